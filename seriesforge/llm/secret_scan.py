"""Secret scans with a random forest for false-positive removal.

DataFrame functions and Spark's own forest only.

A run is a stretch of ``A-Z a-z 0-9 + / _ . @ -`` with up to two ``=`` behind
it; every run of a word is looked at, wherever it stands in it. Candidates are
runs of 12 or more characters that hold a digit, runs of 20 or more that change
between upper and lower case, and any run of 6 or more to which a credential's
name assigns (``=`` or ``:``).

Each is described by its length, the share of adjacent characters that change
class (upper, lower, digit, other), the share of each class, how much of it
words of the corpus cover, and by what is learned of its surroundings: of the
path (source), of the word and of the signs in front of it and of the word
behind it, the share of labelled findings with the same surroundings that are
secrets. In training these shares come from the other half of the findings.

The covering words are the most frequent short words of all documents,
counted whole; only that bounded list reaches the driver.

Labelled findings are any table with ``candidate``, ``before``, ``after``,
``path`` and a 0/1 ``label``. Where none was written by hand, ``rule_labels``
derives them: key formats of known issuers and random-looking values assigned
to a credential's name are positive, what has the form of a mail address, an
address, a number, a checksum without a name or of words is negative. No
feature states such a form or name: the forest judges by the features above,
also what no rule names.

Defined results: null and empty texts have no candidates; every occurrence is a
finding with its word's position in the text and its own in the word; repeated
rows give repeated findings; nulls in the path count as an empty path. Without
labels of both kinds no forest can be trained: then what is labelled 1 scores 1
and all else 0. Columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

# Names that stand before credentials.
CREDENTIAL_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "private_key", "bearer")
# Formats of known issuers.
ISSUER_FORMATS = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{35}$|^sk_(live|test)_[A-Za-z0-9]{16,}$|^glpat-[A-Za-z0-9_-]{20}$"
SIGNS = "A-Za-z0-9+/_.@-"
RUN = rf"([^{SIGNS}]*)([{SIGNS}]+={{0,2}})"
NAMED = rf"(?i)({'|'.join(CREDENTIAL_NAMES)})[\"']?\s*[=:]+>?\s*[\"']?$"
SURROUNDINGS = ["path", "before_word", "before_signs", "after_word"]
FEATURES = ["length", "transitions", "upper", "lower", "digits", "others", "coverage", *(f"{c}_rate" for c in SURROUNDINGS)]


@dataclass(frozen=True)
class SecretModel:
    """The forest, the covering words, and for each kind of surroundings a small table of labelled findings."""

    forest: PipelineModel | None
    words: list[str]
    rates: dict[str, DataFrame]
    prior: float


def find_candidates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, path, word_no, run_no, candidate, before, after) of every candidate.

    A narrow pass: words are cut, numbered and filtered within each row.
    """
    words = F.split(F.col(f"`{text_col}`"), r"\s+")
    rows = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")).alias("path"), words.alias("_w"))
    # Cheap tests first: most words are short and follow a word that ends in a letter.
    found = F.expr(
        rf"""filter(transform(_w, (w, i) -> if(
               (length(w) >= 12 and (w rlike '[0-9]' or length(w) >= 20))
               or (length(w) >= 7 and (contains(w, '=') or contains(w, ':')))
               or (length(w) >= 6 and i > 0 and right(get(_w, i - 1), 1) in ('=', ':', '>', '"', "'")),
               struct(i as word_no, w as word, concat_ws(' ', get(_w, i - 2), get(_w, i - 1)) as before, coalesce(get(_w, i + 1), '') as after), null)),
             c -> c is not null)"""
    )
    each = rows.select("doc_id", "path", F.explode(found).alias("c")).select("doc_id", "path", "c.*")
    runs = each.withColumn("_gaps", F.regexp_extract_all("word", F.lit(RUN), 1)).withColumn("_runs", F.regexp_extract_all("word", F.lit(RUN), 2))
    numbered = runs.select("doc_id", "path", "word_no", "before", "after", "_gaps", "_runs", F.posexplode("_runs").alias("run_no", "_run"))
    # A sign of assignment at a run's end belongs to what follows it.
    glued = F.expr("coalesce(get(_gaps, run_no + 1), 'x') = '' and endswith(_run, '=')")
    value = F.rtrim(F.when(glued, F.rtrim("_run", F.lit("="))).otherwise(F.col("_run")), F.lit("."))
    front = F.when(F.col("run_no") == 0, F.concat(F.col("before"), F.lit(" "), F.get("_gaps", F.lit(0)))).otherwise(F.concat(F.expr("get(_runs, run_no - 1)"), F.expr("get(_gaps, run_no)")))
    behind = F.expr("coalesce(get(_runs, run_no + 1), after)")
    out = numbered.select("doc_id", "path", F.col("word_no").cast("long").alias("word_no"), F.col("run_no").cast("long").alias("run_no"), value.alias("candidate"), front.alias("before"), behind.alias("after"))
    size = F.length("candidate")
    random_like = (size >= 12) & F.col("candidate").rlike("[0-9]")
    mixed = (size >= 20) & F.col("candidate").rlike("[a-z][A-Z]+[a-z]+[A-Z]")
    return out.where(random_like | mixed | ((size >= 6) & F.col("before").rlike(NAMED)))


def frequent_words(documents: DataFrame, n: int = 400, text_col: str = "text") -> list[str]:
    """The n most frequent words of 3 to 8 letters over all documents."""
    words = documents.select(F.explode(F.split(F.lower(F.col(f"`{text_col}`")), r"[^\p{L}]+")).alias("w")).where(F.length("w").between(3, 8))
    rows = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(n).collect()
    return sorted((r["w"] for r in rows), key=lambda w: (-len(w), w))


def _share(pattern: str) -> Column:
    return (F.length("candidate") - F.length(F.regexp_replace("candidate", pattern, ""))) / F.length("candidate")


def describe(findings: DataFrame, words: list[str]) -> DataFrame:
    """The findings with their own features and the columns of their surroundings."""
    kinds = F.translate("candidate", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    covered = F.aggregate(F.array(*map(F.lit, words)) if words else F.array().cast("array<string>"), F.lower("candidate"), lambda rest, w: F.replace(rest, w, F.lit("")))
    return (
        findings.withColumn("_kinds", kinds)
        .withColumn("length", F.length("candidate").cast("double"))
        .withColumn("transitions", F.expr("size(filter(sequence(2, greatest(2, length(_kinds))), i -> substring(_kinds, i, 1) != substring(_kinds, i - 1, 1))) / length(_kinds)"))
        .withColumn("upper", _share("[A-Z]"))
        .withColumn("lower", _share("[a-z]"))
        .withColumn("digits", _share("[0-9]"))
        .withColumn("others", _share("[^A-Za-z0-9]"))
        .withColumn("coverage", 1 - F.length(covered) / F.length("candidate"))
        .withColumn("before_word", F.regexp_extract(F.lower("before"), r"([\p{L}_]+)[^\p{L}_]*$", 1))
        .withColumn("before_signs", F.regexp_extract("before", r"([^\p{L}0-9_]*)$", 1))
        .withColumn("after_word", F.regexp_extract(F.lower("after"), r"([\p{L}_]+)", 1))
        .drop("_kinds")
    )


def _with_rates(described: DataFrame, rates: dict[str, DataFrame], prior: float, training: bool) -> DataFrame:
    """The shares of secrets among labelled findings of the same surroundings."""
    for name in SURROUNDINGS:
        described = described.join(F.broadcast(rates[name]), name, "left")  # as many rows as labelled findings at most
        sums = [F.coalesce(c, F.lit(0.0)) for c in ("_n0", "_s0", "_n1", "_s1")]
        seen, of = (F.when(F.col("_fold") == 0, sums[2 + k]).otherwise(sums[k]) if training else sums[k] + sums[2 + k] for k in (0, 1))
        described = described.withColumn(f"{name}_rate", (of + 2 * prior) / (seen + 2)).drop("_n0", "_s0", "_n1", "_s1")
    return described


def rule_labels(findings: DataFrame) -> DataFrame:
    """``label`` 1.0 or 0.0 by format; null where no rule speaks."""
    candidate = F.col("candidate")
    named = F.col("before").rlike(NAMED)
    random_like = candidate.rlike(r"^[A-Za-z0-9+/_=.-]{16,}$") & candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")
    negative = candidate.rlike(r"@[\w-]+\.|^[0-9.+/_-]+$|^https?:|^//") | (candidate.rlike("^[0-9a-fA-F]{32,64}$") & ~named) | candidate.rlike(r"^[a-z]+([-_./=][a-z]+)+$")
    return findings.withColumn("label", F.when(candidate.rlike(ISSUER_FORMATS), 1.0).when(named & random_like, 1.0).when(negative, 0.0))


def train_forest(labelled: DataFrame, words: list[str], max_rows: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 7) -> SecretModel:
    """Fit on at most ``max_rows`` labelled findings, in the order of a hash."""
    order = F.xxhash64("candidate", "before", "path", "after")
    sample = stash(describe(labelled.where("label is not null").orderBy(order).limit(max_rows), words).select("label", F.pmod(F.xxhash64("candidate"), F.lit(2)).alias("_fold"), *FEATURES[:-4], *SURROUNDINGS), "labelled")
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return SecretModel(None, words, {}, 0.0)
    prior = counts[1.0] / sum(counts.values())
    sums = [F.sum(F.when(F.col("_fold") == k, v).otherwise(0.0)).alias(n) for k in (0, 1) for n, v in ((f"_n{k}", F.lit(1.0)), (f"_s{k}", F.col("label")))]
    rates = {c: stash(sample.groupBy(c).agg(*sums), "rates") for c in SURROUNDINGS}
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False)
    rows = _with_rates(sample, rates, prior, True).select("label", *FEATURES)
    return SecretModel(PipelineModel([assembler, forest.fit(assembler.transform(rows))]), words, rates, prior)


def score_findings(findings: DataFrame, model: SecretModel) -> DataFrame:
    """The findings with ``score``."""
    if model.forest is None:
        return rule_labels(findings).select(*findings.columns, F.coalesce("label", F.lit(0.0)).alias("score"))
    rows = _with_rates(describe(findings, model.words), model.rates, model.prior, False)
    return model.forest.transform(rows).select(*findings.columns, vector_to_array("probability")[1].alias("score"))


def scan_secrets(documents: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, path, word_no, run_no, candidate, before, after, score, is_secret) of every candidate."""
    findings = stash(find_candidates(documents, id_col, text_col, path_col), "findings")
    words = frequent_words(documents, text_col=text_col)
    model = train_forest(rule_labels(findings) if labelled is None else labelled, words)
    return score_findings(findings, model).withColumn("is_secret", F.col("score") >= threshold)
