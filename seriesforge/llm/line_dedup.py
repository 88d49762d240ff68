"""Line dedup by content-defined chunks of lines. DataFrame functions only.

A line is what ends at a line feed or at the end of a sentence, so that a
passage which is spliced into a paragraph still has whole lines of its own;
blank lines belong to the line before them.

A rolling hash over two line hashes is taken at every line, and a line of
LONG_LINE words or more has a hash of its own. Chunks are set by these hashes
alone: a chunk runs on as long as the rolling hash repeats, line by line, that
of an earlier place (the least id's, then the least line's) at the same
distance, and its boundaries are where it stops to. They fall alike wherever a
passage stands, and any repeated passage of two lines lies within chunks,
whatever surrounds it. (Marks at fixed values of the rolling hash would lose
every passage that happens to hold none.)

The text of each earlier place goes to the documents that repeat it. There it is
compared with the chunk, byte by byte (but for white space behind its last
line), and equal ones are removed, where what is removed in one stretch has
``min_chars`` characters or more. The
earlier place stays, and a chunk that overlaps its own earlier place is no
repeat.

What is shuffled are hashes and positions. Texts are read again only for the
documents in question, found by a table of id buckets of fixed size; all other
documents pass through. A passage that a third of all documents share is a few
hashes whose counts are added before the shuffle and whose rows meet one row in
a join that Spark splits; nothing is collected by hash. The repeated hashes of
one shuffle partition are held in memory for that join: eight bytes each, and
the number of partitions follows the input.

Defined results: null and empty texts have no lines and stay as they are. Rows
with equal id and equal text are one document: they are treated alike, and no
occurrence in one is a repeat of the other. Ids that are no whole numbers come
after all others, in the order of their strings, and rows without id last. With
``whole_copy_share`` a document that would lose that share of its characters or
more is left whole, to document dedup, if it is a near-copy: if its five-word
shingles have a Jaccard similarity of 0.8 or more, compared exactly, with what
is kept of the document that holds most of its earlier places (one that would
not lose that share itself). All others are cut.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stash

LINE_ENDS = r"(?<=\n)(?!\n)|(?<=[.!?] )(?!\n)"
BUCKETS = 1 << 20
NEAR_COPY = 0.8  # Jaccard similarity of five-word shingle sets
LONG_LINE = 50  # words from which a line alone is a chunk


def _lines(text: str) -> str:
    """SQL that cuts a text at LINE_ENDS.

    Plain replacements set a mark that is then split at, which is several times
    as fast as looking behind each character; a text that holds the mark itself
    is cut by the pattern.
    """
    marked = text
    for end in (r"\n", ". ", "! ", "? "):
        marked = f"replace({marked}, '{end}', '{end}\\u001e')"
    marked = f"replace({marked}, '\\u001e\\n', '\\n')"
    pattern = LINE_ENDS.replace("\\", "\\\\")
    return f"if(contains({text}, '\\u001e'), split({text}, '{pattern}'), split({marked}, '\\u001e'))"


def _bare(text: str) -> str:
    """SQL of a text without white space behind its last line."""
    return f"rtrim(replace({text}, '\\n', ' '))"


def _rolling(rows: DataFrame) -> DataFrame:
    """(_key, document's columns, _lo, _hi): the hash of each two lines in a row, and of each long line.

    Lines become hashes within their row, so that what is exploded is numbers.
    """
    who = [c for c in rows.columns if c != "_text"]
    # A long line has a negative number. Only lines that begin with white space can be blank, and these are less than '!'.
    hashes = f"""element_at(transform(array({_lines("_text")}), l -> concat(
        transform(slice(l, 2, size(l)), (x, i) -> named_struct('key', if(x < '!' and {_bare("x")} = '', null, xxhash64(get(l, i), {_bare("x")})), 'at', i)),
        filter(transform(l, (x, i) -> if(octet_length(x) >= {2 * LONG_LINE - 1} and length(x) >= {2 * LONG_LINE - 1} and regexp_count(x, '\\\\S+') >= {LONG_LINE}, named_struct('key', xxhash64({_bare("x")}), 'at', -1 - i), null)), h -> h is not null))), 1)"""
    each = rows.select(*who, F.explode(F.expr(hashes)).alias("_h")).select(*who, F.col("_h.key").alias("_key"), F.col("_h.at").alias("_at"))
    pair = F.col("_at") >= 0
    lo = F.when(pair, F.col("_at")).otherwise(-1 - F.col("_at"))
    return each.where("_key is not null").select("_key", *who, lo.alias("_lo"), (lo + F.when(pair, 2).otherwise(1)).alias("_hi"))


def _bucket(doc: str = "_doc") -> Column:
    return F.pmod(doc, F.lit(BUCKETS))


def _texts_of(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(_doc, _text) of these documents and of the few others in their buckets."""
    wanted = F.broadcast(docs.select(_bucket().alias("_bucket")).distinct())  # BUCKETS rows at most
    return rows.select("_doc", "_text").withColumn("_bucket", _bucket()).join(wanted, "_bucket", "left_semi").dropDuplicates(["_doc"]).select("_doc", "_text")


def claimed_chunks(rows: DataFrame) -> DataFrame:
    """(_doc, _lo, _hi, _bytes, _holder): chunks whose hashes occur at an earlier place, with the bytes there, in the document ``_holder``.

    ``rows``: _doc, _order (of the document among all, in steps of 2**31), _text.
    """
    hashes = _rolling(rows)
    # A place is the document's order and the line, as one number: so the first place is found as the hashes are counted.
    place = F.col("_order") + F.col("_lo")
    counted = hashes.select("_key", "_doc", place.alias("_place")).groupBy("_key").agg(F.count("*").alias("_n"), F.min("_place").alias("_place"), F.min_by("_doc", "_place").alias("_holder"))
    repeated = counted.where("_n > 1").select("_key", "_holder", F.pmod("_place", F.lit(2**31).cast("decimal(10,0)")).cast("int").alias("_flo"))
    # Written by itself, so the join has two plain sides, and Spark can split hot hashes.
    repeated = stash(repeated, "repeated")
    joined = hashes.select("_key", "_doc", "_lo", "_hi").join(repeated.hint("shuffle_hash"), "_key").select("_doc", "_lo", "_hi", "_holder", (F.col("_flo") - F.col("_lo")).alias("_shift"))
    later = joined.where((F.col("_doc") != F.col("_holder")) | (F.col("_shift") <= F.col("_lo") - F.col("_hi")))
    # Hashes in a row that repeat the same place are one chunk.
    rank = F.dense_rank().over(Window.partitionBy("_doc", "_holder", "_shift").orderBy("_lo"))
    chunks = later.withColumn("_chunk", F.col("_lo") - rank).groupBy("_doc", "_holder", "_shift", "_chunk").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    chunks = stash(chunks.select("_doc", "_lo", "_hi", "_holder", (F.col("_lo") + F.col("_shift")).alias("_flo"), (F.col("_hi") + F.col("_shift")).alias("_fhi")), "chunks")
    discard(repeated)
    places = chunks.select("_holder", "_flo", "_fhi").distinct().groupBy(F.col("_holder").alias("_doc")).agg(F.collect_list(F.struct("_flo", "_fhi")).alias("_places"))  # of a document's lines
    texts = _texts_of(rows, chunks.select(F.col("_holder").alias("_doc")))
    # A text is cut once below the explode, whatever the number of its places.
    lines = places.join(texts, "_doc").select("_doc", F.expr(_lines("_text")).alias("_l"), "_places").select("_doc", "_l", F.explode("_places").alias("_p"))
    firsts = lines.select(F.col("_doc").alias("_holder"), "_p._flo", "_p._fhi", F.expr(_bare("array_join(slice(_l, _p._flo + 1, _p._fhi - _p._flo), '')")).alias("_bytes"))
    claims = stash(chunks.join(firsts, ["_holder", "_flo", "_fhi"]).select("_doc", "_lo", "_hi", "_bytes", "_holder"), "claims")
    discard(chunks)
    return claims


def _by_document(claims: DataFrame) -> DataFrame:
    """(_doc, _claims): a document's claims are bounded by its lines."""
    return claims.groupBy("_doc").agg(F.collect_list(F.struct("_lo", "_hi", "_bytes")).alias("_claims"))


def _cut(text: str, min_chars: int) -> str:
    """SQL of struct(kept, removed): the text without the claimed chunks whose bytes are right, in stretches of ``min_chars``, and the number of lines removed."""
    size = f"length({_bare("array_join(slice(lines, s._lo + 1, s._hi - s._lo), '')")})"
    right = f"filter(_claims, c -> {_bare("array_join(slice(lines, c._lo + 1, c._hi - c._lo), '')")} = c._bytes)"
    places = f"array_sort(array_distinct(transform({right}, c -> struct(c._lo as _lo, c._hi as _hi))))"
    joined = f"""aggregate({places}, cast(array() as array<struct<_lo:int,_hi:int>>), (done, s) ->
        if(size(done) > 0 and element_at(done, -1)._hi >= s._lo,
           concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1)._lo as _lo, greatest(element_at(done, -1)._hi, s._hi) as _hi))),
           concat(done, array(s))))"""
    kept = """array_join(transform(concat(spans, array(struct(size(lines) as _lo, size(lines) as _hi))),
        (s, i) -> array_join(slice(lines, coalesce(get(spans, i - 1)._hi, 0) + 1, s._lo - coalesce(get(spans, i - 1)._hi, 0)), '')), '')"""
    removed = "aggregate(spans, 0L, (n, s) -> n + s._hi - s._lo)"
    return f"""element_at(flatten(transform(array({_lines(text)}), lines -> transform(array(filter({joined}, s -> {size} >= {min_chars})),
        spans -> struct({kept} as kept, {removed} as removed)))), 1)"""


def _shingles(text: str) -> str:
    """SQL of the set of five-word shingle hashes of a text, words as in the near-dedup stage."""
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"filter(split({lower}, '[ \\\\x09-\\\\x0D]+'), w -> w != '')"
    return f"element_at(transform(array({words}), ws -> array_distinct(transform(sequence(0, greatest(size(ws) - 5, 0)), i -> xxhash64(slice(ws, i + 1, 5))))), 1)"


def near_copies(rows: DataFrame, claims: DataFrame, share: float, min_chars: int) -> DataFrame:
    """(_doc) of the documents that would lose ``share`` of their characters and are near-copies of what is kept of the document they repeat most."""
    lost = claims.groupBy("_doc").agg(F.sum(F.length("_bytes")).alias("_lost"))
    lengths = rows.select("_doc", F.length("_text").alias("_length")).dropDuplicates(["_doc"])
    large = stash(lost.join(lengths, "_doc").where(F.col("_lost") >= share * F.col("_length")).select("_doc"), "large")
    lines = claims.join(large, "_doc", "left_semi").where("_holder != _doc").groupBy("_doc", "_holder").agg(F.sum(F.length("_bytes")).alias("_n"))
    most = lines.groupBy("_doc").agg(F.max(F.struct("_n", "_holder")).alias("_m")).select("_doc", F.col("_m._holder").alias("_holder"))
    pairs = stash(most.join(large.select(F.col("_doc").alias("_holder")), "_holder", "left_anti"), "pairs")
    discard(large)
    texts = _texts_of(rows, pairs.select("_doc").unionByName(pairs.select(F.col("_holder").alias("_doc"))))
    copies = pairs.join(texts, "_doc").select("_doc", "_holder", F.expr(_shingles("_text")).alias("_a"))
    cut = F.when(F.col("_claims").isNull(), F.col("_text")).otherwise(F.expr(_cut("_text", min_chars))["kept"])
    wanted = pairs.select(F.col("_holder").alias("_doc")).distinct()
    own = _by_document(claims.join(wanted, "_doc", "left_semi"))
    holders = texts.join(wanted, "_doc", "left_semi").join(own, "_doc", "left").select(F.col("_doc").alias("_holder"), cut.alias("_text"))
    both = copies.join(holders.select("_holder", F.expr(_shingles("_text")).alias("_b")), "_holder")
    sizes = both.select("_doc", F.size("_a").alias("_na"), F.size("_b").alias("_nb"), F.size(F.array_intersect("_a", "_b")).alias("_n"))
    whole = stash(sizes.where(F.col("_n") / (F.col("_na") + F.col("_nb") - F.col("_n")) >= NEAR_COPY).select("_doc"), "whole")
    discard(pairs)
    return whole


def dedup_lines(documents: DataFrame, min_chars: int = 64, whole_copy_share: float | None = None, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """The documents with repeated chunks of lines taken out of their texts.

    All columns and rows stay; ``removed_col`` adds the number of lines removed
    (a column of that name is replaced).
    """
    names = documents.columns
    inner = [f"c{i}" for i in range(len(names))]
    doc, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    keyed = documents.toDF(*inner).withColumn("_doc", F.xxhash64(doc, text))
    number = F.col(doc) if isinstance(documents.schema[id_col].dataType, T.IntegralType) else F.expr(f"try_cast({doc} AS bigint)")
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(doc).cast("string")), 2).cast("decimal(20,0)") + F.lit(Decimal(2**63))
    order = F.coalesce(number.cast("decimal(20,0)"), F.when(F.col(doc).isNotNull(), hashed), F.lit(Decimal(2**64))).cast("decimal(20,0)")
    order = (order * F.lit(2**16).cast("decimal(5,0)") + F.col("_doc").bitwiseAND(2**16 - 1)).cast("decimal(26,0)")  # rows of one id by their hash
    order = (order * F.lit(2**31).cast("decimal(10,0)")).cast("decimal(36,0)")
    rows = keyed.select("_doc", order.alias("_order"), F.col(text).alias("_text")).where(F.length("_text") > 0)
    claims = claimed_chunks(rows)
    if whole_copy_share is not None:
        whole = near_copies(rows, claims, whole_copy_share, min_chars)
        every, claims = claims, stash(claims.join(whole, "_doc", "left_anti"), "claims")
        discard(every)
    wanted = F.broadcast(claims.select(_bucket().alias("_bucket")).distinct())  # BUCKETS rows at most
    with_bucket = keyed.withColumn("_bucket", F.when(F.length(text) > 0, _bucket()))
    touched = with_bucket.join(wanted, "_bucket", "left_semi").join(_by_document(claims), "_doc", "left").select(*inner, F.when(F.col("_claims").isNotNull(), F.expr(_cut(text, min_chars))).alias("_cut"))
    untouched = with_bucket.join(wanted, "_bucket", "left_anti").select(*inner, F.lit(None).cast(touched.schema["_cut"].dataType).alias("_cut"))
    out = touched.unionByName(untouched)
    columns = [(F.coalesce("_cut.kept", text) if i == text else F.col(i)).alias(c) for i, c in zip(inner, names) if c != removed_col]
    if removed_col:
        columns.append(F.coalesce("_cut.removed", F.lit(0)).alias(removed_col))
    return out.select(*columns)
