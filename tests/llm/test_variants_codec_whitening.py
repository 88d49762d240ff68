"""Spelling variants, the BPE codec and whitening against brute force and libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from seriesforge.llm import bpe_codec, queries, spelling, whitening

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, word string, n long, ids string, _text string"


@pytest.fixture(scope="module")
def edge(spark):
    rows = [
        (1, "Plain WORDS, plain Éclair; plains plain's planes", "w", 1, "i", "t"),
        (1, "Plain WORDS, plain Éclair; plains plain's planes", "w", 1, "i", "t"),
        (2, None, None, None, None, None),
        (3, "", "w", 1, "i", "t"),
        (None, "plain words without an id", None, 2, None, None),
        (4, "abcde " * 20_000 + "abcdf abcdf abcdf", "w", 1, "i", "t"),
        (5, "y" * 30_000 + " " + "ab" * 20_000, "w", 1, "i", "t"),
        (6, " \t\n\x1c　 ", "w", 1, "i", "t"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, every):
    seen = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if every and key is not None:
                h = zlib.crc32(f"{key}:{run}".encode())
                if h % every == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def brute_variants(words):
    near, form, out = {w: [] for w in words}, {}, {}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), set()).add(w)
    letters = sorted({c for w in words for c in w})
    for w in words:
        made = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = [v for v in made - {w} if v in words]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return set(out.values())


def test_query_equals_brute_force_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in queries.op12_spelling_variants(spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(brute_words(rows, 97))
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in want)


def test_every_near_pair_is_found(spark):
    rng = random.Random(5)
    letters = "abcdeàÿß"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(700)} | {"a" * n for n in range(5, 40)} | {"q" * 5000, "q" * 4999 + "z", "q" * 5001, "q" * 5002}
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = [(r["word"], r["other"]) for r in spelling.near_words(table).collect()]
    ordered = sorted(words)
    want = {(a, b) for a in ordered for b in ordered if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_long_chains_of_forms_are_followed(spark):
    chain = [("a" * (5 + i), 2**i) for i in range(20)]
    out = spelling.group_variants(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {r["root"] for r in out} == {"a" * 24}
    assert {r["word"]: r["form_n"] for r in out}["a" * 5] == 2 and {r["word"]: r["form"] for r in out}["a" * 24] is None


def test_ties_go_by_code_points(spark):
    words = [("house", 3), ("houze", 6), ("houÿe", 6), ("houseà", 6), ("mouse", 5)]
    out = {r["word"]: r for r in spelling.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert out["house"]["form"] == "houseà" and out["house"]["n_near"] == 4 and out["mouse"]["form"] is None


def test_spelling_edges(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    for every in (None, 3):
        out = spelling.spelling_variants(edge, slip_every=every)
        got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out.collect()]
        assert set(got) == brute_variants(brute_words(rows, every)) and len(got) == len(set(got))
    assert spelling.spelling_variants(empty).count() == 0


def test_tasks_pass_counts_on_early(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, spelling.count_words(docs, flush_at=50).collect())) == sorted(map(tuple, spelling.count_words(docs).collect()))


# --- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def same(library, codec, text):
    ids, decoded = codec.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<i4").tolist() == want, repr(text[:80])
    assert decoded == library.decode(want, skip_special_tokens=False), repr(text[:80])


def test_codec_equals_the_library_on_odd_texts(library):
    codec = bpe_codec.Codec(PATH)
    rng = random.Random(3)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", "'s", "'LL", "don't", " ", "\t", "\x1c", "\x85", "　", " ", "é", "é", "ΟΔΟΣ", "Σ", "İ", "ǅ", "ﬁ", "K", "µ", "ß", "½", "12", "٣", "漢字", "한국", "👩‍👩‍👧", "​", "\x00", "a" * 30, "thing", "WORDS", "...", "</w>", "ー", "क्षि", "x" * 200]
    texts = ["", *pieces, *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(3000))]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x370, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    for text in texts:
        same(library, codec, text)


def test_long_words_merge_in_the_same_order(library):
    codec = bpe_codec.Codec(PATH)
    rng = random.Random(4)
    for n in (95, 96, 97, 98, 500, 20_000):
        for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz"):
            same(library, codec, "".join(rng.choice(letters) for _ in range(n)))
    table = codec.table
    for _ in range(300):
        word = "".join(rng.choice("theinganrsto") for _ in range(rng.randint(2, 60)))
        assert table.merge(table.parts(word)) == table._merge_linked(table.parts(word))


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe_codec, "MEMO_ENTRIES", 50)
    codec = bpe_codec.Codec(PATH)
    text = " ".join(f"word{i % 170}" for i in range(2000)) + " " + "z" * 500
    assert codec.encode(text) == bpe_codec.Codec(PATH).encode(text)
    assert len(codec) <= 50 and len(codec.old) <= 50 and "z" * 500 not in codec


def test_chunks_share_the_merges_of_their_words(monkeypatch, library):
    codec, merges = bpe_codec.Codec(PATH), []
    merge = bpe_codec.RankTable.merge
    monkeypatch.setattr(bpe_codec.RankTable, "merge", lambda self, parts: merges.append(len(parts)) or merge(self, parts))
    text = "Seriesforge seriesforge, SERIESFORGE. (seriesforge) Éseries éseries,"
    same(library, codec, text)
    assert len(merges) == 6  # seriesforge , . ( ) éseries


def test_words_that_come_again_after_many_others_are_not_merged_again(monkeypatch):
    codec, merges = bpe_codec.Codec(PATH), []
    monkeypatch.setattr(bpe_codec.RankTable, "merge", lambda self, parts: merges.append(1) or parts)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [letters[i % 26] + letters[i // 26 % 26] + letters[i // 676 % 26] + letters[i // 17_576 % 26] for i in range(250_000)]
    for _ in range(2):
        codec.encode(" ".join(words))
    assert len(merges) == len(words)


def test_codec_query_equals_the_library(spark, sf_dir, edge, empty, library):
    def want(rows):
        out = Counter()
        for key, text in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            digests = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
            out[key, len(ids), *(hashlib.sha256(d.encode()).hexdigest() for d in digests)] += 1
        return out

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op13_bpe_codec(spark, sf_dir).collect())) == want(rows)
    coded = bpe_codec.encode_and_decode(edge, PATH, keep=["doc_id", "ids", "_text"], ids_col="numbers")
    got = Counter((r["doc_id"], len(r["numbers"]), *(hashlib.sha256(d.encode()).hexdigest() for d in (" ".join(map(str, r["numbers"])), r["decoded"]))) for r in coded.collect())
    assert got == want([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert bpe_codec.encode_and_decode(empty, PATH).count() == 0


def test_ids_decode(spark, library):
    rows = spark.createDataFrame([(1, [320, 49407, 256]), (2, []), (3, None)], "doc_id long, ids array<int>")
    out = {r["doc_id"]: r["decoded"] for r in bpe_codec.decode_ids(rows, PATH).collect()}
    assert out == {1: library.decode([320, 49407, 256], skip_special_tokens=False), 2: "", 3: None}


# --- whitening


def exact_fit(vectors):
    x = np.array(sorted({tuple(int(v) for v in np.floor(64 * np.asarray(c, float)) + 1_000_000) for c in vectors}), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((n * x - sums) / n).astype(float)
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], directions[:, ::-1]


def check_whitening(rows, vectors, most=16):
    """rows of the operator against a dense decomposition of the same numbers; vectors: (id, entries) of valid rows."""
    n, sums, values, directions = exact_fit([v for _, v in vectors])
    kept = min(most, int((values > 1e-10 * values.sum()).sum()))
    by_id = {}
    for r in rows:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert len(rows) == kept * len(vectors)
    signs = None
    for key, v in vectors:
        x = np.floor(64 * np.asarray(v, float)).astype(int) + 1_000_000
        mine = sorted(by_id[key], key=lambda r: r["component"])
        assert {r["n"] for r in mine} == {n} and {r["deviation"] for r in mine} == {sum(int(n * int(a) - s) ** 2 for a, s in zip(x, sums))}
        want = ((x - (sums / n).astype(float)) @ directions / np.sqrt(np.maximum(values, 1e-300)))[:kept]
        got = np.array([r["whitened"] for r in mine])[:kept]
        if signs is None and np.abs(want).min() > 1e-3:
            signs = np.sign(want * got)
        assert np.allclose(np.abs(got), np.abs(want), rtol=1e-6, atol=1e-7)
        if signs is not None:
            assert np.allclose(got * signs, want, rtol=1e-6, atol=1e-7)
        assert np.allclose([r["explained"] for r in mine][:kept], (values / values.sum())[:kept], rtol=1e-9)
        assert all(r["identity_error"] < 1e-8 for r in mine)


def test_whitening_of_the_table(spark, sf_dir):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitening(queries.op11_incremental_whitening(spark, sf_dir).collect(), vectors)


@pytest.mark.parametrize("dim, n, kind", [(1, 9, "plain"), (6, 100, "plain"), (6, 100, "copies"), (9, 40, "low rank"), (12, 5, "plain"), (20, 300, "few values")])
def test_updates_give_the_spectrum(dim, n, kind):
    rng = np.random.default_rng(dim * n)
    x = rng.integers(-80, 80, (n, dim))
    if kind == "copies":
        x = x[rng.integers(0, 7, n)]
    if kind == "low rank":
        x = x[:, [0, 1, 2] * (dim // 3)]
    if kind == "few values":
        x = np.sign(x)
    whole = np.cov(x.T.astype(float), bias=True).reshape(dim, dim) * n
    for many in (1, 4):
        spectra = whitening.Spectra(many, dim)
        for at in range(0, n, many):
            spectra.add(x[at : at + many])
        one = whitening.Spectra.of_rows([spectra.joined().row()], dim)
        scale = max(1.0, np.abs(whole).max())
        assert one.count[0] == n and (one.sums[0] == x.sum(axis=0)).all() and (np.diff(one.values[0]) >= 0).all()
        assert np.abs(one.vectors[0].T @ one.vectors[0] - np.eye(dim)).max() < 1e-10
        assert np.abs(one.vectors[0] * one.values[0] @ one.vectors[0].T - whole).max() < 1e-10 * scale * dim


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(60)]
    copies = [(100 + i, good[7][1]) for i in range(90)]
    bad = [(900, None), (901, [1.0, nan, 0.0, 0.0, 0.0]), (902, [1.0, inf, 0.0, 0.0, 0.0]), (903, [1.0, None, 0.0, 0.0, 0.0]), (904, [])]
    schema = "vec_id long, embedding array<float>, x string, component int, n long, _v string"
    table = spark.createDataFrame([(i, v, "a", 1, 2, None) for i, v in good + copies + bad], schema)
    valid = [(r["vec_id"], r["embedding"]) for r in table.collect() if r["vec_id"] < 900]
    check_whitening(whitening.whiten(table.repartition(7)).collect(), valid)
    assert whitening.whiten(table.where("vec_id >= 900")).count() == 0 and whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.where("vec_id = 3")).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_large_numbers_stay_exact():
    x, sums = np.array([[3, -5]]), np.array([2**61, -7])
    assert whitening._centred(x, 2**61, sums).tolist() == [[3 * 2**61 - 2**61, -5 * 2**61 + 7]]
