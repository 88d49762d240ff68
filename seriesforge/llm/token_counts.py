"""Token counts from pieces counted once per distinct pre-token.

The model marks a space in front of a piece and never inside one, so merges
stay within a pre-token: a run of spaces and the characters up to the next
space. The count of a text is the sum over its pre-tokens.

1. Vocabulary: every task counts its pre-tokens, Spark adds the counts, and
   each distinct pre-token is split into pieces once. The table is written to
   the shared folder.
2. Texts: the ``head`` most frequent pre-tokens (a bounded number of bounded
   length, so at most ``head * head_bytes`` bytes whatever the input) go to the
   tasks as a table; a text's frequencies of these are summed where they are
   counted. All other frequencies, the rare ones, are joined to the vocabulary
   by the pre-token and summed by text. No id list is ever built for a text.

Defined results: null and empty texts have 0 tokens. Repeated rows are counted
each for themselves; every row of the input gives one row.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices, stash

SPACE_MARK = "▁"
_RUNS = re.compile(r" +[^ ]*")


def pre_tokens(text: str | None) -> list[str]:
    """The text cut in front of each run of spaces.

    A pre-token is given without its first space, which the model puts in
    front of whatever it encodes.
    """
    if not text:
        return []
    text = text.replace(SPACE_MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUNS.findall(" " + text)]


def piece_count(processor, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token; of an empty one the mark of its space."""
    return [len(ids) if t else 1 for t, ids in zip(tokens, processor.encode(tokens, num_threads=1))]


def pre_token_vocabulary(documents: DataFrame, model_path: str, text_col: str = "text", flush_at: int = 600_000, flush_chars: int = 100_000_000) -> DataFrame:
    """(pre_token, n_pieces, frequency) for every distinct pre-token of the table.

    A task passes its counts on when it holds ``flush_at`` different
    pre-tokens, or has read ``flush_chars`` characters, and so holds no more.
    """

    def count(batches):
        seen: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pre_token", "n"])

        read = 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(pre_tokens(text))
                read += len(text or "")
            if len(seen) >= flush_at or read >= flush_chars:
                yield out()
                seen.clear()
                read = 0
        if seen:
            yield out()

    def pieces(batches):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in slices(batches):
            counts = piece_count(processor, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), batch.column(1)], names=["pre_token", "n_pieces", "frequency"])

    counted = in_batches(documents.select(F.col(f"`{text_col}`")), count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("frequency"))
    return in_batches(counted, pieces, "pre_token string, n_pieces long, frequency long")


def _frequent(vocabulary: DataFrame, head: int, head_bytes: int) -> tuple[bytes, int]:
    """The pre-tokens of the lowest frequency at which no more than ``head`` qualify, and above, as Arrow bytes."""
    short = vocabulary.where(F.octet_length("pre_token") <= head_bytes)
    histogram = short.groupBy(F.least("frequency", F.lit(10_000)).alias("f")).agg(F.count("*").alias("n")).collect()  # 10,000 rows at most
    least, total = 10_001, 0
    for f, n in sorted(((r["f"], r["n"]) for r in histogram), reverse=True):
        total += n
        if total > head:
            break
        least = f
    rows = short.where(F.col("frequency") >= least).select("pre_token", F.col("n_pieces").cast("int").alias("n_pieces")).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows)
    return sink.getvalue().to_pybytes(), least


_KEPT: dict[int, dict[str, int]] = {}


def _pieces_of(table) -> dict[str, int]:
    """The broadcast table as a dict, built once per worker process."""
    data = table.value
    key = hash(data)
    if key not in _KEPT:
        _KEPT.clear()
        rows = pa.ipc.open_stream(data).read_all()
        _KEPT[key] = dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    return _KEPT[key]


def count_tokens(documents: DataFrame, model_path: str, head: int = 1_500_000, head_bytes: int = 48, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of the input: doc_id, n_bytes, n_tokens, over_limit.

    ``head`` and ``head_bytes`` bound what is held in a task; they do not
    change the result.
    """
    spark = documents.sparkSession
    vocabulary = stash(pre_token_vocabulary(documents, model_path, text_col), "vocabulary")
    frequent, least = _frequent(vocabulary, head, head_bytes)
    table = spark.sparkContext.broadcast(frequent)
    others = vocabulary.where((F.octet_length("pre_token") > head_bytes) | (F.col("frequency") < least))
    source = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_t"))
    names = ["doc_id", "row_key", "n_bytes", "n_tokens", "pre_token", "n"]
    schema = T.StructType([source.schema["doc_id"]] + [T.StructField(c, T.StringType() if c == "pre_token" else T.LongType()) for c in names[1:]])

    def split(batches):
        """A row for each text with the sum of its known pre-tokens, and one for each rare pre-token of it."""
        pieces, key = _pieces_of(table), TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            ids, keys, sizes, sums, tokens, counts = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                key += 1
                known, rare = 0, {}
                for token in pre_tokens(text):
                    n = pieces.get(token)
                    if n is None:
                        rare[token] = rare.get(token, 0) + 1
                    else:
                        known += n
                ids += [i, *[None] * len(rare)]
                keys += [key] * (len(rare) + 1)
                sizes += [len(text.encode()) if text else 0, *[None] * len(rare)]
                sums += [known, *[None] * len(rare)]
                tokens += [None, *rare]
                counts += [None, *rare.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(x, pa.int64()) for x in (keys, sizes, sums)), pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], names=names)

    rows = stash(in_batches(source, split, schema), "frequencies")
    rare = rows.where("pre_token is not null").select("row_key", "pre_token", F.col("n").cast("int").alias("n"))
    rare = rare.join(others.select("pre_token", F.col("n_pieces").cast("int").alias("n_pieces")), "pre_token").select("row_key", (F.col("n") * F.col("n_pieces")).cast("long").alias("n_tokens"))
    texts = rows.where("pre_token is null").select("row_key", "doc_id", "n_bytes", "n_tokens")
    summed = rare.groupBy("row_key").agg(F.sum("n_tokens").alias("_rare"))
    total = texts.join(summed, "row_key", "left").select("doc_id", "n_bytes", (F.col("n_tokens") + F.coalesce("_rare", F.lit(0))).alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
