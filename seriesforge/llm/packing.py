"""Best-fit packing with patterns fitted by non-negative least squares.

1. Texts become pieces of at most ``capacity`` tokens (one narrow pass; only
   lengths and checksums leave it).
2. The histogram of piece lengths (at most ``capacity`` counts, whatever the
   input's size) goes to the driver. There, patterns of one to four lengths
   that fill a sequence exactly are enumerated, repeat counts are fitted to
   the histogram by non-negative least squares and rounded down to what the
   histogram holds, and the residual histogram is packed best fit decreasing.
   Whole runs of equal lengths are moved at once, so the work follows the
   number of lengths and not the number of documents.
3. The plan is a short list of runs ``(length, first rank, count, first
   sequence, offset)``. A piece finds its place by its length and its rank
   among equals. Ranks come from counts per task and length: no window over a
   hot length, no sort of the corpus.

Defined results: a null text is an empty one and gives one piece that holds
the end id alone; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices, stash

_SPACE = re.compile(r"[ \t\n\r]+")
_CONTROL = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the tokenizer
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64
ROUNDS = 6
LEAN = 0.3  # added to a fitted count before it is rounded: every pattern fills its sequence, so rounding up wastes nothing


# Latin letters below U+0130: composed already, lower-cased one to one.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f"
_PLAIN = re.compile(rf"[!-~{_LATIN}]*\Z")
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")


class TokenBytes:
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer drops white space before it merges, so the ids of a text are
    those of its words in a row. Words repeat; their ids are kept in a bounded
    memo, which a worker process keeps for its next task.

    New words of plain Latin letters, digits and ASCII signs are merged by a
    byte-pair library that reads the same vocabulary, many words in a call: a
    zero byte stands for the end of a word. All others go to the tokenizer.
    """

    kept: dict[str, TokenBytes] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        byte_of = {}  # the vocabulary's letter for a byte -> the byte
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        for char in map(chr, range(0x21, 0x130)):
            byte_of.update(zip(level.pre_tokenize_str(char)[0][0], char.encode()))
        ranks: dict[bytes, int] = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            body = token.removesuffix("</w>")
            if token not in special and all(c in byte_of for c in body):
                ranks[bytes(byte_of[c] for c in body) + b"\0" * (body != token)] = i
        self.words = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.is_last = np.zeros(max(ranks.values()) + 1, bool)
        self.is_last[[i for t, i in ranks.items() if t.endswith(b"\0")]] = True

    @classmethod
    def here(cls, path: str) -> TokenBytes:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _encode(self, parts: list[str]) -> list[bytes]:
        plain = {p: _PRE.findall(p.lower()) for p in parts if _PLAIN.match(p) and not self.special.search(p)}
        ids = np.array(self.words.encode_ordinary("".join(f"{w}\0" for words in plain.values() for w in words)), "<u4")
        raw, ends, found, done = ids.tobytes(), [0, *(np.flatnonzero(self.is_last[ids]) + 1).tolist()], {}, 0
        for p, words in plain.items():
            found[p] = raw[4 * ends[done] : 4 * ends[done + len(words)]]
            done += len(words)
        return [found[p] if p in found else np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in parts]

    def of(self, texts: list[str | None]) -> list[bytes]:
        cut = [_SPACE.split(t) if _CONTROL.search(t) else t.split() for t in (t or "" for t in texts)]
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        missing = list(set().union(*cut).difference(known))
        rare = {}
        for part, ids in zip(missing, self._encode(missing)):
            (known if len(part) <= CACHE_CHARS else rare)[part] = ids
        if rare:
            return [b"".join([known[p] if p in known else rare[p] for p in parts]) for parts in cut]
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and its task and rank there."""
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    schema = T.StructType(
        [source.schema["doc_id"]]
        + [T.StructField(n, k) for n, k in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("task_rank", T.LongType()))]
    )
    kind = pa.int64()

    def run(batches):
        tokens, task = TokenBytes.here(tokenizer_path), TaskContext.get().partitionId()
        counts = np.zeros(capacity + 1, np.int64)
        end, step = end_id.to_bytes(4, "little"), capacity * 4
        for batch in slices(batches):
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, ids in enumerate(tokens.of(batch.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    rank.append(counts[n])
                    counts[n] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, kind)), pa.array(piece, pa.int32()), *(pa.array(x, kind) for x in (start, length, crc)), pa.array([task] * len(row), pa.int32()), pa.array(rank, kind)], names=schema.names
            )

    return in_batches(source, run, schema)


def _patterns(capacity: int, present: np.ndarray, most: int = 150_000) -> np.ndarray:
    """Patterns of one to four lengths that are present and sum to the capacity, padded with zeros.

    Of the triples, which grow with the square of the lengths, every so many
    are taken that there are ``most`` at most.
    """
    lengths = np.flatnonzero(present)
    rows = [np.array([[capacity, 0, 0, 0]])]
    rest = capacity - lengths
    rows.append(np.stack([lengths, rest, 0 * rest, 0 * rest], axis=1)[lengths >= rest])
    for times in (2, 3):
        rest = capacity - times * lengths
        rows.append(np.stack([*[lengths] * times, rest, *[0 * rest] * (3 - times)], axis=1)[rest > 0])
    half = capacity // 2 - lengths
    rows.append(np.stack([lengths, lengths, half, half], axis=1)[(half > 0) & (lengths >= half) & (capacity % 2 == 0)])
    triples = []
    for a in lengths.tolist():
        b = lengths[(lengths < a) & (2 * lengths > capacity - a) & (lengths < capacity - a)]
        b = b[present[capacity - a - b]]
        triples.append(np.stack([np.full(len(b), a), b, capacity - a - b, 0 * b], axis=1))
    triples = np.concatenate([np.zeros((0, 4), np.int64), *triples])
    rows.append(triples[:: max(1, -(-len(triples) // most))])
    out = np.concatenate(rows).astype(np.int64)
    out = out[present[out].all(axis=1, where=out > 0)]
    return np.unique(-np.sort(-out, axis=1), axis=0)[::-1]


def _nnls(patterns: np.ndarray, counts: np.ndarray, steps: int = 400, settled: float = 1e-4) -> np.ndarray:
    """min |Ax - counts|, x >= 0, by accelerated projected gradient until no count moves by more than ``settled`` of the largest.

    A is never built: Ax is a weighted bincount of the patterns' lengths and
    its transpose a gather.
    """
    size = len(counts)

    def forward(x):
        return np.bincount(patterns.ravel(), weights=np.repeat(x, patterns.shape[1]), minlength=size) * used

    used = np.ones(size)
    used[0] = 0
    uses = np.bincount(patterns.ravel(), minlength=size)[1:]
    rate = 1.0 / (patterns.shape[1] * max(1, uses.max()))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        residual = (forward(y) - counts) * used
        new = np.maximum(0, y - rate * residual[patterns].sum(axis=1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        moved = np.abs(new - x).max(initial=0)
        x, t = new, t_new
        if moved <= settled * x.max(initial=0):
            break
    return x


def plan_packing(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset) for a histogram.

    ``counts[n]`` is the number of pieces of n tokens, n from 1 to capacity.
    """
    left, taken = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    plan: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        plan.append((length, int(taken[length]), n, sequence, offset))
        taken[length] += n
        left[length] -= n

    for _ in range(ROUNDS):  # what rounding leaves is fitted again
        patterns = _patterns(capacity, left > 0)
        if not len(patterns):
            break
        fitted, before = np.rint(_nnls(patterns, left.astype(float)) + LEAN), sequences
        for i in np.argsort(-fitted, kind="stable"):
            n = int(fitted[i])
            if not n:
                break
            lengths, each = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            n = int(min(n, (left[lengths] // each).min()))
            if n:
                offset = 0
                for length, times in zip(lengths[::-1].tolist(), each[::-1].tolist()):
                    for _ in range(times):
                        place(length, n, sequences, offset)
                        offset += length
                sequences += n
        if sequences == before:
            break
    room: dict[int, list[list[int]]] = {}  # free tokens: runs of [first sequence, count]
    free = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        while left[length]:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                each = capacity // length
                n = max(1, -(-int(left[length]) // each))
                room.setdefault(capacity, []).append([sequences, n])
                free[capacity] = True
                sequences += n
                continue
            space = length + int(fits[0])
            first, n = room[space].pop()
            used = int(min(n, left[length]))
            if used < n:
                room[space].append([first + used, n - used])
            free[space] = bool(room[space])
            place(length, used, first, capacity - space)
            if space > length:
                room.setdefault(space - length, []).append([first, used])
                free[space - length] = True
    return np.array(plan, np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to the rows of ``token_pieces``."""
    pieces = stash(pieces, "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = per_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    plan = plan_packing(histogram, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    names = [c for c in pieces.columns if c not in ("task", "task_rank")]
    source = pieces.join(before, ["task", "length"]).select(*names, (F.col("before") + F.col("task_rank")).alias("_rank"))
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = names.index("length")

    def run(batches):
        wide = np.int64(1) << np.int64(44)
        keys = plan[:, 0] * wide + plan[:, 1]
        for batch in slices(batches):
            length, rank = batch.column(at).to_numpy(zero_copy_only=False), batch.column(len(names)).to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, length * wide + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(plan[i, 3] + rank - plan[i, 1]), pa.array(plan[i, 4])], names=schema.names)

    return in_batches(source, run, schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack_pieces(token_pieces(documents, tokenizer_path, capacity, end_id, id_col, text_col), capacity)
