"""Benchmark decontamination by the q-gram lemma.

A benchmark item is cut into overlapping windows. If a region of a document is
within k edits of a window of m characters, the two share at least
m - q + 1 - k*q q-grams, and the diagonals (document position minus window
position) of these differ by k at most. So shared q-grams are counted in
overlapping bands of diagonals, and only bands that reach the bound are
verified: by equality first, else by banded alignment. The filter loses no
region within the budget; the verification drops all others.

Items are read in blocks of bounded size, each of them broadcast, and all
documents pass once: a task holds one block and a bounded stretch of texts at a
time. Nothing is shuffled, whatever key or passage is frequent. Hits are
counted in slices of bounded size, texts of millions of characters in pieces
that overlap by more than a window.

Texts are compared lower-cased with white space made single; spans refer to
that form. For each document and item the least distance, the first start and
the last end of its regions are given. Defined results: null and empty texts
match nothing; items under ``min_chars`` characters are too short for windows
and match texts equal to them; repeated rows match each for themselves; all of
a long text is searched. Columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices

BASE = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 22
GROUP_CHARS = 1_000_000
PIECE_CHARS = 2_000_000
HITS = 2_000_000
STRETCH_BYTES = 32_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q-gram at each position, from hashes of its binary parts."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, power_hash = codes.astype(np.uint64) + np.uint64(1), 1, np.array([BASE])  # arrays wrap around
    total, length = None, 0
    left = q
    while left:
        if left & 1:
            if total is None:
                total, length = power, size
            else:  # the longer part follows the shorter
                total = total[: len(power) - length] * power_hash + power[length:][: len(total)]
                length += size
        left >>= 1
        if left:
            power = power[:-size] * power_hash + power[size:]
            power_hash = power_hash * power_hash
            size *= 2
    return total[:n] * BASE ^ (total[:n] >> np.uint64(29))


@dataclass
class Windows:
    """The windows of a block of items, indexed by q-gram. Plain arrays."""

    q: int
    texts: list[str]
    item: np.ndarray
    start: np.ndarray
    budget: np.ndarray
    least: np.ndarray
    grams: np.ndarray = field(repr=False)
    first: np.ndarray = field(repr=False)
    window_of: np.ndarray = field(repr=False)
    position: np.ndarray = field(repr=False)
    short: dict[str, list[int]] = field(repr=False)

    @property
    def band(self) -> int:
        return 2 * max(8, int(self.budget.max(initial=0)))


def make_windows(items: list[tuple[object, str]], q: int, rate: float, width: int, min_chars: int) -> Windows:
    texts, item, start, short = [], [], [], {}
    for number, (_, text) in enumerate(items):
        text = normalise(text)
        if len(text) < max(min_chars, q + 3):
            if text:
                short.setdefault(text, []).append(number)
            continue
        ends = list(range(width, len(text), width // 2)) + [len(text)] if len(text) > width else [len(text)]
        for end in ends:
            begin = max(0, end - width)
            texts.append(text[begin:end])
            item.append(number)
            start.append(begin)
    sizes = np.array([len(t) for t in texts], np.int64)
    budget = np.maximum(0, np.minimum((rate * sizes).astype(np.int64), (sizes - q + 1 - 4) // q))
    hashes = [_gram_hashes(_codes(t), q) for t in texts]
    every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    window_of = np.repeat(np.arange(len(texts)), [len(h) for h in hashes]).astype(np.int64)
    position = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    grams, first = np.unique(every[order], return_index=True)
    return Windows(q, texts, np.array(item, np.int64), np.array(start, np.int64), budget, sizes - q + 1 - budget * q, grams, np.append(first, len(every)), window_of[order], position[order], short)


def banded_distance(pattern: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int]:
    """Least edits of the pattern against any part of the region, on diagonals low..high.

    Returns (distance, start, end) of the part; distance most + 1 if none.
    """
    width = high - low + 1
    big = most + 1
    steps = np.arange(width)
    column = steps + low  # region position of a diagonal at pattern position 0
    inside = (column >= 0) & (column <= len(region))
    row = np.where(inside, 0, big)
    origin = np.where(inside, column, 0)
    for i, c in enumerate(pattern):
        at = column + i
        valid = (at >= 0) & (at < len(region))
        same = np.zeros(width, bool)
        same[valid] = region[at[valid]] == c
        straight = np.where(valid, row + ~same, big)
        down = np.append(row[1:] + 1, big)  # pattern character dropped: next diagonal
        down_from = np.append(origin[1:], 0)
        best, from_ = np.where(down < straight, down, straight), np.where(down < straight, down_from, origin)
        place = column + i + 1
        best = np.where((place >= 0) & (place <= len(region)), best, big)
        slide = best - steps  # region character added: from the left, one edit a step
        least = np.minimum.accumulate(slide)
        where = np.maximum.accumulate(np.where(slide == least, steps, 0))
        row, origin = np.minimum(least + steps, big), from_[where]
        row = np.where((place >= 0) & (place <= len(region)), row, big)
        if row.min() > most:
            return big, 0, 0
    end = int(row.argmin())
    return int(row[end]), int(origin[end]), int(column[end] + len(pattern))


def _matches(texts: list[str], windows: Windows, table: np.ndarray, codes_of: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, window, start, end, distance) of regions within budget; texts are normalised."""
    q, band = windows.q, windows.band
    gap = np.zeros(band + q, np.uint32)
    parts, begins, at = [], [], 0
    for text in texts:
        codes = _codes(text)
        begins.append(at)
        parts += [codes, gap]
        at += len(codes) + len(gap)
    joined = np.concatenate([*parts, np.zeros(0, np.uint32)])
    begins = np.array(begins, np.int64)
    hashes = _gram_hashes(joined, q)
    maybe = np.flatnonzero(table[hashes >> np.uint64(64 - SLOTS)])
    found = np.searchsorted(windows.grams, hashes[maybe])
    found[found == len(windows.grams)] = 0
    true = windows.grams[found] == hashes[maybe] if len(windows.grams) else np.zeros(len(maybe), bool)
    where, gram = maybe[true], found[true]
    if not len(where):
        return
    n = windows.first[gram + 1] - windows.first[gram]
    longest = int(windows.position.max(initial=0)) + q
    # Bands of 2*half diagonals, one starting each `half`: budgets are at most half.
    half = band // 2
    bands = (len(joined) + longest) // half + 2
    ends = np.cumsum(n)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(HITS, int(ends[-1]), HITS)), [len(n)]]))
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo, hi in zip(cuts, cuts[1:]):
        m, at = n[lo:hi], np.cumsum(n[lo:hi])
        hit = np.repeat(windows.first[gram[lo:hi]] + m - at, m) + np.arange(at[-1])
        low = (np.repeat(where[lo:hi], m) - windows.position[hit] + longest) // half  # not below 0
        key = windows.window_of[hit] * bands + low
        some, times = np.unique(np.concatenate([key, key[low > 0] - 1]), return_counts=True)
        keys, of = np.unique(np.concatenate([keys, some]), return_inverse=True)
        counts = np.bincount(of, np.concatenate([counts, times])).astype(np.int64)
    strong: dict[tuple[int, int], list[int]] = {}  # (text, window) -> first diagonals of bands
    for key in keys[counts >= windows.least[keys // bands]].tolist():
        w, b = divmod(key, bands)
        first = b * half - longest  # first diagonal of the band in the joined texts
        size, most = len(windows.texts[w]), int(windows.budget[w])
        last = int(np.searchsorted(begins, first + band + size + most, side="left"))
        for i in range(max(0, int(np.searchsorted(begins, first - most, side="right")) - 1), last):
            strong.setdefault((i, w), []).append(first - int(begins[i]))
    for (i, w), firsts in strong.items():
        text, pattern, most = texts[i], windows.texts[w], int(windows.budget[w])

        letters = Counter(pattern)

        def verified(first: int, text=text, pattern=pattern, letters=letters, most=most, w=w) -> tuple[int, int, int] | None:
            """(distance, start, end) of the region of a band, if it is within budget."""
            start, end = max(0, first - most), min(len(text), first + band + len(pattern) + most)
            if end - start < len(pattern) - most:
                return None
            same = text.find(pattern, start, end)
            if same >= 0:
                return 0, same, same + len(pattern)
            if (letters - Counter(text[start:end])).total() > most:  # more characters are missing than the budget has edits
                return None
            offset = first - start
            distance, s, e = banded_distance(codes_of[w], _codes(text[start:end]), offset - most, offset + band + most, most)
            return (distance, start + s, start + e) if distance <= most else None

        # From both ends: the first and the last region say most, the others at best a lesser distance.
        left = next((x for f in firsts if (x := verified(f))), None)
        if left is None:
            continue
        right = next(x for f in reversed(firsts) if (x := verified(f)))
        distance = min(left[0], right[0])
        if distance:
            distance = min(x[0] for f in firsts if (x := verified(f)))
        yield i, w, left[1], max(left[2], right[2]), distance


def _search(texts: list[str | None], windows: Windows, table: np.ndarray, codes_of: list[np.ndarray]) -> list[dict[int, tuple[int, int, int]]]:
    """For each text: item number -> (least distance, first start, last end)."""
    out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    overlap = 2 * (max(map(len, windows.texts), default=0) + windows.band)
    group: list[tuple[int, int, str]] = []  # text, offset, piece
    size = 0

    def flush() -> None:
        for k, w, start, end, distance in _matches([piece for _, _, piece in group], windows, table, codes_of):
            i, offset, _ = group[k]
            item = int(windows.item[w])
            d, s, e = out[i].get(item, (distance, start + offset, end + offset))
            out[i][item] = (min(d, distance), min(s, start + offset), max(e, end + offset))

    for i, text in enumerate(texts):
        ready = normalise(text)
        for number in windows.short.get(ready, ()):
            out[i][number] = (0, 0, len(ready))
        for at in range(0, max(1, len(ready) - overlap), PIECE_CHARS):
            piece = ready[at : at + PIECE_CHARS + overlap]
            group.append((i, at, piece))
            size += len(piece)
            if size >= GROUP_CHARS:
                flush()
                group, size = [], 0
    flush()
    return out


def _slots(windows: Windows) -> np.ndarray:
    table = np.zeros(1 << SLOTS, bool)
    table[windows.grams >> np.uint64(64 - SLOTS)] = True
    return table


def _whole(items: DataFrame, id_col: str) -> bool:
    return isinstance(items.schema[id_col].dataType, T.IntegralType)


def _blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    item_id = F.col(f"`{id_col}`").cast("long" if _whole(items, id_col) else "string")
    for row in items.select(item_id.alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null").toLocalIterator():
        block.append((row["i"], row["t"]))
        size += len(row["t"])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _broadcast(documents: DataFrame, items: DataFrame, q: int, rate: float, width: int, min_chars: int, block_chars: int, item_col: str, text_col: str) -> list:
    """Each block's windows and ids as a broadcast; the driver holds one block at a time."""
    context = documents.sparkSession.sparkContext
    return [context.broadcast((make_windows(block, q, rate, width, min_chars), [i for i, _ in block])) for block in _blocks(items, item_col, text_col, block_chars)]


def _found(batches: Iterator[pa.RecordBatch], column: int, blocks: list) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """Stretches of rows, and for each row: item id -> (least distance, first start, last end)."""
    for batch in slices(batches, STRETCH_BYTES):
        texts = batch.column(column).to_pylist()
        out: list[dict] = [{} for _ in texts]
        for block in blocks:
            windows, ids = block.value
            if not hasattr(windows, "ready"):
                windows.ready = _slots(windows), [_codes(t) for t in windows.texts]
            for i, found in enumerate(_search(texts, windows, *windows.ready)):
                out[i].update((ids[number], span) for number, span in found.items())
            if len(blocks) > 1:
                block.__dict__.pop("_value", None)  # a worker holds one block at a time
        yield batch, out


def find_passages(
    documents: DataFrame, items: DataFrame, rate: float = 0.08, q: int = 10, width: int = 160, min_chars: int = 32, block_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for each document and item that share a region.

    Of items with equal ids the last one that matches counts.
    """
    source = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    whole = _whole(items, item_col)
    schema = T.StructType([source.schema["doc_id"], T.StructField("item_id", T.LongType() if whole else T.StringType())] + [T.StructField(c, T.LongType()) for c in ("distance", "start", "end")])
    blocks = _broadcast(documents, items, q, rate, width, min_chars, block_chars, item_col, item_text_col)

    def run(batches):
        for batch, out in _found(batches, 1, blocks):
            rows = [(i, item, *span) for i, found in enumerate(out) for item, span in found.items()]
            take, item, *spans = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(item, pa.int64() if whole else pa.string()), *(pa.array(s, pa.int64()) for s in spans)], names=schema.names)

    return in_batches(source, run, schema)


def drop_contaminated(
    documents: DataFrame, items: DataFrame, rate: float = 0.08, q: int = 10, width: int = 160, min_chars: int = 32, block_chars: int = 2_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The documents that share no region with an item; all columns stay."""
    at = documents.columns.index(text_col)
    blocks = _broadcast(documents, items, q, rate, width, min_chars, block_chars, item_col, item_text_col)

    def run(batches):
        for batch, out in _found(batches, at, blocks):
            yield batch.filter(pa.array([not found for found in out], pa.bool_()))

    return in_batches(documents, run, documents.schema)
