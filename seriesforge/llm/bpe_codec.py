"""BPE encoding and decoding by a contiguous rank array.

A short word is a list of parts (ids) and, beside it, a list of the ranks of
the boundaries between neighbours. The least rank is found by a scan (the first
of equals, so merges run from the left), its boundary is deleted, the part in
front becomes the merged one, and the ranks on both sides of it are looked up
again. Both lists stay contiguous. For a word of over ``SHORT_WORD`` parts scans
would cost the square of its length; there a heap of boundaries over linked
neighbours takes the same merges in the same order.

White space is dropped before merging, so a text is the row of its chunks
between white space. What a chunk and what a word in it gives (ids and pieces)
is kept in memos of bounded size in each worker process.

Ids and pieces equal those of the ``tokenizers`` library for byte-level BPE
files that mark the end of a word by a suffix and have no decoder: special
strings in a text get their own id, decoding joins pieces by a space.

Defined results: null and empty texts have no ids and decode to the empty text.
Repeated rows give a row each; an empty table gives none; columns of ``keep``
are passed on as they are.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices
from .packing import _CONTROL, _PLAIN, _PRE, _SPACE

SHORT_WORD = 96
MEMO_ENTRIES = 240_000  # in each of two generations
MEMO_CHARS = 64  # longer chunks are not kept
NO_RANK = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is visible, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class RankTable:
    """Vocabulary and merge ranks of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.piece = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.width = max(self.piece) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {vocab[a] * self.width + vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.inner = {c: vocab[c] for c in byte_letters()}
        self.last = {c: vocab[c + suffix] for c in byte_letters()}
        self.inner_byte, self.last_byte = [*self.inner.values()], [*self.last.values()]  # by byte: the letters' order

    def parts(self, letters: str) -> list[int]:
        return [*map(self.inner.__getitem__, letters[:-1]), self.last[letters[-1]]]

    def byte_parts(self, word: bytes) -> list[int]:
        return [*map(self.inner_byte.__getitem__, word[:-1]), self.last_byte[word[-1]]]

    def merge(self, parts: list[int]) -> list[int]:
        """The parts after all merges."""
        if len(parts) > SHORT_WORD:
            return self._merge_linked(parts)
        rank, width = self.rank.get, self.width
        ranks = [rank(a * width + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = self.made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] * width + parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(parts[i] * width + parts[i + 1], NO_RANK)
        return parts

    def _merge_linked(self, parts: list[int]) -> list[int]:
        rank, width, n = self.rank.get, self.width, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] * width + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank(parts[i] * width + parts[j]) != least:
                continue  # a merge beside it has changed this boundary
            parts[i], parts[j] = self.made[least], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (r := rank(parts[a] * width + parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]


def _joined(found: list[tuple[bytes, str]]) -> tuple[bytes, str]:
    """All ids and all pieces; what has none adds no space."""
    pieces = [pieces for _, pieces in found]
    return b"".join([ids for ids, _ in found]), " ".join(filter(None, pieces) if "" in pieces else pieces)


class Memo(dict):
    """What ``make`` gives for a text. Two generations: when the young one is full it becomes the old one, so what is in use stays."""

    def __init__(self, make: Callable[[str], tuple[bytes, str]]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, text: str) -> tuple[bytes, str]:
        found = self.old.get(text) or self.make(text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[text] = found
        return found


class Codec(Memo):
    """Chunk between white space -> (ids as little-endian 32-bit bytes, pieces joined by a space).

    Words that are merged have memos of their own: chunks of different case and
    punctuation share them.
    """

    kept: dict[str, Codec] = {}

    def __init__(self, path: str):
        super().__init__(self.encode_chunk)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)  # for its Unicode rules only
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.table = RankTable(path)
        self.plain, self.words = Memo(self._encode_plain), Memo(self._encode_word)
        self.letters_plain = not any(s.isalpha() for s in self.table.special)
        self.special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.table.special, key=len, reverse=True)) or "((?!))")

    @classmethod
    def here(cls, path: str) -> Codec:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def encode_chunk(self, chunk: str) -> tuple[bytes, str]:
        if self.letters_plain and chunk.isalpha() and _PLAIN.match(chunk):
            return self.plain[chunk.lower()]  # one word, no special string
        if not self.special.search(chunk):
            found = self._segment(chunk)
            return found[0] if len(found) == 1 else _joined(found)
        found, at = [], 0
        for hit in self.special.finditer(chunk):
            found += self._segment(chunk[at : hit.start()])
            found.append(self._packed([self.table.special[hit[0]]]))
            at = hit.end()
        return _joined(found + self._segment(chunk[at:]))

    def _segment(self, text: str) -> list[tuple[bytes, str]]:
        if not text:
            return []
        if _PLAIN.match(text):
            return [*map(self.plain.__getitem__, _PRE.findall(text.lower()))]
        return [*map(self.words.__getitem__, [w for w, _ in self.cut(self.normalize(text))])]

    def _encode_plain(self, word: str) -> tuple[bytes, str]:
        return self._packed(self.table.merge(self.table.byte_parts(word.encode())))

    def _encode_word(self, letters: str) -> tuple[bytes, str]:
        return self._packed(self.table.merge(self.table.parts(letters)))

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}i", *ids), self.decode(ids)

    def decode(self, ids) -> str:
        return " ".join(map(self.table.piece.__getitem__, ids))

    def encode(self, text: str | None) -> tuple[bytes, str]:
        if not text:
            return b"", ""
        chunks = _SPACE.split(text) if _CONTROL.search(text) else text.split()
        return _joined([*map(self.__getitem__, chunks)])


def encode_and_decode(documents: DataFrame, path: str, keep: list[str] = ("doc_id",), text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """The columns ``keep``, the ids of each whole text and the text that these ids decode to."""
    source = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_".join(["text", *keep])))  # a name that no column has
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded_col, T.StringType())])

    def run(batches):
        codec = Codec.here(path)
        for batch in slices(batches, 1_000_000):
            coded = [codec.encode(text) for text in batch.column(batch.num_columns - 1).to_pylist()]
            ends = np.cumsum([0, *(len(ids) // 4 for ids, _ in coded)])
            values = pa.array(np.frombuffer(b"".join([ids for ids, _ in coded]), "<i4"))
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array([text for _, text in coded], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_batches(source, run, schema)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; null ids give null, an id that the file does not know fails the job."""
    kept = [c for c in rows.columns if c != decoded_col]
    source = rows.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField(decoded_col, T.StringType())])

    def run(batches):
        codec = Codec.here(path)
        for batch in slices(batches):
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(kept.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return in_batches(source, run, schema)
