"""Toxicity by compression distance.

Two dictionaries are trained by the zstandard trainer, one on ordinary text and
one on toxic text. Each whole text is cut into windows of a few words. A window
is compressed with the ordinary dictionary alone, and with the toxic one in
front of it; the bytes that the toxic one saves are the window's evidence. What
both kinds of text have in common saves nothing, since the ordinary dictionary
stands behind both.

Most windows of a toxic text are ordinary. So training goes in rounds: the
toxic dictionary is trained again on those windows of toxic texts that it saved
most, and the ordinary one also on those windows of ordinary texts that the
toxic one saved most, wrongly. Logistic calibration of the counts of windows by
bytes saved, fitted on labelled documents that the dictionaries have not seen,
turns a text's evidence into a probability.

Sizes, window and rounds were chosen by cross-validation inside the training
rows of ``check_s``; held-out rows had no part in it.

Defined results: null and empty texts have no windows, so their score is the
calibrated score of no evidence. Equal texts score alike; every row is kept.
Columns may have any names. Where labels of one kind are missing, the score is
the share of toxic labels.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices

STEPS = 8


@dataclass(frozen=True)
class ToxicityModel:
    """Plain data, under a megabyte: it travels to the tasks with the function."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    window_words: int
    level: int


def _train(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of the trainer; of too few samples for it the samples themselves."""
    samples = list(samples)
    random.Random(3).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8 if segment < 32 else 6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"no text "


def _windows(text: str | None, words_each: int) -> list[bytes]:
    words = (text or "").lower().split()
    return [f" {' '.join(words[i : i + words_each])} ".encode("utf-8", "replace") for i in range(0, len(words), words_each)]


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        level, dict_size=len(content), source_size=80, min_match=4, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def compressors(model: ToxicityModel) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    return _compressor(model.toxic + model.ordinary, model.level), _compressor(model.ordinary, model.level)


def _gains(windows: list[bytes], toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> np.ndarray:
    """Bytes saved by the toxic dictionary, for each window."""
    shorter, longer = toxic.compress, ordinary.compress
    return np.fromiter((len(longer(w)) - len(shorter(w)) for w in windows), np.int32, len(windows))


def _dictionaries(toxic: list[str], ordinary: list[str], words_each: int, level: int, sizes: tuple[int, int], rounds: int, share: float) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries from the texts of either kind."""
    windows = [[w for text in texts for w in _windows(text, words_each)] for texts in (ordinary, toxic)]
    common = _train(windows[0], sizes[0], 64)
    own = _train(windows[1], sizes[1], 12)
    for _ in range(rounds):
        on, off = _compressor(own + common, level), _compressor(common, level)
        most = []
        for each in windows:
            order = np.argsort(-_gains(each, on, off), kind="stable")[: int(share * len(each)) + 1]
            most.append([each[i] for i in order])
        own = _train(most[1], sizes[1], 12)
        common = _train(most[0], sizes[0] // 4, 12) + _train(windows[0], sizes[0] * 3 // 4, 64)
    return common, own


def _features(gains: np.ndarray) -> np.ndarray:
    """How many windows gained 1, 2, ... bytes or more and lost some, also against the length."""
    n = max(1, len(gains))
    counts = np.array([(gains >= k).sum() for k in range(1, STEPS + 1)] + [(gains <= -k).sum() for k in (2, 4)], float)
    return np.concatenate([[1.0], np.log1p(counts), np.sqrt(counts / n), [gains.sum() / n / 4, np.log(n) / 4]])


def score(text: str | None, model: ToxicityModel, pair: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]) -> float:
    z = _features(_gains(_windows(text, model.window_words), *pair)) @ np.array(model.weights)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    max_rows: int = 2500,
    max_train_chars: int = 8_000,
    window_words: int = 16,
    level: int = 7,
    sizes: tuple[int, int] = (400_000, 8192),
    rounds: int = 4,
    share: float = 0.1,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Fit on a bounded sample of labelled documents.

    The bound is ``max_rows`` rows for each label value and ``max_train_chars``
    characters a row (longer rows are not used for fitting): what reaches the
    driver does not grow with the input. Ids are taken from the labels in the
    order of a hash; the documents themselves are not shuffled for it. Rows
    without a label are not used, and each text counts once.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_rows) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * max_rows ids
    rows = (
        documents.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
        .where(F.length("_text").between(1, max_train_chars))
        .join(ids, "_id")
        .groupBy("_id", "_y")
        .agg(F.min("_text").alias("_text"))
        .collect()
    )
    texts = {(r["_y"], r["_text"]) for r in rows}
    taken = [sorted((t for y_, t in texts if y_ == y), key=lambda t: zlib.crc32(t.encode("utf-8", "replace"))) for y in (0, 1)]
    ordinary, toxic = taken
    rate = len(toxic) / max(1, len(toxic) + len(ordinary))
    nothing = (float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), *[0.0] * (2 * STEPS + 6))
    if min(len(toxic), len(ordinary)) < 3:
        return ToxicityModel(b"no text ", b"no text ", nothing, window_words, level)
    shown, unseen = [t[::3] + t[1::3] for t in taken], [t[2::3] for t in taken]
    common, own = _dictionaries(shown[1], shown[0], window_words, level, sizes, rounds, share)
    model = ToxicityModel(common, own, nothing, window_words, level)
    pair = compressors(model)
    x = np.stack([_features(_gains(_windows(t, window_words), *pair)) for y in (0, 1) for t in unseen[y]])
    y = np.repeat([0.0, 1.0], [len(unseen[0]), len(unseen[1])])
    return replace(model, weights=tuple(float(v) for v in _logistic(x, y)))


def score_toxicity(documents: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) and a probability for each whole text.

    One narrow pass: nothing is shuffled, and a task holds one small batch.
    A column of the input named like ``score_col`` is replaced.
    """
    names = [c for c in (documents.columns if keep is None else keep) if c != score_col]
    source = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*names, text_col])))
    schema = T.StructType([documents.schema[c] for c in names] + [T.StructField(score_col, T.DoubleType())])

    def run(batches):
        pair = compressors(model)
        for batch in slices(batches):
            scores = [score(t, model, pair) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64())], names=[*names, score_col])

    return in_batches(source, run, schema)
