"""Leading singular vectors of fields that are long on both sides.

The field is cut into square blocks. A subspace that is drawn at random is
multiplied with the field and its transpose in turn (block power iteration); each
product is a join of the blocks with one side's vectors and a sum of partial
products, and is made orthonormal from its small matrix of scalar products. Only
matrices of ``width`` x ``width`` reach the driver; vectors stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions import philox
from seriesforge.sources.intermediate import removed, written

SIDE = 512  # of a block
FAN_IN = 32  # partial products that are added in one group
OVERSAMPLED = 10
MOST_ROUNDS = 200


@dataclass(frozen=True)
class Truncated:
    """values: squares of the singular values; times (tb, vectors) and cells (cb, vectors) hold a row for each step (of the components) or cell (of the unit vectors); numbers (cell_id, cb, ci) names these."""

    values: np.ndarray
    times: DataFrame
    cells: DataFrame
    numbers: DataFrame
    side: int


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, width)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def number_cells(points: DataFrame, side: int) -> DataFrame:
    """(cell_id, cb, ci): cells dealt into groups of about ``side`` by a hash, numbered within their group."""
    cells = points.select("cell_id").distinct()
    groups = max(1, -(-cells.count() // side))
    dealt = cells.withColumn("cb", F.pmod(F.xxhash64("cell_id"), F.lit(groups)))
    return dealt.withColumn("ci", (F.row_number().over(Window.partitionBy("cb").orderBy("cell_id")) - 1).cast("int"))


def cut(points: DataFrame, numbers: DataFrame, side: int) -> DataFrame:
    """(tb, cb, steps, data): dense blocks of the field (cell_id, t, x), zero where it has no value."""
    widths = numbers.groupBy("cb").agg((F.max("ci") + 1).alias("_w"))
    placed = points.join(numbers.join(widths, "cb"), "cell_id").select(F.floor(F.col("t") / side).alias("tb"), "cb", (F.col("t") % side).cast("int").alias("ti"), "ci", "x", "_w")

    def pack(group: pa.Table) -> pa.Table:
        block = np.zeros((side, group.column("_w")[0].as_py()))
        np.add.at(block, (group.column("ti").to_numpy(), group.column("ci").to_numpy()), group.column("x").to_numpy())
        return pa.table({"tb": group.column("tb").slice(0, 1), "cb": group.column("cb").slice(0, 1), "data": pa.array([block.tobytes()], pa.binary())})

    return placed.groupBy("tb", "cb").applyInArrow(pack, "tb long, cb long, data binary")


def _summed(parts: DataFrame, key: str) -> DataFrame:
    """(key, vectors): the sum of a key's partial products (key, slot, vectors), ``FAN_IN`` at a time."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(len(group.column("vectors")[0].as_py()) // 8)
        for data in group.column("vectors"):
            total += np.frombuffer(data.as_py())
        return pa.table({key: group.column(key).slice(0, 1), "slot": pa.array([group.column("slot")[0].as_py() // FAN_IN], pa.int64()), "vectors": pa.array([total.tobytes()], pa.binary())})

    slots = (parts.agg(F.max("slot")).first()[0] or 0) + 1
    while True:
        parts = parts.groupBy(key, F.expr(f"slot div {FAN_IN}").alias("_g")).applyInArrow(add, f"{key} long, slot long, vectors binary")
        slots = -(-slots // FAN_IN)
        if slots == 1:
            return parts.select(key, "vectors")


def _product(blocks: DataFrame, vectors: DataFrame | None, turn: np.ndarray, transposed: bool, side: int, seed: int = 0) -> DataFrame:
    """The field (or its transpose) times ``vectors @ turn``, as written (key, vectors); without vectors they are drawn at random for each cell."""
    width, kept = turn.shape
    by, out = ("tb", "cb") if transposed else ("cb", "tb")
    drawn = vectors is None
    rows = blocks if drawn else blocks.join(vectors, by)
    schema = pa.schema([(out, pa.int64()), ("slot", pa.int64()), ("vectors", pa.binary())])

    def run(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                block = np.frombuffer(row["data"]).reshape(side, -1)
                if drawn:
                    place = np.arange(block.shape[1] * width).reshape(-1, width)
                    other = philox.uniform(place, row["cb"], seed) - 0.5
                else:
                    other = _matrix(row["vectors"], width)
                made.append((row[out], row[by], ((block.T if transposed else block) @ (other @ turn)).tobytes()))
            yield from _table(made, schema).to_batches()

    return written(_summed(rows.mapInArrow(run, f"{out} long, slot long, vectors binary"), out), "vectors")


def _scalar_products(vectors: DataFrame, width: int) -> np.ndarray:
    """All columns with each other: tasks add up their blocks, Spark the tasks."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for data in batch.column(0).to_pylist():
                part = _matrix(data, width)
                total += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["place", "value"])

    out = np.zeros(width * width)
    for place, value in vectors.select("vectors").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[place] = value
    return (m := out.reshape(width, width)) / 2 + m.T / 2


def _orthonormal(products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turn that makes columns with these scalar products orthonormal, directions of no weight left out; squares of the weights, falling."""
    values, turn = np.linalg.eigh(products)
    values, turn = values[::-1], turn[:, ::-1]
    kept = values > values[0] * 1e-14
    return turn[:, kept] / np.sqrt(values[kept]), values[kept]


def leading(points: DataFrame, n_modes: int, side: int = SIDE, tolerance: float = 1e-13, seed: int = 0) -> Truncated:
    """The leading singular triplets of the field (cell_id, t, x).

    Rounds go on until the values stand still, and then as often again, as
    vectors follow their values at half the digits.
    """
    numbers = written(number_cells(points, side), "cells")
    blocks = written(cut(points, numbers, side), "blocks")
    width, cells, before, rounds, left = n_modes + OVERSAMPLED, None, None, 0, None
    turn = np.eye(width)
    while True:
        times = _product(blocks, cells, turn, False, side, seed)
        raw = turn.shape[1]
        first, _ = _orthonormal(_scalar_products(times, raw))
        # A second pass: what the first leaves is orthonormal to rounding only where the weights are near each other.
        once = _turned(times, first, "tb")
        second, _ = _orthonormal(_scalar_products(once, first.shape[1]))
        if cells is not None:
            removed(cells)
        cells = _product(blocks, once, second, True, side)
        turn, values = _orthonormal(_scalar_products(cells, second.shape[1]))
        rounds += 1
        top = values[:n_modes]
        if left is None and before is not None and len(before) == len(top) and (np.abs(top - before) <= tolerance * top[0]).all():
            left = rounds
        if left is not None:
            left -= 1
        if left == 0 or rounds >= MOST_ROUNDS:
            break
        before = top
        removed(times, once)
    # cells = field' Q: the eigenvectors of its scalar products turn Q into the left vectors, here of the values' length
    kept = min(n_modes, int((values > values[0] * 1e-12).sum()))
    to_times = (second @ (turn * values))[:, :kept]
    left_vectors, right_vectors = _turned(once, to_times, "tb"), _turned(cells, turn[:, :kept], "cb")
    removed(times, once, cells, blocks)
    return Truncated(values[:kept], left_vectors, right_vectors, numbers, side)


def _turned(vectors: DataFrame, turn: np.ndarray, key: str) -> DataFrame:
    width = len(turn)

    def run(batches):
        for batch in batches:
            data = [(_matrix(d, width) @ turn).tobytes() for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[key, "vectors"])

    return written(vectors.select(key, "vectors").mapInArrow(run, f"{key} long, vectors binary"), "turned")


def rows_of(vectors: DataFrame, key: str, width: int) -> DataFrame:
    """(key, place, mode, value) of blocks of vectors."""

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = _matrix(data, width)
                place, mode = np.divmod(np.arange(m.size), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, block)), pa.array(place.astype(np.int32)), pa.array(mode.astype(np.int32)), pa.array(m.ravel())], names=[key, "place", "mode", "value"])

    return vectors.mapInArrow(run, f"{key} long, place int, mode int, value double")
