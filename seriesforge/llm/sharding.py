"""Shards of equal row counts along a Hilbert curve.

Several metadata dimensions are quantised into cells of near equal row counts,
taken over all rows: numbers at their quantiles, strings by the number of rows
with a lesser string. The cells are numbered along a Hilbert curve, rows are
sorted by curve index, and the order is cut into runs whose counts differ by
one at most. A shard so covers a compact region in all dimensions at once, and
the minima and maxima of its files prune reads.

Rows of equal texts form a group: all of them take the least curve index of the
group, so they stand in a row, and a group is split only where it lies across
the end of a shard (at most one group for each end).

Only (id, size, checksum, quantised dimensions) are sorted, never the texts.
Ranks come from a range-partitioned sort and the row counts of its partitions;
the order ends with the id, so a hot source or a text with many copies is
spread over partitions. (Equal rows with equal ids alone can't be told apart;
what is sorted of them is some 60 bytes a row.)

Defined results: a null text has size 16 and checksum 0 and is equal to the
empty text; nulls in a dimension form the lowest cell; repeated rows take a
slot each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stash

#: Bytes of a row besides its text.
ROW_BYTES = 16


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of points (rows, dimensions) with coordinates below 2**bits.

    Skilling's transform (AIP Conf. Proc. 707, 2004), on whole columns.
    """
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, 0) ^ swap
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def _ordered(df: DataFrame, order: list[str], label: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``df`` sorted over all partitions, with _part and _in_part, and the rows of each partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range sort reads its input twice: it must not change in between.
    whole = stash(df, label)
    sorted_rows = stash(whole.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), label)
    discard(whole)
    out = sorted_rows.select("*", F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_in_part")).drop("_at")
    return out, [(r["_part"], r["n"]) for r in out.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()]  # one row per partition


def _before(spark: SparkSession, counts: list[tuple[int, int]]) -> DataFrame:
    """(_part, _before): what stands in the partitions before; one row per partition."""
    before, rows = 0, []
    for part, n in counts:
        rows.append((part, before))
        before += n
    return F.broadcast(spark.createDataFrame(rows, "_part int, _before long"))


def _string_rank(rows: DataFrame, name: str) -> DataFrame:
    """(value, rank) for each string: the number of rows with a lesser one, nulls before all."""
    counts = rows.groupBy(name).agg(F.count("*").alias("_n"))
    ordered, _ = _ordered(counts, [name], "strings")
    sums = [(r["_part"], r["n"]) for r in ordered.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect()]  # one row per partition
    within = F.sum("_n").over(Window.partitionBy("_part").orderBy("_in_part").rowsBetween(Window.unboundedPreceding, -1))
    return ordered.withColumn("_within", F.coalesce(within, F.lit(0))).join(_before(rows.sparkSession, sums), "_part").select(name, (F.col("_before") + F.col("_within")).alias(f"{name}_rank"))


def hilbert_shards(
    documents: DataFrame,
    shards: int = 40,
    dimensions: tuple[str, ...] = ("source", "lang"),
    bits: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, the row's own curve index, shard and slot of every row.

    The dimensions are the named columns (strings or numbers) and the size.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    columns = [F.col(f"`{c}`") for c in dimensions]
    strings = [isinstance(documents.schema[c].dataType, T.StringType) for c in dimensions]
    rows = stash(
        documents.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("_hash"),
            *((c if s else c.cast("double")).alias(f"_d{i}") for i, (c, s) in enumerate(zip(columns, strings))),
        ).withColumn(f"_d{len(dimensions)}", F.col("size").cast("double")),
        "cells",
    )
    strings.append(False)
    n_dims = len(strings)
    steps = [k / 2**bits for k in range(1, 2**bits)]
    cuts = rows.agg(F.count("*").alias("n"), *(F.percentile_approx(f"_d{i}", steps, 10_000).alias(f"_d{i}") for i in range(n_dims) if not strings[i])).first()
    total = cuts["n"]
    for i in range(n_dims):
        if strings[i]:
            rank = _string_rank(rows.select(f"_d{i}"), f"_d{i}").withColumnRenamed(f"_d{i}", "_value")
            rows = rows.join(rank, F.col(f"_d{i}").eqNullSafe(F.col("_value")), "left").drop("_value")

    def cell(i: int) -> Column:
        if strings[i]:
            return F.expr(f"cast(_d{i}_rank * {2**bits} div {max(1, total)} as int)")
        edges = sorted(set(cuts[f"_d{i}"] or []))
        value = F.coalesce(F.col(f"_d{i}"), F.lit(float("-inf")))
        return sum(((value > float(e)).cast("int") for e in edges), F.lit(0))

    @F.pandas_udf("long")
    def curve(axes: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(axes.to_numpy(), bits))

    placed = rows.select("doc_id", "size", "text_crc32", "_hash", F.struct(*(cell(i).alias(f"d{i}") for i in range(n_dims))).alias("_axes"))
    placed = stash(placed.select("doc_id", "size", "text_crc32", "_hash", curve("_axes").alias("curve_index")), "curve")
    # Equal texts take the least index of their group; lone texts have no row in this table.
    group = ["_hash", "size", "text_crc32"]
    groups = stash(placed.groupBy(*group).agg(F.min("curve_index").alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "groups")
    grouped = placed.join(groups, group, "left").withColumn("_at_index", F.coalesce("_least", "curve_index")).drop("_least")
    ordered, counts = _ordered(grouped, ["_at_index", "_hash", "size", "doc_id"], "ordered")
    discard(placed, groups)
    shard = F.expr(f"cast(_rank * {shards} div {max(1, total)} as int)")
    first = F.expr(f"(cast(shard as long) * {max(1, total)} + {shards - 1}) div {shards}")
    ranked = ordered.join(_before(spark, counts), "_part").withColumn("_rank", F.col("_before") + F.col("_in_part")).withColumn("shard", shard)
    return ranked.select("doc_id", "size", "text_crc32", "curve_index", "shard", (F.col("_rank") - first).alias("slot"))
