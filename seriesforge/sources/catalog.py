"""Catalog of basins: key, path, region, subregion, name, as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "key string, path string, region string, subregion string, name string"


def clean(c: Column) -> Column:
    """Empty and NaN texts become null."""
    text = F.trim(c)
    return F.when((text != "") & (F.lower(text) != "nan"), text)


@dataclass(frozen=True)
class Catalog:
    """An immutable catalog; ``register`` returns a new one."""

    entries: DataFrame

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: list[tuple]) -> Catalog:
        return cls(spark.createDataFrame([], SCHEMA)).register(spark.createDataFrame(rows, SCHEMA))

    @classmethod
    def from_listing(cls, known: DataFrame, files: DataFrame) -> Catalog:
        """The known entries whose path is among ``files(path)``."""
        return cls(known.join(files.select("path").distinct(), "path", "left_semi").select(*known.columns))

    def register(self, given: DataFrame, region: str | None = None) -> Catalog:
        """Insert or update: what is given wins, then what was known, then the key as name."""
        new = given.select(
            "key", "path", F.coalesce(clean(F.col("region")), F.lit(region)).alias("region"), clean(F.col("subregion")).alias("subregion"), clean(F.col("name")).alias("name")
        )
        old = self.entries.select("key", *(F.col(c).alias(f"_{c}") for c in ("path", "region", "subregion", "name")))
        both = new.join(old, "key", "full")
        merged = both.select("key", *(F.coalesce(c, f"_{c}").alias(c) for c in ("path", "region", "subregion")), F.coalesce("name", "_name", "key").alias("name"))
        return Catalog(merged)

    def select(self, keys: list[str] | None = None, region: str | None = None, subregion: str | None = None, names: list[str] | None = None) -> DataFrame:
        """All filters hold: region and subregion by part, names as a set, all without case."""
        out = self.entries
        if keys is not None:
            out = out.where(F.col("key").isin(keys))
        for column, part in (("region", region), ("subregion", subregion)):
            if part is not None:
                out = out.where(F.lower(column).contains(part.lower()))
        if names is not None:
            out = out.where(F.lower("name").isin([n.lower() for n in names]))
        return out

    def entry(self, key: str):
        row = self.entries.where(F.col("key") == key).first()
        if row is None:
            raise KeyError(f"{key!r}; there are {sorted(r['key'] for r in self.entries.select('key').limit(50).collect())}")
        return row

    def path(self, key: str) -> str:
        return self.entry(key)["path"]

    def available(self, files: DataFrame) -> DataFrame:
        return self.entries.join(files.select("path").distinct(), "path", "left_semi")

    def missing(self, files: DataFrame) -> DataFrame:
        return self.entries.join(files.select("path").distinct(), "path", "left_anti")

    def regions(self) -> DataFrame:
        return self.entries.where("region is not null").select("region").distinct().orderBy("region")

    def subregions(self, region: str | None = None) -> DataFrame:
        out = self.entries if region is None else self.entries.where(F.lower("region").contains(region.lower()))
        return out.where("subregion is not null").select("subregion").distinct().orderBy("subregion")

    def region_tree(self) -> DataFrame:
        """(region, subregion): the named subregions of every region."""
        return self.entries.where("region is not null and subregion is not null").select("region", "subregion").distinct()

    def by_region(self, column: str = "region") -> DataFrame:
        return self.entries.groupBy(F.coalesce(column, F.lit("Unknown")).alias(column)).agg(F.sort_array(F.collect_list("key")).alias("keys"))

    def summary(self) -> DataFrame:
        """Counts at all three levels of region, subregion and total."""
        return self.entries.rollup("region", "subregion").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))

    def check(self, means: DataFrame, expected: DataFrame) -> DataFrame:
        """``means(name, n, mean)`` against ``expected(name, low, high)``; keys without either say so."""
        joined = self.entries.join(means, "name", "left").join(expected, "name", "left")
        status = F.when(F.col("mean").isNull(), "missing").when(F.col("low").isNull(), "no expectation").when(F.col("mean").between(F.col("low"), F.col("high")), "ok").otherwise("out of range")
        return joined.select("key", "name", "n", "mean", status.alias("status"))

    def __len__(self) -> int:
        return self.entries.count()

    def __contains__(self, key: str) -> bool:
        return self.entries.where(F.col("key") == key).limit(1).count() > 0

    def __iter__(self):
        return (r["key"] for r in self.entries.select("key").orderBy("key").toLocalIterator())


def first_per_name(table: DataFrame, order: str) -> DataFrame:
    """One row of each name, the first by ``order``: metadata for a dissolve."""
    w = Window.partitionBy("name").orderBy(order)
    return table.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def reference_first(df: DataFrame, name: str) -> DataFrame:
    """Ordered by name, with the reference's row in front."""
    return df.orderBy(F.col("name") != name, "name")
