"""Map projection and unions of polygons, as column expressions and joins."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.sources.intermediate import written

# The WGS 84 ellipsoid; true scale at 71 degrees south, as polar maps of Antarctica have it.
MAJOR_AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
TRUE_SCALE = 71.0
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)


def _conformal(phi: float) -> float:
    s = math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - E * s) / (1 + E * s)) ** (E / 2)


#: Metres from the pole for a conformal colatitude of one.
SCALE = MAJOR_AXIS * math.cos(math.radians(TRUE_SCALE)) / math.sqrt(1 - E2 * math.sin(math.radians(TRUE_SCALE)) ** 2) / _conformal(math.radians(TRUE_SCALE))


def polar_sql(lat: str, lon: str) -> tuple[str, str]:
    """Easting and northing of southern latitudes on the polar stereographic plane, as SQL for any engine."""
    phi = f"radians(-1e0 * ({lat}))"
    t = f"tan({math.pi / 4!r}e0 - {phi} / 2e0) / pow((1e0 - {E!r}e0 * sin({phi})) / (1e0 + {E!r}e0 * sin({phi})), {E / 2!r}e0)"
    rho = f"({SCALE!r}e0 * {t})"
    return f"{rho} * sin(radians({lon}))", f"{rho} * cos(radians({lon}))"


def polar_inverse_sql(x: str, y: str) -> tuple[str, str]:
    """Latitude and longitude of a point on that plane (the series in the conformal latitude)."""
    chi = f"({math.pi / 2!r}e0 - 2e0 * atan(sqrt({x} * {x} + {y} * {y}) / {SCALE!r}e0))"
    terms = (E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360, 7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520, 7 * E2**3 / 120 + 81 * E2**4 / 1120, 4279 * E2**4 / 161280)
    phi = " + ".join([chi, *(f"{c:.17e} * sin({2 * (i + 1)}e0 * {chi})" for i, c in enumerate(terms))])
    return f"-1e0 * degrees({phi})", f"degrees(atan2({x}, {y}))"


def to_polar(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    x, y = polar_sql(lat, lon)
    return df.withColumn("x", F.expr(x)).withColumn("y", F.expr(y))


def from_polar(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    lat, lon = polar_inverse_sql(x, y)
    return df.withColumn("lat", F.expr(lat)).withColumn("lon", F.expr(lon))


# --- unions


def edges(polygons: DataFrame) -> DataFrame:
    """(basin, polygon_id, edge, x1, y1, x2, y2) of closed rings, upwards; level edges bound nothing and are left out."""
    polygons = polygons if "polygon_id" in polygons.columns else polygons.withColumn("polygon_id", F.col("ring_id"))
    w = Window.partitionBy("basin", "polygon_id", "ring_id").orderBy("seq")
    raw = polygons.select("basin", "polygon_id", "ring_id", "seq", "x", "y", F.lead("x").over(w).alias("_x"), F.lead("y").over(w).alias("_y")).where("_y is not null and y != _y")
    up = F.col("_y") > F.col("y")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return raw.select("basin", "polygon_id", F.struct("polygon_id", "ring_id", "seq").alias("edge"), pick("x", "_x").alias("x1"), pick("y", "_y").alias("y1"), pick("_x", "x").alias("x2"), pick("_y", "y").alias("y2"))


#: A tile with at most so many edges is cut into slabs; one with more into ``SPLIT`` x ``SPLIT`` tiles.
TILE_EDGES = 24
SPLIT = 4
FIRST_TILES = 8  # at most, along a side of what the polygons cover
ROUNDS = 12
SHORT = 8  # polygons of at most so many edges in a tile are compared with each other there
_TILE = ["basin", "ix", "iy"]
_LINE = ["x1", "y1", "x2", "y2", "a", "b"]


def _in_tiles(pieces: DataFrame, x0: float, y0: float, side: float, first: bool) -> DataFrame:
    """The pieces of edges cut at the borders of their tiles' tiles (of those of a new grid).

    A piece is the part of the line (x1, y1, x2, y2) between the heights a and b.
    What lies left of a tile matters by even and odd only: it becomes level
    marks, of which those that come twice go, and each two that follow become an
    upright piece on the tile's left border. What lies right of it does not matter.
    """
    c = F.col
    border = lambda name, i: (F.lit(x0 if name == "ix" else y0) + (c(name) + i) * F.lit(side))
    slope = F.try_divide(c("y2") - c("y1"), c("x2") - c("x1"))
    if first:
        index = lambda v, origin, by: F.floor((v - F.lit(origin)) / F.lit(side)) + by
        numbers = {"iy": F.sequence(index(c("a"), y0, -1), index(c("b"), y0, 1)), "ix": F.sequence(index(F.least("x1", "x2"), x0, -1), index(c("xr"), x0, 1))}
    else:
        numbers = {n: F.sequence(c(n) * SPLIT, c(n) * SPLIT + SPLIT - 1) for n in ("iy", "ix")}
    rows = pieces.withColumn("iy", F.explode(numbers["iy"])).withColumn("a", F.greatest("a", border("iy", 0))).withColumn("b", F.least("b", border("iy", 1))).where("a < b")
    rows = rows.withColumn("ix", F.explode(numbers["ix"])).where((border("ix", 0) < c("xr")) & (border("ix", 1) > F.least("x1", "x2")))
    # the height up to which (for lines to the left: from which) a line is left of x
    reach = lambda x: F.when(slope.isNull(), F.when(c("x1") <= x, c("b")).otherwise(c("a"))).otherwise(F.least(F.greatest(c("y1") + (x - c("x1")) * slope, c("a")), c("b")))
    rows = rows.withColumn("_p", reach(border("ix", 0))).withColumn("_q", F.when(slope.isNull() & (c("x1") == border("ix", 1)), c("_p")).otherwise(reach(border("ix", 1))))
    back = F.coalesce(slope < 0, F.lit(False))
    none = [F.lit(None).cast("double").alias(n) for n in _LINE[:4]]
    mark = lambda y, low, high: F.when(low < high, F.struct(*none, y.alias("a"), y.alias("b")))
    low, high = F.when(back, c("_p")).otherwise(c("a")), F.when(back, c("b")).otherwise(c("_p"))
    inner = F.when(c("_p") != c("_q"), F.struct(*_LINE[:4], F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b")))
    parts = rows.select(*_TILE, "polygon_id", "xr", F.explode(F.array(inner, mark(low, low, high), mark(high, low, high))).alias("_e")).where("_e is not null")
    polygon = [*_TILE, "polygon_id"]
    odd = parts.select(*polygon, "xr", "_e.*").repartition(*polygon).groupBy(*polygon, *_LINE).agg(F.max("xr").alias("xr"), F.count("*").alias("_n")).where("_n % 2 = 1")
    marks = Window.partitionBy(*polygon, F.col("x1").isNull()).orderBy("a", "b", "x1", "x2", "y1", "y2")
    on_border = c("x1").isNull()
    paired = odd.withColumn("_i", F.row_number().over(marks)).withColumn("_next", F.lead("a").over(marks)).where(~on_border | (c("_i") % 2 == 1))
    edge = lambda n: F.when(on_border, border("ix", 0) if n[0] == "x" else c("a") if n == "y1" else c("_next")).otherwise(c(n))
    cut = paired.select(*polygon, "xr", *[edge(n).alias(n) for n in _LINE[:4]], "a", F.when(on_border, c("_next")).otherwise(c("b")).alias("b"), F.count("*").over(Window.partitionBy(*polygon)).alias("_n"))
    # polygons alike within a tile are one
    few = cut.where(c("_n") <= SHORT).groupBy(*polygon).agg(F.max("xr").alias("xr"), F.array_sort(F.collect_list(F.struct(*_LINE))).alias("_e"))
    few = few.groupBy(*_TILE, "_e").agg(F.min("polygon_id").alias("polygon_id"), F.max("xr").alias("xr"))
    whole = (F.size("_e") == 1) & (c("_e")[0]["x2"] == border("ix", 0)) & (c("_e")[0]["x1"] == border("ix", 0)) & (c("_e")[0]["a"] == border("iy", 0)) & (c("_e")[0]["b"] == border("iy", 1))
    few = few.select(*polygon, "xr", whole.alias("whole"), F.explode("_e").alias("_e")).select(*polygon, "xr", "whole", "_e.*")
    return few.unionByName(cut.where(c("_n") > SHORT).select(*polygon, "xr", F.lit(False).alias("whole"), *_LINE))


def dissolve(polygons: DataFrame, row: float = 1.0) -> DataFrame:
    """(basin, y_low, y_high, left_low, right_low, left_high, right_high): each basin's union as trapezoids that do not overlap.

    ``polygons``: basin, ring_id, seq, x, y and, where polygons have several
    rings, polygon_id; a ring in another is a hole, one that crosses itself is
    read by even and odd. The plane is cut into square tiles (of side ``row``
    times a power of ``SPLIT`` at first). A tile that lies in one polygon is
    whole; one with few edges is cut into slabs at the heights of all corners
    and crossings, so that no edges cross within a slab and edges from left to
    right open and close polygons; any other is cut into smaller tiles. So many
    polygons over each other cost no crossings but those near the union's rim.
    Runs a job for each size of tiles; the pieces are intermediate tables.
    """
    e = edges(polygons)
    right = e.groupBy("basin", "polygon_id").agg(F.max(F.greatest("x1", "x2")).alias("xr"))
    pieces = e.select("basin", "polygon_id", "x1", "y1", "x2", "y2", F.col("y1").alias("a"), F.col("y2").alias("b")).join(right, ["basin", "polygon_id"])
    x0, x1, y0, y1 = e.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min("y1"), F.max("y2")).first()
    x0, x1, y0, y1 = (0.0, 1.0, 0.0, 1.0) if x0 is None else (x0, x1, y0, y1)
    side = float(row)
    while max(x1 - x0, y1 - y0) > FIRST_TILES * side:
        side *= SPLIT
    done, light = [], []
    for turn in range(ROUNDS):
        tiles = written(_in_tiles(pieces, x0, y0, side, turn == 0), "tiles")
        counts = tiles.groupBy(*_TILE).agg(F.count("*").alias("_m"), F.max("whole").alias("_whole"))
        left, low = F.lit(x0) + F.col("ix") * F.lit(side), F.lit(y0) + F.col("iy") * F.lit(side)
        far, high = F.lit(x0) + (F.col("ix") + 1) * F.lit(side), F.lit(y0) + (F.col("iy") + 1) * F.lit(side)
        done.append(counts.where("_whole").select("basin", low.alias("y_low"), high.alias("y_high"), left.alias("left_low"), far.alias("right_low"), left.alias("left_high"), far.alias("right_high")))
        crowded = F.col("_m") > (TILE_EDGES if turn + 1 < ROUNDS else 1 << 62)
        light.append(tiles.join(counts.where(~F.col("_whole") & ~crowded).select(*_TILE), _TILE).withColumn("side", F.lit(side)).withColumn("_left", left).withColumn("_right", far))
        open_tiles = counts.where(~F.col("_whole") & crowded)
        if open_tiles.isEmpty():
            break
        pieces, side = tiles.join(open_tiles.select(*_TILE), _TILE), side / SPLIT
    slabs = _in_slabs(written(functools.reduce(DataFrame.unionByName, light), "light_tiles"), [*_TILE, "side"])
    return functools.reduce(DataFrame.unionByName, done, slabs)


def _in_slabs(pieces: DataFrame, tile: list[str]) -> DataFrame:
    """Trapezoids of the tiles' unions; a polygon that is open on the right ends at the tile's border."""
    a, b = pieces.alias("a"), pieces.alias("b")
    c = F.col
    name = lambda s: F.struct(*[c(f"{s}.{n}") for n in ["polygon_id", *_LINE]])
    met = functools.reduce(Column.__and__, [c(f"a.{n}") == c(f"b.{n}") for n in tile]) & (name("a") < name("b"))
    met &= (F.least("a.x1", "a.x2") <= F.greatest("b.x1", "b.x2")) & (F.least("b.x1", "b.x2") <= F.greatest("a.x1", "a.x2"))
    slope = lambda s: (c(f"{s}.x2") - c(f"{s}.x1")) / (c(f"{s}.y2") - c(f"{s}.y1"))
    height = F.try_divide(c("b.x1") - c("a.x1") + slope("a") * c("a.y1") - slope("b") * c("b.y1"), slope("a") - slope("b"))
    crossings = a.join(b, met).select(*[f"a.{n}" for n in tile], height.alias("y"), F.greatest("a.a", "b.a").alias("_lo"), F.least("a.b", "b.b").alias("_hi")).where("y > _lo and y < _hi").select(*tile, "y")
    levels = pieces.select(*tile, F.explode(F.array("a", "b")).alias("y")).unionByName(crossings).distinct()
    slabs = levels.select(*tile, F.col("y").alias("y_low"), F.lead("y").over(Window.partitionBy(*tile).orderBy("y")).alias("y_high")).where("y_high is not null")
    at = lambda y: F.least(F.greatest(c("x1") + (c("x2") - c("x1")) * (y - c("y1")) / (c("y2") - c("y1")), c("_left")), c("_right"))
    cut = slabs.join(pieces, tile).where("a <= y_low and b >= y_high").select(*tile, "y_low", "y_high", "polygon_id", "_right", at(c("y_low")).alias("low"), at(c("y_high")).alias("high"))
    middle = F.col("low") + F.col("high")
    slab = Window.partitionBy(*tile, "y_low")
    opens = F.row_number().over(Window.partitionBy(*tile, "y_low", "polygon_id").orderBy(middle)) % 2
    turns = cut.withColumn("_middle", middle).withColumn("_step", 2 * opens - 1)
    order = slab.orderBy("_middle", F.desc("_step"))
    state = turns.withColumn("_open", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = state.withColumn("_starts", (F.col("_step") == 1) & (F.col("_open") == 1)).where("_starts or _open = 0")
    paired = ends.withColumn("right_low", F.coalesce(F.lead("low").over(order), "_right")).withColumn("right_high", F.coalesce(F.lead("high").over(order), "_right"))
    return paired.where("_starts and (right_low > low or right_high > high)").select("basin", "y_low", "y_high", F.col("low").alias("left_low"), "right_low", F.col("high").alias("left_high"), "right_high")


def union_area(pieces: DataFrame) -> DataFrame:
    """(basin, area) of dissolved polygons."""
    area = (F.col("y_high") - F.col("y_low")) * (F.col("right_low") - F.col("left_low") + F.col("right_high") - F.col("left_high")) / 2
    return pieces.groupBy("basin").agg(F.sum(area).alias("area"))


def as_polygons(pieces: DataFrame) -> DataFrame:
    """(basin, polygon_id, ring_id, seq, x, y): each trapezoid as a closed ring, for ``points_in_polygons``."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("left_low", "y_low"), corner("right_low", "y_low"), corner("right_high", "y_high"), corner("left_high", "y_high"), corner("left_low", "y_low"))
    name = F.concat_ws(":", F.col("y_low").cast("string"), F.col("left_low").cast("string"), F.col("left_high").cast("string"))
    return pieces.select("basin", name.alias("polygon_id"), F.lit(0).alias("ring_id"), F.posexplode(ring).alias("seq", "_c")).select("basin", "polygon_id", "ring_id", "seq", "_c.x", "_c.y")


# --- columns and metadata of polygon tables


def first_column(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that the table has, in any case of letters."""
    known = {c.lower(): c for c in df.columns}
    return next((known[n.lower()] for n in names if n.lower() in known), None)


# Columns that hold names, in order of preference.
NAME_COLUMNS = ["NAME", "SUBREGION", "BASIN"]
REGION_COLUMNS = ["REGION", "Regions"]


def sectors(table: DataFrame, name: str | None = None, region: str | None = None, wanted: list[str] | None = None) -> DataFrame:
    """The table with ``name`` and ``region`` cleaned for use as file names; rows without a name go.

    The columns are the given ones or the first of the usual ones. ``wanted``
    keeps sectors by their uncleaned name; an unknown one is an error.
    """
    from seriesforge.sources.frames import clean_name

    name, region = name or first_column(table, NAME_COLUMNS), region or first_column(table, REGION_COLUMNS)
    if name is None or name not in table.columns:
        raise ValueError(f"no column of names; there are {table.columns}")
    if wanted is not None:
        found = {r[0] for r in table.where(F.col(f"`{name}`").isin(wanted)).select(f"`{name}`").distinct().collect()}  # of the wanted ones
        if missing := sorted(set(wanted) - found):
            raise ValueError(f"unknown sectors: {missing}")
        table = table.where(F.col(f"`{name}`").isin(wanted))
    others = [F.col(f"`{c}`") for c in table.columns if c not in (name, region)]
    cleaned = table.select(clean_name(F.col(f"`{name}`")).alias("name"), (clean_name(F.col(f"`{region}`")) if region else F.lit(None).cast("string")).alias("region"), *others)
    return cleaned.where("name is not null")


def with_metadata(dissolved: DataFrame, table: DataFrame, order: str, on: str = "name") -> DataFrame:
    """Each dissolved row beside the first row of its name; names without one keep nulls."""
    first = table.withColumn("_i", F.row_number().over(Window.partitionBy(on).orderBy(order))).where("_i = 1").drop("_i")
    return dissolved.join(first, on, "left")
