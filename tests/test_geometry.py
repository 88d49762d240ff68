"""Projection, unions, sectors, and gridded files."""

import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.sources import frames, geometry, netcdf


def test_projection_of_known_points(spark):
    rows = spark.createDataFrame([(-75.0, 120.0), (-71.0, 0.0), (-89.9, -45.0), (-60.0, -179.0)], "lat double, lon double")
    out = geometry.from_polar(geometry.to_polar(rows).select("x", "y", F.col("lat").alias("a"), F.col("lon").alias("o"))).collect()
    for r in out:
        assert r["lat"] == pytest.approx(r["a"], abs=1e-9) and r["lon"] == pytest.approx(r["o"], abs=1e-9)
    # the published example of the variant with a standard parallel: 75 S 120 E, 71 S, origin at 70 E, 6,000,000 m added to both
    a = spark.createDataFrame([(-75.0, 120.0 - 70.0)], "lat double, lon double")
    r = geometry.to_polar(a).first()
    assert r["x"] + 6_000_000 == pytest.approx(7_255_380.79, abs=0.05) and r["y"] + 6_000_000 == pytest.approx(7_053_389.56, abs=0.05)


def polygons(spark, shapes):
    rows = [(basin, str(p), r, i, float(x), float(y)) for basin, polygon in shapes.items() for p, rings in enumerate(polygon) for r, ring in enumerate(rings) for i, (x, y) in enumerate([*ring, ring[0]])]
    return spark.createDataFrame(rows, "basin string, polygon_id string, ring_id int, seq int, x double, y double")


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_areas_of_unions(spark):
    shapes = {
        "apart": [[box(0, 0, 2, 1)], [box(5, 5, 1, 1)]],
        "overlap": [[box(0, 0, 2, 2)], [box(1, 1, 2, 2)]],
        "same": [[box(0, 0, 3, 1)], [box(0, 0, 3, 1)]],
        "neighbours": [[box(0, 0, 1, 1)], [box(1, 0, 1, 1)]],
        "hole": [[box(0, 0, 4, 4), box(1, 1, 2, 2)]],
        "filled hole": [[box(0, 0, 4, 4), box(1, 1, 2, 2)], [box(0.5, 1.5, 3, 1)]],
        "bow tie": [[[(0, 0), (2, 2), (2, 0), (0, 2)]]],
        "star": [[[(0, -2), (2, 0), (0, 2), (-2, 0)]], [box(-1.5, -1.5, 3, 3)]],
    }
    got = {r["basin"]: r["area"] for r in geometry.union_area(geometry.dissolve(polygons(spark, shapes))).collect()}
    want = {"apart": 3, "overlap": 7, "same": 3, "neighbours": 2, "hole": 12, "filled hole": 14, "bow tie": 2, "star": 8 + 4 * 0.5}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_pieces_hold_the_same_points(spark):
    rng = random.Random(3)
    shapes = {b: [[[(rng.uniform(-80, -70), rng.uniform(-5, 5)) for _ in range(rng.randint(3, 6))]] for _ in range(6)] for b in "ab"}
    source = polygons(spark, shapes)
    pieces = geometry.as_polygons(geometry.dissolve(source, row=0.7))
    points = spark.createDataFrame([(i, rng.uniform(-81, -69), rng.uniform(-6, 6)) for i in range(3000)], "cell_id int, lon double, lat double")
    inside = lambda p: {tuple(r) for r in frames.points_in_polygons(points, p).collect()}
    assert inside(pieces) == inside(source)


def test_crowded_polygons_are_cut_at_the_rim_of_their_union_only(spark):
    rng = random.Random(5)
    diamonds = [[(x, y - 1), (x + 1.5, y), (x, y + 1), (x - 1.5, y)] for x, y in ((rng.uniform(0, 3), rng.uniform(0, 2)) for _ in range(150))]
    corners = [[[(rng.randint(0, 8), rng.randint(0, 8)) for _ in range(rng.randint(3, 6))] for _ in range(2)] for _ in range(40)]  # upright edges, on borders of tiles, doubled
    source = polygons(spark, {"diamonds": [[d] for d in diamonds * 2], "corners": corners}).cache()
    pieces = geometry.dissolve(source, row=0.5).cache()
    assert pieces.where("basin = 'diamonds'").count() < 3000  # a slab for each height of a crossing: over 10,000
    heights = (np.arange(3000) + 0.5) / 3000 * 4 - 1
    inside = 0.0
    for y in heights:
        end = -9.0
        for a, b in sorted((d[0][0] - 1.5 * (1 - abs(y - d[1][1])), d[0][0] + 1.5 * (1 - abs(y - d[1][1]))) for d in diamonds if abs(y - d[1][1]) < 1):
            inside, end = inside + max(0.0, b - max(a, end)), max(end, b)
    assert geometry.union_area(pieces).where("basin = 'diamonds'").first()["area"] == pytest.approx(inside * 4 / 3000, abs=1e-3)
    points = spark.createDataFrame([(i, rng.uniform(-2, 9), rng.uniform(-2, 9)) for i in range(3000)], "cell_id int, lon double, lat double")
    found = lambda p: {tuple(r) for r in frames.points_in_polygons(points, p).collect()}
    assert found(geometry.as_polygons(pieces)) == found(source)


def test_sectors_and_metadata(spark):
    table = spark.createDataFrame([(" Pine Island ", "West / A", 1), ("A/B", None, 2), (None, "x", 3), (" ", "x", 4), ("A/B", "East", 5)], "Name string, REGION string, k int")
    out = geometry.sectors(table)
    assert [tuple(r) for r in out.orderBy("k").collect()] == [("Pine_Island", "West_-_A", 1), ("A-B", None, 2), ("A-B", "East", 5)]
    assert geometry.sectors(table, wanted=["A/B"]).count() == 2
    with pytest.raises(ValueError, match="unknown"):
        geometry.sectors(table, wanted=["A/B", "none"])
    with pytest.raises(ValueError, match="names"):
        geometry.sectors(table.select("k"))
    names = spark.createDataFrame([("A-B", 1.0), ("none", 2.0)], "name string, area double")
    merged = {r["name"]: (r["area"], r["k"]) for r in geometry.with_metadata(names, out, "k").collect()}
    assert merged == {"A-B": (1.0, 2), "none": (2.0, None)}


def encode(version, records, shape, values, fill, extra):
    """A classic file as another writer makes it: short integers with scale, a second record variable, a height of one."""
    text = lambda s: struct.pack(count, len(s)) + s + b"\0" * (-len(s) % 4)
    count, offset = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")
    n = lambda x: struct.pack(count, x)
    absent = struct.pack(">i", 0) + n(0)
    dims = [(b"time", 0), (b"height", 1), (b"rlat", shape[0]), (b"rlon", shape[1])]
    grid = values.astype(">i2").tobytes()
    each = shape[0] * shape[1] * 2
    pad = -each % 4

    def head(begin):
        out = b"CDF" + bytes([version]) + n(records) + struct.pack(">i", 10) + n(4) + b"".join(text(d) + n(s) for d, s in dims) + struct.pack(">i", 12) + n(1) + text(b"title") + struct.pack(">i", 2) + text(b"made by hand")
        out += struct.pack(">i", 11) + n(3)
        attributes = [text(b"scale_factor") + struct.pack(">i", 6) + n(1) + struct.pack(">d", 0.5), text(b"add_offset") + struct.pack(">i", 6) + n(1) + struct.pack(">d", 100.0), text(b"_FillValue") + struct.pack(">i", 3) + n(1) + struct.pack(">hh", fill, 0)]
        listed = struct.pack(">i", 12) + n(3) + b"".join(attributes)
        out += text(b"time") + n(1) + n(0) + struct.pack(">i", 12) + n(1) + text(b"units") + struct.pack(">i", 2) + text(b"hours since 1990-01-01 00:00:00") + struct.pack(">i", 6) + n(8) + struct.pack(offset, begin)
        out += text(b"smb") + n(4) + n(0) + n(1) + n(2) + n(3) + listed + struct.pack(">i", 3) + n(each + pad) + struct.pack(offset, begin + 8)
        return out + text(b"lat") + n(2) + n(2) + n(3) + absent + struct.pack(">i", 5) + n(4 * shape[0] * shape[1]) + struct.pack(offset, begin - 4 * shape[0] * shape[1])

    fixed = extra.astype(">f4").tobytes()
    begin = len(head(0)) + len(fixed)
    body = b"".join(struct.pack(">d", 24.0 * 31 * t) + grid[t * each : (t + 1) * each] + b"\0" * pad for t in range(records))
    return head(begin) + fixed + body


@pytest.mark.parametrize("version", [1, 2, 5])
def test_files_of_other_writers_are_read(spark, tmp_path, version):
    rng = np.random.default_rng(version)
    values, lat = rng.integers(-300, 300, (7, 3, 5)), rng.normal(size=(3, 5))
    values[2, 1, 1] = values[6, 0, 4] = -999
    path = str(tmp_path / "a.nc")
    with open(path, "wb") as f:
        f.write(encode(version, 7, (3, 5), values, -999, lat))
    df = netcdf.read_grid(spark, path, "smb")
    assert df.columns == ["t", "ts", "rlat", "rlon", "value"]
    got = {(r["t"], r["rlat"], r["rlon"]): r["value"] for r in df.collect()}
    assert got == {(t, i, j): 100 + 0.5 * values[t, i, j] for t in range(7) for i in range(3) for j in range(5) if values[t, i, j] != -999}
    assert str(df.where("t = 1").first()["ts"]) == "1990-02-01"
    grid = {(r["rlat"], r["rlon"]): r["value"] for r in netcdf.read_grid(spark, path, "lat").collect()}
    assert grid == {(i, j): pytest.approx(lat[i, j], rel=1e-6) for i in range(3) for j in range(5)}
    some = netcdf.read_grid(spark, path, "smb", 2, 4)
    assert {r["t"] for r in some.select("t").distinct().collect()} == {2, 3, 4}
    with pytest.raises(Exception, match="no variable"):
        netcdf.read_grid(spark, path, "none").count()


def test_filters_choose_the_partitions(tmp_path):
    path = str(tmp_path / "a.nc")
    with open(path, "wb") as f:
        f.write(encode(1, 9, (2, 2), np.zeros((9, 2, 2)), -999, np.zeros((2, 2))))
    reader = netcdf.GridReader({"path": path, "variable": "smb", "partitionbytes": "16"}, None)
    assert len(reader.partitions()) == 5
    filters = [netcdf.GreaterThanOrEqual(("t",), 4), netcdf.LessThan(("t",), 6)]
    assert list(reader.pushFilters(filters)) == filters and [(p.first, p.last) for p in reader.partitions()] == [(4, 6)]


def test_grids_are_written_and_read_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(t, i, j, float(rng.normal())) for t in range(23) for i in range(4) for j in range(6) if (i + j + t) % 5]
    field = spark.createDataFrame(rows, "t int, rlat int, rlon int, value double").repartition(5)
    path = str(tmp_path / "grid")
    netcdf.write_grid(field, path, 4, 6, "smb", "1995-01-01", partitions=3)
    assert sorted(map(tuple, netcdf.read_grid(spark, path, "smb").select("t", "rlat", "rlon", "value").collect())) == sorted(rows)
    held = json.load(open(f"{path}/_metadata.json"))
    assert sum(f["steps"] for f in held["files"]) == 23 and not os.listdir(f"{path}/_temporary")
    assert {str(r["ts"]) for r in netcdf.read_grid(spark, path, "smb", 13, 13).collect()} == {"1996-02-01"}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "grid")
    bad = spark.createDataFrame([(0, 0, 0, 1.0), (1, 9, 0, 2.0)], "t int, rlat int, rlon int, value double")
    with pytest.raises(Exception, match="out of bounds"):
        netcdf.write_grid(bad, path, 2, 2, partitions=2)
    assert not [f for f in os.listdir(path) if f.endswith(".nc")] and not os.listdir(f"{path}/_temporary")


def test_units_of_files(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 0, 500.0)], "t int, rlat int, rlon int, value double")
    for units, value in (("kg m-2 yr-1", 0.5), ("m w.e.", 500.0)):
        path = str(tmp_path / units.split()[0])
        netcdf.write_grid(rows, path, 1, 2, "smb", units=units)
        assert netcdf.load_variable(spark, path, "smb").first()["value"] == value
    with pytest.raises(FileNotFoundError):
        netcdf.load_variable(spark, str(tmp_path / "none.nc"), "smb")
