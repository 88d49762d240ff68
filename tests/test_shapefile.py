"""Polygon files: a round trip, a file made by hand, bounds, projections."""

import datetime
import glob
import os
import struct

import pytest

from seriesforge.sources import frames, geometry, shapefile

SQUARE = [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]]
FAR = [[(10.0, 10.0), (10.0, 11.0), (11.0, 11.0), (10.0, 10.0)]]
SCHEMA = "NAME string, REGION string, n long, area double, whole boolean, day date, rings array<array<struct<x:double,y:double>>>"


def rows():
    day = datetime.date(2001, 2, 3)
    return [(" Pine Island ", "West/A", -(2**62), 1 / 3, True, day, SQUARE), ("Getz é", None, None, None, None, None, FAR), ("none", "East", 0, -1.2345678901234567e-300, False, day, None), (None, "x", 7, 5e300, True, day, [FAR[0][:3]])]


@pytest.mark.parametrize("per_file", [1, 2, 100])
def test_round_trip(spark, tmp_path, per_file):
    path = str(tmp_path / "shapes")
    shapefile.write_shapes(spark.createDataFrame(rows(), SCHEMA).coalesce(1), path, per_file=per_file)
    assert len(glob.glob(f"{path}/*.shp")) == -(-4 // per_file) and not glob.glob(f"{path}/_temporary/*")
    for f in glob.glob(f"{path}/*.shp"):
        with open(f, "rb") as file:
            raw = file.read()
        assert struct.unpack_from(">i", raw, 24)[0] * 2 == len(raw)
    df = shapefile.read_shapes(spark, path)
    assert df.columns == ["file", "shape", "NAME", "REGION", "n", "area", "whole", "day", "rings"]
    key = lambda r: str(r[0])
    got = sorted(([*r[:6], r[6] and [[tuple(p) for p in ring] for ring in r[6]]] for r in df.drop("file", "shape").collect()), key=key)
    want = [[r[0] and r[0].strip(), *r[1:6], r[6]] for r in rows()]
    want[3][6] = FAR  # the open ring is closed
    assert got == sorted(want, key=key)


def test_bounds_index_and_partitions(spark, tmp_path):
    path = str(tmp_path / "shapes")
    shapefile.write_shapes(spark.createDataFrame(rows(), SCHEMA).coalesce(1), path)
    near = shapefile.read_shapes(spark, path, bbox=(-1, -1, 5, 5))
    assert {(r["shape"], r["NAME"]) for r in near.collect()} == {(0, "Pine Island"), (2, "none")}
    small = spark.read.format("shapes").option("partitionBytes", 100).load(path)
    assert small.rdd.getNumPartitions() > 1
    everything = sorted(map(str, shapefile.read_shapes(spark, path).collect()))
    assert sorted(map(str, small.collect())) == everything
    for f in glob.glob(f"{path}/*.shx"):
        os.remove(f)
    assert sorted(map(str, shapefile.read_shapes(spark, path).collect())) == everything
    for f in glob.glob(f"{path}/*.dbf"):
        os.remove(f)
    assert shapefile.read_shapes(spark, path).columns == ["file", "shape", "rings"] and shapefile.read_shapes(spark, path).count() == 4


def test_file_of_another_writer(spark, tmp_path):
    """Polygons with heights, a deleted row, numbers with decimals, Latin letters."""
    points = [(1.0, 2.0), (3.0, 4.0), (5.0, 0.0), (1.0, 2.0)]
    content = struct.pack("<i4d2i", 15, 1, 0, 5, 4, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in points) + struct.pack("<6d", 0, 9, 7, 8, 9, 7)
    records = b"".join(struct.pack(">2i", i, len(content) // 2) + content for i in (1, 2))
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(records) // 2) + struct.pack("<2i8d", 1000, 15, 1, 0, 5, 4, 0, 9, 0, 0)
    (tmp_path / "a.shp").write_bytes(head + records)
    field = lambda name, kind, length, decimals: name.ljust(11, b"\0") + kind + struct.pack("<4xBB14x", length, decimals)
    table = struct.pack("<4BIHH20x", 3, 99, 1, 1, 2, 32 + 3 * 32 + 1, 1 + 6 + 8 + 4) + field(b"Basin", b"C", 6, 0) + field(b"AREA", b"N", 8, 2) + field(b"ID", b"N", 4, 0) + b"\x0d"
    (tmp_path / "a.dbf").write_bytes(table + b" B\xe9 a  " + b"   12.50" + b"   7" + b"*gone  " + b"    1.00" + b"****" + b"\x1a")
    (tmp_path / "a.cpg").write_bytes(b"ISO-8859-1")
    got = shapefile.read_shapes(spark, str(tmp_path / "a.shp")).orderBy("shape").collect()
    assert [(r["Basin"], r["AREA"], r["ID"]) for r in got] == [("Bé a", 12.5, 7), (None, None, None)]
    assert [[tuple(p) for p in ring] for ring in got[0]["rings"]] == [points]
    assert [r["name"] for r in shapefile.load_sectors(spark, str(tmp_path / "a.shp")).collect()] == ["Bé_a"]


def test_sectors_in_degrees(spark, tmp_path):
    corners = [(-75.0, 100.0), (-74.0, 100.0), (-74.0, 103.0), (-75.0, 103.0)]
    plane = [(r["x"], r["y"]) for r in geometry.to_polar(spark.createDataFrame([(i, *c) for i, c in enumerate(corners)], "i int, lat double, lon double")).orderBy("i").collect()]
    shapes = spark.createDataFrame([("a b", [plane]), ("c", None)], "NAME string, rings array<array<struct<x:double,y:double>>>")
    shapefile.write_shapes(shapes, str(tmp_path / "p"), crs=shapefile.POLAR)
    sectors = shapefile.load_sectors(spark, str(tmp_path / "p"))
    ring = sectors.where("name = 'a_b'").first()["rings"][0]
    assert [(p["y"], p["x"]) for p in ring] == [pytest.approx(c, abs=1e-8) for c in [*corners, corners[0]]]
    cells = spark.createDataFrame([(1, 101.0, -74.5), (2, 99.0, -74.5)], "cell_id int, lon double, lat double")
    assert {r["cell_id"] for r in frames.points_in_polygons(cells, shapefile.ring_points(sectors)).collect()} == {1}
    shapefile.write_shapes(shapes, str(tmp_path / "q"), crs='PROJCS["other"]')
    with pytest.raises(ValueError, match="not known"):
        shapefile.load_sectors(spark, str(tmp_path / "q"))


def test_what_does_not_fit_is_an_error(spark, tmp_path):
    for columns, value in (("a_long_column string", "x"), ("a string", "x" * 255)):
        df = spark.createDataFrame([(value, SQUARE)], f"{columns}, rings array<array<struct<x:double,y:double>>>")
        with pytest.raises(Exception, match="at most 10|fields hold"):
            shapefile.write_shapes(df, str(tmp_path / "e"))
    assert not [f for f in glob.glob(str(tmp_path / "e" / "**"), recursive=True) if os.path.isfile(f)]
