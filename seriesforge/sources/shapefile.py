"""Polygon files (shapes, their index, a table of attributes) as a Spark data source.

Reading: ``spark.read.format("shapes").load(path)`` gives a row for each shape: its
file and place in it, its attributes, and ``rings``, an array of arrays of points.
The path is a ``.shp`` file or a folder of them. A partition is a run of shapes of
one file: the index says where they stand, a row of attributes has a fixed length,
so only a partition's bytes are read. The option ``bbox`` ("x1,y1,x2,y2") leaves
out shapes whose bounds do not meet it, before their points are read.

Writing: a set of files for each task, or several by ``shapesPerFile``. As for
gridded files, they are under a temporary name until all tasks have ended.

Defined results: a shape without points has null rings; blank attributes and those
of deleted rows' shapes are null; an attribute of over 254 bytes or a column name
of over 10 is an error when written, never cut. Rings are written in the direction
given, closed if they are not.
"""

from __future__ import annotations

import datetime
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from seriesforge.sources import geometry
from seriesforge.sources.netcdf import _files

# Fixed values of the format: file code, version, kinds of shapes that are polygons (plain, with heights, with measures).
CODE, VERSION, NULL_SHAPE, POLYGONS = 9994, 1000, 0, (5, 15, 25)
PARTITION_BYTES = 8_000_000
RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
# The plane of ``geometry`` and the geographic system, as projection files state them.
GEOGRAPHIC = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
POLAR = f'PROJCS["WGS_1984_Antarctic_Polar_Stereographic",{GEOGRAPHIC},PROJECTION["Stereographic_South_Pole"],PARAMETER["False_Easting",0.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",0.0],PARAMETER["Standard_Parallel_1",-71.0],UNIT["Meter",1.0]]'


@dataclass
class Column:
    name: str
    kind: str
    start: int  # in a row, behind the mark of deletion
    length: int
    decimals: int

    @property
    def type(self) -> T.DataType:
        if self.kind in "NF":
            return T.LongType() if self.kind == "N" and not self.decimals and self.length < 20 else T.DoubleType()
        return {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())

    def value(self, raw: bytes, encoding: str):
        text = raw.decode(encoding, "replace").strip(" \0")
        if self.kind in "NF":
            if not text or text.startswith("*"):
                return None
            return int(text) if isinstance(self.type, T.LongType) and "." not in text else float(text) if isinstance(self.type, T.DoubleType) else int(float(text))
        if self.kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        if self.kind == "D":
            return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])) if len(text) == 8 and text.isdigit() and text != "0" * 8 else None
        return text or None


@dataclass
class Attributes:
    rows: int
    header: int
    row: int
    columns: list[Column]


def read_attributes(file) -> Attributes:
    """The header of a table of attributes."""
    rows, header, row = struct.unpack("<4xIHH", file.read(12))
    file.seek(32)
    columns, at = [], 1
    listed = file.read(header - 32)
    for i in range(0, len(listed) - 31, 32):
        if listed[i] == 0x0D:
            break
        name = listed[i : i + 11].split(b"\0")[0].decode("latin-1")
        length, decimals = listed[i + 16], listed[i + 17]
        columns.append(Column(name, chr(listed[i + 11]), at, length, decimals))
        at += length
    return Attributes(rows, header, row, columns)


def _beside(path: str, suffix: str) -> str:
    return path[:-4] + suffix


def _there(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pafs.FileType.File


def _text(fs: pafs.FileSystem, path: str) -> str:
    if not _there(fs, path):
        return ""
    with fs.open_input_file(path) as file:
        return file.read().decode("latin-1").strip()


def _places(fs: pafs.FileSystem, path: str) -> np.ndarray:
    """(shapes, 2): byte and content's length of every shape, from the index or, without one, from the shapes' heads."""
    if _there(fs, _beside(path, ".shx")):
        with fs.open_input_file(_beside(path, ".shx")) as file:
            return 2 * np.frombuffer(file.read()[100:], ">i4").reshape(-1, 2).astype(np.int64)
    out = []
    with fs.open_input_file(path) as file:
        at, end = 100, file.size()
        while at + 8 <= end:
            file.seek(at)
            (words,) = struct.unpack(">4xi", file.read(8))
            out.append((at, 2 * words))
            at += 8 + 2 * words
    return np.array(out, np.int64).reshape(-1, 2)


def _rings(content: bytes, bbox: tuple[float, ...] | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Points of a shape and where its rings begin and end; None if it has none, ValueError if it lies out of bounds."""
    (kind,) = struct.unpack_from("<i", content)
    if kind == NULL_SHAPE:
        return None
    if kind not in POLYGONS:
        raise TypeError(f"shapes of kind {kind} are no polygons")
    x1, y1, x2, y2, parts, n = struct.unpack_from("<4d2i", content, 4)
    if bbox and (x2 < bbox[0] or x1 > bbox[2] or y2 < bbox[1] or y1 > bbox[3]):
        raise ValueError
    starts = np.frombuffer(content, "<i4", parts, 44)
    return np.frombuffer(content, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2), np.append(starts, n)


@dataclass
class Shapes(InputPartition):
    path: str
    first: int
    places: list[tuple[int, int]]


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.names = options["path"], schema.names
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.bbox = tuple(map(float, options["bbox"].split(","))) if "bbox" in options else None

    def partitions(self):
        fs, paths = _files(self.path, ".shp")
        out = []
        for path in paths:
            places = _places(fs, path)
            share = np.cumsum(places[:, 1] + 8) // self.bytes
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(places)]
            out += [Shapes(path, a, [tuple(map(int, p)) for p in places[a:b]]) for a, b in zip(cuts, cuts[1:]) if b > a]
        return out or [Shapes("", 0, [])]

    def read(self, part: Shapes):
        if not part.places:
            return
        fs, _ = _files(self.path, ".shp")
        encoding = _text(fs, _beside(part.path, ".cpg")).lower() or "utf-8"
        encoding = "utf-8" if encoding in ("utf-8", "utf8", "65001") else "latin-1"
        shapes, kept = [], []
        with fs.open_input_file(part.path) as file:
            for i, (at, length) in enumerate(part.places):
                file.seek(at + 8)
                try:
                    shapes.append(_rings(file.read(length), self.bbox))
                    kept.append(i)
                except ValueError:
                    continue
        columns: dict[str, list] = {name: [None] * len(kept) for name in self.names[2:-1]}
        if _there(fs, _beside(part.path, ".dbf")):
            with fs.open_input_file(_beside(part.path, ".dbf")) as file:
                table = read_attributes(file)
                file.seek(table.header + part.first * table.row)
                raw = file.read(len(part.places) * table.row)
            for c in table.columns:
                if c.name in columns:
                    for j, i in enumerate(kept):
                        row = raw[i * table.row : (i + 1) * table.row]
                        columns[c.name][j] = c.value(row[c.start : c.start + c.length], encoding) if row[:1] == b" " else None
        points = np.concatenate([s[0] for s in shapes if s] or [np.empty((0, 2))])
        offset, ring_ends, shape_ends = 0, [0], [0]
        for s in shapes:
            if s:
                ring_ends += (offset + s[1][1:]).tolist()
                offset += len(s[0])
            shape_ends.append(len(ring_ends) - 1)
        flat = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], fields=list(POINT))
        rings = pa.ListArray.from_arrays(pa.array(ring_ends, pa.int32()), flat)
        nested = pa.ListArray.from_arrays(pa.array(shape_ends, pa.int32()), rings, mask=pa.array([s is None for s in shapes]))
        arrow = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32()}
        first = [pa.array([part.path.rsplit("/", 1)[-1]] * len(kept)), pa.array([part.first + i for i in kept], pa.int64())]
        typed = [pa.array(columns[f.name], arrow[f.dataType.simpleString()]) for f in self.schema.fields[2:-1]]
        yield pa.RecordBatch.from_arrays([*first, *typed, nested], names=self.names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ShapeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"].rstrip("/"), schema
        self.per_file, self.crs = int(options.get("shapesperfile", 100_000)), options.get("crs", GEOGRAPHIC)
        self.job = uuid.uuid4().hex
        self.attributes = [f for f in schema.fields if f.name != "rings"]
        if "rings" not in schema.names or not self.attributes:
            raise ValueError("a column rings and at least one attribute")
        for f in self.attributes:
            if len(f.name.encode()) > 10:
                raise ValueError(f"names of columns have at most 10 bytes: {f.name}")
            if f.dataType.simpleString() not in ("string", "int", "bigint", "double", "boolean", "date"):
                raise ValueError(f"no such attributes: {f.name} {f.dataType.simpleString()}")

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator):
        fs, place = self._fs()
        fs.create_dir(f"{place}/_temporary/{self.job}", recursive=True)
        names, shapes, rows = [], [], []

        def close():
            if not shapes:
                return
            name = f"part-{uuid.uuid4().hex}"
            for suffix, content in (*self.encoded(shapes), (".dbf", self.table(rows)), (".prj", self.crs.encode()), (".cpg", b"UTF-8")):
                with fs.open_output_stream(f"{place}/_temporary/{self.job}/{name}{suffix}") as out:
                    out.write(content)
                names.append(name + suffix)
            shapes.clear()
            rows.clear()

        for batch in iterator:
            listed = batch.column(batch.schema.names.index("rings"))
            columns = [batch.column(batch.schema.names.index(f.name)).to_pylist() for f in self.attributes]
            for i in range(batch.num_rows):
                shapes.append(self.shape(listed[i]))
                rows.append([c[i] for c in columns])
                if len(shapes) >= self.per_file:
                    close()
        close()
        return Written(names)

    def shape(self, rings: pa.ListScalar) -> tuple[tuple[float, ...] | None, bytes]:
        """Bounds and content of a shape."""
        parts = []
        for ring in rings.values if rings.is_valid else ():
            if ring.is_valid and len(ring.values):
                points = np.column_stack([np.asarray(ring.values.field(c), float) for c in ("x", "y")])
                parts.append(points if (points[0] == points[-1]).all() else np.vstack([points, points[:1]]))
        if not parts:
            return None, struct.pack("<i", NULL_SHAPE)
        points = np.concatenate(parts).astype("<f8")
        bounds = (*points.min(0).tolist(), *points.max(0).tolist())
        starts = np.cumsum([0, *(len(p) for p in parts[:-1])]).astype("<i4")
        return bounds, struct.pack("<i4d2i", POLYGONS[0], *bounds, len(parts), len(points)) + starts.tobytes() + points.tobytes()

    def encoded(self, shapes: list) -> list[tuple[str, bytes]]:
        bounds = np.array([b for b, _ in shapes if b] or [(0.0,) * 4])
        low, high = bounds[:, :2].min(0), bounds[:, 2:].max(0)
        body, index, at = [], [], 50  # in words of two bytes
        for i, (_, content) in enumerate(shapes):
            words = len(content) // 2
            body.append(struct.pack(">2i", i + 1, words) + content)
            index.append(struct.pack(">2i", at, words))
            at += 4 + words
        head = lambda words: struct.pack(">7i", CODE, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", VERSION, POLYGONS[0], *low, *high, 0, 0, 0, 0)
        return [(".shp", head(at) + b"".join(body)), (".shx", head(50 + 4 * len(shapes)) + b"".join(index))]

    def table(self, rows: list[list]) -> bytes:
        """Attributes in fields as wide as the file's widest value."""
        kinds = {"string": "C", "int": "N", "bigint": "N", "double": "F", "boolean": "L", "date": "D"}

        def cell(value, kind: str) -> bytes:
            if value is None:
                return b"?" if kind == "L" else b""
            if kind == "L":
                return b"T" if value else b"F"
            return (value.strftime("%Y%m%d") if kind == "D" else repr(float(value)) if kind == "F" else str(value)).encode()

        columns, described = [], b""
        for j, f in enumerate(self.attributes):
            kind = kinds[f.dataType.simpleString()]
            cells = [cell(r[j], kind) for r in rows]
            widest = max(map(len, cells))
            if widest > 254:
                raise ValueError(f"an attribute of {widest} bytes: {f.name}; fields hold 254")
            width = {"L": 1, "D": 8, "F": 24}.get(kind, max(widest, 19 if kind == "N" else 1))
            if widest > width:
                raise ValueError(f"a number of {widest} digits: {f.name}; fields hold {width}")
            described += f.name.encode().ljust(11, b"\0") + kind.encode() + struct.pack("<4xBB14x", width, 15 if kind == "F" else 0)
            columns.append([c.rjust(width) if kind in "NF" else c.ljust(width) for c in cells])
        today = datetime.date.today()
        head = struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, len(rows), 33 + len(described), 1 + sum(len(c[0]) for c in columns))
        return head + described + b"\x0d" + b"".join(b" " + b"".join(row) for row in zip(*columns)) + b"\x1a"

    def commit(self, messages):
        fs, place = self._fs()
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{place}/_temporary/{self.job}/{name}", f"{place}/{name}")
        self.abort(messages)

    def abort(self, messages):
        fs, place = self._fs()
        if fs.get_file_info(f"{place}/_temporary/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{place}/_temporary/{self.job}")


class ShapeSource(DataSource):
    """Options: bbox; for writing crs and shapesPerFile."""

    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> T.StructType:
        fs, paths = _files(self.options["path"], ".shp")
        if not paths:
            raise ValueError("no polygon files there")
        columns = []
        if _there(fs, _beside(paths[0], ".dbf")):
            with fs.open_input_file(_beside(paths[0], ".dbf")) as file:
                columns = read_attributes(file).columns
        return T.StructType([T.StructField("file", T.StringType()), T.StructField("shape", T.LongType()), *(T.StructField(c.name, c.type) for c in columns), T.StructField("rings", RINGS)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        reader = ShapeReader(dict(self.options), schema)
        reader.schema = schema
        return reader

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("polygon files are added to a folder, not put in place of others")
        return ShapeWriter(dict(self.options), schema)


def read_shapes(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(file, shape, attributes, rings)"""
    spark.dataSource.register(ShapeSource)
    reader = spark.read.format("shapes")
    return (reader.option("bbox", ",".join(map(repr, bbox))) if bbox else reader).load(path)


def write_shapes(shapes: DataFrame, path: str, crs: str = GEOGRAPHIC, per_file: int = 100_000) -> None:
    """Attributes and ``rings`` as polygon files."""
    shapes.sparkSession.dataSource.register(ShapeSource)
    shapes.write.format("shapes").mode("append").option("crs", crs).option("shapesPerFile", per_file).save(path)


def load_sectors(spark: SparkSession, path: str, name: str | None = None, region: str | None = None, wanted: list[str] | None = None) -> DataFrame:
    """Cleaned name and region, other attributes, and ``rings`` in degrees, x being the longitude.

    Files without a projection are taken as geographic; the plane of ``geometry``
    is turned into degrees; another projection is an error.
    """
    fs, paths = _files(path, ".shp")
    stated = {_text(fs, _beside(p, ".prj")) for p in paths}
    if len(stated) > 1:
        raise ValueError("the files state different projections")
    crs = "".join(stated).replace(" ", "").lower()
    out = geometry.sectors(read_shapes(spark, path), name, region, wanted)
    if not crs.startswith("projcs"):
        return out
    if "stereographic" not in crs or '"standard_parallel_1",-71' not in crs or '"central_meridian",0' not in crs:
        raise ValueError("a projection that is not known: " + "".join(stated)[:80])
    lat, lon = geometry.polar_inverse_sql("p.x", "p.y")
    return out.withColumn("rings", F.expr(f"transform(rings, r -> transform(r, p -> named_struct('x', {lon}, 'y', {lat})))"))


def ring_points(shapes: DataFrame, basin: str = "name") -> DataFrame:
    """(basin, polygon_id, ring_id, seq, x, y) for masks and unions; shapes without points give none."""
    one = shapes.select(F.col(basin).alias("basin"), F.concat_ws(":", "file", "shape").alias("polygon_id"), F.posexplode("rings").alias("ring_id", "_r"))
    return one.select("basin", "polygon_id", "ring_id", F.posexplode("_r").alias("seq", "_p")).select("basin", "polygon_id", "ring_id", "seq", "_p.x", "_p.y")
