"""Gridded files of the classic NetCDF format as a Spark data source.

Reading: ``spark.read.format("gridded").option("variable", ...).load(path)`` gives
a row for each cell and step that has a value; the path is a file or a folder of
files, each a stretch of time. A partition is a run of steps of one file, only its
bytes are read, and filters on ``t`` drop partitions before that.

Writing: a file for each run of steps of a partition. Tasks write under a
temporary name; when all have ended the driver gives the files their names and
writes what they hold to ``_metadata.json``; if one fails all are removed.
"""

from __future__ import annotations

import datetime
import json
import struct
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# Fixed values of the format: numbers of the types, tags of the lists.
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
PARTITION_BYTES = 16_000_000
EPOCH = datetime.date(1970, 1, 1)


@dataclass
class Variable:
    name: str
    dims: list[str]
    shape: list[int]
    kind: np.dtype
    begin: int
    attributes: dict
    records: bool
    record_bytes: int = 0  # of all variables together

    @property
    def step_values(self) -> int:
        return int(np.prod(self.shape[1:])) if self.shape else 1

    def read_steps(self, file, first: int, last: int) -> np.ndarray:
        """The values of the leading dimension's steps from ``first`` up to ``last``."""
        each = self.step_values * self.kind.itemsize
        if not self.records:
            file.seek(self.begin + first * each)
            data = file.read((last - first) * each)
        else:
            parts = []
            for step in range(first, last):
                file.seek(self.begin + step * self.record_bytes)
                parts.append(file.read(each))
            data = b"".join(parts)
        return np.frombuffer(data, self.kind).reshape(last - first, -1)


@dataclass
class Header:
    dims: dict[str, int]
    attributes: dict
    variables: dict[str, Variable] = field(default_factory=dict)
    record_dim: str | None = None


class _Reader:
    def __init__(self, file):
        self.file = file
        magic = file.read(4)
        if magic[:3] != b"CDF" or magic[3:] not in (b"\x01", b"\x02", b"\x05"):
            raise ValueError("not a classic NetCDF file")
        self.wide_counts, self.wide_offsets = magic[3] == 5, magic[3] != 1

    def number(self, wide: bool = False) -> int:
        return struct.unpack(">q" if wide else ">i", self.file.read(8 if wide else 4))[0]

    def count(self) -> int:
        return self.number(self.wide_counts)

    def padded(self, n: int) -> bytes:
        data = self.file.read(n)
        self.file.read(-n % 4)
        return data

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def items(self, tag: int):
        found, n = self.number(), self.count()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("a list of the header is out of place")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.items(ATTRIBUTES):
            name = self.name()
            kind = np.dtype(KINDS[self.number()])
            values = np.frombuffer(self.padded(self.count() * kind.itemsize), kind)
            out[name] = values.tobytes().decode(errors="replace").rstrip("\0") if kind.kind == "S" else (values[0].item() if len(values) == 1 else values.tolist())
        return out


def read_header(file) -> Header:
    r = _Reader(file)
    records = r.count()
    dims = [(r.name(), r.count()) for _ in r.items(DIMENSIONS)]
    record_dim = next((name for name, size in dims if size == 0), None)
    header = Header({name: size or records for name, size in dims}, r.attributes(), record_dim=record_dim)
    record_bytes, single = 0, []
    for _ in r.items(VARIABLES):
        name = r.name()
        names = [dims[r.count()][0] for _ in range(r.count())]
        attributes = r.attributes()
        kind = np.dtype(KINDS[r.number()])
        r.count()  # the stated size, which is derived here
        v = Variable(name, names, [header.dims[d] for d in names], kind, r.number(r.wide_offsets), attributes, bool(names) and names[0] == record_dim)
        header.variables[name] = v
        if v.records:
            single.append(v.step_values * kind.itemsize)
            record_bytes += single[-1] + -single[-1] % 4
    for v in header.variables.values():
        v.record_bytes = single[0] if len(single) == 1 else record_bytes
    return header


def _files(path: str, suffix: str = ".nc") -> tuple[pafs.FileSystem, list[str]]:
    fs, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.File:
        return fs, [place]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return fs, sorted(f.path for f in fs.get_file_info(pafs.FileSelector(place)) if f.path.endswith(suffix))


def _dates(values: np.ndarray, units: str) -> list[datetime.date | None]:
    """Dates of times given as hours or days since a date; others are null."""
    unit, _, since = units.partition(" since ")
    scale = {"days": 1.0, "day": 1.0, "hours": 1 / 24, "hour": 1 / 24}.get(unit.strip())
    try:
        start = datetime.date.fromisoformat(since.strip()[:10])
    except ValueError:
        scale = None
    return [None if scale is None else start + datetime.timedelta(days=float(np.floor(v * scale))) for v in values]


@dataclass
class Steps(InputPartition):
    path: str
    first: int
    last: int
    offset: int  # of the file's first step among all

    def __post_init__(self):
        super().__init__(self)


class GridReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.variable, self.schema = options["path"], options.get("variable"), schema
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.low, self.high = 0, None

    def pushFilters(self, filters):
        """Bounds on ``t`` choose the steps; all filters are left to Spark as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("t",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = f.value + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            yield f

    def partitions(self):
        fs, paths = _files(self.path)
        out, offset = [], 0
        for path in paths:
            with fs.open_input_file(path) as file:
                v = read_header(file).variables[self.variable]
            n = v.shape[0] if _is_stepped(v) else 1
            each = max(1, self.bytes // max(1, v.step_values * v.kind.itemsize)) if _is_stepped(v) else 1
            for first in range(0, n, each):
                last = min(n, first + each)
                if offset + last > self.low and (self.high is None or offset + first < self.high):
                    out.append(Steps(path, first, last, offset))
            offset += n
        return out or [Steps(paths[0] if paths else "", 0, 0, 0)]

    def read(self, part: Steps):
        if part.last <= part.first:
            return
        fs, _ = _files(self.path)
        with fs.open_input_file(part.path) as file:
            header = read_header(file)
            v = header.variables[self.variable]
            stepped = _is_stepped(v)
            raw = v.read_steps(file, part.first, part.last) if stepped else v.read_steps(file, 0, v.shape[0] if v.shape else 1).reshape(1, -1)
            time = header.variables.get(v.dims[0]) if stepped else None
            dates = _dates(time.read_steps(file, part.first, part.last)[:, 0].astype(float), str(time.attributes.get("units", ""))) if time else [None] * (part.last - part.first)
        values = raw.astype(float)
        bad = ~np.isfinite(values)
        for name in ("_FillValue", "missing_value"):
            if name in v.attributes:
                bad |= raw == np.asarray(v.attributes[name], v.kind)
        values = values * float(v.attributes.get("scale_factor", 1.0)) + float(v.attributes.get("add_offset", 0.0))
        shape = v.shape[1:] if stepped else v.shape
        axes = [i for i, size in enumerate(shape) if size > 1]
        for i in range(len(values)):
            at = np.flatnonzero(~bad[i])
            index = np.unravel_index(at, shape) if shape else ()
            columns = [pa.array(np.full(len(at), part.offset + part.first + i, np.int32)), pa.array([dates[i]] * len(at), pa.date32())] if stepped else []
            columns += [pa.array(index[a].astype(np.int32)) for a in axes] + [pa.array(values[i][at])]
            yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


def _is_stepped(v: Variable) -> bool:
    return bool(v.dims) and (v.records or v.dims[0] == "time")


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class GridWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.variable, self.overwrite = options["path"].rstrip("/"), options.get("variable", "value"), overwrite
        self.rows, self.columns = int(options["rows"]), int(options["columns"])
        self.start, self.units = datetime.date.fromisoformat(options.get("start", "1979-01-01")), options.get("units", "")
        self.per_file = int(options.get("stepsperfile", max(1, PARTITION_BYTES // (8 * self.rows * self.columns))))
        self.job = uuid.uuid4().hex

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator):
        """Rows come in the order of their steps."""
        fs, place = self._fs()
        fs.create_dir(f"{place}/_temporary/{self.job}", recursive=True)
        steps: dict[int, np.ndarray] = {}
        files = []

        def close():
            if steps:
                name = f"part-{min(steps):09d}-{uuid.uuid4().hex}.nc"
                with fs.open_output_stream(f"{place}/_temporary/{self.job}/{name}") as out:
                    out.write(self.encoded(steps))
                files.append({"name": name, "first": min(steps), "last": max(steps), "steps": len(steps)})
                steps.clear()

        for batch in iterator:
            names = batch.schema.names
            t, row, column, value = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("t", "rlat", "rlon", "value"))
            cuts = [0, *(np.flatnonzero(np.diff(t)) + 1).tolist(), len(t)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if steps and t[a] < max(steps):
                    raise ValueError("rows are not in the order of their steps: use write_grid")
                if t[a] not in steps and len(steps) >= self.per_file:
                    close()
                grid = steps.setdefault(int(t[a]), np.full((self.rows, self.columns), np.nan))
                grid[row[a:b], column[a:b]] = value[a:b]
        close()
        return Written(files)

    def encoded(self, steps: dict[int, np.ndarray]) -> bytes:
        """A file with time as record dimension: days, number of the step, grid."""
        text = lambda s: struct.pack(">i", len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
        attribute = lambda name, value: text(name) + struct.pack(">i", 2) + text(value)
        none = struct.pack(">ii", 0, 0)

        def variable(name, dims, attributes, kind, size, begin):
            listed = struct.pack(">ii", ATTRIBUTES, len(attributes)) + b"".join(attributes) if attributes else none
            return text(name) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + listed + struct.pack(">iiq", kind, size, begin)

        grid_bytes = 8 * self.rows * self.columns

        def head(begin: int) -> bytes:
            out = b"CDF\x02" + struct.pack(">i", len(steps))
            out += struct.pack(">ii", DIMENSIONS, 3) + text("time") + struct.pack(">i", 0) + text("rlat") + struct.pack(">i", self.rows) + text("rlon") + struct.pack(">i", self.columns)
            out += none + struct.pack(">ii", VARIABLES, 3)
            out += variable("time", [0], [attribute("units", f"days since {EPOCH.isoformat()}")], 6, 8, begin)
            out += variable("step", [0], [], 4, 4, begin + 8)
            return out + variable(self.variable, [0, 1, 2], [attribute("units", self.units)], 6, min(grid_bytes, 2**31 - 4), begin + 12)

        parts = [head(len(head(0)))]
        for t in sorted(steps):
            month = self.start.month - 1 + t
            day = (datetime.date(self.start.year + month // 12, month % 12 + 1, 1) - EPOCH).days
            parts.append(struct.pack(">di", day, t) + steps[t].astype(">f8").tobytes())
        return b"".join(parts)

    def commit(self, messages):
        fs, place = self._fs()
        if self.overwrite:
            for f in _files(self.path)[1]:
                fs.delete_file(f)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["first"])
        for f in files:
            fs.move(f"{place}/_temporary/{self.job}/{f['name']}", f"{place}/{f['name']}")
        with fs.open_output_stream(f"{place}/_metadata.json") as out:
            out.write(json.dumps({"variable": self.variable, "units": self.units, "rows": self.rows, "columns": self.columns, "start": self.start.isoformat(), "files": files}).encode())
        self._clean(fs, place)

    def abort(self, messages):
        self._clean(*self._fs())

    def _clean(self, fs, place):
        if fs.get_file_info(f"{place}/_temporary/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{place}/_temporary/{self.job}")


class GriddedSource(DataSource):
    """Options: variable; for writing rows, columns and, on request, start, units, stepsPerFile."""

    @classmethod
    def name(cls) -> str:
        return "gridded"

    def schema(self) -> T.StructType:
        fs, paths = _files(self.options["path"])
        if not paths:
            raise ValueError("no file of the classic format there")
        with fs.open_input_file(paths[0]) as file:
            header = read_header(file)
        variable = self.options.get("variable")
        if variable not in header.variables:
            raise ValueError(f"no variable {variable!r}; there are {sorted(header.variables)}")
        v = header.variables[variable]
        stepped = _is_stepped(v)
        fields = [T.StructField("t", T.IntegerType()), T.StructField("ts", T.DateType())] if stepped else []
        fields += [T.StructField(d, T.IntegerType()) for d, size in list(zip(v.dims, v.shape))[stepped:] if size > 1]
        return T.StructType([*fields, T.StructField("value", T.DoubleType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return GridReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return GridWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters given to it."""
    spark.dataSource.register(GriddedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_grid(spark: SparkSession, path: str, variable: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(t, ts, cells' indices, value) of steps from ``first`` to ``last``, both included."""
    register(spark)
    out = spark.read.format("gridded").option("variable", variable).load(path)
    if first is not None:
        out = out.where(F.col("t") >= first)
    return out if last is None else out.where(F.col("t") <= last)


def load_variable(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """A variable with its values in metres of water where the file states them in kg m-2."""
    from seriesforge.sources.frames import convert_units

    if not path.endswith(".nc") and not _files(path)[1]:
        raise ValueError(f"no gridded files: {path}")
    fs, paths = _files(path)
    with fs.open_input_file(paths[0]) as file:
        units = str(read_header(file).variables[variable].attributes.get("units", ""))
    return read_grid(spark, path, variable).withColumn("value", convert_units(F.col("value"), F.lit(units)))


def write_grid(field: DataFrame, path: str, rows: int, columns: int, variable: str = "value", start: str = "1979-01-01", units: str = "", partitions: int | None = None) -> None:
    """(t, rlat, rlon, value) as files by stretches of time."""
    register(field.sparkSession)
    rows_of = field.select(F.col("t").cast("int").alias("t"), F.col("rlat").cast("int").alias("rlat"), F.col("rlon").cast("int").alias("rlon"), F.col("value").cast("double").alias("value"))
    dealt = (rows_of.repartitionByRange(partitions, "t") if partitions else rows_of.repartitionByRange("t")).sortWithinPartitions("t")
    dealt.write.format("gridded").mode("append").option("rows", rows).option("columns", columns).option("variable", variable).option("start", start).option("units", units).save(path)
