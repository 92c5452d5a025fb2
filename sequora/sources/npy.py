"""Arrays in ``.npy`` files as tables: a Spark data source that reads row ranges in parallel and writes a file for each task.

``spark.read.format("npy")`` gives (i, row) for each line of a two-dimensional array (a one-dimensional one has lines of one entry): ``i`` counts the lines of
all files in the order of their names. A partition is a range of lines of one file; it reads only its bytes, and only the columns that the option ``columns``
("0,3") names. Of floating kinds, NaN is a missing value and becomes null; of truth values (masks), the entries are 0 and 1. Options: ``lines``, how many lines a partition has.
Paths are those of any store that pyarrow's file systems know.
"""

from __future__ import annotations

import ast
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC = b"\x93NUMPY"
LINES = 65_536
#: Lines that a batch holds.
BATCH = 4096


def _open(path: str):
    from pyarrow import fs

    for hadoop, plain in (("s3a://", "s3://"), ("file:/", "file:///")):
        if path.startswith(hadoop):
            path = plain + path[len(hadoop) :].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def header(file) -> tuple[np.dtype, tuple[int, ...], int]:
    """(kind of number, shape, where the numbers begin) of an open file."""
    start = file.read(8)
    if start[:6] != MAGIC:
        raise ValueError("no .npy file")
    wide = start[6] > 1
    size = struct.unpack("<I" if wide else "<H", file.read(4 if wide else 2))[0]
    fields = ast.literal_eval(file.read(size).decode("latin1"))
    if fields["fortran_order"] and len(fields["shape"]) > 1:
        raise ValueError("columns come first in this file; only arrays stored line by line are read in ranges")
    return np.dtype(fields["descr"]), tuple(fields["shape"]), (12 if wide else 10) + size


def _head(kind: np.dtype, shape: tuple[int, ...]) -> bytes:
    said = repr({"descr": kind.str, "fortran_order": False, "shape": shape})
    said += " " * (-(len(said) + 11) % 64) + "\n"
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(said)) + said.encode("latin1")


class Lines(InputPartition):
    def __init__(self, path: str, first: int, count: int, before: int):
        self.path, self.first, self.count, self.before = path, first, count, before


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.lines = options["path"], int(options.get("lines", LINES))
        self.columns = [int(x) for x in options["columns"].split(",")] if options.get("columns") else None

    def partitions(self) -> list[Lines]:
        from pyarrow import fs

        store, path = _open(self.path)
        info = store.get_file_info(path)
        files = [path] if info.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".npy"))
        out, before = [], 0
        for f in files:
            with store.open_input_file(f) as file:
                n = (header(file)[1] or (1,))[0]
            out += [Lines(f, i, min(self.lines, n - i), before) for i in range(0, n, self.lines)]
            before += n
        return out

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        with store.open_input_file(partition.path) as file:
            kind, shape, start = header(file)
            width = int(np.prod(shape[1:], dtype=np.int64)) if len(shape) > 1 else 1
            for lo in range(partition.first, partition.first + partition.count, BATCH):
                n = min(BATCH, partition.first + partition.count - lo)
                size = n * width * kind.itemsize
                x = np.frombuffer(file.read_at(size, start + lo * width * kind.itemsize), kind).reshape(n, width)
                x = x[:, self.columns] if self.columns else x
                flat = pa.array(x.astype(np.float64).ravel(), from_pandas=kind.kind == "f")
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n) + partition.before), rows], names=["i", "row"])


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class NpyWriter(DataSourceWriter):
    """Each task writes its lines, in the order of their arrival, under a hidden name; the commit shows them in the order of the tasks' first lines."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], np.dtype(options.get("kind", "<f8")), overwrite
        self.job = uuid.uuid4().hex

    def write(self, rows) -> Written:
        store, path = _open(self.path)
        held = [(r.i, [np.nan if v is None else v for v in r.row]) for r in rows]
        if not held:
            return Written(None)
        held.sort(key=lambda x: x[0])
        x = np.array([v for _, v in held], float).astype(self.kind)
        store.create_dir(path, recursive=True)
        name = f"part-{held[0][0]:015d}-{self.job}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{path}/_{name}") as out:
            out.write(_head(self.kind, x.shape))
            out.write(x.tobytes())
        return Written(name)

    def commit(self, messages: list[Written]) -> None:
        from pyarrow import fs

        store, path = _open(self.path)
        store.create_dir(path, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".npy")] if self.overwrite else []
        for f in old:
            store.delete_file(f)
        for m in messages:
            if m and m.name:
                store.move(f"{path}/_{m.name}", f"{path}/{m.name}.npy")

    def abort(self, messages: list[Written]) -> None:
        store, path = _open(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{path}/_{m.name}")


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "i long, row array<double>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
