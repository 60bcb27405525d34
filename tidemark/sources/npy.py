"""Arrays in .npy files as a data source: rows are read by ranges, and written by tasks.

Each file's header tells its shape and kind of number. Ranges of rows are planned as
partitions, and a task reads the bytes of its range only. A writer's tasks write files of
their own; only when all have ended do these get their names.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").load(folder)  # path, row, value
    df.select("value").write.format("npy").save(folder)
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

PART = 64 << 20  # bytes of rows of a partition, about
BATCH = 4 << 20  # bytes that are read or written at once


@dataclass
class Header:
    shape: tuple[int, ...]
    fortran: bool
    kind: np.dtype
    offset: int

    @property
    def row_bytes(self) -> int:
        return self.kind.itemsize * math.prod(self.shape[1:])


def read_header(f) -> Header:
    """The header of an .npy file that is open at its start. Python objects raise."""
    head = f.read(12)
    version = npy.read_magic(io.BytesIO(head[:8]))
    size = int.from_bytes(head[8:10], "little") if version == (1, 0) else int.from_bytes(head[8:12], "little")
    start = 10 if version == (1, 0) else 12
    whole = io.BytesIO(head[8:] + f.read(size + start - 12))
    shape, fortran, kind = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(whole)
    if kind.hasobject or kind.fields or kind.kind not in "fiub":
        raise ValueError(f"no numbers: {kind}")
    return Header(shape, fortran, kind, start + size)


def spark_type(kind: np.dtype, depth: int) -> T.DataType:
    """Halves are read as floats, unsigned numbers as signed ones that hold them."""
    if kind.kind == "b":
        out: T.DataType = T.BooleanType()
    elif kind.kind == "f":
        out = T.DoubleType() if kind.itemsize > 4 else T.FloatType()
    else:
        bits = kind.itemsize + (kind.kind == "u")
        out = T.ByteType() if bits == 1 else T.ShortType() if bits == 2 else T.IntegerType() if bits <= 4 else T.LongType()
    for _ in range(depth):
        out = T.ArrayType(out, False)
    return out


def to_arrow(rows: np.ndarray) -> pa.Array:
    """Rows of an array of any depth as (nested) lists."""
    kind = rows.dtype
    own = {"b": np.bool_, "f": np.float64 if kind.itemsize > 4 else np.float32}.get(kind.kind)
    if own is None:
        bits = kind.itemsize + (kind.kind == "u")
        own = np.int8 if bits == 1 else np.int16 if bits == 2 else np.int32 if bits <= 4 else np.int64
        if kind.kind == "u" and kind.itemsize == 8 and rows.size and rows.max() > np.iinfo(np.int64).max:
            raise OverflowError("a number is larger than the largest long")
    out = pa.array(np.ascontiguousarray(rows).ravel().astype(own))
    for k in range(rows.ndim - 1, 0, -1):
        n = math.prod(rows.shape[:k])
        out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * rows.shape[k], pa.int32()), out)
    return out


def from_arrow(values: pa.Array) -> np.ndarray:
    """Rows of (nested) lists of equal lengths as an array. Nulls, and lists of different
    lengths, raise."""
    shape = [len(values)]
    while pa.types.is_list(values.type):
        if values.null_count:
            raise ValueError("null in what is to be written")
        n = values.value_lengths().to_numpy(zero_copy_only=False)
        if len(n) and (n != n[0]).any():
            raise ValueError("rows of different shapes")
        shape.append(int(n[0]) if len(n) else 0)
        values = values.flatten()
    if values.null_count:
        raise ValueError("null in what is to be written")
    return values.to_numpy(zero_copy_only=False).reshape(shape)


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def listed(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The .npy files of a folder in order of their names, or a single one."""
    store, root = located(path)
    if store.get_file_info(root).type == fs.FileType.Directory:
        files = store.get_file_info(fs.FileSelector(root, recursive=True))
        return store, sorted(f.path for f in files if f.path.endswith(".npy") and not any(x.startswith(("_", ".")) for x in f.path[len(root) :].split("/")))
    return store, [root]


@dataclass
class Range(InputPartition):
    file: str
    header: Header
    first: int
    last: int


class NpySource(DataSource):
    """Options: path; ``first`` and ``last`` bound the rows of each file; ``kind`` is that of
    the numbers that are written (as NumPy names it), else as they are."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> T.StructType:
        store, files = listed(self.options["path"])
        if not files:
            raise ValueError(f"no .npy file in {self.options['path']}")
        with store.open_input_file(files[0]) as f:
            head = read_header(f)
        if not head.shape:
            raise ValueError("an array without rows")
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), T.StructField("value", spark_type(head.kind, len(head.shape) - 1))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NpyReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NpyWriter(self.options, overwrite)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.kind = options["path"], schema["value"].dataType
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None

    def partitions(self) -> list[Range]:
        store, files = listed(self.path)
        out = []
        for name in files:
            with store.open_input_file(name) as f:
                head = read_header(f)
            if not head.shape or spark_type(head.kind, len(head.shape) - 1) != self.kind:
                raise ValueError(f"{name}: {head.kind} of shape {head.shape} isn't as in the first file")
            last = head.shape[0] if self.last is None else min(self.last, head.shape[0])
            # By columns, rows aren't together: such a file is one part, and read whole.
            step = last if head.fortran and len(head.shape) > 1 else max(1, PART // max(1, head.row_bytes))
            out += [Range(name, head, k, min(k + step, last)) for k in range(self.first, last, max(1, step))]
        return out or [Range("", Header((0,), False, np.dtype("<f8"), 0), 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.first >= part.last:
            return
        store, head = located(self.path)[0], part.header
        step = max(1, BATCH // max(1, head.row_bytes))
        with store.open_input_file(part.file) as f:
            whole = None
            if head.fortran and len(head.shape) > 1:
                f.seek(head.offset)
                raw = f.read(head.row_bytes * head.shape[0])
                whole = np.frombuffer(raw, head.kind).reshape(head.shape, order="F")
            for k in range(part.first, part.last, step):
                end = min(k + step, part.last)
                if whole is not None:
                    rows = whole[k:end]
                else:
                    f.seek(head.offset + k * head.row_bytes)
                    raw = f.read((end - k) * head.row_bytes)
                    if len(raw) < (end - k) * head.row_bytes:
                        raise ValueError(f"{part.file} ends before row {end}")
                    rows = np.frombuffer(raw, head.kind).reshape(end - k, *head.shape[1:])
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * (end - k)), pa.array(np.arange(k, end)), to_arrow(rows)], names=["path", "row", "value"])


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str | None
    rows: int


class NpyWriter(DataSourceArrowWriter):
    """A file for each task that has rows, part-00000.npy and so on, of the column ``value`` or the
    only one. What a task writes is first its rows, and then, behind the header that
    tells their number, a copy of them, in a hidden folder; files are moved when all are
    there. What was in the folder before stays unless it is overwritten."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, f"_writing-{uuid.uuid4().hex}"
        self.kind = np.dtype(options["kind"]) if "kind" in options else None

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = located(self.path)
        own = f"{root}/{self.run}/{context.partitionId():05d}-{context.taskAttemptId()}"
        rows, shape, kind, body = 0, None, None, None
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                x = b.slice(k, 1024)
                x = from_arrow(x.column(x.schema.get_field_index("value") if "value" in x.schema.names else 0))
                x = np.ascontiguousarray(x, self.kind or x.dtype)
                if body is None:
                    store.create_dir(f"{root}/{self.run}", recursive=True)
                    shape, kind, body = x.shape[1:], x.dtype, store.open_output_stream(f"{own}.body", compression=None)
                if x.shape[1:] != shape:
                    raise ValueError("rows of different shapes")
                body.write(x.data if x.size else b"")
                rows += len(x)
        if body is None:
            return Written(context.partitionId(), None, 0)
        body.close()
        head = io.BytesIO()
        npy.write_array_header_2_0(head, {"descr": npy.dtype_to_descr(kind), "fortran_order": False, "shape": (rows, *shape)})
        with store.open_output_stream(f"{own}.npy", compression=None) as f, store.open_input_stream(f"{own}.body", compression=None) as g:
            f.write(head.getvalue())
            while piece := g.read(BATCH):
                f.write(piece)
        store.delete_file(f"{own}.body")
        return Written(context.partitionId(), f"{own}.npy", rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = located(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for f in listed(self.path)[1]:
                store.delete_file(f)
        first = len(listed(self.path)[1])
        files = [m.file for m in sorted((m for m in messages if m and m.file), key=lambda m: m.part)]
        for k, name in enumerate(files, first):
            store.move(name, f"{root}/part-{k:05d}.npy")
        self.abort(messages)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        store, root = located(self.path)
        if store.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.run}")
