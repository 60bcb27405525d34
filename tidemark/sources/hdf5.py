"""Data sets of numbers in HDF5 files as a data source, read chunk by chunk.

    spark.dataSource.register(Hdf5Source)
    spark.read.format("hdf5").load(folder)                        # path, key, row, value
    spark.read.format("hdf5").option("list", True).load(folder)   # path, key, shape, kind

The headers of a file tell its data sets and where their parts lie; nothing else is read
to list them. A partition is a row of chunks, or of a data set that is in one piece a
range of rows. Rows of more than one dimension are given as one array of doubles.

Read are files as the library writes them by default, and those with the newer headers
and compact groups: data sets in one piece or in chunks that a version 1 tree finds,
with gzip, shuffle and checksums. Anything else raises and says what it is.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.npy import located

# Fixed values of the public file format.
SIGNATURE, NOWHERE = b"\x89HDF\r\n\x1a\n", (1 << 64) - 1
SPACE, TYPE, LAYOUT, FILTERS, MORE, GROUP, LINK, LINKS = 0x01, 0x03, 0x08, 0x0B, 0x10, 0x11, 0x06, 0x02
GZIP, SHUFFLE, FLETCHER = 1, 2, 3
PART = 64 << 20  # bytes of a partition of a data set in one piece, about


@dataclass
class Stored:
    """A data set: where its numbers lie, whole or by chunks (first place of each in all
    dimensions, address, size in bytes, which filters weren't used)."""

    shape: tuple[int, ...]
    kind: np.dtype
    address: int = NOWHERE
    chunk: tuple[int, ...] | None = None
    chunks: list[tuple[tuple[int, ...], int, int, int]] = field(default_factory=list)
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)

    @property
    def row_bytes(self) -> int:
        return self.kind.itemsize * math.prod(self.shape[1:])


class Headers:
    """What the headers of an open file say."""

    def __init__(self, f):
        self.f = f
        for base in (0, 512, 1024, 2048):
            head = self.at(base, 64)
            if head[:8] == SIGNATURE:
                break
        else:
            raise ValueError("no HDF5 file")
        version = head[8]
        offset, length = (head[13], head[14]) if version < 2 else (head[9], head[10])
        if version > 3 or (offset, length) != (8, 8):
            raise ValueError(f"superblock of version {version} with addresses of {offset} bytes")
        if version < 2:
            start = base + (24 if version == 0 else 28)
            self.base = struct.unpack("<Q", self.at(start, 8))[0]
            self.root = struct.unpack("<Q", self.at(start + 40, 8))[0]
        else:
            self.base, self.root = struct.unpack("<Q", head[12:20])[0], struct.unpack("<Q", head[36:44])[0]

    def at(self, place: int, size: int) -> bytes:
        self.f.seek(place)
        return self.f.read(size)

    def get(self, address: int, size: int) -> bytes:
        raw = self.at(self.base + address, size)
        if len(raw) < size:
            raise ValueError(f"the file ends before {address + size}")
        return raw

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(type, content) of an object's header, in old or new form."""
        head = self.get(address, 16)
        out: list[tuple[int, bytes]] = []
        if head[:4] == b"OHDR":
            flags = head[5]
            at = address + 6 + 16 * bool(flags & 32) + 4 * bool(flags & 16)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.get(at, width), "little")
            parts, step, cut = [(at + width, size)], 4 + 2 * bool(flags & 4), 0
        elif head[0] == 1:
            step, cut, parts = 8, 0, [(address + 16, struct.unpack("<I", head[8:12])[0])]
        else:
            raise ValueError(f"object header of version {head[0]}")
        new = step != 8
        for at, size in parts:  # grows as continuations are found
            raw, k = self.get(at, size), cut
            while k + step <= len(raw):
                kind, n = (raw[k], struct.unpack("<H", raw[k + 1 : k + 3])[0]) if new else struct.unpack("<HH", raw[k : k + 4])
                body = raw[k + step : k + step + n]
                if kind == MORE:
                    place, length = struct.unpack("<QQ", body[:16])
                    parts.append((place + 4, length - 8) if new else (place, length))  # between a mark and a checksum
                elif kind:
                    out.append((kind, body))
                k += step + n
        return out

    def tree(self, address: int, key: int) -> Iterator[tuple[bytes, int]]:
        """(key, child) of all leaves of a tree of version 1."""
        if address == NOWHERE:
            return
        head = self.get(address, 24)
        if head[:4] != b"TREE":
            raise ValueError("no tree of version 1")
        n = struct.unpack("<H", head[6:8])[0]
        raw = self.get(address + 24, n * (key + 8) + key)
        for k in range(n):
            own = raw[k * (key + 8) : k * (key + 8) + key]
            child = struct.unpack("<Q", raw[k * (key + 8) + key : (k + 1) * (key + 8)])[0]
            if head[5]:
                yield from self.tree(child, key)
            else:
                yield own, child

    def members(self, messages: list[tuple[int, bytes]]) -> Iterator[tuple[str, int]]:
        """(name, address) of what is in a group."""
        for kind, body in messages:
            if kind == GROUP:
                tree, heap = struct.unpack("<QQ", body[:16])
                size, _, names = struct.unpack("<QQQ", self.get(heap, 32)[8:])
                letters = self.get(names, size)
                for _, node in self.tree(tree, 8):
                    head = self.get(node, 8)
                    for k in range(struct.unpack("<H", head[6:8])[0]):
                        name, address = struct.unpack("<QQ", self.get(node + 8 + 40 * k, 16))
                        yield letters[name : letters.index(b"\0", name)].decode(), address
            elif kind == LINK:
                flags, k = body[1], 2
                hard = not (flags & 8) or body[k] == 0
                k += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                width = 1 << (flags & 3)
                n = int.from_bytes(body[k : k + width], "little")
                if hard:
                    yield body[k + width : k + width + n].decode(), struct.unpack("<Q", body[k + width + n : k + width + n + 8])[0]
            elif kind == LINKS:
                at = 2 + 8 * (body[1] & 1)
                if struct.unpack("<Q", body[at : at + 8])[0] != NOWHERE:
                    raise ValueError("a group with its links in a heap isn't read")

    def data_sets(self) -> dict[str, list[tuple[int, bytes]]]:
        """The headers of all data sets by their path in the file."""
        out: dict[str, list[tuple[int, bytes]]] = {}
        work, seen = [("", self.root)], set()
        while work:
            path, address = work.pop()
            if address in seen and not path:
                continue
            messages = self.messages(address)
            if any(kind == LAYOUT for kind, _ in messages):
                out[path] = messages
            elif address not in seen:  # a group that is linked from within itself is one
                seen.add(address)
                work += [(f"{path}/{name}" if path else name, child) for name, child in self.members(messages)]
        return dict(sorted(out.items()))

    def stored(self, messages: list[tuple[int, bytes]], parts: bool = True) -> Stored:
        """A data set from its header; with the places of its chunks, if these are wanted."""
        found = dict(reversed(messages))
        body = found[SPACE]
        rank, at = body[1], 8 if body[0] == 1 else 4
        out = Stored(struct.unpack(f"<{rank}Q", body[at : at + 8 * rank]), number_kind(found[TYPE]))
        body = found[LAYOUT]
        if body[0] != 3:
            raise ValueError(f"a data set with a layout of version {body[0]} isn't read")
        if FILTERS in found:
            out.filters = list(filters(found[FILTERS]))
        if body[1] == 1:
            out.address = struct.unpack("<Q", body[2:10])[0]
        elif body[1] == 2:
            n = body[2]
            tree, *chunk = struct.unpack(f"<Q{n}I", body[3 : 11 + 4 * n])
            out.chunk = tuple(chunk[:-1])
            if parts:
                for key, address in self.tree(tree, 8 + 8 * n):
                    size, mask, *place = struct.unpack(f"<II{n}Q", key)
                    out.chunks.append((tuple(place[:-1]), address, size, mask))
        else:
            raise ValueError("a data set within its header isn't read")
        return out


def number_kind(body: bytes) -> np.dtype:
    """The kind of number of a data type."""
    what, big, size = body[0] & 15, body[1] & 1, struct.unpack("<I", body[4:8])[0]
    if what > 1:
        raise ValueError(f"a data set of class {what} isn't of numbers")
    return np.dtype(f"{'>' if big else '<'}{'f' if what else 'i' if body[1] & 8 else 'u'}{size}")


def filters(body: bytes) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(number, values) of the filters of a data set, in the order of writing."""
    old, k = body[0] == 1, 8 if body[0] == 1 else 2
    for _ in range(body[1]):
        number = struct.unpack("<H", body[k : k + 2])[0]
        named = old or number >= 256
        name = struct.unpack("<H", body[k + 2 : k + 4])[0] if named else 0
        k += 4 if named else 2
        n = struct.unpack("<H", body[k + 2 : k + 4])[0]
        k += 4 + (name + 7) // 8 * 8 if old else 4 + name
        yield number, struct.unpack(f"<{n}I", body[k : k + 4 * n])
        k += 4 * (n + n % 2 if old else n)


def unfiltered(raw: bytes, data: Stored, mask: int) -> bytes:
    """A chunk's bytes as they were before its filters."""
    for k, (number, _) in reversed(list(enumerate(data.filters))):
        if mask >> k & 1:
            continue
        if number == GZIP:
            raw = zlib.decompress(raw)
        elif number == SHUFFLE:
            size = data.kind.itemsize
            n = len(raw) // size * size
            raw = np.frombuffer(raw[:n], np.uint8).reshape(size, -1).T.tobytes() + raw[n:]
        elif number == FLETCHER:
            raw = raw[:-4]
        else:
            raise ValueError(f"filter {number} isn't known")
    return raw


@dataclass
class Rows(InputPartition):
    file: str
    key: str
    data: Stored
    base: int
    first: int
    last: int


class Hdf5Source(DataSource):
    """Options: path; ``list`` for data sets without their numbers; ``key`` for a single one."""

    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self) -> str:
        if self.options.get("list", "false").lower() == "true":
            return "path string, key string, shape array<long>, kind string"
        return "path string, key string, row long, value array<double>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Hdf5Reader(self.options)


class Hdf5Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.key, self.listing = options["path"], options.get("key"), options.get("list", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        store, root = located(self.path)
        names = [root]
        if store.get_file_info(root).type == fs.FileType.Directory:
            names = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith((".h5", ".hdf5")))
        if self.listing:
            return [Rows(n, "", Stored((), np.dtype("<f8")), 0, 0, 0) for n in names] or [InputPartition(None)]
        out: list[InputPartition] = []
        for name in names:
            with store.open_input_file(name) as f:
                headers = Headers(f)
                for key, messages in headers.data_sets().items():
                    if self.key not in (None, key):
                        continue
                    data = headers.stored(messages)
                    if not data.shape:
                        raise ValueError(f"{name}: {key} has no rows")
                    step = data.chunk[0] if data.chunk else max(1, PART // max(1, data.row_bytes))
                    for k in range(0, data.shape[0], step):
                        own = [c for c in data.chunks if c[0][0] == k]
                        out.append(Rows(name, key, Stored(data.shape, data.kind, data.address, data.chunk, own, data.filters), headers.base, k, min(k + step, data.shape[0])))
        return out or [InputPartition(None)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Rows):
            return
        store = located(self.path)[0]
        with store.open_input_file(part.file) as f:
            if self.listing:
                headers = Headers(f)
                found = {k: headers.stored(m, parts=False) for k, m in headers.data_sets().items()}
                yield pa.RecordBatch.from_pydict({"path": [part.file] * len(found), "key": list(found), "shape": pa.array([list(d.shape) for d in found.values()], pa.list_(pa.int64())), "kind": pa.array([d.kind.str for d in found.values()], pa.string())})
                return
            rows = numbers(f, part).astype(np.float64).reshape(part.last - part.first, -1)
        for k in range(0, len(rows), 4096):
            own = rows[k : k + 4096]
            value = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32()), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(own)), pa.array([part.key] * len(own)), pa.array(np.arange(part.first + k, part.first + k + len(own))), value], names=["path", "key", "row", "value"])


def numbers(f, part: Rows) -> np.ndarray:
    """The rows of a partition. What was never written is 0."""
    data, n = part.data, part.last - part.first
    out = np.zeros((n, *data.shape[1:]), data.kind)
    if data.chunk is None:
        if data.address != NOWHERE:
            f.seek(part.base + data.address + part.first * data.row_bytes)
            raw = f.read(n * data.row_bytes)
            if len(raw) < n * data.row_bytes:
                raise ValueError(f"{part.file} ends before row {part.last} of {part.key}")
            out[:] = np.frombuffer(raw, data.kind).reshape(out.shape)
        return out
    for place, address, size, mask in data.chunks:
        f.seek(part.base + address)
        whole = np.frombuffer(unfiltered(f.read(size), data, mask), data.kind).reshape(data.chunk)
        room = tuple(slice(a, min(a + w, s)) for a, w, s in zip((0, *place[1:]), data.chunk, out.shape, strict=True))
        out[room] = whole[tuple(slice(0, r.stop - r.start) for r in room)]
    return out
