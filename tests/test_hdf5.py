"""HDF5 files built byte by byte, after the public format, and read back."""

from __future__ import annotations

import struct
import zlib
from itertools import product

import numpy as np
import pytest

from tidemark.sources import hdf5

NOWHERE = (1 << 64) - 1


class Builder:
    """Writes a file: superblock of version 0 or 2, groups as symbol tables or links."""

    def __init__(self, version=0):
        self.version, self.raw = version, bytearray(96 if version == 0 else 48)

    def put(self, data: bytes) -> int:
        self.raw += bytes(-len(self.raw) % 8)
        at = len(self.raw)
        self.raw += data
        return at

    def header(self, messages) -> int:
        if self.version:
            body = b"".join(struct.pack("<BHB", k, len(b), 0) + b for k, b in messages)
            # The second half in a continuation, between its mark and a checksum.
            cut = len(struct.pack("<BHB", 0, 0, 0)) + len(messages[0][1])
            more = self.put(b"OCHK" + body[cut:] + bytes(4))
            first = body[:cut] + struct.pack("<BHBQQ", 0x10, 16, 0, more, len(body) - cut + 8)
            return self.put(b"OHDR" + bytes([2, 1]) + struct.pack("<H", len(first)) + first + bytes(4))
        pad = lambda b: b + bytes(-len(b) % 8)
        body = b"".join(struct.pack("<HHB3x", k, len(pad(b)), 0) + pad(b) for k, b in messages)
        cut = 8 + len(pad(messages[0][1]))
        more = self.put(body[cut:])
        first = body[:cut] + struct.pack("<HHB3xQQ", 0x10, 16, 0, more, len(body) - cut)
        return self.put(struct.pack("<BxHIII", 1, len(messages) + 1, 1, len(first), 0) + first)

    def group(self, members: dict[str, int]) -> int:
        if self.version:
            links = [(0x06, bytes([1, 0, len(n.encode())]) + n.encode() + struct.pack("<Q", a)) for n, a in members.items()]
            return self.header([(0x02, struct.pack("<BBQQ", 0, 0, NOWHERE, NOWHERE)), *links])
        names, letters = {}, bytearray(8)
        for n in members:
            names[n] = len(letters)
            letters += n.encode() + b"\0"
            letters += bytes(-len(letters) % 8)
        heap = self.put(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(letters), NOWHERE, self.put(bytes(letters))))
        nodes, every = [], sorted(members)
        for k in range(0, len(every), 3):  # few to a node, so that the tree has more than one
            entries = b"".join(struct.pack("<QQII16x", names[n], members[n], 0, 0) for n in every[k : k + 3])
            nodes.append(self.put(b"SNOD" + struct.pack("<BxH", 1, len(every[k : k + 3])) + entries))
        tree = self.tree(0, [(struct.pack("<Q", 0), n) for n in nodes], struct.pack("<Q", 0))
        return self.header([(0x11, struct.pack("<QQ", tree, heap))])

    def tree(self, kind: int, leaves: list[tuple[bytes, int]], last: bytes) -> int:
        level = 0
        while True:
            groups = [leaves[k : k + 4] for k in range(0, len(leaves), 4)] or [[]]
            leaves = [(g[0][0] if g else last, self.put(b"TREE" + struct.pack("<BBHQQ", kind, level, len(g), NOWHERE, NOWHERE) + b"".join(k + struct.pack("<Q", a) for k, a in g) + last)) for g in groups]
            level += 1
            if len(leaves) == 1:
                return leaves[0][1]

    def data(self, x: np.ndarray, chunk=None, gzip=False, shuffle=False, check=False, leave_out=(), plain=()) -> int:
        kind = x.dtype
        big = kind.byteorder == ">"
        what = 0x11 if kind.kind == "f" else 0x10
        type_ = bytes([what, big | (8 if kind.kind == "i" else 0), 0, 0]) + struct.pack("<I", kind.itemsize) + bytes(12)
        space = struct.pack(f"<BBB5x{x.ndim}Q", 1, x.ndim, 0, *x.shape) if not self.version else struct.pack(f"<BBBB{x.ndim}Q", 2, x.ndim, 0, 1, *x.shape)
        messages = [(0x01, space), (0x03, type_)]
        if chunk is None:
            place = self.put(x.tobytes()) if x.size else NOWHERE
            return self.header([*messages, (0x08, struct.pack("<BBQQ", 3, 1, place, x.nbytes))])
        leaves = []
        for n, at in enumerate(product(*[range(0, s, c) for s, c in zip(x.shape, chunk)])):
            if n in leave_out:
                continue
            whole = np.zeros(chunk, kind)
            part = x[tuple(slice(a, a + c) for a, c in zip(at, chunk))]
            whole[tuple(slice(0, s) for s in part.shape)] = part
            raw, mask = whole.tobytes(), 0
            if shuffle:
                raw = np.frombuffer(raw, np.uint8).reshape(-1, kind.itemsize).T.tobytes()
            if gzip and n in plain:
                mask = 1 << int(shuffle)
            elif gzip:
                raw = zlib.compress(raw)
            raw += bytes(4) * check
            leaves.append((struct.pack(f"<II{len(at) + 1}Q", len(raw), mask, *at, 0), self.put(raw)))
        tree = self.tree(1, leaves, struct.pack(f"<II{x.ndim + 1}Q", 0, 0, *x.shape, 0)) if leaves else NOWHERE
        used = [(2, [kind.itemsize])] * shuffle + [(1, [4])] * gzip + [(3, [])] * check
        if self.version:
            pipe = bytes([2, len(used)]) + b"".join(struct.pack(f"<HHH{len(v)}I", k, 0, len(v), *v) for k, v in used)
        else:
            pipe = bytes([1, len(used)]) + bytes(6) + b"".join(struct.pack(f"<HHHH8s{len(v)}I", k, 8, 0, len(v), b"name", *v) + bytes(4 * (len(v) % 2)) for k, v in used)
        layout = struct.pack(f"<BBBQ{x.ndim + 1}I", 3, 2, x.ndim + 1, tree, *chunk, kind.itemsize)
        return self.header([*messages, *[(0x0B, pipe)] * bool(used), (0x08, layout)])

    def close(self, path, root: int) -> None:
        head = b"\x89HDF\r\n\x1a\n"
        if self.version:
            head += bytes([2, 8, 8, 0]) + struct.pack("<QQQQI", 0, NOWHERE, len(self.raw), root, 0)
        else:
            head += bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(self.raw), NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
        self.raw[: len(head)] = head
        path.write_bytes(bytes(self.raw))


@pytest.fixture
def source(spark):
    spark.dataSource.register(hdf5.Hdf5Source)
    return lambda: spark.read.format("hdf5")


@pytest.mark.parametrize("version", [0, 2])
def test_data_sets_of_all_kinds(source, tmp_path, version):
    rng = np.random.default_rng(4)
    b, want = Builder(version), {}
    x = rng.standard_normal((50, 7))
    sets = {
        "one piece": (x, {}), "big": (x.astype(">f4"), {}), "halves": (x.astype("<f2"), {}), "line": (np.arange(11, dtype="<i8") - 5, {}), "bytes": (np.arange(12, dtype="u1").reshape(6, 2), {}),
        "chunks": (x, {"chunk": (8, 3)}), "packed": (x, {"chunk": (16, 7), "gzip": True}), "shuffled": (x.astype(">i2"), {"chunk": (8, 4), "gzip": True, "shuffle": True, "check": True}),
        "deep": (rng.standard_normal((9, 4, 5)), {"chunk": (2, 4, 2), "gzip": True}), "some plain": (x, {"chunk": (10, 7), "gzip": True, "shuffle": True, "plain": (1, 3)}),
    }
    members = {}
    for name, (data, how) in sets.items():
        members[name] = b.data(data, **how)
        want[f"in/{name}"] = data
    holes = x.copy()
    holes[8:16] = 0
    members["holes"] = b.data(x, chunk=(8, 7), leave_out=(1,))
    want["in/holes"] = holes
    empty = b.data(np.zeros((0, 3)))
    want["none"] = np.zeros((0, 3))
    b.close(tmp_path / "a.h5", b.group({"in": b.group(members), "none": empty, "bare": b.group({})}))
    got: dict[str, dict[int, list[float]]] = {}
    for r in source().load(str(tmp_path)).collect():
        assert r.row not in got.setdefault(r.key, {})
        got[r.key][r.row] = r.value
    assert set(got) == {k for k, v in want.items() if len(v)}
    for key, rows in got.items():
        assert np.array_equal(np.array([rows[k] for k in range(len(want[key]))]), want[key].astype(float).reshape(len(rows), -1)), key
    listed = {r.key: (tuple(r.shape), r.kind) for r in source().option("list", True).load(str(tmp_path)).collect()}
    assert listed == {k: (v.shape, v.dtype.str) for k, v in want.items()}
    one = source().option("key", "in/packed").load(f"{tmp_path}/a.h5")
    assert one.count() == 50 and one.rdd.getNumPartitions() == 4  # one for each row of chunks


def test_what_isnt_needed_isnt_read(source, tmp_path):
    """A file that was cut: its headers tell the keys, and whole chunks are read."""
    b = Builder()
    x = np.arange(400.0).reshape(100, 4)
    chunked = b.data(x[:20], chunk=(10, 4), gzip=True)
    root = b.group({"early": chunked, "late": 0})
    late = b.data(x)
    # The root, written again behind, with the address of the late one.
    root = b.group({"early": chunked, "late": late})
    b.close(tmp_path / "a.h5", root)
    whole = (tmp_path / "a.h5").read_bytes()
    at = whole.index(x.tobytes()) + 50 * 32
    (tmp_path / "a.h5").write_bytes(whole[:at] + bytes(50 * 32) + whole[at + 50 * 32 :])
    got = source().option("key", "late").load(str(tmp_path)).orderBy("row").collect()
    assert [r.value for r in got[:50]] == x[:50].tolist() and got[99].value == [0.0] * 4
    assert source().option("key", "early").load(str(tmp_path)).count() == 20
    assert source().option("key", "not there").load(str(tmp_path)).count() == 0


def test_what_isnt_known_raises(source, tmp_path):
    (tmp_path / "a.h5").write_bytes(b"something else" * 9)
    with pytest.raises(Exception, match="no HDF5 file"):
        source().load(str(tmp_path)).count()
    b = Builder()
    text = b.header([(0x01, struct.pack("<BBB5xQ", 1, 1, 0, 3)), (0x03, bytes([0x13, 0, 0, 0]) + struct.pack("<I", 4)), (0x08, struct.pack("<BBQQ", 3, 1, NOWHERE, 0))])
    b.close(tmp_path / "a.h5", b.group({"x": text}))
    with pytest.raises(Exception, match="class 3 isn't of numbers"):
        source().load(str(tmp_path)).count()
    (tmp_path / "a.h5").unlink()
    assert source().load(str(tmp_path)).count() == 0
