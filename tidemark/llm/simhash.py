"""Near-duplicates by SimHash, found by pigeonring filtering.

A fingerprint of 64 bits is cut into a ring of segments. If two fingerprints differ in
at most t bits, then from some segment of the ring on every chain of l consecutive
segments differs in at most l * t / m bits. Such chains prune the pairs that share a
key before their full Hamming distance is taken.

Documents of one fingerprint form a class, and only classes are compared. Keys are the
values of so many segments together as must be equal by the pigeonhole rule. A key that
many classes share is cut into blocks, and pairs of blocks are compared in tasks of
bounded size; a task returns ties that span what it found linked, not all links. So
neither large classes nor dense groups of near copies give quadratically many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, utf8, written
from tidemark.llm.components import connected_components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of a text: lower-case words (split at space and \\t\\n\\v\\f\\r), shingles
    of ``width`` words with repeats, XXH64. 0 for a text without words."""
    words = utf8(text).translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - width + 1)
    to = (ends[width - 1 :] if len(words) >= width else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    ones, half = np.zeros(64, np.int64), n / 2
    for at in range(0, n, 16384):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : min(n, at + 16384)].tolist(), to[at : at + 16384].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones > half, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit integers. Texts are read once, and
    nothing else of ``docs`` is."""

    def run(batches):
        for ids, texts in chunks(batches, "doc_id", "text"):
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Ring:
    """Segments of a fingerprint, the keys of pairs, and the chain test."""

    def __init__(self, distance: int, segments: int):
        if segments <= distance:
            raise ValueError("more segments than differing bits are needed")
        cuts = [64 * k // segments for k in range(segments + 1)]
        self.distance, self.m = distance, segments
        self.shifts, self.widths = cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        self.masks = [np.uint64(((1 << w) - 1) << s) for s, w in zip(self.shifts, self.widths, strict=True)]
        self.keys = list(combinations(range(segments), segments - distance))
        self.budgets = [(k + 1) * distance // segments for k in range(segments)]

    def key_columns(self, fp: str) -> list:
        """For each set of segments that may have to be equal, its number and values as
        one 64-bit key."""
        out = []
        for k, sets in enumerate(self.keys):
            key = F.lit(k).cast("long")
            for i in sets:
                part = F.shiftrightunsigned(F.col(fp), self.shifts[i]).bitwiseAND(F.lit((1 << self.widths[i]) - 1).cast("long"))
                key = F.shiftleft(key, self.widths[i]).bitwiseOR(part)
            out.append(key)
        return out

    def linked(self, x: np.ndarray) -> np.ndarray:
        """Which of these XORs are of linked pairs: some chain all around the ring stays
        within its budgets, and then the distance does."""
        flat = x.ravel()
        d = [np.bitwise_count(flat & m) for m in self.masks]
        ok = np.zeros(flat.shape, bool)
        for start in range(self.m):
            alive = np.flatnonzero((d[start] <= self.budgets[0]) & ~ok)
            total = d[start][alive]
            for k in range(1, self.m):
                if not len(alive):
                    break
                total = total + d[(start + k) % self.m][alive]
                go = total <= self.budgets[k]
                alive, total = alive[go], total[go]
            ok[alive] = True
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(flat[at]) <= self.distance
        return ok.reshape(x.shape)


def _dense(ring: Ring, fp: np.ndarray) -> np.ndarray:
    """For each fingerprint of a group the first place in it of what it is tied to."""
    n, label = len(fp), np.arange(len(fp))
    step = max(1, (1 << 19) // n)
    while True:
        before = label.copy()
        for at in range(0, n, step):
            link = ring.linked(fp[at : at + step, None] ^ fp[None, :])
            least = np.where(link, label[None, :], n).min(axis=1)
            label[at : at + step] = np.minimum(label[at : at + step], least)
            # What a row is linked to takes the row's label at once.
            np.minimum.at(label, np.nonzero(link)[1], np.repeat(label[at : at + step], link.sum(axis=1)))
        label = label[label]
        if (label == before).all():
            return label


def _ties(ring: Ring, key: np.ndarray, fp: np.ndarray, rep: np.ndarray, small: int = 48) -> np.ndarray:
    """Pairs of rep that tie what is linked within groups of equal, adjacent keys."""
    edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
    sizes = np.diff(edges)
    out = []
    group = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= small))
    for d in range(1, small):  # all pairs of the small groups, by their distance in the table
        at = at[at + d < len(group)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        hit = at[ring.linked(fp[at] ^ fp[at + d])]
        out.append(np.stack([rep[hit], rep[hit + d]], axis=1))
    for g in np.flatnonzero(sizes > small):
        s = slice(edges[g], edges[g + 1])
        own = rep[s]
        out.append(np.stack([own, own[_dense(ring, fp[s])]], axis=1))
    pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _sorted_runs(batches: Iterator[pa.RecordBatch], names: list[str], rows: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """Arrays of a sorted stream, cut only where the first three columns change."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        held.append([b.column(b.schema.get_field_index(n)).to_numpy() for n in names])
        if sum(len(h[0]) for h in held) < rows:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        differs = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        cut = differs[-1] + 1 if len(differs) else 0
        held = [[c[cut:] for c in cols]]
        if cut:
            yield [c[:cut] for c in cols]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def near_links(classes: DataFrame, distance: int = 4, segments: int = 6, block: int = 8192) -> DataFrame:
    """(a, b) ties between the ids of classes (fp, rep): two classes are tied, directly
    or through others, if and only if a chain of fingerprints leads from one to the
    other in steps of at most ``distance`` bits. Fingerprints are given once each; no classes,
    or a single one, have no ties."""
    ring = Ring(distance, segments)
    rows = classes.select("fp", "rep", F.explode(F.array(*ring.key_columns("fp"))).alias("key"))
    crowded = rows.groupBy("key").count().where(F.col("count") > block)
    crowded = crowded.select("key", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    # A crowded key's rows go to one block of it, and each pair of blocks is a group.
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    d = rows.join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    d = d.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp", "rep")
    d = d.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches):
        for key, x, y, fp, rep in _sorted_runs(batches, ["key", "x", "y", "fp", "rep"]):
            pairs = _ties(ring, np.stack([key, x, y], axis=1), fp.view(np.uint64), rep)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return d.mapInArrow(run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``: the fingerprint as 16
    lower-case hex digits, and the smallest doc_id that links of at most ``distance``
    bits lead to.

    A null or empty text has the fingerprint zero and is linked like any other. Rows
    that repeat an id are documents of the same name: they share its component if their
    fingerprints are linked. Ids are 64-bit integers; a row without id gets a
    fingerprint, and a component only through others. Further columns aren't read. An
    empty table gives an empty one.
    """
    fps = written(with_fingerprints(docs, text, doc_id, width), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("rep is not null"), "classes")
    parts = connected_components(near_links(classes, distance))
    of = classes.join(parts, classes.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "rep", "n")
    # A document that is alone is its own component; the others of a fingerprint, of which
    # there may be very many, are dealt to parts of it before they are joined.
    of = of.where("n > 1 or component_id <> rep").drop("rep", "n")
    rows = fps.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(256)).cast("int"))
    near = rows.select("fp", "_s").distinct().join(of, "fp")
    d = rows.join(near, ["fp", "_s"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
