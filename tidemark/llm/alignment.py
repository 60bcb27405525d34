"""How two tokenizers cut the same texts: groups of tokens between shared cuts, and links.

Both encode a text to tokens of the same bytes. A byte offset where a token of each ends
is a shared cut. Cuts are found by divide and conquer: in an interval, the shared end
that is nearest to the middle is located by bisecting the other side's ends, and both
halves are treated alike; an interval without one is a leaf group. All intervals of one
depth are probed together, and no end is probed twice.

Neither tokenizer has a token that goes past the start of a space or line break, so
texts fall apart into words, which recur: a word's groups and links are found once and
kept, up to a number of bytes. Texts for which that doesn't hold are aligned as a whole.

A pair of linked ids is counted once for each document, over all documents. Of each
document its distinct pairs are kept as numbers; they are counted by tasks first, and
looked up where the counts are, or joined with them if there are too many.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, slices, written
from tidemark.llm.token_files import Encoder

SPACE = "▁"
ENTRY = 330  # bytes, about, that a word takes beside its letters, groups and links


def shared_cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the increasing offsets ``a`` are in ``b``; the last ones of both are equal."""
    cut = np.zeros(len(a), bool)
    cut[-1:] = True
    lo, hi = np.array([0]), np.array([len(a) - 1])  # of each interval, the ends that weren't probed
    while True:
        some = lo < hi
        lo, hi = lo[some], hi[some]
        if not len(lo):
            return cut
        left = right = (lo + hi) // 2  # probed are those from left on, up to right
        open_ = np.arange(len(lo))
        while len(open_):
            for back in (False, True):
                at = left[open_] - 1 if back else right[open_]
                inside = at >= lo[open_] if back else at < hi[open_]
                on, at = open_[inside], at[inside]
                if back:
                    left[on] -= 1
                else:
                    if left is right:
                        right = right.copy()
                    right[on] += 1
                hit = b[np.searchsorted(b, a[at])] == a[at]
                cut[at[hit]] = True
                found = np.zeros(len(lo), bool)
                found[on[hit]] = True
                open_ = open_[~found[open_]]
            open_ = open_[(left[open_] > lo[open_]) | (right[open_] < hi[open_])]
        lo, hi = np.concatenate([lo, right]), np.concatenate([left, hi])


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in a, place in b) of tokens that share bytes; given are their ends."""
    first = np.searchsorted(b, np.concatenate([[0], a[:-1]]), side="right")
    last = np.searchsorted(b, a, side="left")
    n = last - first + 1
    of_a = np.repeat(np.arange(len(a)), n)
    return of_a, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[of_a]


class Aligner:
    """Groups and links of texts under a byte-level tokenizer (A, of the tokenizers library)
    and a SentencePiece model (B, which adds a space before a text)."""

    def __init__(self, path_a: str, path_b: str, most: int = 96 << 20, longest: int = 128):
        import sentencepiece

        self.a = Encoder(path_a)  # one of its own: its setting differs
        self.tokenizer = self.a.tokenizer
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.by_words = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in plain)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        vocabulary, letters = self.tokenizer.get_vocab(), _byte_letters()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.kind = np.dtype("<u4" if len(self.bytes_a) * len(pieces) <= 1 << 32 else "<u8")
        self.most, self.longest = most, longest
        # Tokens as they are written in groups: those of A with what stands after one of a group
        # and after its last, then those of B. B's comma is another sign until they are counted.
        names = [[str(i).encode() + after for i in range(n)] for n, ends in ((len(self.bytes_a), b",|"), (len(pieces), b"\t;")) for after in (ends[:1], ends[1:])]
        self.names = [x for own in names for x in own]
        self.groups: dict[str, bytes] = {}  # of each known word
        self.pairs: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.held = 0

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B of space + text; None where the bytes of one differ from it."""
        a = self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        raw = b" " + text.encode("utf-8", "surrogatepass")
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def parts(self, text: str, ends: np.ndarray) -> tuple[list[bytes], list[bytes]] | None:
        """The groups, and a number for each link, of each part of space + text that ends at
        one of these offsets, which are shared cuts. None where encoded() is."""
        ids = self.encoded(text)
        if ids is None:
            return None
        a, b = np.cumsum(self.size_a[ids[0]]), np.cumsum(self.size_b[ids[1]])
        cuts = a[shared_cuts(a, b)]
        size = len(self.bytes_a), len(self.size_b)
        last_a, last_b = (np.searchsorted(x, cuts) for x in (a, b))  # of each group
        sign = np.zeros(len(a) + len(b), np.int64)
        group_a, group_b = (np.searchsorted(cuts, x) for x in (a, b))
        place_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
        place_b = np.arange(len(b)) + last_a[group_b] + 1
        sign[place_a] = ids[0]
        sign[place_b] = ids[1] + 2 * size[0]
        sign[place_a[last_a]] += size[0]
        sign[place_b[last_b]] += size[1]
        written = list(map(self.names.__getitem__, sign.tolist()))
        of_a, of_b = overlaps(a, b)
        pairs = (ids[0][of_a] * size[1] + ids[1][of_b]).astype(self.kind).tobytes()
        upto = (np.searchsorted(a, ends, side="right") + np.searchsorted(b, ends, side="right")).tolist()
        link = (np.searchsorted(a[of_a], ends, side="right") * self.kind.itemsize).tolist()
        return [b"".join(written[i:j]) for i, j in zip([0, *upto], upto, strict=False)], [pairs[i:j] for i, j in zip([0, *link], link, strict=False)]

    def learn(self, words: list[str]) -> None:
        """Aligns new words, many at a time, behind a word that is cut off again."""
        for at in range(0, len(words), 8192):
            some = words[at : at + 8192]
            text = "".join(["a", *[w if w[0] == "\n" else " " + w for w in some]])
            size = [2, *[len(w.encode("utf-8", "surrogatepass")) + (w[0] != "\n") for w in some]]
            found = self.parts(text, np.cumsum(size))
            if found is None:
                raise ValueError("words that were to be aligned aren't encoded without loss")
            self.groups.update(zip(some, found[0][1:], strict=True))
            self.pairs.update(zip(some, found[1][1:], strict=True))
            self.held += self.size_of(some)

    def size_of(self, words: list[str]) -> int:
        """Bytes, about, that known words take."""
        return ENTRY * len(words) + sum(map(len, words)) + sum(map(len, map(self.groups.__getitem__, words))) + sum(map(len, map(self.pairs.__getitem__, words)))

    def align(self, texts: list[str | None]) -> list[tuple[bytes, bytes, int, int]]:
        """(groups, a number for each link, tokens of A, tokens of B) of each text."""
        if self.held > self.most:
            self.old, self.groups, self.pairs, self.held = (self.groups, self.pairs), {}, {}, 0
        split, missing = [], set()
        for t in texts:
            words = self.a.words(t) if t and self.by_words and SPACE not in t else None
            if words:
                words[0] = words[0][1:]  # less the line break; a space is before the text
                missing.update(words)
            split.append(words)
        missing.difference_update(self.groups)
        again = [w for w in missing if w in self.old[0]]
        for known, old in zip((self.groups, self.pairs), self.old, strict=True):
            known.update(zip(again, map(old.__getitem__, again), strict=True))
        self.held += self.size_of(again)
        self.learn([w for w in missing if w not in self.groups])
        out = []
        for t, words in zip(texts, split, strict=True):
            if words:
                groups, pairs = (b"".join(map(known.__getitem__, words)) for known in (self.groups, self.pairs))
            else:
                whole = self.parts(t, np.array([len(t.encode("utf-8", "surrogatepass")) + 1])) if t else None
                groups, pairs = (whole[0][0], whole[1][0]) if whole else (b"", b"")
            n = groups.count(b";")
            n_a, n_b = groups.count(b",") + n, groups.count(b"\t") + n
            out.append((groups[:-1].replace(b"\t", b","), pairs, n_a, n_b))
        long = [w for w in missing if len(w) > self.longest]
        self.held -= self.size_of(long)
        for w in long:
            del self.groups[w], self.pairs[w]
        return out


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones of Latin-1
    stand for themselves, the others for what follows 255, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The one of this worker process: tasks that follow each other share its words."""
    return Aligner(path_a, path_b)


def token_groups(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, then n_a, n_b, n_groups, n_links,
    groups (``a1,a2|b1;a3|b2,b3``: ids of A and B, group after group), pairs and times
    (binary: distinct linked pairs as a * vocabulary of B + b, little-endian unsigned
    32-bit integers, or 64-bit ones if vocabularies are that large, in order, and how
    often each is linked; a pair is repeated for each further 255 times).

    Texts that are null or empty, or that a tokenizer doesn't keep (a literal U+2581 comes
    back as a space), have no tokens: zeros, and empty values. Rows are independent:
    repeated ones, other columns and an empty table change nothing. Texts are taken
    whole; what a process holds grows with the longest text, not with the table. ``keep``
    may name any columns but the added ones.
    """
    kept = docs.select(*keep, F.col(text).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    names = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]

    def run(batches):
        m = aligner(path_a, path_b)
        for batch in batches:
            at = batch.num_columns - 1
            for part in slices(batch, at, 256, 1 << 20):
                found = m.align(part.column(at).to_pylist())
                pairs, times = zip(*[distinct(np.frombuffer(p, m.kind)) for _, p, _, _ in found], strict=True)
                numbers = [
                    [n for _, _, n, _ in found],
                    [n for _, _, _, n in found],
                    [g.count(b";") + 1 if g else 0 for g, _, _, _ in found],
                    [len(p) // m.kind.itemsize for _, p, _, _ in found],
                ]
                cols = [*[pa.array(x, pa.int64()) for x in numbers], pa.array([g.decode() for g, _, _, _ in found], pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *cols], names=[*part.schema.names[:at], *names])

    return kept.mapInArrow(run, ", ".join([*fields, "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"]))


def distinct(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers in order, each once for every 255 times that it is there, and the times."""
    own, n = np.unique(codes, return_counts=True)
    if len(n) and n.max() > 255:
        parts = -(-n // 255)
        own, left = np.repeat(own, parts), np.repeat(n, parts)
        place = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
        n = np.minimum(left - 255 * place, 255)
    return own.tobytes(), n.astype(np.uint8).tobytes()


def pair_counts(rows: DataFrame, of: tuple[int, str], most: int = 1 << 20) -> DataFrame:
    """(pair, n, best): in how many rows of ``pairs`` each pair is, and whether no other
    pair of its id of A is in more. Tasks count first, and hand on after ``most`` pairs."""
    size_b, kind = of

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(where, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for b in batches:
            for part in slices(b, 0, b.num_rows or 1, 1 << 22):
                each = [np.frombuffer(x, kind) for x in part.column(0).to_pylist()]
                # A pair that stands there more than once is repeated side by side.
                each = [x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x for x in each]
                held.append(np.unique(np.concatenate(each), return_counts=True))
                if sum(len(p) for p, _ in held) > most:
                    held = [merged()]
                    if len(held[0][0]) > most // 2:
                        yield _counted(*held.pop())
        if held:
            yield _counted(*merged())

    counts = rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("_a", F.floor(F.col("pair") / F.lit(size_b)))
    top = counts.groupBy("_a").agg(F.max("n").alias("_top"))
    return counts.join(top, "_a").select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def _counted(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])


@lru_cache(maxsize=1)
def _counts_at(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    store, root = fs.FileSystem.from_uri(path)
    t = dataset.dataset(root, filesystem=store, format="parquet").to_table()
    pair, n, best = (t.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return pair[order], n[order], best[order]


def linked_by(path_a: str, path_b: str) -> tuple[int, str]:
    """How pairs of these vocabularies are written: the size of B's, and the numbers' kind."""
    m = aligner(path_a, path_b)
    return len(m.size_b), m.kind.str


def counted_links(rows: DataFrame, of: tuple[int, str], most: int = 8_000_000) -> DataFrame:
    """``rows`` of token_groups(), which should be written, with n_best (links whose pair no
    other of its id of A surpasses in documents) and count_sum (of the documents of each
    link's pair) instead of pairs and times. ``of`` is what linked_by() returns.

    Up to ``most`` different pairs, workers read their counts from the shared folder, at
    17 bytes a pair; else the links of all rows are joined with them."""
    spark, path, kind = rows.sparkSession, new_path(rows.sparkSession, "pair-counts"), of[1]
    pair_counts(rows, of).write.parquet(path)
    counts = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in ("pairs", "times")]
    if counts.count() > most:
        return _joined(rows, counts, names, kind)
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names]

    def run(batches):
        pair, n, best = _counts_at(path)
        for b in batches:
            i, j = b.num_columns - 2, b.num_columns - 1
            for part in slices(b, i, 1024, 1 << 22):
                pairs, times = part.column(i).to_pylist(), part.column(j).to_pylist()
                at = np.searchsorted(pair, np.frombuffer(b"".join(pairs), kind).astype(np.int64))
                own = np.frombuffer(b"".join(times), np.uint8).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(list(map(len, times)))])
                sums = [np.concatenate([[0], np.cumsum(x)])[upto] for x in (own * best[at], own * n[at])] if len(at) else [np.zeros(len(upto), np.int64)] * 2
                yield pa.RecordBatch.from_arrays([*part.columns[:i], *[pa.array(np.diff(s)) for s in sums]], names=[*names, "n_best", "count_sum"])

    return rows.select(*names, "pairs", "times").mapInArrow(run, ", ".join([*fields, "n_best long, count_sum long"]))


def _joined(rows: DataFrame, counts: DataFrame, names: list[str], kind: str) -> DataFrame:
    """The same by a join. Its key is the pair: one that is in very many rows makes a large
    part of one side, which adaptive execution splits."""
    keyed = written(rows.withColumn("_row", F.monotonically_increasing_id()), "keyed")

    def run(batches):
        for b in batches:
            for part in slices(b, 1, 64, 1 << 20):
                pairs, times = part.column(1).to_pylist(), part.column(2).to_pylist()
                row = np.repeat(part.column(0).to_numpy(), list(map(len, times)))
                cols = [pa.array(row), pa.array(np.frombuffer(b"".join(pairs), kind).astype(np.int64)), pa.array(np.frombuffer(b"".join(times), np.uint8).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["_row", "pair", "_times"])

    links = keyed.select("_row", "pairs", "times").mapInArrow(run, "_row long, pair long, _times long")
    own = links.join(counts, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("n_best"), F.sum(F.col("_times") * F.col("n")).alias("count_sum"))
    d = keyed.select("_row", *names).join(own, "_row", "left")
    return d.select(*names, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")])
