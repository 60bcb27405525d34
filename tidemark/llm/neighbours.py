"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become hashed vectors of words and word shapes, weighted by inverse document
frequency over all documents. The leading singular vectors of a bounded sample of
labelled documents span the latent space. The sample's vectors are broadcast; every
document is compared with all of them, in blocks of exact cosine products, and the
labels of its nearest are weighted by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, written
from tidemark.llm.labelled import class_counts, fold, sampled, texts_of, training_labels

BLOCK = 256  # rows whose products are taken together
ENTRY = 170  # bytes, about, that a remembered word takes beside two for each letter


def shape(word: str) -> str:
    """The signs of a word: X for letters in upper case, x for other letters, 0 for
    digits, other characters as they are, and runs of one sign cut to two."""
    body = word.rstrip(".,;:!?")
    if body.isalpha() and len(word) - len(body) < 2:  # most words, without patterns
        return ("X" if len(body) > 1 and body.isupper() else "x") + word[len(body) :]
    body = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "x", word)
    body = re.sub(r"\d+", "0", body)
    return re.sub(r"(.)\1+", r"\1\1", body)


class Features:
    """Sparse vectors of texts: ``dims`` hashed places for words, and as many for shapes
    and adjacent repeats."""

    def __init__(self, dims: int, most: int = 96 << 20, longest: int = 64):
        self.dims, self.most, self.longest, self.held = dims, most, longest, 0
        self.places: dict[str, int] = {}  # of each word both places, in one number

    def place(self, word: str) -> int:
        at = zlib.crc32(word.lower().strip(".,;:!?").encode("utf-8", "surrogatepass")) % self.dims
        return at << 32 | self.dims + zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % (self.dims // 8)

    @property
    def size(self) -> int:
        return self.dims + self.dims // 8 + 1

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, counts) of a text, in order of place."""
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        unique = Counter(words)
        known = self.places
        if self.held > self.most:
            known.clear()
            self.held = 0
        own = list(map(known.get, unique))
        for k, w in [(k, w) for k, (w, at) in enumerate(zip(unique, own, strict=True)) if at is None]:
            own[k] = self.place(w)
            if len(w) <= self.longest:
                known[w] = own[k]
                self.held += ENTRY + 2 * len(w)
        n = np.fromiter(unique.values(), np.float64, len(unique))
        both = np.array(own, np.int64)
        repeats = sum(map(eq, words, words[1:]))
        places = np.concatenate([both >> 32, both & 0xFFFFFFFF, [self.size - 1]])
        total = np.bincount(places, weights=np.concatenate([n, n, [repeats]]), minlength=self.size)
        found = np.flatnonzero(total)
        return found, total[found]

    def vector(self, text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, weights): the words' part and the shapes' part have length 1 each."""
        at, n = self.counts(text)
        v = np.where(at < self.dims, np.log1p(n) * idf[at], n * idf[at])
        for own in (at < self.dims, at >= self.dims):
            v[own] /= np.sqrt((v[own] ** 2).sum()) or 1.0
        return at, v


@lru_cache(maxsize=2)
def features(dims: int) -> Features:
    """Those of this worker process: tasks that follow each other share its words."""
    return Features(dims)


def inverse_frequencies(docs: DataFrame, dims: int) -> np.ndarray:
    """log((1 + N) / (1 + n)) + 0.1 per place, over all documents: each task adds up its
    own, and what reaches the driver is one number a place."""

    def run(batches):
        f = features(dims)
        n = np.zeros(f.size + 1, np.int64)
        for (texts,) in chunks(batches, "text"):
            for t in texts:
                n[f.counts(t)[0]] += 1
            n[-1] += len(texts)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], names=["place", "n"])

    total = np.zeros(Features(dims).size + 1)
    for r in docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        total[r.place] = r.n
    return np.log((1 + total[-1]) / (1 + total[:-1])) + 0.1


def sparse(sample: DataFrame, dims: int, idf: np.ndarray) -> DataFrame:
    """(doc_id, y, places, weights) of a labelled sample (doc_id, text, y): what the driver
    gets of it is at most one number a place and text, however long the texts are."""

    def run(batches):
        f = features(dims)
        for ids, ys, texts in chunks(batches, "doc_id", "y", "text", rows=64):
            found = [f.vector(t, idf) for t in texts]
            cols = [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([v for _, v in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "y", "places", "weights"])

    own = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text")
    return own.mapInArrow(run, "doc_id long, y int, places array<long>, weights array<double>")


def latent_basis(rows: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of a matrix, one a column, from the products of its
    rows, of which there are few. Directions of no length are left out."""
    squares, u = np.linalg.eigh(rows @ rows.T)
    keep = np.flatnonzero(squares > squares[-1] * 1e-12)[::-1][:rank]
    return rows.T @ (u[:, keep] / np.sqrt(squares[keep]))


def vote(cosines: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float, k: int, power: float) -> np.ndarray:
    """Share of label 1 among the k nearest of each row, weighted by similarity and by
    class; the prior has the weight of one weak neighbour. Neighbours that tie for the
    last places share these. Each row's sums are over its own neighbours, in their order."""
    n, k = len(cosines), min(k, cosines.shape[1])
    last = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, cosines.shape[1] - k]
    row, near = np.nonzero(cosines >= last[:, None])
    c = cosines[row, near]
    tied = c == last[row]
    ties = np.bincount(row[tied], minlength=n)
    share = (k - np.bincount(row[~tied], minlength=n)) / ties
    w = np.maximum(c, 0.0) ** power * weight[near] * np.where(tied, share[row], 1.0)
    return (np.bincount(row, weights=w * y[near], minlength=n) + 1e-3 * prior) / (np.bincount(row, weights=w, minlength=n) + 1e-3)


def cosines(rows: np.ndarray, latent: np.ndarray, places: int = 6) -> np.ndarray:
    """Cosines of rows with vectors of length 1, rounded so that the last digits, which
    depend on what is multiplied together, decide nothing. Products are of one size."""
    block = np.zeros((BLOCK, rows.shape[1]))
    block[: len(rows)] = rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9)
    return np.round(block @ latent.T, places)[: len(rows)]


def quality_scores(
    docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, threshold: float = 0.7,
    per_class: int = 1000, dims: int = 8192, rank: int = 64, k: int = 25, power: float = 4.0,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Learnt from are labels outside the fold ``held_out`` only, at most ``per_class`` of
    each class: that bounds what is broadcast, to 2 * per_class * rank numbers. Document
    frequencies are of all documents. A text alone decides its score: null and empty
    texts get the share of label 1 among the training labels, repeated texts equal
    scores. Without labels of both classes all scores are that share (0.5 if there are
    none). Rows without id are in no fold: held_out is null. An empty table gives an
    empty one; further columns aren't read.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    train = training_labels(labels, label, folds, held_out)
    n0, n1 = class_counts(train)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.5
    sample = written(texts_of(docs, sampled(train, per_class)), "labelled") if n0 and n1 else None
    model = None
    if sample is not None and sample.select("y").distinct().count() == 2:
        idf = inverse_frequencies(docs, dims)
        rows = sparse(sample, dims, idf).orderBy("doc_id").collect()
        y = np.array([r.y for r in rows], np.float64)
        matrix = np.zeros((len(rows), Features(dims).size))
        for i, r in enumerate(rows):
            matrix[i, r.places] = r.weights
        basis = latent_basis(matrix, rank)
        latent = matrix @ basis
        latent /= np.linalg.norm(latent, axis=1, keepdims=True) + 1e-9
        weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum())) * len(y)
        model = (idf, basis, latent, y, weight)
    shared = sc.broadcast(model)

    def run(batches):
        m, f = shared.value, features(dims)
        for ids, texts in chunks(batches, "doc_id", "text", rows=BLOCK):
            scores = np.full(len(ids), prior)
            if m:
                idf, basis, latent, y, weight = m
                block = np.zeros((len(ids), basis.shape[1]))
                for i, t in enumerate(texts):
                    at, v = f.vector(t, idf)
                    block[i] = v @ basis[at]
                scores = np.clip(vote(cosines(block, latent), y, weight, prior, k, power), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
