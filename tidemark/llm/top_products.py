"""Exact search for the largest inner products, by MaxScore.

A query's terms are its components; the postings of a term are the vectors whose
component has the query's sign there, so that each adds to the score. A term's bound is
the most that it can add within a shard. Terms whose bounds together stay under the
score to beat are non-essential: a vector that is in no posting of the others can't be
among the best. The postings of essential terms are traversed and summed up; the
vectors that they lead to are probed for what is left, from the largest bound on, as
long as they stay competitive.

A shard is a block of vectors in a task. It reads the queries block by block from the
shared folder: neither the queries nor the vectors are ever held whole, and no pairs are
made but those that are competitive. The score to beat starts from a query's scores with a
bounded sample of vectors, each a vector that counts. The best of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, spread, written
from tidemark.llm.vectors import blocks, exact, whole

NUMBERS = 1 << 20  # numbers of vectors in a shard
QUERIES = 1 << 18  # numbers of queries that are read together
PROBED = 8  # terms that are probed together
LEAST = -(1 << 63)  # no score to beat


class Shard:
    """Postings of a block of vectors, by component and sign."""

    def __init__(self, v: np.ndarray):
        self.v, self.largest = v, int(np.abs(v).max(initial=0))
        # Of each sign, the rows and sizes of the components that have it.
        self.postings = []
        for side in (v, -v):
            own = [np.flatnonzero(side[:, d] > 0) for d in range(v.shape[1])]
            self.postings.append([(rows, side[rows, d]) for d, rows in enumerate(own)])
        self.most = np.maximum(np.stack([v.max(axis=0, initial=0), (-v).max(axis=0, initial=0)]), 0)
        self.kinds: dict[type, tuple[np.ndarray, list]] = {}

    def of(self, kind: type) -> tuple[np.ndarray, list]:
        """Vectors by component, and postings, in a kind of number."""
        if kind not in self.kinds:
            self.kinds[kind] = np.ascontiguousarray(self.v.T.astype(kind)), [[(rows, w.astype(kind)) for rows, w in own] for own in self.postings]
        return self.kinds[kind]

    def competitive(self, q: np.ndarray, beat: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all vectors whose inner product with q is at least ``beat``."""
        d = min(len(q), self.v.shape[1])
        q = q[:d]
        kind = exact(d * self.largest * int(np.abs(q).max(initial=0)))
        columns, postings = self.of(kind)
        used = np.flatnonzero(q)
        side = (q[used] < 0).astype(np.int64)
        bound = np.abs(q[used]) * self.most[side, used]
        order = np.argsort(-bound, kind="stable")  # from the largest bound on
        used, side, bound = used[order], side[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)  # what terms from each on can add
        if rest[0] < beat:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        essential = int(np.count_nonzero(rest >= beat)) if beat > 0 else 0
        size = np.abs(q[used]).astype(kind)
        if essential:
            most = np.zeros(len(self.v), kind)
            for t, s, w in zip(used[:essential].tolist(), side.tolist(), size, strict=False):
                rows, own = postings[s][t]
                most[rows] += own * w
            rows = np.flatnonzero(most + kind(rest[min(essential, len(used))]) >= beat)
        else:
            rows = np.arange(len(self.v))  # vectors without a term may be among the best, too
        score, signed = np.zeros(len(rows), kind), q[used].astype(kind)
        at = 0
        while at < len(used) and len(rows):
            to = max(essential, PROBED) if at == 0 else at + PROBED
            for t, w in zip(used[at:to].tolist(), signed[at:to], strict=True):
                score += columns[t][rows] * w
            at = min(to, len(used))
            stay = score + kind(rest[at]) >= beat
            rows, score = rows[stay], score[stay]
        return rows, score.astype(np.int64)


def best(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, of equals the smaller ids."""
    if len(score) > 4 * k:  # all that reach the k-th score
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((rows[some], ids[some], -score[some]))[:k]]
    return np.lexsort((rows, ids, -score))[:k]


def top_products(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = 5, scale: int = 256, every: int = 50, sample: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every`` the k
    largest inner products with all other rows (all, if there are fewer), from rank 1;
    of equal scores the smaller vec_id comes first, and rows without id last.

    Components are taken as integers floor(scale * x), held within 2^26 on both sides;
    scores are exact as long as they fit into 64 bits. Vectors that are null, or hold null
    or a number that isn't finite, take no part. Of vectors of different lengths the
    components that both have are multiplied: missing ones count as 0, and an empty vector's
    scores are 0. Rows that repeat an id are rows like others: each is a query of its own,
    and finds the others. Rows without id are no queries. An empty table gives an empty
    one; further columns aren't read. ``sample`` bounds the vectors whose scores set the
    first scores to beat; results don't depend on it.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), whole(rows, vector, scale).alias("v")).where("v is not null")
    # Each row has a key of its own, that is written once: a row isn't its own partner.
    kept = written(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "whole-vectors")
    drawn = kept.orderBy(F.xxhash64("row"), "row").limit(sample).select("row", "v")
    path = new_path(spark, "sample")
    drawn.write.parquet(path)

    def seeded(batches):
        store, root = fs.FileSystem.from_uri(path)
        own = dataset.dataset(root, filesystem=store, format="parquet").to_table(columns=["row", "v"]).to_batches()
        parts = [(r.to_numpy(), Shard(v)) for (r,), v in blocks(iter(own), 1, NUMBERS)]
        for (row, ids), v in blocks(batches, 2, QUERIES):
            beat = []
            for r, q in zip(row.to_pylist(), v, strict=True):
                found = np.empty(0, np.int64)
                for names, shard in parts:
                    at, score = shard.competitive(q, int(found.min()) if len(found) == k else LEAST)
                    found = np.sort(np.concatenate([found, score[names[at] != r]]))[-k:]
                beat.append(int(found[0]) if len(found) == k else LEAST)
            n = np.full(len(v), v.shape[1])
            own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(v.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([row, ids, pa.array(beat, pa.int64()), own], names=["row", "vec_id", "beat", "v"])

    asked = spread(kept.where(F.col("vec_id") % every == 0))
    queries = new_path(spark, "queries")
    asked.mapInArrow(seeded, "row long, vec_id long, beat long, v array<int>").write.parquet(queries)

    def run(batches):
        store, root = fs.FileSystem.from_uri(queries)
        own = dataset.dataset(root, filesystem=store, format="parquet")
        for (row, ids), v in blocks(batches, 2, NUMBERS):
            shard, row = Shard(v), row.to_numpy()
            order = np.where(ids.is_null().to_numpy(zero_copy_only=False), (1 << 63) - 1, ids.fill_null(0).to_numpy())
            for (asker, asker_id, beat), qs in blocks(own.to_batches(columns=["row", "vec_id", "beat", "v"], batch_size=4096), 3, QUERIES):
                out: list[tuple[np.ndarray, np.ndarray]] = []
                for name, at_least, q in zip(asker.to_pylist(), beat.to_pylist(), qs, strict=True):
                    at, score = shard.competitive(q, at_least)
                    other = row[at] != name
                    at, score = at[other], score[other]
                    top = best(row[at], score, order[at], k)
                    out.append((at[top], score[top]))
                at, n = np.concatenate([a for a, _ in out]), np.array([len(a) for a, _ in out])
                if not len(at):
                    continue
                of = pa.array(np.repeat(np.arange(len(n)), n))
                cols = [asker.take(of), asker_id.take(of), ids.take(pa.array(at)), pa.array(np.concatenate([s for _, s in out])), pa.array(row[at])]
                yield pa.RecordBatch.from_arrays(cols, names=["asker", "query_id", "vec_id", "score", "row"])

    found = spread(kept).mapInArrow(run, "asker long, query_id long, vec_id long, score long, row long")
    order = Window.partitionBy("asker").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
