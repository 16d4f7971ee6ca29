"""Exact top-k inner products by MaxScore over shards.

Vectors are integers; each dimension is a query term and its column of a shard is the term's
posting list. A term's bound is the most it can add to any row of the shard. Terms are ordered by
bound; those whose bounds together can't reach the k-th best score are non-essential. Rows are
scored on the essential terms first; the others are probed, strongest first, only for rows that
can still reach the k-th best score. The shards' best rows are merged.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_BYTES = 16 << 20  # of a shard's matrix
LEAST_ROWS = 2048  # of a shard, however many tasks could run at once
LARGEST = float(1 << 20)  # of a component in a shard's matrix; rows with larger ones are scored apart
LONG = 1 << 63


def quantised(vectors: DataFrame, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, q)`` with q = floor(scale * x) of every vector that takes part.

    As doubles, which hold the integers exactly. Left out are null ids and vectors and those that
    hold null or non-finite components. Repeated rows count once.
    """
    def floored(c):
        x = F.greatest(F.least(c.cast("double") * scale, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
        return F.when(F.abs(x) < 2.0 ** 53, F.floor(x).cast("double")).otherwise(x)

    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    return (vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull())
            .where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, floored).alias("q")).distinct())


class Shard:
    """Columns of one shard and, for each sign of a query's weight, the most a row can have. Rows with
    a component of ``LARGEST`` or more are kept apart."""

    def __init__(self, ids: np.ndarray, rows: list[np.ndarray], dims: int):
        small = np.array([float(np.abs(r).max(initial=0)) < LARGEST for r in rows], bool)
        self.ids = ids[small]
        self.x = np.zeros((dims, int(small.sum())), np.float64)
        for i, r in enumerate(r for r, ok in zip(rows, small) if ok):
            self.x[: len(r), i] = r
        self.large = [(int(v), [int(c) for c in r]) for v, r, ok in zip(ids, rows, small) if not ok]
        self.high = np.maximum(self.x.max(1, initial=0), 0)
        self.low = np.maximum(-self.x.min(1, initial=0), 0)
        self.exact = float(np.abs(self.x).max(initial=0)) * dims

    def top(self, own: int, q: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """Scores and ids of the k best rows but those of ``own``; ties go to the smaller id."""
        dims = min(len(q), len(self.x))
        w = np.zeros(len(self.x))
        w[:dims] = q[:dims]
        search = self.top_small if self.exact * float(np.abs(w).max(initial=0)) < 2.0 ** 53 else self.top_exact
        score, row = search(own, w, k)
        score, ids = list(score), self.ids[row].tolist()
        if self.large:
            mine = [int(c) for c in q]
            more = [(sum(a * b for a, b in zip(mine, r)), v) for v, r in self.large if v != own]
            both = sorted([*zip(score, ids), *more], key=lambda x: (-x[0], x[1]))[:k]
            score, ids = [s for s, _ in both], [v for _, v in both]
        return score, ids

    def top_small(self, own: int, w: np.ndarray, k: int) -> tuple[list[int], np.ndarray]:
        """MaxScore in doubles that hold every sum exactly."""
        rows = np.flatnonzero(self.ids != own)
        seed = rows[: max(256, 4 * k)]
        first = w @ self.x[:, seed]
        least = np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else -np.inf
        bound = np.where(w > 0, w * self.high, -w * self.low)
        order = np.argsort(bound, kind="stable")
        reach = np.cumsum(bound[order])
        spare = int(np.searchsorted(reach, least, "left"))  # bounds of order[:spare] add up to less than least
        essential, rest = order[spare:], order[:spare][::-1]
        score = np.zeros(len(self.ids))
        for d in essential:
            score += w[d] * self.x[d]
        score = score[rows]
        left = float(reach[spare - 1]) if spare else 0.0
        keep = score + left >= least
        rows, score = rows[keep], score[keep]
        for i in range(0, len(rest), 4):
            part = rest[i:i + 4]
            score = score + w[part] @ self.x[np.ix_(part, rows)]
            left -= float(bound[part].sum())
            keep = score + left >= least
            rows, score = rows[keep], score[keep]
            if len(rows) <= 2 * k:
                part = rest[i + 4:]
                score = score + w[part] @ self.x[np.ix_(part, rows)]
                break
        best = np.lexsort((self.ids[rows], -score))[:k]
        return score[best].astype(np.int64).tolist(), rows[best]

    def top_exact(self, own: int, w: np.ndarray, k: int) -> tuple[list[int], np.ndarray]:
        """The same in Python's integers, for weights too large for exact sums of doubles."""
        rows = np.flatnonzero(self.ids != own)
        used = np.flatnonzero(w)
        score = [0] * len(rows)
        for d, weight in zip(used.tolist(), map(int, w[used])):
            score = [s + weight * int(x) for s, x in zip(score, self.x[d, rows].tolist())]
        best = sorted(range(len(rows)), key=lambda i: (-score[i], self.ids[rows[i]]))[:k]
        return [score[i] for i in best], rows[best]


def order_of(score: int) -> str | None:
    """For a score beyond 64 bits a text that sorts like it among those of its sign."""
    if -LONG <= score < LONG:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):05d}{digits}"
    return f"{99999 - len(digits):05d}" + "".join(str(9 - int(c)) for c in digits)


def _lists(col: pa.Array) -> list[np.ndarray]:
    flat, at = col.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(np.array(col.value_lengths()))]
    return [flat[a:b] for a, b in zip(at, at[1:])]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, vec_id: str = "vec_id",
          vector: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of every query, exact.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another
    id. Score: inner product of the quantised vectors (a shorter one is filled up with zeros);
    ties go to the smaller id; rank is from 1. A score beyond 64 bits is ranked exactly and shown
    as null. Different vectors under one id are candidates of their own, and queries whose results
    are ranked together. Each shard gets all queries as a stream, so a task holds one shard (of 16
    MB, or ``shard_rows``) and one batch of queries. See ``quantised`` for rows that take no part;
    an empty table gives an empty result; further columns are ignored.
    """
    from tempora.session import materialize

    all_ = materialize(quantised(vectors, scale, vec_id, vector), "vectors")
    n, cells = all_.agg(F.count("*"), F.sum(F.size("q"))).first()
    tasks = all_.sparkSession.sparkContext.defaultParallelism
    shards = 1 + n // shard_rows if shard_rows else 1 + max(8 * (cells or 0) // SHARD_BYTES, min(tasks - 1, n // LEAST_ROWS))
    rows = all_.select(F.pmod(F.xxhash64("vec_id", "q"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "q")
    asks = all_.where(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "q")

    def run(batches):
        at, ids, held, shard = None, [], [], None
        out: list[tuple] = []

        def flush():
            q, v, s = list(zip(*out)) if out else [(), (), ()]
            out.clear()
            far = [order_of(x) for x in s]
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array([x if f is None else None for x, f in zip(s, far)], pa.int64()),
                                               pa.array([0 if f is None else 1 if x > 0 else -1 for x, f in zip(s, far)], pa.int32()),
                                               pa.array(far, pa.string())], names=["query_id", "vec_id", "score", "side", "far"])

        for b in batches:
            for s, kind, v, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), _lists(b.column(3))):
                if s != at:
                    at, ids, held, shard = s, [], [], None
                if not kind:
                    ids.append(v)
                    held.append(q.copy())
                elif ids:
                    if shard is None:
                        shard, held = Shard(np.array(ids, np.int64), held, max(map(len, held))), []
                    score, near = shard.top(v, q, k)
                    out += [(v, i, x) for i, x in zip(near, score)]
                    if len(out) >= 50_000:
                        yield flush()
        yield flush()

    found = (rows.unionAll(asks).repartition("shard").sortWithinPartitions("shard", "kind")
             .mapInArrow(run, "query_id long, vec_id long, score long, side int, far string"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("far"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
