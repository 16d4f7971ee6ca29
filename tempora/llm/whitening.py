"""Embedding whitening by a covariance weighted with multiplicities.

Vectors are put on an integer grid and equal ones are grouped, so each distinct vector takes part
once, with its count (or one) as its weight. Sums are exact integers; the covariance is a weighted
matrix product of centred vectors, added up over the tasks by Spark. Each distinct vector is
whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.session import materialize

COMPONENTS = 32
LONG = 1 << 63
GRID_END = float(1 << 62)  # entries beyond are taken as this far out
HOT_SHARE = 1000  # vectors of over one in so many rows meet their rows by broadcast: fewer than that many vectors


def grid(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64,
         shift: int = 1_000_000) -> DataFrame:
    """``(vec_id, h, x)``: x has ``floor(scale * c) + shift`` for each entry c as a double, h is its
    hash. Vectors null or with null or non-finite entries are left out."""
    entry = F.col(embedding)
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    def cell(c):
        return F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(GRID_END)), F.lit(-GRID_END))) + F.lit(shift).cast("long")

    x = df.where(entry.isNotNull()).where(finite).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(entry, cell).alias("x"))
    return x.select("vec_id", F.xxhash64("x").alias("h"), "x")


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) for each length of the lists of a column."""
    col = batch.column(batch.schema.get_field_index(column))
    size = np.diff(col.offsets.to_numpy())
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        part = col if len(at) == len(size) else col.take(pa.array(at))
        yield int(d), at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("weight")).to_numpy()


def _wide(a: np.ndarray, factor: int) -> np.ndarray:
    """The integers, as Python's own if ``factor`` times the largest may leave 64 bits."""
    most = max(-int(a.min(initial=0)), int(a.max(initial=0)))
    return a if most * factor < LONG >> 1 else a.astype(object)


def exact_sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of ``x``: the sum of weights, and the exact weighted sum of each dimension."""
    kind = pa.decimal128(38, 0)
    schema = pa.schema([("length", pa.int32()), ("i", pa.int32()), ("v", kind)])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            weight = _weights(b)
            for d, at, x in _matrices(b, "x"):
                w = weight[at]
                w = w.astype(object) if (x := _wide(x, int(w.sum()))).dtype == object else w
                own = [int(w.sum()), *(int(s) for s in w @ x)]
                total[d] = [p + q for p, q in zip(total[d], own)] if d in total else own
        for d, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()),
                                              pa.array([Decimal(s) for s in sums], kind)], schema=schema)

    found: dict[int, dict[int, int]] = {}
    for r in distinct.mapInArrow(run, "length int, i int, v decimal(38,0)").groupBy("length", "i").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.length, {})[r.i] = int(r.v)
    return {d: (s[-1], [s[i] for i in range(d)]) for d, s in found.items()}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly: n times the vectors less their mean."""
    x = _wide(x, 2 * n)
    return x * n - np.array(sums, x.dtype)


def weighted_products(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> dict[int, np.ndarray]:
    """For each key that ``rows`` gives with a matrix Y and weights w: the sum of ``Y.T @ (w * Y)``.
    Tasks add up their own; Spark adds up the entries of all tasks."""
    schema = pa.schema([("length", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, y, w in rows(b):
                own = y.T @ (w[:, None] * y)
                total[d] = total[d] + own if d in total else own
        for d, m in total.items():
            for i in range(len(m)):
                j = np.arange(i, len(m), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), k, np.int32)) for k in (d, i)]
                                                 + [pa.array(j), pa.array(m[i, i:])], schema=schema)

    out: dict[int, list] = {}
    for r in df.mapInArrow(run, "length int, i int, j int, v double").groupBy("length", "i", "j").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.length, []).append((r.i, r.j, r.v))
    full = {}
    for d, entries in out.items():
        i, j, v = map(np.array, zip(*entries))
        m = np.zeros((int(j.max()) + 1,) * 2)
        m[i, j] = v
        m[j, i] = v
        full[d] = m
    return full


def weighted_means(df: DataFrame, rows, n: dict[int, int]) -> dict[int, np.ndarray]:
    """For each key the weighted mean of the rows of Y."""
    schema = pa.schema([("length", pa.int32()), ("i", pa.int32()), ("v", pa.float64())])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, y, w in rows(b):
                total[d] = total.get(d, 0.0) + w @ y
        for d, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), d, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)),
                                              pa.array(s)], schema=schema)

    out: dict[int, dict] = {}
    for r in df.mapInArrow(run, "length int, i int, v double").groupBy("length", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.length, {})[r.i] = r.v
    return {d: np.array([s[i] for i in range(len(s))]) / n[d] for d, s in out.items()}


def principal_axes(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns, each with its
    largest entry positive. Eigenvalues that are zero to double precision are set to zero."""
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components].copy(), u[:, ::-1][:, :components]
    e[e <= max(e[0], 0) * len(cov) * 8 * np.finfo(float).eps] = 0.0
    lead = u[np.abs(u).argmax(0), np.arange(u.shape[1])]
    return e, u * np.where(lead < 0, -1.0, 1.0)


def whitened(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64, shift: int = 1_000_000,
             components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """One row a vector: ``vec_id, n, deviation, z, explained, identity_error``.

    The fit list is all vectors (``weights="counts"``) or each distinct one once (``"one"``); n is
    its length. ``z``: the vector on at most ``components`` unit eigenvectors of the covariance
    (divisor n), over the roots of the eigenvalues, by falling eigenvalue. ``explained``: each
    eigenvalue's share of the trace. ``deviation``: the exact sum over the dimensions of
    ``(n * x - sum)^2``, null beyond 64 bits. ``identity_error``: the largest entry of the
    covariance of z less the identity, over the components that have an eigenvalue.

    Vectors null or with null or non-finite entries are left out. Vectors of another length are
    fitted apart, each length with its own n. Components without variance have null in ``z``; if
    no dimension varies, ``explained`` is null too. A vector without dimensions has an empty
    ``z``. Null ids and repeated rows come out as often as they come in; an empty table gives an
    empty result; further columns are ignored. Entries beyond 2^62 on the grid count as that far.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights must be counts or one")
    spark = df.sparkSession
    rows = grid(df, vec_id, embedding, scale, shift)
    grouped = rows.groupBy("h", "x").agg(F.count("*").alias("rows"))
    distinct = materialize(grouped.withColumn("weight", F.col("rows") if weights == "counts" else F.lit(1).cast("long")), "distinct")
    fit = exact_sums(distinct.select("x", "weight"))
    size = {d: n for d, (n, _) in fit.items()}

    def centred(b: pa.RecordBatch):
        weight = _weights(b)
        for d, at, x in _matrices(b, "x"):
            if d:
                yield d, (deviations(x, *fit[d]) / size[d]).astype(float), weight[at].astype(float)

    cov = {d: m / size[d] for d, m in weighted_products(distinct.select("x", "weight"), centred).items()}
    axes = {d: principal_axes(m, components) for d, m in cov.items()}
    turn = {d: u / np.sqrt(np.where(e > 0, e, 1.0)) for d, (e, u) in axes.items()}
    real = {d: e > 0 for d, (e, _) in axes.items()}
    schema = pa.schema([("h", pa.int64()), ("x", pa.list_(pa.int64())), ("rows", pa.int64()), ("weight", pa.int64()),
                        ("deviation", pa.int64()), ("z", pa.list_(pa.float64()))])

    def whiten(batches):
        for b in batches:
            for d, at, x in _matrices(b, "x"):
                dev = deviations(x, *fit[d])
                most = max(-int(dev.min(initial=0)), int(dev.max(initial=0)))
                square = ((dev if most * most * max(d, 1) < LONG else dev.astype(object)) ** 2).sum(1, initial=0)
                own = [int(s) if s < LONG else None for s in square]
                z = (dev / size[d]).astype(float) @ turn[d] if d else np.zeros((len(at), 0))
                blank = np.broadcast_to(~real[d], z.shape).ravel() if d else None
                part = b.take(pa.array(at))
                lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * z.shape[1], pa.array(z.ravel(), mask=blank))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)).cast(schema.field(c).type)
                                                  for c in ("h", "x", "rows", "weight")]
                                                 + [pa.array(own, pa.int64()), lists], schema=schema)

    done = materialize(distinct.mapInArrow(whiten, "h long, x array<long>, rows long, weight long, deviation long, z array<double>"), "whitened")

    def coordinates(b: pa.RecordBatch, centre: dict | None = None):
        weight = _weights(b)
        for d, at, x in _matrices(b, "x"):
            if d and real[d].any():
                col = b.column(b.schema.get_field_index("z")).take(pa.array(at)).flatten()
                z = col.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(at), -1)[:, real[d]]
                yield d, z - centre[d] if centre else z, weight[at].astype(float)

    coded = done.select("x", "weight", "z")
    mean = weighted_means(coded, coordinates, size)
    again = weighted_products(coded, lambda b: coordinates(b, mean))
    error = {d: float(np.abs(m / size[d] - np.eye(len(m))).max()) for d, m in again.items()}
    facts = []
    for d, n in size.items():
        trace = float(np.trace(cov[d])) if d else 0.0
        facts.append((d, n, [float(e / trace) if trace else None for e in axes[d][0]] if d else [], error.get(d)))
    facts = spark.createDataFrame(facts, "length int, n long, explained array<double>, identity_error double")

    values = done.select("h", "x", "deviation", "z")
    total = distinct.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(values.join(distinct.where(F.col("rows") * HOT_SHARE > total).select("h", "x"), ["h", "x"], "left_semi"))
    often = rows.join(hot, ["h", "x"])
    rest = rows.join(hot.select("h", "x"), ["h", "x"], "left_anti").join(values, ["h", "x"])
    return often.unionByName(rest).withColumn("length", F.size("x")).join(F.broadcast(facts), "length").select(
        "vec_id", "n", "deviation", "z", "explained", "identity_error")


def whitened_components(df: DataFrame, **options) -> DataFrame:
    """``whitened`` with one row a vector and component (numbered from 1): ``vec_id, component, n,
    deviation, whitened, explained, identity_error``."""
    w = whitened(df, **options)
    return w.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("z").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("i")).alias("explained"), "identity_error")
