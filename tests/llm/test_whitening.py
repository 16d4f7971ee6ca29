"""Whitening against numpy over all rows, and the defined results of odd input."""

import math

import numpy as np
import pytest

from tempora.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def fitted(rows, ids=None):
    """Whitened rows as a dict (vec_id, component) -> row."""
    return {(r.vec_id, r.component): r for r in rows}


def brute(vectors, components=32):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    dev = x * n - s
    y = (dev / n).astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return (dev ** 2).sum(1), y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_components_equal_a_fit_over_all_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.4, (60, 40)) * np.linspace(1, 0.2, 40)
    vectors = np.r_[base, base[:5].repeat(30, 0), base[:1].repeat(400, 0)].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA)
    out = whitening.whitened_components(df).collect()
    assert len(out) == len(vectors) * 32
    deviation, z, share = brute(vectors)
    got = fitted(out)
    whole = np.array([[got[i, k + 1].whitened for k in range(32)] for i in range(len(vectors))])
    sign = np.sign((whole * z).sum(0))
    assert np.abs(whole - z * sign).max() < 1e-7
    assert [got[i, 1].deviation for i in range(len(vectors))] == [int(d) for d in deviation]
    assert np.allclose([got[0, k + 1].explained for k in range(32)], share, rtol=1e-9)
    assert {r.n for r in out} == {len(vectors)}
    assert len({r.identity_error for r in out}) == 1 and 0 <= out[0].identity_error < 1e-9
    centred = whole - whole.mean(0)
    assert np.abs(centred.T @ centred / len(whole) - np.eye(32)).max() < 1e-9


def test_weights_of_one_fit_distinct_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (30, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(np.r_[base, base[:1].repeat(50, 0)])], SCHEMA)
    out = whitening.whitened_components(df, weights="one").collect()
    deviation, z, _ = brute(base, 4)
    got = fitted(out)
    assert {r.n for r in out} == {30} and len(out) == 80 * 4
    assert [got[i, 1].deviation for i in range(30)] == [int(d) for d in deviation]
    assert all(got[i, k].whitened == got[0, k].whitened for i in range(30, 80) for k in range(1, 5))
    with pytest.raises(ValueError):
        whitening.whitened(df, weights="some")


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [1.0, -inf], 0),
            (6, [0.5, 1.0], 0), (7, [0.25, 3.0], 0), (7, [0.25, 3.0], 0), (None, [-2.0, 0.1], 0),
            (9, [0.5, 0.5, 0.5], 0), (10, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "weight")
    out = whitening.whitened_components(df).collect()
    pairs = [r for r in out if r.n == 4]
    assert sorted((-1 if r.vec_id is None else r.vec_id) for r in pairs) == [-1, -1, 6, 6, 7, 7, 7, 7]
    alone = [r for r in out if r.vec_id == 9]  # one vector of its length: nothing varies
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [
        (k, 1, 0, None, None, None) for k in (1, 2, 3)]
    assert len(out) == 8 + 3  # the vector without dimensions has no component
    assert whitening.whitened(df).where("vec_id = 10").first().z == []


def test_without_variance_in_a_direction(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0) for i in range(20)], SCHEMA)
    out = whitening.whitened_components(df).collect()
    first = [r for r in out if r.component == 1]
    assert np.isclose(sum(r.whitened ** 2 for r in first) / 20, 1) and first[0].identity_error < 1e-9
    assert {r.whitened for r in out if r.component > 1} == {None} and first[0].explained == pytest.approx(1)


def test_large_entries_stay_exact(spark):
    rows = [(0, [3e6, 1.0]), (1, [1.0, 2.0]), (2, [3e38, 0.0]), (3, [-1.0, 5.0])]
    for some in (rows[:2] + rows[3:], rows):
        df = spark.createDataFrame([(i, v, 0) for i, v in some], SCHEMA)
        got = fitted(whitening.whitened_components(df).collect())
        assert {i for i, _ in got} == {i for i, _ in some}
        assert all(np.isfinite(r.whitened) for (i, k), r in got.items() if k == 1)
    exact = brute([v for _, v in rows[:2] + rows[3:]], 2)[0]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows[:2] + rows[3:]], SCHEMA)
    assert [r.deviation for r in whitening.whitened(df).orderBy("vec_id").collect()] == [int(d) for d in exact]


def test_empty_table(spark):
    out = whitening.whitened_components(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 0
