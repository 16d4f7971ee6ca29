"""Exact quantiles of groups against numpy, with sketches coarse enough that brackets act."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.config import WL, ProfileConfig
from tempora.operators import profile as P
from tempora.operators import quantiles as Q
from tests.test_profile import frame

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]


def made(spark, groups):
    rows = [(k, float(v), "x") for k, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double, n string").repartition(7)


@pytest.mark.parametrize("accuracy", [5, 40, 1000])
def test_equal_to_numpy(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    groups = {"hot": np.exp(rng.normal(size=6000) * 6), "ties": rng.integers(0, 4, 2000), "one": [3.5], "two": [1.0, -2.0],
              "equal": [7.0] * 900, "signs": rng.normal(size=701) * 1e-3, "far": np.r_[rng.normal(size=500), 1e300, -1e300],
              "nine": np.arange(9.0)}
    got = {r.g: r for r in Q.grouped_quantiles(made(spark, groups), ["g"], "v", PROBS, accuracy).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        np.testing.assert_allclose(got[k].quantiles, np.quantile(np.asarray(vs, float), PROBS), rtol=1e-12, atol=1e-15)


def test_nulls_empty_tables_and_null_keys(spark):
    rows = [("a", None), ("a", math.nan), (None, 2.0), (None, None), (None, 4.0), ("b", 1.0), ("b", math.nan)]
    df = spark.createDataFrame(rows, "g string, quantiles double")
    got = {r.g: (r.n, r.quantiles) for r in Q.grouped_quantiles(df, ["g"], "quantiles", [0.5, 0.25]).collect()}
    assert got == {"a": (0, None), None: (2, [3.0, 2.5]), "b": (1, [1.0, 1.0])}
    assert Q.grouped_quantiles(df.limit(0), ["g"], "quantiles", [0.5]).count() == 0
    for bad in ([], [1.5], [-0.1]):
        with pytest.raises(ValueError):
            Q.grouped_quantiles(df, ["g"], "quantiles", bad)


def test_only_a_bracket_of_a_hot_group_is_ranked(spark):
    n, accuracy = 40_000, 400
    x = spark.range(n).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % n).cast("double").alias("_v"))
    b = Q.brackets(x, ["g"], [0.5, 0.95], accuracy).first()
    for lo, hi, p in zip(b["_lo"], b["_hi"], [0.5, 0.95]):
        assert lo <= p * (n - 1) <= hi and hi - lo <= 8 * n / accuracy
    got = Q.grouped_quantiles(x, ["g"], "_v", [0.5, 0.95], accuracy).first()
    assert got.quantiles == pytest.approx([(n - 1) * 0.5, (n - 1) * 0.95])


def test_workload_stats_by_selection(spark):
    rng = np.random.default_rng(3)
    c = P.clean(frame(spark, rng.gamma(2, 3, 700), dep="a").union(frame(spark, rng.integers(1, 9, 300), dep="b"))).cache()
    plain = P.workload_stats(c).orderBy(*WL).collect()
    chosen = P.workload_stats(c, ProfileConfig(select_percentiles=True, approx_accuracy=60)).orderBy(*WL).collect()
    assert [r.asDict().keys() for r in plain] == [r.asDict().keys() for r in chosen]
    for a, b in zip(plain, chosen):
        assert list(a)[:2] == list(b)[:2] and list(a)[2:] == pytest.approx(list(b)[2:])
