"""MaxScore against brute force: ties, bounds, shards, rows that take no part."""

import numpy as np
import pytest

from tempora.llm import maxscore as M
from tempora.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def brute(vectors, k=20, every=20):
    out = []
    for q, a in vectors.items():
        if q % every == 0:
            best = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), v) for v, b in vectors.items() if v != q)[:k]
            out += [(q, r, v, -s) for r, (s, v) in enumerate(best, 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def quantised(e):
    return [int(np.floor(64 * np.float64(x))) for x in e]


def test_query_equals_brute_force(spark):
    vectors = {r.vec_id: quantised(r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert rows(REGISTRY["op6_maxscore_top_k"](spark, SF)) == brute(vectors)


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_ties_and_shards(spark, shard_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(-20, 20, (7, 5))
    vectors = {i: (base[i % 7] if i % 3 else rng.integers(-20, 20, 5)).tolist() for i in range(300)}
    df = spark.createDataFrame([(i, [x / 64 for x in v]) for i, v in vectors.items()] * 2, "vec_id long, embedding array<float>")
    assert rows(M.top_k(df, k=20, shard_rows=shard_rows)) == brute(vectors)


def test_pruning_loses_nothing():
    rng = np.random.default_rng(4)
    for scale in (1, 30, 1 << 19, 1 << 25):
        x = rng.integers(-scale, scale + 1, (900, 12))
        x[: 300] = x[0]
        s = M.Shard(np.arange(900), list(x.astype(float)), 12)
        for q in range(0, 900, 90):
            score, ids = s.top(q, x[q].astype(float), 20)
            all_ = x.astype(object) @ x[q].astype(object)
            best = sorted((i for i in range(900) if i != q), key=lambda i: (-all_[i], i))[:20]
            assert ids == best and score == [all_[i] for i in best]


def test_large_components_and_repeated_ids(spark):
    data = {0: [3e6, 1.0], 20: [1.0, 0.5], 1: [2e6, -1e6], 2: [-1e30, 0.0], 3: [3e38, 1.0], 4: [1e20, 2e20], 40: [-2e38, 5.0], 5: [0.25, 0.25]}
    data = {i: [float(np.float32(c)) for c in v] for i, v in data.items()}
    df = spark.createDataFrame([(i, v) for i, v in data.items()], "vec_id long, embedding array<float>")
    exact = {i: [int(64 * c) if abs(c) > 1e15 else int(np.floor(64 * c)) for c in v] for i, v in data.items()}
    want = [(q, r, v, s if -M.LONG <= s < M.LONG else None) for q, r, v, s in brute(exact, k=5)]
    assert rows(M.top_k(df, k=5)) == want and any(s is None for *_, s in want)
    assert rows(M.top_k(df, k=5, shard_rows=2)) == want
    twice = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [1.0]), (1, [3.0])], "vec_id long, embedding array<double>")
    assert rows(M.top_k(twice, k=3)) == [(0, 1, 1, 2 * 3 * 4096), (0, 2, 1, 3 * 4096), (0, 3, 1, 2 * 4096)]


def test_scores_beyond_64_bits_sort_as_texts():
    rng = np.random.default_rng(1)
    some = [int(s) * 10 ** int(e) for s, e in zip(rng.integers(-10 ** 6, 10 ** 6, 300), rng.integers(14, 60, 300))]
    for sign in (1, -1):
        far = [x for x in some if x * sign >= M.LONG + 1]
        assert sorted(far) == sorted(far, key=M.order_of) and len(far) > 50


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (20, [0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, [-1.0, 0.25, 3.0]),
            (6, []), (7, [1e30, 0.0]), (0, [1.0, 2.0])]
    df = spark.createDataFrame([(*d, 1) for d in data], "vec_id long, embedding array<float>, score int")
    got = rows(M.top_k(df))
    want = brute({i: quantised(v) if i != 7 else [64 * int(np.float32(1e30)), 0] for i, v in ((0, [1.0, 2.0]), (20, [0.5]), (5, [-1.0, 0.25, 3.0]), (6, []), (7, [1e30, 0.0]))})
    want = [(q, r, v, s if s < M.LONG else None) for q, r, v, s in want]
    assert got == want and len(got) == 8
    assert rows(M.top_k(df.limit(0))) == [] and rows(M.top_k(df.where("vec_id = 0"))) == []
