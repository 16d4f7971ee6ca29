"""Importance resampling: counts and weights against plain Python, held-out accuracy, edge cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import resampling as R
from tempora.llm.common import byte_classes, slices, token_hashes
from tempora.llm.queries import REGISTRY

SF = "/root/testdata/sf0.01"


def tables(spark, sf=SF):
    return [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")]


def plain_grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]+", low, re.A)
    return [(w,) for w in words] + list(zip(words, words[1:]))


def bucket_of(grams):
    out = []
    for g in grams:
        h = [token_hashes(w.encode(), byte_classes())[0] for w in g]
        x = h[0] if len(h) == 1 else R.combine(*h)
        out.append(int(x[0]) >> 48)
    return out


def test_grams_equal_plain_python():
    texts = [b"", "Été à la FIN!! fin, a-b".encode(), b" \t\n", b"one", b"x | y %%% z\x00\x01 w"]
    got = [[] for _ in texts]
    for at, n, bucket, doc in R.grams(texts, 1 << 16):
        for b, d in zip(bucket, doc):
            got[at + d].append(int(b))
    for t, g in zip(texts, got):
        assert sorted(g) == sorted(bucket_of(plain_grams(t.decode())))


def test_long_tokens_and_block_borders():
    from tempora.llm.common import BLOCK

    c = byte_classes({32: 0, 10: 0})
    words = [b"a" * (BLOCK + 5), b"b" * (BLOCK - 1), b"cd", b"a" * (BLOCK + 5), b"cd"] + [b"w%d" % (i % 7) for i in range(400_000)]
    h, start, end = token_hashes(b" ".join(words), c)
    assert len(h) == len(words) and h[0] == h[3] and h[2] == h[4] and len(set(h[5:].tolist())) == 7
    assert h[5] == token_hashes(b"w0", c)[0][0]
    assert [n for _, n, _, _ in slices([b"x" * (BLOCK + 9), b"y", b"", b"z"], c)] == [1, 3]


def test_weights_equal_the_definition(spark):
    docs = spark.createDataFrame([(1, "good fine text"), (2, "good fine words"), (3, "bad !! bad"), (4, None), (5, "good !! odd")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    m = R.fit(docs, labels)
    fitted = {r.doc_id for r in R.labelled_sample(labels).where("kind = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    raw, target = np.zeros(1 << 16), np.zeros(1 << 16)
    for d, t in texts.items():
        for b in bucket_of(plain_grams(t)):
            raw[b] += 1
            target[b] += d in fitted
    ratio = np.log(target + 1) - np.log(raw * target.sum() / raw.sum() + 1)
    got = {r.doc_id: r.log_weight for r in R.scores(docs, m).collect()}
    for d, t in texts.items():
        assert got[d] == pytest.approx(sum(ratio[b] for b in bucket_of(plain_grams(t))))


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1e3, 500), np.repeat([3.25, -3.25, 0.0], 20), rng.normal(0, 1e-3, 100)].tolist()
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for k in (1, 17, 300, len(x)):
        assert R.kth_largest(df, "x", k) == sorted(x, reverse=True)[k - 1]


def test_cut():
    assert R.best_cut(np.array([1.0, 2, 3]), np.array([-1.0, 0, 0.5])) == 0.75
    assert R.best_cut(np.array([]), np.array([1.0])) == -np.inf
    assert R.best_cut(np.array([2.0, 2.0]), np.array([2.0])) in (-np.inf, np.inf)


def test_held_out_accuracy(spark):
    """Labels of one half decide, those of the other half judge."""
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    half = labels.where("doc_id % 2 = 0")
    got = {r.doc_id for r in R.resample(docs, half).collect()}
    judged = labels.where("doc_id % 2 = 1").collect()
    good = [r.doc_id in got for r in judged if r.quality == 1 and r.toxic == 0]
    bad = [r.doc_id in got for r in judged if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_held_out_toxic_documents_go(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    got = {r.doc_id for r in R.resample(docs, labels.where("doc_id % 2 = 0")).collect()}
    judged = labels.where("doc_id % 2 = 1").collect()
    toxic = [r.doc_id in got for r in judged if r.quality == 1 and r.toxic == 1]
    clean = [r.doc_id in got for r in judged if r.quality == 1 and r.toxic == 0]
    print("toxic kept", np.mean(toxic), len(toxic), "clean kept", np.mean(clean), len(clean))
    assert np.mean(toxic) < 0.25 and np.mean(clean) > 0.94


def test_toxic_weights_count_each_mark_once():
    marks = np.unique([b for b in range(0, R.TOXIC_BUCKETS, 3)])
    ratio = 1 + marks / R.TOXIC_BUCKETS
    texts = [b"", b"a b a b", b"x y z w v u t", b"a b"]
    own = [set() for _ in texts]
    for at, _, bucket, doc in R.grams(texts, R.TOXIC_BUCKETS):
        for b, d in zip(bucket.tolist(), doc.tolist()):
            own[at + d].add(b)
    want = [sum(1 + b / R.TOXIC_BUCKETS for b in o if b % 3 == 0) for o in own]
    assert R._toxic_weights(texts, marks, ratio).tolist() == pytest.approx(want)


def test_query_and_filter_agree(spark):
    docs, labels = tables(spark)
    got = {r.doc_id for r in REGISTRY["op4_importance_resampling"](spark, SF).collect()}
    kept = R.kept(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == got
    n = docs.count()
    assert 0.5 * n < len(got) < n


def test_edge_cases(spark):
    rows = [(1, "good text here", 1.0), (1, "good text here", 1.0), (None, None, None), (2, "", 2.0), (3, "!! !!", 0.5), (4, "word " * 100000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key double")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (3, 0, 0), (2, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, 1)],
                                   "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.kind > 0) for r in R.labelled_sample(labels).collect()} == {(1, True), (3, False)}
    kept = R.kept(docs, labels)
    assert kept.columns == docs.columns
    kept.collect()
    assert R.kept(docs, labels.limit(0)).count() == 6  # no model: every weight is 0, nothing is rejected
    assert R.kept(docs.limit(0), labels).count() == 0 and R.resample(docs.limit(0), labels).count() == 0
    assert R.scores(docs, R.Model(np.zeros(1 << 16), 0.0)).where(F.col("log_weight") != 0).count() == 0


def test_who_stays_equals_plain_python(spark):
    """The whole query restated over dictionaries, but for the choice of the labelled halves: models,
    weights, marks of toxic text, both cuts, noise and the size of the sample."""
    from collections import Counter
    from math import log

    import xxhash

    docs, labels = tables(spark, "/root/testdata/sf0.001")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    good = {r.doc_id: r.kind for r in R.labelled_sample(labels).collect()}
    tox = {r.doc_id: r.kind for r in R.toxic_sample(labels).collect()}
    hashes = {}

    def wide(text):
        """64-bit hashes of words and pairs."""
        out = []
        for g in plain_grams(text):
            if g not in hashes:
                h = [token_hashes(w.encode(), byte_classes())[0] for w in g]
                hashes[g] = int((h[0] if len(h) == 1 else R.combine(*h))[0])
            out.append(hashes[g])
        return out

    grams = {d: wide(t) for d, t in rows.items()}
    raw, target = Counter(), Counter()
    for d, g in grams.items():
        raw.update(x >> 48 for x in g)
        if good.get(d) == 1:
            target.update(x >> 48 for x in g)
    scale = sum(target.values()) / sum(raw.values())
    ratio = lambda b: log(target[b] + 1) - log(raw[b] * scale + 1)
    weight = {d: sum(ratio(x >> 48) for x in g) for d, g in grams.items()}

    def cut_between(high, low):
        best, where = 0.0, -np.inf
        values = sorted({*high, *low})
        for a, b in zip([None, *values], [*values, None]):
            t = -np.inf if a is None else np.inf if b is None else (a + b) / 2
            gain = sum(x >= t for x in high) / len(high) + sum(x < t for x in low) / len(low)
            if gain > best + 1e-12:
                best, where = gain, t
        return where

    cut = cut_between([weight[d] for d in rows if good.get(d) == 2], [weight[d] for d in rows if good.get(d) == 0])
    own = {d: {x >> 44 for x in g} for d, g in grams.items()}
    n = {k: sum(tox.get(d) == k for d in rows) for k in (1, 3)}
    seen = {k: Counter(b for d in rows if tox.get(d) == k for b in own[d]) for k in (1, 3)}
    marks = {}
    for b in seen[3]:
        share = (seen[3][b] + seen[1][b]) / (n[1] + n[3])
        spread = (share * (1 - share) * n[1] * n[3] / (n[1] + n[3])) ** 0.5
        r = log(seen[3][b] + 1) - log(seen[1][b] * n[3] / n[1] + 1)
        if seen[3][b] - n[3] * share > R.SIGNIFICANT * spread and r > 0:
            marks[b] = r
    sums = {d: sum(marks.get(b, 0.0) for b in s) for d, s in own.items()}
    high, low = ([sums[d] for d in rows if tox.get(d) == k] for k in (4, 2))
    limit = cut_between(high, low) if marks and high and low else np.inf
    limit = limit if limit > 0 else np.inf

    def noise(d):
        u = xxhash.xxh64_intdigest(rows[d].encode(), (7 + d) % (1 << 64))
        return -log(-log((u + 0.5) / 2.0 ** 64 * (1 - 1e-12)))

    able = {d: weight[d] + noise(d) for d in rows if sums[d] < limit}
    k = sum(weight[d] >= cut for d in able)
    want = set(sorted(able, key=able.get, reverse=True)[:k])
    got = {r.doc_id for r in REGISTRY["op4_importance_resampling"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and 0 < len(got) < len(rows)
