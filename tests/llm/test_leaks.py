"""Decontamination: alignment and seeds against plain Python, planted copies, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.llm import leaks as L
from tempora.llm.common import byte_classes, token_hashes
from tempora.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (L.MATCH if x == y else L.MISMATCH), h[i - 1, j] + L.GAP, h[i, j - 1] + L.GAP)
    return int(h.max())


words = st.lists(st.integers(0, 4), min_size=1, max_size=14)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=6))
def test_alignment_equals_plain_python(pairs):
    u = lambda x: np.array(x, np.uint64)
    score, start, end = L.align([u(a) for a, _ in pairs], [u(b) for _, b in pairs])
    for (a, b), s, i, j in zip(pairs, score, start, end):
        assert s == smith_waterman(a, b)
        if s:  # the stretch alone scores as much
            assert smith_waterman(a[i:j], b) == s


def split(text):
    return "".join(c if c.isalnum() or c >= "\x80" else " " for c in (text or "").lower()).split()


def brute(docs, items, least=L.LEAST_SCORE):
    """Every text against every item: pairs with a common n-gram, aligned as a whole."""
    out = {}
    for i, t in items.items():
        b = split(t)
        n = min(L.GRAM, len(b))
        grams = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if b else set()
        for d, x in docs.items():
            a = split(x)
            if any(tuple(a[k:k + n]) in grams for k in range(len(a) - n + 1)) and b:
                share = smith_waterman(a, b) / (L.MATCH * len(b))
                if share >= (1 if len(b) < L.LEAST_WORDS else least):
                    out[d, i] = share
    return out


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.score for r in REGISTRY["op10_seeded_alignment"](spark, SF).collect()}
    assert got == pytest.approx(brute(docs, items)) and got


def prose(rng, n):
    return [f"w{int(i)}" for i in rng.integers(0, 5000, n)]


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(f"other{int(rng.integers(1000))}" if x < share * 2 / 3 else w)
        if share * 2 / 3 <= x < share:
            out.append("added")
    return out


@pytest.mark.parametrize("few", [L.FEW, 0])
def test_edited_copies(spark, few):
    rng = np.random.default_rng(8)
    items = {i: prose(rng, int(rng.integers(20, 60))) for i in range(12)}
    docs, planted = {}, {}
    for d in range(120):
        body = prose(rng, 150)
        if d % 3 == 0:
            i = 0 if d % 2 else int(rng.integers(12))  # one item stands in many documents
            at = int(rng.integers(150))
            body[at:at] = edited(rng, items[i], 0.15)
            planted[d] = i
        if d % 4 == 0:
            body[5:5] = ["this", "is", "the", "common", "phrase", "of", "all"]
        docs[d] = " ".join(body).capitalize() + "."
    items[3][2:2] = ["this", "is", "the", "common", "phrase"]
    frames = (spark.createDataFrame([(d, t, 1.0) for d, t in docs.items()], "doc_id long, text string, score double"),
              spark.createDataFrame([(i, " ".join(t), 2.0) for i, t in items.items()], "item_id long, text string, score double"))
    got = {(r.doc_id, r.item_id): r for r in L.leaks(*frames, few=few).collect()}
    want = brute(docs, {i: " ".join(t) for i, t in items.items()})
    assert {k: r.score for k, r in got.items()} == pytest.approx(want)
    assert {d for d, _ in got} >= {d for d in planted if (d, planted[d]) in want} and len(got) > 30
    clean = L.without_leaks(*frames)
    assert {r.doc_id for r in clean.collect()} == docs.keys() - {d for d, _ in got} and clean.columns == frames[0].columns
    for (d, i), r in got.items():
        part = split(docs[d])[r.start:r.end]
        assert smith_waterman(part, items[i]) == round(r.score * 2 * len(items[i]))


def test_rare_words(spark):
    u = lambda x: np.array(x, np.uint64).tobytes()
    texts = spark.createDataFrame([("a", 8, u([1, 1, 2, 3, 4, 5, 6, 7])), ("b", 3, u([8, 9, 10]))], "item string, size long, words binary")
    often = spark.createDataFrame([(1, 500), (2, 400), (3, 3), (4, 9), (5, 2), (6, 90), (8, 7), (9, 1)], "g long, often long")
    # 4 of 8 words must match, so one of the 5 rarest; all of 3 words, so the rarest
    assert sorted((r.item, r.word) for r in L.rare_words(texts, often).collect()) == [("a", 3), ("a", 4), ("a", 5), ("a", 6), ("a", 7), ("b", 10)]


def test_a_common_phrase_pairs_nothing(spark):
    rng = np.random.default_rng(12)
    phrase = "which of the following is true"
    items = {i: f"{phrase} {' '.join(prose(rng, 24))}" for i in range(60)}
    docs = {d: f"{' '.join(prose(rng, 40))} {phrase} {' '.join(prose(rng, 40))}" for d in range(300)}
    docs[1000] = f"{' '.join(prose(rng, 40))} {items[7]} {' '.join(prose(rng, 40))}"
    frames = (spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
              spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in L.leaks(*frames).collect()} == {(1000, 7)}
    held = L.benchmark_items(frames[0].withColumnRenamed("doc_id", "item_id")).select(F.md5("words").alias("region"), "words")
    own = L.benchmark_items(frames[1]).withColumn("item", F.md5("words")).drop("item_id")
    alone, sharing = (L.candidates(own, held, [L.GRAM], few=n) for n in (10_000, L.FEW))
    assert alone.count() >= 60 * 301 and sharing.count() < 4000  # words here are drawn from 5,000
    wanted = {(r.region, r.item) for r in alone.collect()}
    assert {(r.region, r.item) for r in sharing.collect()} <= wanted


def test_insertions_up_to_the_score(spark):
    """Four words in a row survive, and a foreign word follows every two others: the alignment spans
    half as much again as the item."""
    item = [f"it{i}" for i in range(200)]
    text = item[:4] + [x for i in range(4, 200, 2) for x in (item[i], item[i + 1], f"foreign{i}")]
    short = [f"sh{i}" for i in range(12)]
    docs = {1: " ".join(["pre"] * 50 + text + ["post"] * 50), 2: " ".join(["pre"] * 400 + short[:8] + ["post"] * 400), 3: "pre post"}
    items = {1: " ".join(item), 2: " ".join(short)}
    frames = (spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
              spark.createDataFrame(list(items.items()), "item_id long, text string"))
    want = brute(docs, items)
    assert want.keys() == {(1, 1), (2, 2)} and want[1, 1] < 0.52
    assert {(r.doc_id, r.item_id): r.score for r in L.leaks(*frames).collect()} == pytest.approx(want)


def test_edited_copies_in_many_documents(spark):
    rng = np.random.default_rng(3)
    item = [f"item{i}" for i in range(24)]
    changed = [f"other{i}" if i in (6, 12, 18) else w for i, w in enumerate(item)]
    body = lambda d: " ".join([*prose(rng, 20), *(item if d == 0 else changed), *prose(rng, 20)])
    docs = {d: body(d) for d in range(160)}
    frames = (spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
              spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.score for r in L.leaks(*frames).collect()}
    assert got == pytest.approx(brute(docs, {1: " ".join(item)})) and len(got) == 160
    assert L.without_leaks(*frames).count() == 0


@settings(max_examples=120, deadline=None)
@given(words, words)
def test_unreachable_pairs_score_too_low(a, b):
    n = min(L.GRAM, len(b))
    common = {tuple(a[i:i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i:i + n]) for i in range(len(b) - n + 1)}
    if not L.reachable(np.array(a, np.uint64), np.array(b, np.uint64), L.LEAST_SCORE) and common:
        assert smith_waterman(a, b) / (L.MATCH * len(b)) < (1 if len(b) < L.LEAST_WORDS else L.LEAST_SCORE)


def test_map_has_every_gram(spark):
    items = L.benchmark_items(spark.createDataFrame([(i, " ".join(f"x{i}y{j}" for j in range(50))) for i in range(40)], "item_id long, text string"))
    marks = L.bit_map(items.select(F.explode("grams").alias("g")), 16)
    grams = {g for r in items.collect() for g in r.grams}
    assert len(grams) == 40 * 47
    want = {(g % (1 << 64)) >> 48 for g in grams}
    assert want == {64 * i + b for i, w in enumerate(marks.tolist()) for b in range(64) if w >> b & 1}


def test_edge_cases(spark):
    item = "the quick brown fox jumps over the lazy dog tonight"
    rows = [(1, None), (2, ""), (3, "!!"), (None, f"so {item} x"), (4, f"So, The QUICK brown fox jumps over the lazy dog tonight"), (4, f"So, The QUICK brown fox jumps over the lazy dog tonight"),
            (5, "filler words here " * 30000 + item), (6, "two words"), (7, "quick brown fox jumps"), (8, "sun shines")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "Two  words"), (None, item), (10, item), (14, "sun shines bright")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaks(docs, bench).collect()}
    assert got == {(d, i) for d in (None, 4, 5) for i in (10, None)} | {(6, 13)}
    assert sorted(r.doc_id for r in L.without_leaks(docs, bench).collect()) == [1, 2, 3, 7, 8]
    assert L.leaks(docs.limit(0), bench).count() == 0 and L.leaks(docs, bench.limit(0)).count() == 0
    assert L.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_hash_of_words_matches_split():
    c = byte_classes({b: 0 for b in range(128) if not chr(b).isalnum()})
    t = "Éa-b c1\x00d été"
    assert len(token_hashes(t.lower().encode(), c)[0]) == len(split(t))
