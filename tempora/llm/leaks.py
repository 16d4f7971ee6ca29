"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

The n-grams of the benchmark mark bits of a map of fixed size. One scan of the corpus finds
where documents hold such n-grams and sends those regions, as word hashes; a region is as wide as
an alignment through the n-gram can be for items of the n-gram's length class.

Seeds join regions to items: n-grams that few items or few regions hold. A phrase that many of
both hold is no seed alone, but together with a rare word: an alignment that reaches the least
score matches so many words of the item that, of n words of which k must match, it matches one of
the n - k + 1 that are in the fewest regions. So no pair is lost, and a common phrase doesn't pair
all with all. Pairs with too few common words are left out; the others are aligned locally, with
gaps, so that copies with changed, missing or added words still score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import byte_classes, combine, salted_join, sliced, slices
from tempora.session import materialize

GRAM = 4
MAP_BITS = 24  # of the bit map; its size, 2 MB, doesn't depend on the benchmark's
MATCH, MISMATCH, GAP = 2, -2, -2
LEAST_SCORE = 0.5  # share of the score of an unchanged copy of the item
FEW = 16  # items or regions that hold an n-gram which is a seed alone
LEAST_WORDS = 8  # shorter items are found only as unchanged copies

_CLASSES = byte_classes({b: 0 for b in range(128) if not chr(b).isalnum()})


def _lower(col: pa.Array) -> list[bytes]:
    return [b"" if x is None else x.lower().encode() for x in col.to_pylist()]


def _grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every n-gram that lies within one text."""
    if len(h) < n:
        return h[:0], np.zeros(0, np.int64)
    g = combine(*[h[i:len(h) - n + 1 + i] for i in range(n)])
    at = np.flatnonzero(doc[n - 1:] == doc[:len(doc) - n + 1])
    return g[at], at


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", gram: int = GRAM) -> DataFrame:
    """``item_id, size, words, grams``: word hashes of each item (8 bytes each) and the hashes of its
    n-grams; an item shorter than a gram is one gram. Items without words are left out."""
    def run(batches):
        for b in sliced(batches, 1):
            ids, cols = b.column(0).to_pylist(), [[], [], [], []]
            for at, n, h, doc in slices(_lower(b.column(1)), _CLASSES):
                edge = np.searchsorted(doc, np.arange(n + 1))
                for i in range(n):
                    own = h[edge[i]:edge[i + 1]]
                    if len(own):
                        g, _ = _grams(own, np.zeros(len(own)), min(gram, len(own)))
                        for col, v in zip(cols, (ids[at + i], len(own), own.tobytes(), np.unique(g).view(np.int64))):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))],
                                             names=["item_id", "size", "words", "grams"])

    return benchmark.select(F.col(item_id).cast("long"), F.col(text).alias("t")).mapInArrow(
        run, "item_id long, size long, words binary, grams array<long>")


def bit_map(hashes: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """Bit x is set if a hash of the column ``g`` begins with the bits of x. What comes to the driver
    is at most one row for each 64 bits of the map."""
    top = F.shiftrightunsigned("g", 64 - bits)
    found = (hashes.groupBy(F.shiftright(top, 6).alias("at"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(g >>> %d & 63 as int))" % (64 - bits))).alias("word"))).toPandas()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64).view(np.uint64)
    return words


def marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the map may hold each hash; never false for one that it holds."""
    x = h >> np.uint64(64 - int(np.log2(len(marks))) - 6)
    return (marks[x >> np.uint64(6)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)


def needed(size, least: float):
    """Words of an item of ``size`` words that must match, as a column."""
    return F.when(size < LEAST_WORDS, size).otherwise(F.ceil(size * least - 1e-6))


def widest(size: int, least: float) -> int:
    """Words of a text that an alignment with an item of ``size`` words can span: gaps and changes
    cost as much as matches give."""
    return size if size < LEAST_WORDS else int(size * (2 - least)) + 1


REGION = "doc_id long, text_hash long, at long, words binary"


def regions(docs: DataFrame, maps: list[tuple[np.ndarray, int]], grams: list[int], doc_id: str, text: str) -> DataFrame:
    """``REGION``: stretches of a document around its benchmark n-grams. ``maps``: for each class of
    item lengths the map of its n-grams and how many words to take around one. Regions that
    overlap are one, so all of them are no longer than the text."""
    every = maps[0][0] if maps else np.zeros(1 << MAP_BITS - 6, np.uint64)
    for m, _ in maps[1:]:
        every = every | m

    def run(batches):
        for b in sliced(batches, 2):
            ids, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
            cols: list[list] = [[] for _ in range(4)]
            for first, n, h, doc in slices(_lower(b.column(2)), _CLASSES):
                edge = np.searchsorted(doc, np.arange(n + 1))
                low, high = [], []
                for k in grams:
                    g, at = _grams(h, doc, k)
                    hit = np.flatnonzero(marked(every, g))
                    for marks, reach in maps:
                        own = at[hit[marked(marks, g[hit])]]
                        low.append(np.maximum(own - reach, edge[doc[own]]))
                        high.append(np.minimum(own + reach, edge[doc[own] + 1]))
                if not low:
                    continue
                low, high = np.concatenate(low), np.concatenate(high)
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order])
                new = np.flatnonzero(np.r_[True, (low[1:] > high[:-1]) | (doc[low[1:]] != doc[low[:-1]])] if len(low) else [])
                for i, j in zip(low[new], high[np.r_[new[1:], len(low)] - 1] if len(low) else []):
                    d = int(doc[i])
                    for col, v in zip(cols, (ids[first + d], hashes[first + d], int(i - edge[d]), h[i:j].tobytes())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["doc_id", "text_hash", "at", "words"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"),
                       F.col(text).alias("t")).mapInArrow(run, REGION)


def _exploded(rows: DataFrame, name: str, fn) -> DataFrame:
    """``name, g, times``: for each row the hashes that ``fn`` makes of its words, each once with how
    often it comes."""
    def run(batches):
        for b in batches:
            found = [np.unique(fn(np.frombuffer(w, np.uint64)), return_counts=True) for w in b.column(1).to_pylist()]
            if found:
                at = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.concatenate([h for h, _ in found]).view(np.int64)),
                                                  pa.array(np.concatenate([n for _, n in found]))], names=[name, "g", "times"])

    return rows.select(name, "words").mapInArrow(run, f"{name} string, g long, times long")


def words_of(rows: DataFrame, name: str, marks: np.ndarray | None = None) -> DataFrame:
    """``name, g, times``: the distinct words of each row's ``words``, of those the map may hold."""
    return _exploded(rows, name, lambda h: h if marks is None else h[marked(marks, h)])


def grams_of(rows: DataFrame, name: str, sizes: list[int], marks: np.ndarray) -> DataFrame:
    """``name, g, times``: the distinct n-grams of each row's ``words``, of those the map may hold."""
    def fn(h):
        g = np.concatenate([_grams(h, np.zeros(len(h)), k)[0] for k in sizes])
        return g[marked(marks, g)]

    return _exploded(rows, name, fn)


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman score of each pair, and start and end of the best alignment in ``a``.

    All pairs advance together, word by word of ``a``; a gap in ``a`` is a running maximum.
    """
    m, n = max(map(len, a)), max(map(len, b))
    x, y = np.zeros((len(a), m), np.uint64), np.zeros((len(a), n), np.uint64)
    x_there, y_there = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for i, (p, q) in enumerate(zip(a, b)):
        x[i, : len(p)], x_there[i, : len(p)] = p, True
        y[i, : len(q)], y_there[i, : len(q)] = q, True
    rows = np.arange(len(a))
    score, since = np.zeros((len(a), n + 1), np.int32), np.zeros((len(a), n + 1), np.int32)
    best, start, end = [np.zeros(len(a), np.int32) for _ in range(3)]
    slope = -GAP * np.arange(n + 1, dtype=np.int32)
    step = np.arange(n + 1)
    for i in range(m):
        same = (y == x[:, i:i + 1]) & y_there & x_there[:, i:i + 1]
        diagonal = score[:, :-1] + np.where(same, MATCH, MISMATCH)
        up = score + GAP
        now, own = np.maximum(up, 0), np.where(up > 0, since, i + 1)
        better = diagonal > now[:, 1:]
        from_ = np.where(score[:, :-1] > 0, since[:, :-1], i)
        now[:, 1:] = np.where(better, diagonal, now[:, 1:])
        own[:, 1:] = np.where(better, from_, own[:, 1:])
        lifted = now + slope
        top = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == top, step, 0), axis=1)
        score = top - slope
        since = np.take_along_axis(own, source, axis=1)
        at = score.argmax(1)
        high = score[rows, at]
        win = (high > best) & x_there[:, i]
        best = np.where(win, high, best)
        start = np.where(win, since[rows, at], start)
        end = np.where(win, i + 1, end)
    return best, start, end


def reachable(a: np.ndarray, b: np.ndarray, least: float, gram: int = GRAM) -> bool:
    """Whether item ``b`` can reach the least score in ``a``: at most its words that ``a`` has match,
    and an n-gram of it must stand there."""
    need = 1.0 if len(b) < LEAST_WORDS else least
    if int(np.isin(b, a).sum()) < need * len(b) - 1e-6:
        return False
    n = min(gram, len(b))
    return bool(np.isin(_grams(b, np.zeros(len(b)), n)[0], _grams(a, np.zeros(len(a)), n)[0]).any())


def _aligned(pairs: DataFrame, least: float, gram: int) -> DataFrame:
    """``region, item, score, start, end`` from pairs with the words of both, if ``reachable``."""
    most = 1 << 21  # cells of one step of a batch of pairs

    def run(batches):
        for b in batches:
            r, i, p, q = [c.to_pylist() for c in b.columns]
            x, y = [np.frombuffer(v, np.uint64) for v in p], [np.frombuffer(v, np.uint64) for v in q]
            able = [k for k in range(len(r)) if reachable(x[k], y[k], least, gram)]
            order = sorted(able, key=lambda k: (len(x[k]), len(y[k])))
            out = np.zeros((3, len(r)), np.int64)
            while order:
                take, wide, tall = 0, 1, 1
                while take < len(order):
                    wide, tall = max(wide, len(x[order[take]])), max(tall, len(y[order[take]]))
                    if take and (take + 1) * max(tall, wide) > most // 16:
                        break
                    take += 1
                part, order = order[:take], order[take:]
                out[:, part] = align([x[k] for k in part], [y[k] for k in part])
            cols = [b.column(0), b.column(1), *map(pa.array, out)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(able, pa.int64())) for c in cols], names=["region", "item", "score", "start", "end"])

    return pairs.select("region", "item", "region_words", "item_words").mapInArrow(
        run, "region string, item string, score long, start long, end long")


def rare_words(texts: DataFrame, often: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``item, word``: of each item's words the rarest, so many that an alignment with the least score
    matches one. ``texts``: ``item, size, words``; ``often``: ``g, often``, the regions that hold a
    word (0 if it isn't there)."""
    own = words_of(texts, "item").join(often, "g", "left").join(texts.select("item", "size"), "item")
    before = F.coalesce(F.sum("times").over(Window.partitionBy("item").orderBy(F.coalesce("often", F.lit(0)), "g")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("before", before).where(F.col("before") <= F.col("size") - needed(F.col("size"), least)).select("item", F.col("g").alias("word"))


def candidates(items: DataFrame, stretches: DataFrame, sizes: list[int], least: float = LEAST_SCORE, few: int = FEW) -> DataFrame:
    """``region, item``: the pairs that share a seed. No other pair shares an n-gram and can reach the
    least score. ``items``: ``item, size, words, grams``, one row an item; ``stretches``: ``region,
    words``; ``few``: an n-gram held by so many items or regions at most is a seed alone."""
    own = materialize(items.select("item", F.explode("grams").alias("g")), "grams")
    held = materialize(grams_of(stretches, "region", sizes, bit_map(own)).select("region", "g"), "grams")
    both = own.groupBy("g").agg(F.count("*").alias("items")).join(held.groupBy("g").agg(F.count("*").alias("regions")), "g")
    crowded = materialize(both.where(F.least("items", "regions") > few).select("g"), "crowded")
    direct = salted_join(held, own.join(crowded, "g", "left_anti"), "g", ["region"], "inner").select("region", "item").distinct()
    if crowded.isEmpty():
        return direct
    phrases = own.join(crowded, "g")
    held = materialize(salted_join(held, crowded, "g", ["region"], "left_semi"), "phrases")
    texts = items.select("item", "size", "words").join(phrases.select("item").distinct(), "item", "left_semi")
    near = stretches.join(held.select("region").distinct(), "region", "left_semi")
    often = words_of(near, "region", bit_map(words_of(texts, "item"))).groupBy("g").agg(F.count("*").alias("often"))
    rare = materialize(rare_words(texts, often, least), "rare")
    words = words_of(near, "region", bit_map(rare.select(F.col("word").alias("g")))).select("region", F.col("g").alias("word"))
    keyed = held.join(words, "region").select("region", F.xxhash64("g", "word").alias("seed"))
    seeds = phrases.join(rare, "item").select("item", F.xxhash64("g", "word").alias("seed"))
    return direct.unionByName(salted_join(keyed, seeds, "seed", ["region"], "inner").select("region", "item")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", gram: int = GRAM, least: float = LEAST_SCORE, few: int = FEW) -> DataFrame:
    """``doc_id, text_hash, item_id, score, start, end``: documents that hold an item.

    score: the best local alignment as a share of the item's score with itself, at least
    ``least`` (1 for items of fewer than 8 words); start and end: its words in the document. One
    row for a text and an item of the same ids. Null or empty texts hold nothing and are held by
    nothing; repeated rows come out once; an empty table gives an empty result; further columns
    are ignored.
    """
    items = materialize(benchmark_items(benchmark, item_id, item_text, gram).withColumn("item", F.md5("words"))
                        .withColumn("class", F.length(F.bin("size"))), "items")
    classes = items.groupBy("class").agg(F.max("size").alias("size")).collect()  # a row for each power of two
    maps = [(bit_map(items.where(F.col("class") == c["class"]).select(F.explode("grams").alias("g"))), widest(c.size, least) + gram) for c in classes]
    sizes = sorted(r[0] for r in items.select(F.least("size", F.lit(gram)).cast("int")).distinct().collect())
    found = materialize(regions(docs, maps, sizes, doc_id, text).withColumn("region", F.md5("words")), "regions")
    texts = items.select("item", "words", "size", "grams").dropDuplicates(["item"])
    stretches = materialize(found.select("region", "words").dropDuplicates(["region"]), "stretches")
    pairs = materialize(candidates(texts, stretches, sizes, least, few), "pairs")
    worded = pairs.join(stretches.withColumnRenamed("words", "region_words"), "region").join(texts.select("item", F.col("words").alias("item_words")), "item")
    scored = materialize(_aligned(worded, least, gram).join(texts.select("item", "size"), "item")
                         .withColumn("share", F.col("score") / (MATCH * F.col("size")))
                         .where(F.col("share") >= F.when(F.col("size") < LEAST_WORDS, 1.0).otherwise(least)), "aligned")
    hits = (found.select("doc_id", "text_hash", "at", "region").join(scored, "region")
            .join(items.select("item_id", "item"), "item"))
    best = F.max(F.struct(F.col("share"), -(F.col("at") + F.col("start")), F.col("at") + F.col("end")))
    return (hits.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b"))
            .select("doc_id", "text_hash", "item_id", F.col("b.share").alias("score"), (-F.col("b.col2")).alias("start"), F.col("b.col3").alias("end")))


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item of the benchmark. Null and empty
    texts stay; repeated rows stay or go together; an empty table on either side leaves all rows."""
    found = materialize(leaks(docs, benchmark, doc_id, text, **options).select(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct(), "leaks")
    own = docs.withColumn("__own", F.xxhash64(F.coalesce(text, F.lit(""))))
    clean = own.join(found, (F.col("__own") == F.col("__hash")) & F.col(doc_id).cast("long").eqNullSafe(F.col("__doc")), "left_anti")
    return clean.drop("__own")
