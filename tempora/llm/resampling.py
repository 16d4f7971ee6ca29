"""Quality by importance resampling.

Two bag models over hashed word n-grams, one of target text (documents labelled good) and one of
the raw corpus, give each document the log of its importance: the sum over its n-grams of the log
ratio of the models. Documents are then sampled without replacement by Gumbel top-k: noise from a
hash of the document is added to the log weight, and the k largest stay. How many stay is how
many documents lie above the weight that best parts the labelled good from the bad.

Toxic documents are judged apart, as they are ordinary text but for a few words: n-grams that are
in significantly more labelled toxic than clean documents have the log of that ratio, and a
document in which their sum reaches a second cut is never sampled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import SPACES, byte_classes, byte_column, combine, sliced, slices
from tempora.session import materialize

BUCKETS = 1 << 16
LABELLED = 20_000  # labelled documents of each kind that the model is fitted on, at most
SMOOTHING = 1.0
TOXIC_BUCKETS = 1 << 20
SIGNIFICANT = 6.0  # standard deviations from which on an n-gram counts as a mark of toxic text

# Words are runs of letters, digits and bytes from 0x80 on; runs of other marks are words too.
_CLASSES = byte_classes({b: 2 for b in range(128) if not chr(b).isalnum()} | dict.fromkeys(SPACES, 0))


@dataclass
class Model:
    """Log ratio of the target model to the raw model by bucket; the weight that parts good from bad;
    buckets and log ratios of the marks of toxic text, and the sum from which on a text is toxic."""

    ratio: np.ndarray
    cut: float
    marks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    mark_ratio: np.ndarray = field(default_factory=lambda: np.zeros(0))
    toxic_cut: float = np.inf


def grams(texts: list[bytes], buckets: int):
    """(first text, texts, bucket, text number) of all words and pairs of words, by slices."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for at, n, h, doc in slices([t.lower() for t in texts], _CLASSES):
        same = doc[1:] == doc[:-1]
        two = combine(h[:-1], h[1:])[same] if len(h) else h
        yield at, n, (np.r_[h, two] >> shift).astype(np.int64), np.r_[doc, doc[1:][same]]


def _sample(labels: DataFrame, want, bound: int, kind: int) -> DataFrame:
    return labels.where(want).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("kind", F.lit(kind))


def labelled_sample(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """``doc_id, kind``: up to ``bound`` good (quality 1 and not toxic) and bad (quality 0) documents,
    those with the least hash of their id. Kind 1: good, to fit the target model on; 2: good, held
    out to find the cut; 0: bad. Rows with nulls or both labels are no sample."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    bad = F.col("quality") == 0
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.bool_and(good).alias("good"), F.bool_and(bad).alias("bad"))
    fitted = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    return (_sample(own, "good", bound, 1).withColumn("kind", F.when(fitted, 1).otherwise(2))
            .unionByName(_sample(own, "bad", bound, 0)))


def toxic_sample(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """``doc_id, kind``: up to ``bound`` toxic and clean (toxic 0) documents of any quality. Kind 3:
    toxic, to find the marks on; 4: toxic, a quarter held out; 1 and 2: clean. Nulls or both are no sample."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.bool_and(F.col("toxic") == 1).alias("toxic"), F.bool_and(F.col("toxic") == 0).alias("clean"))
    held = (F.pmod(F.xxhash64("doc_id", F.lit("toxic quarter")), F.lit(4)) == 0).cast("int")
    return (_sample(own, "toxic", bound, 3).unionByName(_sample(own, "clean", bound, 1))
            .withColumn("kind", F.col("kind") + held))


def toxic_marks(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and log ratios of the n-grams in significantly more toxic than clean documents of the
    sample. Only these come to the driver; a task sends at most one row a bucket."""
    def run(batches):
        seen = np.zeros((2, TOXIC_BUCKETS + 1), np.int64)  # the last one counts the documents
        for b in sliced(batches, "t"):
            texts, toxic = byte_column(b, "t"), np.array([k == 3 for k in b.column(1).to_pylist()], bool)
            for at, n, bucket, doc in grams(texts, TOXIC_BUCKETS):
                once = np.unique(doc.astype(np.int64) * TOXIC_BUCKETS + bucket)
                kind = toxic[at:at + n][once // TOXIC_BUCKETS]
                for k in (0, 1):
                    seen[k, :-1] += np.bincount(once[kind == k] % TOXIC_BUCKETS, minlength=TOXIC_BUCKETS)
                    seen[k, -1] += int((toxic[at:at + n] == k).sum())
        some = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[1, some]), pa.array(seen[0, some])], names=["bucket", "toxic", "clean"])

    found = materialize(docs.join(F.broadcast(sample.where("kind in (1, 3)")), "doc_id").select("t", "kind")
                        .mapInArrow(run, "bucket long, toxic long, clean long")
                        .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic")
    n = found.where(F.col("bucket") == TOXIC_BUCKETS).first()
    if n is None or not n.toxic or not n.clean:
        return np.zeros(0, np.int64), np.zeros(0)
    share = (F.col("toxic") + F.col("clean")) / (n.toxic + n.clean)
    spread = F.sqrt(share * (1 - share) * (n.toxic * n.clean / (n.toxic + n.clean)))
    ratio = F.log(F.col("toxic") + SMOOTHING) - F.log(F.col("clean") * (n.toxic / n.clean) + SMOOTHING)
    marks = (found.where((F.col("bucket") < TOXIC_BUCKETS) & (F.col("toxic") - n.toxic * share > SIGNIFICANT * spread))
             .select("bucket", ratio.alias("ratio")).where("ratio > 0").orderBy("bucket").toPandas())
    return marks["bucket"].to_numpy(np.int64), marks["ratio"].to_numpy(float)


def _toxic_weights(texts: list[bytes], marks: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Sum of the log ratios of the distinct marks in each text."""
    out = np.zeros(len(texts))
    if not len(marks):
        return out
    marked = np.zeros(TOXIC_BUCKETS, bool)
    marked[marks] = True
    for at, n, bucket, doc in grams(texts, TOXIC_BUCKETS):
        hit = marked[bucket]
        once = np.unique(doc[hit].astype(np.int64) * TOXIC_BUCKETS + bucket[hit])
        out[at:at + n] = np.bincount(once // TOXIC_BUCKETS, ratio[np.searchsorted(marks, once % TOXIC_BUCKETS)], n)
    return out


def toxic_model(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, bound: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Marks of toxic text, their log ratios, and the cut found on the held-out quarter. Without labels
    of both kinds, or without marks, nothing is toxic."""
    sample = materialize(toxic_sample(labels, bound), "sample")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    marks, ratio = toxic_marks(own, sample)
    if not len(marks):
        return marks, ratio, np.inf

    def weigh(batches):
        for b in sliced(batches, "t"):
            w = _toxic_weights(byte_column(b, "t"), marks, ratio)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("kind")), pa.array(w)], names=["kind", "w"])

    seen = own.join(F.broadcast(sample.where("kind in (2, 4)")), "doc_id").select("t", "kind").mapInArrow(weigh, "kind int, w double").toPandas()
    cut = best_cut(seen["w"][seen["kind"] == 4].to_numpy(), seen["w"][seen["kind"] == 2].to_numpy())
    return marks, ratio, cut if cut > 0 else np.inf


def counts(docs: DataFrame, sample: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """``bucket, raw, target``: n-grams of all documents and of the good sample; a task sends at
    most one row a bucket."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).join(
        F.broadcast(sample), "doc_id", "left").select("t", "kind")

    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in sliced(batches, "t"):
            texts = byte_column(b, "t")
            good = np.array([k == 1 for k in b.column(1).to_pylist()], bool)
            for at, n, bucket, doc in grams(texts, buckets):
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[at:at + n][doc]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    return rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def _log_weights(texts: list[bytes], ratio: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for at, n, bucket, doc in grams(texts, len(ratio)):
        out[at:at + n] = np.bincount(doc, ratio[bucket], n)
    return out


def _noise(ids: list, texts: list[bytes], seed: int) -> np.ndarray:
    """Gumbel noise from a hash of id and text."""
    u = np.array([xxhash.xxh64_intdigest(t, (seed + (i if i is not None else -1)) % (1 << 64)) for i, t in zip(ids, texts)], np.uint64)
    return -np.log(-np.log((u.astype(np.float64) + 0.5) / 2.0 ** 64 * (1 - 1e-12)))


def _scored(ids: list, texts: list[bytes], model: Model, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights, and keys; a toxic text's key is not a number."""
    w = _log_weights(texts, model.ratio)
    key = w + _noise(ids, texts, seed) if len(w) else w
    return w, np.where(_toxic_weights(texts, model.marks, model.mark_ratio) >= model.toxic_cut, np.nan, key)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
        bound: int = LABELLED) -> Model:
    """The models over all documents, the target model on at most ``bound`` labelled ones.

    To the driver come one row a bucket and one weight for each document of the labelled sample.
    Without good labels all weights are 0; without bad ones every document is above the cut.
    """
    sample = materialize(labelled_sample(labels, bound), "sample")
    found = counts(docs, sample, doc_id, text, buckets).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    # both are smoothed at the target's size, so a bucket that is rare in the corpus says little
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    ratio = np.log(target + SMOOTHING) - np.log(expected + SMOOTHING)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).join(F.broadcast(sample), "doc_id")

    def weigh(batches):
        for b in sliced(batches, "t"):
            w = _log_weights(byte_column(b, "t"), ratio)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("kind")), pa.array(w)], names=["kind", "w"])

    seen = own.select("t", "kind").mapInArrow(weigh, "kind int, w double").toPandas()
    return Model(ratio, best_cut(seen["w"][seen["kind"] == 2].to_numpy(), seen["w"][seen["kind"] == 0].to_numpy()),
                 *toxic_model(docs, labels, doc_id, text, bound))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight from which on documents count as good: the one with the greatest sum of the
    shares of good above and bad below; the middle between neighbours; -inf without both kinds."""
    if not len(good) or not len(bad):
        return -np.inf
    w = np.r_[good, bad]
    order = np.argsort(w, kind="stable")
    is_bad = np.r_[np.zeros(len(good)), np.ones(len(bad))][order]
    gain = np.r_[0, np.cumsum(is_bad / len(bad) - (1 - is_bad) / len(good))]
    s = w[order]
    free = np.r_[True, s[1:] != s[:-1], True]
    at = int(np.flatnonzero(free)[np.argmax(gain[free])])
    return -np.inf if at == 0 else np.inf if at == len(s) else float((s[at - 1] + s[at]) / 2)


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """``doc_id, log_weight, key`` of every document; key is the weight with Gumbel noise, null for
    toxic text."""
    def run(batches):
        for b in sliced(batches, "t"):
            w, key = _scored(b.column(0).to_pylist(), byte_column(b, "t"), model, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w), pa.array(key, from_pandas=True)], names=["doc_id", "log_weight", "key"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(
        run, "doc_id long, log_weight double, key double")


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order."""
    u = x.view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def kth_largest(table: DataFrame, column: str, k: int) -> float:
    """The k-th largest double of a column, exact: four passes fix 16 bits each, by counts of at
    most 65,536 prefixes."""
    def digits(batches):
        for b in batches:
            u = _ordered(b.column(0).to_numpy(zero_copy_only=False) + 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64))], names=["u"])

    bits = table.select(F.col(column)).where(F.col(column).isNotNull()).mapInArrow(digits, "u long")
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        own = bits if shift == 48 else bits.where(F.shiftrightunsigned("u", shift + 16) == F.lit(prefix))
        tops = own.groupBy(F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(0xFFFF)).alias("d")).count().collect()
        for d, n in sorted(tops, reverse=True):
            if left <= n:
                prefix = prefix << 16 | d
                break
            left -= n
    u = np.uint64(prefix)
    back = u ^ np.uint64(1 << 63) if prefix >> 63 else ~u
    return float(np.array([back], np.uint64).view(np.float64)[0])


def sampled_key(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> tuple[DataFrame, float]:
    """All scores (written once) and the least key of the sample of k documents, k being how many
    documents that aren't toxic have at least the weight ``model.cut``."""
    all_ = materialize(scores(docs, model, doc_id, text, seed), "scores")
    k = all_.where((F.col("log_weight") >= model.cut) & F.col("key").isNotNull()).count()
    return all_, kth_largest(all_, "key", k) if k else np.inf


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7,
             buckets: int = BUCKETS, bound: int = LABELLED) -> DataFrame:
    """``doc_id, log_weight, key``: the sampled documents.

    A null or empty text has weight 0; repeated rows share their key and stay or go together;
    an empty table gives an empty result; further columns are ignored. Labels need ``doc_id``,
    ``quality`` and ``toxic``; a document with contradicting labels is in neither sample.
    """
    all_, least = sampled_key(docs, fit(docs, labels, doc_id, text, buckets, bound), doc_id, text, seed)
    return all_.where(F.col("key") >= least)


def kept(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7,
         buckets: int = BUCKETS, bound: int = LABELLED) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``resample`` keeps; no row is shuffled."""
    model = fit(docs, labels, doc_id, text, buckets, bound)
    _, least = sampled_key(docs, model, doc_id, text, seed)
    ids, at = docs.columns.index(doc_id), docs.columns.index(text)

    def run(batches):
        for b in sliced(batches, at):
            texts = [x or b"" for x in b.column(at).cast(pa.binary()).to_pylist()]
            _, key = _scored(b.column(ids).cast(pa.int64()).to_pylist(), texts, model, seed)
            yield b.filter(pa.array(key >= least))

    return docs.mapInArrow(run, docs.schema)
