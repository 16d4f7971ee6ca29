"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Hands rows to Python in batches of at most 4 MB, unless the session sets another bound than
    Spark's own of 64 MB: executors hold several batches at once outside their heap."""
    if spark.conf.get(ARROW_BYTES) == "67108864b":
        spark.conf.set(ARROW_BYTES, "4m")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, for a session with bounded batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SLICE_BYTES = 2 << 20  # of text that a task handles at once, or one longer text


def sliced(batches: Iterator[pa.RecordBatch], column: int | str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes in a text column (or one row), so that a
    task's memory follows that bound and not the rows of a batch."""
    for b in batches:
        at = b.schema.get_field_index(column) if isinstance(column, str) else column
        size = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end, i = np.cumsum(size), 0
        while i < b.num_rows:
            before = int(end[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(end, before + most, "right")))
            yield b.slice(i, j - i)
            i = j


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null reads as the empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with a function batch -> dict of columns in the order of ``schema``. Batches with
    a text column ``t`` come in slices of at most ``most`` bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(iter([whole]), "t", most) if "t" in whole.schema.names else [whole]:
                if not b.num_rows:
                    continue
                out = fn(b)
                cols = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type)
                        for f in arrow]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.mapInArrow(run, schema)


BLOCK = 1 << 20  # bytes hashed at once; a longer token is hashed on its own
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i up to a block."""
    if not _POWERS:
        with np.errstate(over="ignore"):
            for k, p in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                _POWERS[k] = np.cumprod(np.r_[np.uint64(1), np.full(BLOCK, p, np.uint64)])
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def token_hashes(buf: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every token of ``buf``.

    ``classes`` maps a byte to its class; class 0 separates, and a token is a maximal run of one
    other class. The hash is a polynomial over the bytes, from prefix sums, then mixed; equal
    tokens have equal hashes wherever they stand.
    """
    a = np.frombuffer(buf, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = classes[a]
    edge = np.flatnonzero(c[1:] != c[:-1]) + 1
    start, end = np.r_[0, edge], np.r_[edge, len(a)]
    keep = c[start] != 0
    start, end = start[keep], end[keep]
    h = np.zeros(len(start), np.uint64)
    up, down = _powers()
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + BLOCK, "right"))
        if j == i:
            h[i] = xxhash.xxh64_intdigest(buf[start[i]:end[i]])
            i += 1
            continue
        part = a[start[i]:end[j - 1]].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            s = np.r_[np.uint64(0), np.cumsum(part * up[: len(part)])]
            x, y = start[i:j] - start[i], end[i:j] - start[i]
            h[i:j] = mix((s[y] - s[x]) * down[x])
        i = j
    return h, start, end


def slices(texts: list[bytes], classes: np.ndarray, most: int = BLOCK) -> Iterator[tuple]:
    """(first text, number of texts, hashes, text number in the slice) for slices of the texts."""
    at = 0
    while at < len(texts):
        n, size = at, 0
        while n < len(texts) and (n == at or size + len(texts[n]) < most):
            size += len(texts[n]) + 1
            n += 1
        ends = np.cumsum([len(t) + 1 for t in texts[at:n]])
        h, start, _ = token_hashes(b"\n".join(texts[at:n]), classes)
        yield at, n - at, h, np.searchsorted(ends, start, "right")
        at = n


def combine(*parts: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of hash arrays."""
    h = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for x in parts:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(1))
    return h


def byte_classes(kinds: dict[int, int] | None = None, rest: int = 1) -> np.ndarray:
    c = np.full(256, rest, np.uint8)
    for b, k in (kinds or {}).items():
        c[b] = k
    return c


SALTS = 16


def salted_join(rows: DataFrame, few: DataFrame, key: str, spread: list[str], how: str) -> DataFrame:
    """``rows`` joined with ``few``, one row a key, on the key and a salt from the columns ``spread``,
    so the rows of one common key are dealt to several tasks."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    each = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(each, [key, "__salt"], how).drop("__salt")


SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def like_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order."""
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
