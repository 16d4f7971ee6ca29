"""The registered ``opN_`` queries: production parameters over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import (chat, crosstokens, leaks, licenses, lines, matrices, maxscore, packing, pseudonyms, resampling, simhash,
                         warc, whitening)
from tempora.llm.common import read

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def tokenizer() -> str:
    """The vocabulary file of the packing queries; a local file on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_license_templates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in the whole text of all documents."""
    return licenses.scan(read(spark, sf_dir, "documents")).drop("spans")


@query("op2_line_templates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines whose templates recur across documents."""
    return lines.dedup_lines(read(spark, sf_dir, "documents"), n_chars="n_chars").select("doc_id", "text", "n_chars")


# Fixed value: what both rows of the conversation -1 say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query("op3_chat_schemas")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as records of several layouts, formatted, and read back from the output."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema)
    out = chat.read_back(chat.formatted(chat.canonical_turns(chat.records_of(turns.unionByName(own)), attached="attached")))
    joined = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_read", "")
    return out.select("conv_id", F.size("turns_read").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                      F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"), "layout")


@query("op4_importance_resampling")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay when all are resampled towards those labelled good."""
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_min_slack_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids by minimum bin slack."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer(), window=4096, end_id=2)


@query("op6_maxscore_top_k")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows by integer inner product for every row whose vec_id is divisible by 20."""
    return maxscore.top_k(read(spark, sf_dir, "embeddings"), k=20, every=20, scale=64).select(
        "query_id", "rank", "vec_id", "score")


def pseudonym_key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms: the session's ``spark.tempora.pseudonymKey``, else a fixed one for
    runs on synthetic tables. A key of over 64 bytes counts by its digest of 64."""
    key = spark.conf.get("spark.tempora.pseudonymKey", "synthetic tables only").encode()
    return key if len(key) <= 64 else hashlib.blake2b(key).digest()


@query("op7_feistel_pseudonyms")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by pseudonyms of the same format."""
    return pseudonyms.pseudonymise(read(spark, sf_dir, "documents"), pseudonym_key(spark)).drop("spans")


@query("op8_best_fit_matrices")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as rows of a token-id matrix of width 2048: the ids, cumulative piece lengths,
    documents and starts of each row, and a checksum of its position ids."""
    out = matrices.packed_matrices(read(spark, sf_dir, "documents"), tokenizer(), window=2048, end_id=2, pad_id=0)
    return out.select("sequence_id", "input_ids", F.crc32("position_ids").alias("positions_crc32"), "cu_seqlens",
                      F.col("doc_ids").alias("doc_id"), "starts")


@query("op9_simhash_golay")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, 4 differing bits."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, bits=4, seed=42)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_seeded_alignment")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, by n-gram seeds and local alignment."""
    return leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "score", "start", "end")


@query("op11_indexed_warc")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back by the index."""
    index, folder = warc.archive_pages(read(spark, sf_dir, "pages"))
    return warc.read_records(index, folder).select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to").alias("refers_to"))


@query("op12_arrow_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by two public vocabularies, aligned by their bytes."""
    import public_tokenizers

    return crosstokens.aligned(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_multiplicity_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened by the covariance of all of them."""
    return whitening.whitened_components(read(spark, sf_dir, "embeddings"), scale=64, shift=1_000_000, components=32)
