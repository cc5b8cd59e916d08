"""Token counts with a digest cache.

Each content digest is joined, with the tokenizer file's digest, to a stored table of counts; only
the distinct contents that miss are encoded, and their counts are appended to the table.

Plan: one scan digests the texts (JVM) and keeps narrow rows; the distinct digests are anti-joined
to the cache; one row for each miss brings its text to the encoder (a shuffle of the texts, spread by
digest and id; rows repeated in full bring theirs again, and a batch encodes it once); the narrow rows then join the cache.  Copies cost a digest, not an
encoding, and a hot content costs narrow rows only.

Edge cases: null text counts as empty (0 tokens); repeated rows and ties on ``doc_id`` each get
their row; an empty table gives an empty result; other input columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.llm import bpe
from finweave.llm.common import clean_text, materialize, scratch_path, small_batches, text_pieces

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def content_digest(column: str = "text") -> Column:
    """Digest of the normalised content.  A count depends on every byte, so null is the only thing normalised."""
    return F.unhex(F.sha2(clean_text(column), 256))


def encode_misses(batches: Iterator[pa.RecordBatch], path: str, version: str) -> Iterator[pa.RecordBatch]:
    """(digest, text) to rows of the cache."""
    enc = bpe.encoder(path)
    for batch in batches:
        # Rows repeated in full come together; each content of a batch is encoded once.
        first = pa.table({"digest": batch.column("digest"), "row": np.arange(batch.num_rows)}).group_by("digest").aggregate([("row", "min")])
        batch = batch.take(first.column("row_min").combine_chunks().sort())
        for digests, texts in text_pieces(batch.column("digest"), batch.column("text"), bpe.ENCODE_BYTES):
            counts = pa.array(enc.count(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(texts), pa.string()), digests.cast(pa.binary()), counts], names=["tokenizer", "digest", "n_tokens"])


def update_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, cache_exists: bool) -> DataFrame:
    """Encodes the distinct contents that the cache lacks, appends them, and returns the cache's rows of this tokenizer."""
    spark = docs.sparkSession
    version = bpe.file_digest(tokenizer_path)
    texts = docs.select(F.col("doc_id").cast("string").alias("row_key"), clean_text().alias("text")).withColumn("digest", content_digest())
    # One row stands for each content; the smallest id, so that a rerun picks the same.
    wanted = texts.groupBy("digest").agg(F.min("row_key").alias("row_key"))
    if cache_exists:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).select("digest")
        wanted = wanted.join(known, "digest", "left_anti")
    wanted = wanted.select(F.col("digest").alias("w_digest"), F.col("row_key").alias("w_key"))
    misses = texts.join(wanted.hint("shuffle_hash"), (F.col("digest") == F.col("w_digest")) & F.col("row_key").eqNullSafe(F.col("w_key")), "left_semi").select("digest", "text")
    counted = misses.mapInArrow(lambda it: encode_misses(it, tokenizer_path, version), CACHE_SCHEMA)
    # Rows that share both id and text stood for their content together.
    counted = counted.groupBy("tokenizer", "digest").agg(F.max("n_tokens").alias("n_tokens"))
    with small_batches(spark, bpe.ENCODE_ROWS):
        counted.write.mode("append").option("compression", "zstd").parquet(cache_path)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, cache_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    ``cache_path`` names a Parquet table to reuse and extend; without it a new one is made in the
    shared folder.
    """
    spark = docs.sparkSession
    exists = cache_path is not None and _has_rows(spark, cache_path)
    cache = update_cache(docs, tokenizer_path, cache_path := cache_path or scratch_path(spark, "token-cache"), exists)
    narrow = docs.select("doc_id", F.octet_length(clean_text()).cast("long").alias("n_bytes"), content_digest().alias("digest"))
    # A cache shared by writers that raced may hold a digest twice.  Written, so that the join is of its
    # own and may split a content that very many rows have.
    once = materialize(cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    out = narrow.join(once, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _has_rows(spark, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
