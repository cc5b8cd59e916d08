"""Importance resampling towards a target corpus, by hashed n-grams.

Features are runs of words, counted in ``buckets`` hash buckets over the documents and over the target.
A bucket's gain is the scaled logarithm of how much more of the target than of the documents it holds; a
document's weight is the mean gain of its features, and with Gumbel noise from a digest of its id the highest
scores are a draw without replacement in proportion to the weights.

Two passes read the texts, as Arrow batches.  In the first every task sums ``np.bincount`` into one vector
of ``buckets`` counts, and ``treeReduce`` merges the tasks' vectors, so that the driver gets one of a fixed
size.  In the second the gains, of the same fixed size, are broadcast, and ``np.bincount`` sums them by
document.  What follows are narrow rows: they are ordered by ranges of the score and numbered within each,
so that no task holds the draw, whatever its size.

Edge cases: null and empty texts have no features and weight 0; a null id counts as empty in the digest and
stands last among ties; rows of one id have the same noise and ranks of their own (ties in order of features and
weight, then of a digest of the row); without enough documents nothing is drawn; an empty target or an empty table are allowed;
no other columns are carried by ``importance_scores``, all by ``resample``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.llm.common import as_large_text, clean_text, give_back_memory, materialize, numbered, small_batches, text_pieces
from finweave.llm.mixing import copies_of, row_digest

BUCKETS = 10_000
MAX_WORDS, MIN_WORDS, PERCENT, SEED, SCALE = 1, 20, 10, 2024, 1000
#: Vectors that one merge gets, about.
MERGED = 16
#: Distinct features that a worker remembers the buckets of.
REMEMBERED = 500_000


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """What each byte becomes: ASCII letters in lower case, digits and bytes from 128 on themselves, all others a space."""
    table = np.full(256, 32, np.uint8)
    for first, last, to in (("0", "9", "0"), ("a", "z", "a"), ("A", "Z", "a")):
        codes = np.arange(ord(first), ord(last) + 1)
        table[codes] = codes - ord(first) + ord(to)
    table[128:] = np.arange(128, 256)
    return table


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts, one after another, and each text's offsets into them."""
    texts = as_large_text(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_folded()[data]))
    lists = pc.ascii_split_whitespace(folded)
    real = np.asarray(pc.greater(pc.binary_length(lists.values), 0).to_numpy(zero_copy_only=False), bool)
    before = np.concatenate([[0], np.cumsum(real)])
    return lists.values.filter(pa.array(real)), before[np.asarray(lists.offsets, np.int64)]


class Buckets:
    """Buckets of the features of texts; a feature met before is looked up."""

    def __init__(self, buckets: int, max_words: int) -> None:
        self.buckets, self.max_words, self.known = buckets, max_words, {}

    def _numbers(self, features: pa.Array) -> np.ndarray:
        encoded = features.dictionary_encode()
        known, distinct = self.known, encoded.dictionary.cast(pa.large_binary()).to_pylist()
        if len(known) > REMEMBERED:
            known.clear()
        numbers = list(map(known.get, distinct))
        for i, n in enumerate(numbers):
            if n is None:
                numbers[i] = known[distinct[i]] = zlib.crc32(distinct[i]) % self.buckets
        return np.array(numbers, np.int64)[encoded.indices.to_numpy(zero_copy_only=False)] if distinct else np.zeros(0, np.int64)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all features, the text that each is of, and each text's number of words."""
        words, offsets = words_of(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        numbers, owners = [self._numbers(words)], [owner]
        for n in range(2, self.max_words + 1):
            start = np.flatnonzero(np.arange(len(words)) + n <= offsets[1:][owner])
            runs = [words.take(pa.array(start + k)) for k in range(n)]
            numbers.append(self._numbers(pc.binary_join_element_wise(*runs, pa.scalar(" ", words.type))))
            owners.append(owner[start])
        return np.concatenate(numbers), np.concatenate(owners), np.diff(offsets)


def count_batches(batches: Iterator[pa.RecordBatch], buckets: int, max_words: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """A task's texts to one row: the counts of all buckets, and behind them the number of texts with enough words."""
    total, hashed = np.zeros(buckets + 1, np.int64), Buckets(buckets, max_words)
    for batch in batches:
        for _, texts in text_pieces(batch.column("text"), batch.column("text")):
            numbers, _, words = hashed.of(texts)
            total[:-1] += np.bincount(numbers, minlength=buckets)
            total[-1] += np.count_nonzero(words >= min_words)
    yield pa.RecordBatch.from_pydict({"counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS) -> tuple[np.ndarray, int]:
    """Counts of all features of ``docs`` (text) by bucket, and the number of documents with at least ``min_words`` words."""
    with small_batches(docs.sparkSession):
        rows = docs.select(clean_text().alias("text")).mapInArrow(lambda it: count_batches(it, buckets, max_words, min_words), "counts binary").rdd
        if not (tasks := rows.getNumPartitions()):
            return np.zeros(buckets, np.int64), 0
        # So deep that a merge, the driver's too, gets few vectors however many tasks there are.
        depth = max(2, ceil(log(tasks, MERGED)))
        total = rows.map(lambda row: np.frombuffer(row[0], "<i8")).treeReduce(np.add, depth)
    return total[:-1], int(total[-1])


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """What a feature in each bucket adds: ``SCALE`` times the logarithm of its share of the target over that of the documents, counts smoothed by one."""
    n, all_docs, all_target = len(of_docs), int(of_docs.sum()), int(of_target.sum())
    share = lambda t, s: float(t + 1) * float(all_docs + n) / (float(s + 1) * float(all_target + n))
    return np.array([floor(SCALE * log(share(t, s))) for t, s in zip(of_target.tolist(), of_docs.tolist())], np.int64)


def weigh_batches(batches: Iterator[pa.RecordBatch], gain: np.ndarray, max_words: int) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, text) to key, doc_id, n_words, n_features, weight."""
    hashed = Buckets(len(gain), max_words)
    for batch in batches:
        at = 0
        for keys, texts in text_pieces(batch.column("key"), batch.column("text")):
            numbers, owner, words = hashed.of(texts)
            n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
            # Sums of whole numbers below 2**53 are exact in doubles.
            total = np.bincount(owner, weights=gain[numbers], minlength=len(texts)).astype(np.int64)
            columns = [keys, batch.column("doc_id").slice(at, len(texts)), *(pa.array(x, pa.int64()) for x in (words, n, total // np.maximum(n, 1)))]
            at += len(texts)
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "n_words", "n_features", "weight"])
    give_back_memory()


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in units of ``1 / SCALE``, from the first 32 bits of a digest of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored_rows(docs: DataFrame, target: DataFrame, key: Column, buckets: int = BUCKETS, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """key, doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text); the rank of what is not drawn is null."""
    spark = docs.sparkSession
    of_docs, n_eligible = bucket_counts(docs, buckets, max_words, min_words)
    of_target, _ = bucket_counts(target, buckets, max_words, min_words)
    sent = spark.sparkContext.broadcast(gains(of_docs, of_target))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(key.alias("key"), "doc_id", clean_text().alias("text"))
    rows = rows.mapInArrow(lambda it: weigh_batches(it, sent.value, max_words), f"key long, doc_id {kind}, n_words long, n_features long, weight long")
    rows = materialize(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance-scores")
    drawn = n_eligible * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("key")]
    in_order = numbered(rows.where(F.col("n_words") >= min_words), "place", *order)
    out = ["key", "doc_id", "n_features", "weight", "score"]
    ranked = in_order.select(*out, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return ranked.unionByName(rows.where(F.col("n_words") < min_words).select(*out, F.lit(None).cast("long").alias("rank")))


def importance_scores(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank (in order of the draw, null where not drawn) of every row of ``docs`` (doc_id, text)."""
    return scored_rows(docs, target, F.lit(0).cast("long"), **options).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns."""
    rows = scored_rows(docs, target, row_digest(docs), **options)
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count("rank").alias("copies")).where("copies > 0")
    return copies_of(docs, copies)
