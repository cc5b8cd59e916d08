"""Shared plumbing of the corpus operators: inputs, shared scratch tables, word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path, so any store Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session (tests, notebooks on one machine) may name none and gets a local folder; on a
    cluster that would lose rows, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="finweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/finweave/{tag}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder through Hadoop's file system, whatever the store."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


#: Where the tables that ``materialize`` gave out stand, and the tables written in each open scope.
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scopes: list[list[str]] = []


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage at a table that survives lost executors, and makes later passes over the
    same rows see identical values.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[out] = path
    for scope in _scopes:
        scope.append(path)
    return out


#: Rows that Spark sends to Python at once at most, while a table is written.
ARROW_ROWS = 2_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Smaller Arrow batches for the actions inside: each stands in the JVM and, twice for a while, in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` gave out and nothing reads any more; others are left alone."""
    for df in tables:
        if (path := _tables.pop(df, None)) is not None:
            delete_path(df.sparkSession, path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what ``materialize`` wrote inside, but for the last table, the scope's result."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop()[:-1]:
            delete_path(spark, path)


def free_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, made longer until no column of ``df`` starts with it: names for what joins a caller's rows."""
    taken = {c.lower() for c in df.columns}
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def clean_text(column: str = "text") -> Column:
    """Whole text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unit_hash(*columns: Column, seed: str) -> Column:
    """Reproducible uniform number in [0, 1): 52 bits of an MD5 digest, the same in any SQL engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws("|", F.lit(seed), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def hash_candidates(rows: DataFrame, key: str, most: int, seed: str) -> tuple[DataFrame, Column]:
    """The rows of about ``2 * most`` distinct keys by a threshold on a hash, all if there are fewer, and that hash.

    What is left is bounded whatever the table's size, so that it may be ordered and cut at ``most``.
    """
    u = unit_hash(F.col(key), seed=seed)
    n = rows.agg(F.approx_count_distinct(key).alias("n")).first()["n"]
    return (rows.where(u < 2 * most / n) if n > 2 * most else rows), u


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with their place (from 0) in ``order`` over all of them.

    They are dealt by ranges and ordered within; a place is its range's start and the place in it.  Only one row for
    each range meets in one task.  ``rows`` are read twice (for the ranges' bounds), so they should be written and narrow.
    """
    spark = rows.sparkSession
    at, part = F.col(f"{name}_at"), f"{name}_part"
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    # Numbers a partition's rows from its number shifted by 33 bits on.
    dealt = materialize(dealt.withColumn(f"{name}_at", F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)), "numbered")
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{name}_start")), "numbered-starts")
    return dealt.join(starts, part).withColumn(name, F.col(f"{name}_start") + at.bitwiseAND(F.lit(2**33 - 1))).drop(part, f"{name}_at", f"{name}_start")


def as_large_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Arrow text with 64-bit offsets and nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


#: What ``word_hashes(strip=True)`` takes out of words.
MARK = re.compile(r"[\W_]+")
#: Bytes of text that a Python step takes at once (one text at least): bounds a task's memory.
PIECE_BYTES = 2_000_000


def give_back_memory() -> None:
    """Workers outlive their tasks, and what their allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def _c_library() -> ctypes.CDLL | None:
    """The C library, where it has ``malloc_trim``."""
    try:
        library = ctypes.CDLL(None)
        return library if hasattr(library, "malloc_trim") else None
    except OSError:
        return None


_libc = _c_library()


def text_pieces(keys: pa.Array, texts: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Slices of a batch's keys and texts with a bounded number of bytes; Arrow's free memory goes back after a batch."""
    texts = as_large_text(texts)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at, done = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, done + piece_bytes, "right")))
        yield keys.slice(at, to - at), texts.slice(at, to - at)
        at, done = to, int(ends[to - 1])
    give_back_memory()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an unsigned 64-bit array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, strip: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of a batch, and each text's offsets into them.

    Words are runs between white space; ``strip`` takes all but letters and digits out of each, and
    drops words of which nothing is left.  Every distinct word of the batch is hashed once.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(as_large_text(texts)))
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    encoded = lists.values.dictionary_encode()
    dictionary = encoded.dictionary.to_pylist()
    if strip:
        dictionary = [w if w.isalnum() else MARK.sub("", w) for w in dictionary]
    if not dictionary:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, dictionary), dtype=np.uint64, count=len(dictionary))
    real = np.fromiter(map(bool, dictionary), dtype=bool, count=len(dictionary))
    indices = encoded.indices.to_numpy(zero_copy_only=False)
    kept = real[indices]
    before = np.concatenate([[0], np.cumsum(kept)])
    return hashed[indices[kept]], before[offsets]


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and each text's offsets into them.

    A text of one to ``n - 1`` words has one shingle, all its words; an empty text has none.
    """
    lengths = np.diff(offsets)
    counts = np.where(lengths >= n, lengths - n + 1, (lengths > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(lengths)), counts)
    start = offsets[:-1][owner] + (np.arange(out_offsets[-1]) - out_offsets[:-1][owner])
    end = offsets[1:][owner]
    acc = np.full(len(start), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(n):
        position = start + k
        inside = position < end
        value = np.where(inside, words[np.minimum(position, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else acc
        acc = np.where(inside, mix64((acc ^ value) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)), acc)
    return acc, out_offsets


def fixed_list(values: Sequence[str]) -> Column:
    """Small literal array."""
    return F.array(*[F.lit(v) for v in values])
