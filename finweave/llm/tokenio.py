"""Token ids in binary shards with Elias-Fano document boundaries.

A shard file is: magic, the concatenated ids in 16 or 32 bits (what the vocabulary needs), the
Elias-Fano coded document ends, the Elias-Fano coded document ids, and a footer of fixed size.  A
reader takes the footer, then any document by two boundary lookups; there is no 64-bit table.

Documents are dealt to shards by ranges of ``doc_id`` (then of the text's digest) and sorted within, so shards in order hold
the corpus in ascending ``doc_id``.  Each task writes its shard under a temporary name in the shared
folder and renames it; there are as many as shuffle partitions, more where a shard would take over ``SHARD_BYTES``; a lost or repeated task writes the same bytes to the same name.  The driver
keeps one row for each shard.

Edge cases: ids are whole numbers; null text is a document of only the end id; a null ``doc_id`` stands before all others
and is read back as null; rows that share an id are ordered by a
digest of the text, then by the text; an empty table writes no shard
and reads back as an empty table; other columns are not carried.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.llm import bpe
from finweave.llm.common import clean_text, scratch_path, shuffle_partitions, small_batches, text_pieces
from finweave.llm.eliasfano import EliasFano, encode

MAGIC = b"FWTOKEN1"
#: id width in bytes, documents, null document ids, ids, bytes of the ends, bytes of the document ids
FOOTER = struct.Struct("<BxxxxxxxQQQQQ8s")
#: Bytes of text that one shard takes about: a task keeps its documents' lengths and ids.
SHARD_BYTES = 2**29
#: Documents read back at once.
CHUNK_DOCS = 4096
SHARD_SCHEMA = "shard int, path string, n_docs long, n_ids long, n_bytes long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def write_shard(batches: Iterator[pa.RecordBatch], out_dir: str, tokenizer_path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Encodes a task's documents in their order into one file."""
    shard = TaskContext.get().partitionId()
    enc = bpe.encoder(tokenizer_path)
    dtype = np.dtype("<u2") if max(enc.vocab_size - 1, end_id) < 2**16 else np.dtype("<u4")
    fs, root = _open(out_dir)
    name, temp = f"{root}/{shard:06d}.tok", f"{root}/.{shard:06d}.{uuid.uuid4().hex}"
    out, lengths, keys, nulls = None, [], [], 0
    for batch in batches:
        for doc_ids, texts in text_pieces(batch.column("doc_id"), batch.column("text"), bpe.ENCODE_BYTES):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(temp)
                out.write(MAGIC)
            ids, offsets = enc.encode(texts)
            ids = np.insert(ids, offsets[1:], end_id)
            out.write(ids.astype(dtype).tobytes())
            lengths.append(np.diff(offsets) + 1)
            nulls += doc_ids.null_count
            keys.append(doc_ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
    if out is None:
        return
    ends = np.cumsum(np.concatenate(lengths))
    tables = encode(ends), encode(np.concatenate(keys))
    for t in tables:
        out.write(t)
    out.write(FOOTER.pack(dtype.itemsize, len(ends), nulls, int(ends[-1]), len(tables[0]), len(tables[1]), MAGIC))
    out.close()
    fs.move(temp, name)
    size = len(MAGIC) + int(ends[-1]) * dtype.itemsize + sum(map(len, tables)) + FOOTER.size
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{out_dir}/{shard:06d}.tok"], "n_docs": [len(ends)], "n_ids": [int(ends[-1])], "n_bytes": [size]})


class TokenShard:
    """One shard file, read by ranges."""

    def __init__(self, path: str) -> None:
        fs, inner = _open(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        self.width, self.n_docs, self.n_null, self.n_ids, ends, keys, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        at = size - FOOTER.size - ends - keys
        self.ends = EliasFano(self.file.read_at(ends, at))
        self.keys = EliasFano(self.file.read_at(keys, at + ends))

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Start of document ``a``, then the ends of documents ``a`` to ``b - 1``."""
        if a == 0:
            return np.concatenate([[0], self.ends.slice(0, b)])
        return self.ends.slice(a - 1, b)

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        known = self.keys.slice(max(0, a - self.n_null), max(0, b - self.n_null))
        return [None] * (b - a - len(known)) + known.tolist()

    def ids(self, begin: int, end: int) -> np.ndarray:
        data = self.file.read_at((end - begin) * self.width, len(MAGIC) + begin * self.width)
        return np.frombuffer(data, np.dtype(f"<u{self.width}"))

    def document(self, i: int) -> np.ndarray:
        begin, end = self.bounds(i, i + 1)
        return self.ids(int(begin), int(end))


def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, base) to a row for each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            shard = TokenShard(path)
            for a in range(0, shard.n_docs, CHUNK_DOCS):
                b = min(a + CHUNK_DOCS, shard.n_docs)
                bounds = shard.bounds(a, b)
                crcs = []
                for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    crcs.append(zlib.crc32(shard.ids(begin, end).astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(a, b), pa.int64()), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], schema=schema)


def write_token_shards(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = 2, num_shards: int | None = None) -> list[dict]:
    """Writes ``docs`` (doc_id, text) and returns the shards in order; the driver holds only these rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text().alias("text"))
    # Rows of one id, or of none, are dealt on by their text's digest, so no id fills a shard alone.
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("text")]
    rows = rows.withColumn("digest", F.xxhash64("text"))
    if num_shards is None:
        n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        num_shards = max(shuffle_partitions(spark), -(-n_bytes // SHARD_BYTES))
    dealt = rows.repartitionByRange(num_shards, *order[:2]).sortWithinPartitions(*order).drop("digest")
    with small_batches(spark, bpe.ENCODE_ROWS):
        shards = dealt.mapInArrow(lambda it: write_shard(it, out_dir, tokenizer_path, end_id), SHARD_SCHEMA).collect()
    return [r.asDict() for r in sorted(shards, key=lambda r: r["shard"])]


def read_token_shards(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    base, rows = 0, []
    for s in shards:
        rows.append((s["path"], base))
        base += s["n_ids"]
    listed = spark.createDataFrame(rows, "path string, base long")
    if rows:
        listed = listed.repartition(len(rows))
    return listed.mapInArrow(read_shards, READ_SCHEMA)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, out_dir: str | None = None) -> DataFrame:
    """Writes the shards (to a new shared folder unless one is named) and reads every document back."""
    spark = docs.sparkSession
    out_dir = out_dir or scratch_path(spark, "token-shards")
    if "://" not in out_dir and not out_dir.startswith("/"):
        out_dir = out_dir.replace("file:", "", 1)
    return read_token_shards(spark, write_token_shards(docs, tokenizer_path, out_dir, end_id))
