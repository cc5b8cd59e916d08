"""Packing by powers of two: no sequence crosses documents, and none is padded.

A document's ids, with an end id, are cut into pieces of the longest length as often as it fits, then into
one piece for each binary digit of the rest, longest first.  A piece is a sequence of its own.  Sequences
are stored as Parquet in one folder for each length, so a trainer takes batches of equal length from one
folder, at as many sequences as fill its budget of tokens.

Plan: one pass without a shuffle.  Every task encodes its documents, cuts the ids of a batch by index (the
pieces are slices of one buffer) and numbers its sequences from its own number on, shifted by 33 bits;
so numbers are unique without a count of what other tasks have.  A lost task is run again with the same rows and numbers.

Ids are stored as little-endian unsigned 32-bit integers, in binary columns; ``token_ids`` reads them.

Edge cases: null and empty texts are one sequence of the end id alone; a null ``doc_id`` is carried; rows
that share an id, or are repeated in full, have sequences of their own (``sequence_id`` tells them apart); an empty table gives an empty result;
texts of any length are cut alike; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finweave.llm import bpe
from finweave.llm.common import clean_text, scratch_path, small_batches, text_pieces

LONGEST, END_ID = 2048, 1
#: Bits of a sequence's number within its task.
TASK_BITS = 33
COLUMNS = "doc_id {}, start long, length long, ids binary, doc_tokens long, sequence_id long"


def cut(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and length of every piece of documents of these lengths, in order."""
    digits = np.arange(longest.bit_length() - 2, -1, -1)
    rest, digit = np.nonzero((lengths[:, None] % longest >> digits) & 1)
    full = np.repeat(np.arange(len(lengths)), lengths // longest)
    owner = np.concatenate([full, rest])
    length = np.concatenate([np.full(len(full), longest, np.int64), np.left_shift(1, digits)[digit]])
    # Stable, so that the full pieces of a document stay before its others.
    order = np.argsort(owner, kind="stable")
    return owner[order], length[order]


def cut_batches(batches: Iterator[pa.RecordBatch], tokenizer_path: str, longest: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the rows of ``COLUMNS``."""
    enc, number = bpe.encoder(tokenizer_path), TaskContext.get().partitionId() << TASK_BITS
    for batch in batches:
        for doc_ids, texts in text_pieces(batch.column("doc_id"), batch.column("text"), bpe.ENCODE_BYTES):
            ids, offsets = enc.encode(texts)
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            tokens = np.diff(offsets) + 1
            owner, length = cut(tokens, longest)
            ends = np.cumsum(length)
            first = np.cumsum(tokens) - tokens
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(np.concatenate([[0], ends]) * 4), pa.py_buffer(ids)])
            columns = [doc_ids.take(pa.array(owner)), pa.array(ends - length - first[owner]), pa.array(length), pieces.cast(pa.binary()), pa.array(tokens[owner]), pa.array(np.arange(number, number + len(length)))]
            number += len(length)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id"])


def token_ids(stored: bytes) -> np.ndarray:
    """Ids of one stored sequence."""
    return np.frombuffer(stored, "<u4")


def pack(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end_id: int = END_ID, out_dir: str | None = None) -> DataFrame:
    """Stores the sequences of ``docs`` (doc_id, text), by length, and returns them as read back: doc_id, start, length, ids, doc_tokens, sequence_id.

    ``longest`` is a power of two of at least 2.  Without ``out_dir`` they stand in a new shared folder.
    """
    if longest < 2 or longest & (longest - 1):
        raise ValueError(f"the longest sequence must be a power of two, not {longest}")
    spark = docs.sparkSession
    schema = COLUMNS.format(dict(docs.dtypes)["doc_id"])
    out_dir = out_dir or scratch_path(spark, "packed")
    with small_batches(spark, bpe.ENCODE_ROWS):
        rows = docs.select("doc_id", clean_text().alias("text")).mapInArrow(lambda it: cut_batches(it, tokenizer_path, longest, end_id), schema)
        rows.write.option("compression", "zstd").option("parquet.enable.dictionary#ids", "false").partitionBy("length").parquet(out_dir)
    return spark.read.schema(schema).parquet(out_dir)


def pack_report(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece, from the stored sequences."""
    rows = pack(docs, tokenizer_path, **options)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
