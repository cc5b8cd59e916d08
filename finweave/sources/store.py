"""Small steps on a shared store through Hadoop's file system, so any store that Spark reads will do."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    """The path and its file system on the JVM; a local one without checksum files, which other programs do not keep up."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return where, fs.getRaw() if fs.getUri().getScheme() == "file" else fs


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; no folder is no names."""
    where, fs = _at(spark, path)
    found = fs.listStatus(where) if fs.exists(where) else []
    return sorted(f.getPath().getName() for f in found if not f.getPath().getName().endswith(".crc"))


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file."""
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def ends(spark: SparkSession, path: str, count: int) -> tuple[bytes, bytes]:
    """The first and the last few bytes of a file of any size."""
    where, fs = _at(spark, path)
    size = fs.getFileStatus(where).getLen()
    stream = fs.open(where)
    try:
        first = [stream.read() for _ in range(min(count, size))]
        stream.seek(max(0, size - count))
        return bytes(first), bytes([stream.read() for _ in range(min(count, size))])
    finally:
        stream.close()


def sha256(spark: SparkSession, path: str) -> str:
    """Digest of a file of any size, read as a stream."""
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Puts ``new`` in the place of ``path``: what stands there is moved aside first, and back if that fails."""
    (target, fs), (source, _) = _at(spark, path), _at(spark, new)
    aside, _ = _at(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}.old")
    if not fs.exists(source):
        raise OSError(f"{new} is not there")
    moved = fs.exists(target) and fs.rename(target, aside)
    if not fs.rename(source, target):
        if moved:
            fs.rename(aside, target)
        raise OSError(f"{new} cannot be moved to {path}")
    if moved:
        fs.delete(aside, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, written beside its place and moved there whole."""
    temp = f"{path}.{uuid.uuid4().hex}"
    where, fs = _at(spark, temp)
    try:
        out = fs.create(where, True)
        out.write(bytearray(data))
        out.close()
        replace(spark, temp, path)
    finally:
        fs.delete(where, True)


def write_lines(rows: DataFrame, path: str, head: bytes = b"") -> None:
    """One file of a table's only column, a line for each row in the table's order, after ``head``.

    Tasks write parts; the JVM copies these into one file as a stream, so no row comes to the driver's
    memory.
    """
    spark = rows.sparkSession
    parts, temp = f"{path}.{uuid.uuid4().hex}.parts", f"{path}.{uuid.uuid4().hex}"
    where, fs = _at(spark, temp)
    try:
        rows.write.text(parts, lineSep="\n")
        out = fs.create(where, True)
        out.write(bytearray(head))
        for name in names(spark, parts):
            if name.startswith("part-"):
                part = fs.open(_at(spark, f"{parts}/{name}")[0])
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                part.close()
        out.close()
        replace(spark, temp, path)
    finally:
        delete(spark, parts)
        fs.delete(where, True)
