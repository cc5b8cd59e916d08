"""Incremental inventory: files that arrive are inspected as a stream and merged into a manifest.

The manifest is a log of rows by merge: each merge writes the rows that are new and those whose status it
changes (a file whose content another one now has under a path that stands before it), and the row with the highest number stands for
its path.  What a merge reads of the manifest are the rows that share a content or a path with its files, however long
ago they came; no watermark ends that.  A repeated micro-batch writes the same folder again.  After
``MERGES`` merges the log is written anew as one.

Where Arrow opens the store, tasks list the tree and append what the manifest lacks, or has with another length or time, to a log of
arrivals; the stream reads that log and its tasks open the files.  So the driver never holds a list of files, which Spark's own
source of files sends it several times in each run.

In other stores the stream's source is Spark's.  There files without bytes are in no split of its readers, and a path that came once does not
come again when its file changes; so each update lists the tree after the stream and merges what the manifest lacks or has otherwise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finweave.functions import ids
from finweave.sources.files import inspect, list_files, mark_duplicates, opens, parse_path, read_contents, relative, scan_files
from finweave.sources import store
from finweave.sources.tables import delete_folder, staged, staging

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
ROW = "relative_path string, company_code string, report_year int, statement_scope string, sha256 string, length long, encoding string, reason string, inventory_status string, notes array<string>, modified timestamp, number long"
ARRIVAL = "relative_path string, path string, length long, modificationTime timestamp"
MERGES = 32
#: Parts of the log of arrivals that one micro-batch takes.
PARTS = 16


def _arriving(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]")
    files = (reader if most is None else reader.option("maxFilesPerTrigger", most)).load(root)
    decoded = F.try_url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    return files.withColumn("relative_path", relative(decoded, root))


def _inspected(files: DataFrame) -> DataFrame:
    rows = inspect(files).withColumns(parse_path(F.col("relative_path")))
    return rows.withColumn("reason", F.coalesce("path_issue", "decode_issue"))


def stream_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path parts, size, sha256, encoding, issue) of every file as it arrives."""
    rows = _inspected(_arriving(spark, root))
    return rows.select(ids.document_id(F.col("sha256")).alias("doc_id"), "relative_path", "company_code", "report_year", "statement_scope", "sha256", F.col("length").alias("file_size_bytes"), "encoding", "reason", "modificationTime")


def start_inventory(spark: SparkSession, root: str, out: str, checkpoint: str):
    """Appends new files' rows to a Parquet table until no more are there; exactly once by the sink's log.  Files without bytes are not among them."""
    return stream_files(spark, root).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_manifest_log(spark: SparkSession, manifest: str, but: str | None = None) -> DataFrame:
    """Every path's standing row; without those of one merge."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{manifest}/log")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], ROW)
    rows = spark.read.schema(f"{ROW}, merge string").parquet(f"{manifest}/log")
    rows = rows.where(F.col("merge") != F.lit(but or ""))
    last = Window.partitionBy("relative_path").orderBy(F.col("number").desc())
    return rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "merge")


def merge_files(spark: SparkSession, files: DataFrame, manifest: str, merge: str) -> None:
    """Merges files (relative_path, length, content, modificationTime) into the manifest under a merge's name; the same name again replaces what it wrote."""
    with staging(spark):
        files = files.withColumn("modified", F.date_trunc("MILLISECOND", "modificationTime"))
        new = staged(_inspected(files).select("relative_path", "company_code", "report_year", "statement_scope", "sha256", "length", "encoding", "reason", "modified"), "arrived")
        standing = staged(read_manifest_log(spark, manifest, but=merge), "standing")
        number = (standing.agg(F.max("number")).first()[0] or 0) + 1
        before = standing.join(new.select("relative_path"), "relative_path", "left_semi").select("sha256")
        contents = staged(new.select("sha256").unionByName(before).distinct(), "contents")
        kept = standing.join(new.select("relative_path"), "relative_path", "left_anti").join(contents, "sha256", "left_semi")
        rows = new.unionByName(kept.select(*new.columns))
        good = mark_duplicates(rows.where("reason IS NULL")).drop("primary_path")
        bad = rows.where("reason IS NOT NULL").withColumns({"inventory_status": F.lit(None).cast("string"), "notes": F.array().cast("array<string>")})
        was = standing.select("relative_path", F.struct("sha256", "inventory_status", "notes", "modified").alias("was"))
        changed = good.unionByName(bad).join(was, "relative_path", "left").where(~F.struct("sha256", "inventory_status", "notes", "modified").eqNullSafe(F.col("was"))).drop("was")
        changed.withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{manifest}/log/merge={merge}")
        # The scope's last table is kept; nothing reads this one.
        staged(spark.range(0), "merged")


def compact(spark: SparkSession, manifest: str, most: int = MERGES) -> None:
    """Writes the log anew as one merge where it has more than ``most``; if that breaks off, rows stand twice and the standing ones are the same."""
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{manifest}/log")
    fs = log.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath().toString() for f in fs.listStatus(log)] if fs.exists(log) else []
    if len(old) > most:
        read_manifest_log(spark, manifest).write.parquet(f"{manifest}/log/merge=c-{uuid.uuid4().hex}")
        for path in old:
            delete_folder(spark, path)


def _missing(spark: SparkSession, root: str, manifest: str) -> DataFrame:
    """Listed files that the manifest lacks or has with another length or time."""
    known = read_manifest_log(spark, manifest).select("relative_path", "length", F.col("modified").alias("_time"))
    listed = list_files(spark, root)
    same = [listed[c] == known[c] for c in ("relative_path", "length")] + [F.date_trunc("MILLISECOND", "modificationTime") == F.col("_time")]
    return staged(listed.join(known, same, "left_anti"), "left-files")


def _merged(stream: DataFrame, checkpoint: str, merge) -> None:
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def land(missing: DataFrame, log: str, most: int | None) -> None:
    """Appends files to the log of arrivals in parts of which ``PARTS``, or ``most`` if that is less, hold at most ``most`` files."""
    count = missing.count()
    per = max(1, most // PARTS) if most else -(-count // PARTS)
    if count:
        # A quarter more parts than needed, as they come out a little uneven.
        missing.select("relative_path", "path", "length", "modificationTime").repartition(-(-count * 5 // (per * 4))).write.option("maxRecordsPerFile", per).mode("append").parquet(log)


def _arrivals(spark: SparkSession, log: str, most: int | None) -> DataFrame:
    reader = spark.readStream.schema(ARRIVAL)
    return (reader if most is None else reader.option("maxFilesPerTrigger", min(most, PARTS))).parquet(log)


def _arrived(batch: DataFrame) -> DataFrame:
    """Contents of a micro-batch's files, each once, by what was listed last; a file that has gone since is left out."""
    last = batch.groupBy("relative_path").agg(F.max(F.struct("modificationTime", "length", "path")).alias("last"))
    return read_contents(last.select("relative_path", "last.*"), gone=True)


def update_inventory(spark: SparkSession, root: str, manifest: str, checkpoint: str, most: int | None = None) -> None:
    """Brings a manifest up to date with what has arrived below ``root``, in micro-batches of at most ``most`` files."""
    merge = lambda read, name: lambda files, number: merge_files(files.sparkSession, read(files).select("relative_path", "length", "content", "modificationTime"), manifest, f"{name}-{number:09d}")
    if opens(root):
        log = f"{manifest.rstrip('/')}/arrivals"
        land(_missing(spark, root, manifest), log, most)
        if store.exists(spark, log):
            _merged(_arrivals(spark, log, most), f"{checkpoint}/arrivals", merge(_arrived, "a"))
    else:
        _merged(_arriving(spark, root, most), checkpoint, merge(lambda files: files, "s"))
        left = _missing(spark, root, manifest)
        if not left.isEmpty():
            read = scan_files(spark, root).select("relative_path", "content").join(left.drop("path"), "relative_path")
            merge_files(spark, read, manifest, f"l-{uuid.uuid4().hex}")
    compact(spark, manifest)


def streamed_inventory(spark: SparkSession, manifest: str) -> tuple[DataFrame, DataFrame]:
    """(documents, issues) as ``build_inventory`` gives them, from the manifest."""
    rows = read_manifest_log(spark, manifest)
    issues = rows.where("reason IS NOT NULL").select("relative_path", F.col("length").alias("file_size_bytes"), "sha256", "reason")
    documents = rows.where("reason IS NULL").select(ids.document_id(F.col("sha256")).alias("doc_id"), "relative_path", "company_code", "report_year", "statement_scope", "sha256", F.col("length").alias("file_size_bytes"), "encoding", "inventory_status", "notes")
    return documents, issues


def start_first_seen(spark: SparkSession, root: str, out: str, checkpoint: str):
    """As ``start_inventory``, but of files with equal content that arrive within a day only the first one's row."""
    return first_seen(stream_files(spark, root)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(files: DataFrame) -> DataFrame:
    """Stateful deduplication by content: the first row of each digest within the watermark's memory."""
    return files.withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["sha256"])
