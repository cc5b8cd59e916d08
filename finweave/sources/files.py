"""The corpus tree as rows: inventory, first-seen duplicates, verified texts.

Listings are made by tasks, folder by folder, where Arrow opens the store, and tasks open the listed files themselves, so no
name comes to the driver and a task reads many small files.  Elsewhere ``binaryFile`` reads files where they are, and Spark's own
index of the tree is the only list of files that the driver holds.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.functions import ids
from finweave.functions.text import strip_accents
from finweave.sources.tables import staged

BOM = "EFBBBF"
YEARS = (1900, 2100)
#: Bytes of contents after which a batch of files goes on.
HELD = 1 << 22


def relative(path: Column, root: str) -> Column:
    """What stands behind the root in a decoded file URI."""
    base = F.lit(root.rstrip("/").split("://")[-1].removeprefix("file:"))
    plain = F.regexp_replace(path, r"^[a-z0-9]+:/*(?=/)", "")
    return F.substring(plain, F.instr(plain, base) + F.length(base) + 1, F.lit(2**31 - 1))


def _text_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").load(root)


def _decoded(path: Column) -> Column:
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _arrow_uri(root: str) -> str | None:
    """The root as a URI that Arrow opens, or null for other stores."""
    uri = root if "://" in root else f"file://{os.path.abspath(root.removeprefix('file:'))}"
    try:
        pyarrow.fs.FileSystem.from_uri(quote(uri, safe="/:@%+"))
    except (pa.ArrowInvalid, OSError):
        return None
    return uri.rstrip("/")


def opens(root: str) -> bool:
    """Whether tasks can open files below ``root`` themselves."""
    return _arrow_uri(root) is not None


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path) of folders to what stands in them: path, is_folder, length, modificationTime."""
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            fs, inner = pyarrow.fs.FileSystem.from_uri(uri)
            found = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if f.type in (pyarrow.fs.FileType.File, pyarrow.fs.FileType.Directory)]
            paths = [f"{uri}/{quote(f.base_name)}" for f in found]
            folders = [f.type == pyarrow.fs.FileType.Directory for f in found]
            times = [None if d else f.mtime for f, d in zip(found, folders)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_()), pa.array([f.size or 0 for f in found], pa.int64()), pa.array(times, pa.timestamp("us", "UTC"))], names=["path", "is_folder", "length", "modificationTime"])


def walk(spark: SparkSession, uri: str) -> DataFrame:
    """path (a URI), length, modificationTime of all files below a folder: tasks list its folders, level by level; no name comes to the driver."""
    level = spark.createDataFrame([(quote(uri, safe="/:@%+"),)], "path string")
    files = None
    while True:
        found = level.repartition("path").mapInArrow(_list_folders, "path string, is_folder boolean, length long, modificationTime timestamp")
        found = staged(found, "listed")
        here = found.where("NOT is_folder").drop("is_folder")
        files = here if files is None else files.unionByName(here)
        level = found.where("is_folder").select("path")
        if level.isEmpty():
            return files


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, path (a URI), length, modificationTime of every .txt below ``root``, any case of the suffix.

    In stores that Arrow does not open, Spark's index is the list; its readers leave files without bytes out of their
    splits, and these are what the index has besides.
    """
    key = lambda c: relative(_decoded(F.col(c)), root)
    if (uri := _arrow_uri(root)) is not None:
        found = walk(spark, uri).where(F.lower("path").endswith(".txt"))
        return found.select(relative(_decoded(F.col("path")), uri).alias("relative_path"), "path", "length", "modificationTime")
    files = _text_files(spark, root)
    seen = files.where("length > 0").select("path", "length", "modificationTime")
    every = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string")
    listed = every.select("path", key("path").alias("relative_path"))
    sized = seen.select(key("path").alias("relative_path"), "length", "modificationTime")
    return listed.join(sized, "relative_path", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long")))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, length, content, modificationTime of every .txt below ``root``; a file that cannot be read fails the job."""
    if opens(root):
        return read_contents(list_files(spark, root)).select("relative_path", "length", "content", "modificationTime")
    files = _text_files(spark, root).where("length > 0").select(relative(_decoded(F.col("path")), root).alias("relative_path"), "length", "content", "modificationTime")
    empty = list_files(spark, root).where("length = 0").select("relative_path", "length", F.lit(b"").alias("content"), "modificationTime")
    return files.unionByName(empty)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, length, content, read_issue of every .txt; where a store is known to Arrow, a file that cannot be read is an issue."""
    if _arrow_uri(root) is None:
        return scan_files(spark, root).withColumn("read_issue", F.lit(None).cast("string"))
    listed = list_files(spark, root).select("path", "relative_path")
    read = read_listed(listed, "relative_path")
    return read.withColumn("length", F.coalesce(F.octet_length("content").cast("long"), F.lit(0).cast("long")))


def parse_path(path: Column) -> dict[str, Column]:
    """Ticker, year and scope of ``ticker/year/document/file.txt``, and why a path is none."""
    parts = F.split(path, "/")
    at = lambda k: F.get(parts, F.lit(k))
    year = at(1).try_cast("int")
    name = F.lower(F.concat_ws("/", at(2), at(3)))
    scope = F.when(F.contains(name, F.lit("consolidated")), "consolidated").when(F.contains(name, F.lit("separate")), "separate").when(F.contains(name, F.lit("aggregated")), "aggregated").otherwise("other")
    why = (
        F.when(F.size(parts) != 4, F.lit("path must have four parts"))
        .when(~at(0).rlike("^[A-Za-z0-9]{2,10}$"), F.lit("invalid ticker"))
        .when(~at(1).rlike("^[0-9]{4}$") | ~year.between(*YEARS), F.lit("invalid year"))
        .when(~F.lower(at(3)).endswith(".txt"), F.lit("not a text file"))
    )
    return {"company_code": F.upper(at(0)), "report_year": year, "statement_scope": scope, "path_issue": why}


def inspect(files: DataFrame) -> DataFrame:
    """Adds sha256, encoding and decode_issue of (content); no content is none of them."""
    marked = F.hex(F.substring("content", 1, 3)) == BOM
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.withColumns({"sha256": F.sha2("content", 256), "encoding": F.when(marked, "utf-8-sig").otherwise("utf-8"), "decode_issue": F.when(~valid, F.lit("invalid UTF-8"))})


def mark_duplicates(files: DataFrame) -> DataFrame:
    """Adds inventory_status and notes: empty, ready (first path of its content) or duplicate.

    The first path comes from a minimum by content that is joined back, so a content that a third of
    all files share is no window's burden.
    """
    order = F.struct(F.lower("relative_path").alias("folded"), F.col("relative_path").alias("path"))
    first = files.where(F.col("length") > 0).groupBy("sha256").agg(F.min(order).alias("first")).select("sha256", F.col("first.path").alias("primary_path"))
    rows = files.join(first, "sha256", "left")
    status = F.when(F.col("length") == 0, "empty").when(F.col("relative_path") == F.col("primary_path"), "ready").otherwise("duplicate")
    rows = rows.withColumn("inventory_status", status)
    notes = F.when(F.col("inventory_status") == "duplicate", F.array(F.concat(F.lit("duplicate_of="), "primary_path"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("notes", notes)


def build_inventory(spark: SparkSession, root: str, repo_id: str = "local", revision: str = "snapshot") -> tuple[DataFrame, DataFrame]:
    """(documents, issues) of a corpus tree in order of folded path; files that cannot be read are issues."""
    rows = inspect(read_files(spark, root)).withColumns(parse_path(F.col("relative_path")))
    reason = F.coalesce("path_issue", "read_issue", "decode_issue")
    # Contents are read once; what is kept is narrow.
    rows = staged(rows.withColumn("reason", reason).drop("content", "path"), "inspected")
    unread = F.col("read_issue").isNotNull()
    none = lambda c: F.when(~unread, F.col(c))
    issues = rows.where("reason IS NOT NULL").select("relative_path", none("length").alias("file_size_bytes"), none("sha256").alias("sha256"), "reason")
    good = mark_duplicates(rows.where("reason IS NULL"))
    documents = good.select(ids.document_id(F.col("sha256")).alias("doc_id"), F.lit(repo_id).alias("repo_id"), F.lit(revision).alias("revision"), "relative_path", "company_code", "report_year", "statement_scope", "sha256", F.col("length").alias("file_size_bytes"), "encoding", "inventory_status", "notes")
    by_path = (F.lower("relative_path"), F.col("relative_path"))
    return documents.orderBy(*by_path), issues.orderBy(*by_path)


def inventory_counts(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: ready, empty, duplicate, issues."""
    kinds = [F.count_if(F.col("inventory_status") == s).alias(s) for s in ("ready", "empty", "duplicate")]
    return documents.agg(*kinds).crossJoin(issues.agg(F.count(F.lit(1)).alias("issues")))


def read_verified(spark: SparkSession, root: str, documents: DataFrame) -> DataFrame:
    """doc_id, relative_path, text of the ready documents; a file that changed since the inventory fails the job."""
    ready = documents.where("inventory_status = 'ready'").select("doc_id", "relative_path", F.col("sha256").alias("want_sha"), F.col("file_size_bytes").alias("want_size"), "encoding")
    # Names meet before contents are read.
    rows = read_contents(list_files(spark, root).join(ready, "relative_path")) if opens(root) else scan_files(spark, root).join(ready, "relative_path")
    same = (F.col("length") == F.col("want_size")) & (F.sha2("content", 256) == F.col("want_sha"))
    body = F.when(F.col("encoding") == "utf-8-sig", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    text = F.when(same, F.decode(body, "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("source changed: "), "relative_path")))
    return rows.select("doc_id", "relative_path", text.alias("text"))


def _read_tolerant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of files of up to ``HELD`` bytes, or of one larger file, which is all a task holds at a time."""
    def read(uri: str) -> tuple[bytes | None, str | None]:
        try:
            # Hadoop leaves letters beyond ASCII as they are, which Arrow takes for a broken URI.
            fs, inner = pyarrow.fs.FileSystem.from_uri(quote(uri, safe="/:@%+"))
            with fs.open_input_stream(inner) as f:
                return f.read(), None
        except OSError as error:
            return None, f"read failure: {type(error).__name__} errno={error.errno}"

    for batch in batches:
        contents: list[bytes | None] = []
        whys: list[str | None] = []
        held, done, uris = 0, 0, batch.column("path").to_pylist()
        for k, uri in enumerate(uris):
            content, why = read(uri)
            contents.append(content)
            whys.append(why)
            held += len(content or b"")
            if held >= HELD or k == len(uris) - 1:
                others = [batch.column(n).slice(done, k + 1 - done) for n in batch.schema.names]
                yield pa.RecordBatch.from_arrays([*others, pa.array(contents, pa.binary()), pa.array(whys, pa.string())], names=[*batch.schema.names, "content", "read_issue"])
                contents, whys, held, done = [], [], 0, k + 1


def read_listed(paths: DataFrame, *kept: str) -> DataFrame:
    """(path) to path, kept columns, content, read_issue: a file that cannot be read becomes an issue and the scan goes on."""
    paths = paths.select("path", *kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)
    return paths.mapInArrow(_read_tolerant, f"{schema}, content binary, read_issue string")


def read_contents(listed: DataFrame, gone: bool = False) -> DataFrame:
    """Listed files (path and whatever else) with their content; one that cannot be read fails the job, but for those that are ``gone``, which are left out if so told.

    Files are dealt to as many tasks as shuffles have, however many or small they are.
    """
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = read_listed(listed.repartition(parts, "path"), *[c for c in listed.columns if c != "path"])
    if gone:
        read = read.where(~F.coalesce(F.startswith("read_issue", F.lit("read failure: FileNotFoundError")), F.lit(False)))
    content = F.when(F.col("read_issue").isNull(), F.col("content")).otherwise(F.raise_error(F.concat_ws(" ", "path", "read_issue")).cast("binary"))
    return read.withColumn("content", content).drop("read_issue")


def content_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the content metrics of a text: lines, characters, control and replacement characters, number share, table marks."""
    t = F.col(text)
    chars = F.length(t)
    compact = F.length(F.regexp_replace(t, r"\s", ""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return df.withColumns({
        "n_characters": chars, "n_lines": count("\n") + F.when(t.endswith("\n") | (t == ""), 0).otherwise(1), "n_replacement": count("�"), "n_control": count(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"),
        "numeric_ratio": F.when(compact > 0, F.round(count("[0-9]") / compact, 6)).otherwise(F.lit(0.0)), "has_html_table": t.rlike(r"(?i)<table\b"), "has_pipe_table": t.rlike(r"(?m)^\s*\|.*\|\s*$"), "has_tab_table": F.contains(t, F.lit("\t")),
    })


#: What marks a report's scope, assurance and period in its folder name without accents, spaces and signs.
NAME_MARKS = {
    "scope": (("hopnhat", "consolidated"), ("congtyme|riengle|rieng", "separate")),
    "assurance": (("kiemtoan", "audited"), ("soatxet", "reviewed")),
    "period_type": (("quy[1-4]", "quarterly"), ("bannien|6thang", "semiannual")),
}
UNMARKED = {"scope": "unspecified", "assurance": "unspecified", "period_type": "annual_or_unspecified"}
EXPECTED_YEARS = (2015, 2025)


def report_facts(path: Column, name_key: Column) -> dict[str, Column]:
    """What a path tells, however incomplete: ticker, year, report name and its marks, and every issue of its structure.

    ``name_key`` is the third part without accents, lower-cased, letters and digits only.
    """
    parts = F.split(path, "/")
    at = lambda k: F.get(parts, F.lit(k))
    ticker = F.when(at(0).rlike("^[A-Za-z0-9]{2,10}$"), F.upper(at(0)))
    year = F.when(at(1).rlike("^[0-9]{4}$"), at(1).cast("int"))
    why = F.array_compact(F.array(
        F.when(F.size(parts) != 4, F.lit("expected exactly ticker/year/report/file hierarchy")),
        F.when(ticker.isNull(), F.lit("invalid ticker directory")),
        F.when(~F.coalesce(year.between(*YEARS), F.lit(False)), F.lit("invalid year directory")),
    ))
    def marked(kind: str) -> Column:
        out = F.lit(UNMARKED[kind])
        for pattern, value in reversed(NAME_MARKS[kind]):
            out = F.when(F.coalesce(name_key, F.lit("")).rlike(pattern), F.lit(value)).otherwise(out)
        return out

    return {
        "ticker": ticker, "year": year, "year_in_expected_range": F.coalesce(year.between(*EXPECTED_YEARS), F.lit(False)), "report_name": at(2), **{kind: marked(kind) for kind in NAME_MARKS},
        "structure_status": F.when(F.size(why) == 0, F.lit("valid")).otherwise(F.lit("malformed")), "structure_issue": F.when(F.size(why) > 0, F.array_join(why, "; ")),
    }


def tolerant_rows(files: DataFrame) -> DataFrame:
    """Adds the facts and size flags of (relative_path, length)."""
    key = F.regexp_replace(F.lower(strip_accents(F.get(F.split("relative_path", "/"), F.lit(2)))), "[^a-z0-9]+", "")
    rows = files.withColumn("_key", key)
    return rows.withColumns(report_facts(F.col("relative_path"), F.col("_key"))).drop("_key").withColumns({"is_empty": F.col("length") == 0, "is_tiny": F.col("length") < 1024})


def profile_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Every file with its size flags and path facts, from the listing alone, in order of folded path."""
    rows = tolerant_rows(list_files(spark, root).drop("path"))
    return rows.withColumnsRenamed({"length": "size_bytes", "modificationTime": "modified_at"}).orderBy(F.lower("relative_path"), "relative_path")
