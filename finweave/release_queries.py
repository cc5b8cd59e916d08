"""Queries that go through files: a corpus told from the suppliers, its inventory, release, audit files and streams.

Each supplier is one file; what a key leaves over on division by 8 tells its kind.  Files stand in the
session's shared folder and are written once for a session and a set of tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave import streaming
from finweave.functions import ids, text
from finweave.operators import extraction, ledger, matching
from finweave.plans import audit, gate, profile, release
from finweave.queries import QUERIES, SQL, VIEWS, on_tables, order_keys, order_reports, query, table
from finweave.sources import files, snapshot, store, tables

_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """The folder that ``write(folder)`` filled, made once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = tables.shared_folder(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def _write_files(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    fs, base = pyarrow.fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")
    for batch in batches:
        for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist()):
            fs.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
            with fs.open_output_stream(f"{base}/{path}") as out:
                out.write(body)
        yield batch.select(["path"])


#: A supplier's path, and its content in characters, where both engines agree.
K = "s_suppkey % 8"
PATH = f"CASE WHEN {K} = 4 THEN concat('S', lpad(CAST(s_suppkey AS STRING), 7, '0'), '/fs/a.txt') ELSE concat('S', lpad(CAST(s_suppkey AS STRING), 7, '0'), '/', CASE WHEN {K} = 3 THEN '1800' ELSE '2023' END, '/', CASE WHEN {K} = 0 THEN 'Consolidated FS' ELSE 'separate' END, '/', CASE WHEN {K} = 1 THEN 'B.TXT' ELSE 'a.txt' END) END"
ROWS = "concat('<tr><td rowspan=2>Doanh thu thuần</td><td>', CAST(s_suppkey AS STRING), '</td></tr>', chr(10), '<tr><td>1.2.3</td></tr>', chr(10), '<tr><td>Item</td><td>', CAST(s_nationkey AS STRING), ',5</td></tr></table>', chr(10))"
REPORT = f"concat('Đơn vị tính: triệu đồng', chr(10), 'Báo cáo kết quả kinh doanh', chr(10), '<table><tr><th>Chỉ tiêu</th><th>Năm 2023</th></tr>', chr(10), {ROWS})"
#: Kind 5 repeats its nation's text, kind 6 has a broken table behind a delimited one, kind 7 is no UTF-8.
TEXT = f"CASE WHEN {K} = 2 THEN '' WHEN {K} = 5 THEN concat('Nation ', CAST(s_nationkey AS STRING), chr(10), '<table><tr><td>a</td><td>1</td></tr></table>', chr(10)) WHEN {K} = 6 THEN concat('Số ', CAST(s_suppkey AS STRING), chr(10), 'Chỉ tiêu', chr(9), '2023', chr(9), '2022', chr(10), 'A', chr(9), '1', chr(9), '2', chr(10), 'B', chr(9), '3', chr(9), '4', chr(10), chr(10), '<table><tr><td>x', chr(10)) ELSE {REPORT} END"
CORPUS = f"SELECT s_suppkey, {K} AS kind, {PATH} AS path, {TEXT} AS body FROM supplier"
GOOD = f"SELECT *, sha256(body) AS sha, CASE WHEN body = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY body ORDER BY lower(path), path) = 1 THEN 'ready' ELSE 'duplicate' END AS status, first_value(path) OVER (PARTITION BY body ORDER BY lower(path), path) AS primary_path FROM ({CORPUS}) c WHERE kind NOT IN (3, 4, 7)"


def corpus(spark: SparkSession, sf_dir: str) -> str:
    """The root of the suppliers' files."""
    def write(root: str) -> None:
        rows = spark.sql(CORPUS.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
        broken = F.unhex(F.lit("FFFEFA"))
        rows = rows.select("path", F.when(F.col("kind") == 7, F.concat(broken, F.col("body").cast("binary"))).otherwise(F.col("body").cast("binary")).alias("body"))
        rows.repartition("path").mapInArrow(lambda it: _write_files(it, root), "path string").count()

    return _once(spark, sf_dir, "corpus", write)


def inventory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return files.build_inventory(spark, corpus(spark, sf_dir))


def manifest_file(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "manifest", lambda path: tables.write_manifest(*inventory(spark, sf_dir), path))


def built(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict]:
    """The suppliers' release, written, and loaded with all checks."""
    source = manifest_file(spark, sf_dir)

    def write(path: str) -> None:
        documents = tables.read_manifest(spark, source)[0]
        release.write_release(spark, release.build_tables(spark, corpus(spark, sf_dir), documents), path, store.sha256(spark, source))

    return release.load_release(spark, _once(spark, sf_dir, "release", write), inventory=tables.read_manifest(spark, source)[0])


# Files.
FILE_INVENTORY = f"SELECT path AS relative_path, status, sha AS sha256, CASE WHEN status = 'duplicate' THEN concat('duplicate_of=', primary_path) END AS note, octet_length(encode(body))::BIGINT AS size FROM ({GOOD}) g UNION ALL SELECT path, CASE kind WHEN 3 THEN 'invalid year' WHEN 4 THEN 'path must have four parts' ELSE 'invalid UTF-8' END, CASE WHEN kind <> 7 THEN sha256(body) END, NULL, octet_length(encode(body)) + CASE WHEN kind = 7 THEN 3 ELSE 0 END FROM ({CORPUS}) c WHERE kind IN (3, 4, 7)"


@on_tables("file_inventory", FILE_INVENTORY)
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and issues of the corpus tree."""
    return _inventory_rows(*inventory(spark, sf_dir))


def _inventory_rows(documents: DataFrame, issues: DataFrame) -> DataFrame:
    good = documents.select("relative_path", F.col("inventory_status").alias("status"), "sha256", F.get("notes", F.lit(0)).alias("note"), F.col("file_size_bytes").alias("size"))
    return good.unionByName(issues.select("relative_path", F.col("reason").alias("status"), F.when(F.col("reason") != "invalid UTF-8", F.col("sha256")).alias("sha256"), F.lit(None).cast("string").alias("note"), F.col("file_size_bytes").alias("size")))


@on_tables("file_inventory_counts", f"SELECT count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'duplicate') AS duplicate, (SELECT count(*) FROM ({CORPUS}) c WHERE kind IN (3, 4, 7)) AS issues FROM ({GOOD}) g")
def file_inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.inventory_counts(*inventory(spark, sf_dir))


@on_tables("manifest_round_trip", f"SELECT concat('doc_', sha) AS doc_id, path AS relative_path, split_part(path, '/', 1) AS company_code, 2023 AS report_year, CASE WHEN kind = 0 THEN 'consolidated' ELSE 'separate' END AS statement_scope, status AS inventory_status FROM ({GOOD}) g")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to a manifest and read back."""
    return tables.read_manifest(spark, manifest_file(spark, sf_dir))[0].select("doc_id", "relative_path", "company_code", "report_year", "statement_scope", "inventory_status")


@on_tables("verified_texts", f"SELECT path AS relative_path, sha256(body) AS text_digest, length(body)::INT AS n FROM ({GOOD}) g WHERE status = 'ready'")
def verified_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the ready documents, checked against the manifest."""
    texts = files.read_verified(spark, corpus(spark, sf_dir), tables.read_manifest(spark, manifest_file(spark, sf_dir))[0])
    return texts.select("relative_path", F.sha2("text", 256).alias("text_digest"), F.length("text").alias("n"))


@on_tables("tolerant_inventory", f"SELECT path AS relative_path, split_part(path, '/', 1) AS ticker, CASE kind WHEN 3 THEN 1800 WHEN 4 THEN NULL ELSE 2023 END AS year, CASE WHEN kind IN (3, 4) THEN 'malformed' ELSE 'valid' END AS structure_status, CASE kind WHEN 3 THEN 'invalid year directory' WHEN 4 THEN 'expected exactly ticker/year/report/file hierarchy; invalid year directory' END AS structure_issue, kind = 2 AS is_empty, octet_length(encode(body)) < 1024 AS is_tiny FROM ({CORPUS}) c")
def tolerant_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every path, malformed ones too."""
    return files.profile_inventory(spark, corpus(spark, sf_dir)).select("relative_path", "ticker", "year", "structure_status", "structure_issue", "is_empty", "is_tiny")


NAMES = ("BCTC Hợp nhất kiểm toán", "Công ty mẹ soát xét bán niên", "Riêng lẻ Quý 3", "6 tháng", "Báo cáo")


@on_tables("report_names", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'separate' WHEN 2 THEN 'separate' ELSE 'unspecified' END AS scope, CASE s_suppkey % 5 WHEN 0 THEN 'audited' WHEN 1 THEN 'reviewed' ELSE 'unspecified' END AS assurance, CASE s_suppkey % 5 WHEN 1 THEN 'semiannual' WHEN 2 THEN 'quarterly' WHEN 3 THEN 'semiannual' ELSE 'annual_or_unspecified' END AS period_type FROM supplier")
def report_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope, assurance and period of accented report names."""
    name = F.get(F.array(*[F.lit(x) for x in NAMES]), (F.col("s_suppkey") % 5).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("ABC/2023/"), name, F.lit("/a.txt")).alias("relative_path"), F.lit(1).cast("long").alias("length"))
    return files.tolerant_rows(rows).select("s_suppkey", "scope", "assurance", "period_type")


@on_tables("corpus_readiness", f"SELECT 'path parsing' AS finding, concat(count(*) FILTER (kind IN (3, 4)), '/', count(*), ' malformed paths') AS evidence FROM ({CORPUS}) c UNION ALL SELECT 'quarantine', concat(count(*) FILTER (kind = 2), ' empty files; 0 sampled read errors') FROM ({CORPUS}) c UNION ALL SELECT 'encoding', concat(count(*) FILTER (kind = 7), '/', count(*), ' sampled files are not strict UTF-8') FROM ({CORPUS}) c UNION ALL SELECT 'table detection', concat(printf('%.1f', count(*) FILTER (kind <> 2) * 100.0 / count(*)), '% of sampled files contain simple table markers') FROM ({CORPUS}) c UNION ALL SELECT 'coverage', concat(count(*) FILTER (kind <> 4), ' observed ticker-year pairs') FROM ({CORPUS}) c")
def corpus_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = files.read_files(spark, corpus(spark, sf_dir))
    body = F.make_valid_utf8(F.col("content").cast("string"))
    seen = content.select("read_issue", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8_valid"), (F.contains(body, F.lit("<table")) | F.contains(body, F.lit("\t"))).alias("has_markers"))
    found = profile.readiness(files.profile_inventory(spark, corpus(spark, sf_dir)), seen)
    return found.select("finding", F.replace("evidence", F.lit(","), F.lit("")).alias("evidence"))


@on_tables("content_quality", f"SELECT count(*) AS files, count(*) AS read, 0::BIGINT AS read_errors, round(count(*) FILTER (kind <> 7) / count(*), 6) AS utf8_share FROM ({CORPUS}) c")
def content_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = files.read_files(spark, corpus(spark, sf_dir))
    return profile.content_quality(content.select("read_issue", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8_valid")))


@on_tables("ticker_years", f"SELECT DISTINCT split_part(path, '/', 1) AS ticker, CASE kind WHEN 3 THEN 1800 ELSE 2023 END AS year FROM ({CORPUS}) c WHERE kind <> 4")
def ticker_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that the corpus has, each once."""
    return files.profile_inventory(spark, corpus(spark, sf_dir)).where("ticker IS NOT NULL AND year IS NOT NULL").select("ticker", "year").dropDuplicates(["ticker", "year"])


@on_tables("streamed_inventory", f"SELECT path AS relative_path, CASE kind WHEN 3 THEN 'invalid year' WHEN 4 THEN 'path must have four parts' WHEN 7 THEN 'invalid UTF-8' END AS reason FROM ({CORPUS}) c")
def streamed_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of the corpus and its issue, as a stream merged them."""
    return streaming.read_manifest_log(spark, streamed(spark, sf_dir)).select("relative_path", "reason")


@on_tables("streamed_manifest", FILE_INVENTORY)
def streamed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and issues of the manifest that streams of few files left, with duplicates over all of them and files without bytes."""
    return _inventory_rows(*streaming.streamed_inventory(spark, streamed(spark, sf_dir)))


def streamed(spark: SparkSession, sf_dir: str) -> str:
    """The manifest of two runs of the stream, the first in batches of a third of the files."""
    def write(path: str) -> None:
        root = corpus(spark, sf_dir)
        n = table(spark, sf_dir, "supplier").count()
        streaming.update_inventory(spark, root, f"{path}/manifest", f"{path}/state", most=max(1, n // 3))
        streaming.update_inventory(spark, root, f"{path}/manifest", f"{path}/state")

    return f"{_once(spark, sf_dir, 'stream', write)}/manifest"


@on_tables("snapshot_copy", f"SELECT count(*) AS file_count, sum(octet_length(encode(body)) + CASE WHEN kind = 7 THEN 3 ELSE 0 END)::BIGINT AS total_bytes, 0::BIGINT AS files_left FROM ({CORPUS}) c WHERE kind <> 1")
def snapshot_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus fetched as a pinned snapshot: what was planned, and what is left to fetch then."""
    uri = lambda path: path if "://" in path else f"file://{path.removeprefix('file:')}"
    target = tables.shared_folder(spark, "snapshot")
    request = snapshot.Request("suppliers", uri(f"{target}/files"), f"{target}/record.json", include=("*.txt",))
    source = snapshot.FolderSource(spark, uri(corpus(spark, sf_dir)))
    made = snapshot.download(spark, request, source, free=lambda _: 1 << 50)
    left = snapshot.plan(request, source)
    return spark.createDataFrame([(made.file_count, made.total_bytes, left.files_to_download)], "file_count long, total_bytes long, files_left long")


# The release.
READY = f"SELECT * FROM ({GOOD}) g WHERE status = 'ready'"
PER_KIND = "CASE WHEN kind IN (0, 1) THEN {0} WHEN kind = 5 THEN {1} ELSE {2} END"


@on_tables("release_counts", f"SELECT 'documents' AS name, count(*)::BIGINT AS n FROM ({READY}) r UNION ALL SELECT 'tables', count(*) FROM ({READY}) r UNION ALL SELECT 'cells', sum({PER_KIND.format(7, 2, 9)})::BIGINT FROM ({READY}) r UNION ALL SELECT 'placements', sum({PER_KIND.format(8, 2, 9)})::BIGINT FROM ({READY}) r UNION ALL SELECT 'source_table_occurrences', (SELECT count(*) FROM ({GOOD}) g WHERE status <> 'empty')")
def release_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a release that was written, swapped into place and verified."""
    counts = built(spark, sf_dir)[1]["counts"]
    return spark.createDataFrame([(k, v) for k, v in counts.items() if k != "issues"], "name string, n long")


@on_tables("release_occurrences", f"SELECT path AS relative_path, 0 + CASE WHEN kind = 6 THEN 1 ELSE 0 END AS ordinal, CASE WHEN status = 'duplicate' THEN 'duplicate' WHEN kind = 6 THEN 'rejected' ELSE 'canonical' END AS status, CASE WHEN kind = 6 THEN 'unclosed_html_table' END AS rejection_code, CASE WHEN status = 'duplicate' THEN primary_path END AS duplicate_of_relative_path FROM ({GOOD}) g WHERE status <> 'empty'")
def release_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of the sources: canonical, rejected behind a delimited table, or of a copied file."""
    return built(spark, sf_dir)[0]["source_table_occurrences"].select("relative_path", "ordinal", "status", "rejection_code", "duplicate_of_relative_path")


@on_tables("release_cells", f"SELECT path AS relative_path, v.row_idx, v.col_idx, v.label, v.value, v.period, v.unit FROM ({READY}) r, LATERAL (VALUES (1, 1, 'Doanh thu thuần', s_suppkey::DOUBLE, '2023', 'VND_million'), (3, 1, 'Item', (SELECT s_nationkey + 0.5 FROM supplier s WHERE s.s_suppkey = r.s_suppkey)::DOUBLE, '2023', 'VND_million')) v(row_idx, col_idx, label, value, period, unit) WHERE kind IN (0, 1)")
def release_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the reports' tables, one of whose labels spans two rows."""
    tables_ = built(spark, sf_dir)[0]
    rows = tables_["cells"].where("value_numeric IS NOT NULL").join(tables_["tables"].where("statement_type = 'income_statement'").select("table_id", "doc_id"), "table_id").join(tables_["documents"].select("doc_id", "relative_path"), "doc_id")
    return rows.select("relative_path", "row_idx", "col_idx", F.col("row_label_raw").alias("label"), F.col("value_numeric").cast("double").alias("value"), "period", "unit")


@on_tables("release_issues", f"SELECT 'metric_unknown' AS code, count(*) AS n FROM ({READY}) r WHERE kind IN (0, 1) UNION ALL SELECT 'number_invalid', count(*) FROM ({READY}) r WHERE kind IN (0, 1)")
def release_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.issue_counts(built(spark, sf_dir)[0]["issues"])


@on_tables("release_views", f"SELECT split_part(path, '/', 1) AS company_code, 1::BIGINT AS n_tables FROM ({READY}) r")
def release_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over the release's files as named views."""
    built(spark, sf_dir)
    tables.register_views(spark, _written[(spark.sparkContext.applicationId, sf_dir, "release")])
    return spark.sql("SELECT company_code, count(*) AS n_tables FROM documents JOIN tables USING (doc_id) GROUP BY company_code")


@on_tables("release_differences", f"SELECT concat('doc_', sha) AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN 'not_released' WHEN 1 THEN 'different' ELSE 'not_ready' END AS why FROM ({READY}) r WHERE s_suppkey % 4 <> 0")
def release_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release's documents against an inventory from which some are gone, some changed, and some not ready."""
    documents = built(spark, sf_dir)[0]["documents"]
    key = F.substring("company_code", 2, 7).cast("int")
    kept = documents.where((key % 3 != 0) | (key % 4 == 0))
    changed = documents.where((key % 3 != 2) | (key % 4 == 0)).withColumn("report_year", F.when((key % 3 == 1) & (key % 4 != 0), F.lit(1999)).otherwise(F.col("report_year")))
    return release.document_differences(kept, changed)


@on_tables("release_violations", f"SELECT * FROM (SELECT 'cell_table' AS rule, sum({PER_KIND.format(7, 2, 9)})::BIGINT AS violations FROM ({READY}) r WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'placement_table', sum({PER_KIND.format(8, 2, 9)})::BIGINT FROM ({READY}) r WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'years', count(*) FROM ({READY}) r WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'unique_documents', count(*) FROM ({READY}) r WHERE s_suppkey % 9 = 0 UNION ALL SELECT 'rejected_shape', count(*) FROM ({READY}) r WHERE kind = 6) v WHERE violations > 0")
def release_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release with tables taken out, years out of range, documents twice, and rejections without a code."""
    rows = built(spark, sf_dir)[0]
    key = F.substring("company_code", 2, 7).cast("int")
    d = rows["documents"]
    gone = d.where(key % 5 == 0).select("doc_id")
    odd = d.withColumn("report_year", F.when(key % 7 == 0, F.lit(3000)).otherwise(F.col("report_year")))
    # Doubled documents keep the year that their first row has, so only one of the two is counted.
    twice = d.where(key % 9 == 0)
    broken = rows | {"documents": odd.unionByName(twice), "tables": rows["tables"].join(gone, "doc_id", "left_anti"), "source_table_occurrences": rows["source_table_occurrences"].withColumn("rejection_code", F.lit(None).cast("string"))}
    named = ("cell_table", "placement_table", "years", "unique_documents", "rejected_shape")
    return release.release_violations(broken).where(F.col("rule").isin(*named) & (F.col("violations") > 0))


@on_tables("duplicate_notes", f"SELECT 'duplicate_note' AS rule, count(*) FILTER (status = 'duplicate' AND s_suppkey % 2 = 0) AS violations FROM ({GOOD}) g UNION ALL SELECT 'note_of_others', count(*) FILTER (status <> 'duplicate' AND s_suppkey % 3 = 0) FROM ({GOOD}) g")
def duplicate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that a duplicate must have and others must not."""
    documents = inventory(spark, sf_dir)[0].withColumn("key", F.substring("company_code", 2, 7).cast("int"))
    is_copy = F.col("inventory_status") == "duplicate"
    notes = F.when(is_copy & (F.col("key") % 2 == 0), F.array(F.lit("duplicate of"))).when(~is_copy & (F.col("key") % 3 == 0), F.array(F.lit("duplicate_of=x"))).otherwise(F.col("notes"))
    return ledger.note_violations(documents.withColumn("notes", notes))


# Strict files.
@on_tables("csv_round_trip", "SELECT CAST(n_nationkey AS STRING) AS k, concat(n_name, ',\"', chr(10), CAST(n_regionkey AS STRING)) AS v FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with commas, quotes and line ends, written and read back."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.concat("n_name", F.lit(',"\n'), F.col("n_regionkey").cast("string")).alias("v"))
    path = _once(spark, sf_dir, "csv", lambda path: tables.write_strict_csv(path, ("k", "v"), rows.orderBy("k")))
    return tables.read_strict_csv(spark, path, ("k", "v"))


@on_tables("label_file", "SELECT CASE WHEN event_id % 3 = 0 THEN 'true_issue' WHEN event_id % 3 = 1 THEN 'false_positive' ELSE 'uncertain' END AS label, CASE WHEN event_id % 3 = 1 THEN 'other' END AS cause_code, count(*) AS n FROM events GROUP BY 1, 2")
def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file that was written and read back with its checks."""
    k = F.col("event_id") % 3
    label = F.when(k == 0, "true_issue").when(k == 1, "false_positive").otherwise("uncertain")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string"), F.lit("_"), F.col("event_id").cast("string")).alias("sample_id"), label.alias("label"), F.when(k == 1, "other").alias("cause_code"), F.lit("").alias("reviewer_note"))
    path = _once(spark, sf_dir, "labels", lambda path: tables.write_strict_csv(path, tables.LABEL_COLUMNS, tables.staged(rows, "label-rows")))
    sample = tables.read_strict_csv(spark, path, tables.LABEL_COLUMNS).select("sample_id")
    return tables.read_labels(spark, path, sample).groupBy("label", "cause_code").agg(F.count(F.lit(1)).alias("n"))


@query("label_violations", "labs", sql="SELECT 'unknown_sample' AS rule, count(*) FILTER (k % 7 = 0) AS violations FROM labs UNION ALL SELECT 'repeated_sample', (SELECT count(*) FROM (SELECT k FROM labs GROUP BY k HAVING count(*) > 1)) UNION ALL SELECT 'invalid_label', count(*) FILTER (label IS NULL OR k % 11 = 0) FROM labs UNION ALL SELECT 'invalid_cause', count(*) FILTER (cause_code IS NOT NULL AND k % 5 = 0) FROM labs")
def label_violations(rows: DataFrame) -> DataFrame:
    """Labels of unknown samples, repeated ones, and values outside their lists."""
    sample = rows.where("k % 7 <> 0").select(F.col("k").cast("string").alias("sample_id")).distinct()
    labels = rows.select(F.col("k").cast("string").alias("sample_id"), F.when(F.col("k") % 11 == 0, F.lit("maybe")).otherwise(F.col("label")).alias("label"), F.when(F.col("cause_code").isNotNull() & (F.col("k") % 5 == 0), F.lit("no cause")).otherwise(F.col("cause_code")).alias("cause_code"))
    return tables.label_violations(labels, sample)


METRICS = "count(*) AS samples, count(*) FILTER (label = 'true_issue') AS true_issues, count(*) FILTER (label = 'false_positive') AS false_positives, count(*) FILTER (label = 'uncertain') AS uncertain, count(*) FILTER (label IS NULL) AS unlabeled"


@query("label_evaluation", "labs", sql=f"SELECT issue_code, {METRICS} FROM (SELECT issue_code, CASE WHEN k % 3 <> 0 THEN label END AS label FROM labs) GROUP BY issue_code")
def label_evaluation(rows: DataFrame) -> DataFrame:
    """A sample, a third of which has no label, with its labels."""
    rows = rows.select("*", F.sha2(F.concat_ws("|", "k", "issue_code", "label", "cause_code"), 256).alias("sample_id")).dropDuplicates(["k"])
    found = audit.evaluate_labels(rows.select("sample_id", "issue_code"), rows.where("k % 3 <> 0").select("sample_id", "label", "cause_code"))
    return found.select("issue_code", "samples", "true_issues", "false_positives", "uncertain", "unlabeled")


@query("after_metrics", "iss", sql=f"SELECT issue_code, {METRICS} FROM (SELECT code AS issue_code, CASE WHEN lab = 'false_positive' AND raw_value IS DISTINCT FROM 'v3' THEN 'true_issue' ELSE lab END AS label FROM (SELECT DISTINCT doc_id, table_id, cell_id, field, code, raw_value, CASE WHEN length(table_id) % 2 = 0 THEN 'false_positive' ELSE 'uncertain' END AS lab FROM iss WHERE cell_id IS NOT NULL)) GROUP BY issue_code")
def after_metrics(i: DataFrame) -> DataFrame:
    """Labels against a later release that has only the issues with one value left."""
    i = i.where("cell_id IS NOT NULL").distinct()
    sample = i.withColumnRenamed("code", "issue_code").withColumn("sample_id", ids.digest("|", *[F.col(c) for c in i.columns if c != "code"], F.col("issue_code")))
    labels = sample.select("sample_id", F.when(F.length("table_id") % 2 == 0, "false_positive").otherwise("uncertain").alias("label"), F.lit(None).cast("string").alias("cause_code"))
    return audit.evaluate_after(sample, labels, i.where("raw_value = 'v3'")).select("issue_code", "samples", "true_issues", "false_positives", "uncertain", "unlabeled")


@query("table_sets", "tabs", sql="SELECT true AS same, count(*) FILTER (source_ordinal = 3) = 0 AS without_some FROM tabs")
def table_sets(t: DataFrame) -> DataFrame:
    """A release's tables against the same and against fewer."""
    return t.sparkSession.createDataFrame([(audit.same_keys(t, t.select("table_id").distinct(), "table_id"), audit.same_keys(t, t.where("source_ordinal <> 3"), "table_id"))], "same boolean, without_some boolean")


# The gate.
PROVED = "SELECT l_orderkey, r, l_partkey, r % 3 <> 0 AND r % 5 <> 0 AND r % 4 <> 0 AS verified FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem)"


@on_tables("cell_provenance", f"SELECT concat('t', CAST(l_orderkey AS STRING)) AS table_id, CAST(r AS INT) AS row_idx, verified, CASE WHEN r % 4 <> 0 THEN concat('<td>v', CAST(l_partkey AS STRING), '&amp;</td>') END AS source_excerpt FROM ({PROVED}) p")
def cell_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose text is in their line; every third has another text, every fourth no line, every fifth another table's lines."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("rows"))
    lines = rows.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.transform("rows", lambda r: F.concat(F.lit("<td>v"), r["l_partkey"].cast("string"), F.lit("&amp;</td>"))).alias("lines"))
    cells = rows.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.posexplode("rows").alias("p", "x")).withColumn("r", F.col("p") + 1)
    name = F.concat(F.lit("t"), F.col("doc_id"))
    cells = cells.select(
        "doc_id", name.alias("table_id"), F.col("r").alias("row_idx"), F.lit(0).alias("col_idx"), ids.cell_id(name, F.col("r"), F.lit(0)).alias("cell_id"),
        F.when(F.col("r") % 3 == 0, F.lit("other")).otherwise(F.concat(F.lit("v"), F.col("x.l_partkey").cast("string"), F.lit("&"))).alias("value_raw"),
        F.when(F.col("r") % 4 == 0, F.lit(99)).otherwise(F.col("r")).alias("source_line_start"), F.when(F.col("r") % 4 == 0, F.lit(99)).otherwise(F.col("r")).alias("source_line_end"),
        F.lit(1).alias("line_start"), F.when(F.col("r") % 5 == 0, F.col("r") - 1).otherwise(F.lit(99)).alias("line_end"),
    )
    return gate.cell_provenance(cells, lines).select("table_id", "row_idx", "verified", "source_excerpt")


FAILED = {"shape_mismatch": 2, "statement_mismatch": 3, "unit_mismatch": 5, "period_mismatch": 7, "invalid_provenance": 11, "no_numeric_value": 13}


@query("table_usability", "tabs", sql="SELECT replace(table_id, 'tbl_', 'ann_') AS annotation_id, concat_ws(',', " + ", ".join(f"CASE WHEN line_start % {m} = 0 THEN '{c}' END" for c, m in FAILED.items()) + ") AS failures FROM tabs WHERE statement_type IS NOT NULL")
def table_usability(t: DataFrame) -> DataFrame:
    """Annotations that differ from their tables in one or several ways, told by the first line."""
    t = t.where("statement_type IS NOT NULL")
    key = lambda code: F.col("line_start") % FAILED[code] == 0
    assessed = t.select(
        F.replace("table_id", F.lit("tbl_"), F.lit("ann_")).alias("annotation_id"), "table_id", (F.col("row_count") + key("shape_mismatch").cast("int")).alias("row_count"), "column_count",
        F.when(key("statement_mismatch"), F.lit("notes")).otherwise(F.upper("statement_type")).alias("statement_type"), F.when(key("unit_mismatch"), F.lit("VND")).otherwise(F.lit("")).alias("unit_normalized"),
        F.array(F.lit("2023")).alias("expected_periods"), F.array().cast("array<string>").alias("failures"),
    )
    plain = {"value_raw": F.lit("5"), "row_label_raw": F.lit("Cash"), "column_label_raw": F.lit("Năm"), "value_numeric": F.lit(5.0), "period": F.lit("2023"), "verified": F.lit(True)}
    ann = F.replace("table_id", F.lit("tbl_"), F.lit("ann_")).alias("annotation_id")
    good = t.select(ann, *[c.alias(n) for n, c in plain.items()])
    bad = t.select(ann, *[c.alias(n) for n, c in (plain | {"period": F.when(key("period_mismatch"), F.lit("1999")).otherwise(F.lit("2023")), "verified": ~key("invalid_provenance"), "value_numeric": F.when(~key("no_numeric_value"), F.lit(5.0))}).items()])
    found = gate.table_usability(assessed, t, good.unionByName(bad))
    order = F.array(*[F.lit(c) for c in FAILED])
    return found.select("annotation_id", F.array_join(F.filter(order, lambda c: F.array_contains("failures", c)), ",").alias("failures"))


@query("annotation_violations", "tabs", sql="SELECT 'statement_type' AS rule, count(*) FILTER (statement_type IS NULL) AS violations FROM tabs UNION ALL SELECT 'lines', count(*) FILTER (line_start = 1) FROM tabs UNION ALL SELECT 'shape', count(*) FILTER (row_count = 2) FROM tabs UNION ALL SELECT 'annotation_id', count(*) FILTER (source_ordinal = 2) FROM tabs UNION ALL SELECT 'pilot_document', count(*) FILTER (source_ordinal = 5) FROM tabs UNION ALL SELECT 'schema_version', 0 UNION ALL SELECT 'unique_annotations', 0")
def annotation_violations(t: DataFrame) -> DataFrame:
    """Expected tables that break a rule of their file."""
    from finweave.plans.pilot import annotation_violations as found

    rows = t.withColumn("line_start", F.when(F.col("line_start") == 1, F.lit(0)).otherwise(F.col("line_start"))).withColumn("row_count", F.when(F.col("row_count") == 2, F.lit(0)).otherwise(F.col("row_count")))
    rows = rows.withColumn("doc_id", F.concat(F.when(F.col("source_ordinal") == 5, F.lit("no")).otherwise(F.lit("")), F.col("table_id"))).withColumn("annotation_schema_version", F.lit("1"))
    right = ids.annotation_id(F.col("doc_id"), F.col("line_start"), F.col("line_end"), F.col("statement_type"))
    rows = rows.withColumn("annotation_id", F.when(F.col("source_ordinal") == 2, F.concat(F.lit("x"), right)).otherwise(right))
    return found(rows, t.select(F.col("table_id").alias("doc_id")))


@query("match_assessment", "ann", "tabs", sql="SELECT annotation_id, CASE WHEN n = 0 THEN 'missing_table' ELSE '' END AS failure FROM (SELECT ann.annotation_id, count(tabs.table_id) AS n FROM ann LEFT JOIN tabs ON replace(ann.annotation_id, 'ann_', '') = replace(tabs.table_id, 'tbl_', '') AND ann.line_start <= tabs.line_end AND tabs.line_start <= ann.line_end AND tabs.source_ordinal <> 1 GROUP BY 1)")
def match_assessment(a: DataFrame, t: DataFrame) -> DataFrame:
    """Annotations of documents of one table each, some of which the tables lack."""
    own = lambda df, c: df.withColumn("doc_id", F.regexp_replace(c, "^[a-z]+_", ""))
    found = matching.assess_matching(own(a, "annotation_id"), own(t, "table_id").where("source_ordinal <> 1"))
    return found.select("annotation_id", F.when(F.array_contains("failures", "missing_table"), F.lit("missing_table")).otherwise(F.lit("")).alias("failure"))


@query("match_assessment_all", "ann", "tabs")
def match_assessment_all(a: DataFrame, t: DataFrame) -> DataFrame:
    """Annotations of whole documents, whose tables they compete for; SQL cannot state the best assignment, and a test compares it with brute force."""
    return matching.assess_matching(a, t).select("annotation_id", "doc_id", "table_id", "overlap", "failures")


# Texts and extraction.
@on_tables("exact_keys", "SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS key FROM part")
def exact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of part names in capitals, with odd spaces."""
    odd = F.concat(F.lit("  "), F.replace(F.upper("p_name"), F.lit(" "), F.lit(" \t ")), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalized_key(odd).alias("key"))


@on_tables("wide_keys", "SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS key FROM part")
def wide_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of part names in wide capitals between ideographic and no-break spaces."""
    wide = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ")
    return table(spark, sf_dir, "part").select("p_partkey", text.normalized_key(F.concat(F.lit("\u3000"), F.replace(wide, F.lit(" "), F.lit("\u00a0\u3000")))).alias("key"))


LINES = ("- 12,5  3", "1. abc  def", "• x  1  y", "plain 1", "(1.234) 5%", "ab 12", " ")


@on_tables("line_predicates", "SELECT p_partkey, p_partkey % 7 IN (0, 1) AS is_list, p_partkey % 7 IN (4, 5) AS mostly_numeric FROM part")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets whose cells are alike, and lines that are mostly digits."""
    line = F.get(F.array(*[F.lit(x) for x in LINES]), (F.col("p_partkey") % 7).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", line.alias("line"), F.split(line, "  +").alias("cells"))
    return rows.select("p_partkey", text.is_list_line(F.col("line"), F.col("cells")).alias("is_list"), (text.predominantly_numeric(F.col("line")) & ~text.is_list_line(F.col("line"), F.col("cells"))).alias("mostly_numeric"))


@query("eligible_cells", "cels", sql="SELECT cell_id, row_idx % 5 NOT IN (1, 2, 3) AS eligible FROM cels")
def eligible_cells(c: DataFrame) -> DataFrame:
    """Cells with a number, a blank label, an auxiliary column, or their label as value."""
    k = F.col("row_idx") % 5
    label = F.when(k == 1, F.lit("  ")).when(k == 3, F.col("value_raw")).otherwise(F.lit("Cash"))
    return c.select("cell_id", text.is_eligible_value_cell(F.col("value_raw"), label, F.when(k == 2, F.lit("Mã số")).otherwise(F.lit("2023")), F.col("value_numeric")).alias("eligible"))


@on_tables("short_texts", "SELECT doc_id, CASE WHEN length(text) > 20 THEN concat(substr(text, 1, 19), '…') ELSE text END AS head, CASE WHEN n_chars % 2000 < 2 THEN concat(CAST(n_chars % 2000 * 512 AS STRING), ' B') ELSE concat(printf('%.1f', n_chars % 2000 / 2.0), ' KiB') END AS size FROM documents")
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of texts and sizes as reports show them."""
    return table(spark, sf_dir, "documents").select("doc_id", text.shortened(F.col("text"), 20).alias("head"), text.human_bytes((F.col("n_chars") % 2000 * 512).cast("long")).alias("size"))


@on_tables("extraction_totals", "SELECT count(DISTINCT l_orderkey) AS documents, count(DISTINCT l_orderkey) AS tables, sum(n)::BIGINT AS cells, sum(n)::BIGINT AS placements, 0::BIGINT AS rejections, 0::BIGINT AS html_free, 0::BIGINT AS html_free_with_tables FROM (SELECT l_orderkey, (count(*) + 1) * 3 AS n FROM lineitem GROUP BY 1)")
def extraction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.extraction_totals(extraction.extract_tables(order_reports(spark, sf_dir), ("document",)))


@on_tables("extraction_is_deterministic", "SELECT DISTINCT concat('doc_', CAST(l_orderkey AS STRING)) AS doc_id FROM lineitem WHERE l_orderkey % 50 = 0")
def extraction_is_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the extraction, the second over texts some of which were changed: only these differ."""
    reports = order_reports(spark, sf_dir)
    changed = reports.withColumn("text", F.when(F.substring("doc_id", 5, 20).cast("long") % 50 == 0, F.replace("text", F.lit("Item"), F.lit("Line"))).otherwise(F.col("text")))
    return profile.nondeterministic(extraction.extract_tables(reports, ("digest",)), extraction.extract_tables(changed, ("digest",)))


@on_tables("mixed_ordinals", "SELECT concat('doc_', CAST(o_orderkey AS STRING)) AS doc_id, v.kind, v.ordinal, v.rejected FROM orders, (VALUES ('html', 0, false), ('structured_text', 1, false), ('html', 2, true), ('html', 3, false)) v(kind, ordinal, rejected)")
def mixed_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of both kinds, one of them rejected, share one sequence of ordinals."""
    k = F.col("o_orderkey").cast("string")
    one = "<table><tr><td>a</td><td>1</td></tr></table>\n"
    body = F.concat(F.lit(f"{one}\nChỉ tiêu\t2023\t2022\nCash\t"), k, F.lit(f"\t12\nDebt\t7\t8\n\n<table><tr><td rowspan='0'>1</td></tr></table>\n\ntext\n{one}"))
    found = tables.staged(extraction.extract_tables(order_keys(spark, sf_dir).select(F.concat(F.lit("doc_"), k).alias("doc_id"), body.alias("text")), ("candidate", "rejected")), "spots")
    rejected = extraction.spots_of(found, "rejected").select("doc_id", "kind", "ordinal", F.lit(True).alias("rejected"))
    candidates = extraction.spots_of(found, "candidates").select("doc_id", "kind", "ordinal")
    return candidates.unionByName(rejected.select("doc_id", "kind", "ordinal")).distinct().join(rejected, ["doc_id", "kind", "ordinal"], "left").select("doc_id", "kind", "ordinal", F.coalesce("rejected", F.lit(False)).alias("rejected"))
