"""Manifests, strict CSV files, label files, and releases of Parquet tables."""

from __future__ import annotations

import csv
import io
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from finweave.errors import ContractError
from finweave.sources import store

DOCUMENT = "doc_id string, repo_id string, revision string, relative_path string, company_code string, report_year int, statement_scope string, sha256 string, file_size_bytes bigint, encoding string, inventory_status string, notes array<string>"
MANIFEST = f"record_type string, {DOCUMENT}, reason string"
RELEASE = {
    "documents": "doc_id string, repo_id string, revision string, relative_path string, company_code string, report_year int, statement_scope string, sha256 string, file_size_bytes bigint, encoding string, inventory_status string, ruleset_version string, normalization_fingerprint string",
    "tables": "table_id string, doc_id string, source_ordinal int, title_raw string, statement_type string, unit_raw string, unit_normalized string, line_start int, line_end int, row_count int, column_count int, quality_score double, csv_path string",
    "cells": "cell_id string, table_id string, row_idx int, col_idx int, row_label_raw string, row_label_canonical string, column_label_raw string, column_label_canonical string, value_raw string, value_numeric decimal(38,10), period string, unit string, source_line_start int, source_line_end int, extraction_confidence double",
    "placements": "table_id string, row_idx int, col_idx int, cell_id string",
    "issues": "code string, doc_id string, table_id string, cell_id string, field string, raw_value string",
    "source_table_occurrences": "source_table_id string, doc_id string, relative_path string, source_sha256 string, ordinal int, line_start int, line_end int, status string, canonical_table_id string, rejection_code string, duplicate_of_relative_path string",
}
ORDER = {
    "documents": ("doc_id",), "tables": ("doc_id", "table_id"), "cells": ("table_id", "row_idx", "col_idx", "cell_id"), "placements": ("table_id", "row_idx", "col_idx", "cell_id"),
    "issues": ("doc_id", "table_id", "cell_id", "field", "code", "raw_value"), "source_table_occurrences": ("relative_path", "ordinal", "line_start", "line_end", "source_table_id"),
}
#: Fixed values.
LABELS = ("true_issue", "false_positive", "uncertain")
CAUSES = (
    "year_header_as_unit", "missing_unit_context", "unsupported_unit_alias", "non_metric_row", "unsupported_metric_alias", "non_value_cell", "ocr_corruption", "separator_ambiguity",
    "legitimate_missing_value", "mixed_unit_table", "statement_signal_conflict", "period_missing_year", "period_format_ambiguous", "other",
)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name below the session's shared folder (``spark.checkpoint.dir``); only a local session may have none and gets a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ContractError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="finweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/finweave/{name}-{uuid.uuid4().hex}"


#: Folders that ``staged`` wrote, by open scope.
_scopes: list[list[str]] = []


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes a table that several later steps read to the shared folder, and reads it back.

    So it survives lost executors and keeps later plans small.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    for scope in _scopes:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, whatever the store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what ``staged`` wrote inside, but for the last table, the result."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop()[:-1]:
            delete_folder(spark, path)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def manifest_lines(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """(line) of a manifest: documents and issues in one order, keys sorted, nulls kept."""
    rows = documents.withColumn("record_type", F.lit("document")).unionByName(issues.withColumn("record_type", F.lit("issue")), allowMissingColumns=True)
    shown = {"document": sorted(["record_type", *StructType.fromDDL(DOCUMENT).names]), "issue": sorted(["record_type", "relative_path", "file_size_bytes", "sha256", "reason"])}
    as_json = lambda kind: F.to_json(F.struct(*shown[kind]), {"ignoreNullFields": "false"})
    line = F.when(F.col("record_type") == "document", as_json("document")).otherwise(as_json("issue"))
    return rows.orderBy(F.lower("relative_path"), "relative_path").select(line.alias("line"))


def write_manifest(documents: DataFrame, issues: DataFrame, path: str) -> None:
    """One JSONL file in the shared store, in one order."""
    store.write_lines(manifest_lines(documents, issues), path)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, issues); fails on broken lines and on paths or ready ids that repeat."""
    raw = spark.read.text(path)
    rows = raw.select(F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    odd = rows.agg(F.count_if(~F.col("record_type").isin("document", "issue") | F.col("record_type").isNull()).alias("kind"), F.count_if(F.col("relative_path").isNull()).alias("path")).first()
    twice = rows.groupBy("relative_path").count().where("count > 1").isEmpty()
    ready = rows.where("record_type = 'document' AND inventory_status = 'ready'").groupBy("doc_id").count().where("count > 1").isEmpty()
    if odd["kind"] or odd["path"] or not twice or not ready:
        raise ContractError("manifest: unknown record, missing path, or repeated path or ready document")
    documents = rows.where("record_type = 'document'").select(*StructType.fromDDL(DOCUMENT).names)
    return documents, rows.where("record_type = 'issue'").select("relative_path", "file_size_bytes", "sha256", "reason")


def _check_csv(spark: SparkSession, path: str, columns: tuple[str, ...], strict: bool = True) -> bool:
    """The file must be UTF-8 with line feeds, a last one, and exactly this header; only the header comes to the driver.

    Where not ``strict``, as in files that other programs saved, a byte order mark and any line ends will do.
    Tasks check the lines of their part of the file.  Whether a field may hold a line end: some line has an odd number of quotes, or a return.
    """
    lines = spark.read.text(path, lineSep="\n")
    line = F.col("value")
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    found = lines.agg(F.count_if(~F.is_valid_utf8(line)).alias("invalid"), F.count_if(F.contains(line, F.lit("\r"))).alias("returns"), F.count_if(quotes % 2 == 1).alias("open")).first()
    first, (head, tail) = lines.first(), store.ends(spark, path, 3)
    # Readers of lines take a byte order mark away.
    if first is None or found["invalid"] or (strict and (found["returns"] or head == b"\xef\xbb\xbf" or not tail.endswith(b"\n"))):
        raise ContractError(f"{path}: not UTF-8 with line feeds and a last line feed")
    header = first["value"] if strict else first["value"].removeprefix("\ufeff").rstrip("\r")
    if tuple(next(csv.reader(io.StringIO(header)), ())) != columns:
        raise ContractError(f"{path}: header {first['value']}")
    return bool(found["open"] or found["returns"])


def read_strict_csv(spark: SparkSession, path: str, columns: tuple[str, ...], strict: bool = True) -> DataFrame:
    """All-string rows of a file that holds to the strict form, or at least to its header; tasks share the file where no field holds a line end."""
    whole = _check_csv(spark, path, columns, strict)
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", not strict).option("multiLine", whole).option("escape", '"').csv(path)


def csv_line(*columns: Column) -> Column:
    """Fields with commas between; a field that holds a comma, a quote or a line end stands in quotes."""
    def field(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(text)

    return F.concat_ws(",", *[field(c) for c in columns])


def write_strict_csv(path: str, columns: tuple[str, ...], rows: DataFrame, allow_identical: bool = False) -> None:
    """A table as one file in its order; an existing file is an error unless ``allow_identical``."""
    spark = rows.sparkSession
    if store.exists(spark, path) and not allow_identical:
        raise ContractError(f"{path} exists")
    head = io.StringIO()
    csv.writer(head, lineterminator="\n").writerow(columns)
    store.write_lines(rows.select(csv_line(*[F.col(c) for c in columns]).alias("line")), path, head.getvalue().encode())


LABEL_COLUMNS = ("sample_id", "label", "cause_code", "reviewer_note")


def read_labels(spark: SparkSession, path: str | None, sample: DataFrame) -> DataFrame:
    """The labels of a sample, empty causes and notes as null; no file is no labels."""
    if path is None or not store.exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in LABEL_COLUMNS))
    rows = read_strict_csv(spark, path, LABEL_COLUMNS, strict=False)
    rows = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in LABEL_COLUMNS})
    check_labels(rows, sample)
    return rows


def check_labels(labels: DataFrame, sample: DataFrame) -> None:
    broken = label_violations(labels, sample).where("violations > 0").collect()
    if broken:
        raise ContractError("labels: " + ", ".join(f"{r['rule']} {r['violations']}" for r in broken))


def label_violations(labels: DataFrame, sample: DataFrame) -> DataFrame:
    """(rule, violations): unknown and repeated samples, labels and causes outside their lists."""
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))
    unknown = count(labels.join(sample.select("sample_id"), "sample_id", "left_anti"), "unknown_sample")
    repeated = count(labels.groupBy("sample_id").count().where("count > 1"), "repeated_sample")
    label = count(labels.where(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))), "invalid_label")
    cause = count(labels.where(F.col("cause_code").isNotNull() & (F.col("cause_code") != "") & ~F.col("cause_code").isin(*CAUSES)), "invalid_cause")
    return unknown.unionByName(repeated).unionByName(label).unionByName(cause)


def shaped(df: DataFrame, name: str) -> DataFrame:
    """The columns of a release table in its types; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(RELEASE[name])])


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: a digest of a table that does not depend on order or partitions, and its row count.

    Row digests are summed in eight 32-bit parts, so no list of rows is ever built.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    hashed = df.select(row.alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(8)]
    summed = hashed.agg(F.count(F.lit(1)).alias("n"), *parts)
    return summed.select("n", F.sha2(F.concat_ws("|", "n", *[F.coalesce(F.col(f"p{k}").cast("string"), F.lit("0")) for k in range(8)]), 256).alias("fingerprint"))


def read_release(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(ddl).parquet(f"{path}/{name}.parquet") for name, ddl in RELEASE.items()}


def register_views(spark: SparkSession, path: str) -> None:
    for name, df in read_release(spark, path).items():
        df.createOrReplaceTempView(name)
