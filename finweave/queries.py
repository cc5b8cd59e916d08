"""Queries over the driver's tables, one or more for each operator family, with SQL that states the result apart from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.functions import ids, labels, numbers, periods, text, units
from finweave.operators import extraction, ledger, matching, normalization
from finweave.plans import audit, gate, profile
from finweave.sources import files
from finweave.sources.tables import staged
from finweave.sources.tables import table_fingerprint as fingerprint

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A release's tables told from the driver's rows; both engines read the same text.
VIEWS = {
    "docs": "SELECT concat('doc_', CAST(c_custkey AS STRING)) AS doc_id, concat('T', CAST(c_nationkey AS STRING)) AS company_code, CAST(2015 + c_custkey % 9 AS INT) AS report_year, CASE WHEN c_custkey % 4 = 0 THEN 'consolidated' WHEN c_custkey % 4 = 1 THEN 'separate' ELSE 'other' END AS statement_scope, CAST(c_custkey * 7919 % 100003 AS BIGINT) AS file_size_bytes, concat('h', CAST(c_custkey % 1400 AS STRING)) AS sha256 FROM customer",
    "tabs": "SELECT concat('tbl_', CAST(o_orderkey AS STRING)) AS table_id, concat('doc_', CAST(o_custkey AS STRING)) AS doc_id, CAST(o_orderkey % 7 AS INT) AS source_ordinal, CASE WHEN o_orderkey % 3 <> 0 THEN concat('Title ', CAST(o_orderkey % 50 AS STRING)) END AS title_raw, CASE WHEN o_orderkey % 4 = 0 THEN 'balance_sheet' WHEN o_orderkey % 4 = 1 THEN 'income_statement' WHEN o_orderkey % 4 = 2 THEN 'cash_flow_statement' END AS statement_type, CASE WHEN o_orderkey % 5 = 0 THEN 'VND_million' END AS unit_normalized, CASE WHEN o_orderkey % 5 = 0 THEN 'triệu đồng' END AS unit_raw, CAST(1 + o_orderkey % 40 AS INT) AS line_start, CAST(1 + o_orderkey % 40 + o_orderkey % 11 AS INT) AS line_end, CAST(2 + o_orderkey % 30 AS INT) AS row_count, CAST(2 + o_orderkey % 6 AS INT) AS column_count, CAST(0.75 AS DOUBLE) + CAST(o_orderkey % 4 AS DOUBLE) / 16 AS quality_score FROM orders",
    "cels": "SELECT concat('cell_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING)) AS cell_id, concat('tbl_', CAST(l_orderkey AS STRING)) AS table_id, CAST(l_linenumber AS INT) AS row_idx, CAST(l_linenumber % 3 AS INT) AS col_idx, l_returnflag AS row_label_raw, l_linestatus AS column_label_raw, CAST(l_partkey AS STRING) AS value_raw, CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_quantity AS DOUBLE) END AS value_numeric, CAST(l_linenumber AS INT) AS source_line_start, CAST(l_linenumber + 1 AS INT) AS source_line_end FROM lineitem",
    "iss": "SELECT CASE WHEN l_partkey % 4 = 0 THEN 'metric_unknown' WHEN l_partkey % 4 = 1 THEN 'number_invalid' WHEN l_partkey % 4 = 2 THEN 'unit_unknown' ELSE 'period_ambiguous' END AS code, CASE WHEN l_partkey % 4 = 0 THEN 'metric' WHEN l_partkey % 4 = 1 THEN 'number' WHEN l_partkey % 4 = 2 THEN 'unit' ELSE 'period' END AS field, concat('doc_', CAST(o_custkey AS STRING)) AS doc_id, concat('tbl_', CAST(l_orderkey AS STRING)) AS table_id, CASE WHEN l_linenumber <> 3 THEN concat('cell_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING)) END AS cell_id, CASE WHEN l_suppkey % 10 <> 0 THEN concat('v', CAST(l_suppkey % 17 AS STRING)) END AS raw_value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 1",
    "occ": "SELECT concat('src_', CAST(o_orderkey AS STRING)) AS source_table_id, concat('doc_', CAST(o_custkey AS STRING)) AS doc_id, CAST(o_orderkey % 7 AS INT) AS ordinal, CASE WHEN o_orderkey % 10 < 8 THEN 'canonical' WHEN o_orderkey % 10 = 8 THEN 'rejected' ELSE 'duplicate' END AS status, CASE WHEN o_orderkey % 10 <> 8 THEN concat('tbl_', CAST(o_orderkey AS STRING)) END AS canonical_table_id, CASE WHEN o_orderkey % 10 = 8 THEN (CASE WHEN o_orderkey % 20 = 8 THEN 'nested_html_table' ELSE 'span_collision' END) END AS rejection_code, CASE WHEN o_orderkey % 10 = 9 THEN 'other.txt' END AS duplicate_of_relative_path FROM orders",
    "labs": "SELECT CASE WHEN h % 5 < 2 THEN 'true_issue' WHEN h % 5 = 2 THEN 'false_positive' WHEN h % 5 = 3 THEN 'uncertain' END AS label, CASE WHEN h % 5 = 2 THEN (CASE WHEN h % 2 = 0 THEN 'ocr_corruption' ELSE 'other' END) END AS cause_code, issue_code, k FROM (SELECT event_id AS k, event_id % 7919 AS h, event_type AS issue_code FROM events) e",
    "ann": "SELECT concat('ann_', CAST(o_orderkey AS STRING)) AS annotation_id, concat('doc_', CAST(o_custkey AS STRING)) AS doc_id, CAST(1 + o_orderkey % 40 + o_orderkey % 3 AS INT) AS line_start, CAST(1 + o_orderkey % 40 + o_orderkey % 11 + o_orderkey % 2 AS INT) AS line_end FROM orders WHERE o_orderkey % 11 > 1",
}
FIELDS, SCOPES = ("metric", "number", "unit", "period"), ("consolidated", "other", "separate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over Parquet scans; the names in it stand for DataFrames, so no view is registered."""
    body = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"FROM {t}" in body or f"JOIN {t}" in body}
    for t in used:
        body = body.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(body, **used)


def query(name: str, *views: str, sql: str | None = None, with_: tuple[str, ...] | None = None):
    """Registers a query over views, and its SQL with those views as common tables."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql is not None:
            named = views if with_ is None else with_
            SQL[name] = ("WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in named) + " " if named else "") + sql
        return f

    return add


def on_tables(name: str, sql: str | None = None):
    """Registers a query that reads the driver's tables itself."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Coverage, distributions and ranks.
query("document_summary", "docs", sql="SELECT count(*) AS n_documents, count(DISTINCT doc_id) AS n_doc_id, count(DISTINCT company_code) AS n_company_code, count(DISTINCT report_year) AS n_report_year, count(DISTINCT statement_scope) AS n_statement_scope, min(report_year) AS first_year, max(report_year) AS last_year, round(avg(file_size_bytes), 2) AS avg_bytes, round(median(file_size_bytes), 2) AS median_bytes FROM docs")(profile.document_summary)
query("scope_matrix", "docs", sql="SELECT report_year, count(*) FILTER (statement_scope = 'consolidated') AS consolidated, count(*) FILTER (statement_scope = 'other') AS other, count(*) FILTER (statement_scope = 'separate') AS separate FROM docs GROUP BY report_year")(lambda d: profile.scope_matrix(d, SCOPES))
query("company_coverage", "docs", sql="SELECT company_code, count(*) AS n_documents, count(DISTINCT report_year) AS n_years, count(DISTINCT statement_scope) AS n_scopes, min(report_year) AS first_year, max(report_year) AS last_year FROM docs GROUP BY company_code")(profile.company_coverage)
query("coverage_heatmap", "docs", sql="SELECT company_code, count(*) FILTER (report_year = 2016) AS \"2016\", count(*) FILTER (report_year = 2020) AS \"2020\" FROM docs WHERE company_code IN (SELECT company_code FROM docs GROUP BY company_code ORDER BY count(*) DESC, company_code LIMIT 10) GROUP BY company_code")(lambda d: profile.coverage_heatmap(d, (2016, 2020), 10))
query("table_summary", "tabs", sql="SELECT count(*) AS n_tables, count(DISTINCT doc_id) AS n_documents, CAST(sum(row_count * column_count) AS BIGINT) AS estimated_cells, round(avg(row_count), 4) AS avg_rows, round(avg(column_count), 4) AS avg_columns, round(avg(quality_score), 4) AS avg_quality, count(*) FILTER (title_raw IS NULL) AS no_title, count(*) FILTER (statement_type IS NULL) AS no_statement, count(*) FILTER (unit_normalized IS NULL) AS no_unit FROM tabs")(profile.table_summary)
query("missingness", "tabs", sql=" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2)::DOUBLE AS percent FROM tabs" for c in ("table_id", "title_raw", "statement_type", "unit_normalized")))(lambda t: profile.missingness(t.select("table_id", "title_raw", "statement_type", "unit_normalized")))
query("statement_distribution", "tabs", sql="SELECT coalesce(statement_type, '(missing)') AS value, count(*) AS n FROM tabs GROUP BY 1")(lambda t: profile.distribution(t, "statement_type"))
on_tables("exact_quantiles", "SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0])::DOUBLE AS level, round(unnest(quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0])), 6) AS value FROM lineitem")(lambda s, d: profile.exact_quantiles(table(s, d, "lineitem"), "l_extendedprice"))
on_tables("describe_quantity", "SELECT count(l_quantity) AS count, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, round(min(l_quantity), 4) AS min, round(quantile_cont(l_quantity, 0.5), 4) AS p50, round(quantile_cont(l_quantity, 0.75), 4) AS p75, round(quantile_cont(l_quantity, 0.9), 4) AS p90, round(quantile_cont(l_quantity, 0.95), 4) AS p95, round(quantile_cont(l_quantity, 0.99), 4) AS p99, round(max(l_quantity), 4) AS max FROM lineitem")(lambda s, d: profile.describe(table(s, d, "lineitem"), "l_quantity"))
query("occurrence_status", "occ", sql="SELECT status, count(*) AS n, count(DISTINCT doc_id) AS n_documents, count(DISTINCT canonical_table_id) AS n_tables FROM occ GROUP BY status")(profile.status_summary)
query("occurrence_status_counts", "occ", sql="SELECT s.status, count(occ.status) AS n FROM (VALUES ('canonical'), ('rejected'), ('duplicate')) s(status) LEFT JOIN occ USING (status) GROUP BY s.status")(ledger.status_counts)
query("occurrence_invariants", "occ", sql="SELECT 'known_status' AS rule, count(*) FILTER (ordinal = 6) AS violations FROM occ UNION ALL SELECT 'canonical_shape', count(*) FILTER (ordinal = 5 AND status = 'canonical') FROM occ UNION ALL SELECT 'rejected_shape', count(*) FILTER (ordinal = 4 AND status = 'rejected') FROM occ UNION ALL SELECT 'duplicate_shape', count(*) FILTER (ordinal = 3 AND status = 'duplicate') FROM occ UNION ALL SELECT 'unique_id', count(*) FROM (SELECT source_table_id FROM occ WHERE ordinal = 2 GROUP BY 1)")(
    lambda o: ledger.occurrence_violations(
        o.withColumns({
            "status": F.when(F.col("ordinal") == 6, F.lit("odd")).otherwise(F.col("status")), "canonical_table_id": F.when(F.col("ordinal") != 5, F.col("canonical_table_id")),
            "rejection_code": F.when(F.col("ordinal") != 4, F.col("rejection_code")), "duplicate_of_relative_path": F.when(F.col("ordinal") != 3, F.col("duplicate_of_relative_path")),
        }).unionByName(o.where("ordinal = 2 AND status = 'canonical'")).unionByName(o.where("ordinal = 2 AND status <> 'canonical'"))
    )
)
query("rejection_histogram", "occ", sql="SELECT rejection_code, count(*) AS n FROM occ WHERE rejection_code IS NOT NULL GROUP BY 1")(profile.rejection_histogram)
query("issue_shares", "iss", sql="SELECT code, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM iss GROUP BY code")(profile.issue_shares)
query("issue_matrix", "iss", sql="SELECT code, " + ", ".join(f"count(*) FILTER (field = '{f}') AS {f}" for f in FIELDS) + " FROM iss GROUP BY code")(lambda i: profile.issue_matrix(i, FIELDS))
query("affected_rates", "iss", "cels", sql="SELECT *, round(n_issues * 100.0 / n_cells, 4)::DOUBLE AS per_100_cells FROM (SELECT count(*) AS n_issues, count(DISTINCT cell_id) AS n_cell_id, count(DISTINCT table_id) AS n_table_id, count(DISTINCT doc_id) AS n_doc_id FROM iss), (SELECT count(*) AS n_cells FROM cels)")(profile.affected_rates)
query("top_values", "iss", sql="SELECT code, raw_value, n, place FROM (SELECT code, raw_value, count(*) AS n, CAST(row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, raw_value ASC NULLS LAST) AS INT) AS place FROM iss GROUP BY code, raw_value) WHERE place <= 10")(profile.top_values)
query("issues_by_document", "docs", "iss", sql="SELECT docs.doc_id, company_code, count(iss.doc_id) AS n_issues FROM docs LEFT JOIN iss ON docs.doc_id = iss.doc_id GROUP BY docs.doc_id, company_code")(profile.issues_by_document)
query("largest_tables", "tabs", "docs", sql="SELECT table_id, doc_id, company_code, estimated_cells FROM (SELECT table_id, doc_id, CAST(row_count * column_count AS BIGINT) AS estimated_cells FROM tabs ORDER BY 3 DESC, table_id LIMIT 20) JOIN docs USING (doc_id)")(profile.largest_tables)
query("provenance", "iss", "tabs", "occ", "docs", sql="SELECT iss.cell_id, iss.table_id, iss.doc_id, company_code, report_year, occ.ordinal, occ.status, line_start, line_end FROM iss JOIN tabs USING (table_id, doc_id) LEFT JOIN occ ON occ.canonical_table_id = iss.table_id AND occ.doc_id = iss.doc_id JOIN docs ON docs.doc_id = iss.doc_id WHERE code = 'unit_unknown' ORDER BY iss.table_id, iss.cell_id NULLS FIRST LIMIT 25")(lambda i, t, o, d: profile.provenance(i, t, o, d, "unit_unknown"))
query("multiple_digests", "docs", sql="SELECT sha256, count(*) AS n FROM docs GROUP BY 1 HAVING count(*) > 1")(lambda d: profile.multiple_keys(d, "sha256"))
query("anomalies", "docs", sql="SELECT count(*) FILTER (file_size_bytes BETWEEN 0 AND 1023) AS tiny, count(*) FILTER (file_size_bytes > (SELECT quantile_cont(file_size_bytes, 0.995) FROM docs)) AS oversized, count(*) FILTER (report_year NOT BETWEEN 2016 AND 2022) AS odd_years, (SELECT coalesce(sum(m), 0)::BIGINT FROM (SELECT count(*) AS m FROM docs GROUP BY sha256 HAVING count(*) > 1)) AS repeated FROM docs")(lambda d: profile.anomalies(d, (2016, 2022)))
query("quick_look", "iss", sql="SELECT sum(m)::BIGINT AS n_rows, sum(m - 1)::BIGINT AS n_repeated, 6 AS n_columns FROM (SELECT count(*) AS m FROM iss GROUP BY code, field, doc_id, table_id, cell_id, raw_value)")(profile.quick_look)
TEXTS, FIGURES = ("table_id", "title_raw", "statement_type", "unit_raw"), ("line_start", "row_count", "quality_score")
DESCRIBED = " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique, (SELECT {c} FROM tabs WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top, (SELECT count(*) FROM tabs WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS frequency, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, NULL::DOUBLE AS p75, NULL::DOUBLE AS max FROM tabs" for c in TEXTS]
    + [f"SELECT '{c}', count({c}), count(*) - count({c}), NULL, NULL, NULL, round(avg({c}), 4), round(stddev_samp({c}), 4), min({c})::DOUBLE, round(quantile_cont({c}, 0.25), 4)::DOUBLE, round(quantile_cont({c}, 0.5), 4)::DOUBLE, round(quantile_cont({c}, 0.75), 4)::DOUBLE, max({c})::DOUBLE FROM tabs" for c in FIGURES]
)
query("describe_all", "tabs", sql=f"SELECT * FROM ({DESCRIBED}) d")(lambda t: profile.describe_all(t.select(*TEXTS, *FIGURES)))
query("seeded_sample", "docs", sql="SELECT doc_id, company_code FROM docs ORDER BY sha256(concat('seed|', doc_id)), doc_id LIMIT 25")(lambda d: profile.seeded_sample(d.select("doc_id", "company_code"), "doc_id", "seed", 25))
query("download_plan", "docs", sql="SELECT count(*) AS file_count, sum(file_size_bytes)::BIGINT AS total_bytes, count(*) FILTER (report_year > 2018) AS pending_count, sum(file_size_bytes) FILTER (report_year > 2018)::BIGINT AS pending_bytes, 1::BIGINT AS n_revisions, sum(file_size_bytes) FILTER (report_year > 2018) + 1000 <= 1000000000000 AS fits FROM docs")(lambda d: profile.download_plan(d.select(F.col("file_size_bytes").alias("size"), (F.col("report_year") > 2018).alias("will_download"), F.lit("r1").alias("revision")), 1000, 10**12))
QUERIES["company_issues"] = lambda s, d: profile.company_issues(s, view(s, d, "iss"), view(s, d, "docs"), "T3")
SQL["company_issues"] = f"WITH iss AS ({VIEWS['iss']}), docs AS ({VIEWS['docs']}) SELECT report_year, code, count(*) AS n FROM iss JOIN docs USING (doc_id) WHERE company_code = 'T3' GROUP BY 1, 2"
QUERIES["table_drilldown"] = lambda s, d: profile.table_drilldown(s, view(s, d, "tabs"), view(s, d, "occ"), view(s, d, "iss"), "tbl_5", 10)[2].select("code", "cell_id", "raw_value")
SQL["table_drilldown"] = f"WITH iss AS ({VIEWS['iss']}) SELECT code, cell_id, raw_value FROM iss WHERE table_id = 'tbl_5' ORDER BY code, cell_id NULLS FIRST LIMIT 10"

# Integrity.
query("referential_integrity", "iss", "tabs", "cels", "docs", sql="SELECT 'table_document' AS rule, count(*) AS violations FROM tabs WHERE doc_id NOT IN (SELECT doc_id FROM docs) UNION ALL SELECT 'cell_table', count(*) FROM cels WHERE table_id NOT IN (SELECT table_id FROM tabs) UNION ALL SELECT 'issue_cell', count(*) FROM iss WHERE cell_id IS NULL OR cell_id NOT IN (SELECT cell_id FROM cels) UNION ALL SELECT 'unique_documents', count(*) FROM (SELECT doc_id FROM docs GROUP BY 1 HAVING count(*) > 1)")(
    lambda i, t, c, d: ledger.stacked(ledger.orphans(t, d, "table_document", "doc_id"), ledger.orphans(c, t, "cell_table", "table_id"), ledger.orphans(i, c, "issue_cell", "cell_id"), ledger.repeated(d, "unique_documents", "doc_id"))
)
query("row_constraints", "tabs", sql="SELECT 'lines' AS rule, count(*) FILTER (NOT (line_end >= line_start + 5)) AS violations FROM tabs UNION ALL SELECT 'shape', count(*) FILTER (NOT (row_count > 2)) FROM tabs UNION ALL SELECT 'titled', count(*) FILTER (title_raw IS NULL) FROM tabs")(
    lambda t: ledger.violations(t, {"lines": F.col("line_end") >= F.col("line_start") + 5, "shape": F.col("row_count") > 2, "titled": F.col("title_raw").isNotNull()})
)
query("issue_references", "iss", "docs", "tabs", "cels", sql="SELECT (SELECT count(*) FROM iss WHERE doc_id NOT IN (SELECT doc_id FROM docs)) AS documents, (SELECT count(*) FROM iss WHERE table_id NOT IN (SELECT table_id FROM tabs)) AS tables, (SELECT count(*) FROM iss WHERE cell_id IS NOT NULL AND cell_id NOT IN (SELECT cell_id FROM cels)) AS cells")(audit.reference_violations)

# Audit.
CONTEXT = "SELECT iss.code AS issue_code, iss.field, iss.doc_id, iss.table_id, iss.cell_id, iss.raw_value, company_code, report_year, statement_type, row_label_raw, value_raw, CASE WHEN iss.cell_id IS NULL THEN tabs.line_start ELSE cels.source_line_start END AS source_line_start, CASE WHEN iss.cell_id IS NULL THEN tabs.line_end ELSE cels.source_line_end END AS source_line_end FROM iss JOIN docs ON docs.doc_id = iss.doc_id LEFT JOIN tabs ON tabs.table_id = iss.table_id LEFT JOIN cels ON cels.cell_id = iss.cell_id"
query("issue_context", "iss", "docs", "tabs", "cels", sql=CONTEXT)(lambda *v: audit.issue_context(*v).select("issue_code", "field", "doc_id", "table_id", "cell_id", "raw_value", "company_code", "report_year", "statement_type", "row_label_raw", "value_raw", "source_line_start", "source_line_end"))
KEYED = f"SELECT *, sha256(concat('{audit.SEED}|', sample_id)) AS selection_rank, concat(issue_code, '|', company_code, '|', CAST(report_year AS STRING), '|', coalesce(statement_type, ''), '|', lower(trim(coalesce(raw_value, '')))) AS stratum_key FROM (SELECT *, sha256(concat('fp|', issue_code, '|', doc_id, '|', table_id, '|', coalesce(cell_id, ''), '|', field, '|', coalesce(raw_value, ''))) AS sample_id FROM ({CONTEXT}) c) k"
query("stratified_sample", "iss", "docs", "tabs", "cels", sql=f"SELECT sample_id, issue_code, doc_id, stratum_key, selection_rank FROM (SELECT *, row_number() OVER (PARTITION BY issue_code ORDER BY selection_rank, sample_id) AS m FROM (SELECT *, row_number() OVER (PARTITION BY issue_code, stratum_key ORDER BY selection_rank, sample_id) AS n FROM ({KEYED}) q) WHERE n <= 5) WHERE m <= CASE WHEN issue_code = 'period_ambiguous' THEN 100 ELSE 200 END")(
    lambda i, d, t, c: audit.sample_rows(i, d, t, c, "fp").select("sample_id", "issue_code", "doc_id", "stratum_key", "selection_rank")
)
METRICS = "count(*) AS samples, count(*) FILTER (label = 'true_issue') AS true_issues, count(*) FILTER (label = 'false_positive') AS false_positives, count(*) FILTER (label = 'uncertain') AS uncertain, count(*) FILTER (label IS NULL) AS unlabeled, round(count(*) FILTER (label IN ('true_issue', 'false_positive'))::DOUBLE / count(*), 4) AS coverage, round(count(*) FILTER (label = 'false_positive')::DOUBLE / count(*) FILTER (label IN ('true_issue', 'false_positive')), 4) AS false_positive_rate"


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("coverage", "false_positive_rate")})


query("label_metrics", "labs", sql=f"SELECT m.*, coalesce(causes, '') AS causes FROM (SELECT issue_code, {METRICS} FROM labs GROUP BY issue_code) m LEFT JOIN (SELECT issue_code, string_agg(concat(cause_code, '=', CAST(n AS STRING)), ';' ORDER BY cause_code) AS causes FROM (SELECT issue_code, cause_code, count(*) AS n FROM labs WHERE cause_code IS NOT NULL GROUP BY 1, 2) GROUP BY 1) c USING (issue_code)")(lambda rows: _rates(audit.label_metrics(rows)))
query("label_metrics_overall", "labs", sql=f"SELECT {METRICS} FROM labs")(lambda rows: _rates(audit.label_metrics(rows, by_code=False)))
query("issues_still_present", "iss", sql="SELECT doc_id, table_id, cell_id, code, field, EXISTS (SELECT 1 FROM iss l WHERE l.raw_value = 'v3' AND l.doc_id = i.doc_id AND l.table_id = i.table_id AND coalesce(l.cell_id, 'None') = coalesce(i.cell_id, 'None') AND l.field = i.field AND l.code = i.code) AS present FROM iss i")(lambda i: audit.still_present(i.withColumnRenamed("code", "issue_code"), i.where("raw_value = 'v3'")).select("doc_id", "table_id", "cell_id", F.col("issue_code").alias("code"), "field", "present"))
query("changed_context", "iss", "tabs", "cels", sql="SELECT count(*) FILTER (cell_id IS NOT NULL AND value_raw IS DISTINCT FROM (CASE WHEN l % 3 = 0 THEN 'changed' ELSE value_raw END)) AS cells, count(*) FILTER (title_raw IS NOT NULL AND o % 2 = 0) AS tables FROM (SELECT iss.cell_id, cels.value_raw, cels.row_idx AS l, tabs.title_raw, tabs.source_ordinal AS o FROM iss LEFT JOIN cels ON cels.cell_id = iss.cell_id LEFT JOIN tabs ON tabs.table_id = iss.table_id)")(
    lambda i, t, c: audit.context_violations(
        i.join(t.select("table_id", F.col("title_raw").alias("table_title_raw"), F.col("unit_raw").alias("table_unit_raw")), "table_id", "left").join(c.select("cell_id", "row_label_raw", "column_label_raw", "value_raw"), "cell_id", "left"),
        t.withColumn("title_raw", F.when((F.col("source_ordinal") % 2 == 0) & F.col("title_raw").isNotNull(), F.lit("changed")).otherwise(F.col("title_raw"))),
        c.withColumn("value_raw", F.when(F.col("row_idx") % 3 == 0, F.lit("changed")).otherwise(F.col("value_raw"))),
    )
)

# Gate.
RANK = "sha256(concat('week1-pilot-v1', chr(10), '{0}', chr(10), {1}))"
DOC_RANK = RANK.format("document", "doc_id")
STRATUM_RANK = RANK.format("stratum", "company_code, chr(10), CAST(report_year AS STRING), chr(10), statement_scope")
query("pilot_documents", "docs", sql=f"SELECT doc_id, company_code, pick FROM (SELECT *, CAST(row_number() OVER (PARTITION BY company_code ORDER BY is_fill, CASE WHEN is_fill = 0 THEN stratum_rank ELSE document_rank END, doc_id) AS INT) AS pick FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY company_code, report_year, statement_scope ORDER BY document_rank, doc_id) > 1 THEN 1 ELSE 0 END AS is_fill FROM (SELECT *, {DOC_RANK} AS document_rank, {STRATUM_RANK} AS stratum_rank FROM docs WHERE company_code IN (SELECT company_code FROM docs GROUP BY company_code HAVING count(*) >= 3 ORDER BY {RANK.format('company', 'company_code')}, company_code LIMIT 20)))) WHERE pick <= 3")(lambda d: gate.pick_documents(d).select("doc_id", "company_code", "pick"))
CELL_RANK, BUCKET_RANK = RANK.format("audit_cell", "cell_id"), RANK.format("cell_stratum", "company_code, chr(10), CAST(report_year AS STRING), chr(10), coalesce(statement_type, '')")
query("audit_cells", "cels", "tabs", "docs", sql=f"SELECT cell_id, table_id FROM (SELECT *, row_number() OVER (PARTITION BY company_code, report_year, statement_type ORDER BY cell_rank, cell_id) AS round FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY cell_rank, cell_id) AS t FROM (SELECT cell_id, table_id, company_code, report_year, statement_type, {CELL_RANK} AS cell_rank, {BUCKET_RANK} AS bucket_rank FROM cels JOIN tabs USING (table_id) JOIN docs USING (doc_id))) WHERE t <= 2) ORDER BY round, bucket_rank, cell_id LIMIT 30")(
    lambda c, t, d: gate.pick_cells(c.select("cell_id", "table_id").join(t.select("table_id", "doc_id", "statement_type").join(d.select("doc_id", "company_code", "report_year"), "doc_id"), "table_id")).select("cell_id", "table_id")
)
query("interval_overlap", "ann", "tabs", sql="SELECT ann.doc_id, annotation_id, table_id, CAST(ann.line_start = tabs.line_start AND ann.line_end = tabs.line_end AS INT) AS exact, CAST(least(ann.line_end, tabs.line_end) - greatest(ann.line_start, tabs.line_start) + 1 AS BIGINT) AS overlap, CAST(ann.line_end - ann.line_start + 1 AS BIGINT) AS span, CAST(abs(ann.line_start - tabs.line_start) + abs(ann.line_end - tabs.line_end) AS BIGINT) AS distance FROM ann JOIN tabs ON ann.doc_id = tabs.doc_id AND ann.line_start <= tabs.line_end AND tabs.line_start <= ann.line_end")(matching.overlapping_pairs)
#: All overlaps compete; SQL cannot state the best assignment, and a test compares it with brute force.
query("table_assignment", "ann", "tabs")(lambda a, t: matching.assign_tables(staged(matching.overlapping_pairs(a, t), "overlapping-pairs"), a))
ASSESSED = "SELECT table_id, doc_id, statement_type, source_ordinal % 3 <> 0 AS usable FROM tabs WHERE statement_type IS NOT NULL"


def _assessed(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    rows = t.where("statement_type IS NOT NULL").withColumn("usable", F.col("source_ordinal") % 3 != 0)
    return rows if d is None else rows.join(d, "doc_id")


query("statement_metrics", "tabs", sql=f"SELECT statement_type, count(*) AS expected, count(*) AS matched, count(*) FILTER (usable) AS usable FROM ({ASSESSED}) a GROUP BY 1")(lambda t: gate.statement_metrics(_assessed(t)))
query("stratum_metrics", "tabs", "docs", sql=f"SELECT company_code, report_year, statement_type, count(*) AS n, count(*) FILTER (usable) AS usable, count(*) >= 10 AS included, count(*) < 10 OR count(*) FILTER (usable) * 100 >= count(*) * 70 AS passed FROM ({ASSESSED}) a JOIN docs USING (doc_id) GROUP BY 1, 2, 3")(lambda t, d: gate.stratum_metrics(_assessed(t, d)))
query("pareto", "iss", sql="SELECT code, n AS count, CAST(sum(n) OVER w AS BIGINT) AS cumulative, concat(CAST(CAST(round(n * 100::DECIMAL(20,0) / sum(n) OVER (), 2) AS DECIMAL(6,2)) AS STRING), '%') AS share, concat(CAST(CAST(round((sum(n) OVER w) * 100::DECIMAL(20,0) / sum(n) OVER (), 2) AS DECIMAL(6,2)) AS STRING), '%') AS cumulative_share FROM (SELECT code, count(*) AS n FROM iss GROUP BY 1) WINDOW w AS (ORDER BY n DESC, code ROWS UNBOUNDED PRECEDING)")(gate.pareto)
#: One row for each company: its documents, tables and cells as the numbers of a gate of its own.
GATES = "SELECT company_code, count(DISTINCT docs.doc_id) AS documents, count(DISTINCT CASE WHEN statement_type = 'balance_sheet' THEN table_id END) AS fewest, count(DISTINCT CASE WHEN source_ordinal % 3 <> 0 THEN table_id END) AS usable, count(DISTINCT table_id) AS tables, count(DISTINCT CASE WHEN line_start > 2 THEN table_id END) AS valid, count(DISTINCT report_year) AS strata, count(DISTINCT CASE WHEN title_raw IS NOT NULL THEN report_year END) AS passing, count(DISTINCT unit_raw) + 29 AS audited FROM docs LEFT JOIN tabs ON docs.doc_id = tabs.doc_id GROUP BY company_code"
query("gate_checks", "docs", "tabs", sql=f"SELECT company_code, documents = 60 AS pilot_documents, fewest >= 30 AS expected_tables, tables > 0 AND usable * 100 >= tables * 85 AS table_usability, tables > 0 AND valid = tables AS provenance, audited = 30 AS manual_audit, strata = passing AS strata FROM ({GATES}) g")(
    lambda d, t: d.join(t.withColumnRenamed("doc_id", "t_doc"), F.col("doc_id") == F.col("t_doc"), "left")
    .groupBy("company_code")
    .agg(*[F.count_distinct(c).alias(n) for n, c in {"d": F.col("doc_id"), "f": F.when(F.col("statement_type") == "balance_sheet", F.col("table_id")), "u": F.when(F.col("source_ordinal") % 3 != 0, F.col("table_id")), "t": F.col("table_id"), "v": F.when(F.col("line_start") > 2, F.col("table_id")), "s": F.col("report_year"), "p": F.when(F.col("title_raw").isNotNull(), F.col("report_year")), "a": F.col("unit_raw")}.items()])
    .select("company_code", *[c.alias(k) for k, c in gate.gate_checks(F.col("d"), F.col("f"), F.col("u"), F.col("t"), F.col("v"), F.col("t"), F.col("a") + 29, F.col("s"), F.col("p")).items()])
)
query("audit_immutability", "cels", sql="SELECT count(*) FILTER (row_idx = 1) AS missing, 0::BIGINT AS unknown, count(*) FILTER (row_idx = 2) AS changed, count(*) FILTER (row_idx = 3) AS unmarked FROM cels")(
    lambda c: gate.audit_changes(c, c.where("row_idx <> 1").withColumn("value_raw", F.when(F.col("row_idx") == 2, F.lit("x")).otherwise(F.col("value_raw"))).withColumn("verified", F.when(F.col("row_idx") != 3, F.lit("true")).otherwise(F.lit("maybe"))), ("value_raw", "row_label_raw"))
)
query("cell_eligibility", "cels", sql="SELECT cell_id, value_numeric IS NOT NULL AND col_idx <> 0 AND row_idx % 5 <> 0 AS calculable, value_numeric IS NOT NULL AND NOT (col_idx <> 0 AND row_idx % 5 <> 0) AS comparable, value_numeric IS NULL AS searchable FROM cels")(
    lambda c: normalization.cell_eligibility(c.withColumn("row_label_canonical", F.lit("revenue")).withColumn("period", F.lit("2023")).withColumn("unit", F.when(F.col("col_idx") != 0, F.lit("VND")).otherwise(F.lit("ratio"))).withColumn("issue_codes", F.when(F.col("row_idx") % 5 == 0, F.array(F.lit("unit_conflict"))).otherwise(F.array(F.lit("metric_unknown"))))).select("cell_id", "calculable", "comparable", "searchable")
)

# Scalars.
GROUPED = "CASE WHEN i >= 1000000 THEN concat(CAST(i {d} 1000000 AS STRING), '.', lpad(CAST(i {d} 1000 % 1000 AS STRING), 3, '0'), '.', lpad(CAST(i % 1000 AS STRING), 3, '0')) WHEN i >= 1000 THEN concat(CAST(i {d} 1000 AS STRING), '.', lpad(CAST(i % 1000 AS STRING), 3, '0')) ELSE CAST(i AS STRING) END"


@on_tables(
    "number_parser",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_linenumber IN (1, 4) THEN c / 100.0 WHEN l_linenumber = 2 THEN -c / 100.0 WHEN l_linenumber = 3 THEN i WHEN l_linenumber = 5 THEN -i END AS DOUBLE) AS value, CASE WHEN l_linenumber = 4 THEN 'percent' END AS hint, CASE WHEN l_linenumber = 6 THEN 'number_invalid' WHEN l_linenumber = 7 THEN 'number_ambiguous' END AS issue FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(round(l_extendedprice * 100) AS BIGINT) // 100 AS i FROM lineitem)",
)
def number_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices printed in seven ways, by line number, and read back."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cents.alias("c"), F.floor(cents / 100).cast("long").alias("i"))
    dotted = F.expr(GROUPED.format(d="div"))
    full = F.concat(dotted, F.lit(","), F.lpad((F.col("c") % 100).cast("string"), 2, "0"))
    n = F.col("l_linenumber")
    raw = F.when(n == 1, full).when(n == 2, F.concat(F.lit("("), full, F.lit(")"))).when(n == 3, F.col("i").cast("string")).when(n == 4, F.concat(full, F.lit(" %"))).when(n == 5, F.concat(F.lit("-"), F.col("i").cast("string"))).when(n == 6, F.concat(full, F.lit(" VND"))).otherwise(F.concat(F.lit("1234."), F.lpad((F.col("i") % 1000).cast("string"), 3, "0")))
    out = numbers.with_number(rows.withColumn("raw", raw), "raw", "v", "hint", "issue")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("v").cast("double").alias("value"), "hint", "issue")


#: ASCII digits and marks, and their wide forms.
NARROW, WIDE = "0123456789.,()%-", "０１２３４５６７８９．，（）％－"


@on_tables(
    "wide_numbers",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE l_linenumber WHEN 1 THEN c / 100.0 WHEN 2 THEN -c / 100.0 WHEN 3 THEN i % 1000000 WHEN 4 THEN c / 100.0 WHEN 5 THEN -i WHEN 6 THEN -(1 + i % 9) END AS DOUBLE) AS value, CASE WHEN l_linenumber = 4 THEN 'percent' END AS hint, CASE WHEN l_linenumber > 6 THEN CASE i % 3 WHEN 0 THEN 'number_missing' WHEN 1 THEN 'number_ambiguous' ELSE 'number_invalid' END END AS issue, l_linenumber <= 6 OR i % 3 = 1 AS candidate FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(round(l_extendedprice * 100) AS BIGINT) // 100 AS i FROM lineitem)",
)
def wide_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in wide digits and marks, between no-break spaces, raised and in brackets of one character, and read back."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cents.alias("c"), F.floor(cents / 100).cast("long").alias("i"))
    wide = lambda c: F.translate(c, NARROW, WIDE)
    full = F.concat(F.expr(GROUPED.format(d="div")), F.lit(","), F.lpad((F.col("c") % 100).cast("string"), 2, "0"))
    n, i = F.col("l_linenumber"), F.col("i")
    spaced = F.concat((i % 1000000 / 1000).cast("long").cast("string"), F.lit("\u00a0"), F.lpad((i % 1000).cast("string"), 3, "0"))
    circled = F.get(F.array(*[F.lit(chr(0x2474 + k)) for k in range(9)]), (i % 9).cast("int"))
    other = F.when(i % 3 == 0, F.lit("Ｎ／Ａ")).when(i % 3 == 1, F.lit("１２３４．５６⁷")).otherwise(F.lit("１２３ Ⅻ"))
    raw = F.when(n == 1, wide(full)).when(n == 2, wide(F.concat(F.lit("("), full, F.lit(")")))).when(n == 3, spaced).when(n == 4, wide(F.concat(full, F.lit("\u3000%")))).when(n == 5, wide(F.concat(F.lit("-"), i.cast("string")))).when(n == 6, circled).otherwise(other)
    out = numbers.with_number(rows.withColumn("raw", raw), "raw", "v", "hint", "issue")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("v").cast("double").alias("value"), "hint", "issue", numbers.is_numeric_candidate(F.col("raw")).alias("candidate"))


@on_tables(
    "period_parser",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 6 = 1 THEN concat(CAST(year(o_orderdate) AS STRING), '-Q', CAST(quarter(o_orderdate) AS STRING)) WHEN o_orderkey % 6 = 2 THEN CAST(year(o_orderdate) AS STRING) WHEN o_orderkey % 6 = 3 THEN concat('2020-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) WHEN o_orderkey % 6 = 4 AND day(o_orderdate) > 12 THEN concat('20', lpad(CAST(year(o_orderdate) % 100 AS STRING), 2, '0'), strftime(o_orderdate, '-%m-%d')) END AS period, CASE WHEN o_orderkey % 6 = 4 AND day(o_orderdate) <= 12 THEN 'period_ambiguous' WHEN o_orderkey % 6 = 5 THEN 'period_incomplete' END AS issue FROM orders",
)
def period_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates printed as dates, quarters, years, months and fragments, and read back."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.concat(F.lit("Quý "), F.quarter(d).cast("string"), F.lit("/"), F.year(d).cast("string"))).when(k == 2, F.concat(F.lit("Năm  "), F.year(d).cast("string"))).when(k == 3, F.concat(F.lit("Tháng "), F.month(d).cast("string"))).when(k == 4, F.date_format(d, "d-M-yy")).otherwise(F.lit("Quý đầu"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", periods.normalize_period(text.native_key(raw), F.lit(2020)).alias("p"))
    return rows.select("o_orderkey", F.col("p.value").alias("period"), F.col("p.issue_code").alias("issue"))


UNIT_TEXTS = (("Đơn vị tính: triệu đồng", "VND_million", None), ("ĐVT: tỷ đồng", "VND_billion", None), ("Tỷ lệ (%)", "percent", None), ("năm 2023", None, None), ("đồng thau", None, "unit_unknown"), ("Ngàn  VNĐ", "VND_thousand", None), ("lần", "ratio", None))


@on_tables("unit_parser", "SELECT p_partkey, CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{u}'" for k, (_, u, _i) in enumerate(UNIT_TEXTS) if u) + " END AS unit, CASE WHEN p_partkey % 7 = 4 THEN 'unit_unknown' END AS issue, CAST(CASE p_partkey % 7 WHEN 0 THEN p_size * 1000000 WHEN 1 THEN p_size * 1000000000::BIGINT WHEN 2 THEN p_size * 0.01 WHEN 5 THEN p_size * 1000 WHEN 6 THEN p_size END AS DOUBLE) AS economic FROM part")
def unit_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit texts by key, and the economic value of the size in that unit."""
    raw = F.get(F.array(*[F.lit(t) for t, *_ in UNIT_TEXTS]), (F.col("p_partkey") % 7).cast("int"))
    key = text.native_key(raw)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", units.normalize_unit(key).alias("unit"), units.unit_issue(key).alias("issue"))
    return rows.select("p_partkey", "unit", "issue", units.economic_value(F.col("p_size").cast("decimal(20,2)"), F.col("unit")).cast("double").alias("economic"))


@on_tables("unit_resolution", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'percent' WHEN 1 THEN 'VND_million' WHEN 4 THEN 'percent' END AS unit, CASE p_partkey % 5 WHEN 2 THEN 'unit_conflict' WHEN 3 THEN 'unit_unknown' END AS issue FROM part")
def unit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of cell, column and table against each other."""
    k = F.col("p_partkey") % 5
    none = F.lit(None).cast("string")
    hint = F.when(k == 0, F.lit("percent")).otherwise(none)
    column = F.when(k == 2, F.lit("nghìn đồng")).when(k == 3, F.lit("công ty")).when(k == 4, F.lit("tỷ lệ (%)")).otherwise(none)
    whole = F.when(k.isin(0, 1, 2, 4), F.lit("đơn vị tính: triệu đồng")).otherwise(none)
    rows = table(spark, sf_dir, "part").select("p_partkey", units.resolve_unit(hint, column, column, whole).alias("u"))
    return rows.select("p_partkey", F.col("u.value").alias("unit"), F.col("u.issue_code").alias("issue"))


#: Column headers in capitals and composed letters.
HEADERS = ("TRIỆU ĐỒNG", "ĐỒNG", "VNĐ", "SỐ TIỀN (TỶ ĐỒNG)", "PHẦN TRĂM", "LẦN", "NĂM 2023", "DONG")


@on_tables("unit_headers", "SELECT p_partkey, p_size % 2 = 0 AS in_table, CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN CASE WHEN p_size % 2 = 0 THEN {a} ELSE {b} END" for k, (a, b) in enumerate((("'VND_million'", "'VND_million'"), ("NULL", "'VND'"), ("NULL", "'VND'"), ("NULL", "'VND_billion'"), ("'percent'", "'percent'"), ("'ratio'", "'ratio'"), ("'VND_million'", "NULL"), ("NULL", "'VND'")))) + " END AS unit, CASE WHEN p_size % 2 = 0 AND p_partkey % 8 IN (1, 2, 3, 7) THEN 'unit_conflict' END AS issue FROM part")
def unit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of column headers in capitals, beside a table's unit and alone."""
    column = F.get(F.array(*[F.lit(h) for h in HEADERS]), (F.col("p_partkey") % 8).cast("int"))
    whole = F.when(F.col("p_size") % 2 == 0, F.lit("đơn vị tính: triệu đồng"))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("in_table"), units.resolve_unit(F.lit(None).cast("string"), column, text.native_key(column), whole).alias("u"))
    return rows.select("p_partkey", "in_table", F.col("u.value").alias("unit"), F.col("u.issue_code").alias("issue"))


@on_tables("metric_lookup", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'net_revenue' WHEN 1 THEN 'total_assets' END AS metric, CASE WHEN p_partkey % 4 = 2 THEN 'metric_unknown' END AS issue FROM part")
def metric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to the table of spellings."""
    raw = F.get(F.array(F.lit("Doanh thu  thuần"), F.lit("TOTAL ASSETS"), F.lit("Something else"), F.lit("Mã số")), (F.col("p_partkey") % 4).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.native_key(raw).alias("label_key"))
    return rows.join(F.broadcast(labels.metric_table(spark)), "label_key", "left").select("p_partkey", "metric", labels.metric_issue(F.col("label_key")).alias("issue"))


@on_tables("statement_lookup", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'cash_flow_statement' WHEN 3 THEN 'income_statement' END AS statement, CASE WHEN p_partkey % 5 = 2 THEN 'statement_conflict' END AS issue FROM part")
def statement_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = ("BẢNG CÂN ĐỐI KẾ TOÁN hợp nhất", "Cash flow statement 2023", "Balance sheet and income statement", "Income statement, see notes to the financial statements", "Something")
    raw = F.get(F.array(*[F.lit(t) for t in titles]), (F.col("p_partkey") % 5).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", labels.normalize_statement(text.native_key(raw)).alias("s"))
    return rows.select("p_partkey", F.col("s.value").alias("statement"), F.col("s.issue_code").alias("issue"))


@on_tables("company_check", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'company_conflict' END AS issue FROM customer")
def company_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    title = F.when(k == 0, F.lit("Báo cáo, mã CK: XYZ")).when(k == 1, F.lit("Stock code - abc")).otherwise(F.lit("no ticker"))
    return table(spark, sf_dir, "customer").select("c_custkey", labels.company_issue(F.lit("ABC"), text.native_key(title)).alias("issue"))


@on_tables("content_ids", "SELECT l_orderkey, l_linenumber, l_partkey, concat('tbl_', sha256(concat('doc_', CAST(l_orderkey AS STRING), chr(10), CAST(l_linenumber AS STRING), chr(10), CAST(l_partkey AS STRING), chr(10), '0'))) AS table_id, concat('cell_', sha256(concat('t', CAST(l_orderkey AS STRING), chr(10), CAST(l_linenumber AS STRING), chr(10), '2'))) AS cell_id, concat('tblmatch_', sha256(concat('doc_', CAST(l_orderkey AS STRING), chr(10), CASE WHEN l_linenumber > 1 THEN 'notes' ELSE 'unknown' END, chr(10), CAST(l_linenumber AS STRING), chr(10), CAST(l_partkey AS STRING)))) AS match_key FROM lineitem")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    doc = F.concat(F.lit("doc_"), c("l_orderkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ids.table_id(doc, c("l_linenumber"), c("l_partkey"), F.lit(0)).alias("table_id"), ids.cell_id(F.concat(F.lit("t"), c("l_orderkey").cast("string")), c("l_linenumber"), F.lit(2)).alias("cell_id"), ids.match_key(doc, F.when(c("l_linenumber") > 1, F.lit(" Notes")), c("l_linenumber"), c("l_partkey")).alias("match_key"))


@on_tables("path_parser", "SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN concat('T', CAST(c_nationkey AS STRING)) END AS company_code, CASE WHEN c_custkey % 5 < 3 THEN 2020 END AS report_year, CASE c_custkey % 5 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'separate' WHEN 2 THEN 'other' END AS scope, CASE c_custkey % 5 WHEN 3 THEN 'path must have four parts' WHEN 4 THEN 'invalid year' END AS issue FROM customer")
def path_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    ticker = F.concat(F.lit("t"), F.col("c_nationkey").cast("string"))
    path = F.concat(ticker, F.when(k == 0, F.lit("/2020/Consolidated FS/a.txt")).when(k == 1, F.lit("/2020/fs/SEPARATE.TXT")).when(k == 2, F.lit("/2020/fs/x.txt")).when(k == 3, F.lit("/2020/a.txt")).otherwise(F.lit("/20x0/fs/a.txt")))
    parts = files.parse_path(path)
    good = parts["path_issue"].isNull()
    # A ticker of one letter and one digit has two characters, the least that is allowed.
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(good, parts["company_code"]).alias("company_code"), F.when(good, parts["report_year"]).alias("report_year"), F.when(good, parts["statement_scope"]).alias("scope"), parts["path_issue"].alias("issue"))


@on_tables("first_seen_duplicates", "SELECT doc_id, sha256(text) AS sha256, CASE WHEN text = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY text ORDER BY lpad(CAST(doc_id AS STRING), 12, '0')) = 1 THEN 'ready' ELSE 'duplicate' END AS inventory_status FROM documents")
def first_seen_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the first path of each content is ready."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("relative_path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("length"))
    return files.mark_duplicates(rows).select("doc_id", "sha256", "inventory_status")


@on_tables("content_profile", "SELECT doc_id, CAST(length(text) AS INT) AS n_characters, CAST(len(regexp_extract_all(text, chr(10))) + CASE WHEN text LIKE concat('%', chr(10)) OR text = '' THEN 0 ELSE 1 END AS INT) AS n_lines, round(len(regexp_extract_all(text, '[0-9]'))::DOUBLE / length(regexp_replace(text, '\\s', '', 'g')), 6) AS numeric_ratio, contains(text, chr(9)) AS has_tab_table FROM documents")
def content_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.content_profile(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_characters", "n_lines", "numeric_ratio", "has_tab_table")


@on_tables("page_tables", "SELECT count(*) AS n_pages, count(*) FILTER (regexp_matches(html, '(?i)<table\\b')) AS with_table FROM pages")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.content_profile(table(spark, sf_dir, "pages").select("html"), "html").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if("has_html_table").alias("with_table"))


# Extraction: an order's lines as an HTML table in a report.
def order_reports(spark: SparkSession, sf_dir: str, pages: int = 1) -> DataFrame:
    """doc_id, company_code, report_year, text: title, unit line and a table of each order's lines.

    Orders have at most seven lines, so a report's list is bounded.  With two pages the table breaks
    before the last line and repeats its title and header.
    """
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    price = F.concat(F.floor("l_extendedprice").cast("string"), F.lit(","), F.lpad((F.round(F.col("l_extendedprice") * 100).cast("long") % 100).cast("string"), 2, "0"))
    row = F.concat(F.lit("<tr>"), cell(F.concat(F.lit("Item "), F.col("l_linenumber").cast("string"))), cell(F.col("l_quantity").cast("int").cast("string")), cell(price), F.lit("</tr>"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", row.alias("row")))).alias("rows"))
    title = "Báo cáo kết quả kinh doanh\n"
    head = F.lit("<table><tr><th>Chỉ tiêu</th><th>Năm 2023</th><th>Quý 1/2024</th></tr>")
    body = lambda rows: F.array_join(F.transform(rows, lambda r: r["row"]), "")
    whole = F.concat(F.lit("Đơn vị tính: triệu đồng\n" + title), head, body("rows"), F.lit("</table>\n"))
    if pages > 1:
        n = F.size("rows")
        last = F.when(n > 1, F.concat(F.lit("===== PAGE 2 =====\n" + title), head, body(F.slice("rows", n, 1)), F.lit("</table>\n"))).otherwise(F.lit(""))
        first = F.when(n > 1, F.slice("rows", F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.col("rows"))
        whole = F.concat(F.lit("Đơn vị tính: triệu đồng\n" + title), head, body(first), F.lit("</table>\n"), last)
    return lines.select(F.concat(F.lit("doc_"), F.col("l_orderkey").cast("string")).alias("doc_id"), F.lit("ABC").alias("company_code"), F.lit(2023).alias("report_year"), whole.alias("text"))


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey in as many tasks as the session shuffles in: the table's file is small beside the work that its texts make."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, "orders").select("o_orderkey").repartition(n, "o_orderkey")


LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem"
CELLS = f"SELECT concat('doc_', CAST(l_orderkey AS STRING)) AS doc_id, CAST(r AS INT) AS row_idx, 1 AS col_idx, concat('Item ', CAST(l_linenumber AS STRING)) AS row_label_raw, '2023' AS period, 'VND_million' AS unit, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS value FROM ({LINES}) x UNION ALL SELECT concat('doc_', CAST(l_orderkey AS STRING)), CAST(r AS INT), 2, concat('Item ', CAST(l_linenumber AS STRING)), '2024-Q1', 'VND_million', round(l_extendedprice, 2) FROM ({LINES}) x"


@on_tables("html_extraction", f"SELECT * FROM ({CELLS}) c")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports to normalized value cells."""
    reports = order_reports(spark, sf_dir)
    names = ("doc_id", "row_idx", "col_idx", "row_label_raw", "period", "unit")
    return normalization.normalize_texts(reports, (*names, "value_numeric"), valued=True).select(*names, F.col("value_numeric").cast("double").alias("value"))


@on_tables("page_continuation", "SELECT concat('doc_', CAST(l_orderkey AS STRING)) AS doc_id, CAST(count(*) + 1 AS INT) AS row_count, 3 AS column_count, count(*) > 1 AS continued, CAST((count(*) + 1) * 3 AS BIGINT) AS n_placements FROM lineitem GROUP BY l_orderkey")
def page_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that break across a page are one again."""
    found = extraction.tables_of(extraction.extract_tables(order_reports(spark, sf_dir, pages=2), ("table",)))
    return found.select("doc_id", "row_count", "column_count", F.array_contains("evidence", extraction.CONTINUED).alias("continued"), F.col("n_placements").cast("long").alias("n_placements"))


@on_tables("extraction_issues", "SELECT code, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT 'metric_unknown' AS code, count(*) FILTER (l_linenumber <> 1) AS n FROM lineitem UNION ALL SELECT 'number_invalid', count(*) FILTER (l_linenumber = 7) FROM lineitem UNION ALL SELECT 'number_ambiguous', count(*) FILTER (l_linenumber = 6) FROM lineitem) c")
def extraction_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by code of the reports' tables, with their share of all: labels of no metric, numbers of odd forms."""
    reports = order_reports(spark, sf_dir)
    odd = F.regexp_replace("text", "<td>Item 1</td>", "<td>Doanh thu thuần</td>")
    odd = F.regexp_replace(odd, "(<td>Item 7</td><td>)[0-9]+", "$11.2.3")
    odd = F.regexp_replace(odd, "(<td>Item 6</td><td>)[0-9]+", "$11.234.56,7.8")
    reports = reports.withColumn("text", odd)
    return profile.issue_shares(normalization.issues_of_texts(reports, repeated=False))


@on_tables("occurrence_ledger", "SELECT 'canonical' AS status, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'rejected', 0 UNION ALL SELECT 'duplicate', 0")
def occurrence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the reports' tables, by status."""
    reports = order_reports(spark, sf_dir)
    documents = reports.select("doc_id", F.col("doc_id").alias("relative_path"), F.sha2("text", 256).alias("sha256"))
    return ledger.status_counts(ledger.occurrences(staged(extraction.extract_tables(reports, ledger.PARTS), "extracted"), documents))


@on_tables("delimited_extraction", "SELECT concat('doc_', CAST(o_orderkey AS STRING)) AS doc_id, 3 AS row_count, 3 AS column_count, 0.85::DOUBLE AS quality_score FROM orders")
def delimited_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-delimited runs in prose become tables with a header."""
    k = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit("Some prose.\nChỉ tiêu\t2023\t2022\nCash\t"), k, F.lit("\t12\nDebt\t7\t"), k, F.lit("\n\nMore prose."))
    found = extraction.extract_tables(order_keys(spark, sf_dir).select(F.concat(F.lit("doc_"), k).alias("doc_id"), body.alias("text")), ("table",))
    return extraction.tables_of(found).select("doc_id", "row_count", "column_count", "quality_score")


@on_tables("rejected_regions", "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'nested_html_table' WHEN 1 THEN 'unclosed_html_table' WHEN 2 THEN 'invalid_span_value' ELSE 'unsupported_html_structure' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def rejected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = ("<table><tr><td><table></table></td></tr></table>", "<table><tr><td>1</td></tr>", "<table><tr><td rowspan='0'>1</td></tr></table>", "<table><tbody><tr><td>1</td></tr></tbody></table>")
    body = F.get(F.array(*[F.lit(b) for b in broken]), (F.col("o_orderkey") % 4).cast("int"))
    found = extraction.extract_tables(order_keys(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("doc_id"), body.alias("text")), ("rejected",))
    return extraction.spots_of(found, "rejected").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@on_tables("distinct_texts", "SELECT 'documents' AS side, count(DISTINCT text) AS n FROM documents UNION ALL SELECT 'benchmark', count(DISTINCT text) FROM benchmark")
def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union and distinct over two tables."""
    both = table(spark, sf_dir, "documents").select(F.lit("documents").alias("side"), "text").unionByName(table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("side"), "text"))
    return both.distinct().groupBy("side").agg(F.count(F.lit(1)).alias("n"))


ROW_DIGEST = "sha256(concat('{\"o_custkey\":', o_custkey, ',\"o_orderkey\":', o_orderkey, ',\"o_orderstatus\":\"', o_orderstatus, '\"}'))"


@on_tables("table_fingerprint", f"SELECT n, sha256(concat_ws('|', n, {', '.join(f'p{k}' for k in range(8))})) AS fingerprint FROM (SELECT count(*) AS n, {', '.join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT) AS p{k}" for k in range(8))} FROM (SELECT {ROW_DIGEST} AS h FROM orders) d) s")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free digest of a table."""
    return fingerprint(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
