"""The stratified sample over rows that repeat."""

from pyspark.sql import functions as F

from finweave.plans import audit


def test_a_sample_counts_repeated_rows_once_each(spark):
    """Two equal issues are two rows of a stratum, not four; a cell that stands twice counts twice."""
    issue = "code string, field string, doc_id string, table_id string, cell_id string, raw_value string"
    issues = spark.createDataFrame([("number_invalid", "number", "d", "t", None, "v")] * 2 + [("unit_unknown", "unit", "d", "t", "c", "v")], issue)
    documents = spark.createDataFrame([("d", "ABC", 2023)], "doc_id string, company_code string, report_year int")
    tables = spark.createDataFrame([("t", "notes", None, None, 1, 2)], "table_id string, statement_type string, title_raw string, unit_raw string, line_start int, line_end int")
    cells = spark.createDataFrame([("c", "a", "b", "1", 1, 1)] * 2, "cell_id string, row_label_raw string, column_label_raw string, value_raw string, source_line_start int, source_line_end int")
    found = audit.sample_rows(issues, documents, tables, cells, "fp")
    assert {r["issue_code"]: r["n"] for r in found.groupBy("issue_code").agg(F.count(F.lit(1)).alias("n")).collect()} == {"number_invalid": 2, "unit_unknown": 2}
