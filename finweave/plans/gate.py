"""The pilot gate: selection of documents and cells, usability of tables, metrics, checks, Pareto."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finweave.functions import ids
from finweave.functions.text import is_eligible_value_cell, percentage_passes, unescape_html

STATEMENTS = ("balance_sheet", "income_statement", "cash_flow_statement")
COMPANIES, PER_COMPANY, AUDIT_CELLS, PER_TABLE = 20, 3, 30, 2
LEAST = {"documents": 60, "per_statement": 30, "usable": 85, "stratum_rows": 10, "stratum": 70}


def pick_companies(documents: DataFrame, n: int = COMPANIES, least: int = PER_COMPANY) -> DataFrame:
    """company_code of the first companies by stable rank that have enough documents."""
    enough = documents.groupBy("company_code").agg(F.count(F.lit(1)).alias("n_documents")).where(F.col("n_documents") >= least)
    return enough.withColumn("company_rank", ids.stable_rank("company", F.col("company_code"))).orderBy("company_rank", "company_code").limit(n)


def pick_documents(documents: DataFrame, n_companies: int = COMPANIES, per_company: int = PER_COMPANY) -> DataFrame:
    """Of each picked company one document for each (year, scope) in stratum order, filled up by document rank."""
    rows = documents.join(pick_companies(documents, n_companies, per_company).select("company_code"), "company_code")
    rank = lambda space, *cols: ids.stable_rank(space, *[F.col(c) for c in cols])
    rows = rows.withColumn("document_rank", rank("document", "doc_id")).withColumn("stratum_rank", rank("stratum", "company_code", "report_year", "statement_scope"))
    first = F.row_number().over(Window.partitionBy("company_code", "report_year", "statement_scope").orderBy("document_rank", "doc_id"))
    rows = rows.withColumn("is_fill", (first > 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("company_code").orderBy("is_fill", F.when(F.col("is_fill") == 0, F.col("stratum_rank")).otherwise(F.col("document_rank")), "doc_id"))
    return rows.withColumn("pick", place).where(F.col("pick") <= per_company).orderBy("company_code", "report_year", "statement_scope", "doc_id")


def pick_cells(candidates: DataFrame, n: int = AUDIT_CELLS, per_table: int = PER_TABLE) -> DataFrame:
    """Round robin over (company, year, statement) buckets by rank, at most ``per_table`` cells of a table."""
    bucket = ("company_code", "report_year", "statement_type")
    rows = candidates.withColumn("cell_rank", ids.stable_rank("audit_cell", F.col("cell_id"))).withColumn("bucket_rank", ids.stable_rank("cell_stratum", *[F.col(c) for c in bucket]))
    rows = rows.withColumn("_t", F.row_number().over(Window.partitionBy("table_id").orderBy("cell_rank", "cell_id"))).where(F.col("_t") <= per_table)
    rows = rows.withColumn("round", F.row_number().over(Window.partitionBy(*bucket).orderBy("cell_rank", "cell_id"))).where(F.col("round") <= n)
    return rows.drop("_t").orderBy("round", "bucket_rank", "cell_id").limit(n)


def cell_provenance(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds excerpt and verified: the cell's lines exist, lie in its table, hold its text, its id is right and its place is its own.

    ``cells`` has doc_id, table_id, cell_id, row_idx, col_idx, value_raw, source lines and the table's
    line_start and line_end; ``lines`` has doc_id and the document's lines as an array.
    """
    c = F.col
    span = ["doc_id", "source_line_start", "source_line_end"]
    # Cells of a row share their lines: each span is put together once, from rows of one line.
    good = (c("source_line_start") >= 1) & (c("source_line_end") >= c("source_line_start"))
    spans = cells.where(good).select(*span).distinct().withColumn("_no", F.explode(F.sequence("source_line_start", "source_line_end")))
    each = lines.select("doc_id", F.posexplode("lines").alias("_at", "_line")).select("doc_id", (c("_at") + 1).alias("_no"), "_line")
    found = spans.join(each, ["doc_id", "_no"]).groupBy(*span).agg(F.sort_array(F.collect_list(F.struct("_no", "_line"))).alias("_lines"))
    whole = F.size("_lines") == c("source_line_end") - c("source_line_start") + 1
    found = found.where(whole).select(*span, F.array_join(c("_lines._line"), "\n").alias("source_excerpt"))
    # Of cells at one place the first has it; places are judged before rows carry their excerpts.
    own = F.row_number().over(Window.partitionBy("table_id", "row_idx", "col_idx").orderBy("cell_id")) == 1
    rows = cells.withColumn("_own", own).join(found, span, "left")
    shown = unescape_html(F.regexp_replace("source_excerpt", r"(?i)<br\s*/?>", "\n"))
    in_table = c("source_line_start").between(c("line_start"), c("line_end")) & c("source_line_end").between(c("line_start"), c("line_end"))
    return rows.withColumn("_shown", shown).withColumn("verified", F.coalesce(F.contains("_shown", "value_raw") & in_table & (c("cell_id") == ids.cell_id(c("table_id"), c("row_idx"), c("col_idx"))) & c("_own"), F.lit(False))).drop("_shown", "_own")


def table_usability(assessed: DataFrame, tables: DataFrame, audits: DataFrame) -> DataFrame:
    """Adds the later failures and usable to assessed annotations (with failures so far)."""
    c = F.col
    value = is_eligible_value_cell(c("value_raw"), c("row_label_raw"), c("column_label_raw"), c("value_numeric"))
    seen = audits.join(assessed.select("annotation_id", "expected_periods"), "annotation_id").withColumn("_value", value)
    odd = ~F.coalesce(F.array_contains("expected_periods", c("period")), F.lit(False))
    flags = seen.groupBy("annotation_id").agg(
        F.bool_or(c("_value") & c("value_numeric").isNull()).alias("no_number"),
        F.bool_or(c("_value") & (F.size("expected_periods") > 0) & odd).alias("odd_period"),
        F.bool_or(~c("verified")).alias("unverified"),
    )
    t = tables.select("table_id", F.col("row_count").alias("t_rows"), F.col("column_count").alias("t_columns"), F.col("statement_type").alias("t_statement"), F.col("unit_normalized").alias("t_unit"))
    rows = assessed.join(t, "table_id", "left").join(flags, "annotation_id", "left")
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    found = {
        "shape_mismatch": (c("t_rows") != c("row_count")) | (c("t_columns") != c("column_count")),
        "statement_mismatch": low(c("t_statement")) != F.lower("statement_type"),
        "unit_mismatch": (low(c("unit_normalized")) != "") & (low(c("t_unit")) != low(c("unit_normalized"))),
        "no_numeric_value": c("no_number"), "period_mismatch": c("odd_period"), "invalid_provenance": c("unverified"),
    }
    more = F.array_compact(F.array(*[F.when(c("table_id").isNotNull() & cond, F.lit(code)) for code, cond in found.items()]))
    rows = rows.withColumn("failures", F.concat("failures", more)).withColumn("usable", c("table_id").isNotNull() & (F.size("failures") == 0))
    return rows.drop("t_rows", "t_columns", "t_statement", "t_unit", "no_number", "odd_period", "unverified")


def statement_metrics(assessed: DataFrame) -> DataFrame:
    """expected, matched and usable tables of each statement type, zeros too."""
    agg = [f(F.col("statement_type") == s).alias(f"{s}_{k}") for s in STATEMENTS for k, f in (("expected", F.count_if), ("matched", lambda x: F.count_if(x & F.col("table_id").isNotNull())), ("usable", lambda x: F.count_if(x & F.col("usable"))))]
    one = assessed.agg(*agg)
    rows = [F.struct(F.lit(s).alias("statement_type"), *[F.col(f"{s}_{k}").alias(k) for k in ("expected", "matched", "usable")]) for s in STATEMENTS]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def stratum_metrics(assessed: DataFrame, least: int = LEAST["stratum_rows"], share: int = LEAST["stratum"]) -> DataFrame:
    """n, usable, included and passed of each (company, year, statement)."""
    out = assessed.groupBy("company_code", "report_year", "statement_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("usable").alias("usable"))
    out = out.withColumn("included", F.col("n") >= least)
    return out.withColumn("passed", ~F.col("included") | percentage_passes(F.col("usable"), F.col("n"), share))


def gate_checks(n_documents: Column, fewest: Column, usable: Column, expected: Column, valid_cells: Column, cells: Column, audited: Column, strata: Column, passed: Column) -> dict[str, Column]:
    """The six checks over one-row aggregates."""
    return {
        "pilot_documents": n_documents == LEAST["documents"],
        "expected_tables": fewest >= LEAST["per_statement"],
        "table_usability": percentage_passes(usable, expected, LEAST["usable"]),
        "provenance": (cells > 0) & (valid_cells == cells),
        "manual_audit": audited == AUDIT_CELLS,
        "strata": strata == passed,
    }


def pareto(codes: DataFrame, code: str = "code") -> DataFrame:
    """count, cumulative, and shares of each code as text with two decimals, largest first."""
    counts = codes.groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("count"))
    order = Window.orderBy(F.col("count").desc(), F.col("code"))
    total = F.sum("count").over(Window.partitionBy())
    upto = F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = lambda n: F.concat(F.round(n.cast("decimal(20,0)") * 100 / total.cast("decimal(20,0)"), 2).cast("decimal(6,2)").cast("string"), F.lit("%"))
    return counts.select("code", "count", upto.alias("cumulative"), share(F.col("count")).alias("share"), share(upto).alias("cumulative_share"))


def audit_changes(derived: DataFrame, given: DataFrame, columns: tuple[str, ...], key: str = "cell_id") -> DataFrame:
    """One row: audit rows missing, unknown, changed in a fixed column, or not marked true or false."""
    a = derived.select(key, *[F.col(x).cast("string").alias(f"a_{x}") for x in columns], F.lit(True).alias("in_a"))
    b = given.select(key, "verified", *[F.col(x).cast("string").alias(f"b_{x}") for x in columns], F.lit(True).alias("in_b"))
    rows = a.join(b, key, "full_outer")
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    changed = ~F.forall(F.array(*[text(f"a_{x}") == text(f"b_{x}") for x in columns]), lambda v: v)
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    marked = F.coalesce(F.trim(F.col("verified").cast("string")).isin("true", "false"), F.lit(False))
    return rows.agg(F.count_if(F.col("in_b").isNull()).alias("missing"), F.count_if(F.col("in_a").isNull()).alias("unknown"), F.count_if(both & changed).alias("changed"), F.count_if(both & ~marked).alias("unmarked"))
