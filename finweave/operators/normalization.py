"""Normalization of extracted tables: columns on cells, keys in one Arrow pass.

Labels repeat across cells, so the one function that needs Python (exact keys) runs once for each
distinct label of a batch; nothing is shuffled for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finweave.functions import labels, numbers, periods, told, units
from finweave.functions.text import is_value_candidate, native_key, normalized_key, once
from finweave.operators.extraction import OF_TABLE, PIECE_ROWS, cells_of, extract_text, tables_of, texts_of, with_cell_id, with_table_id

ISSUE_FIELDS = {
    "company_conflict": "company", "period_incomplete": "period", "period_ambiguous": "period", "period_invalid": "period", "statement_conflict": "statement_type", "metric_unknown": "metric",
    "number_missing": "number", "number_ambiguous": "number", "number_invalid": "number", "unit_unknown": "unit", "unit_conflict": "unit",
}
BLOCKING = ("unit_conflict", "number_ambiguous", "period_ambiguous")
ISSUE_COLUMNS = ("doc_id", "table_id", "cell_id", "field", "code", "raw_value")


def with_keys(df: DataFrame, pairs: dict[str, str], exact: bool = True) -> DataFrame:
    """Adds normalized keys of text columns: {column: key column}."""
    key = normalized_key if exact else native_key
    return df.withColumns({name: key(F.col(c)) for c, name in pairs.items()})


def normalize_tables(tables: DataFrame, documents: DataFrame, exact: bool = True) -> DataFrame:
    """Adds company_code, report_year, statement_type, unit_normalized and the table's issues."""
    return _judged_tables(with_keys(tables.join(documents.select("doc_id", "company_code", "report_year"), "doc_id"), {"title_raw": "title_key", "unit_raw": "unit_key"}, exact))


def _judged_tables(keyed: DataFrame) -> DataFrame:
    statement = labels.normalize_statement(F.coalesce("title_key", F.lit("")))
    return keyed.withColumn("statement_type", statement["value"]).withColumn("statement_issue", statement["issue_code"]).withColumn("company_issue", labels.company_issue(F.col("company_code"), F.col("title_key"))).withColumn("unit_normalized", units.normalize_unit(F.col("unit_key")))


def normalize_cells(cells: DataFrame, tables: DataFrame, exact: bool = True) -> DataFrame:
    """Canonical labels, period, number and unit of every cell, with the issue codes beside them."""
    context = tables.select("table_id", "report_year", "statement_type", F.col("unit_raw").alias("table_unit_raw"), F.col("unit_key").alias("table_unit_key"))
    # A row's metric comes from its first cell in reading order.
    first = Window.partitionBy("table_id", "row_idx").orderBy("col_idx", "cell_id")
    rows = cells.withColumn("row_first", F.first("row_label_raw").over(first)).withColumn("in_row", F.row_number().over(first)).join(context, "table_id")
    return _judged_cells(with_keys(rows, {"row_first": "metric_key", "column_label_raw": "column_key", "value_raw": "value_key"}, exact))


def _judged_cells(rows: DataFrame) -> DataFrame:
    """Cells with keys, their place in the row and their table's context, judged column by column."""
    unknown = F.when(labels.metric_issue(F.col("metric_key")).isNotNull() & F.col("statement_type").isNotNull() & (F.col("statement_type") != "notes"), F.lit("metric_unknown"))
    period = F.when(periods.has_period_evidence(F.col("column_key")), periods.normalize_period(F.col("column_key"), F.col("report_year")))
    rows = once(rows, metric=labels.normalize_metric(F.col("metric_key")), metric_issue=F.when(F.col("in_row") == 1, unknown), _p=period)
    rows = rows.withColumn("period", F.col("_p.value")).withColumn("period_issue", F.col("_p.issue_code")).drop("_p")
    candidate = is_value_candidate(F.col("value_raw"), F.col("row_label_raw"), F.col("column_key"))
    rows = once(rows, is_value=candidate, _number=F.when(candidate & numbers.is_numeric_candidate(F.col("value_raw")), F.col("value_raw")))
    rows = numbers.with_number(rows, "_number")
    rows = rows.withColumn("number_issue", F.when(~((F.col("number_issue") == "number_missing") & F.col("metric").isNull()), F.col("number_issue")))
    stated = F.col("number_hint").isNotNull() | units.has_unit_evidence(F.col("value_key")) | units.has_unit_evidence(F.col("column_key")) | units.has_unit_evidence(F.col("table_unit_key"))
    decided = F.when(F.col("is_value") & stated, units.resolve_unit(F.col("number_hint"), F.col("column_label_raw"), F.col("column_key"), F.col("table_unit_key")))
    rows = once(rows, _u=decided).withColumn("unit", F.col("_u.value")).withColumn("unit_issue", F.col("_u.issue_code"))
    return rows.withColumn("row_label_canonical", F.col("metric")).withColumn("column_label_canonical", F.col("period")).drop("_u", "_number", "in_row", "number_hint")


#: A cell's place in its document, and what a pass over texts tells of cells and of issues.
PLACE = ("doc_id", *OF_TABLE, "row_idx", "col_idx")
OF_CELL = (
    *PLACE, "row_label_raw", "column_label_raw", "value_raw", "source_line_start", "source_line_end", "extraction_confidence", "report_year", "statement_type", "row_first", "metric", "metric_issue",
    "period", "period_issue", "is_value", "value_numeric", "number_issue", "unit", "unit_issue",
)
OF_ISSUE = (*PLACE, "field", "code", "raw_value")
TYPES = {c: "int" for c in ("source_ordinal", "line_start", "line_end", "row_idx", "col_idx", "source_line_start", "source_line_end", "report_year")} | {"extraction_confidence": "double", "is_value": "boolean"}


def _told(table: dict, year: int | None, statement: str | None, valued: bool = False) -> Iterator[tuple]:
    """(``LOCATED`` of a cell, first label of its row, metric, its issue, period, whether it may be a value, number, its issue, unit) of a table's cells; where ``valued``, only of those with a number."""
    unit_key = told.key_of(table["unit_raw"])
    of_table, main = told.states_unit(unit_key), statement is not None and statement != "notes"
    columns: dict[str | None, tuple] = {}
    row, nothing = -1, (None, None)
    # Cells come row by row, the first of a row before its others.
    for cell in table["cells"]:
        at, _, label, column, raw, _, _ = cell
        if at != row:
            row, first = at, label
            metric, unknown = told.metric_of(told.key_of(label))
            odd = "metric_unknown" if unknown and main else None
        else:
            odd = None
        if valued and (label is None or raw == label):
            continue
        if column not in columns:
            key = told.key_of(column)
            columns[column] = key, told.period_of(key, year), of_table or told.states_unit(key), told.unit_of(column, None, key, unit_key)
        key, period, stated, usual = columns[column]
        number, hint, issue, unit = None, None, None, nothing
        if is_value := told.may_hold_value(raw, label, key):
            number, hint, issue = told.number_of(raw)
            if issue == "number_missing" and metric is None:
                issue = None
            if hint:
                unit = told.unit_of(column, hint, key, unit_key)
            elif stated or told.states_unit(told.key_of(raw)):
                unit = usual
        if number is not None or not valued:
            yield cell, first, metric, odd, period, is_value, number, issue, unit


def _told_cells(found: dict, k: int, code: str | None, year: int | None, valued: bool) -> Iterator[tuple]:
    """The rows ``OF_CELL`` of a document, the number of the document in its batch first; where ``valued``, only those with a number."""
    for t in found["tables"]:
        statement, _ = told.statement_of(told.key_of(t["title_raw"]))
        place, confidence = (k, t["source_ordinal"], t["line_start"], t["line_end"]), t["quality_score"]
        for cell, first, metric, odd, period, is_value, number, issue, unit in _told(t, year, statement, valued):
            yield (*place, *cell, confidence, year, statement, first, metric, odd, *period, is_value, number, issue, *unit)


def _told_issues(found: dict, k: int, code: str | None, year: int | None) -> Iterator[tuple]:
    """The rows ``OF_ISSUE`` of a document, the number of the document in its batch first."""
    for t in found["tables"]:
        title_key = told.key_of(t["title_raw"])
        statement, conflict = told.statement_of(title_key)
        place = (k, *(t[c] for c in OF_TABLE))
        for field, issue in (("company", told.company_issue_of(code, title_key)), ("statement_type", conflict)):
            if issue is not None:
                yield (*place, None, None, field, issue, t["title_raw"])
        for (r, c, _, column, value, _, _), first, _, metric, (_, period), _, _, number, (_, unit) in _told(t, year, statement):
            if metric or period or number or unit:
                for field, issue, raw in (("metric", metric, first), ("period", period, column), ("number", number, value), ("unit", unit, value)):
                    if issue is not None:
                        yield (*place, r, c, field, issue, raw)


def _told_batches(batches: Iterator[pa.RecordBatch], tell: Callable[..., Iterator[tuple]], names: tuple[str, ...], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []

        def laid_out() -> pa.RecordBatch:
            columns = dict(zip(names, zip(*rows)))
            columns["doc_id"] = batch.column("doc_id").take(pa.array(columns["doc_id"], pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name != "doc_id" else columns["doc_id"].cast(f.type) for f in schema], schema=schema)

        codes, years = batch.column("company_code").to_pylist(), batch.column("report_year").to_pylist()
        for k, (text, code, year) in enumerate(zip(texts_of(batch), codes, years)):
            rows += tell(extract_text("", text), k, code, year)
            if len(rows) >= PIECE_ROWS:
                yield laid_out()
                rows = []
        if rows:
            yield laid_out()


def _told_of(documents: DataFrame, tell: Callable[..., Iterator[tuple]], names: tuple[str, ...], wanted: tuple[str, ...]) -> DataFrame:
    """What ``tell`` tells of documents (doc_id, text, company_code, report_year) in one pass: its columns ``names``, of which those that are ``wanted`` leave the pass."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = StructType.fromDDL(", ".join(f"{c} {TYPES.get(c, 'string')}" for c in wanted))
    schema = to_arrow_schema(shape)
    kinds = {"doc_id": "string", "text": "string", "company_code": "string", "report_year": "int"}
    return documents.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]).mapInArrow(lambda it: _told_batches(it, tell, names, schema), shape)


def normalize_texts(documents: DataFrame, wanted: tuple[str, ...] = OF_CELL, valued: bool = False) -> DataFrame:
    """Cells with their place of documents (doc_id, text, company_code, report_year): what ``normalize_extraction`` tells of them, found together with them in one pass.

    ``valued`` leaves out cells without a number.  Numbers leave the pass as decimal literals.
    """
    found = _told_of(documents, partial(_told_cells, valued=valued), OF_CELL, wanted)
    return found.withColumn("value_numeric", F.col("value_numeric").cast(numbers.VALUE_TYPE)) if "value_numeric" in wanted else found


def issues_of_texts(documents: DataFrame, repeated: bool = True) -> DataFrame:
    """The distinct issues of documents as ``issues_of`` has them; they are made distinct by place, and identifiers come after that.

    A document tells each of its issues once, so nothing is compared where no doc_id is ``repeated``.
    """
    found = _told_of(documents, _told_issues, OF_ISSUE, OF_ISSUE)
    found = with_cell_id(with_table_id(found.distinct() if repeated else found))
    return found.withColumn("cell_id", F.when(F.col("row_idx").isNotNull(), F.col("cell_id"))).select(*ISSUE_COLUMNS)


TABLE_ISSUES = (("company", "company_issue", "title_raw"), ("statement_type", "statement_issue", "title_raw"))
CELL_ISSUES = (("metric", "metric_issue", "row_first"), ("period", "period_issue", "column_label_raw"), ("number", "number_issue", "value_raw"), ("unit", "unit_issue", "value_raw"))


def _stacked(df: DataFrame, kinds: tuple[tuple[str, str, str], ...], *keys: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(field).alias("field"), F.col(code).alias("code"), F.col(raw).alias("raw_value")) for field, code, raw in kinds])
    return df.select(*keys, F.explode(F.filter(each, lambda i: i["code"].isNotNull())).alias("i")).select(*keys, "i.*")


def issues_of(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """The distinct issues of normalized tables and cells."""
    of_tables = _stacked(tables.drop("cell_id").withColumn("cell_id", F.lit(None).cast("string")), TABLE_ISSUES, "doc_id", "table_id", "cell_id")
    of_cells = _stacked(cells, CELL_ISSUES, "doc_id", "table_id", "cell_id")
    return of_tables.unionByName(of_cells).select(*ISSUE_COLUMNS).distinct()


def normalize_extraction(extracted: DataFrame, documents: DataFrame, exact: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, cells, issues) of extracted documents (doc_id, company_code, report_year)."""
    tables = normalize_tables(tables_of(extracted), documents, exact)
    cells = normalize_cells(cells_of(extracted), tables, exact)
    return tables, cells, issues_of(tables, cells)


def cell_eligibility(df: DataFrame, codes: str = "issue_codes") -> DataFrame:
    """Adds searchable, comparable, calculable and blocking_reasons from a cell's fields and issue codes."""
    reasons = F.filter(F.coalesce(F.col(codes), F.array().cast("array<string>")), lambda c: c.isin(*BLOCKING))
    labelled = F.col("row_label_canonical").isNotNull() & F.col("period").isNotNull()
    full = labelled & F.col("value_numeric").isNotNull()
    calculable = full & F.coalesce(F.col("unit").isin(*units.MONETARY), F.lit(False)) & (F.size(reasons) == 0)
    filled = F.coalesce(F.trim("value_raw") != "", F.lit(False))
    return df.withColumns({"blocking_reasons": reasons, "calculable": calculable, "comparable": full & ~calculable, "searchable": labelled & filled & F.col("value_numeric").isNull()})
