"""Reports judged in the pass that reads them: the rules in Python equal the columns, and nothing is judged, written or dealt out again behind the pass."""

import os
import random
from decimal import Decimal

from pyspark.sql import functions as F

from finweave import queries, release_queries  # noqa: F401  (registers its queries)
from finweave.functions import labels, numbers, periods, told, units
from finweave.functions.text import is_value_candidate, python_key
from finweave.operators import extraction, normalization
from finweave.plans import profile

MARKS = ("0", "12", "345", "1.234", "1,5", "7" * 27, ".", ",", " ", " ", "(", ")", "-", "+", "%", "O", "o", "５", "．", "⁷", "⑴", "½", "—", "n/a", "x", " ", "\x1d", "đ", "")
HEADERS = ("năm", "Năm ", "2023", "1999", "ngày ", "31/12/2023", "29/02/23", "29-2-2023", "1/13/24", "31/12/23", "0/0/0000", "quý ", "QUÝ", "iv", "II", "4", "5", "tháng ", "13", "/", "-", " ", "năm 2020", "(", ")", "Triệu đồng", "VND", "vnđ", "TỶ", "đơn vị tính: ", "ĐVT:", "Đơn vị:", "phần trăm", "%", "lần", "LAẦN", "İ", "đồng thau", "mã số", "STT", "note", "1.000 vnd", " ", "ﬁ", "x", "")
TITLES = ("Bảng cân đối kế toán", "Báo cáo kết quả kinh doanh", "THUYẾT MINH BÁO CÁO TÀI CHÍNH", "lưu chuyển tiền tệ", "mã ck: ", "Ticker ", "stock code -", "abc", "XYZ1", " ", "income statement", "Doanh thu thuần", "Revenue", "Tổng cộng", "")


def _made(rng, parts, n, most):
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_rules_told_in_python_equal_the_columns(spark):
    rng = random.Random(11)
    raws = [None, *dict.fromkeys(_made(rng, MARKS, 4000, 5))]
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").withColumn("n", F.when(numbers.is_numeric_candidate(F.col("raw")), F.col("raw")))
    for r in numbers.with_number(rows, "n").orderBy("i").collect()[1:]:
        number, hint, issue = told.number_of(r["raw"])
        assert (None if number is None else Decimal(number), hint, issue) == (r["value_numeric"], r["number_hint"], r["number_issue"]), r
    literal = spark.createDataFrame([(r, told.number_of(r)[0]) for r in raws[1:]], "raw string, number string")
    values = numbers.with_number(literal.where("number IS NOT NULL"), "raw").where(~F.col("value_numeric").eqNullSafe(F.col("number").cast(numbers.VALUE_TYPE)))
    assert literal.where("number IS NOT NULL").count() > 200 and values.count() == 0

    heads = [None, *dict.fromkeys(_made(rng, HEADERS, 3000, 3))]
    some = [(i, raw, told.key_of(raw), rng.choice([None, 1998, 2023]), rng.choice([None, "percent"]), told.key_of(rng.choice(heads)), rng.choice(["a", "Mã số", None])) for i, raw in enumerate(heads)]
    rows = spark.createDataFrame(some, "i int, raw string, key string, year int, hint string, whole string, label string")
    evident = F.when(periods.has_period_evidence(F.col("key")), periods.normalize_period(F.col("key"), F.col("year")))
    got = rows.select("*", evident.alias("p"), units.has_unit_evidence(F.col("key")).alias("e"), units.resolve_unit(F.col("hint"), F.col("raw"), F.col("key"), F.col("whole")).alias("u"), is_value_candidate(F.lit("a"), F.col("label"), F.col("key")).alias("v"))
    for r in got.orderBy("i").collect():
        assert told.period_of(r["key"], r["year"]) == (tuple(r["p"]) if r["p"] else (None, None)), r
        assert told.states_unit(r["key"]) == r["e"] and told.unit_of(r["raw"], r["hint"], r["key"], r["whole"]) == tuple(r["u"]), r
        assert told.may_hold_value("a", r["label"], r["key"]) == r["v"], r

    keys = [None, *dict.fromkeys(map(python_key, _made(rng, TITLES, 2000, 4)))]
    rows = spark.createDataFrame([(i, key, rng.choice([None, "ABC", "xyz1"])) for i, key in enumerate(keys)], "i int, key string, code string")
    got = rows.select("*", labels.normalize_statement(F.coalesce("key", F.lit(""))).alias("s"), labels.company_issue(F.col("code"), F.col("key")).alias("c"), labels.normalize_metric(F.col("key")).alias("m"), labels.metric_issue(F.col("key")).alias("x"))
    for r in got.collect():
        assert told.statement_of(r["key"]) == tuple(r["s"]) and told.company_issue_of(r["code"], r["key"]) == r["c"], r
        assert told.metric_of(r["key"]) == (r["m"], r["x"] is not None), r


def _report(rng):
    odd = ["1.234.56,7", "12,5", "(7)", "", "n/a", "5 %", "1.2.3", "Doanh thu thuần", "Other", "đồng", "12", "1.5"]
    cell = lambda: f"<td{rng.choice(['', '', '', ' rowspan=2', ' colspan=2'])}>{rng.choice(odd)}</td>"
    table = lambda: "<table><tr><th>Chỉ tiêu</th>" + "".join(f"<th>{rng.choice(['Năm 2023', '31/12/23', 'Mã số', 'tỷ đồng', '1/2/2024'])}</th>" for _ in range(2)) + "</tr>" + "".join(f"<tr>{cell()}{cell()}{cell()}</tr>" for _ in range(rng.randint(1, 4))) + "</table>\n"
    title = rng.choice(["Bảng cân đối kế toán\n", "Báo cáo kết quả kinh doanh mã ck: XYZ\n", "Some prose\n", ""])
    return rng.choice(["Đơn vị tính: triệu đồng\n", "Đơn vị tính: đồng thau\n", ""]) + title + table() + rng.choice(["", f"===== PAGE 2 =====\n{title}{table()}", "Chỉ tiêu\t2023\nCash\t5\nDebt\t7%\n"])


def test_texts_are_judged_as_their_extraction_is(spark):
    rng = random.Random(12)
    documents = spark.createDataFrame([(f"d{i}", _report(rng), "ABC", 2023) for i in range(300)], "doc_id string, text string, company_code string, report_year int")
    _, cells, issues = normalization.normalize_extraction(extraction.extract_tables(documents), documents)
    of = lambda rows, c: sorted(map(str, rows.select(*c).collect()))
    names = ["doc_id", "row_idx", "col_idx", "row_label_raw", "column_label_raw", "value_raw", "source_line_start", "source_line_end", "statement_type", "row_first", "metric", "metric_issue", "period", "period_issue", "is_value", "value_numeric", "number_issue", "unit", "unit_issue"]
    assert of(normalization.normalize_texts(documents), names) == of(cells, names)
    assert of(normalization.normalize_texts(documents, valued=True), names) == of(cells.where("value_numeric IS NOT NULL"), names)
    told_ = of(issues, normalization.ISSUE_COLUMNS)
    assert of(normalization.issues_of_texts(documents, repeated=False), normalization.ISSUE_COLUMNS) == told_
    assert of(normalization.issues_of_texts(documents.unionByName(documents)), normalization.ISSUE_COLUMNS) == told_


def _lines(spark, path, n=40):
    rows = [(order, line, 7 * order + line, line, float(line), order + line / 4) for order in range(1, n) for line in range(1, order % 7 + 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{path}/lineitem.parquet")
    return rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_need_one_shuffle_and_no_table_between(spark, tmp_path):
    rows = _lines(spark, tmp_path)
    kept = lambda: sum(len(files) for _, _, files in os.walk(spark.conf.get("spark.checkpoint.dir")))
    before = kept()
    cells = queries.QUERIES["html_extraction"](spark, str(tmp_path))
    assert _plan(cells).count("Exchange") == 1 and "Generate" not in _plan(cells) and cells.count() == 2 * len(rows)
    found = queries.QUERIES["extraction_issues"](spark, str(tmp_path))
    assert "hashpartitioning(doc_id" not in _plan(found) and "Generate" not in _plan(found)
    assert {r["code"]: r["n"] for r in found.collect()} == {"metric_unknown": sum(r[1] != 1 for r in rows), "number_invalid": sum(r[1] == 7 for r in rows), "number_ambiguous": sum(r[1] == 6 for r in rows)}
    assert kept() == before


def test_digests_tell_the_documents_whose_rows_differ(spark):
    """One row for each document and run says what all rows of the extraction say."""
    rng = random.Random(13)
    base = [_report(rng) for _ in range(60)]
    swaps = [("12", "13"), ("<td>", "<td >"), ("<td>", "<th>"), ("2023", "2022"), ("\n", "\n\n"), ("<table>", "<table><table>"), ("triệu", "tỷ"), ("\t5", "\t6"), (" colspan=2", ""), ("prose", "Prose"), ("</table>", "</table> ")]
    texts = [(f"d{i}-{j}", t, t.replace(*swap)) for i, t in enumerate(base) for j, swap in enumerate([*swaps, ("", "")])]
    texts = [(doc, a, a if doc.endswith(f"-{len(swaps)}") else b) for doc, a, b in texts]
    rows = spark.createDataFrame(texts, "doc_id string, text string, again string")
    first, second = rows.select("doc_id", "text"), rows.select("doc_id", F.col("again").alias("text")).where("doc_id <> 'd7-11'")
    run = lambda parts: sorted(r["doc_id"] for r in profile.nondeterministic(extraction.extract_tables(first, *parts), extraction.extract_tables(second, *parts)).collect())
    told_ = run([("digest",)])
    assert told_ == run([]) and "d7-11" in told_ and len(base) < len(told_) < len(texts) - len(base)
    extracted = extraction.extract_tables(first)
    n = {r["doc_id"]: r["n_rows"] for r in extraction.extract_tables(first, ("digest",)).collect()}
    assert n == {r["doc_id"]: r["count"] for r in extracted.groupBy("doc_id").count().collect()}


def test_runs_meet_as_one_row_a_document(spark, tmp_path):
    _lines(spark, tmp_path, 120)
    odd = queries.QUERIES["extraction_is_deterministic"](spark, str(tmp_path))
    plan = _plan(odd)
    assert "Join" not in plan and "value_raw" not in plan and sorted(r["doc_id"] for r in odd.collect()) == ["doc_100", "doc_50"]
