"""Scalar rules against vectors, and round trips."""

import unicodedata
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finweave.functions import labels, numbers, periods, text, units
from finweave.operators import extraction

NUMBERS = [
    ("1.234.567", "1234567", None, None), ("1,234,567.89", "1234567.89", None, None), ("1.234.567,8", "1234567.8", None, None), ("(1 234)", "-1234", None, None), ("-5", "-5", None, None), ("+7", "7", None, None), ("(-5)", "-5", None, None),
    ("12,5%", "12.5", "percent", None), ("(5)%", "-5", "percent", None), ("(5%)", None, None, "number_invalid"), ("0.125", "125", None, None), ("1234.567", None, None, "number_ambiguous"), (".5", None, None, "number_ambiguous"), ("1.234,567", None, None, "number_ambiguous"),
    ("1,000,00O", "1000000", None, None), ("12.", "12", None, None), ("1.23.456", None, None, "number_invalid"), ("1,23,456", None, None, "number_ambiguous"), ("abc", None, None, "number_invalid"), ("-", None, None, "number_missing"), ("N/A", None, None, "number_missing"), ("", None, None, "number_missing"),
    ("(5", None, None, "number_invalid"), ("1 23", None, None, "number_invalid"), ("%", None, "percent", "number_missing"), ("1 234", "1234", None, None), (None, None, None, None),
]


def test_numbers(spark):
    rows = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NUMBERS)], "i int, raw string")
    got = {r["i"]: r for r in numbers.with_number(rows, "raw").collect()}
    for i, (raw, value, hint, issue) in enumerate(NUMBERS):
        r = got[i]
        assert (r["value_numeric"], r["number_hint"], r["number_issue"]) == (None if value is None else Decimal(value), hint, issue), raw


@settings(max_examples=5, deadline=None)
@given(st.lists(st.decimals(-10**12, 10**12, places=2), min_size=20, max_size=20))
def test_printed_numbers_come_back(spark, values):
    shown = [f"{v:,.2f}".replace(",", "_").replace(".", ",").replace("_", ".") for v in values]
    got = numbers.with_number(spark.createDataFrame(list(enumerate(shown)), "i int, raw string"), "raw").orderBy("i").collect()
    assert [r["value_numeric"] for r in got] == values


PERIODS = [
    ("31/12/2023", "2023-12-31", None), ("Ngày 01-02-2024", "2024-02-01", None), ("30/02/2023", None, "period_invalid"), ("31/12/23", "2023-12-31", None), ("01/02/23", None, "period_ambiguous"), ("Quý IV/2022", "2022-Q4", None), ("q2", "2021-Q2", None),
    ("Năm 2020", "2020", None), ("2019", "2019", None), ("5", "2021-05", None), ("13", None, None), ("Tháng 11", "2021-11", None), ("Quý đầu", None, "period_incomplete"), ("Chỉ tiêu", None, None), ("", None, None),
]


def test_periods(spark):
    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PERIODS)], "i int, raw string").withColumn("key", text.native_key(F.col("raw")))
    got = rows.select("i", periods.normalize_period(F.col("key"), F.lit(2021)).alias("p")).collect()
    for r in got:
        assert (r["p"]["value"], r["p"]["issue_code"]) == PERIODS[r["i"]][1:], PERIODS[r["i"]]


def test_units_and_scales(spark):
    raws = ["Đơn vị tính: triệu đồng", "ĐVT: VNĐ", "tỷ lệ (%)", "năm 2023", "đồng hồ", None, ""]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").withColumn("key", text.native_key(F.col("raw")))
    got = rows.orderBy("i").select(units.normalize_unit(F.col("key")).alias("u"), units.unit_issue(F.col("key")).alias("x"), units.has_unit_evidence(F.col("key")).alias("e")).collect()
    assert [tuple(r) for r in got] == [("VND_million", None, True), ("VND", None, True), ("percent", None, True), (None, None, False), (None, "unit_unknown", True), (None, None, False), (None, None, False)]
    one = spark.range(1)
    moved = one.select(units.convert_scale(F.lit(Decimal("2.5")), F.lit("VND_billion"), F.lit("VND_million")).alias("v")).first()["v"]
    assert moved == 2500
    with pytest.raises(Exception, match="incompatible"):
        one.select(units.convert_scale(F.lit(Decimal(1)), F.lit("percent"), F.lit("VND"))).collect()


def test_labels_and_keys(spark):
    rows = spark.createDataFrame([("Ｒevenue",), ("  DOANH  thu thuần ",), ("STRASSE ß",)], "raw string")
    keys = [r[0] for r in rows.select(text.normalized_key("raw")).collect()]
    assert keys == ["revenue", "doanh thu thuần", "strasse ss"]
    metrics = [r[0] for r in rows.select(labels.normalize_metric(text.normalized_key("raw"))).collect()]
    assert metrics == ["revenue", "net_revenue", None]
    with pytest.raises(ValueError):
        labels.check_aliases({"a": ("Same",), "b": ("same ",)})


WIDE = [
    ("１２３", "123", None, None), ("１．２３４，５０", "1234.50", None, None), ("（５）", "-5", None, None), ("１２,5％", "12.5", "percent", None), ("－７", "-7", None, None), ("1 234", "1234", None, None), ("1　234", "1234", None, None), ("\x1c12\x1f", "12", None, None),
    ("⑴", "-1", None, None), ("⒈", "1", None, None), ("x²", None, None, "number_invalid"), ("𝟙𝟚", "12", None, None), ("Ｎ／Ａ", None, None, "number_missing"), ("︲", None, None, "number_missing"), ("﹘", None, None, "number_missing"), ("½", None, None, "number_invalid"), ("１２Ｏ", "120", None, None),
    ("٣", None, None, "number_invalid"), ("１é", None, None, "number_invalid"),
]


def test_compatibility_forms(spark):
    rows = spark.createDataFrame([(i, n[0]) for i, n in enumerate(WIDE)], "i int, raw string")
    got = {r["i"]: r for r in numbers.with_number(rows, "raw").withColumn("may", numbers.is_numeric_candidate(F.col("raw"))).collect()}
    for i, (raw, value, hint, issue) in enumerate(WIDE):
        r = got[i]
        assert (r["value_numeric"], r["number_hint"], r["number_issue"]) == (None if value is None else Decimal(value), hint, issue), raw
        assert r["may"] == (value is not None), raw


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]) | st.sampled_from("１⑴²ﬁ㎏…ⅫK"), max_size=12), min_size=30, max_size=30))
def test_plain_forms_are_nfkc_where_that_is_ascii(spark, texts):
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text.plain_forms(F.col("t"))).collect()]
    for t, g in zip(texts, got):
        form = unicodedata.normalize("NFKC", t)
        assert (g == form) if form.isascii() else not g.isascii()


def test_units_of_headers_in_capitals(spark):
    raws = ["TRIỆU ĐỒNG", "ĐỒNG", "VNĐ", "NGHÌN VNĐ", "SỐ TIỀN (TỶ ĐỒNG)", "Phần Trăm", "SỐ LƯỢNG"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").withColumn("key", text.native_key(F.col("raw")))
    none = F.lit(None).cast("string")
    got = rows.orderBy("i").select(units.resolve_unit(none, F.col("raw"), F.col("key"), none).alias("u")).collect()
    assert [r["u"]["value"] for r in got] == ["VND_million", "VND", "VND", "VND_thousand", "VND_billion", "percent", None]
    assert all(r["u"]["issue_code"] is None for r in got)


def test_unit_lines_are_those_of_the_list():
    assert extraction.names_unit("ĐƠN VỊ TÍNH: đồng") and not extraction.names_unit("ĐVT: đồng")
