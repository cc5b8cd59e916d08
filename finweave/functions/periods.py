"""Periods: dates, quarters, years and months as column headers print them, on normalized keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_SHORT = r"^([0-9]{1,2})[/\-]([0-9]{1,2})[/\-]([0-9]{2})$"
DATE_LONG = r"^(?:ngày\s+)?([0-9]{1,2})[/\-]([0-9]{1,2})[/\-]([0-9]{4})$"
QUARTER = r"^(?:quý|q)\s*(i{1,3}|iv|[1-4])(?:\s*(?:năm|/|-)?\s*([0-9]{4}))?$"
YEAR = r"^(?:năm\s+)?((?:19|20)[0-9]{2})$"
MONTH = r"^(?:tháng\s+)?([0-9]{1,2})$"
OPEN = r"^(?:tháng|quý|năm)"


def has_period_evidence(key: Column) -> Column:
    out = F.lit(False)
    for pattern in (DATE_SHORT, DATE_LONG, QUARTER, YEAR, MONTH, OPEN):
        out = out | key.rlike(pattern)
    return F.coalesce(out, F.lit(False))


def normalize_period(key: Column, report_year: Column) -> Column:
    """Struct of value and issue_code; null and blank keys have neither."""
    part = lambda pattern, group: F.regexp_extract(key, pattern, group)
    number = lambda pattern, group: part(pattern, group).try_cast("int")
    date_of = lambda d, m, y: F.try_to_date(F.concat_ws("/", d, m, y), "d/M/yyyy")
    short_year = F.lpad((F.floor(report_year / 100) * 100 + number(DATE_SHORT, 3)).cast("string"), 4, "0")
    short = date_of(part(DATE_SHORT, 1), part(DATE_SHORT, 2), short_year)
    long = date_of(part(DATE_LONG, 1), part(DATE_LONG, 2), part(DATE_LONG, 3))
    quarter = F.try_element_at(F.create_map(*[F.lit(x) for pair in (("i", 1), ("ii", 2), ("iii", 3), ("iv", 4), ("1", 1), ("2", 2), ("3", 3), ("4", 4)) for x in pair]), part(QUARTER, 1))
    quarter_year = F.coalesce(F.nullif(part(QUARTER, 2), F.lit("")), report_year.cast("string"))
    value = lambda v: F.struct(v.cast("string").alias("value"), F.lit(None).cast("string").alias("issue_code"))
    issue = lambda c: F.struct(F.lit(None).cast("string").alias("value"), F.lit(c).alias("issue_code"))
    dated = lambda d: F.when(d.isNotNull(), value(F.date_format(d, "yyyy-MM-dd"))).otherwise(issue("period_invalid"))
    return (
        F.when(key.rlike(DATE_SHORT) & (number(DATE_SHORT, 1) <= 12) & (number(DATE_SHORT, 2) <= 12), issue("period_ambiguous"))
        .when(key.rlike(DATE_SHORT), dated(short))
        .when(key.rlike(DATE_LONG), dated(long))
        .when(key.rlike(QUARTER), value(F.concat(quarter_year, F.lit("-Q"), quarter.cast("string"))))
        .when(key.rlike(YEAR), value(part(YEAR, 1)))
        .when(key.rlike(MONTH) & number(MONTH, 1).between(1, 12), value(F.concat(report_year.cast("string"), F.lit("-"), F.lpad(number(MONTH, 1).cast("string"), 2, "0"))))
        .when(key.rlike(OPEN), issue("period_incomplete"))
        .otherwise(F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("issue_code")))
    )
