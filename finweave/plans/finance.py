"""Questions about canonical values as rows, answered by joins and aggregations, and the check of balance sheets.

A question has an operation, companies, periods and metrics (arrays, in the order asked), and for a ratio its two
metrics; many questions are a table and are answered by one job.  Values of money in any scale are brought to one
unit: the one asked for, or the one that all values share, or VND.

Operations: ``lookup`` and ``compare`` give a row for each value (compare with its difference from the first one asked for), ``rank``
gives rows in order (largest first), ``difference`` (second less first), ``growth_rate`` (percent, of the first), ``ratio``
(numerator by denominator), ``average`` and ``sum`` give one row.  A question's members are its companies x periods x metrics; a ratio's are its
companies x periods.

Issues, one for a row, in this order: ``unknown_operation``; ``wrong_members`` (a difference or growth rate of other than two members, a
ratio of other than one, nothing asked for); ``missing_value``; ``ambiguous_value`` (a member with several values); ``mixed_units`` (money beside
percent or ratio, but for values that are looked up); ``unit_mismatch`` (the unit asked for is of another kind); ``division_by_zero``.  A row with an issue has no value.  An operation over all
members fails as a whole; lookup, compare and rank go on without the members that have an issue of their own, and tell them.

Edge cases: null arrays count as empty; members asked for twice count once; equal values rank by the order asked; facts without company, period, metric, unit or value are no
facts; facts repeated with equal value and unit are one; values have six digits behind the mark.  An empty table of questions gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finweave.functions.units import MONETARY, MULTIPLIERS, PLAIN, unit_multiplier

VALUE = "decimal(38,6)"
#: The operations.
EACH, TWO, ALL = ("lookup", "compare", "rank"), ("difference", "growth_rate"), ("average", "sum")
OPERATIONS = (*EACH, *TWO, "ratio", *ALL)


def facts_of(cells: DataFrame, tables: DataFrame, documents: DataFrame) -> DataFrame:
    """company, period, metric, value, unit, cell_id of a release's cells that name all of them."""
    rows = cells.join(tables.select("table_id", "doc_id"), "table_id").join(documents.select("doc_id", "company_code"), "doc_id")
    return rows.select(F.col("company_code").alias("company"), "period", F.col("row_label_canonical").alias("metric"), F.col("value_numeric").alias("value"), "unit", "cell_id")


def _kind(unit: Column) -> Column:
    return F.when(unit.isin(*MONETARY), F.lit("money")).when(unit.isin(*PLAIN), unit)


def single_facts(facts: DataFrame) -> DataFrame:
    """company, period, metric, base (the value in VND, or plain), kind, unit, cell_id (the smallest), ambiguous of every member."""
    keys = ["company", "period", "metric"]
    whole = F.lit(True)
    for c in (*keys, "value", "unit"):
        whole = whole & F.col(c).isNotNull()
    rows = facts.where(whole & F.col("unit").isin(*MULTIPLIERS))
    # Equal amounts in two scales are one value.
    rows = rows.withColumns({"kind": _kind(F.col("unit")), "base": (F.col("value") * unit_multiplier(F.col("unit"))).cast(VALUE)})
    rows = rows.groupBy(*keys).agg(F.min("base").alias("low"), F.max("base").alias("high"), F.min("kind").alias("kind"), F.max("kind").alias("kind_to"), F.min("unit").alias("unit"), F.max("unit").alias("unit_to"), F.min("cell_id").alias("cell_id"))
    unit = F.when(F.col("unit") == F.col("unit_to"), F.col("unit")).otherwise(F.lit("VND"))
    return rows.select(*keys, F.col("low").alias("base"), "kind", unit.alias("unit"), "cell_id", ((F.col("low") != F.col("high")) | (F.col("kind") != F.col("kind_to"))).alias("ambiguous"))


def _asked(questions: DataFrame) -> DataFrame:
    """A row for each member of a question: its place, company, period, metric, and role (value, numerator, denominator)."""
    listed = lambda c: F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))
    is_ratio = F.col("operation") == "ratio"
    roles = F.when(is_ratio, F.array(F.struct(F.lit("numerator").alias("role"), F.col("numerator").alias("metric")), F.struct(F.lit("denominator").alias("role"), F.col("denominator").alias("metric"))))
    roles = roles.otherwise(F.transform(listed("metrics"), lambda m: F.struct(F.lit("value").alias("role"), m.alias("metric"))))
    rows = questions.withColumns({"_companies": listed("companies"), "_periods": listed("periods"), "_roles": roles})
    n = F.size("_companies") * F.size("_periods") * F.when(is_ratio, F.lit(1)).otherwise(F.size("_roles"))
    rows = rows.withColumn("n_members", n)
    # Without members a question is one row, which tells the issue.
    rows = rows.withColumns({c: F.when(F.col("n_members") > 0, F.col(c)) for c in ("_companies", "_periods", "_roles")})
    rows = rows.select("query_id", "operation", "expected_unit", "top_k", "n_members", F.posexplode_outer("_companies").alias("i", "company"), "_periods", "_roles")
    rows = rows.select("query_id", "operation", "expected_unit", "top_k", "n_members", "i", "company", F.posexplode_outer("_periods").alias("j", "period"), "_roles")
    rows = rows.select("query_id", "operation", "expected_unit", "top_k", "n_members", "i", "company", "j", "period", F.posexplode_outer("_roles").alias("k", "_role"))
    return rows.select("query_id", "operation", "expected_unit", "top_k", "n_members", F.struct("i", "j", "k").alias("nth"), "company", "period", F.col("_role.metric").alias("metric"), F.coalesce("_role.role", F.lit("value")).alias("role"))


def _in_unit(base: Column, unit: Column) -> Column:
    return (base / unit_multiplier(unit)).cast(VALUE)


def answer(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, operation, place, company, period, metric, value, unit, change, issue, cells for rows of questions.

    ``questions`` has query_id (unique), operation, companies, periods, metrics, numerator, denominator, top_k, expected_unit.  company, period and
    metric are null in rows that stand for several; ``change`` is a compared value's difference from the first; ``cells`` are those that the row rests on.
    """
    rows = _asked(questions).join(single_facts(facts), ["company", "period", "metric"], "left")
    alone = (
        F.when(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), F.lit("unknown_operation"))
        .when((F.col("n_members") == 0) | (F.col("operation").isin(*TWO) & (F.col("n_members") != 2)) | ((F.col("operation") == "ratio") & (F.col("n_members") != 1)), F.lit("wrong_members"))
        .when(F.col("base").isNull(), F.lit("missing_value"))
        .when(F.col("ambiguous"), F.lit("ambiguous_value"))
    )
    # Kinds must agree, but for a ratio's two sides, which give a plain number.
    rows = rows.withColumn("issue", alone)
    good = F.when(F.col("issue").isNull(), F.col("kind"))
    per = rows.groupBy("query_id").agg(
        F.min(good).alias("kind_low"), F.max(good).alias("kind_high"), F.min(F.when(F.col("issue").isNull(), F.col("unit"))).alias("unit_low"), F.max(F.when(F.col("issue").isNull(), F.col("unit"))).alias("unit_high"),
        F.min(F.struct(_severity(F.col("issue")), "issue")).alias("worst"),
    )
    rows = rows.join(per, "query_id")
    shared = F.when(F.col("unit_low") == F.col("unit_high"), F.col("unit_low")).otherwise(F.lit("VND"))
    # Values that are looked up stand alone.
    is_lookup = F.col("operation") == "lookup"
    unit = F.coalesce("expected_unit", F.when(is_lookup, F.col("unit")).otherwise(shared))
    rows = rows.withColumn("target", F.when(F.col("operation") == "growth_rate", F.lit("percent")).when(F.col("operation") == "ratio", F.lit("ratio")).otherwise(unit))
    asked_kind = _kind(F.col("expected_unit"))
    wrong = F.col("expected_unit").isNotNull() & F.when(F.col("operation") == "growth_rate", F.col("expected_unit") != "percent").when(F.col("operation") == "ratio", ~F.col("expected_unit").isin("ratio", "percent")).otherwise(asked_kind.isNull() | (asked_kind != F.col("kind")))
    of_all = F.when(~is_lookup & (F.col("kind_low") != F.col("kind_high")), F.lit("mixed_units")).when(wrong, F.lit("unit_mismatch"))
    rows = rows.withColumn("target", F.when((F.col("operation") == "ratio") & (F.col("expected_unit") == "percent"), F.lit("percent")).otherwise(F.col("target")))
    return _each(rows.where(F.col("operation").isin(*EACH)), of_all).unionByName(_together(rows.where(~F.coalesce(F.col("operation").isin(*EACH), F.lit(False))), of_all))


def _severity(issue: Column) -> Column:
    order = ("unknown_operation", "wrong_members", "missing_value", "ambiguous_value")
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(issue == name, F.lit(i)).otherwise(out)
    return out.alias("severity")


OUT = ("query_id", "operation", "place", "company", "period", "metric", "value", "unit", "change", "issue", "cells")


def _each(rows: DataFrame, of_all: Column) -> DataFrame:
    """Lookup, compare and rank: a row for each member; what a rank cuts off is left out."""
    rows = rows.withColumn("issue", F.coalesce("issue", of_all)).withColumn("value", F.when(F.col("issue").isNull(), _in_unit(F.col("base"), F.col("target"))))
    asked = Window.partitionBy("query_id").orderBy("nth")
    by_value = Window.partitionBy("query_id").orderBy(F.col("value").desc_nulls_last(), "nth")
    first = F.first("value", ignorenulls=True).over(asked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    is_rank = F.col("operation") == "rank"
    rows = rows.withColumns({"place": F.when(is_rank, F.row_number().over(by_value)).otherwise(F.row_number().over(asked)), "change": F.when(F.col("operation") == "compare", F.col("value") - first).cast(VALUE)})
    rows = rows.where(~is_rank | F.col("issue").isNotNull() | F.col("top_k").isNull() | (F.col("place") <= F.col("top_k")))
    cells = F.when(F.col("value").isNotNull(), F.array("cell_id")).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"unit": F.when(F.col("value").isNotNull(), F.col("target")), "cells": cells}).select(*OUT)


def _together(rows: DataFrame, of_all: Column) -> DataFrame:
    """Difference, growth rate, ratio, average and sum: one row for each question."""
    low = F.min(F.struct("nth", "base"))
    high = F.max(F.struct("nth", "base"))
    side = lambda name: F.max(F.when(F.col("role") == name, F.col("base")))
    rows = rows.withColumn("of_all", F.when(F.col("operation") != "ratio", of_all).otherwise(F.when(of_all == "unit_mismatch", of_all)))
    got = rows.groupBy("query_id", "operation", "target").agg(
        F.first("worst.issue").alias("worst"), F.max("of_all").alias("of_all"), low.alias("low"), high.alias("high"), F.sum("base").alias("total"), F.count("base").alias("n"),
        side("numerator").alias("above"), side("denominator").alias("below"), F.sort_array(F.collect_set("cell_id")).alias("cells"), F.max("kind_low").alias("kind_low"), F.max("kind_high").alias("kind_high"),
    )
    op = F.col("operation")
    a, b = F.col("low.base"), F.col("high.base")
    zero = ((op == "growth_rate") & (a == 0)) | ((op == "ratio") & (F.col("below") == 0))
    mixed = F.when((op == "ratio") & (F.col("kind_low") != F.col("kind_high")), F.lit("mixed_units"))
    issue = F.coalesce("worst", mixed, "of_all", F.when(zero, F.lit("division_by_zero")))
    got = got.withColumn("issue", issue)
    share = lambda x, y: (x.cast("double") / y.cast("double"))
    plain = lambda x: F.round(x, 6).cast(VALUE)
    value = (
        F.when(op == "difference", _in_unit(b - a, F.col("target")))
        .when(op == "growth_rate", plain(share(b - a, F.abs(a)) * 100))
        .when(op == "ratio", plain(share(F.col("above"), F.col("below")) * F.when(F.col("target") == "percent", 100).otherwise(1)))
        .when(op == "average", _in_unit(F.col("total") / F.col("n"), F.col("target")))
        .when(op == "sum", _in_unit(F.col("total"), F.col("target")))
    )
    ok = F.col("issue").isNull()
    none = F.lit(None).cast("string")
    cells = F.when(ok, F.col("cells")).otherwise(F.array().cast("array<string>"))
    return got.withColumns({"value": F.when(ok, value), "place": F.lit(1), "unit": F.when(ok, F.col("target")), "cells": cells, "change": F.lit(None).cast(VALUE), "company": none, "period": none, "metric": none}).select(*OUT)


def balance_check(facts: DataFrame, assets: str = "total_assets", sources: tuple[str, ...] = ("total_liabilities", "equity"), halves: int = 1) -> DataFrame:
    """company, period, assets, sources, gap, tolerance (all in VND), status of every company and period that names one of the metrics.

    Values are rounded to their unit where they are printed, so each may be off by half of it; the tolerance is the
    sum of these halves (``halves`` times) over the values that take part.  Status: ``balanced``, ``unbalanced``, ``incomplete`` (a value is missing),
    ``ambiguous_value`` or ``mixed_units``.
    """
    wanted = (assets, *sources)
    rows = single_facts(facts.where(F.col("metric").isin(*wanted)))
    half = F.when(F.col("kind") == "money", unit_multiplier(F.col("unit")) / 2 * halves)
    of = lambda *names: F.sum(F.when(F.col("metric").isin(*names), F.col("base")))
    met = rows.groupBy("company", "period").agg(
        of(assets).alias("assets"), of(*sources).alias("sources"), F.sum(half).alias("tolerance"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ambiguous"), 1)).alias("ambiguous"), F.count(F.when(F.col("kind") != "money", 1)).alias("plain"),
    )
    gap = F.col("assets") - F.col("sources")
    status = (
        F.when(F.col("ambiguous") > 0, F.lit("ambiguous_value")).when(F.col("plain") > 0, F.lit("mixed_units")).when(F.col("n") < len(wanted), F.lit("incomplete"))
        .when(F.abs(gap) <= F.col("tolerance"), F.lit("balanced")).otherwise(F.lit("unbalanced"))
    )
    told = F.col("status").isin("balanced", "unbalanced")
    rows = met.withColumns({"status": status, "gap": gap})
    return rows.select("company", "period", *[F.when(told, F.col(c)).cast(VALUE).alias(c) for c in ("assets", "sources", "gap", "tolerance")], "status")
