"""Queries of operations over canonical values and of the balance check, on values told from the orders of each nation and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.plans import finance
from finweave.queries import QUERIES, SQL, VIEWS, table, view

#: Revenue in a unit by nation, a balance sheet in thousands, and a rate in percent; some are missing, some stand twice.
VIEWS["facts"] = """WITH base AS (
  SELECT n, y, CAST(count(*) AS INT) AS m FROM (SELECT c_nationkey AS n, year(o_orderdate) AS y FROM orders JOIN customer ON c_custkey = o_custkey) o GROUP BY n, y
), told AS (
  SELECT n, y, 'revenue' AS metric, CASE WHEN n % 11 = 10 THEN 0 ELSE 100 + m % 900 END AS v, CASE WHEN n % 3 = 0 THEN 'VND' WHEN n % 3 = 1 THEN 'VND_thousand' ELSE 'VND_million' END AS unit FROM base WHERE n % 9 <> 8 OR y <> 1995
  UNION ALL SELECT n, y, 'total_assets', 1000 + m % 900, 'VND_thousand' FROM base
  UNION ALL SELECT n, y, 'total_liabilities', 600, 'VND_thousand' FROM base
  UNION ALL SELECT n, y, 'equity', 400 + m % 900 + CASE WHEN n % 5 = 0 THEN 3 WHEN n % 5 = 1 THEN 1 ELSE 0 END, 'VND_thousand' FROM base WHERE n % 7 <> 6 AND n <> 22
  UNION ALL SELECT n, y, 'equity', 17, 'percent' FROM base WHERE n = 22
  UNION ALL SELECT n, y, 'equity', 5, 'VND_thousand' FROM base WHERE n = 23
  UNION ALL SELECT n, y, 'equity', (400 + m % 900) * 1000, 'VND' FROM base WHERE n = 2
  UNION ALL SELECT n, y, 'roe', m % 40, 'percent' FROM base
)
SELECT concat('T', CAST(n AS STRING)) AS company, CAST(y AS STRING) AS period, metric, CAST(v AS DECIMAL(38,10)) AS value, unit, concat('cell_', metric, '_', CAST(n AS STRING), '_', CAST(y AS STRING), '_', unit) AS cell_id FROM told"""
ASKED = "query_id", "operation", "companies", "periods", "metrics", "numerator", "denominator", "top_k", "expected_unit"


def _questions(spark: SparkSession, sf_dir: str, operation: str, **columns) -> DataFrame:
    """One question for each nation; ``columns`` are made of its number."""
    n = F.col("n_nationkey")
    given = {"companies": F.array(F.concat(F.lit("T"), n)), "periods": F.array(F.lit("1995")), "metrics": F.array(F.lit("revenue"))} | columns
    none = {"numerator": "string", "denominator": "string", "top_k": "int", "expected_unit": "string"}
    rows = table(spark, sf_dir, "nation")
    return rows.select(n.alias("query_id"), F.lit(operation).alias("operation"), *[given.get(c, F.lit(None).cast(none.get(c, "string"))).alias(c) for c in ASKED[2:]])


def _told(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("query_id", "place", *columns, F.col("value").cast("double").alias("value"), "unit", "issue", F.size("cells").alias("n_cells"))


def _neighbours():
    return F.array(F.concat(F.lit("T"), F.col("n_nationkey")), F.concat(F.lit("T"), (F.col("n_nationkey") + 1) % 25))


def _unit():
    """Millions, a unit that money does not have, or none."""
    return F.when(F.col("n_nationkey") % 4 == 0, F.lit("VND_million")).when(F.col("n_nationkey") % 4 == 1, F.lit("ratio"))


def _years(*years: str):
    return F.array(*map(F.lit, years))


#: A member's value in VND, or plain, and its issue; units' multipliers for values of money.
MEMBERS = """, members AS (
  SELECT company, period, metric, min(base) AS base, min(kind) AS kind, CASE WHEN min(unit) = max(unit) THEN min(unit) ELSE 'VND' END AS unit, min(base) <> max(base) AS twice
  FROM (SELECT *, CAST(value AS BIGINT) * CASE unit WHEN 'VND_thousand' THEN 1000 WHEN 'VND_million' THEN 1000000 ELSE 1 END AS base, CASE WHEN unit LIKE 'VND%' THEN 'money' ELSE unit END AS kind FROM facts) GROUP BY ALL
), mult(unit, m) AS (VALUES ('VND', 1), ('VND_thousand', 1000), ('VND_million', 1000000))"""
_BY_VALUE = "CASE WHEN unit LIKE 'VND%' THEN base * 1000000 // coalesce((SELECT any_value(m) FROM mult WHERE mult.unit = x.unit), 1) ELSE base * 1000000 END::DOUBLE / 1000000.0::DOUBLE"


def _register(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = f"WITH facts AS ({VIEWS['facts']}){MEMBERS} {sql}"
        return f

    return add


@_register("plan_lookup", f"""SELECT query_id, place, company, period, metric, CASE WHEN issue IS NULL THEN {_BY_VALUE} END AS value, CASE WHEN issue IS NULL THEN unit END AS unit, issue, (issue IS NULL)::INTEGER AS n_cells FROM (
  SELECT n_nationkey AS query_id, (p.i * 3 + k.i + 1)::INTEGER AS place, concat('T', n_nationkey) AS company, p.period, k.metric, base, unit, CASE WHEN base IS NULL THEN 'missing_value' WHEN twice THEN 'ambiguous_value' END AS issue
  FROM nation CROSS JOIN (VALUES (0, '1995'), (1, '2050')) p(i, period) CROSS JOIN (VALUES (0, 'revenue'), (1, 'roe'), (2, 'equity')) k(i, metric)
  LEFT JOIN members m ON m.company = concat('T', n_nationkey) AND m.period = p.period AND m.metric = k.metric) x""")
def plan_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of three metrics in a year that is there and one that is not."""
    asked = _questions(spark, sf_dir, "lookup", periods=F.array(F.lit("1995"), F.lit("2050"), F.lit("1995")), metrics=F.array(*map(F.lit, ("revenue", "roe", "equity"))))
    return _told(finance.answer(asked, view(spark, sf_dir, "facts")), "company", "period", "metric")


PAIR = "FROM nation JOIN (VALUES (1), (2)) s(place) ON true LEFT JOIN members m ON m.company = concat('T', (n_nationkey + place - 1) % 25) AND m.period = '1995' AND m.metric = 'revenue'"


@_register("plan_compare", f""", x0 AS (SELECT n_nationkey AS query_id, place, concat('T', (n_nationkey + place - 1) % 25) AS company, base, m.unit, n_nationkey % 4 AS a {PAIR}
), x AS (SELECT query_id, place, company, base, a, CASE WHEN a = 0 THEN 'VND_million' WHEN min(unit) OVER w = max(unit) OVER w THEN min(unit) OVER w ELSE 'VND' END AS unit, CASE WHEN base IS NULL THEN 'missing_value' WHEN a = 1 THEN 'unit_mismatch' END AS issue FROM x0 WINDOW w AS (PARTITION BY query_id)
), y AS (SELECT *, CASE WHEN issue IS NULL THEN {_BY_VALUE} END AS value FROM x)
SELECT query_id, place, company, value, round(value - first_value(value IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS change, CASE WHEN issue IS NULL THEN unit END AS unit, issue, (issue IS NULL)::INTEGER AS n_cells FROM y""")
def plan_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of neighbouring companies, in millions, as it is, or in a unit that money does not have."""
    rows = finance.answer(_questions(spark, sf_dir, "compare", companies=_neighbours(), expected_unit=_unit()), view(spark, sf_dir, "facts"))
    return _told(rows.withColumn("change", F.round(F.col("change").cast("double"), 6)), "company", "change")


TWO_YEARS = "FROM nation LEFT JOIN members a ON a.company = concat('T', n_nationkey) AND a.period = '1995' AND a.metric = 'revenue' LEFT JOIN members b ON b.company = concat('T', n_nationkey) AND b.period = '1996' AND b.metric = 'revenue'"


@_register("plan_difference", f"""SELECT query_id, 1 AS place, CASE WHEN issue IS NULL THEN {_BY_VALUE} END AS value, CASE WHEN issue IS NULL THEN unit END AS unit, issue, CASE WHEN issue IS NULL THEN 2 ELSE 0 END AS n_cells FROM (
  SELECT n_nationkey AS query_id, b.base - a.base AS base, a.unit, CASE WHEN n_nationkey % 6 = 5 THEN 'wrong_members' WHEN a.base IS NULL OR b.base IS NULL THEN 'missing_value' END AS issue {TWO_YEARS}) x""")
def plan_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of 1996 less that of 1995; some questions name one year."""
    asked = _questions(spark, sf_dir, "difference", periods=F.when(F.col("n_nationkey") % 6 == 5, F.array(F.lit("1995"))).otherwise(_years("1995", "1996")))
    return _told(finance.answer(asked, view(spark, sf_dir, "facts")))


@_register("plan_growth_rate", f"""SELECT query_id, 1 AS place, CASE WHEN issue IS NULL THEN round((b - a)::DOUBLE / abs(a)::DOUBLE * 100, 6) END AS value, CASE WHEN issue IS NULL THEN 'percent' END AS unit, issue, CASE WHEN issue IS NULL THEN 2 ELSE 0 END AS n_cells FROM (
  SELECT n_nationkey AS query_id, a.base AS a, b.base AS b, CASE WHEN a.base IS NULL OR b.base IS NULL THEN 'missing_value' WHEN n_nationkey % 4 IN (0, 1) THEN 'unit_mismatch' WHEN a.base = 0 THEN 'division_by_zero' END AS issue {TWO_YEARS}) x""")
def plan_growth_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of revenue from 1995 to 1996; some had none, and some ask for money."""
    return _told(finance.answer(_questions(spark, sf_dir, "growth_rate", periods=_years("1995", "1996"), expected_unit=_unit()), view(spark, sf_dir, "facts")))


@_register("plan_ratio", """SELECT query_id, 1 AS place, CASE WHEN issue IS NULL THEN round(a::DOUBLE / b::DOUBLE * CASE WHEN p THEN 100 ELSE 1 END, 6) END AS value, CASE WHEN issue IS NULL THEN CASE WHEN p THEN 'percent' ELSE 'ratio' END END AS unit, issue, CASE WHEN issue IS NULL THEN 2 ELSE 0 END AS n_cells FROM (
  SELECT n_nationkey AS query_id, n_nationkey % 2 = 0 AS p, a.base AS a, b.base AS b, CASE WHEN a.base IS NULL OR b.base IS NULL THEN 'missing_value' WHEN a.twice OR b.twice THEN 'ambiguous_value' WHEN a.kind <> b.kind THEN 'mixed_units' WHEN b.base = 0 THEN 'division_by_zero' END AS issue
  FROM nation LEFT JOIN members a ON a.company = concat('T', n_nationkey) AND a.period = '1995' AND a.metric = 'equity' LEFT JOIN members b ON b.company = concat('T', n_nationkey) AND b.period = '1995' AND b.metric = CASE WHEN n_nationkey % 3 = 0 THEN 'revenue' ELSE 'total_assets' END) x""")
def plan_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity by assets or by revenue, as a ratio or in percent; missing, ambiguous and mixed values are told."""
    n = F.col("n_nationkey")
    asked = _questions(spark, sf_dir, "ratio", numerator=F.lit("equity"), denominator=F.when(n % 3 == 0, F.lit("revenue")).otherwise(F.lit("total_assets")), expected_unit=F.when(n % 2 == 0, F.lit("percent")))
    return _told(finance.answer(asked, view(spark, sf_dir, "facts")))


OVER = """FROM (SELECT n_nationkey AS query_id, n_nationkey % 4 AS a, count(*) AS n, count(m.base) AS known, sum(m.base) AS total, count(DISTINCT m.kind) AS kinds, CASE WHEN n_nationkey % 4 = 0 THEN 'VND_million' WHEN min(m.unit) = max(m.unit) THEN min(m.unit) ELSE 'VND' END AS unit
  FROM nation JOIN (VALUES ('1995'), ('1996'), ('1997')) p(period) ON true JOIN (VALUES (0, 'revenue'), (1, 'roe')) k(i, metric) ON k.i = 0 OR n_nationkey % 8 = 6 LEFT JOIN members m ON m.company = concat('T', n_nationkey) AND m.period = p.period AND m.metric = k.metric GROUP BY n_nationkey) g"""
OVER_ISSUE = "CASE WHEN known < n THEN 'missing_value' WHEN kinds > 1 THEN 'mixed_units' WHEN a = 1 THEN 'unit_mismatch' END"


def _over(spark: SparkSession, sf_dir: str, operation: str) -> DataFrame:
    metrics = F.when(F.col("n_nationkey") % 8 == 6, F.array(F.lit("revenue"), F.lit("roe"))).otherwise(F.array(F.lit("revenue")))
    return _told(finance.answer(_questions(spark, sf_dir, operation, periods=_years("1995", "1996", "1997"), metrics=metrics, expected_unit=_unit()), view(spark, sf_dir, "facts")))


@_register("plan_average", f"SELECT query_id, 1 AS place, CASE WHEN issue IS NULL THEN round(base::DOUBLE / n / (SELECT m FROM mult WHERE mult.unit = x.unit), 6) END AS value, CASE WHEN issue IS NULL THEN unit END AS unit, issue, CASE WHEN issue IS NULL THEN n ELSE 0 END::INTEGER AS n_cells FROM (SELECT query_id, total AS base, n, unit, {OVER_ISSUE} AS issue {OVER}) x")
def plan_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean revenue over three years."""
    return _over(spark, sf_dir, "average")


@_register("plan_sum", f"SELECT query_id, 1 AS place, CASE WHEN issue IS NULL THEN {_BY_VALUE} END AS value, CASE WHEN issue IS NULL THEN unit END AS unit, issue, CASE WHEN issue IS NULL THEN n ELSE 0 END::INTEGER AS n_cells FROM (SELECT query_id, total::BIGINT AS base, n, unit, {OVER_ISSUE} AS issue {OVER}) x")
def plan_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue over three years."""
    return _over(spark, sf_dir, "sum")


@_register("plan_rank", f"""SELECT query_id, place, company, CASE WHEN issue IS NULL THEN {_BY_VALUE} END AS value, CASE WHEN issue IS NULL THEN unit END AS unit, issue, (issue IS NULL)::INTEGER AS n_cells FROM (
  SELECT n_nationkey AS query_id, row_number() OVER (PARTITION BY n_nationkey ORDER BY base DESC NULLS LAST, i)::INTEGER AS place, concat('T', i) AS company, base, 'VND' AS unit, CASE WHEN base IS NULL THEN 'missing_value' END AS issue
  FROM nation JOIN (SELECT unnest(range(25)) AS i) s ON true LEFT JOIN members m ON m.company = concat('T', i) AND m.metric = 'revenue' AND m.period = (1995 + n_nationkey % 7)::VARCHAR) x WHERE place <= 3 + query_id % 4 OR issue IS NOT NULL""")
def plan_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The companies of most revenue in a year, of all companies."""
    n = F.col("n_nationkey")
    asked = _questions(spark, sf_dir, "rank", companies=F.array(*[F.lit(f"T{i}") for i in range(25)]), periods=F.array((1995 + n % 7).cast("string")), top_k=(3 + n % 4).cast("int"))
    return _told(finance.answer(asked, view(spark, sf_dir, "facts")), "company")


@_register("balance_check", """SELECT company, period, CASE WHEN told THEN assets END::DOUBLE AS assets, CASE WHEN told THEN sources END::DOUBLE AS sources, CASE WHEN told THEN assets - sources END::DOUBLE AS gap, CASE WHEN told THEN tolerance END AS tolerance, status FROM (
  SELECT *, status IN ('balanced', 'unbalanced') AS told FROM (
  SELECT *, CASE WHEN twice > 0 THEN 'ambiguous_value' WHEN plain > 0 THEN 'mixed_units' WHEN n < 3 THEN 'incomplete' WHEN abs(assets - sources) <= tolerance THEN 'balanced' ELSE 'unbalanced' END AS status FROM (
  SELECT company, period, sum(base) FILTER (metric = 'total_assets') AS assets, sum(base) FILTER (metric <> 'total_assets') AS sources, sum(CASE m.unit WHEN 'VND_thousand' THEN 500 WHEN 'VND' THEN 0.5 END)::DOUBLE AS tolerance, count(*) AS n, count(*) FILTER (twice) AS twice, count(*) FILTER (kind <> 'money') AS plain
  FROM members m WHERE metric IN ('total_assets', 'total_liabilities', 'equity') GROUP BY 1, 2)))""")
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets against liabilities and equity: equal, off by what rounding allows, off by more, incomplete, ambiguous, mixed."""
    rows = finance.balance_check(view(spark, sf_dir, "facts"))
    return rows.select("company", "period", *[F.col(c).cast("double").alias(c) for c in ("assets", "sources", "gap", "tolerance")], "status")
