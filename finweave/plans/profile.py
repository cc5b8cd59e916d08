"""Analytics over a release or an inventory: coverage, missingness, distributions, ranks, provenance, drill-down."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
#: Parts that a pass of ``values_at_ranks`` cuts each open range into.
PARTS = 1024


def n(condition: Column | None = None) -> Column:
    return (F.count(F.lit(1)) if condition is None else F.count_if(condition)).cast("long")


def rounded(c: Column, places: int = 4) -> Column:
    return F.round(c.cast("double"), places)


def values_at_ranks(df: DataFrame, column: str, ranks_of) -> tuple[int, dict[int, float]]:
    """The number of finite values of a column, and the value at each rank (from 0) that ``ranks_of(number)`` names, exactly.

    Each pass cuts the ranges that still hold a wanted rank into ``PARTS`` parts and counts these; the
    next one reads only the parts with a wanted rank, between the least and the greatest value there, until
    a part has one value.  So a pass sends a bounded number of counts, and no list of values is built.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')")
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    wanted = sorted(set(ranks_of(whole["n"]))) if whole["n"] else []
    open_, found = [(0, whole["n"], whole["low"], whole["high"])], {}
    while open_:
        ranges = []
        for before, n_rows, low, high in open_:
            mine = [r for r in wanted if before <= r < before + n_rows]
            if low == high:
                found |= dict.fromkeys(mine, low)
            elif mine:
                ranges.append((before, n_rows, low, high))
        if not ranges:
            break
        which, part = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (_, _, low, high) in enumerate(ranges):
            inside = F.col("v").between(low, high)
            step = (high - low) / PARTS
            # The ends always fall to different parts, so each pass narrows every range.
            at = F.least(F.lit(PARTS - 1), F.floor((F.col("v") - low) / step).cast("int")) if step > 0 else (F.col("v") > low).cast("int")
            which, part = F.when(inside, F.lit(k)).otherwise(which), F.when(inside, F.when(F.col("v") == high, F.lit(PARTS - 1)).otherwise(F.least(at, F.lit(PARTS - 2)))).otherwise(part)
        counts = values.select("v", which.alias("k"), part.alias("part")).where("k IS NOT NULL").groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        open_, upto = [], {k: r[0] for k, r in enumerate(ranges)}
        for r in sorted(counts.collect(), key=lambda r: (r["k"], r["part"])):
            open_.append((upto[r["k"]], r["n"], r["low"], r["high"]))
            upto[r["k"]] += r["n"]
    return whole["n"], found


def quantiles(df: DataFrame, column: str, levels: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles with linear interpolation between ranks; of no values, none."""
    ends = lambda n, p: (floor((n - 1) * p), ceil((n - 1) * p))
    n_rows, at = values_at_ranks(df, column, lambda n: [r for p in levels for r in ends(n, p)])
    if not n_rows:
        return [None] * len(levels)
    out = []
    for p in levels:
        low, high = ends(n_rows, p)
        share = (n_rows - 1) * p - low
        out.append(at[low] if low == high else (1 - share) * at[low] + share * at[high])
    return out


def document_summary(d: DataFrame) -> DataFrame:
    distinct = [F.count_distinct(c).alias(f"n_{c}") for c in ("doc_id", "company_code", "report_year", "statement_scope")]
    median = F.lit(quantiles(d, "file_size_bytes", (0.5,))[0])
    one = d.agg(n().alias("n_documents"), *distinct, F.min("report_year").alias("first_year"), F.max("report_year").alias("last_year"), rounded(F.avg("file_size_bytes"), 2).alias("avg_bytes"))
    return one.withColumn("median_bytes", rounded(median, 2))


def scope_matrix(d: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    """Documents by year and scope, zeros filled."""
    return d.groupBy("report_year").pivot("statement_scope", list(scopes)).count().na.fill(0)


def company_coverage(d: DataFrame) -> DataFrame:
    return d.groupBy("company_code").agg(n().alias("n_documents"), F.count_distinct("report_year").alias("n_years"), F.count_distinct("statement_scope").alias("n_scopes"), F.min("report_year").alias("first_year"), F.max("report_year").alias("last_year"))


def coverage_heatmap(d: DataFrame, years: tuple[int, ...], top: int) -> DataFrame:
    """The companies with most documents by year."""
    first = d.groupBy("company_code").agg(n().alias("total")).orderBy(F.col("total").desc(), "company_code").limit(top)
    return d.join(first.select("company_code"), "company_code").groupBy("company_code").pivot("report_year", list(years)).count().na.fill(0)


def table_summary(t: DataFrame) -> DataFrame:
    cells = F.col("row_count").cast("long") * F.col("column_count")
    return t.agg(n().alias("n_tables"), F.count_distinct("doc_id").alias("n_documents"), F.sum(cells).alias("estimated_cells"), rounded(F.avg("row_count")).alias("avg_rows"), rounded(F.avg("column_count")).alias("avg_columns"), rounded(F.avg("quality_score")).alias("avg_quality"), n(F.col("title_raw").isNull()).alias("no_title"), n(F.col("statement_type").isNull()).alias("no_statement"), n(F.col("unit_normalized").isNull()).alias("no_unit"))


def missingness(df: DataFrame) -> DataFrame:
    """column, n_null, percent of every column, in one pass."""
    one = df.agg(n().alias("n_rows"), *[n(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_null")) for c in df.columns])
    rows = one.select("n_rows", F.explode(each).alias("r")).select("n_rows", "r.*")
    return rows.select("column", "n_null", rounded(F.when(F.col("n_rows") > 0, F.col("n_null") * 100.0 / F.col("n_rows")).otherwise(0.0), 2).alias("percent"))


def distribution(df: DataFrame, column: str, absent: str = "(missing)") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(absent)).alias("value")).agg(n().alias("n")).orderBy(F.col("n").desc(), "value")


def exact_quantiles(df: DataFrame, column: str, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """level, value with linear interpolation between ranks."""
    rows = df.sparkSession.createDataFrame(list(zip(levels, quantiles(df, column, levels))), "level double, value double")
    return rows.select("level", rounded(F.col("value"), 6).alias("value"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, stddev, min, exact percentiles, max."""
    c = F.col(column).cast("double")
    levels = (0.5, 0.75, 0.9, 0.95, 0.99)
    exact = {f"p{round(p * 100)}": F.lit(v).cast("double") for p, v in zip(levels, quantiles(df, column, levels))}
    one = df.agg(F.count(c).alias("count"), rounded(F.avg(c)).alias("mean"), rounded(F.stddev_samp(c)).alias("std"), rounded(F.min(c)).alias("min"), rounded(F.max(c)).alias("max"))
    return one.select("count", "mean", "std", "min", *[rounded(v).alias(name) for name, v in exact.items()], "max")


def status_summary(o: DataFrame) -> DataFrame:
    return o.groupBy("status").agg(n().alias("n"), F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("canonical_table_id").alias("n_tables"))


def rejection_histogram(o: DataFrame) -> DataFrame:
    return o.where("rejection_code IS NOT NULL").groupBy("rejection_code").agg(n().alias("n"))


def issue_shares(i: DataFrame) -> DataFrame:
    """code, n, share of all: the window runs over one row for each code."""
    counts = i.groupBy("code").agg(n().alias("n"))
    return counts.select("code", "n", rounded(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def issue_matrix(i: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return i.groupBy("code").pivot("field", list(fields)).count().na.fill(0)


def affected_rates(i: DataFrame, c: DataFrame) -> DataFrame:
    """Distinct cells, tables and documents with issues, and issues for 100 cells."""
    a = i.agg(n().alias("n_issues"), *[F.count_distinct(k).alias(f"n_{k}") for k in ("cell_id", "table_id", "doc_id")])
    both = a.crossJoin(c.agg(n().alias("n_cells")))
    return both.withColumn("per_100_cells", rounded(F.try_divide(F.col("n_issues") * 100.0, F.col("n_cells"))))


def top_values(i: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent raw values of each code; nulls come last among equals."""
    counts = i.groupBy("code", "raw_value").agg(n().alias("n"))
    order = Window.partitionBy("code").orderBy(F.col("n").desc(), F.col("raw_value").asc_nulls_last())
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def issues_by_document(d: DataFrame, i: DataFrame) -> DataFrame:
    """Every document with its issues, zeros too; issues are counted before the join."""
    counts = i.groupBy("doc_id").agg(n().alias("n"))
    return d.select("doc_id", "company_code").join(counts, "doc_id", "left").select("doc_id", "company_code", F.coalesce("n", F.lit(0).cast("long")).alias("n_issues"))


def largest_tables(t: DataFrame, d: DataFrame, k: int = 20) -> DataFrame:
    size = F.col("row_count").cast("long") * F.col("column_count")
    first = t.withColumn("estimated_cells", size).orderBy(F.col("estimated_cells").desc(), "table_id").limit(k)
    return first.join(d.select("doc_id", "company_code"), "doc_id").select("table_id", "doc_id", "company_code", "estimated_cells")


def provenance(i: DataFrame, t: DataFrame, o: DataFrame, d: DataFrame, code: str, k: int = 25) -> DataFrame:
    """Issues of a code with their table, its place in the source, and the document."""
    rows = i.where(F.col("code") == code).join(t.select("table_id", "doc_id", "line_start", "line_end"), ["table_id", "doc_id"])
    rows = rows.join(o.select(F.col("canonical_table_id").alias("table_id"), "doc_id", "ordinal", "status"), ["table_id", "doc_id"], "left").join(d.select("doc_id", "company_code", "report_year"), "doc_id")
    return rows.select("cell_id", "table_id", "doc_id", "company_code", "report_year", "ordinal", "status", "line_start", "line_end").orderBy("table_id", "cell_id").limit(k)


def multiple_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, with their counts."""
    return df.groupBy(*keys).agg(n().alias("n")).where("n > 1")


def company_issues(spark: SparkSession, i: DataFrame, d: DataFrame, company: str) -> DataFrame:
    """Issues of one company by year and code; the company is a bound parameter."""
    return spark.sql("SELECT report_year, code, count(*) AS n FROM {i} JOIN {d} USING (doc_id) WHERE company_code = :company GROUP BY report_year, code", args={"company": company}, i=i, d=d.select("doc_id", "company_code", "report_year"))


def table_drilldown(spark: SparkSession, t: DataFrame, o: DataFrame, i: DataFrame, table_id: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A table's row, its occurrences by ordinal, and its first issues."""
    args = {"id": table_id, "k": k}
    meta = spark.sql("SELECT * FROM {t} WHERE table_id = :id", args={"id": table_id}, t=t)
    found = spark.sql("SELECT * FROM {o} WHERE canonical_table_id = :id ORDER BY ordinal", args={"id": table_id}, o=o)
    return meta, found, spark.sql("SELECT * FROM {i} WHERE table_id = :id ORDER BY code, cell_id LIMIT :k", args=args, i=i)


def anomalies(d: DataFrame, years: tuple[int, int]) -> DataFrame:
    """One row: tiny files, files above the 99.5 % size, years outside, members of repeated digests."""
    high = F.lit(quantiles(d, "file_size_bytes", (0.995,))[0])
    twice = d.groupBy("sha256").agg(n().alias("m")).where("m > 1").agg(F.coalesce(F.sum("m"), F.lit(0).cast("long")).alias("repeated"))
    one = d.agg(n(F.col("file_size_bytes").between(0, 1023)).alias("tiny"), n(F.col("file_size_bytes") > high).alias("oversized"), n(~F.col("report_year").between(*years)).alias("odd_years"))
    return one.crossJoin(twice)


def quick_look(df: DataFrame) -> DataFrame:
    """One row: rows, columns, rows that repeat another in full."""
    keys = [F.col(f"`{c}`") for c in df.columns]
    groups = df.groupBy(*keys).agg(n().alias("_m"))
    return groups.agg(F.sum("_m").alias("n_rows"), F.sum(F.col("_m") - 1).alias("n_repeated")).withColumn("n_columns", F.lit(len(df.columns)))


def describe_all(df: DataFrame) -> DataFrame:
    """column, count, n_null, and of numbers mean, std, min, p25, p50, p75, max, of all others n_unique, top, frequency (booleans, dates and nested values as text).

    The mode is exact: equal values are counted before the shuffle, and a column's counts are reduced by partitions before
    they meet; ties go to the smaller text.  Numbers that are none or not finite count as null.
    """
    numeric = [c for c, kind in df.dtypes if kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))]
    others = [c for c in df.columns if c not in numeric]
    as_text = {c: F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if kind.startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string") for c, kind in df.dtypes}
    shown = lambda c: F.when(F.col(f"`{c}`").isNotNull(), as_text[c])
    schema = "column string, count long, n_null long, n_unique long, top string, frequency long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    spark = df.sparkSession
    out = spark.createDataFrame([], schema)
    if others:
        each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), shown(c).alias("value")) for c in others])))
        counted = each.groupBy("column", "value").agg(n().alias("m"))
        known = F.col("value").isNotNull()
        mode = F.min(F.when(known, F.struct((-F.col("m")).alias("minus"), "value"))).alias("mode")
        rows = counted.groupBy("column").agg(F.sum(F.when(known, F.col("m"))).alias("count"), F.sum(F.when(~known, F.col("m"))).alias("n_null"), F.count("value").alias("n_unique"), mode)
        rows = spark.createDataFrame([(c,) for c in others], "column string").join(rows, "column", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        none = [F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
        out = out.unionByName(rows.select("column", zero("count"), zero("n_null"), zero("n_unique"), F.col("mode.value").alias("top"), (-F.col("mode.minus")).cast("long").alias("frequency"), *none))
    for c in numeric:
        v = F.col(f"`{c}`").cast("double")
        v = F.when(F.abs(v) < float("inf"), v)
        quarters = quantiles(df.select(v.alias("v")), "v", (0.25, 0.5, 0.75))
        one = df.agg(F.count(v).alias("count"), (F.count(F.lit(1)) - F.count(v)).alias("n_null"), rounded(F.avg(v)).alias("mean"), rounded(F.stddev_samp(v)).alias("std"), rounded(F.min(v)).alias("min"), rounded(F.max(v)).alias("max"))
        exact = [rounded(F.lit(q)).alias(name) for q, name in zip(quarters, ("p25", "p50", "p75"))]
        none = F.lit(None).cast("long")
        out = out.unionByName(one.select(F.lit(c).alias("column"), "count", "n_null", none.alias("n_unique"), F.lit(None).cast("string").alias("top"), none.alias("frequency"), "mean", "std", "min", *exact, "max"))
    return out


def content_quality(profile: DataFrame) -> DataFrame:
    """One row of (read_issue, utf8_valid): files, read files, read errors, share of valid UTF-8 among the read ones."""
    read = F.col("read_issue").isNull()
    return profile.agg(n().alias("files"), n(read).alias("read"), n(~read).alias("read_errors"), rounded(F.avg(F.when(read, F.col("utf8_valid").cast("int"))), 6).alias("utf8_share"))


def readiness(inventory: DataFrame, content: DataFrame) -> DataFrame:
    """priority, finding, evidence: what the tolerant inventory and the inspected contents say about a corpus, in five rows.

    ``inventory`` has structure_status, is_empty, ticker, year; ``content`` has read_issue, utf8_valid, has_markers.
    """
    both = F.col("ticker").isNotNull() & F.col("year").isNotNull()
    a = inventory.agg(n().alias("total"), n(F.col("structure_status") == "malformed").alias("malformed"), n(F.coalesce("is_empty", F.lit(False))).alias("empty"), F.count_distinct(F.when(both, F.struct("ticker", "year"))).alias("pairs"))
    b = content.agg(n().alias("files"), n(F.col("read_issue").isNotNull()).alias("errors"), n(~F.col("utf8_valid")).alias("invalid"), F.coalesce(F.avg(F.coalesce("has_markers", F.lit(False)).cast("int")), F.lit(0.0)).alias("marked"))
    # One-row sides.
    one, whole = a.crossJoin(b), lambda c: F.format_number(F.col(c), 0)
    found = (
        ("P0", "path parsing", F.concat(whole("malformed"), F.lit("/"), whole("total"), F.lit(" malformed paths"))),
        ("P0", "quarantine", F.concat(whole("empty"), F.lit(" empty files; "), whole("errors"), F.lit(" sampled read errors"))),
        ("P1", "encoding", F.concat(whole("invalid"), F.lit("/"), whole("files"), F.lit(" sampled files are not strict UTF-8"))),
        ("P1", "table detection", F.concat(F.format_string("%.1f", F.col("marked") * 100), F.lit("% of sampled files contain simple table markers"))),
        ("P2", "coverage", F.concat(whole("pairs"), F.lit(" observed ticker-year pairs"))),
    )
    rows = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(f).alias("finding"), e.alias("evidence")) for p, f, e in found])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def extraction_totals(extracted: DataFrame) -> DataFrame:
    """One row: documents, tables, cells, placements, rejections, and documents without HTML tables, with and without other tables."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    d = extracted.where("part = 'document'")
    sums = [total(c).alias(name) for c, name in (("n_tables", "tables"), ("n_cells", "cells"), ("n_placements", "placements"), ("n_rejected", "rejections"))]
    return d.agg(n().alias("documents"), *sums, n(F.col("html_free")).alias("html_free"), n(F.col("html_free") & (F.col("n_tables") > 0)).alias("html_free_with_tables"))


def nondeterministic(first: DataFrame, second: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys whose rows differ between two runs of a step, or that only one run has; a key's digest is a sum, so order is no matter, and the sums of equal runs cancel out."""
    row = lambda df: F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))).cast("decimal(38,0)")
    signed = lambda df, sign: df.select(key, F.lit(sign).alias("n"), (row(df) * sign).alias("digest"))
    both = signed(first, 1).unionByName(signed(second, -1)).groupBy(key).agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))
    return both.where((F.col("n") != 0) | (F.col("digest") != 0)).select(key)


def seeded_sample(df: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """The same k rows on every run: first by a digest of seed and key."""
    return df.withColumn("_rank", F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)).orderBy("_rank", key).limit(k).drop("_rank").orderBy(key)


def download_plan(files: DataFrame, reserve: int, free: int) -> DataFrame:
    """One row: files and bytes in all and still to fetch, revisions, whether they fit beside a reserve."""
    one = files.agg(n().alias("file_count"), F.sum("size").alias("total_bytes"), n(F.col("will_download")).alias("pending_count"), F.coalesce(F.sum(F.when(F.col("will_download"), F.col("size"))), F.lit(0).cast("long")).alias("pending_bytes"), F.count_distinct("revision").alias("n_revisions"))
    return one.withColumn("fits", (F.col("pending_bytes") + reserve <= free) & (F.col("n_revisions") == 1))
