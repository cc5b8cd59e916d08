"""Audit of normalization issues: stratified sample, label metrics, comparison of releases, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finweave.functions import ids
from finweave.errors import ContractError

RATE = "decimal(20,6)"
SEED, PER_STRATUM = "normalization-audit-v1", 5
#: Rows of each code that a sample holds at most.
LIMITS = {"unit_unknown": 200, "metric_unknown": 200, "number_invalid": 200, "number_missing": 200, "unit_conflict": 100, "statement_conflict": 100, "number_ambiguous": 100, "period_incomplete": 100, "period_ambiguous": 100}
TABLES_AFTER, MIN_COVERAGE, MAX_FALSE = 146_011, 0.90, 0.05
CONTEXT_CELL, CONTEXT_TABLE = ("row_label_raw", "column_label_raw", "value_raw"), ("table_title_raw", "table_unit_raw")


def _left_join(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """A left join for which rows without a key are dealt out by their other columns; they match nothing, and would all meet in one task."""
    left = rows.withColumn("_key", F.coalesce(key, F.concat(F.lit("none "), F.xxhash64(*rows.columns).cast("string"))))
    right = other.withColumnRenamed(key, "_other")
    return left.join(right, (F.col("_key") == F.col("_other")) & F.col(key).isNotNull(), "left").drop("_key", "_other")


def issue_context(issues: DataFrame, documents: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Issues with their document's, table's and cell's fields; lines come from the cell, or the table where there is none."""
    d = documents.select("doc_id", "company_code", "report_year")
    t = tables.select("table_id", "statement_type", F.col("title_raw").alias("table_title_raw"), F.col("unit_raw").alias("table_unit_raw"), F.col("line_start").alias("_ts"), F.col("line_end").alias("_te"))
    c = cells.select("cell_id", *CONTEXT_CELL, F.col("source_line_start").alias("_cs"), F.col("source_line_end").alias("_ce"))
    rows = issues.withColumnRenamed("code", "issue_code").join(d, "doc_id")
    rows = _left_join(_left_join(rows, t, "table_id"), c, "cell_id")
    own = F.col("cell_id").isNull()
    return rows.withColumn("source_line_start", F.when(own, F.col("_ts")).otherwise(F.col("_cs"))).withColumn("source_line_end", F.when(own, F.col("_te")).otherwise(F.col("_ce"))).drop("_ts", "_te", "_cs", "_ce")


def reference_violations(issues: DataFrame, documents: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: issues without their document, and with a table or cell id that is nowhere."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    lost = count(issues.join(documents, "doc_id", "left_anti"), "documents")
    lost = lost.crossJoin(count(issues.where("table_id IS NOT NULL").join(tables, "table_id", "left_anti"), "tables"))
    return lost.crossJoin(count(issues.where("cell_id IS NOT NULL").join(cells, "cell_id", "left_anti"), "cells"))


def with_sample_keys(rows: DataFrame, fingerprint: str, seed: str = SEED) -> DataFrame:
    """Adds sample_id, stratum_key and selection_rank."""
    c = F.col
    empty = lambda name: F.coalesce(c(name).cast("string"), F.lit(""))
    rows = rows.withColumn("release_fingerprint", F.lit(fingerprint)).withColumn("sample_id", ids.sample_id(c("release_fingerprint"), c("issue_code"), c("doc_id"), c("table_id"), c("cell_id"), c("field"), c("raw_value")))
    stratum = F.concat_ws("|", "issue_code", "company_code", empty("report_year"), empty("statement_type"), F.lower(F.trim(empty("raw_value"))))
    return rows.withColumn("stratum_key", stratum).withColumn("selection_rank", ids.selection_rank(seed, c("sample_id")))


def stratified(rows: DataFrame, per_stratum: int = PER_STRATUM, limits: dict[str, int] | None = None) -> DataFrame:
    """At most ``per_stratum`` rows of each stratum, then at most a code's limit, in order of rank.

    Row numbers with a bound become group limits that run before the shuffle, so a stratum of any
    size sends a few rows from each task.
    """
    limits = LIMITS if limits is None else limits
    order = ("selection_rank", "sample_id")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("issue_code", "stratum_key").orderBy(*order))).where(F.col("_n") <= per_stratum)
    if limits:
        has_limit = F.col("issue_code").isin(*limits)
        most = F.lit(0)
        for code, limit in limits.items():
            most = F.when(F.col("issue_code") == code, F.lit(limit)).otherwise(most)
        capped = rows.where(has_limit).withColumn("_n", F.row_number().over(Window.partitionBy("issue_code").orderBy(*order)))
        # The largest limit, as a constant, is what tasks can apply before the shuffle.
        rows = capped.where((F.col("_n") <= max(limits.values())) & (F.col("_n") <= most)).unionByName(rows.where(~has_limit))
    return rows.drop("_n").orderBy("issue_code", *order)


def sample_rows(issues: DataFrame, documents: DataFrame, tables: DataFrame, cells: DataFrame, fingerprint: str, seed: str = SEED, per_stratum: int = PER_STRATUM, limits: dict[str, int] | None = None) -> DataFrame:
    """The stratified sample with its context.

    Keys and ranks need only the document's company and year and the table's statement, so rows are
    chosen on narrow columns; texts of tables and cells join the few rows that are left.
    """
    narrow = issues.withColumnRenamed("code", "issue_code").join(documents.select("doc_id", "company_code", "report_year"), "doc_id").join(tables.select("table_id", "statement_type"), "table_id", "left")
    # Rows that repeat, or whose cell does, only push others out; so all that stay are among these, and are chosen again with every repetition.
    near = stratified(with_sample_keys(narrow, fingerprint, seed), per_stratum, limits).select("sample_id").distinct()
    named = ids.sample_id(F.lit(fingerprint), *[F.col(c) for c in ("code", "doc_id", "table_id", "cell_id", "field", "raw_value")])
    chosen = issues.withColumn("sample_id", named).join(near, "sample_id", "left_semi").drop("sample_id")
    return stratified(with_sample_keys(issue_context(chosen, documents, tables, cells), fingerprint, seed), per_stratum, limits)


def build_sample(release: dict[str, DataFrame], fingerprint: str, seed: str = SEED, per_stratum: int = PER_STRATUM, limits: dict[str, int] | None = None) -> DataFrame:
    return sample_rows(release["issues"], release["documents"], release["tables"], release["cells"], fingerprint, seed, per_stratum, limits)


def rate(n: Column, d: Column) -> Column:
    return F.when(d > 0, (n.cast("decimal(20,0)") / d.cast("decimal(20,0)")).cast(RATE))


def label_metrics(labelled: DataFrame, by_code: bool = True) -> DataFrame:
    """Counts, coverage, false-positive rate and causes of (issue_code, label, cause_code), by code or over all."""
    is_ = lambda v: F.count_if(F.coalesce(F.col("label"), F.lit("")) == v).cast("long")
    keys = ["issue_code"] if by_code else []
    out = labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), is_("true_issue").alias("true_issues"), is_("false_positive").alias("false_positives"), is_("uncertain").alias("uncertain"))
    conclusive = F.col("true_issues") + F.col("false_positives")
    out = out.withColumn("unlabeled", F.col("samples") - conclusive - F.col("uncertain")).withColumn("coverage", F.coalesce(rate(conclusive, F.col("samples")), F.lit(0).cast(RATE))).withColumn("false_positive_rate", rate(F.col("false_positives"), conclusive))
    if not by_code:
        return out
    causes = labelled.where("cause_code IS NOT NULL AND cause_code != ''").groupBy("issue_code", "cause_code").count()
    causes = causes.groupBy("issue_code").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "cause_code", "count"))), ";").alias("causes"))
    return out.join(causes, "issue_code", "left").withColumn("causes", F.coalesce("causes", F.lit("")))


def evaluate_labels(sample: DataFrame, labels: DataFrame) -> DataFrame:
    return label_metrics(sample.select("sample_id", "issue_code").join(labels.select("sample_id", "label", "cause_code"), "sample_id", "left"))


def _key(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("None"))


def still_present(sample: DataFrame, after_issues: DataFrame) -> DataFrame:
    """Adds ``present``: the issue is in the later release, by document, table, cell, field and code."""
    keys = {"k_doc": F.col("doc_id"), "k_table": _key("table_id"), "k_cell": _key("cell_id"), "k_field": F.col("field")}
    later = after_issues.select(*[c.alias(n) for n, c in keys.items()], F.col("code").alias("k_code")).distinct().withColumn("present", F.lit(True))
    rows = sample.withColumns(keys).withColumn("k_code", F.col("issue_code"))
    return rows.join(later, [*keys, "k_code"], "left").withColumn("present", F.coalesce("present", F.lit(False))).drop(*keys, "k_code")


def evaluate_after(sample: DataFrame, labels: DataFrame, after_issues: DataFrame, by_code: bool = True) -> DataFrame:
    """Label metrics where a false positive that is gone from the later release counts as a true issue."""
    rows = still_present(sample, after_issues).join(labels.select("sample_id", "label", "cause_code"), "sample_id", "left")
    fixed = F.when((F.col("label") == "false_positive") & ~F.col("present"), F.lit("true_issue")).otherwise(F.col("label"))
    return label_metrics(rows.withColumn("label", fixed), by_code)


def context_violations(sample: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: samples whose cell or table is missing or changed in a release."""
    c = cells.select("cell_id", *[F.col(n).alias(f"now_{n}") for n in CONTEXT_CELL], F.lit(True).alias("has_cell"))
    t = tables.select("table_id", F.col("title_raw").alias("now_table_title_raw"), F.col("unit_raw").alias("now_table_unit_raw"), F.lit(True).alias("has_table"))
    rows = sample.join(c, "cell_id", "left").join(t, "table_id", "left")
    changed = lambda names: ~F.forall(F.array(*[F.col(n).eqNullSafe(F.col(f"now_{n}")) for n in names]), lambda x: x)
    return rows.agg(
        F.count_if(F.col("cell_id").isNotNull() & (F.col("has_cell").isNull() | changed(CONTEXT_CELL))).alias("cells"),
        F.count_if(F.col("table_id").isNotNull() & (F.col("has_table").isNull() | changed(CONTEXT_TABLE))).alias("tables"),
    )


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Both tables have the same set of keys."""
    return a.select(key).join(b.select(key), key, "left_anti").isEmpty() and b.select(key).join(a.select(key), key, "left_anti").isEmpty()


def compare_releases(before: dict[str, DataFrame], after: dict[str, DataFrame], sample: DataFrame, labels: DataFrame) -> dict:
    """Counts and label metrics of two releases of the same tables; the driver gets one row for each code."""
    if not same_keys(before["tables"], after["tables"], "table_id"):
        raise ContractError("the releases hold different tables")
    for release in (before, after):
        if sum(context_violations(sample, release["tables"], release["cells"]).first()):
            raise ContractError("the sample's context is not the release's")
    out = {f"{name}_{kind}": r[kind].count() for name, r in (("before", before), ("after", after)) for kind in ("tables", "issues")}
    out["by_code"] = {r["issue_code"]: r.asDict() for r in evaluate_after(sample, labels, after["issues"]).collect()}
    out["overall"] = evaluate_after(sample, labels, after["issues"], by_code=False).first().asDict()
    return out


def quality_gate(comparison: dict, tables: int = TABLES_AFTER, coverage: float = MIN_COVERAGE, most_false: float = MAX_FALSE) -> list[str]:
    """What keeps a comparison from passing; empty if it passes."""
    why = [] if comparison["after_tables"] == tables else [f"{comparison['after_tables']} tables instead of {tables}"]
    if comparison["overall"]["coverage"] < coverage:
        why.append(f"coverage {comparison['overall']['coverage']}")
    for name, r in [("overall", comparison["overall"]), *sorted(comparison["by_code"].items())]:
        if r["false_positive_rate"] is not None and r["false_positive_rate"] > most_false:
            why.append(f"{name}: false positives {r['false_positive_rate']}")
    return why


def guard_sample(existing: DataFrame | None, fingerprint: str) -> None:
    """A sample of another release is not overwritten."""
    first = None if existing is None else existing.select("release_fingerprint").first()
    if first is not None and first[0] != fingerprint:
        raise ContractError("a sample of another release is there")


def markdown(title: str, rows: list[dict]) -> str:
    """A small report table."""
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join("" if r[n] is None else str(r[n]) for n in names) + " |" for r in rows]
    return f"# {title}\n\n" + "\n".join(lines) + "\n"


def comparison_report(result: dict, why: list[str]) -> str:
    """A comparison as Markdown: the verdict, counts before and after, and metrics of all samples and of each code."""
    counts = [{"count": kind, "before": result[f"before_{kind}"], "after": result[f"after_{kind}"], "change": result[f"after_{kind}"] - result[f"before_{kind}"]} for kind in ("tables", "issues")]
    verdict = "Passed." if not why else "Failed:\n\n" + "\n".join(f"* {w}" for w in why)
    parts = [f"# Comparison of two releases\n\n{verdict}\n", markdown("Counts", counts), markdown("All samples", [result["overall"]]), markdown("By issue code", [result["by_code"][c] for c in sorted(result["by_code"])])]
    return "\n".join([parts[0], *[p.replace("# ", "## ", 1) for p in parts[1:]]])
