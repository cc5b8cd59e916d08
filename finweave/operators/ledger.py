"""The ledger of table occurrences in the sources: canonical, rejected, or a duplicate of another file's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.functions import ids
from finweave.operators.extraction import spots_of, tables_of
from finweave.operators.matching import containing_table

#: What the ledger reads of an extraction.
PARTS = ("candidate", "rejected", "table")
STATUSES = ("canonical", "rejected", "duplicate")
COLUMNS = ("source_table_id", "doc_id", "relative_path", "source_sha256", "ordinal", "line_start", "line_end", "status", "canonical_table_id", "rejection_code", "duplicate_of_relative_path")


def occurrences(extracted: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each HTML table region of the ready documents.

    Every detected region is either rejected, under the same ordinal and lines, or lies in exactly one table.
    """
    candidates = spots_of(extracted, "candidates").where("kind = 'html'").drop("reason", "kind")
    rejected = spots_of(extracted, "rejected").where("kind = 'html'").select("doc_id", "ordinal", "line_start", "line_end", F.col("reason").alias("rejection_code"))
    every = candidates.unionByName(rejected.drop("rejection_code")).distinct()
    judged = every.join(rejected, ["doc_id", "ordinal", "line_start", "line_end"], "left")
    found = containing_table(judged.where("rejection_code IS NULL"), tables_of(extracted)).select("doc_id", "ordinal", "canonical_table_id")
    rows = judged.join(found, ["doc_id", "ordinal"], "left").join(documents.select("doc_id", "relative_path", F.col("sha256").alias("source_sha256")), "doc_id")
    rows = rows.withColumn("status", F.when(F.col("rejection_code").isNotNull(), "rejected").otherwise("canonical")).withColumn("duplicate_of_relative_path", F.lit(None).cast("string"))
    return _with_id(rows)


def _with_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("source_table_id", ids.occurrence_id(*[F.col(c) for c in ("relative_path", "source_sha256", "ordinal", "line_start", "line_end")])).select(*COLUMNS)


def duplicate_occurrences(primary: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of each duplicate file: its primary's regions under its own path."""
    copies = documents.where("inventory_status = 'duplicate'").select(F.col("relative_path").alias("copy_path"), "sha256", F.regexp_extract(F.get("notes", F.lit(0)), "^duplicate_of=(.+)$", 1).alias("of_path"))
    both = primary.join(copies, (primary["relative_path"] == copies["of_path"]) & (primary["source_sha256"] == copies["sha256"]))
    rows = both.select("doc_id", F.col("copy_path").alias("relative_path"), "source_sha256", "ordinal", "line_start", "line_end", F.lit("duplicate").alias("status"), "canonical_table_id", F.lit(None).cast("string").alias("rejection_code"), F.col("of_path").alias("duplicate_of_relative_path"))
    return _with_id(rows)


def note_violations(documents: DataFrame) -> DataFrame:
    """(rule, violations): a duplicate has exactly one note, that names the file it repeats; others name none."""
    names = F.filter(F.coalesce("notes", F.array().cast("array<string>")), lambda x: x.startswith("duplicate_of="))
    is_copy = F.col("inventory_status") == "duplicate"
    rules = {"duplicate_note": ~is_copy | ((F.size("notes") == 1) & (F.size(names) == 1) & (F.length(F.get(names, F.lit(0))) > len("duplicate_of="))), "note_of_others": is_copy | (F.size(names) == 0)}
    return violations(documents, rules)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows that break each rule, in one pass."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")).select("r.*")


def repeated(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    """(rule, violations): keys that stand more than once."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))


def orphans(child: DataFrame, parent: DataFrame, rule: str, *keys: str) -> DataFrame:
    """(rule, violations): child rows whose keys no parent has; null keys count."""
    return child.join(parent.select(*keys), list(keys), "left_anti").agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))


def stacked(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def occurrence_violations(rows: DataFrame) -> DataFrame:
    """Invariants of the ledger."""
    none = lambda c: F.col(c).isNull()
    shape = {
        "canonical": ~none("canonical_table_id") & none("rejection_code") & none("duplicate_of_relative_path"),
        "rejected": none("canonical_table_id") & ~none("rejection_code") & none("duplicate_of_relative_path"),
        "duplicate": ~none("duplicate_of_relative_path"),
    }
    rules = {"known_status": F.col("status").isin(*STATUSES)} | {f"{s}_shape": (F.col("status") != s) | c for s, c in shape.items()}
    return stacked(violations(rows, rules), repeated(rows, "unique_id", "source_table_id"))


def status_counts(rows: DataFrame) -> DataFrame:
    """(status, n) of all three statuses, zeros too."""
    one = rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES])).alias("r")).select("r.*")
