"""From a corpus tree to a release: inventory, extraction, normalization, ledger, checks, Parquet and a manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.functions import ids
from finweave.operators.extraction import cells_of, extract_tables, placements_of, tables_of
from finweave.operators.ledger import duplicate_occurrences, note_violations, occurrence_violations, occurrences, orphans, repeated, stacked, status_counts, violations
from finweave.operators.normalization import ISSUE_FIELDS, issues_of, normalize_cells, normalize_tables
from finweave.errors import ContractError
from finweave.sources import store
from finweave.sources.files import build_inventory, read_verified
from finweave.sources.tables import ORDER, RELEASE, canonical_json, read_release, shaped, staged, table_fingerprint

RULESET = "1"


def extract_corpus(spark: SparkSession, root: str, documents: DataFrame) -> DataFrame:
    """The extraction of an inventory's ready documents, read where they are and checked against it."""
    return extract_tables(read_verified(spark, root, documents))


def build_tables(spark: SparkSession, root: str, inventory: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six tables of a release; what several of them need is written once."""
    documents = staged(inventory if inventory is not None else build_inventory(spark, root)[0], "inventory")
    _raise("inventory", note_violations(documents))
    ready = documents.where("inventory_status = 'ready'")
    extracted = staged(extract_corpus(spark, root, ready), "extracted")
    tables = staged(normalize_tables(tables_of(extracted), ready), "tables")
    cells = staged(normalize_cells(cells_of(extracted), tables), "cells")
    issues = issues_of(tables, cells)
    own = staged(occurrences(extracted, ready), "occurrences")
    fingerprint = F.sha2(F.concat_ws("|", F.lit(RULESET), "doc_id"), 256)
    return {
        "documents": shaped(ready.withColumns({"ruleset_version": F.lit(RULESET), "normalization_fingerprint": fingerprint}), "documents"),
        "tables": shaped(tables, "tables"),
        "cells": shaped(cells, "cells"),
        "placements": shaped(placements_of(extracted), "placements"),
        "issues": shaped(issues, "issues"),
        "source_table_occurrences": shaped(own.unionByName(duplicate_occurrences(own, documents)), "source_table_occurrences"),
    }


def release_violations(release: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) over a release: keys, references, ranges, grids, issue fields, the ledger."""
    d, t, c, p, i, o = (release[n] for n in RELEASE)
    grid = p.join(t.select("table_id", "row_count", "column_count"), "table_id", "left")
    of_field = F.create_map(*[F.lit(x) for pair in ISSUE_FIELDS.items() for x in pair])
    return stacked(
        repeated(d, "unique_documents", "doc_id"), repeated(t, "unique_tables", "table_id"), repeated(c, "unique_cells", "cell_id"), repeated(p, "unique_coordinates", "table_id", "row_idx", "col_idx"),
        orphans(t, d, "table_document", "doc_id"), orphans(c, t, "cell_table", "table_id"), orphans(p, t, "placement_table", "table_id"), orphans(p, c, "placement_cell", "cell_id"), orphans(c, p, "cell_placed", "cell_id"), orphans(i, d, "issue_document", "doc_id"),
        orphans(i.where("table_id IS NOT NULL"), t, "issue_table", "table_id"), orphans(i.where("cell_id IS NOT NULL"), c, "issue_cell", "cell_id"),
        violations(d, {"document_ids": ids.is_id(F.col("doc_id"), "doc_") & (F.col("doc_id") == ids.document_id(F.col("sha256"))), "years": F.col("report_year").between(1900, 2100), "paths": ~F.col("relative_path").rlike(r"(^/|\\|(^|/)\.\.?(/|$))")}),
        violations(t, {"table_ids": F.col("table_id") == ids.table_id(F.col("doc_id"), F.col("line_start"), F.col("line_end"), F.col("source_ordinal")), "table_lines": (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")), "table_shape": (F.col("row_count") > 0) & (F.col("column_count") > 0), "quality": F.col("quality_score").between(0, 1)}),
        violations(c, {"cell_ids": F.col("cell_id") == ids.cell_id(F.col("table_id"), F.col("row_idx"), F.col("col_idx")), "cell_values": F.col("value_raw").isNotNull(), "cell_lines": (F.col("source_line_start") >= 1) & (F.col("source_line_end") >= F.col("source_line_start"))}),
        violations(grid, {"grid_bounds": (F.col("row_idx") >= 0) & (F.col("col_idx") >= 0) & (F.col("row_idx") < F.col("row_count")) & (F.col("col_idx") < F.col("column_count"))}),
        violations(i, {"issue_fields": F.try_element_at(of_field, F.col("code")) == F.col("field")}),
        occurrence_violations(o),
    )


def _raise(what: str, rules: DataFrame) -> None:
    broken = rules.where("violations > 0").collect()
    if broken:
        raise ContractError(f"{what}: " + ", ".join(f"{r['rule']} {r['violations']}" for r in broken))


def check_release(release: dict[str, DataFrame]) -> None:
    _raise("release", release_violations(release))


def write_release(spark: SparkSession, release: dict[str, DataFrame], path: str, source_manifest_sha256: str = "") -> dict:
    """Writes all tables beside ``path``, checks what was written, adds the manifest, then puts it in its place.

    Tables are range-partitioned by their order and sorted within, so reading them in file order is
    reading them in order at any size.  An older release is moved aside before, and back on failure.
    """
    staging = f"{path.rstrip('/')}.staging"
    store.delete(spark, staging)
    try:
        for name, df in release.items():
            df.orderBy(*ORDER[name]).write.option("compression", "snappy").parquet(f"{staging}/{name}.parquet")
        written = read_release(spark, staging)
        check_release(written)
        prints = {name: table_fingerprint(df).first() for name, df in written.items()}
        manifest = {
            "schema_version": "2",
            "source_manifest_sha256": source_manifest_sha256,
            "dataset_fingerprint": dataset_fingerprint(prints),
            "counts": {name: r["n"] for name, r in prints.items()},
            "issue_counts_by_code": {r["code"]: r["n"] for r in issue_counts(written["issues"]).collect()},
            "source_table_occurrence_counts": {r["status"]: r["n"] for r in status_counts(written["source_table_occurrences"]).collect()},
        }
        store.write_bytes(spark, f"{staging}/manifest.json", canonical_json(manifest).encode() + b"\n")
        store.replace(spark, staging, path.rstrip("/"))
    finally:
        store.delete(spark, staging)
    return manifest


def dataset_fingerprint(prints: dict) -> str:
    """One digest of the tables' fingerprints."""
    return hashlib.sha256("|".join(f"{n}:{prints[n]['fingerprint']}" for n in sorted(prints)).encode()).hexdigest()


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code")


#: What a released document and the inventory must agree on.
DOCUMENT_FACTS = ("relative_path", "company_code", "report_year", "statement_scope", "sha256")


def document_differences(released: DataFrame, inventory: DataFrame) -> DataFrame:
    """doc_id and ``why`` (not_ready, not_released, different) of documents on which a release and an inventory's ready rows disagree."""
    side = lambda df, name: df.select("doc_id", F.struct(*DOCUMENT_FACTS).alias(name))
    both = side(released, "a").join(side(inventory.where("inventory_status = 'ready'"), "b"), "doc_id", "full_outer")
    why = F.when(F.col("b").isNull(), F.lit("not_ready")).when(F.col("a").isNull(), F.lit("not_released")).when(~F.col("a").eqNullSafe(F.col("b")), F.lit("different"))
    return both.select("doc_id", why.alias("why")).where("why IS NOT NULL")


def load_release(spark: SparkSession, path: str, verify: bool = True, inventory: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict]:
    """A checked release and its manifest: counts, fingerprint and every constraint, and the inventory's documents where given."""
    manifest = json.loads(store.read_bytes(spark, f"{path}/manifest.json"))
    release = read_release(spark, path)
    prints = {name: table_fingerprint(df).first() for name, df in release.items()} if verify else {}
    for name, r in prints.items():
        if r["n"] != manifest["counts"][name]:
            raise ContractError(f"release: {name} has not the manifest's count")
    if verify and dataset_fingerprint(prints) != manifest["dataset_fingerprint"]:
        raise ContractError("release: the tables are not those of the manifest's fingerprint")
    if verify:
        check_release(release)
    if inventory is not None and (odd := document_differences(release["documents"], inventory).limit(5).collect()):
        raise ContractError("release: documents differ from the inventory: " + ", ".join(f"{r['doc_id']} {r['why']}" for r in odd))
    return release, manifest
