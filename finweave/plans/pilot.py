"""The pilot gate end to end: the annotation workspace, the sample of cells to audit, the evaluation and its artifacts.

Selections and metrics run over the whole release; what people fill in (three small files) and what is
published (three more) is bounded by the pilot's documents, so their rows may come to the driver.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.errors import ContractError, GateError
from finweave.functions import ids
from finweave.operators import ledger, matching
from finweave.plans import gate
from finweave.sources import files, store
from finweave.sources.tables import canonical_json, read_strict_csv, staged, write_strict_csv

SCHEMA_VERSION = "1"
#: The columns of the pilot's files.
PILOT_DOCUMENT = ("annotation_schema_version", "dataset_fingerprint", "source_manifest_sha256", "doc_id", "relative_path", "company_code", "report_year", "statement_scope")
EXPECTED_TABLE = ("annotation_schema_version", "annotation_id", "doc_id", "relative_path", "statement_type", "line_start", "line_end", "row_count", "column_count", "unit_normalized", "expected_periods", "notes")
CELL_AUDIT = (
    "annotation_schema_version", "sampling_version", "cell_id", "doc_id", "relative_path", "company_code", "report_year", "annotation_id", "statement_type", "table_id", "row_idx", "col_idx", "row_label_raw",
    "column_label_raw", "value_raw", "value_numeric", "period", "unit", "source_line_start", "source_line_end", "source_excerpt", "verified", "review_notes",
)
PARETO = ("rank", "code", "count", "share", "cumulative_share")
ARTIFACTS = ("gate-report.md", "gate-result.json", "pareto-errors.csv")
#: Line ends of any kind.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
MOST_EXCERPT = 500


def _sha(spark: SparkSession, path: str) -> str:
    return hashlib.sha256(store.read_bytes(spark, path)).hexdigest()


def prepare(spark: SparkSession, release: dict[str, DataFrame], manifest: dict, folder: str, companies: int = gate.COMPANIES, per_company: int = gate.PER_COMPANY) -> dict:
    """Writes the picked documents, an empty table of expected tables and the metadata to a new folder, all or nothing."""
    if store.names(spark, folder):
        raise GateError(f"{folder} is not empty")
    with_tables = release["documents"].where("inventory_status = 'ready'").join(release["tables"].select("doc_id").distinct(), "doc_id", "left_semi")
    picked = gate.pick_documents(with_tables, companies, per_company)
    if picked.select("company_code").distinct().count() < companies:
        raise GateError(f"fewer than {companies} companies have {per_company} documents with tables")
    facts = {"annotation_schema_version": SCHEMA_VERSION, "dataset_fingerprint": manifest["dataset_fingerprint"], "source_manifest_sha256": manifest["source_manifest_sha256"]}
    picked = picked.withColumns({name: F.lit(value) for name, value in facts.items()}).orderBy("company_code", "report_year", "statement_scope", "doc_id")
    staging = f"{folder.rstrip('/')}.prepare"
    store.delete(spark, staging)
    try:
        write_strict_csv(f"{staging}/pilot-documents.csv", PILOT_DOCUMENT, picked)
        store.write_bytes(spark, f"{staging}/expected-tables.csv", (",".join(EXPECTED_TABLE) + "\n").encode())
        counts = picked.agg(F.count(F.lit(1)).alias("document_count"), F.count_distinct("company_code").alias("company_count")).first().asDict()
        metadata = facts | counts | {"sampling_version": ids.PILOT_VERSION, "pilot_documents_sha256": _sha(spark, f"{staging}/pilot-documents.csv")}
        store.write_bytes(spark, f"{staging}/pilot-metadata.json", canonical_json(metadata).encode() + b"\n")
        store.replace(spark, staging, folder.rstrip("/"))
    finally:
        store.delete(spark, staging)
    return metadata


def read_pilot(spark: SparkSession, manifest: dict, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, expected tables) of a workspace that belongs to the release and holds to its rules."""
    for name in ("pilot-metadata.json", "pilot-documents.csv", "expected-tables.csv"):
        if not store.exists(spark, f"{folder}/{name}"):
            raise GateError(f"{folder}/{name} is missing")
    metadata = json.loads(store.read_bytes(spark, f"{folder}/pilot-metadata.json"))
    want = {"sampling_version": ids.PILOT_VERSION, "annotation_schema_version": SCHEMA_VERSION, "dataset_fingerprint": manifest["dataset_fingerprint"], "source_manifest_sha256": manifest["source_manifest_sha256"], "pilot_documents_sha256": _sha(spark, f"{folder}/pilot-documents.csv")}
    odd = sorted(name for name, value in want.items() if metadata.get(name) != value)
    if odd:
        raise GateError(f"{folder}: {', '.join(odd)} not as in the metadata")
    documents = read_strict_csv(spark, f"{folder}/pilot-documents.csv", PILOT_DOCUMENT).withColumn("report_year", F.col("report_year").cast("int"))
    expected = read_strict_csv(spark, f"{folder}/expected-tables.csv", EXPECTED_TABLE)
    whole = {c: F.col(c).try_cast("int") for c in ("line_start", "line_end", "row_count", "column_count")}
    periods = F.filter(F.transform(F.split(F.coalesce("expected_periods", F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")
    expected = expected.withColumns(whole | {"expected_periods": periods})
    broken = annotation_violations(expected, documents).where("violations > 0").collect()
    if broken:
        raise GateError("expected tables: " + ", ".join(f"{r['rule']} {r['violations']}" for r in broken))
    return documents, expected


def annotation_violations(expected: DataFrame, documents: DataFrame) -> DataFrame:
    """(rule, violations) of expected tables: identity, statement, lines, shape, documents of the pilot."""
    c = F.col
    rules = {
        "schema_version": c("annotation_schema_version") == SCHEMA_VERSION,
        "annotation_id": c("annotation_id") == ids.annotation_id(c("doc_id"), c("line_start"), c("line_end"), c("statement_type")),
        "statement_type": c("statement_type").isin(*gate.STATEMENTS),
        "lines": (c("line_start") >= 1) & (c("line_end") >= c("line_start")),
        "shape": (c("row_count") >= 1) & (c("column_count") >= 1),
    }
    return ledger.stacked(ledger.violations(expected, rules), ledger.repeated(expected, "unique_annotations", "annotation_id"), ledger.orphans(expected, documents, "pilot_document", "doc_id"))


def document_lines(spark: SparkSession, corpus: str, documents: DataFrame) -> DataFrame:
    """(doc_id, lines) of the documents' files as they are now; bytes that are no text read as replacement characters."""
    wanted = documents.select("doc_id", "relative_path")
    if files.opens(corpus):
        # The listed paths alone are read.
        rows = files.read_listed(files.list_files(spark, corpus).join(wanted, "relative_path").select("path", "doc_id"), "doc_id")
        content = F.when(F.col("read_issue").isNull(), F.col("content")).otherwise(F.raise_error(F.concat_ws(" ", "path", "read_issue")).cast("binary"))
    else:
        rows, content = files.scan_files(spark, corpus).join(wanted, "relative_path"), F.col("content")
    text = F.make_valid_utf8(content.cast("string"))
    return rows.select("doc_id", F.split(F.regexp_replace(text, f"(?:{LINE_END})$", ""), LINE_END, -1).alias("lines"))


def cell_audits(assessed: DataFrame, release: dict[str, DataFrame], documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Every cell of the matched tables with its annotation, excerpt and automatic verdict."""
    matched = assessed.where("table_id IS NOT NULL").select("annotation_id", "statement_type", "table_id")
    of_table = release["tables"].select("table_id", "doc_id", "line_start", "line_end")
    rows = release["cells"].join(matched, "table_id").join(of_table, "table_id").join(documents.select("doc_id", "relative_path", "company_code", "report_year"), "doc_id")
    rows = gate.cell_provenance(rows, lines)
    blank = {c: F.coalesce(c, F.lit("")) for c in ("row_label_raw", "column_label_raw", "period", "unit")}
    return rows.withColumns(blank | {"annotation_schema_version": F.lit(SCHEMA_VERSION), "sampling_version": F.lit(ids.PILOT_VERSION), "value_numeric": F.col("value_numeric").cast("double"), "source_excerpt": F.coalesce("source_excerpt", F.lit("")), "review_notes": F.lit("")})


def assess(spark: SparkSession, release: dict[str, DataFrame], corpus: str, documents: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assessed annotations, audits of all cells of their tables), written once for the steps that follow."""
    tables = release["tables"].join(documents.select("doc_id"), "doc_id", "left_semi")
    assessed = staged(matching.assess_matching(expected, tables), "assessed")
    audits = staged(cell_audits(assessed, release, documents, document_lines(spark, corpus, documents)), "audits")
    return assessed, audits


def audit_sample(audits: DataFrame) -> DataFrame:
    """The cells that a person looks at, with cut excerpts and nothing filled in."""
    picked = gate.pick_cells(audits)
    cut = F.when(F.length("source_excerpt") > MOST_EXCERPT, F.concat(F.substring("source_excerpt", 1, MOST_EXCERPT - 3), F.lit("..."))).otherwise(F.col("source_excerpt"))
    return picked.withColumns({"source_excerpt": cut, "verified": F.lit("")}).select(*CELL_AUDIT).orderBy("annotation_id", "row_idx", "col_idx", "cell_id")


def sample_cells(spark: SparkSession, release: dict[str, DataFrame], manifest: dict, corpus: str, folder: str) -> DataFrame:
    """Writes the sample of cells to audit; an audit that is there is not overwritten."""
    if store.exists(spark, f"{folder}/cell-audit.csv"):
        raise GateError(f"{folder}/cell-audit.csv exists")
    documents, expected = read_pilot(spark, manifest, folder)
    if expected.isEmpty():
        raise GateError("no expected tables")
    sample = staged(audit_sample(assess(spark, release, corpus, documents, expected)[1]), "audit-sample")
    if (n := sample.count()) < gate.AUDIT_CELLS:
        raise GateError(f"{n} cells to audit, {gate.AUDIT_CELLS} needed")
    write_strict_csv(f"{folder}/cell-audit.csv", CELL_AUDIT, sample.orderBy("annotation_id", "row_idx", "col_idx", "cell_id"))
    return sample


def read_audit(spark: SparkSession, sample: DataFrame, folder: str) -> DataFrame:
    """The filled-in audit: exactly the sample's cells, nothing changed but the verdict and the notes."""
    if not store.exists(spark, f"{folder}/cell-audit.csv"):
        raise GateError(f"{folder}/cell-audit.csv is missing")
    given = read_strict_csv(spark, f"{folder}/cell-audit.csv", CELL_AUDIT)
    fixed = tuple(c for c in CELL_AUDIT if c not in ("verified", "review_notes", "cell_id"))
    found = gate.audit_changes(sample, given, fixed).first().asDict() | {"repeated": given.groupBy("cell_id").count().where("count > 1").count()}
    if any(found.values()):
        raise GateError("cell audit: " + ", ".join(f"{k} {v}" for k, v in found.items() if v))
    return given.withColumn("verified", F.trim("verified") == "true")


def evaluate(spark: SparkSession, release: dict[str, DataFrame], manifest: dict, corpus: str, folder: str) -> dict:
    """The gate's result: checks, metrics, shares of failures, and digests of all that it was told."""
    documents, expected = read_pilot(spark, manifest, folder)
    assessed, audits = assess(spark, release, corpus, documents, expected)
    given = read_audit(spark, audit_sample(audits), folder)
    final = staged(gate.table_usability(assessed, release["tables"], audits).join(documents.select("doc_id", "company_code", "report_year"), "doc_id"), "usability")
    counted = final.agg(F.count(F.lit(1)).alias("expected"), F.count("table_id").alias("matched"), F.count_if("usable").alias("usable")).first()
    cells = audits.agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("valid")).first()
    audited = given.agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("verified")).first()
    by_statement = {r["statement_type"]: {f"{k}_count": r[k] for k in ("expected", "matched", "usable")} for r in gate.statement_metrics(final).collect()}
    strata = gate.stratum_metrics(final).orderBy("company_code", "report_year", "statement_type").collect()
    n_documents, fewest = documents.count(), min(m["expected_count"] for m in by_statement.values())
    included = [r for r in strata if r["included"]]
    numbers = {
        "pilot_document_count": (n_documents, gate.LEAST["documents"], 100), "statement_type_coverage": (fewest, gate.LEAST["per_statement"], 100), "overall_table_usability": (counted["usable"], counted["expected"], gate.LEAST["usable"]),
        "accepted_cell_provenance": (cells["valid"], cells["n"], 100), "manual_cell_audit": (audited["verified"], gate.AUDIT_CELLS, 100), "eligible_strata_usability": (sum(r["passed"] for r in included), len(included), gate.LEAST["stratum"]),
    }
    lit = lambda *values: [F.lit(v).cast("long") for v in values]
    verified = audited["verified"] if audited["n"] == gate.AUDIT_CELLS else -1
    verdicts = gate.gate_checks(*lit(n_documents, fewest, counted["usable"], counted["expected"], cells["valid"], cells["n"], verified, len(included), numbers["eligible_strata_usability"][0]))
    passed = spark.range(1).select(*[c.alias(k) for k, c in verdicts.items()]).first()
    checks = [{"name": name, "passed": bool(ok), "numerator": a, "denominator": b, "threshold_percent": t} for (name, (a, b, t)), ok in zip(numbers.items(), passed)]
    pareto = gate.pareto(final.select(F.explode("failures").alias("code"))).orderBy(F.col("count").desc(), "code").collect()
    digests = {f"{name.replace('-', '_')}_sha256": _sha(spark, f"{folder}/{name}.csv") for name in ("pilot-documents", "expected-tables", "cell-audit")}
    inputs = sorted([*digests.values(), manifest["dataset_fingerprint"], manifest["source_manifest_sha256"]])
    return {
        "sampling_version": ids.PILOT_VERSION, "annotation_schema_version": SCHEMA_VERSION, "dataset_fingerprint": manifest["dataset_fingerprint"], "source_manifest_sha256": manifest["source_manifest_sha256"], **digests,
        "evaluation_inputs_sha256": hashlib.sha256("\n".join(inputs).encode()).hexdigest(), "document_count": n_documents, "annotated_table_count": counted["expected"], "matched_table_count": counted["matched"], "usable_table_count": counted["usable"],
        "checks": checks, "statement_metrics": by_statement,
        "stratum_metrics": {f"{r['company_code']}:{r['report_year']}:{r['statement_type']}": {"annotated_count": r["n"], "usable_count": r["usable"], "included": r["included"], "passed": r["passed"] if r["included"] else None} for r in strata},
        "pareto_rows": [{"rank": k, **{c: r[c] for c in PARETO[1:]}} for k, r in enumerate(pareto, start=1)], "passed": all(c["passed"] for c in checks),
    }


def report(result: dict) -> str:
    """The result as Markdown."""
    table = lambda head, rows: [f"| {' | '.join(head)} |", f"|{' --- |' * len(head)}", *[f"| {' | '.join(map(str, r))} |" for r in rows]]
    counts = [f"* {label}: {result[key]}" for label, key in (("Sampling", "sampling_version"), ("Pilot documents", "document_count"), ("Annotated tables", "annotated_table_count"), ("Matched tables", "matched_table_count"), ("Usable tables", "usable_table_count"))]
    checks = table(("Check", "Value", "Threshold", "Status"), [(c["name"], f"{c['numerator']}/{c['denominator']}", f">= {c['threshold_percent']}%", "pass" if c["passed"] else "fail") for c in result["checks"]])
    pareto = table([c.replace("_", " ") for c in PARETO], [[r[c] for c in PARETO] for r in result["pareto_rows"]]) if result["pareto_rows"] else ["No failures."]
    facts = [f"* {k}: `{result[k]}`" for k in ("dataset_fingerprint", "source_manifest_sha256", "evaluation_inputs_sha256")]
    return "\n".join(["# Pilot gate", "", f"Status: {'PASSED' if result['passed'] else 'FAILED'}", "", *counts, "", "## Checks", "", *checks, "", "## Failures", "", *pareto, "", "## Inputs", "", *facts, ""])


def publish(spark: SparkSession, result: dict, folder: str) -> None:
    """Writes the three artifacts; a folder with anything else in it is left alone."""
    others = [n for n in store.names(spark, folder) if n not in ARTIFACTS]
    if others:
        raise GateError(f"{folder} holds {', '.join(others)}")
    rows = io.StringIO()
    writer = csv.DictWriter(rows, PARETO, lineterminator="\n")
    writer.writeheader()
    writer.writerows(result["pareto_rows"])
    for name, text in (("gate-result.json", canonical_json(result) + "\n"), ("pareto-errors.csv", rows.getvalue()), ("gate-report.md", report(result))):
        store.write_bytes(spark, f"{folder}/{name}", text.encode())


def load(spark: SparkSession, inventory: str, release: str) -> tuple[dict[str, DataFrame], dict]:
    """A release that was built from an inventory file, checked against it."""
    from finweave.plans.release import load_release
    from finweave.sources.tables import read_manifest

    try:
        tables, manifest = load_release(spark, release, inventory=read_manifest(spark, inventory)[0])
    except ContractError as error:
        raise GateError(str(error)) from error
    if manifest["source_manifest_sha256"] != store.sha256(spark, inventory):
        raise GateError("the release was built from another inventory")
    return tables, manifest
