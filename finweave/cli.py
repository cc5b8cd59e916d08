"""Command line: inventory, build, the audit's sample, baseline and compare, the pilot gate, and a smoke run.

Exit codes: 0 done; 1 a contract or gate failed; 2 inventory rejected files, or a gate's input is no input.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from finweave.errors import FinweaveError, GateError
from finweave.plans import audit, pilot, profile, release
from finweave.sources import files, store, tables


def session() -> SparkSession:
    return SparkSession.builder.appName("finweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def inventory(args: argparse.Namespace) -> int:
    documents, issues = files.build_inventory(session(), args.root, args.repo_id, args.revision)
    tables.write_manifest(documents, issues, args.out)
    counts = files.inventory_counts(documents, issues).first().asDict()
    print(json.dumps(counts, sort_keys=True))
    return 2 if counts["issues"] else 0


def build(args: argparse.Namespace) -> int:
    spark = session()
    documents = tables.read_manifest(spark, args.manifest)[0] if args.manifest else None
    source = store.sha256(spark, args.manifest) if args.manifest else ""
    manifest = release.write_release(spark, release.build_tables(spark, args.root, documents), args.out, source)
    print(json.dumps(manifest["counts"], sort_keys=True))
    return 0


def sample(args: argparse.Namespace) -> int:
    """Writes the stratified sample; a sample of another release is not overwritten."""
    spark = session()
    loaded, manifest = release.load_release(spark, args.release)
    path = spark._jvm.org.apache.hadoop.fs.Path(args.out)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    audit.guard_sample(spark.read.parquet(args.out) if there else None, manifest["dataset_fingerprint"])
    tables.staged(audit.build_sample(loaded, manifest["dataset_fingerprint"]), "sample").write.mode("overwrite").parquet(args.out)
    return 0


def baseline(args: argparse.Namespace) -> int:
    spark = session()
    rows = spark.read.parquet(args.sample)
    metrics = audit.evaluate_labels(rows, tables.read_labels(spark, args.labels, rows)).orderBy("issue_code").collect()
    store.write_bytes(spark, args.out, audit.markdown("False positives by issue code", [r.asDict() for r in metrics]).encode())
    return 0


def compare(args: argparse.Namespace) -> int:
    spark = session()
    rows = spark.read.parquet(args.sample)
    before, after = (release.load_release(spark, p)[0] for p in (args.before, args.after))
    result = audit.compare_releases(before, after, rows, tables.read_labels(spark, args.labels, rows))
    why = audit.quality_gate(result, tables=args.tables)
    store.write_bytes(spark, args.out, (json.dumps(result | {"failures": why, "passed": not why}, sort_keys=True, indent=2, default=str) + "\n").encode())
    if args.report:
        store.write_bytes(spark, args.report, audit.comparison_report(result, why).encode())
    for line in why:
        print(line, file=sys.stderr)
    return int(bool(why))


def smoke(args: argparse.Namespace) -> int:
    """Extracts a corpus, the first documents twice, and prints totals."""
    spark = session()
    documents, issues = files.build_inventory(spark, args.root)
    ready = tables.staged(documents.where("inventory_status = 'ready'"), "ready")
    first = tables.staged(release.extract_corpus(spark, args.root, ready), "extracted")
    repeated = ready.orderBy(files.F.lower("relative_path"), "relative_path").limit(args.repeat).select("doc_id")
    again = release.extract_corpus(spark, args.root, ready.join(repeated, "doc_id", "left_semi"))
    if odd := profile.nondeterministic(first.join(repeated, "doc_id", "left_semi"), again).take(5):
        print(f"not deterministic: {', '.join(r['doc_id'] for r in odd)}", file=sys.stderr)
        return 2
    counts = profile.extraction_totals(first).first().asDict() | {"discovered": documents.count() + issues.count(), "repeated": repeated.count()}
    print(json.dumps(counts, sort_keys=True))
    return 0


def prepare(args: argparse.Namespace) -> int:
    """Writes the pilot's annotation workspace."""
    spark = session()
    print(json.dumps(pilot.prepare(spark, *pilot.load(spark, args.manifest, args.release), args.annotations), sort_keys=True))
    return 0


def sample_cells(args: argparse.Namespace) -> int:
    """Writes the cells to audit beside the filled-in expected tables."""
    spark = session()
    pilot.sample_cells(spark, *pilot.load(spark, args.manifest, args.release), args.corpus, args.annotations)
    return 0


def evaluate(args: argparse.Namespace) -> int:
    """Evaluates the pilot and publishes the result."""
    spark = session()
    result = pilot.evaluate(spark, *pilot.load(spark, args.manifest, args.release), args.corpus, args.annotations)
    pilot.publish(spark, result, args.out)
    print("passed" if result["passed"] else "failed")
    return int(not result["passed"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="finweave", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(run, *names: str, within=commands, **defaults: str | int) -> None:
        p = within.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        for name in names:
            p.add_argument(f"--{name}", required=True)
        for name, value in defaults.items():
            p.add_argument(f"--{name.replace('_', '-')}", default=value, type=type(value) if value is not None else str)
        p.set_defaults(run=run)

    command(inventory, "root", "out", repo_id="local", revision="snapshot")
    command(build, "root", "out", manifest=None)
    command(sample, "release", "out")
    command(baseline, "sample", "out", labels=None)
    command(compare, "before", "after", "sample", "out", labels=None, report=None, tables=audit.TABLES_AFTER)
    command(smoke, "root", repeat=10)
    steps = commands.add_parser("gate", help="The pilot gate.").add_subparsers(required=True)
    command(prepare, "manifest", "release", "annotations", within=steps)
    command(sample_cells, "manifest", "release", "corpus", "annotations", within=steps)
    command(evaluate, "manifest", "release", "corpus", "annotations", "out", within=steps)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except FinweaveError as error:
        print(error, file=sys.stderr)
        return 2 if isinstance(error, GateError) else 1


if __name__ == "__main__":
    sys.exit(main())
