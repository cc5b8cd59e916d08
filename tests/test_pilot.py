"""The pilot gate, from a corpus to its artifacts, through the command line."""

import csv
import json

import pytest

from finweave import cli
from finweave.errors import GateError
from finweave.plans import pilot
from finweave.sources import tables

TITLES = {"income_statement": "Báo cáo kết quả hoạt động kinh doanh", "balance_sheet": "Bảng cân đối kế toán", "cash_flow_statement": "Báo cáo lưu chuyển tiền tệ"}
ROWS = ("Doanh thu thuần", "Tổng cộng tài sản", "Giá vốn hàng bán")


def report(company, year):
    out = ["Đơn vị tính: triệu đồng"]
    for k, title in enumerate(TITLES.values()):
        body = "".join(f"<tr><td>{label}</td><td>{company * 100 + year + k * 7 + i}</td></tr>\n" for i, label in enumerate(ROWS))
        out += [title, f"<table><tr><th>Chỉ tiêu</th><th>Năm {year}</th></tr>\n{body}</table>"]
    return "\n".join(out) + "\n"


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pilot")
    for company in range(21):
        for year in (2021, 2022, 2023) if company else (2021,):
            path = root / "corpus" / f"C{company:02}" / str(year) / "consolidated"
            path.mkdir(parents=True)
            (path / "a.txt").write_text(report(company, year), encoding="utf-8")
    at = {n: str(root / n) for n in ("corpus", "manifest.jsonl", "release", "annotations", "out")}
    assert cli.main(["inventory", "--root", at["corpus"], "--out", at["manifest.jsonl"]]) == 0
    assert cli.main(["build", "--root", at["corpus"], "--out", at["release"], "--manifest", at["manifest.jsonl"]]) == 0
    return at


def run(place, step, *more):
    return cli.main(["gate", step, "--manifest", place["manifest.jsonl"], "--release", place["release"], "--annotations", place["annotations"], *more])


def edit(path, change, newline="\n"):
    with open(path, encoding="utf-8", newline="") as f:
        rows = list(csv.DictReader(f))
        names = list(rows[0]) if rows else None
    change(rows)
    with open(path, "w", encoding="utf-8", newline="") as f:
        writer = csv.DictWriter(f, names, lineterminator=newline)
        writer.writeheader()
        writer.writerows(rows)


def test_gate_end_to_end(spark, place, capsys):
    corpus = ("--corpus", place["corpus"])
    evaluate = lambda: run(place, "evaluate", *corpus, "--out", place["out"])
    assert run(place, "prepare") == 0
    metadata = json.load(open(f"{place['annotations']}/pilot-metadata.json"))
    assert (metadata["document_count"], metadata["company_count"]) == (60, 20)
    assert run(place, "prepare") == 2  # not empty
    assert run(place, "sample-cells", *corpus) == 2  # nothing expected yet
    built = tables.read_release(spark, place["release"])
    path = {r["doc_id"]: r["relative_path"] for r in built["documents"].collect()}
    pilot_docs = {r["doc_id"] for r in csv.DictReader(open(f"{place['annotations']}/pilot-documents.csv", encoding="utf-8"))}
    annotated = [r for r in built["tables"].collect() if r["doc_id"] in pilot_docs]
    assert len(annotated) == 180
    made = spark.createDataFrame([("1", r["doc_id"], path[r["doc_id"]], r["statement_type"], r["line_start"], r["line_end"], r["row_count"], r["column_count"], r["unit_normalized"]) for r in annotated], "annotation_schema_version string, doc_id string, relative_path string, statement_type string, line_start int, line_end int, row_count int, column_count int, unit_normalized string")
    made = made.withColumn("annotation_id", pilot.ids.annotation_id(*[pilot.F.col(c) for c in ("doc_id", "line_start", "line_end", "statement_type")])).withColumn("expected_periods", pilot.F.lit("2021; 2022;2023")).withColumn("notes", pilot.F.lit("a, \"b\"\nc"))
    tables.write_strict_csv(f"{place['annotations']}/expected-tables.csv", pilot.EXPECTED_TABLE, made, allow_identical=True)
    assert run(place, "sample-cells", *corpus) == 0
    audit = f"{place['annotations']}/cell-audit.csv"
    assert run(place, "sample-cells", *corpus) == 2  # is there
    assert evaluate() == 2  # not filled in
    edit(audit, lambda rows: [r.update(verified="true") for r in rows])
    assert evaluate() == 0
    result = json.load(open(f"{place['out']}/gate-result.json"))
    assert result["passed"] and [c["name"] for c in result["checks"] if c["passed"]] == [c["name"] for c in result["checks"]]
    assert (result["annotated_table_count"], result["matched_table_count"], result["usable_table_count"]) == (180, 180, 180)
    assert "PASSED" in open(f"{place['out']}/gate-report.md").read()
    # One cell judged false: the gate fails, and its artifacts say why.
    edit(audit, lambda rows: rows[3].update(verified="false"))
    assert evaluate() == 1
    result = json.load(open(f"{place['out']}/gate-result.json"))
    assert [c["name"] for c in result["checks"] if not c["passed"]] == ["manual_cell_audit"]
    # Changed facts, other files, and other corpora are input errors.
    edit(audit, lambda rows: rows[3].update(verified="true", value_raw="9"))
    assert evaluate() == 2 and "changed 1" in capsys.readouterr().err
    open(f"{place['out']}/other.txt", "w").close()
    with pytest.raises(GateError):
        pilot.publish(spark, result, place["out"])


def test_gate_of_wrong_annotations(spark, place, tmp_path):
    """A shifted, a misnamed and a missing table fail under their codes."""
    built, manifest = pilot.load(spark, place["manifest.jsonl"], place["release"])
    documents = built["documents"].withColumn("report_year", pilot.F.col("report_year"))
    some = built["tables"].where("statement_type = 'balance_sheet'").orderBy("table_id").limit(6).collect()
    wrong = [{}, {"row_count": 9}, {"unit_normalized": "VND"}, {"line_start": 1, "line_end": 90}, {"line_start": 900, "line_end": 901}, {"expected_periods": ["1999"]}]
    rows = [{"annotation_id": f"a{i}", "expected_periods": ["2021", "2022", "2023"], **{c: r[c] for c in ("doc_id", "statement_type", "line_start", "line_end", "row_count", "column_count", "unit_normalized")}} | w for i, (r, w) in enumerate(zip(some, wrong))]
    expected = spark.createDataFrame(rows, "annotation_id string, doc_id string, statement_type string, line_start int, line_end int, row_count int, column_count int, unit_normalized string, expected_periods array<string>")
    assessed, audits = pilot.assess(spark, built, place["corpus"], documents, expected)
    final = pilot.gate.table_usability(assessed, built["tables"], audits)
    got = {r["annotation_id"]: sorted(r["failures"]) for r in final.collect()}
    # Lines that hold all three tables match one of them.
    assert "span_mismatch" in got.pop("a3")
    assert got == {"a0": [], "a1": ["shape_mismatch"], "a2": ["unit_mismatch"], "a4": ["missing_table"], "a5": ["period_mismatch"]}
    odd = pilot.annotation_violations(expected.withColumn("annotation_schema_version", pilot.F.lit("1")), documents).where("violations > 0").collect()
    assert {r["rule"]: r["violations"] for r in odd} == {"annotation_id": 6}


def test_release_is_checked_against_its_inventory(spark, place, tmp_path):
    other = tmp_path / "other.jsonl"
    lines = open(place["manifest.jsonl"], encoding="utf-8").read().splitlines()
    other.write_text("\n".join(lines[1:]) + "\n", encoding="utf-8")
    with pytest.raises(GateError, match="not_ready"):
        pilot.load(spark, str(other), place["release"])


def test_smoke(place, capsys):
    assert cli.main(["smoke", "--root", place["corpus"]]) == 0
    counts = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (counts["documents"], counts["tables"], counts["cells"], counts["rejections"], counts["html_free"]) == (61, 183, 183 * 8, 0, 0)
