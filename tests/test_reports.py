"""Extraction, release, audit and gate on small reports written here."""

import itertools
import json
import os
import pathlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from finweave import queries, streaming
from finweave.operators import extraction, matching, normalization
from finweave.plans import audit, gate, release
from finweave.sources import files, tables
from finweave.streaming import start_inventory

INCOME = """Đơn vị tính: triệu đồng
Báo cáo kết quả hoạt động kinh doanh
<table><tr><th>Chỉ tiêu</th><th>Mã số</th><th>Năm 2023</th></tr>
<tr><td>Doanh thu thuần</td><td>10</td><td>1.234,5</td></tr>
<tr><td>Something odd</td><td>11</td><td>1.2.3</td></tr></table>
===== PAGE 2 =====
Báo cáo kết quả hoạt động kinh doanh
<table><tr><th>Chỉ tiêu</th><th>Mã số</th><th>Năm 2023</th></tr>
<tr><td>Giá vốn hàng bán</td><td>12</td><td>(500)</td></tr></table>
"""
BALANCE = "ĐVT: tỷ đồng\nBảng cân đối kế toán\n<table><tr><td rowspan=2>Chỉ tiêu</td><td colspan=2>Số dư</td></tr><tr><td>31/12/2023</td><td>31/12/23</td></tr><tr><td>Tổng cộng tài sản</td><td>5%</td><td>7</td></tr></table>\n<table><tr><td>open"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for path, body in {
        "ABC/2023/Consolidated FS/a.txt": INCOME.encode(), "xyz/2023/fs separate/b.TXT": b"\xef\xbb\xbf" + BALANCE.encode(), "XYZ/2024/fs/copy.txt": INCOME.encode(),
        "XYZ/2024/fs/empty.txt": b"", "XYZ/1800/fs/old.txt": b"x", "XYZ/2024/fs/broken.txt": b"\xff\xfe\xfa", "bad.txt": b"x",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body)
    return str(root)


def test_inventory_and_manifest(spark, corpus, tmp_path):
    documents, issues = files.build_inventory(spark, corpus)
    got = {r["relative_path"]: r for r in documents.collect()}
    assert {p: r["inventory_status"] for p, r in got.items()} == {"ABC/2023/Consolidated FS/a.txt": "ready", "XYZ/2024/fs/copy.txt": "duplicate", "XYZ/2024/fs/empty.txt": "empty", "xyz/2023/fs separate/b.TXT": "ready"}
    assert got["XYZ/2024/fs/copy.txt"]["notes"] == ["duplicate_of=ABC/2023/Consolidated FS/a.txt"]
    assert got["xyz/2023/fs separate/b.TXT"]["encoding"] == "utf-8-sig" and got["xyz/2023/fs separate/b.TXT"]["company_code"] == "XYZ"
    assert {r["relative_path"]: r["reason"] for r in issues.collect()} == {"XYZ/1800/fs/old.txt": "invalid year", "XYZ/2024/fs/broken.txt": "invalid UTF-8", "bad.txt": "path must have four parts"}
    assert tuple(files.inventory_counts(documents, issues).first()) == (2, 1, 1, 3)
    path = str(tmp_path / "manifest.jsonl")
    tables.write_manifest(documents, issues, path)
    again, odd = tables.read_manifest(spark, path)
    assert sorted(r["doc_id"] for r in again.collect()) == sorted(r["doc_id"] for r in got.values()) and odd.count() == 3
    lines = open(path).read().splitlines()
    assert list(json.loads(lines[0])) == sorted(json.loads(lines[0]))
    with open(path, "a") as f:
        f.write(lines[0] + "\n")
    with pytest.raises(tables.ContractError):
        tables.read_manifest(spark, path)


@pytest.fixture(scope="module")
def written(spark, corpus, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("release") / "one")
    return out, release.write_release(spark, release.build_tables(spark, corpus), out)


def test_release_end_to_end(spark, corpus, written, tmp_path):
    out, manifest = written
    loaded, same = release.load_release(spark, out)
    assert same == manifest and manifest["counts"]["documents"] == 2 and manifest["counts"]["tables"] == 2
    assert manifest["source_table_occurrence_counts"] == {"canonical": 3, "rejected": 1, "duplicate": 2}
    table = loaded["tables"].where("statement_type = 'income_statement'").first()
    assert (table["row_count"], table["column_count"], table["unit_normalized"], table["line_start"]) == (4, 3, "VND_million", 3)
    cells = {(r["row_idx"], r["col_idx"]): r for r in loaded["cells"].where(F.col("table_id") == table["table_id"]).collect()}
    assert float(cells[1, 2]["value_numeric"]) == 1234.5 and cells[1, 2]["period"] == "2023" and cells[1, 2]["unit"] == "VND_million" and cells[1, 2]["row_label_canonical"] == "net_revenue"
    assert float(cells[3, 2]["value_numeric"]) == -500 and cells[1, 1]["value_numeric"] is None
    assert manifest["issue_counts_by_code"]["number_invalid"] == 1 and manifest["issue_counts_by_code"]["metric_unknown"] == 1
    spans = loaded["placements"].groupBy("cell_id").count().where("count = 2").count()
    assert spans == 2
    assert release.write_release(spark, release.build_tables(spark, corpus), str(tmp_path / "again"))["dataset_fingerprint"] == manifest["dataset_fingerprint"]
    broken = dict(loaded) | {"cells": loaded["cells"].limit(3)}
    assert release.release_violations(broken).where("violations > 0").count() > 0


def test_audit_of_a_release(spark, written):
    built = tables.read_release(spark, written[0])
    sample = tables.staged(audit.build_sample(built, "fp"), "sample")
    n = sample.count()
    assert n == built["issues"].count() and sample.columns.count("stratum_key") == 1
    labels = sample.select("sample_id", F.lit("false_positive").alias("label"), F.lit("other").alias("cause_code"), F.lit(None).cast("string").alias("reviewer_note"))
    assert tables.label_violations(labels, sample).where("violations > 0").count() == 0
    assert tables.label_violations(labels.withColumn("label", F.lit("no")), sample).where("rule = 'invalid_label'").first()["violations"] == n
    metrics = audit.evaluate_labels(sample, labels).collect()
    assert all(float(r["false_positive_rate"]) == 1 and r["causes"] == f"other={r['samples']}" for r in metrics)
    after = dict(built) | {"issues": built["issues"].limit(0)}
    result = audit.compare_releases(built, after, sample, labels)
    assert float(result["overall"]["false_positive_rate"]) == 0 and audit.quality_gate(result, tables=2) == []
    assert audit.quality_gate(result) == ["2 tables instead of 146011"]
    changed = dict(built) | {"cells": built["cells"].withColumn("value_raw", F.lit("x"))}
    with pytest.raises(tables.ContractError):
        audit.compare_releases(built, changed, sample, labels)


def test_provenance_and_usability(spark, corpus):
    documents = files.build_inventory(spark, corpus)[0].where("inventory_status = 'ready'")
    texts = files.read_verified(spark, corpus, documents)
    found = tables.staged(extraction.extract_tables(texts), "found")
    t = tables.staged(normalization.normalize_tables(extraction.tables_of(found), documents), "t")
    c = tables.staged(normalization.normalize_cells(extraction.cells_of(found), t), "c")
    context = c.join(t.select("table_id", "line_start", "line_end"), "table_id")
    lines = texts.select("doc_id", F.split("text", "\n").alias("lines"))
    audited = gate.cell_provenance(context, lines)
    assert audited.where("NOT verified").count() == 0 and audited.count() == c.count()
    wrong = gate.cell_provenance(context.withColumn("value_raw", F.lit("not there")), lines)
    assert wrong.where("verified").count() == 0
    expected = t.where("statement_type IS NOT NULL").select(F.concat(F.lit("ann_"), "table_id").alias("annotation_id"), "doc_id", "statement_type", "line_start", "line_end", "row_count", "column_count", "unit_normalized", F.array(F.lit("2023"), F.lit("2023-12-31")).alias("expected_periods"))
    assessed = matching.assess_matching(expected, t)
    usable = gate.table_usability(assessed, t, audited.join(assessed.select("annotation_id", "table_id"), "table_id")).collect()
    assert all(r["table_id"] is not None and "missing_table" not in r["failures"] and "invalid_provenance" not in r["failures"] for r in usable)


def test_assignment_is_global():
    pairs = [("a1", "t1", 0, 10, 10, 2), ("a1", "t2", 0, 9, 10, 3), ("a2", "t1", 0, 10, 10, 1), ("a3", "t9", 1, 5, 5, 0)]
    assert matching.best_assignment(pairs) == {"a1": "t2", "a2": "t1", "a3": "t9"}
    tie = [("a1", "t2", 0, 5, 5, 0), ("a1", "t1", 0, 5, 5, 0), ("a2", "t1", 0, 5, 5, 0), ("a2", "t2", 0, 5, 5, 0)]
    assert matching.best_assignment(tie) == {"a1": "t1", "a2": "t2"}


def brute_assignment(pairs):
    gain = {(a, t): (exact, Fraction(over, span), -dist) for a, t, exact, over, span, dist in pairs}
    rows, columns = sorted({a for a, _ in gain}), sorted({t for _, t in gain})
    best = None
    for chosen in itertools.product([*columns, None], repeat=len(rows)):
        used = [(a, t) for a, t in zip(rows, chosen) if t]
        if len({t for _, t in used}) < len(used) or any(u not in gain for u in used):
            continue
        total = tuple(sum(x) for x in zip((0, 0, 0), *(gain[u] for u in used)))
        key = (tuple(-x for x in total), [(t is None, t or "") for t in chosen])
        if best is None or key < best[0]:
            best = key, dict(used)
    return best[1]


def test_assignment_equals_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        pairs = [(f"a{i}", f"t{j}", rng.randint(0, 1), rng.randint(1, 3), 3, rng.randint(0, 2)) for i in range(n) for j in range(m) if rng.random() < 0.7]
        if pairs:
            assert matching.best_assignment(pairs) == brute_assignment(pairs)
    # One part of 40 annotations and 40 tables.
    large = [(f"a{i:02}", f"t{j:02}", int(i == j), 1, 1 + abs(i - j), abs(i - j)) for i in range(40) for j in range(40)]
    assert matching.best_assignment(large) == {f"a{i:02}": f"t{i:02}" for i in range(40)}


def test_assignment_query_takes_all_overlaps(spark, tmp_path):
    keys = [59, 101, 138, 179, 181, 189]
    spark.createDataFrame([(k, 1) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    pairs = matching.overlapping_pairs(queries.view(spark, str(tmp_path), "ann"), queries.view(spark, str(tmp_path), "tabs")).collect()
    want = brute_assignment([(r["annotation_id"], r["table_id"], r["exact"], r["overlap"], r["span"], r["distance"]) for r in pairs])
    assert any(a[4:] != t[4:] for a, t in want.items())
    got = queries.QUERIES["table_assignment"](spark, str(tmp_path)).collect()
    assert {r["annotation_id"]: r["table_id"] for r in got} == want


def _intervals(rng, n, lines, prefix):
    """Intervals of two documents: many short ones, some equal, a few that reach far."""
    rows = []
    for i in range(n):
        start = rng.randint(1, lines)
        rows.append((f"{prefix}{i:03}", rng.choice(["d1", "d1", "d2"]), start, start + rng.choice([0, 1, 3, 8, 8, 20, 300])))
    return rows


@pytest.mark.parametrize("lines,n", [(60, 12), (3000, 90), (40_000, 500)])
def test_interval_joins_in_bins(spark, monkeypatch, lines, n):
    """Overlaps equal a plain comparison, and parts found by Spark give the assignment of whole documents, over short and long documents."""
    monkeypatch.setattr(matching, "RUN", 512)
    rng = random.Random(lines)
    expected, found = _intervals(rng, n, lines, "a"), _intervals(rng, n, lines, "t")
    e = spark.createDataFrame([*expected, ("a-none", "d1", None, 5)], "annotation_id string, doc_id string, line_start int, line_end int")
    t = spark.createDataFrame([*found, ("t-none", "d1", 4, None)], "table_id string, doc_id string, line_start int, line_end int")
    pairs = tables.staged(matching.overlapping_pairs(e, t), "pairs")
    want = {(x[0], y[0]) for x in expected for y in found if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]}
    got = [(r["annotation_id"], r["table_id"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    whole, parts = ({(r["annotation_id"], r["table_id"]) for r in rows.collect()} for rows in (matching.assign_tables(pairs), matching.assign_tables(pairs, e)))
    assert whole == parts and parts
    # Pairs that share an annotation or a table are in one part.
    named = matching.assignment_parts(pairs, e).collect()
    for key in ("annotation_id", "table_id"):
        of = {}
        assert all(of.setdefault((r["doc_id"], r[key]), r["part"]) == r["part"] for r in named)
    assert len(named) == len(got) and (lines < 100 or len({(r["doc_id"], r["part"]) for r in named}) > 10)


@pytest.mark.parametrize(
    "html,reason",
    [("<table><tr><td rowspan=0>x</td></tr></table>", "invalid_span_value"), ("<table><tbody><tr><td>x</td></tr></tbody></table>", "unsupported_html_structure"), ("<table><tr><td><table></table></td></tr></table>", "nested_html_table"), ("<table></table>", "empty_extracted_table"), ("<table><tr><td>x", "unclosed_html_table"), ("<table><tr><td colspan=100001>x</td></tr></table>", "expansion_limit_exceeded"), ("<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2>c</td></tr></table>", "span_collision")],
)
def test_rejections(html, reason):
    good = "<table><tr><td>a</td><td>1</td></tr></table>"
    found = extraction.extract_text("d", f"{good}\n{html}")
    assert [r["reason"] for r in found["rejected"]] == [reason] and len(found["tables"]) == 1


def test_delimited_runs():
    text = "===== PAGE 1 =====\nDear all,\n- a  1\n- b  2\n- c  3\n\nChỉ tiêu\t2023\t2022\nA\t1\t2\nB\t3\t4\n"
    found = extraction.extract_text("d", text)
    assert [(t["row_count"], t["evidence"]) for t in found["tables"]] == [(3, ["consistent_columns", "financial_header", "numeric_density"])]
    assert extraction.extract_text("d", "a\t1\nb\t2\tx\nc\t3\n")["rejected"][0]["reason"] == "ragged_structured_rows"


def test_strict_csv(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    rows = spark.createDataFrame([("1", "a,b"), ("2", None)], "k string, v string")
    tables.write_strict_csv(path, ("k", "v"), rows)
    assert sorted(r["k"] for r in tables.read_strict_csv(spark, path, ("k", "v")).collect()) == ["1", "2"]
    with pytest.raises(tables.ContractError):
        tables.write_strict_csv(path, ("k", "v"), rows)
    with pytest.raises(tables.ContractError):
        tables.read_strict_csv(spark, path, ("v", "k"))
    (tmp_path / "y.csv").write_bytes(b"k,v\r\n1,2\r\n")
    with pytest.raises(tables.ContractError):
        tables.read_strict_csv(spark, str(tmp_path / "y.csv"), ("k", "v"))


def test_labels_that_another_program_saved(spark, tmp_path):
    sample = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    path = tmp_path / "labels.csv"
    path.write_bytes(b"\xef\xbb\xbfsample_id,label,cause_code,reviewer_note\r\ns1,uncertain,,\"a\r\nb\"\r\ns2,true_issue,,x")
    rows = {r["sample_id"]: r for r in tables.read_labels(spark, str(path), sample).collect()}
    assert rows["s1"]["label"] == "uncertain" and rows["s1"]["cause_code"] is None and rows["s2"]["label"] == "true_issue"
    assert tables.read_labels(spark, str(tmp_path / "none.csv"), sample).count() == 0
    path.write_text("sample_id,label,cause,reviewer_note\n")
    with pytest.raises(tables.ContractError):
        tables.read_labels(spark, str(path), sample)


def test_streaming_inventory(spark, corpus, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # a second run finds nothing new
        start_inventory(spark, corpus, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 6  # the empty file has no split


def _told(documents, issues):
    rows = [(r["relative_path"], r["inventory_status"], r["sha256"], tuple(r["notes"])) for r in documents.collect()]
    return sorted(rows + [(r["relative_path"], r["reason"], None, ()) for r in issues.collect()])


@pytest.mark.parametrize("backwards", [False, True])
def test_merged_streams_equal_the_batch_inventory(spark, corpus, tmp_path, monkeypatch, backwards):
    """Files arrive one by one in either order, over several runs, also one that changes; the log is written anew between."""
    monkeypatch.setattr(streaming, "MERGES", 3)
    root, manifest, state = tmp_path / "root", str(tmp_path / "manifest"), str(tmp_path / "state")
    source = pathlib.Path(corpus)
    paths = sorted((p.relative_to(source) for p in source.rglob("*") if p.is_file()), key=str, reverse=backwards)
    root.mkdir()
    for k, path in enumerate(paths):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes((source / path).read_bytes())
        if k % 3 == 2 or k == len(paths) - 1:
            streaming.update_inventory(spark, str(root), manifest, state, most=1)
            assert _told(*streaming.streamed_inventory(spark, manifest)) == _told(*files.build_inventory(spark, str(root)))
    # What it had as its content is another file's now.
    changed = root / "ABC/2023/Consolidated FS/a.txt"
    changed.write_bytes(b"something else")
    os.utime(changed, (2_000_000_000, 2_000_000_000))
    streaming.update_inventory(spark, str(root), manifest, state)
    told = _told(*streaming.streamed_inventory(spark, manifest))
    assert told == _told(*files.build_inventory(spark, str(root)))
    assert ("XYZ/2024/fs/copy.txt", "ready") in {t[:2] for t in told}
    streaming.compact(spark, manifest, 0)
    assert _told(*streaming.streamed_inventory(spark, manifest)) == told


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    manifest = str(tmp_path / "manifest")
    rows = spark.createDataFrame([("ABC/2023/fs/b.txt", 1, b"x", None), ("ABC/2023/fs/a.txt", 1, b"x", None)], "relative_path string, length long, content binary, modificationTime timestamp")
    for part in (rows.limit(1), rows, rows):
        streaming.merge_files(spark, part, manifest, f"s-{part.count()}")
    told = _told(*streaming.streamed_inventory(spark, manifest))
    assert [t[:2] for t in told] == [("ABC/2023/fs/a.txt", "ready"), ("ABC/2023/fs/b.txt", "duplicate")]


def test_listing_takes_odd_names_and_folders(spark, tmp_path):
    for name in ("A B/2023/é %41+/x y#.txt", "A B/2023/empty/z.TXT", "A B/other.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"abc")
    (tmp_path / "no files here").mkdir()
    rows = files.list_files(spark, str(tmp_path))
    assert {(r["relative_path"], r["length"]) for r in rows.collect()} == {("A B/2023/é %41+/x y#.txt", 3), ("A B/2023/empty/z.TXT", 0)}
    read = files.read_files(spark, str(tmp_path)).collect()
    assert {(r["relative_path"], bytes(r["content"])) for r in read} == {("A B/2023/é %41+/x y#.txt", b"abc"), ("A B/2023/empty/z.TXT", b"")}

def test_many_small_files_are_few_tasks(spark, tmp_path):
    """Listing, streams and verified reads send the driver no more for more files: tasks do not grow with their number."""
    root, manifest = tmp_path / "root", str(tmp_path / "manifest")
    for k in range(100):
        (root / f"S{k:03d}/2023/fs").mkdir(parents=True)
        (root / f"S{k:03d}/2023/fs/a.txt").write_bytes(b"" if k == 7 else f"text {k}".encode())
    documents = tables.staged(files.build_inventory(spark, str(root))[0], "documents")
    tracker = spark.sparkContext.statusTracker()

    def last_stage() -> int:
        group = str(tmp_path) + str(next(marks))
        spark.sparkContext.setJobGroup(group, group)
        spark.sparkContext.parallelize([0], 1).count()
        spark.sparkContext._jsc.clearJobGroup()
        return max(s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds)

    marks = itertools.count()
    first = last_stage()
    streaming.update_inventory(spark, str(root), manifest, str(tmp_path / "state"), most=100)
    assert files.read_verified(spark, str(root), documents).count() == 99
    sizes = [info.numTasks for i in range(first + 1, last_stage()) if (info := tracker.getStageInfo(i))]
    # A batch takes 16 parts of the log; a task for each folder or file would be 100 and more.
    assert sizes and max(sizes) <= 40
    assert _told(*streaming.streamed_inventory(spark, manifest)) == _told(*files.build_inventory(spark, str(root)))
    log = [spark.read.parquet(str(p)).count() for p in pathlib.Path(f"{manifest}/arrivals").glob("*.parquet")]
    assert sum(log) == 100 and sum(sorted(log)[-streaming.PARTS:]) <= 100


def test_plain_csv_files_are_shared_by_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "marked.csv").write_bytes(b"\xef\xbb\xbfk,v\n1,2\n")
    with pytest.raises(tables.ContractError):
        tables.read_strict_csv(spark, str(tmp_path / "marked.csv"), ("k", "v"))
    path = str(tmp_path / "long.csv")
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.concat(F.lit('a,"'), F.col("id").cast("string")).alias("v"))
    tables.write_strict_csv(path, ("k", "v"), rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = tables.read_strict_csv(spark, path, ("k", "v"))
        assert read.rdd.getNumPartitions() > 2
        assert read.count() == 20_000 and read.exceptAll(rows).isEmpty()
        # A field with a line end somewhere: the file is read whole and right.
        broken = rows.withColumn("v", F.when(F.col("k") == "15000", F.lit("x\ny")).otherwise(F.col("v")))
        tables.write_strict_csv(f"{path}2", ("k", "v"), broken)
        read = tables.read_strict_csv(spark, f"{path}2", ("k", "v"))
        assert read.count() == 20_000 and read.exceptAll(broken).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_issues_without_a_cell_are_dealt_out(spark):
    n = 4000
    issues = spark.range(n).select(F.lit("unit_unknown").alias("code"), F.lit("unit").alias("field"), F.lit("d").alias("doc_id"), F.col("id").cast("string").alias("table_id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("c"), "id")).alias("cell_id"), F.lit("x").alias("raw_value"))
    documents = spark.createDataFrame([("d", "A", 2023)], "doc_id string, company_code string, report_year int")
    shown = issues.select("table_id", F.lit(None).cast("string").alias("statement_type"), F.lit("t").alias("title_raw"), F.lit("u").alias("unit_raw"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    cells = issues.where("cell_id IS NOT NULL").select("cell_id", *[F.lit("v").alias(c) for c in audit.CONTEXT_CELL], F.lit(7).alias("source_line_start"), F.lit(8).alias("source_line_end"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = audit.issue_context(issues, documents, shown, cells).withColumn("part", F.spark_partition_id()).select("part", "source_line_start", "cell_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == n and all(r["source_line_start"] == (7 if r["cell_id"] else 1) for r in rows)
    assert max(sum(r["part"] == p for r in rows) for p in {r["part"] for r in rows}) < n / 2
