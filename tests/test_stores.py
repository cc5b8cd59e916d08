"""Settings, snapshots, exact ranks, and what a corpus tells of itself."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from finweave.errors import ContractError, DownloadError, NoSpace
from finweave.functions import numbers
from finweave.plans import profile
from finweave.settings import Settings
from finweave.sources import files, snapshot, store
from finweave.streaming import start_first_seen, stream_files


def test_settings(tmp_path, monkeypatch):
    for name in ("APP_ENV", "DATA_ROOT", "LOG_LEVEL"):
        monkeypatch.delenv(name, raising=False)
    path = tmp_path / ".env"
    path.write_text("# a comment\nAPP_ENV=staging\nexport DATA_ROOT='/x y'\nOTHER=1\n")
    assert Settings.load(str(path)) == Settings("staging", "/x y", "INFO")
    monkeypatch.setenv("LOG_LEVEL", "DEBUG")
    monkeypatch.setenv("APP_ENV", "test")
    assert Settings.load(str(path)) == Settings("test", "/x y", "DEBUG")
    assert Settings.load(None).data_root == "data"
    monkeypatch.setenv("LOG_LEVEL", "LOUD")
    with pytest.raises(ContractError):
        Settings.load(None)


def test_snapshot(spark, tmp_path):
    source = tmp_path / "source"
    (source / "a").mkdir(parents=True)
    (source / "a" / "x.txt").write_text("12345")
    (source / "y.txt").write_text("678")
    (source / "z.bin").write_text("9")
    request = snapshot.Request("repo", f"file://{tmp_path}/target", f"{tmp_path}/record.json", include=("*.txt", "*.bin"), exclude=("z*",), reserve=10)
    folder = snapshot.FolderSource(spark, f"file://{source}")
    made = snapshot.plan(request, folder)
    assert (made.file_count, made.total_bytes, made.files_to_download, made.bytes_to_download) == (2, 8, 2, 8)
    with pytest.raises(NoSpace):
        snapshot.download(spark, request, folder, free=lambda _: 17)
    assert not (tmp_path / "record.json").exists()
    snapshot.download(spark, request, folder, free=lambda _: 18)
    assert (tmp_path / "target" / "a" / "x.txt").read_text() == "12345" and not (tmp_path / "target" / "z.bin").exists()
    record = json.loads((tmp_path / "record.json").read_text())
    assert record["status"] == "complete" and record["resolved_revision"] == made.resolved_revision
    assert snapshot.download(spark, request, folder, dry_run=True).files_to_download == 0
    with pytest.raises(DownloadError):
        snapshot.plan(snapshot.Request("repo", request.target, "", include=("none",)), folder)


def test_replace_keeps_the_old_one_on_failure(spark, tmp_path):
    path = str(tmp_path / "x")
    store.write_bytes(spark, path, b"old")
    with pytest.raises(OSError):
        store.replace(spark, str(tmp_path / "absent"), path)
    assert store.read_bytes(spark, path) == b"old" and store.names(spark, str(tmp_path)) == ["x"]
    store.write_bytes(spark, path, b"new")
    assert store.read_bytes(spark, path) == b"new" and store.sha256(spark, path) == __import__("hashlib").sha256(b"new").hexdigest()


@pytest.mark.parametrize("kind", ["normal", "ties", "outliers", "one", "none", "tiny"])
def test_quantiles_equal_sorting(spark, kind, monkeypatch):
    rng = np.random.default_rng(5)
    values = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 3000) / 7, "outliers": np.concatenate([rng.random(2000), [1e300, -1e300, 1e18]]), "one": np.array([3.5]), "none": np.array([]), "tiny": rng.integers(0, 9, 500) * 5e-324}[kind]
    monkeypatch.setattr(profile, "PARTS", 16)
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    got = profile.quantiles(rows, "v", profile.LEVELS)
    if len(values):
        assert np.allclose(got, np.quantile(values, profile.LEVELS), rtol=1e-12, atol=0)
    else:
        assert got == [None] * len(profile.LEVELS)


def test_tolerant_inventory_and_readiness(spark, tmp_path):
    for path, body in {
        "ABC/2023/Hợp nhất kiểm toán Quý 2/a.txt": "a|b|c", "abc/2023/Công ty mẹ soát xét bán niên/b.txt": "", "x/1800/deep/more/c.txt": "<table>", "AB/20x0/n.txt": "\t", "ABCD/2014/BCTC/d.TXT": "x" * 2000,
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body, encoding="utf-8")
    rows = {r["relative_path"].rpartition("/")[2]: r for r in files.profile_inventory(spark, str(tmp_path)).collect()}
    facts = lambda n: tuple(rows[n][c] for c in ("ticker", "year", "scope", "assurance", "period_type", "structure_status", "is_empty", "is_tiny"))
    assert facts("a.txt") == ("ABC", 2023, "consolidated", "audited", "quarterly", "valid", False, True)
    assert facts("b.txt") == ("ABC", 2023, "separate", "reviewed", "semiannual", "valid", True, True)
    assert facts("d.TXT") == ("ABCD", 2014, "unspecified", "unspecified", "annual_or_unspecified", "valid", False, False) and not rows["d.TXT"]["year_in_expected_range"]
    assert rows["c.txt"]["structure_issue"] == "expected exactly ticker/year/report/file hierarchy; invalid ticker directory; invalid year directory"
    assert (rows["n.txt"]["year"], rows["n.txt"]["structure_status"]) == (None, "malformed")
    content = files.read_files(spark, str(tmp_path)).select("read_issue", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8_valid"), F.col("content").cast("string").rlike(r"<table|\|.*\||\t").alias("has_markers"))
    found = {r["finding"]: r["evidence"] for r in profile.readiness(files.profile_inventory(spark, str(tmp_path)), content).collect()}
    assert found == {"path parsing": "2/5 malformed paths", "quarantine": "1 empty files; 0 sampled read errors", "encoding": "0/5 sampled files are not strict UTF-8", "table detection": "60.0% of sampled files contain simple table markers", "coverage": "2 observed ticker-year pairs"}


def test_files_that_cannot_be_read_are_issues(spark, tmp_path, monkeypatch):
    good = tmp_path / "ABC" / "2023" / "fs"
    good.mkdir(parents=True)
    (good / "a.txt").write_text("x")
    (good / "b.txt").write_text("y")
    listed = files.list_files(spark, str(tmp_path)).where("relative_path LIKE '%a.txt'").collect() + [(("ABC/2023/fs/gone.txt"), f"file://{good}/gone.txt", 3, None)]
    rows = spark.createDataFrame([tuple(r) for r in listed], "relative_path string, path string, length long, modificationTime timestamp")
    monkeypatch.setattr(files, "list_files", lambda *_: rows)
    documents, issues = files.build_inventory(spark, str(tmp_path))
    assert [r["relative_path"] for r in documents.collect()] == ["ABC/2023/fs/a.txt"]
    issue = issues.first()
    assert issue["relative_path"] == "ABC/2023/fs/gone.txt" and issue["reason"].startswith("read failure: FileNotFoundError") and issue["sha256"] is None and issue["file_size_bytes"] is None


def test_stream_paths_are_relative_to_the_root(spark, tmp_path):
    root = tmp_path / "tree"
    for path in ("bad.txt", "deep/more/XYZ/2020/fs/b.txt", "ABC/2020/fs/c d.txt", "ABC/2020/fs/copy.txt"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("same" if path.startswith("ABC") else path)
    assert stream_files(spark, str(root)).isStreaming
    from finweave.streaming import start_inventory

    start_inventory(spark, str(root), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r["relative_path"]: r["reason"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {r["relative_path"]: r["reason"] for r in files.build_inventory(spark, str(root))[1].collect()}
    assert {p: w for p, w in got.items() if w} == batch == {"bad.txt": "path must have four parts", "deep/more/XYZ/2020/fs/b.txt": "path must have four parts"}
    start_first_seen(spark, str(root), f"{tmp_path}/first", f"{tmp_path}/state2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/first").count() == 3


def test_numbers_beyond_the_type_are_issues(spark):
    texts = ["1234", "1" * 28, "1" * 29, "0" * 20 + "1" * 28, "1,123456789012", "1,12345678900000", "(1.123456789012)"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", numbers.parse_number(F.col("t")).alias("n")).collect()
    got = {r["t"]: (r["n"]["value"] is not None, r["n"]["issue_code"]) for r in rows}
    assert got == {t: (i in (0, 1, 3, 5), None if i in (0, 1, 3, 5) else "number_invalid") for i, t in enumerate(texts)}
