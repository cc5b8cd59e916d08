"""The command line on a small corpus."""

import json

from finweave import cli


def test_inventory_build_and_sample(spark, tmp_path, capsys):
    path = tmp_path / "corpus" / "ABC" / "2023" / "fs"
    path.mkdir(parents=True)
    (path / "a.txt").write_text("Báo cáo kết quả kinh doanh\n<table><tr><th>Chỉ tiêu</th><th>2023</th></tr><tr><td>Odd</td><td>1.2.3</td></tr></table>\n", encoding="utf-8")
    root, out = str(tmp_path / "corpus"), tmp_path
    assert cli.main(["inventory", "--root", root, "--out", str(out / "m.jsonl")]) == 0
    assert json.loads(capsys.readouterr().out)["ready"] == 1
    assert cli.main(["build", "--root", root, "--out", str(out / "r"), "--manifest", str(out / "m.jsonl")]) == 0
    assert cli.main(["sample", "--release", str(out / "r"), "--out", str(out / "s")]) == 0
    assert cli.main(["baseline", "--sample", str(out / "s"), "--out", str(out / "b.md")]) == 0
    assert "number_invalid" in (out / "b.md").read_text()
    (path.parent / "odd.txt").write_text("x")
    assert cli.main(["inventory", "--root", root, "--out", str(out / "m2.jsonl")]) == 2
    compare = ["compare", "--before", str(out / "r"), "--after", str(out / "r"), "--sample", str(out / "s"), "--out", str(out / "c.json"), "--report", str(out / "c.md")]
    assert cli.main(compare) == 1 and not json.loads((out / "c.json").read_text())["passed"]
    assert "Failed:" in (out / "c.md").read_text() and "| tables | 1 | 1 | 0 |" in (out / "c.md").read_text()
