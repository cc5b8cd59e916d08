"""Fusion, measures, expansion, operations over values and the balance check on small tables with odd rows."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from finweave.operators import graph, ranking
from finweave.plans import finance, profile

LIST = "query_id long, place int, id long"


def test_fusion_with_missing_members(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 2, 12), (1, 9, 10), (2, 1, 5), (None, 1, 7), (1, None, 8), (1, 3, None)], LIST)
    b = spark.createDataFrame([(1, 1, 12), (1, 2, 10), (3, 1, 6)], LIST)
    rows = ranking.fuse({"a": a, "b": b}, top=2).collect()
    unit = 10**9
    got = {(r["query_id"], r["place"]): (r["id"], r["score"], r["place_a"], r["place_b"]) for r in rows}
    # Of equal scores the smaller id comes first.
    assert got == {
        (1, 1): (10, unit // 61 + unit // 62, 1, 2), (1, 2): (12, unit // 62 + unit // 61, 2, 1), (2, 1): (5, unit // 61, 1, None), (3, 1): (6, unit // 61, None, 1),
    }
    fined = ranking.fuse({"a": a, "b": b}, penalty=F.when(F.col("id") == 10, 10**9)).where("query_id = 1").collect()
    assert [r["id"] for r in sorted(fined, key=lambda r: r["place"])] == [12, 11, 10]
    assert ranking.fuse({"a": a.limit(0), "b": b.limit(0)}).collect() == []


def test_measures(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 13), (2, 1, 20), (4, 1, 1)], LIST)
    judged = spark.createDataFrame([(1, 11, True), (1, 11, True), (1, 13, True), (1, 99, True), (1, 10, False), (2, 21, True), (3, 5, True), (4, 1, False), (None, 1, True)], "query_id long, id long, relevant boolean")
    per = ranking.query_measures(ranked, judged, cuts=(3, 5))
    got = {r["query_id"]: r for r in per.collect()}
    one = got[1]
    assert (one["n_relevant"], one["n_listed"], one["reciprocal"]) == (3, 4, 0.5)
    assert (one["precision_3"], one["recall_3"], one["precision_5"], one["recall_5"]) == pytest.approx((1 / 3, 1 / 3, 2 / 5, 2 / 3))
    assert one["f2_5"] == pytest.approx(5 * (2 / 5) * (2 / 3) / (4 * 2 / 5 + 2 / 3))
    # No hit, no list, nothing relevant.
    assert [got[q]["recall_5"] for q in (2, 3, 4)] == [0.0, 0.0, None] and [got[q]["reciprocal"] for q in (2, 3, 4)] == [0.0, 0.0, None]
    total = ranking.measures(per, cuts=(3, 5)).first()
    assert (total["n_queries"], total["n_unjudged"], total["mrr"]) == (4, 1, round(0.5 / 3, 6))
    assert {(r["query_id"], r["id"], r["reason"]) for r in ranking.failures(ranked, judged, cut=3).collect()} == {(1, 13, "below_cut"), (1, 99, "not_listed"), (2, 21, "not_listed"), (3, 5, "not_listed")}


def brute_expand(tables, found, top):
    keys = list(graph.KINDS)
    def kinds(a, b):
        if a["company_code"] is not None and a["company_code"] == b["company_code"]:
            yield "same_company", str(a["company_code"])
            if None not in (a["report_year"], b["report_year"]) and abs(a["report_year"] - b["report_year"]) == 1:
                yield "adjacent_period", f"{b['company_code']}|{b['report_year']}"
        if a["report_year"] is not None and a["report_year"] == b["report_year"]:
            yield "same_period", str(a["report_year"])
        if a["statement_type"] is not None and a["statement_type"] == b["statement_type"]:
            yield "same_statement_type", a["statement_type"]
        if a["doc_id"] is not None and a["doc_id"] == b["doc_id"] and b["statement_type"] == "notes" and a["statement_type"] != "notes":
            yield "explained_by_note", a["doc_id"]
        for m in set(a["metrics"] or ()) & set(b["metrics"] or ()):
            yield "shared_metric", m

    out = []
    for q in sorted({f[0] for f in found}):
        seeds = {t: s for query, t, s in found if query == q}
        best = {t: (-s, -1, -s, "", "", "") for t, s in seeds.items()}
        for a in tables:
            if a["table_id"] in seeds:
                for b in tables:
                    if b["table_id"] not in seeds:
                        for kind, key in kinds(a, b):
                            s = seeds[a["table_id"]]
                            path = (-(s * graph.KINDS[kind] // 100), keys.index(kind), -s, a["table_id"], key, kind)
                            best[b["table_id"]] = min(best.get(b["table_id"], path), path)
        for place, (t, p) in enumerate(sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:top], 1):
            out.append((q, place, t, -p[0], p[5] or None, p[4] or None, p[3] or None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_expansion_equals_comparing_all_tables(spark, seed):
    """Hubs that most tables have, tables without keys, equal scores."""
    rng = random.Random(seed)
    schema = "table_id string, doc_id string, company_code string, report_year int, statement_type string, metrics array<string>"
    rows = [(f"t{i:03}", rng.choice(["d1", "d2", f"d{i}", None]), rng.choice(["A", "A", "B", f"c{i}", None]), rng.choice([2020, 2020, 2021, 2019, None]), rng.choice(["notes", "x", "y", None]), rng.choice([["m1"], ["m1", "m2", "m2"], [f"m{i}"], [], None])) for i in range(150)]
    names = [c.split()[0] for c in schema.split(", ")]
    found = [(q, t, rng.choice([50, 50, 90, 100])) for q in (1, 2, 3) for t in rng.sample([r[0] for r in rows], 5)]
    keys = graph.graph_keys(spark.createDataFrame(rows, schema))
    got = graph.expand(keys, spark.createDataFrame(found, "query_id long, table_id string, score long"), seeds=5).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute_expand([dict(zip(names, r)) for r in rows], found, 6), key=repr)


def test_expansion_without_rows(spark):
    keys = graph.graph_keys(spark.createDataFrame([], "table_id string, doc_id string, company_code string, report_year int, statement_type string, metrics array<string>"))
    found = spark.createDataFrame([(1, "t", 7)], "query_id long, table_id string, score long")
    assert [tuple(r) for r in graph.expand(keys, found).collect()] == [(1, 1, "t", 7, None, None, None)]
    assert graph.expand(keys, found.limit(0)).collect() == []


FACTS = [
    ("A", "2020", "revenue", "100", "VND_million", "c1"), ("A", "2021", "revenue", "150000", "VND_thousand", "c2"), ("B", "2020", "revenue", "100", "VND_million", "c3"), ("B", "2021", "revenue", "0", "VND", "c4"), ("B", "2022", "revenue", "5", "VND", "c5"),
    ("A", "2020", "roe", "12", "percent", "c6"), ("A", "2020", "equity", "-40", "VND_million", "c7"), ("C", "2020", "revenue", "1", "VND", "c8"), ("C", "2020", "revenue", "2", "VND", "c9"), ("D", "2020", "revenue", "1", "VND_thousand", "d1"), ("D", "2020", "revenue", "1000", "VND", "d2"),
    (None, "2020", "revenue", "9", "VND", "x"), ("A", "2020", "revenue", None, "VND", "y"), ("A", "2020", "revenue", "7", None, "z"), ("A", "2020", "revenue", "7", "boxes", "w"),
]
QUESTIONS = "query_id string, operation string, companies array<string>, periods array<string>, metrics array<string>, numerator string, denominator string, top_k int, expected_unit string"


def answers(spark, *questions):
    facts = spark.createDataFrame([(*f[:3], None if f[3] is None else Decimal(f[3]), *f[4:]) for f in FACTS], "company string, period string, metric string, value decimal(38,10), unit string, cell_id string")
    full = [(f"q{i:02}", *q, *([None] * (8 - len(q)))) for i, q in enumerate(questions)]
    out = {}
    for r in finance.answer(spark.createDataFrame(full, QUESTIONS), facts).orderBy("query_id", "place").collect():
        out.setdefault(r["query_id"], []).append((r["company"], r["period"], None if r["value"] is None else float(r["value"]), r["unit"], r["issue"]))
    return [out.get(f"q{i:02}", []) for i in range(len(questions))]


def test_operations(spark):
    r = ["revenue"]
    got = answers(
        spark,
        ("lookup", ["A", "A", "Z"], ["2020"], ["revenue", "roe"]),
        ("compare", ["A", "B"], ["2020"], r),
        ("difference", ["A"], ["2020", "2021"], r),
        ("difference", ["A"], ["2020", "2021"], r, None, None, None, "VND_billion"),
        ("growth_rate", ["A"], ["2020", "2021"], r),
        ("growth_rate", ["B"], ["2021", "2022"], r),
        ("ratio", ["A"], ["2020"], None, "equity", "revenue"),
        ("ratio", ["A"], ["2020"], None, "equity", "revenue", None, "percent"),
        ("ratio", ["A"], ["2020"], None, "equity", "roe"),
        ("average", ["A", "B"], ["2020"], r),
        ("sum", ["A"], ["2020", "2021"], r),
        ("sum", ["A"], ["2020"], ["revenue", "roe"]),
        ("sum", ["C"], ["2020"], r),
        ("sum", ["D"], ["2020"], r),
        ("rank", ["C", "B", "A", "D", "Z"], ["2020"], r, None, None, 2),
        ("sum", ["A"], ["2020"], r, None, None, None, "percent"),
        ("guess", ["A"], ["2020"], r),
        ("lookup", [], ["2020"], r),
        ("difference", ["A"], ["2020"], r),
        (None, None, None, None),
    )
    none = (None, None)
    assert got == [
        [("A", "2020", 100.0, "VND_million", None), ("A", "2020", 12.0, "percent", None), ("Z", "2020", None, None, "missing_value"), ("Z", "2020", None, None, "missing_value")],
        [("A", "2020", 100.0, "VND_million", None), ("B", "2020", 100.0, "VND_million", None)],
        [(*none, 50_000_000.0, "VND", None)],
        [(*none, 0.05, "VND_billion", None)],
        [(*none, 50.0, "percent", None)],
        [(*none, None, None, "division_by_zero")],
        [(*none, -0.4, "ratio", None)],
        [(*none, -40.0, "percent", None)],
        [(*none, None, None, "mixed_units")],
        [(*none, 100.0, "VND_million", None)],
        [(*none, 250_000_000.0, "VND", None)],
        [(*none, None, None, "mixed_units")],
        [(*none, None, None, "ambiguous_value")],
        [(*none, 1000.0, "VND", None)],
        # Equal values in the order asked; what has an issue is told behind.
        [("B", "2020", 100_000_000.0, "VND", None), ("A", "2020", 100_000_000.0, "VND", None), ("C", "2020", None, None, "ambiguous_value"), ("Z", "2020", None, None, "missing_value")],
        [(*none, None, None, "unit_mismatch")],
        [(*none, None, None, "unknown_operation")],
        [(None, None, None, None, "wrong_members")],
        [(*none, None, None, "wrong_members")],
        [(*none, None, None, "unknown_operation")],
    ]


def test_balance(spark):
    rows = [
        ("A", "assets", "10", "VND_million"), ("A", "debt", "6", "VND_million"), ("A", "equity", "4000.6", "VND_thousand"), ("B", "assets", "10", "VND"), ("B", "debt", "6", "VND"), ("B", "equity", "7", "VND"),
        ("C", "assets", "10", "VND"), ("D", "assets", "1", "percent"), ("D", "debt", "1", "VND"), ("D", "equity", "1", "VND"), ("E", "assets", "1", "VND"), ("E", "assets", "2", "VND"), ("E", "debt", "1", "VND"), ("E", "equity", "0", "VND"), ("F", "other", "1", "VND"),
    ]
    facts = spark.createDataFrame([(c, "2020", m, Decimal(v), u, f"{c}{m}{v}") for c, m, v, u in rows], "company string, period string, metric string, value decimal(38,10), unit string, cell_id string")
    got = {r["company"]: (None if r["gap"] is None else float(r["gap"]), None if r["tolerance"] is None else float(r["tolerance"]), r["status"]) for r in finance.balance_check(facts, "assets", ("debt", "equity")).collect()}
    assert got == {"A": (-600.0, 1_000_500.0, "balanced"), "B": (-3.0, 1.5, "unbalanced"), "C": (None, None, "incomplete"), "D": (None, None, "mixed_units"), "E": (None, None, "ambiguous_value")}
    assert finance.balance_check(facts.limit(0)).collect() == []


def test_describe_takes_all_kinds(spark):
    rows = [("b", True, 1.5, 3, ["x"], None), ("a", True, float("nan"), 4, ["x"], None), ("a", False, None, 5, None, None), ("b", None, float("inf"), 6, ["y"], None), (None, None, 2.5, 7, [], None)]
    df = spark.createDataFrame(rows, "`t.x` string, flag boolean, v double, i int, l array<string>, nothing string")
    got = {r["column"]: r for r in profile.describe_all(df).collect()}
    text = lambda c: tuple(got[c][k] for k in ("count", "n_null", "n_unique", "top", "frequency"))
    # Of equally frequent texts the smaller one.
    assert text("t.x") == (4, 1, 2, "a", 2) and text("flag") == (3, 2, 2, "true", 2) and text("nothing") == (0, 5, 0, None, None) and text("l")[:3] == (4, 1, 3)
    number = lambda c: tuple(got[c][k] for k in ("count", "n_null", "mean", "min", "p25", "p50", "p75", "max"))
    assert number("v") == (2, 3, 2.0, 1.5, 1.75, 2.0, 2.25, 2.5) and number("i") == (5, 0, 5.0, 3.0, 4.0, 5.0, 6.0, 7.0)
    assert {r["column"]: (r["count"], r["n_null"]) for r in profile.describe_all(df.limit(0)).collect()} == {c: (0, 0) for c in df.columns}
