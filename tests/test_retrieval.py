"""Lexical and dense search against plain tellings of them."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from finweave.operators import dense, lexical

WORD = re.compile(r"[^\W_]+")


def brute_bm25(docs, queries, k):
    """(query_id, place, id, score) by scoring every document."""
    counts = [Counter(WORD.findall((t or "").lower())) for _, _, t in docs]
    n, mean = len(docs), sum(c.total() for c in counts) / len(docs)
    df = Counter(w for c in counts for w in c)
    out = []
    for qid, facet, text in queries:
        asked, found = Counter(WORD.findall((text or "").lower())), []
        for row, ((i, f, _), c) in enumerate(zip(docs, counts)):
            if facet is not None and facet != f:
                continue
            score = 0
            for w, times in asked.items():
                if c[w]:
                    idf = math.log(1.0 + (float(n) - df[w] + 0.5) / (df[w] + 0.5))
                    score += math.floor(1e6 * idf * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)))) * times
            if any(c[w] for w in asked):
                found.append((-score, i is None, i or 0, row))
        out += [(qid, place, None if none else i, -s) for place, (s, none, i, _) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda m: " ".join(vocabulary[min(int(rng.expovariate(0.03)), 399)] for _ in range(m))
    docs = [(i, rng.choice(["en", "fr", None]), some(rng.randint(1, 60))) for i in range(n)]
    # A third are one text, and some are none.
    docs += [(10_000 + i, "en", "W1 w2, the same w399 text") for i in range(n // 2)] + [(7, "fr", None), (7, "fr", ""), (None, "en", "w3 w4"), (8, "en", "..."), (9, "en", "Été w5 w5")]
    return docs, some


@pytest.mark.parametrize("sent", [500_000, 0])
def test_lexical_equals_scoring_everything(spark, monkeypatch, sent):
    """With the small sides sent and without; many ties, and postings that are left out."""
    monkeypatch.setattr(lexical, "SENT", sent)
    monkeypatch.setattr(lexical, "SEEDS", 60)
    rng = random.Random(3)
    docs, some = corpus(rng, 500)
    queries = [(i, rng.choice(["en", "fr", None, "xx"]), some(rng.randint(1, 12))) for i in range(12)] + [(90, None, "unknown words"), (91, None, None), (92, "en", "the same text w399"), (92, None, "été été w5"), (93, None, "w390 w391 w392 w1")]
    table = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, lang string, text string")
    index = lexical.build_index(table, facets=("lang",))
    got = lexical.search(index, asked, k=10).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_bm25(docs, queries, 10)
    terms = lexical.query_terms(index, asked, "query_id", "text")
    found, weak = lexical.candidates(index, terms, 10)
    assert weak.count() > 0 and 0 < found.count() < lexical._sums(lexical._parts(index, terms)).count()


def test_lexical_hands_on_only_the_best(spark, monkeypatch):
    """Few queries meet documents in the tasks that hold them, a few at a time; the index has a row for each document and no posting is joined."""
    monkeypatch.setattr(lexical, "candidates", None)
    rng = random.Random(4)
    docs, some = corpus(rng, 120)
    queries = [(i, rng.choice(["en", "fr", None]), some(rng.randint(1, 12))) for i in range(8)] + [(90, None, "the same text w399 w1 w1")]
    asked = spark.createDataFrame(queries, "query_id long, lang string, text string")
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(2), facets=("lang",))
    assert index.documents.count() == len(docs)
    for cells in (1_000_000, 40):
        monkeypatch.setattr(lexical, "CELLS", cells)
        got = lexical.search(index, asked, k=4).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_bm25(docs, queries, 4)


def test_lexical_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    index = lexical.build_index(none, facets=("lang",))
    asked = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert lexical.search(index, asked).collect() == []
    some = lexical.build_index(spark.createDataFrame([(1, "en", "a b")], "doc_id long, lang string, text string"))
    assert lexical.search(some, asked.limit(0)).collect() == []
    assert [(r["id"], r["place"]) for r in lexical.search(some, asked).collect()] == [(1, 1)]


def test_term_counts_of_long_texts(spark):
    text = " ".join(f"Word{i % 997}" for i in range(50_000))
    got = spark.createDataFrame([(text,), (None,), ("",), ("a",)], "t string").select(lexical.term_counts(F.col("t")).alias("c")).collect()
    assert {x["term"]: x["times"] for x in got[0]["c"]} == Counter(text.lower().split())
    assert [[tuple(x) for x in r["c"]] for r in got[1:]] == [[], [], [("a", 1)]]


def brute_cosines(rows, queries, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    rows = sorted({(i, tuple(v)) for i, v in rows}, key=repr)
    out = []
    for qid, q in queries:
        scored = sorted((-round(float(unit(q) @ unit(v)) * 1e6), i is None, i or 0) for i, v in rows)
        out += [(qid, place, None if none else i, -s) for place, (s, none, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def vectors(rng, n, d=9):
    centres = rng.normal(size=(12, d)) * 3
    return [(int(i), (centres[rng.integers(12)] + rng.normal(size=d)).tolist()) for i in range(n)]


BAD = [(900, None), (901, [0.0] * 9), (902, [1.0] * 5), (903, [float("nan")] * 9), (904, [float("inf")] + [1.0] * 8), (905, [])]


def test_dense_search_exact_and_indexed(spark, monkeypatch):
    """Vectors that very many rows share, ids with several vectors, odd vectors; groups of few rows."""
    rng = np.random.default_rng(4)
    rows = vectors(rng, 600)
    rows += [(2000 + i, rows[5][1]) for i in range(400)] + [(3, rows[9][1]), (3, rows[9][1]), (None, rows[7][1])]
    queries = [(i, v) for i, v in rows[:40]] + [(77, rows[5][1]), (78, rows[5][1])]
    table = spark.createDataFrame(rows + BAD, "id long, vector array<double>")
    asked = spark.createDataFrame(queries + BAD, "query_id long, vector array<double>")
    monkeypatch.setattr(dense, "ROWS", 100)
    monkeypatch.setattr(dense, "QUERIES", 7)
    index = dense.build_index(table, cells=8)
    want = brute_cosines(rows, queries, 10)
    exact = dense.search_exactly(index, asked, k=10)
    assert sorted((tuple(r) for r in exact.collect()), key=repr) == want
    found = dense.search(index, asked, k=10)
    rate = dense.recall(found, exact).first()["recall"]
    assert rate >= 0.9
    # All cells and many candidates give the exact result.
    every = dense.search(index, asked, k=10, probe=8, keep=40)
    assert sorted((tuple(r) for r in every.collect()), key=repr) == want


def test_dense_sample_is_bounded(spark):
    rows = spark.createDataFrame(vectors(np.random.default_rng(1), 500), "id long, vector array<double>")
    index = dense.build_index(rows, sample=64, cells=64)
    assert len(index.book.centroids) <= 64 and index.rows.count() == 500


def test_dense_without_rows(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    for index in (dense.build_index(none), dense.build_index(spark.createDataFrame(BAD[:2], "id long, vector array<double>"))):
        assert dense.search(index, one).collect() == [] and dense.search_exactly(index, one).collect() == []
    index = dense.build_index(one.withColumnRenamed("query_id", "id"))
    assert dense.search(index, one.limit(0)).collect() == [] and [tuple(r) for r in dense.search(index, one).collect()] == [(1, 1, 1, 1_000_000)]
