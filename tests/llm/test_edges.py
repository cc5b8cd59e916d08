"""Every operator and stage on odd inputs: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import public_tokenizers
import pytest

import corpus_pipeline
from finweave.llm import audio, decontaminate, licenses, linededup, minhash, mixing, quality, tokencount, tokenio, urlfilter

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977} of {i}" for i in range(60_000))
#: Extra columns that the operators use as names of their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, node long, dropped string, size string, set string, k_n int, score double, w_doc long, n_lines int"
ROWS = [
    (1, "a b c d e f g h", "en", "s1"),
    (1, "a b c d e f g h", "en", "s1"),
    (1, "another text under the same id\nwith two lines", "en", "s1"),
    (None, "no id at all here", None, None),
    (2, None, "en", "s2"),
    (3, "", "en", "s2"),
    (4, "   \n\n ", None, None),
    (5, LONG, "en", "s1"),
    (6, "<|endoftext|> two  spaces \U0001f600 é\tß ", "de", ""),
    (-7, "Released under the MIT License.", "en", "s3"),
]


def table(spark, rows=ROWS):
    extra = (7, 7, 7, "x", "x", "x", 7, 0.5, 7, 7)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


def labels(spark, rows=((1, 1, 0), (5, 0, 1), (5, 1, 0), (None, 1, 0), (3, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=((1, "a b c d e f"), (2, None), (3, "x"), (3, "")), extra=True):
    return spark.createDataFrame([(*r, "z") for r in rows], "item_id long, text string, doc_id string")


OPERATORS = {
    "near": lambda s, d: minhash.near_duplicates(d),
    "near_weighted": lambda s, d: minhash.near_duplicates(d, weighted=True),
    "lines": lambda s, d: linededup.line_report(d),
    "audio": lambda s, d: audio.audio_report(d),
    "counts": lambda s, d: tokencount.token_counts(d, BPE),
    "quality": lambda s, d: quality.quality_scores(d, labels(s)),
    "mixing": lambda s, d: mixing.mix_report(d),
    "licences": lambda s, d: licenses.license_scan(d),
    "tokens": lambda s, d: tokenio.token_output(d, BPE),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(spark, name):
    rows = OPERATORS[name](spark, table(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).collect() == []


def test_contaminated_edges(spark):
    found = decontaminate.contaminated(table(spark), benchmark(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1)}
    # Items of one or two words match whole texts only.
    short = benchmark(spark, ((1, "Alpha"), (2, "alpha beta"), (3, "alpha alpha")))
    texts = ["alpha", "ALPHA, beta!", "alpha beta gamma", "the alpha beta of it", "beta alpha", "", None]
    found = decontaminate.contaminated(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), short).collect()
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in found} == {(0, 1, 1.0), (1, 2, 1.0)}
    assert decontaminate.contaminated(table(spark), benchmark(spark, ())).collect() == []
    assert decontaminate.contaminated(table(spark, []), benchmark(spark)).collect() == []
    kept = decontaminate.decontaminate(table(spark), benchmark(spark))
    assert kept.columns == table(spark).columns and kept.count() == len(ROWS) - 2


def test_urls_edges(spark):
    rules = [urlfilter.UrlRule("allow", "org/"), urlfilter.UrlRule("block", "example.org/es/")]
    urls = [(1, None), (2, "no mark"), (3, "HTTP://A.Example.ORG/es/x?y#z"), (3, "HTTP://A.Example.ORG/es/x?y#z"), (4, "x://org"), (5, "x://org/"), (6, "a://b://c/d"), (None, "")]
    pages = spark.createDataFrame([(*u, "h", 1.0) for u in urls], "page_id long, url string, host string, score double")
    got = {(r["page_id"], r["host"], r["path"], r["rule"]) for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got == {(1, "", "", None), (2, "", "", None), (3, "a.example.org", "/es/x", "example.org/es/"), (4, "org", "", None), (5, "org", "/", "org/"), (6, "b:", "//c/d", None), (None, "", "", None)}
    assert urlfilter.judge_urls(pages.limit(0), rules).collect() == []


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    labels(spark).write.parquet(f"{path}/labels.parquet")
    benchmark(spark).write.parquet(f"{path}/benchmark.parquet")
    table(spark).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, sf_dir, name, stage):
    docs = table(spark)
    out = stage(spark, docs, sf_dir)
    if name != "tokens":
        assert out.columns == docs.columns
    assert out.count() <= 2 * len(ROWS)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_keep_one_keeps_one_of_equal_rows(spark):
    kept = minhash.keep_one(table(spark)).collect()
    texts = [r["text"] for r in kept]
    # Null, empty and blank texts have no words and are one class.
    assert len(kept) == 7 and len(set(texts)) == 7


#: Every name that the operators that return whole rows have for columns of their own.
TAKEN = (
    "k_row", "k_key", "k_rows", "k_copies", "k_at", "k_copy", "k_first", "k_doc", "k_hash", "k_times", "k_text", "t_doc", "t_hash", "g_doc", "g_hash", "g_gone", "dropped", "row_hash", "label", "node", "class_id",
    "n_rows", "place", "key", "size", "target", "expected", "offset", "K__", "g__", "_q_score", "f_hash", "template", "line", "line_no", "digest", "w_doc", "item_id", "score", "rank", "weight", "p_text", "words",
)


def clashing(spark):
    """Rows whose every extra column has a value of its own."""
    rows = [(*r, *[f"{i}-{name}" for name in TAKEN]) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in TAKEN)), {r[4:] for r in rows}


WHOLE_ROWS = {
    **{name: stage for name, stage in corpus_pipeline.STAGES if name != "tokens"},
    "lines": lambda s, d, _: linededup.drop_recurring_lines(d),
}


@pytest.mark.parametrize("name", WHOLE_ROWS)
def test_other_columns_come_back_as_they_are(spark, sf_dir, name):
    docs, values = clashing(spark)
    out = WHOLE_ROWS[name](spark, docs, sf_dir)
    got = out.select(*TAKEN).collect()
    assert got and {tuple(r) for r in got} <= values
    if name == "lines":
        assert {tuple(r) for r in got} == values
    else:
        assert out.columns == docs.columns
