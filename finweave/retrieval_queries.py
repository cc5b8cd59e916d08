"""Queries of retrieval over the driver's tables: lexical and dense search, fusion, ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finweave.operators import dense, graph, lexical, ranking
from finweave.queries import VIEWS, on_tables, table, view
from finweave.sources.tables import staged, staging

#: BM25 by scoring every document; parts in millionths, rounded down.
BM25 = r"""
{sources}
, words AS (
  SELECT id, facet, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')) AS term FROM corpus
), counted AS (
  SELECT id, facet, term, count(*)::DOUBLE AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT id, sum(tf) AS length FROM counted GROUP BY id
), sizes AS (
  SELECT (SELECT count(*) FROM corpus)::DOUBLE AS n, (SELECT sum(tf) FROM counted)::DOUBLE / (SELECT count(*) FROM corpus)::DOUBLE AS mean
), terms AS (
  SELECT term, ln(1.0::DOUBLE + (any_value(n) - count(*)::DOUBLE + 0.5::DOUBLE) / (count(*)::DOUBLE + 0.5::DOUBLE)) AS idf FROM counted, sizes GROUP BY term
), asked_words AS (
  SELECT query_id, filter, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')) AS term FROM asked
), asked_terms AS (
  SELECT query_id, filter, term, count(*) AS times FROM asked_words GROUP BY ALL
), scored AS (
  SELECT query_id, id, sum(floor(1000000.0::DOUBLE * idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))))::BIGINT * times)::BIGINT AS score
  FROM asked_terms JOIN terms USING (term) JOIN counted USING (term) JOIN lengths USING (id), sizes WHERE filter IS NULL OR filter = facet GROUP BY ALL
)
SELECT query_id, place::INTEGER AS place, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM scored) WHERE place <= 30
"""
DOCUMENT_SOURCES = "WITH corpus AS (SELECT doc_id AS id, lang AS facet, text FROM documents), asked AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END AS filter, text FROM benchmark)"


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item as a question; a third of them ask for English documents, a third for French ones."""
    k = F.col("item_id") % 3
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.when(k == 1, F.lit("en")).when(k == 2, F.lit("fr")).alias("lang"))


@on_tables("lexical_top30", BM25.format(sources=DOCUMENT_SOURCES))
def lexical_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 30 documents of every benchmark item."""
    with staging(spark):
        index = lexical.build_index(table(spark, sf_dir, "documents"), facets=("lang",))
        return staged(lexical.search(index, benchmark_questions(spark, sf_dir)), "lexical-top")


TABLE_SOURCES = f"""WITH docs AS ({VIEWS['docs']}), tabs AS ({VIEWS['tabs']}), cels AS ({VIEWS['cels']}), labels_of AS (
  SELECT table_id, string_agg(DISTINCT row_label_raw, ' ' ORDER BY row_label_raw) AS labels FROM cels GROUP BY table_id
), corpus AS (
  SELECT table_id AS id, company_code AS facet, replace(concat_ws(' ', title_raw, statement_type, company_code, report_year::VARCHAR, unit_normalized, labels), '_', ' ') AS text
  FROM tabs JOIN docs USING (doc_id) LEFT JOIN labels_of USING (table_id)
), asked AS (
  SELECT n_nationkey AS query_id, concat('T', n_nationkey) AS filter, concat('Title ', n_nationkey, ' balance sheet 20', 15 + n_nationkey % 9, ' VND million R') AS text FROM nation
)"""


@on_tables("table_retrieval", BM25.format(sources=TABLE_SOURCES))
def table_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about a balance sheet for each company, over the tables of that company alone."""
    docs, tabs, cels = (view(spark, sf_dir, v) for v in ("docs", "tabs", "cels"))
    rows = lexical.table_documents(tabs, docs, cels.withColumnRenamed("row_label_raw", "row_label_canonical"))
    n = F.col("n_nationkey")
    asked = table(spark, sf_dir, "nation").select(n.alias("query_id"), F.concat(F.lit("T"), n).alias("company_code"), F.concat(F.lit("Title "), n, F.lit(" balance sheet 20"), 15 + n % 9, F.lit(" VND million R")).alias("text"))
    with staging(spark):
        index = lexical.build_index(rows, key="table_id", facets=("company_code",))
        return staged(lexical.search(index, asked), "table-top")


#: Cosines of every vector that is asked with every vector, in millionths.
COSINES = """
WITH units AS (
  SELECT vec_id AS id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
), scored AS (
  SELECT q.id AS query_id, r.id, round(list_inner_product(q.u, r.u) * 1000000)::BIGINT AS score FROM units q, units r WHERE q.id % 50 = 0
)
SELECT query_id, place::INTEGER AS place, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM scored) WHERE place <= 30
"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows, rows.where(F.col("id") % 50 == 0).withColumnRenamed("id", "query_id")


@on_tables("dense_top30_exact", COSINES)
def dense_top30_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 nearest of all vectors."""
    rows, queries = _vectors(spark, sf_dir)
    with staging(spark):
        return staged(dense.search_exactly(dense.build_index(rows), queries), "dense-exact")


@on_tables("dense_top30")
def dense_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 nearest vectors by the index; which cells are looked at is not what SQL states."""
    rows, queries = _vectors(spark, sf_dir)
    with staging(spark):
        return staged(dense.search(dense.build_index(rows), queries), "dense-top")


@on_tables("dense_recall")
def dense_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the 30 nearest vectors the index finds."""
    rows, queries = _vectors(spark, sf_dir)
    with staging(spark):
        index = dense.build_index(rows)
        return staged(dense.recall(staged(dense.search(index, queries), "dense-top"), staged(dense.search_exactly(index, queries), "dense-exact")), "dense-recall")


#: Three rankings of each nation's customers: by balance, by orders, by what they ordered for; the last only of those with more than one order.
RANKINGS = """
WITH per AS (
  SELECT c_custkey AS id, c_nationkey AS query_id, c_acctbal AS balance, count(o_orderkey) AS n, coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS cents, c_mktsegment AS segment
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, c_acctbal, c_mktsegment
)"""
FUSED = f"""{RANKINGS}
, lists AS (
  SELECT query_id, id, 0 AS l, row_number() OVER (PARTITION BY query_id ORDER BY balance DESC, id) AS place FROM per
  UNION ALL SELECT query_id, id, 1, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) FROM per WHERE n > 0
  UNION ALL SELECT query_id, id, 2, row_number() OVER (PARTITION BY query_id ORDER BY cents DESC, id) FROM per WHERE n > 1
), fused AS (
  SELECT query_id, id, sum(CASE l WHEN 2 THEN 2000000000 ELSE 1000000000 END // (60 + place))::BIGINT AS score, max(place) FILTER (l = 0)::INTEGER AS place_balance,
    max(place) FILTER (l = 1)::INTEGER AS place_orders, max(place) FILTER (l = 2)::INTEGER AS place_spent FROM lists WHERE place <= 30 GROUP BY query_id, id
), placed AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS place, id, score, place_balance, place_orders, place_spent FROM fused
)"""


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("query_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return rows.join(orders, "id", "left").fillna(0, ["n", "cents"])


def _fused(per: DataFrame) -> DataFrame:
    best = lambda rows, c: ranking.in_places(rows, c).where(F.col("place") <= 30)
    lists = {"balance": best(per, "balance"), "orders": best(per.where("n > 0"), "n"), "spent": best(per.where("n > 1"), "cents")}
    return ranking.fuse(lists, weights={"spent": 2})


@on_tables("rank_fusion", f"{FUSED} SELECT * FROM placed WHERE place <= 30")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rankings with missing members as one."""
    return _fused(_rankings(spark, sf_dir))


#: Of a nation, customers of the building segment are relevant; some nations have a second segment, and every seventh has none.
JUDGED = "SELECT query_id, id FROM per WHERE query_id % 7 <> 3 AND (segment = 'BUILDING' OR segment = 'MACHINERY' AND query_id % 2 = 0)"
PER_CUT = ", ".join(f"count(*) FILTER (place <= {k})::DOUBLE AS h{k}" for k in ranking.CUTS)
MEASURED = ", ".join(
    f"round(avg(CASE WHEN rel > 0 THEN coalesce(h{k}, 0) / {k}.0::DOUBLE END), 6) AS precision_{k}, round(avg(CASE WHEN rel > 0 THEN h{k} / rel END), 6) AS recall_{k}, "
    f"round(avg(CASE WHEN rel > 0 THEN CASE WHEN h{k} = 0 THEN 0.0::DOUBLE ELSE 5 * (h{k} / {k}) * (h{k} / rel) / (4 * (h{k} / {k}) + h{k} / rel) END END), 6) AS f2_{k}"
    for k in ranking.CUTS
)


@on_tables("ranking_measures", f"{FUSED}, judged AS ({JUDGED}), hits AS (SELECT judged.query_id, count(*)::DOUBLE AS rel, min(place) AS first, {PER_CUT} FROM judged LEFT JOIN (SELECT * FROM placed WHERE place <= 30) p USING (query_id, id) GROUP BY 1) SELECT n_regionkey AS intent, count(*) AS n_queries, count(*) FILTER (rel IS NULL) AS n_unjudged, round(avg(CASE WHEN rel > 0 THEN coalesce(1.0::DOUBLE / first, 0) END), 6) AS mrr, {MEASURED} FROM (SELECT DISTINCT query_id FROM per) q JOIN nation ON n_nationkey = q.query_id LEFT JOIN hits USING (query_id) GROUP BY 1")
def ranking_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the fused lists against judgements, by region."""
    per = _rankings(spark, sf_dir)
    q, segment = F.col("query_id"), F.col("segment")
    judged = per.select("query_id", "id", ((q % 7 != 3) & ((segment == "BUILDING") | ((segment == "MACHINERY") & (q % 2 == 0)))).alias("relevant"))
    rows = ranking.query_measures(_fused(per), judged)
    intents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_regionkey").alias("intent"))
    return ranking.measures(rows.join(intents, "query_id"), by=("intent",))


#: Paths of at most one edge, each written out.
SHARES = ", ".join(f"('{k}', {i}, {s})" for i, (k, s) in enumerate(graph.KINDS.items()))
EXPANDED = f"""WITH docs AS ({VIEWS['docs']}), tabs AS ({VIEWS['tabs']}), cels AS ({VIEWS['cels']}), nodes AS (
  SELECT table_id, doc_id, company_code, report_year, statement_type, row_count FROM tabs JOIN docs USING (doc_id)
), seeds AS (
  SELECT company_code AS query_id, table_id AS seed, 1000 + row_count AS score FROM nodes
  QUALIFY row_number() OVER (PARTITION BY company_code ORDER BY row_count DESC, table_id) <= 4
), metrics AS (SELECT DISTINCT table_id, row_label_raw AS metric FROM cels WHERE row_label_raw IS NOT NULL), linked AS (
  SELECT 'same_company' AS kind, a.company_code AS key, a.table_id AS seed, b.table_id FROM nodes a JOIN nodes b USING (company_code)
  UNION ALL SELECT 'same_period', a.report_year::VARCHAR, a.table_id, b.table_id FROM nodes a JOIN nodes b USING (report_year) WHERE a.table_id IN (SELECT seed FROM seeds)
  UNION ALL SELECT 'same_statement_type', a.statement_type, a.table_id, b.table_id FROM nodes a JOIN nodes b USING (statement_type) WHERE a.table_id IN (SELECT seed FROM seeds)
  UNION ALL SELECT 'adjacent_period', concat(b.company_code, '|', b.report_year), a.table_id, b.table_id FROM nodes a JOIN nodes b ON a.company_code = b.company_code AND abs(a.report_year - b.report_year) = 1
  UNION ALL SELECT 'explained_by_note', a.doc_id, a.table_id, b.table_id FROM nodes a JOIN nodes b USING (doc_id) WHERE b.statement_type = 'cash_flow_statement' AND a.statement_type IS DISTINCT FROM 'cash_flow_statement'
  UNION ALL SELECT 'shared_metric', a.metric, a.table_id, b.table_id FROM metrics a JOIN metrics b USING (metric) WHERE a.table_id IN (SELECT seed FROM seeds)
), reached AS (
  SELECT query_id, table_id, score * share // 100 AS score, kind, key, seed, ord, score AS of_seed FROM seeds JOIN linked USING (seed) JOIN (VALUES {SHARES}) k(kind, ord, share) USING (kind) WHERE table_id <> seed
), best AS (
  SELECT query_id, table_id, score, kind, key, seed FROM reached WHERE (query_id, table_id) NOT IN (SELECT query_id, seed FROM seeds)
  QUALIFY row_number() OVER (PARTITION BY query_id, table_id ORDER BY score DESC, ord, of_seed DESC, seed, key) = 1
  UNION ALL SELECT query_id, seed, score, NULL, NULL, NULL FROM seeds
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id)::INTEGER AS place, table_id, score::BIGINT AS score, kind, key, seed FROM best
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) <= 6"""


@on_tables("graph_expansion", EXPANDED)
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each company the four longest tables, and what is one edge away, to the best six."""
    docs, tabs, cels = (view(spark, sf_dir, v) for v in ("docs", "tabs", "cels"))
    metrics = cels.groupBy("table_id").agg(F.collect_set("row_label_raw").alias("metrics"))
    nodes = tabs.join(docs.select("doc_id", "company_code", "report_year"), "doc_id").join(metrics, "table_id", "left")
    order = Window.partitionBy("company_code").orderBy(F.col("row_count").desc(), "table_id")
    found = nodes.withColumn("nth", F.row_number().over(order)).where("nth <= 4").select(F.col("company_code").alias("query_id"), "table_id", (F.col("row_count") + 1000).alias("score"))
    with staging(spark):
        keys = staged(graph.graph_keys(nodes, notes="cash_flow_statement"), "graph-keys")
        return staged(graph.expand(keys, found), "graph-top")
