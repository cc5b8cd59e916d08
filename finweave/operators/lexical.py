"""Lexical retrieval: an index as tables, and exact top-k without a shuffle of postings.

The index has a row for each document (facets, row number, id, length, and its terms with how often they stand in it), written by
the tasks that read the texts, and each term's document frequency with the most that it can add to any document, but for its own weight.
No posting is a row of its own, and nothing is sorted.  Facets are the columns that a query may filter by.

A score is a sum of BM25 parts, each rounded down to a millionth, so it is a whole number and does not depend on
the order of the sum.  While the queries' terms are at most ``SENT`` and the queries at most ``QUERIES``, they are sent to the tasks, and a task scores its documents
against all queries and hands on its best ``k`` of each; only these are shuffled.  No text is read at query time.

More queries are searched by joins.  These go from rare terms to frequent ones.  Sums over a query's rarest terms give a threshold: the
k-th best of them is a lower bound of the k-th best score.  Terms whose bounds together stay below it cannot bring a document in by
themselves, and these are the frequent ones; so only the postings of the others make candidates.  With the best of these scored in full the
threshold rises, and candidates that the left-out terms' bounds cannot lift to it fall.  What is left gets its parts of
the frequent terms.  Either result equals scoring every document.

Edge cases: null and empty texts have no terms and are never found (they count as documents); a query
without known terms, or whose filter fits nothing, has no rows; a null facet of a query does not filter; rows that share an id are found
apart; ties go to the smaller id (null last), then to the earlier row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finweave.functions.text import steps
from finweave.sources.tables import staged

WORD = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
#: A score's unit, postings that give a query's first threshold.
UNIT, SEEDS = 1e6, 20_000
#: Rows that are broadcast, and queries that a task scores its documents against, at most.
SENT, QUERIES = 500_000, 5_000
#: Scores and parts of them that a task holds at once, about, and documents that it is given at once.
CELLS, BATCH = 1_000_000, 1_000
TOP = 30


@dataclass(frozen=True)
class LexicalIndex:
    """The tables of an index, its facets, and the corpus's size and mean length."""

    documents: DataFrame
    terms: DataFrame
    facets: tuple[str, ...]
    n_docs: int
    mean_length: float

    @property
    def postings(self) -> DataFrame:
        """A row for each term of each document."""
        return self.documents.select("n", "id", *self.facets, "length", F.inline("counts"))


def term_counts(text: Column) -> Column:
    """Array of (term, times) of a text's lower-case words; counted within the row, so that no word is shuffled."""
    words = F.sort_array(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))
    first = lambda w: F.filter(F.transform(w, lambda x, i: F.struct(x.alias("term"), i.alias("at"), ((i == 0) | (x != F.get(w, i - 1))).alias("new"))), lambda x: x["new"])
    starts = lambda w: F.struct(F.size(w).alias("n"), first(w).alias("first"))
    counted = lambda x: F.transform(x["first"], lambda s, j: F.struct(s["term"].alias("term"), (F.coalesce(F.get(x["first"], j + 1)["at"], x["n"]) - s["at"]).alias("times")))
    return steps(words, starts, counted)


def _saturation(times: Column, length: Column, mean_length: float) -> Column:
    return times * F.lit(K1 + 1) / (times + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean_length)))


def _sent(df: DataFrame) -> DataFrame:
    """``df`` (written) as the side that is broadcast, while it is small enough; otherwise as it is."""
    return F.broadcast(df) if df.count() <= SENT else df


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", facets: tuple[str, ...] = ()) -> LexicalIndex:
    """Index of ``docs`` in the shared folder; one pass over the texts."""
    rows = docs.select(F.monotonically_increasing_id().alias("n"), F.col(key).alias("id"), *facets, term_counts(F.col(text)).alias("counts"))
    rows = staged(rows.withColumn("length", F.aggregate("counts", F.lit(0), lambda s, x: s + x["times"])), "lexical-documents")
    n_docs, total = rows.agg(F.count(F.lit(1)), F.sum("length")).first()
    mean = total / n_docs if total else 1.0
    index = LexicalIndex(rows, rows, tuple(facets), n_docs, mean)
    most = F.max(_saturation(F.col("times"), F.col("length"), mean)).alias("most")
    terms = staged(index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), most), "lexical-terms")
    return LexicalIndex(rows, terms, tuple(facets), n_docs, mean)


def _part(idf: Column, saturation: Column) -> Column:
    return F.floor(F.lit(UNIT) * idf * saturation).cast("long")


def query_terms(index: LexicalIndex, queries: DataFrame, key: str, text: str) -> DataFrame:
    """q, query_id, filters, term, asked (times), idf, n_docs, bound (the most that the term adds) of the known terms of every query."""
    filters = [F.col(c).alias(f"f_{c}") if c in queries.columns else F.lit(None).cast("string").alias(f"f_{c}") for c in index.facets]
    rows = queries.select(F.monotonically_increasing_id().alias("q"), F.col(key).alias("query_id"), *filters, term_counts(F.col(text)).alias("counts"))
    # The number is made before the terms, in a step of its own.
    rows = rows.select("q", "query_id", *[f"f_{c}" for c in index.facets], F.inline("counts")).withColumnRenamed("times", "asked")
    rows = staged(rows, "lexical-query")
    idf = F.log(F.lit(1.0) + (F.lit(float(index.n_docs)) - F.col("n_docs") + F.lit(0.5)) / (F.col("n_docs") + F.lit(0.5)))
    known = index.terms.join(_sent(rows), "term").withColumn("idf", idf)
    bound = (_part(F.col("idf"), F.col("most")) * F.col("asked")).alias("bound")
    return staged(known.select("q", "query_id", *[f"f_{c}" for c in index.facets], "term", "asked", "idf", "n_docs", bound), "lexical-asked")


def _parts(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """q, query_id, n, id, score: a row for each posting of an asked term in a document that fits the query's filter."""
    fits = F.lit(True)
    for c in index.facets:
        fits = fits & (F.col(f"f_{c}").isNull() | (F.col(f"f_{c}") == F.col(c)))
    part = _part(F.col("idf"), _saturation(F.col("times"), F.col("length"), index.mean_length)) * F.col("asked")
    return index.postings.join(_sent(asked), "term").where(fits).select("q", "query_id", "n", "id", part.alias("score"))


def _sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("q", "query_id", "n", "id").agg(F.sum("score").alias("score"))


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n"))
    # A bounded row number is applied before the shuffle too.
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _threshold(sums: DataFrame, k: int) -> DataFrame:
    """q, least: the k-th best sum, of queries that have as many."""
    least = _best(sums, k).groupBy("q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
    return least.where(F.col("found") == k).select("q", "least")


def candidates(index: LexicalIndex, asked: DataFrame, k: int = TOP) -> tuple[DataFrame, DataFrame]:
    """Sums (q, query_id, n, id, score) of every document that may be among a query's best ``k``, and the terms that they leave out."""
    rarest = Window.partitionBy("q").orderBy("n_docs", "term").rowsBetween(Window.unboundedPreceding, -1)
    first = asked.withColumn("upto", F.coalesce(F.sum("n_docs").over(rarest), F.lit(0))).where(F.col("upto") < SEEDS).drop("upto")
    least = staged(_threshold(_sums(_parts(index, staged(first, "lexical-rarest"))), k), "lexical-least")
    weakest = Window.partitionBy("q").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    terms = asked.join(least, "q", "left").withColumn("together", F.sum("bound").over(weakest))
    terms = staged(terms.withColumn("weak", F.coalesce(F.col("together") < F.col("least"), F.lit(False))).drop("least", "together"), "lexical-weighed")
    weak = staged(terms.where("weak").drop("weak"), "lexical-weak")
    sums = staged(_sums(_parts(index, staged(terms.where("NOT weak").drop("weak"), "lexical-strong"))), "lexical-sums")
    lift = weak.groupBy("q").agg(F.sum("bound").alias("lift"))
    # The best by these sums in full: the k-th of their scores is the better bound.
    best = staged(_best(sums, k).drop("place"), "lexical-best")
    least = _threshold(_sums(best.unionByName(_parts_of(index, weak, best))), k).join(lift, "q", "left").select("q", (F.col("least") - F.coalesce("lift", F.lit(0))).alias("needed"))
    left = sums.join(staged(least, "lexical-needed"), "q", "left").where(F.col("needed").isNull() | (F.col("score") >= F.col("needed")))
    return staged(left.drop("needed"), "lexical-candidates"), weak


def _parts_of(index: LexicalIndex, asked: DataFrame, documents: DataFrame) -> DataFrame:
    """``_parts`` of the (q, n) in ``documents`` (written) alone."""
    met = F.col("q").eqNullSafe(F.col("c_q")) & (F.col("n") == F.col("c_n"))
    return _parts(index, asked).join(_sent(documents.select(F.col("q").alias("c_q"), F.col("n").alias("c_n"))), met, "left_semi")


@dataclass(frozen=True)
class Asked:
    """The queries as tasks get them: distinct terms with their weights, the queries of each (``starts`` into ``query`` and ``times``), and filters."""

    terms: pa.Array
    idf: np.ndarray
    starts: np.ndarray
    query: np.ndarray
    times: np.ndarray
    q: np.ndarray
    filters: tuple[tuple[pa.Array, np.ndarray], ...]


def _asked(rows: pa.Table, facets: tuple[str, ...]) -> Asked:
    """``query_terms`` by term; a query that does not filter by a facet has -2 there, others the number of its value."""
    rows = rows.combine_chunks()
    coded = rows.column("term").combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    q, first, query = np.unique(rows.column("q").to_numpy(), return_index=True, return_inverse=True)
    _, of_term = np.unique(code, return_index=True)
    starts = np.searchsorted(code[order], np.arange(len(of_term) + 1))
    filters = []
    for c in facets:
        wanted = rows.column(f"f_{c}").combine_chunks().take(pa.array(first))
        values = pc.unique(wanted.drop_null())
        filters.append((values, pc.fill_null(pc.index_in(wanted, value_set=values, skip_nulls=True), -2).to_numpy(zero_copy_only=False)))
    return Asked(coded.dictionary, rows.column("idf").to_numpy()[of_term], starts, query[order], rows.column("asked").to_numpy()[order].astype(np.int64), q, tuple(filters))


def _first(rows: pa.Table, k: int) -> pa.Table:
    """The best ``k`` rows of each query."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending"), ("n", "ascending")], null_placement="at_end"))
    q = rows.column("q").to_numpy()
    return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def best_batches(batches: Iterator[pa.RecordBatch], asked: Asked, facets: tuple[str, ...], mean_length: float, k: int) -> Iterator[pa.RecordBatch]:
    """q, n, id, score of a task's best ``k`` documents of every query."""
    kept, waiting, n_waiting = None, [], 0
    n_q, per_term = len(asked.q), np.diff(asked.starts)
    least = np.zeros(n_q, np.int64)
    for batch in batches:
        counts = batch.column("counts")
        ends, flat = counts.offsets.to_numpy().astype(np.int64), counts.values
        found = pc.index_in(flat.field("term"), value_set=asked.terms)
        at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        term = found.drop_null().to_numpy(zero_copy_only=False)
        times = flat.field("times").to_numpy(zero_copy_only=False)[at].astype(float)
        doc = np.searchsorted(ends, at, "right") - 1
        length = batch.column("length").to_numpy(zero_copy_only=False).astype(float)[doc]
        part = np.floor(UNIT * asked.idf[term] * (times * (K1 + 1) / (times + K1 * ((1 - B) + B * length / mean_length)))).astype(np.int64)
        facet = [pc.fill_null(pc.index_in(batch.column(c), value_set=values, skip_nulls=True), -1).to_numpy(zero_copy_only=False) for c, (values, _) in zip(facets, asked.filters)]
        # Documents are taken so many at once that scores and parts have a bound (one document at least).
        pairs = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=per_term[term], minlength=batch.num_rows))])
        a = 0
        while a < batch.num_rows:
            b = min(batch.num_rows, max(a + 1, min(a + CELLS // n_q, int(np.searchsorted(pairs, pairs[a] + CELLS, "right")) - 1)))
            mine = slice(*np.searchsorted(doc, [a, b]))
            repeat = per_term[term[mine]]
            which = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat - asked.starts[term[mine]], repeat)
            cell = np.repeat(doc[mine] - a, repeat) * n_q + asked.query[which]
            # Sums of whole numbers below 2**53 are exact.
            score = np.bincount(cell, weights=np.repeat(part[mine], repeat) * asked.times[which], minlength=(b - a) * n_q).astype(np.int64).reshape(b - a, n_q)
            fits = (np.bincount(cell, minlength=(b - a) * n_q) > 0).reshape(b - a, n_q)
            for code, (_, wanted) in zip(facet, asked.filters):
                fits &= (wanted == -2) | (code[a:b, None] == wanted)
            if b - a > k:
                least = np.maximum(least, np.partition(np.where(fits, score, 0), -k, axis=0)[-k])
            row, query = np.nonzero(fits & (score >= least))
            index = pa.array(row + a)
            waiting.append(pa.table({"q": query, "n": batch.column("n").take(index), "id": batch.column("id").take(index), "score": score[row, query]}))
            n_waiting += len(row)
            if n_waiting > max(CELLS // 4, k * n_q):
                kept = _first(pa.concat_tables([*([kept] if kept else []), *waiting]), k)
                waiting, n_waiting = [], 0
                q = kept.column("q").to_numpy()
                full = np.bincount(q, minlength=n_q) == k
                last = np.searchsorted(q, np.flatnonzero(full), "right") - 1
                least[full] = np.maximum(least[full], kept.column("score").to_numpy()[last])
            a = b
    if kept or waiting:
        kept = _first(pa.concat_tables([*([kept] if kept else []), *waiting]), k)
        yield from kept.set_column(0, "q", pa.array(asked.q[kept.column("q").to_numpy()])).to_batches(BATCH)


def _search_at_once(index: LexicalIndex, asked: DataFrame, k: int) -> DataFrame:
    """q, query_id, n, id, score of each task's best documents; the queries' terms are sent."""
    spark, facets, mean = asked.sparkSession, index.facets, index.mean_length
    kinds = dict(index.documents.dtypes)
    rows = asked.select("q", *[F.col(f"f_{c}").cast(kinds[c]).alias(f"f_{c}") for c in facets], "term", "asked", "idf").toArrow()
    sent = spark.sparkContext.broadcast(_asked(rows, facets))
    found = index.documents.select("n", "id", *facets, "length", "counts").mapInArrow(lambda it: best_batches(it, sent.value, facets, mean, k), f"q long, n long, id {kinds['id']}, score long")
    return found.join(F.broadcast(asked.select("q", "query_id").distinct()), "q")


def search(index: LexicalIndex, queries: DataFrame, k: int = TOP, key: str = "query_id", text: str = "text") -> DataFrame:
    """query_id, place, id, score of the best ``k`` documents of every query, exactly.

    ``queries`` may have columns of the facets' names, whose values filter.
    """
    asked = query_terms(index, queries, key, text)
    size = asked.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("q").alias("queries")).first()
    if 0 < size["terms"] <= SENT and size["queries"] <= QUERIES:
        scored = _search_at_once(index, asked, k)
    else:
        sums, weak = candidates(index, asked, k)
        scored = _sums(sums.unionByName(_parts_of(index, weak, sums)))
    return _best(scored, k).select("query_id", "place", "id", "score")


def table_documents(tables: DataFrame, documents: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id, text, company_code, report_year, statement_type: what a release's table is found by.

    The text has title, statement, company, year, unit, and the canonical metrics of the table's rows.
    """
    metrics = cells.groupBy("table_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set("row_label_canonical"))).alias("metrics"))
    rows = tables.join(documents.select("doc_id", "company_code", "report_year"), "doc_id").join(metrics, "table_id", "left")
    words = F.concat_ws(" ", "title_raw", "statement_type", "company_code", F.col("report_year").cast("string"), "unit_normalized", "metrics")
    return rows.select("table_id", F.replace(words, F.lit("_"), F.lit(" ")).alias("text"), "company_code", "report_year", "statement_type")
