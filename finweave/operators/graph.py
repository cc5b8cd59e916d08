"""One hop from found tables to others, over six kinds of edges, and the best few by their best path.

Tables are the nodes.  Edges are not written out, as a company's or a year's tables are linked each with each; a kind's
edges all lead through keys (a company, a year, a metric), and ``graph_keys`` is a row for each table and key.
What a search needs of a key is bounded: all tables behind one key are reached with one score, and ties go to the smaller
id, so a key's first ``top + seeds`` tables hold all that can be among the best ``top`` (at most ``seeds`` of them are found
already).  A key that a third of all tables have so costs as much as a small one; its first tables are taken
before the shuffle.

Edge cases: null companies, years, statements and metrics make no key; a table never leads to itself; a table that is
found has its own score, by the path of no edge; of equal paths the kind's order in ``KINDS`` counts, then the better seed,
the smaller one, the smaller key; scores are whole numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finweave.sources.tables import staged

#: Kinds of edges with the hundredths of a seed's score that they pass on, best first.
KINDS = {"explained_by_note": 80, "same_statement_type": 30, "adjacent_period": 60, "shared_metric": 50, "same_company": 40, "same_period": 20}
TOP, SEEDS = 6, 30


def _entry(kind: str, leads: Column, starts: Column, *parts: Column) -> Column:
    """One key of a table; null where one of its parts is."""
    key = F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), leads.alias("leads"), starts.alias("starts"))


def graph_keys(tables: DataFrame, notes: str = "notes") -> DataFrame:
    """table_id, kind, key, leads (the key leads to the table), starts (the table leads to the key).

    ``tables`` has table_id, doc_id, company_code, report_year, statement_type, metrics (array).  Adjacent periods are
    neighbouring years of one company; a note explains the other tables of its document.
    """
    year = F.col("report_year").cast("int")
    company, doc, statement = F.col("company_code"), F.col("doc_id"), F.col("statement_type")
    is_note = F.coalesce(statement == notes, F.lit(False))
    yes, no = F.lit(True), F.lit(False)
    one = [
        _entry("same_company", yes, yes, company), _entry("same_period", yes, yes, year), _entry("same_statement_type", yes, yes, statement), _entry("explained_by_note", is_note, ~is_note, doc),
        # A table stands at its own year, and starts from the years beside it.
        _entry("adjacent_period", yes, no, company, year), _entry("adjacent_period", no, yes, company, year - 1), _entry("adjacent_period", no, yes, company, year + 1),
    ]
    metrics = F.transform(F.array_distinct(F.coalesce("metrics", F.array().cast("array<string>"))), lambda m: _entry("shared_metric", yes, yes, m))
    rows = tables.select("table_id", F.inline(F.concat(F.array(*one), metrics)))
    return rows.where(F.col("key").isNotNull() & F.col("table_id").isNotNull())


def expand(keys: DataFrame, found: DataFrame, top: int = TOP, seeds: int = SEEDS, kinds: dict[str, int] | None = None) -> DataFrame:
    """query_id, place, table_id, score, kind, key, seed: the best ``top`` of found tables and those one edge away.

    ``found`` has (query_id, table_id, score) with at most ``seeds`` rows for each query, the first by score where there are more.
    ``kind``, ``key`` and ``seed`` tell the path; they are null for a table that was found.
    """
    kinds = kinds or KINDS
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "table_id")
    found = staged(found.select("query_id", "table_id", F.col("score").cast("long").alias("score")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= seeds).drop("nth"), "graph-seeds")
    nth = Window.partitionBy("kind", "key").orderBy("to")
    # Bounded row numbers are taken before the shuffle, so a hub's tables never meet.
    first = keys.where("leads").select("kind", "key", F.col("table_id").alias("to")).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= top + seeds).drop("nth")
    starts = keys.where("starts").select("kind", "key", "table_id").join(found, "table_id").select("query_id", F.col("table_id").alias("seed"), "score", "kind", "key")
    # Of a query's seeds behind one key the best one leads to all others, and the next best to it.
    best = starts.groupBy("query_id", "kind", "key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "seed")).alias("best"))
    others = starts.join(best, ["query_id", "kind", "key"]).where(F.col("seed") != F.col("best.seed"))
    others = others.groupBy("query_id", "kind", "key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "seed")).alias("best"))
    paths = best.unionByName(others).select("query_id", "kind", "key", F.col("best.seed").alias("seed"), (-F.col("best.minus")).alias("score"))
    share = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("kind"))
    reached = paths.join(first, ["kind", "key"]).where(F.col("to") != F.col("seed"))
    place = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)]), F.col("kind"))
    reached = reached.where(share.isNotNull()).select("query_id", F.col("to").alias("table_id"), F.floor(F.col("score") * share / 100).cast("long").alias("score"), F.col("score").alias("of_seed"), place.alias("order"), "kind", "key", "seed")
    own = found.select("query_id", "table_id", "score", F.col("score").alias("of_seed"), F.lit(-1).alias("order"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("seed"))
    path = F.min(F.struct((-F.col("score")).alias("minus"), "order", (-F.col("of_seed")).alias("minus_seed"), "seed", "key", "kind")).alias("path")
    rows = own.unionByName(reached).groupBy("query_id", "table_id").agg(path, F.max(F.when(F.col("order") < 0, F.col("score"))).alias("found"))
    # What was found stays with its own score.
    mine = F.col("found").isNotNull()
    rows = rows.select("query_id", "table_id", F.coalesce("found", -F.col("path.minus")).alias("score"), *[F.when(~mine, F.col(f"path.{c}")).alias(c) for c in ("kind", "key", "seed")])
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("query_id", "place", "table_id", "score", "kind", "key", "seed")
