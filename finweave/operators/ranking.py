"""Ranked lists: fusion by reciprocal ranks, and their measures against judgements.

A list has rows (query_id, place, id), places from 1.  Lists may lack members, and queries, that others have.

Edge cases: rows without a place, a query or an id take no part; a list that holds an id twice for a query counts its best
place; judged ids that are listed twice count once; queries without a relevant id are counted (``n_unjudged``) and take no part in
means; a query that has relevant ids and no list has measures of 0; empty tables give no rows (measures: one row of nulls where no group is asked for).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added to each place, so that the first places do not decide alone; a score's unit.
SMOOTHING, UNIT = 60, 10**9
CUTS = (3, 5, 10)


def in_places(rows: DataFrame, score: str = "score") -> DataFrame:
    """Places by score, best first; ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc_nulls_last(), F.col("id"))
    return rows.withColumn("place", F.row_number().over(order))


def _clean(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.col("query_id").isNotNull() & F.col("id").isNotNull() & F.col("place").isNotNull())
    return rows.groupBy("query_id", "id").agg(F.min("place").alias("place"))


def fuse(lists: dict[str, DataFrame], top: int = 30, weights: dict[str, int] | None = None, penalty: Column | None = None) -> DataFrame:
    """query_id, place, id, score, and the place in each list (null where it lacks the id), of the best ``top`` ids.

    A score is the sum of ``weight / (SMOOTHING + place)`` in whole billionths, each rounded down, so that it does not
    depend on the lists' order.  ``penalty`` (of query_id, id and the lists' places) is taken off, as for an id whose company or period contradicts the query.
    """
    weights = weights or {}
    names = list(lists)
    rows = [_clean(lists[n]).select("query_id", "id", F.lit(i).alias("of"), "place", F.floor(F.lit(UNIT * weights.get(n, 1)) / (F.col("place") + SMOOTHING)).alias("part")) for i, n in enumerate(names)]
    each = [F.max(F.when(F.col("of") == i, F.col("place"))).alias(f"place_{n}") for i, n in enumerate(names)]
    met = reduce(DataFrame.unionByName, rows).groupBy("query_id", "id").agg(F.sum("part").alias("score"), *each)
    if penalty is not None:
        met = met.withColumn("score", F.col("score") - F.coalesce(penalty, F.lit(0)).cast("long"))
    return in_places(met).where(F.col("place") <= top).select("query_id", "place", "id", "score", *[f"place_{n}" for n in names])


def query_measures(ranked: DataFrame, judged: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """query_id, n_relevant, n_listed, reciprocal (of the first relevant place), and precision, recall and F2 at every cut.

    ``judged`` has (query_id, id, relevant).  Precision at a cut divides by the cut, also where the list is shorter.
    """
    listed = _clean(ranked)
    wanted = judged.where(F.col("relevant") & F.col("query_id").isNotNull() & F.col("id").isNotNull()).select("query_id", "id").distinct()
    hits = wanted.join(listed, ["query_id", "id"], "left").groupBy("query_id")
    hits = hits.agg(F.count(F.lit(1)).alias("n_relevant"), F.min("place").alias("first"), *[F.count(F.when(F.col("place") <= k, 1)).alias(f"hits_{k}") for k in cuts])
    lengths = listed.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_listed"))
    everyone = judged.where(F.col("query_id").isNotNull()).select("query_id").distinct()
    rows = everyone.join(lengths, "query_id", "left").join(hits, "query_id", "left")
    out = [F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), F.coalesce("n_listed", F.lit(0)).alias("n_listed"), F.when(F.col("n_relevant") > 0, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("reciprocal")]
    for k in cuts:
        precision, recall = F.col(f"hits_{k}") / F.lit(float(k)), F.col(f"hits_{k}") / F.col("n_relevant")
        # F2 weighs recall four times as much.
        f2 = F.when(F.col(f"hits_{k}") == 0, F.lit(0.0)).otherwise(5 * precision * recall / (4 * precision + recall))
        out += [precision.alias(f"precision_{k}"), recall.alias(f"recall_{k}"), F.when(recall.isNotNull(), f2).alias(f"f2_{k}")]
    return rows.select("query_id", *out)


def measures(per_query: DataFrame, cuts: tuple[int, ...] = CUTS, by: tuple[str, ...] = ()) -> DataFrame:
    """n_queries, n_unjudged, mrr, and the means of the measures at every cut, by columns such as a question's intent."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    out = [F.count(F.lit(1)).alias("n_queries"), F.count(F.when(F.col("n_relevant") == 0, 1)).alias("n_unjudged"), mean("reciprocal", "mrr")]
    out += [mean(f"{m}_{k}", f"{m}_{k}") for k in cuts for m in ("precision", "recall", "f2")]
    return per_query.groupBy(*by).agg(*out)


def failures(ranked: DataFrame, judged: DataFrame, cut: int = 10) -> DataFrame:
    """query_id, id, place, reason of relevant ids that the first ``cut`` places lack: ``not_listed`` or ``below_cut``."""
    wanted = judged.where(F.col("relevant") & F.col("query_id").isNotNull() & F.col("id").isNotNull()).select("query_id", "id").distinct()
    rows = wanted.join(_clean(ranked), ["query_id", "id"], "left").where(F.col("place").isNull() | (F.col("place") > cut))
    return rows.withColumn("reason", F.when(F.col("place").isNull(), F.lit("not_listed")).otherwise(F.lit("below_cut")))
