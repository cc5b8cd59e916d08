"""Mixing sources to target weights by systematic sampling.

A source's documents stand in a fixed order, by size class and then by a hash of the id.  Every
document expects ``target / source_size`` copies; the running sum of these, moved by one random
offset for the source, crosses some integers within each document, and each crossing emits the
document once.  As the order is by size, the emitted words follow the target to about the size of one
document; nothing is tried twice or chosen by its result.

The running sum needs each document's place in its source.  Rows that the order cannot tell apart
(equal id and size, as rows without an id have) are counted first and stand as one row with a number.
No window ever holds a source: counts of (source, size class, hash range) give each range's start,
where the number of ranges follows the class's count, and a window only orders one range of about
``RANGE_ROWS`` rows.  A source, a single size or a group of equal rows that holds a third of all rows
is spread like the others.

Edge cases: null text has size 0; null source is a source of its own, last in order; documents of
size 0 are kept with 0 taken; rows that share an id keep separate places (ties by size); an empty
table gives an empty result; no text at all gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finweave.llm.common import clean_text, free_prefix, materialize, scratch_scope, shuffle_partitions, unit_hash

#: Words in the sense of the mix: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one window orders, and rows that are made of one in a task at once.
RANGE_ROWS = 4096
#: Size classes in each doubling of the size.
CLASSES = 16
SEED = "mix-1"


def n_words(column: str = "text") -> Column:
    return F.regexp_count(clean_text(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, n_docs, target of every source; one row for each source.

    Targets fill like water: each is ``level * weight`` unless that is above ``most`` times the
    source's size.  In order of size over weight the full sources come first, so running sums give
    every possible level and the right one is the first that does not fill the next source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    from_here = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("filled", F.coalesce(F.sum("source_size").over(upto), F.lit(0))).withColumn("open", F.sum("weight").over(from_here)).withColumn("total", F.sum("source_size").over(everything))
    level = (F.lit(float(share)) * F.col("total") - F.lit(float(most)) * F.col("filled")) / F.col("open")
    per = per.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.lit(float(most)) * F.col("source_size"))
    per = per.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    cap = F.lit(float(most)) * F.col("source_size")
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), cap), cap)
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def place_in_source(sizes: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows of (doc_id, source, size, key) that are alike as one, with their number ``n_rows`` and the ``place`` (from 0) of the first.

    Sources are compared null-safe through (source is null, source or empty).
    """
    rows = sizes.withColumn("s_null", F.col("source").isNull()).withColumn("s_key", F.coalesce("source", F.lit("")))
    rows = rows.groupBy("s_null", "s_key", "source", "doc_id", "size", "key").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = rows.withColumn("class", F.floor(F.log2(F.col("size") + F.lit(1.0)) * CLASSES).cast("int")).withColumn("u", unit_hash(F.col("doc_id"), seed=SEED))
    rows = materialize(rows, "mix-alike")
    key = ["s_null", "s_key", "class"]
    classes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("ranges", F.ceil(F.col("n") / range_rows)).drop("n")
    # Written, so that Spark knows its size and may send it to the rows, or split a class that very many have.
    classes = materialize(classes, "mix-classes")
    rows = rows.join(classes, key).withColumn("range", F.floor(F.col("u") * F.col("ranges")).cast("long")).drop("ranges")
    # Dealt by range: a join by class before would do for the windows, and a large class would be one task.
    rows = rows.repartition(*key, "range")
    starts = rows.groupBy(*key, "range").agg(F.sum("n_rows").alias("n"))
    before = Window.partitionBy("s_null", "s_key").orderBy("class", "range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*key, "range").orderBy("u", F.col("doc_id").asc_nulls_first(), "size", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Ordered before the join: the window's shuffle already is by the join's key.
    rows = rows.withColumn("upto", F.sum("n_rows").over(inside))
    return rows.join(starts, [*key, "range"]).withColumn("place", F.col("start") + F.col("upto") - F.col("n_rows")).drop("class", "u", "range", "start", "upto")


def _crossings(place: Column, n_rows: Column) -> Column:
    """Integers that the running sum crosses within ``n_rows`` rows from ``place`` on: their copies."""
    upto = lambda at: F.floor(F.col("expected") * at + F.col("offset"))
    return F.when(F.col("size") > 0, F.least(upto(place + n_rows) - upto(place), F.ceil("expected") * n_rows)).otherwise(F.lit(0)).cast("long")


def placed_rows(docs: DataFrame, key: Column, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, key, n_rows, place, source_size, target, expected, offset; ``key`` tells rows of one id and size apart.

    The texts are read once; every later step works on narrow written rows.
    """
    sizes = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), key.alias("key")), "mix-sizes")
    targets = source_targets(sizes, weights, share, most).select(F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s_key"), "source_size", "target")
    targets = targets.withColumn("offset", unit_hash(F.col("s_null"), F.col("s_key"), seed=f"{SEED}-offset"))
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return place_in_source(sizes).join(targets, ["s_null", "s_key"]).withColumn("expected", expected)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) for every row of ``docs`` (doc_id, source, text)."""
    placed = materialize(placed_rows(docs, F.lit(0), **options), "mix-placed")
    out = ["doc_id", "size", "source_size", "target"]
    each = lambda rows, n: rows.select(*out, "expected", "offset", F.explode(F.sequence(F.col("place"), F.col("place") + n - 1)).alias("place"))
    few = each(placed.where(F.col("n_rows") <= RANGE_ROWS), F.col("n_rows"))
    # A large group of equal rows is cut and dealt anew before its rows are made.
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(RANGE_ROWS).cast("long")))
    cut = placed.where(F.col("n_rows") > RANGE_ROWS).withColumn("at", at).repartition(shuffle_partitions(docs.sparkSession), "doc_id", "place", "at")
    cut = cut.withColumn("n_rows", F.least(F.col("n_rows") - F.col("at"), F.lit(RANGE_ROWS))).withColumn("place", F.col("place") + F.col("at"))
    rows = few.unionByName(each(cut, F.col("n_rows")))
    return rows.select(*out, (_crossings(F.col("place"), F.lit(1)) * F.col("size")).alias("taken"))


def row_digest(docs: DataFrame) -> Column:
    """Digest of all columns, so rows with equal digests are equal (maps are compared as JSON)."""
    kinds = dict(docs.dtypes)
    return F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if "map<" in kinds[c] else F.col(f"`{c}`") for c in docs.columns])


def copies_of(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, as often as ``copies`` (key, rows, copies) says.

    ``key`` is the row's digest, ``rows`` the number of rows that have it, ``copies`` the copies of all of them together.
    """
    # Names that no column of the caller has.
    p = free_prefix(docs, "k_")
    row, key, rows, n, at = (F.col(f"{p}{c}") for c in ("row", "key", "rows", "copies", "at"))
    copies = materialize(copies.select(*[F.col(c).alias(f"{p}{c}") for c in ("key", "rows", "copies")]), "row-copies")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.withColumn(f"{p}row", row_digest(docs)).join(copies.hint("shuffle_hash"), row == key)
    alone = joined.where(rows == 1).select(*columns, n)
    # Rows repeated in full: one of each stays before its copies are made.
    shared = joined.where(rows > 1).groupBy(key).agg(F.first(F.struct(*columns, n)).alias(f"{p}first")).select(f"{p}first.*")
    few = alone.unionByName(shared.where(n <= RANGE_ROWS))
    cut = shared.where(n > RANGE_ROWS).withColumn(f"{p}at", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(RANGE_ROWS).cast("long")))).repartition(shuffle_partitions(docs.sparkSession), at)
    cut = cut.withColumn(f"{p}copies", F.least(n - at, F.lit(RANGE_ROWS))).drop(f"{p}at")
    return few.unionByName(cut).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*columns)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs``, with all its columns, as often as the mix takes it.

    Copies are dealt to distinct rows: equal rows stand as one whose copies are their sum.
    """
    # What is left of the sampling is the copies of each row.
    with scratch_scope(docs.sparkSession):
        placed = placed_rows(docs, row_digest(docs), **options)
        copies = placed.select("key", F.col("n_rows").alias("rows"), _crossings(F.col("place"), F.col("n_rows")).alias("copies"))
        return copies_of(docs, copies.where("copies > 0"))
