"""Peak concurrency: how many intervals of a group are open at each moment, and when most are.

Every interval gives a +1 and its worth at its start and the opposite at its end.  These are summed by
group and minute (sums before the shuffle), and moments whose sums are both zero are left out.  Running
sums, the next moment, the running maximum and the overall maximum are window functions, at three levels,
so that no window holds a group: minutes within a block of 1,024 minutes, blocks within a span of 1,024
blocks, and the spans of a group.  A timestamp has less than 2**33 minutes, so a window never has more than
1,024 rows at the first two levels and about 8,000 at the last, whatever the number of intervals.

What is joined to rows (first end by key, group by key) is aggregated and written first, so that Spark may
split a key that a third of all rows have.

Edge cases: intervals without a start, or that do not end after it, take no part; no end means open
forever; a worth of null, or of no finite number, is 0; an empty table gives an empty result; other columns
are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from finweave.llm.common import discard, materialize, scratch_scope

#: Bits of a minute's number within a block, and of a block's within a span.
BLOCK_BITS, SPAN_BITS = 10, 10
ALL_NATIONS, NO_NATION = -2, -1
#: A sale stays open for so long after its first shipment.
AFTER_SHIPPING = 7 * 24 * 60


def minute_of(df: DataFrame, column: str) -> Column:
    """Whole minutes since 1970 in UTC; a time without a zone is one in UTC.  Null stays null."""
    t = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        return F.unix_date(t.cast("date")).cast("long") * 1440 + F.hour(t) * 60 + F.minute(t)
    return F.floor(F.unix_micros(t) / F.lit(60_000_000).cast("decimal(20,0)")).cast("long")


def worth_in_cents(column: str) -> Column:
    """Nearest cent, halves up; null and what is no finite number are 0."""
    x = F.col(column).cast("double")
    return F.when(F.abs(x) < F.lit(9e16), F.floor(F.lit(100.0) * x + F.lit(0.5))).otherwise(F.lit(0)).cast("long")


def changes(intervals: DataFrame) -> DataFrame:
    """group, minute, d_open, d_worth of every moment at which intervals (group, start, end, worth) change something."""
    ordered = intervals.where(F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
    event = lambda minute, sign: F.struct(F.col(minute).alias("minute"), F.lit(sign).cast("long").alias("d_open"), (F.col("worth") * sign).alias("d_worth"))
    each = ordered.select("group", F.explode(F.array(event("start", 1), event("end", -1))).alias("e")).select("group", "e.*").where(F.col("minute").isNotNull())
    net = each.groupBy("group", "minute").agg(F.sum("d_open").alias("d_open"), F.sum("d_worth").alias("d_worth"))
    return net.where((F.col("d_open") != 0) | (F.col("d_worth") != 0))


def _before(value: Column, window: Window) -> Column:
    """Of all earlier rows of the window."""
    return value.over(window.rowsBetween(Window.unboundedPreceding, -1))


def _level(rows: DataFrame, within: list[str], order: str) -> DataFrame:
    """Adds to rows (sums n, c; maxima of n and c within; first minute) what stands before each within its window, and the next one's first minute."""
    window = Window.partitionBy(*within).orderBy(order)
    started = rows.withColumns({"n_before": F.coalesce(_before(F.sum("n"), window), F.lit(0)), "c_before": F.coalesce(_before(F.sum("c"), window), F.lit(0)), "follows": F.lead("first").over(window)})
    # Maxima from the window's start on.
    raised = started.withColumns({"n_most": F.col("n_most") + F.col("n_before"), "c_most": F.col("c_most") + F.col("c_before")})
    return raised.withColumn("n_high", _before(F.max("n_most"), window))


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.max("n_most").alias("n_most"), F.max("c_most").alias("c_most"), F.min("first").alias("first"))


def sweep(net: DataFrame) -> DataFrame:
    """group, minute, to_minute, n_open, worth, high_open, is_peak for rows of ``changes``."""
    rows = net.select("group", F.shiftright("minute", BLOCK_BITS).alias("block"), "minute", "d_open", "d_worth")
    inside = Window.partitionBy("group", "block").orderBy("minute")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("group", "block", "minute", "d_open", "d_worth", F.sum("d_open").over(upto).alias("n_open"), F.sum("d_worth").over(upto).alias("worth"), F.lead("minute").over(inside).alias("to_minute"))
    rows = materialize(rows.withColumn("n_high", F.max("n_open").over(upto)), "sweep-moments")
    blocks = rows.groupBy("group", "block").agg(F.sum("d_open").alias("n"), F.sum("d_worth").alias("c"), F.max("n_open").alias("n_most"), F.max("worth").alias("c_most"), F.min("minute").alias("first"))
    blocks = _level(blocks.withColumn("span", F.shiftright("block", SPAN_BITS)), ["group", "span"], "block")
    spans = _level(_summed(blocks, "group", "span"), ["group"], "span").withColumn("peak", F.max("c_most").over(Window.partitionBy("group")))
    s = spans.select("group", "span", F.col("n_before").alias("s_n"), F.col("c_before").alias("s_c"), F.col("n_high").alias("s_high"), F.col("follows").alias("s_follows"), "peak")
    # One row for each block, never more than there are minutes on the calendar.
    known = blocks.join(s, ["group", "span"]).select(
        "group", "block", (F.col("n_before") + F.col("s_n")).alias("b_n"), (F.col("c_before") + F.col("s_c")).alias("b_c"), F.coalesce("follows", "s_follows").alias("b_follows"), "peak",
        # A null is left out by greatest.
        F.greatest(F.col("n_high") + F.col("s_n"), F.col("s_high")).alias("b_high"),
    )
    known = materialize(known, "sweep-blocks")
    out = rows.join(known, ["group", "block"])
    worth = F.col("worth") + F.col("b_c")
    return out.select(
        "group", "minute", F.coalesce("to_minute", "b_follows").alias("to_minute"), (F.col("n_open") + F.col("b_n")).alias("n_open"), worth.alias("worth"),
        F.greatest(F.col("n_high") + F.col("b_n"), F.col("b_high")).alias("high_open"), (worth == F.col("peak")).alias("is_peak"),
    )


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame) -> DataFrame:
    """group (the client's nation, and again -2 for all), start, end, worth of every sale.

    A sale ends a time after its first shipment.  Of a client with several rows the smallest nation counts.
    """
    shipped = lines.select("sale_id", minute_of(lines, "shipped_at").alias("shipped")).where(F.col("sale_id").isNotNull() & F.col("shipped").isNotNull())
    shipped = materialize(shipped.groupBy("sale_id").agg(F.min("shipped").alias("shipped")), "sweep-shipped")
    nations = materialize(clients.where(F.col("client_id").isNotNull()).groupBy("client_id").agg(F.min("nation_id").cast("int").alias("nation_id")), "sweep-nations")
    rows = sales.select("sale_id", "client_id", minute_of(sales, "sold_at").alias("start"), worth_in_cents("total").alias("worth")).where(F.col("start").isNotNull())
    rows = rows.join(shipped, "sale_id", "left").join(nations, "client_id", "left")
    nation = F.coalesce("nation_id", F.lit(NO_NATION))
    return rows.select(F.explode(F.array(nation, F.lit(ALL_NATIONS))).alias("group"), "start", (F.col("shipped") + AFTER_SHIPPING).alias("end"), "worth")


def peak_concurrency(sales: DataFrame, lines: DataFrame, clients: DataFrame) -> DataFrame:
    """nation_id, from_s, to_s, n_open, open_cents, high_open, is_peak of every moment at which a nation's open sales change."""
    with scratch_scope(sales.sparkSession):
        net = materialize(changes(open_sales(sales, lines, clients)), "sweep-changes")
    out = sweep(net)
    discard(net)
    return out.select(F.col("group").alias("nation_id"), (F.col("minute") * 60).alias("from_s"), (F.col("to_minute") * 60).alias("to_s"), "n_open", F.col("worth").alias("open_cents"), "high_open", "is_peak")
