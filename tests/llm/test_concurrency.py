"""The sweep against a plain one, over several blocks and spans, and on odd rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from finweave.llm import concurrency

UTC = dt.timezone.utc


def brute_sweep(intervals):
    """(group, moment) to (next moment, open, worth, highest so far, is peak), interval by interval."""
    net = {}
    for group, start, end, worth in intervals:
        if start is None or (end is not None and end <= start):
            continue
        for at, sign in ((start, 1), (end, -1)):
            if at is not None:
                n, w = net.setdefault(group, {}).get(at, (0, 0))
                net[group][at] = (n + sign, w + sign * worth)
    out = {}
    for group, by in net.items():
        moments = [m for m in sorted(by) if by[m] != (0, 0)]
        n = w = high = 0
        high = None
        rows = []
        for m in moments:
            n, w = n + by[m][0], w + by[m][1]
            high = n if high is None else max(high, n)
            rows.append((m, n, w, high))
        top = max((r[2] for r in rows), default=None)
        for r, after in zip(rows, [*moments[1:], None]):
            out[group, r[0]] = (after, r[1], r[2], r[3], r[2] == top)
    return out


@pytest.mark.parametrize("spread", [40, 5_000, 4_000_000])
def test_sweep_equals_brute_force(spark, spread):
    rng = random.Random(spread)
    rows = []
    for _ in range(1500):
        start = rng.randint(-spread, spread)
        rows.append((rng.choice([0, 0, 0, 1, -1, 7]), rng.choice([start, start, start, None]), rng.choice([None, start + rng.randint(-3, spread)]), rng.choice([0, 5, 5, -2])))
    rows += [(9, 10, 20, 3), (9, 20, 30, 3), (9, 30, 40, 4)]
    intervals = spark.createDataFrame(rows, "group int, start long, end long, worth long")
    got = {(r["group"], r["minute"]): tuple(r)[2:] for r in concurrency.sweep(concurrency.changes(intervals)).collect()}
    assert got == brute_sweep(rows)
    # An end that meets an equal start changes nothing there; one that meets another worth does.
    assert (9, 20) not in got and got[9, 30] == (40, 1, 4, 1, True)


def sale(i, client, sold, total, extra="x"):
    return (i, client, sold, total, extra)


SALES = "sale_id long, client_id long, sold_at {}, total double, nation_id string"
LINES = "sale_id long, shipped_at {}, total int"
CLIENTS = "client_id long, nation_id int, sale_id int"


@pytest.mark.parametrize("kind,zone", [("timestamp_ntz", "America/New_York"), ("timestamp", "Asia/Kolkata")])
def test_sales_in_any_session_zone(spark, kind, zone):
    """Seconds are those of UTC, in zones with and without a change of clocks; extra columns with clashing names are left alone."""
    tz = None if kind == "timestamp_ntz" else UTC
    at = lambda *x: dt.datetime(*x, tzinfo=tz)
    sold = at(2024, 3, 10, 2, 30, 59)
    sales = [sale(1, 1, sold, 1.005), sale(2, 2, sold, None), sale(None, 3, at(1969, 12, 31, 23, 59, 30), 2.0), sale(4, None, None, 5.0), sale(5, 1, at(2024, 3, 20), float("nan")), sale(6, 9, at(2024, 3, 11), 7.0), sale(6, 9, at(2024, 3, 11), 7.0)]
    lines = [(1, at(2024, 3, 12, 2, 31), 0), (1, at(2024, 3, 11, 2, 31, 5), 0), (1, None, 0), (5, at(2024, 3, 1), 0), (None, at(2024, 1, 1), 0)]
    clients = [(1, 3, 0), (1, 4, 0), (2, None, 0), (3, 3, 0), (None, 5, 0)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        tables = [spark.createDataFrame(rows, schema.format(kind)) for rows, schema in ((sales, SALES), (lines, LINES), (clients, CLIENTS))]
        got = {(r["nation_id"], r["from_s"]): (r["n_open"], r["open_cents"]) for r in concurrency.peak_concurrency(*tables).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    s = lambda *x: int(dt.datetime(*x, tzinfo=UTC).timestamp())
    start, end, late = s(2024, 3, 10, 2, 30), s(2024, 3, 18, 2, 31), s(2024, 3, 11)
    # 100 * 1.005 is a little below 100.5; a sale shipped before it was sold, by more than the week, takes no part.
    assert got == {
        (3, -60): (1, 200), (3, start): (2, 300), (3, end): (1, 200), (-1, start): (1, 0), (-1, late): (3, 1400),
        (-2, -60): (1, 200), (-2, start): (3, 300), (-2, late): (5, 1700), (-2, end): (4, 1600),
    }


def test_empty_tables(spark):
    tables = [spark.createDataFrame([], schema.format("timestamp_ntz")) for schema in (SALES, LINES, CLIENTS)]
    out = concurrency.peak_concurrency(*tables)
    assert out.columns == ["nation_id", "from_s", "to_s", "n_open", "open_cents", "high_open", "is_peak"] and out.collect() == []


def test_no_window_holds_a_group(spark):
    """Half of all rows are one group's, and no window has more rows than a block has minutes."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(-2).alias("group"), (F.col("id") * 7 % 50_000).alias("start"), (F.col("id") * 7 % 50_000 + 13).alias("end"), F.lit(1).cast("long").alias("worth"))
    out = concurrency.sweep(concurrency.changes(rows))
    most = out.groupBy("group", F.shiftright("minute", concurrency.BLOCK_BITS)).count().agg(F.max("count")).first()[0]
    assert most <= 2**concurrency.BLOCK_BITS
    hot = out.where("`group` = -2")
    assert hot.count() > 10 * most
