"""Interval joins of tables with annotations, and the best one-to-one assignment."""

from __future__ import annotations

from collections.abc import Iterator
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finweave.sources.tables import staged

MIN_OVERLAP = 80
#: Lines of a bin in which intervals meet, and of one in which runs are found.
BIN, RUN = 64, 4096


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1)


def _bins(df: DataFrame, name: str) -> DataFrame:
    """A row for each bin of lines that (line_start, line_end) has a part in."""
    of = lambda line: F.floor(line / BIN).cast("long")
    first, last = F.least("line_start", "line_end"), F.greatest("line_start", "line_end")
    return df.withColumn(name, F.explode(F.sequence(of(first), of(last))))


def _bin_of(line: Column) -> Column:
    return F.floor(line / BIN).cast("long")


def overlapping_pairs(expected: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, annotation_id, table_id, exact, overlap, span, distance of pairs that share lines.

    Rows meet by document and bin of ``BIN`` lines, so one large document is as many keys as it has bins; a pair
    counts in the bin of its later start alone.
    """
    e = _bins(expected.select("doc_id", "annotation_id", "line_start", "line_end"), "bin").alias("e")
    t = _bins(tables.select("doc_id", "table_id", "line_start", "line_end"), "bin").alias("t")
    es, ee, ts, te = (F.col(c) for c in ("e.line_start", "e.line_end", "t.line_start", "t.line_end"))
    meet = (F.col("e.doc_id") == F.col("t.doc_id")) & (F.col("e.bin") == F.col("t.bin")) & (es <= te) & (ts <= ee) & (F.col("e.bin") == _bin_of(F.greatest(es, ts)))
    return e.join(t, meet).select("e.doc_id", "e.annotation_id", "t.table_id", ((es == ts) & (ee == te)).cast("int").alias("exact"), overlap(es, ee, ts, te).cast("long").alias("overlap"), (ee - es + 1).cast("long").alias("span"), (F.abs(es - ts) + F.abs(ee - te)).cast("long").alias("distance"))


def containing_table(candidates: DataFrame, tables: DataFrame) -> DataFrame:
    """Each candidate with the table that holds its lines under its ordinal or as a continued table; they meet by document and bin of lines."""
    c, t = candidates.withColumn("_bin", _bin_of(F.col("line_start"))).alias("c"), _bins(tables, "_bin").alias("t")
    inside = (F.col("c.doc_id") == F.col("t.doc_id")) & (F.col("c._bin") == F.col("t._bin")) & (F.col("t.line_start") <= F.col("c.line_start")) & (F.col("t.line_end") >= F.col("c.line_end"))
    own = (F.col("t.source_ordinal") == F.col("c.ordinal")) | F.array_contains("t.evidence", "continued_across_page")
    return c.join(t, inside & own).select("c.*", F.col("t.table_id").alias("canonical_table_id")).drop("_bin")


def assignment_parts(pairs: DataFrame, expected: DataFrame) -> DataFrame:
    """``pairs`` with ``part``: pairs that share an annotation or a table, directly or over others, have one part.

    Pairs are in one part where the lines between their annotations' ends run on without a gap (tables reach over such
    gaps with what they overlap), which may join parts but cuts none.  The runs are found by the greatest end so far, within bins of starts and then over a document's bins, so no
    window holds a document's pairs.
    """
    lines = expected.select("doc_id", "annotation_id", F.col("line_start").alias("_from"), F.col("line_end").alias("_to"))
    # What a table reaches: from the first to the last of its annotations.
    spans = pairs.select("doc_id", "annotation_id", "table_id").join(lines, ["doc_id", "annotation_id"])
    spans = spans.groupBy("doc_id", "table_id").agg(F.min("_from").alias("first"), F.max("_to").alias("last"))
    spans = staged(spans.withColumn("bin", F.floor(F.col("first") / RUN).cast("long")), "assignment-spans")
    inside = Window.partitionBy("doc_id", "bin").orderBy("first", F.col("last").desc(), "table_id")
    over = Window.partitionBy("doc_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.groupBy("doc_id", "bin").agg(F.max("last").alias("last")).select("doc_id", "bin", F.max("last").over(over).alias("before"))
    rows = spans.withColumn("here", F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1))).join(reach, ["doc_id", "bin"])
    far = F.greatest("here", "before")
    # A span starts a run where nothing before reaches it; the last start at or before a span names its run.
    rows = staged(rows.withColumn("start", F.when(far.isNull() | (F.col("first") > far), F.col("first"))).select("doc_id", "bin", "table_id", "first", "last", "start"), "assignment-starts")
    starts = rows.groupBy("doc_id", "bin").agg(F.max("start").alias("start")).select("doc_id", "bin", F.max("start").over(over).alias("earlier"))
    named = rows.withColumn("own", F.max("start").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(starts, ["doc_id", "bin"])
    return pairs.join(named.select("doc_id", "table_id", F.coalesce("own", "earlier").alias("part")), ["doc_id", "table_id"])


def best_assignment(pairs: list[tuple[str, str, int, int, int, int]]) -> dict[str, str]:
    """annotation -> table with the greatest (exact spans, overlap shares, -distance), then the smallest tables in annotation order.

    Each connected part is solved alone as an assignment problem over integers, which is exact and
    takes time with the cube of the part's size.
    """
    # Shares are whole numbers over the least common denominator of all.
    common = lcm(*{span for _, _, _, _, span, _ in pairs})
    gain = {(a, t): (exact, over * (common // span), -dist) for a, t, exact, over, span, dist in pairs}
    options: dict[str, list[str]] = {}
    for a, t in sorted(gain):
        options.setdefault(a, []).append(t)
    out: dict[str, str] = {}
    left = set(options)
    while left:
        part, tables, grown = {min(left)}, set(), True
        while grown:
            tables = {t for a in part for t in options[a]}
            more = {a for a in left if tables & set(options[a])}
            grown, part = more != part, more
        left -= part
        rows, columns = sorted(part), sorted(tables)
        chosen = _cheapest(_costs(rows, columns, gain))
        out |= {a: columns[c] for a, c in zip(rows, chosen) if c < len(columns)}
    return out


def _costs(rows: list[str], columns: list[str], gain: dict[tuple[str, str], tuple[int, int, int]]) -> list[list[int]]:
    """Costs of each row's tables and of staying without one (as many columns more as rows).

    A cost is one integer of digits: exact spans, shares, distances, then the rank of the row's
    table; each digit's base is above any sum of it.
    """
    own = [[gain.get((a, t)) for t in columns] for a in rows]
    held = [g for row in own for g in row if g is not None]
    shares = 1 + sum(g[1] for g in held)
    distances = 1 - sum(g[2] for g in held)
    ranks = len(columns) + 1
    order = ranks ** len(rows)
    costs, most = [], 0
    for k, row in enumerate(own):
        place = ranks ** (len(rows) - 1 - k)
        costs.append([None if g is None else r * place - ((g[0] * shares + g[1]) * distances + g[2]) * order for r, g in enumerate(row)] + [len(columns) * place] * len(rows))
        most += max(abs(c) for c in costs[-1] if c is not None)
    never = 1 + 2 * most
    return [[never if c is None else c for c in row] for row in costs]


def _cheapest(costs: list[list[int]]) -> list[int]:
    """The column of each row in the cheapest assignment (Hungarian method; columns at least as many as rows)."""
    n, m = len(costs), len(costs[0])
    of_row, of_column = [0] * (n + 1), [0] * (m + 1)
    held, way = [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        held[0], at = i, 0
        least: list[int | None] = [None] * (m + 1)
        seen, free = [], list(range(1, m + 1))
        # How far the search has moved: what is seen or least counts from where it stood then, so no step changes all columns.
        moved, since = 0, []
        while held[at]:
            seen.append(at)
            since.append(moved)
            row, base, to, best = costs[held[at] - 1], of_row[held[at]] - moved, 0, None
            for j in free:
                slack = row[j - 1] - base - of_column[j]
                now = least[j]
                if now is None or slack < now:
                    least[j], way[j], now = slack, at, slack
                if best is None or now < best:
                    best, to = now, j
            moved, at = best, to
            free.remove(to)
        for j, then in zip(seen, since):
            of_row[held[j]] += moved - then
            of_column[j] -= moved - then
        while at:
            held[at], at = held[way[at]], way[at]
    return [j - 1 for _, j in sorted((held[j], j) for j in range(1, m + 1) if held[j])]


PAIR = ("annotation_id", "table_id", "exact", "overlap", "span", "distance")
ASSIGNED = "doc_id string, annotation_id string, table_id string, overlap long, span long"


def _solved(doc_id: str, rows: list[tuple]) -> list[tuple]:
    by = {(r[0], r[1]): r for r in rows}
    return [(doc_id, a, t, by[a, t][3], by[a, t][4]) for a, t in sorted(best_assignment(rows).items())]


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in order of their part to the assigned ones; a task holds one part at a time."""
    key, rows, names = None, [], ["doc_id", "annotation_id", "table_id", "overlap", "span"]
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=names)
    for batch in batches:
        out = []
        for doc_id, part, *pair in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", *PAIR))):
            if (doc_id, part) != key:
                if rows:
                    out += _solved(key[0], rows)
                key, rows = (doc_id, part), []
            rows.append(tuple(pair))
        yield made(out)
    if rows:
        yield made(_solved(key[0], rows))


def assign_tables(pairs: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """doc_id, annotation_id, table_id, overlap, span of the best assignment in each document.

    With the annotations' lines, Spark cuts a document into connected parts first and the solver sees one part; without, a document.
    """
    rows = pairs.withColumn("part", F.lit(0)) if expected is None else assignment_parts(pairs, expected)
    rows = rows.select("doc_id", F.col("part").cast("long").alias("part"), *PAIR)
    # Parts are many and mostly small: sorted rows cost no group each.
    return rows.repartition("doc_id", "part").sortWithinPartitions("doc_id", "part").mapInArrow(_assign, ASSIGNED)


def assess_matching(expected: DataFrame, tables: DataFrame) -> DataFrame:
    """Every annotation with its table, overlap and failures missing_table or span_mismatch."""
    pairs = staged(overlapping_pairs(expected, tables), "overlapping-pairs")
    rows = expected.join(assign_tables(pairs, expected).drop("doc_id"), "annotation_id", "left")
    failures = F.array_compact(F.array(F.when(F.col("table_id").isNull(), F.lit("missing_table")), F.when(F.col("overlap") * 100 < F.col("span") * MIN_OVERLAP, F.lit("span_mismatch"))))
    return rows.withColumn("failures", failures)

