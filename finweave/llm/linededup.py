"""Line deduplication by a log-template tree, in DataFrame operations only.

The tree has fixed depth: a line (lower-cased, digit runs as ``0``) falls to a leaf by its number of
tokens and its first ``LEADING`` tokens.  A token's support is the number of the leaf's different
lines that have it at its place; the leading tokens have the support of the whole leaf.  The
``FIXED_SHARE`` best supported tokens of a line are fixed, and the least support of these stands for
the size of the line's cluster; a token that at most half of the cluster has is a variable field and
becomes a wildcard.  So a field's values may repeat, lines of every length above ``LEADING`` tokens have
fields, and a template is the same over few lines and over many.  A value that more than half of the
cluster has makes a template of its own.  Lines without wildcards, lines alone in their leaf and lines
of up to ``LEADING`` tokens (the leaf is the whole line) are their own template.

A template with wildcards recurs if documents of different content have it; without that its lines
are their own templates.  A line recurs if two documents have it, equal texts under different ids
too.  Of a recurring template the first line stays (smallest document id, then line number) and all
others are dropped, in the same document too; blank lines stay.

Plan: a first pass masks each text once and keeps digests of its lines; only leaves that hold different
lines bring their lines' tokens into the second step, each different line once.  Counts are plain
aggregations with sums before the shuffle.  What is joined to all lines is written first, so that such a
join is of its own and may be split or broadcast: a line that a third of all documents share, or a leaf
that holds them, is spread.  The last step gives each document its list of dropped lines.

Edge cases: ids are whole numbers; a null id stands after all others, as 2**63 - 1 would; null text is
returned as null with 0 lines; an empty text has one blank line; rows with equal id and text are one
document whose rows get equal results; an empty table gives an empty result; other columns are not
carried by ``line_report`` and are kept by ``drop_recurring_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.llm.common import discard, free_prefix, materialize

LEADING = 3
FIXED_SHARE = 0.7
LAST_ID = 2**63 - 1


def masked(text: Column) -> Column:
    """The text in the form that templates compare."""
    return F.lower(F.regexp_replace(text, "[0-9]+", "0"))


def n_tokens(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def line_rows(docs: DataFrame, least_tokens: int = 1) -> DataFrame:
    """doc_id, row_hash, line_no, masked line and its n_tokens of every line that is not blank and has enough tokens."""
    texts = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64("text").alias("row_hash"), masked(F.col("text")).alias("text"))
    # Masking keeps line ends and spaces, so the whole text is masked at once.
    rows = texts.select("doc_id", "row_hash", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim("line")).where("line != ''").withColumn("n_tokens", n_tokens(F.col("line")))
    return rows if least_tokens == 1 else rows.where(F.col("n_tokens") >= least_tokens)


def _leaf() -> Column:
    return F.xxhash64("n_tokens", F.substring_index("line", " ", LEADING))


def templates(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """line_hash, template of the lines that get wildcards; all others are their own template."""
    long_enough = F.col("n_tokens") > LEADING
    leaves = digests.where(long_enough).groupBy("leaf").agg(F.min("line_hash").alias("low"), F.max("line_hash").alias("high")).where("low != high").select("leaf")
    leaves = materialize(leaves, "line-leaves")
    # Each different line of such leaves stands once, brought by its first row.
    stood_by = digests.where(long_enough).join(leaves, "leaf", "left_semi").groupBy("line_hash").agg(F.min("doc_id").alias("w_doc"), F.min("row_hash").alias("low"), F.max("row_hash").alias("high"))
    wanted = stood_by.withColumnRenamed("line_hash", "w_hash").hint("shuffle_hash")
    lines = line_rows(docs, LEADING + 1).select("doc_id", "line", "n_tokens", F.xxhash64("line").alias("line_hash"))
    lines = lines.join(wanted, (F.col("line_hash") == F.col("w_hash")) & (F.col("doc_id") == F.col("w_doc")))
    # A line that its document repeats is there more than once.
    lines = lines.dropDuplicates(["line_hash"]).withColumn("leaf", _leaf())
    # Leading tokens are the leaf's own and fixed; where they are all that must be, the last of them stands for the leaf.
    n_fixed = F.ceil(F.col("n_tokens") * FIXED_SHARE).cast("int")
    given = F.least(F.lit(LEADING), n_fixed - 1)
    rest = F.slice(F.split("line", " "), given + 1, F.col("n_tokens"))
    placed = lines.select("leaf", "line_hash", "n_tokens", "low", "high", F.posexplode(rest).alias("place", "token"))
    # The line's contents go with one of its tokens.
    contents = [F.when(F.col("place") == 0, F.col(c)).alias(c) for c in ("low", "high")]
    placed = materialize(placed.select("leaf", "line_hash", "n_tokens", *contents, F.xxhash64("place", "token").alias("token")), "line-tokens")
    shared = placed.groupBy("leaf", "token").agg(F.count(F.lit(1)).alias("support")).where("support > 1")
    # Written, so that the join can split a token that very many lines of a leaf have.
    shared = materialize(shared, "line-shared")
    supported = placed.join(shared, ["leaf", "token"], "left").select("leaf", "line_hash", "n_tokens", "low", "high", F.struct(F.coalesce("support", F.lit(1)).alias("support"), "token").alias("place"))
    made = supported.groupBy("line_hash", "leaf", "n_tokens").agg(F.sort_array(F.collect_list("place"), asc=False).alias("places"), F.max("low").alias("low"), F.max("high").alias("high"))
    made = made.withColumn("least", F.element_at("places", n_fixed - given)["support"]).withColumn("fixed", F.filter("places", lambda p: p["support"] * 2 > F.col("least"))["token"])
    made = materialize(made.where(F.size("fixed") + given < F.col("n_tokens")).select("line_hash", F.xxhash64("leaf", "fixed").alias("template"), "low", "high"), "line-wildcards")
    discard(placed, leaves, shared)
    several = made.groupBy("template").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("template")
    return made.select("line_hash", "template").join(several, "template", "left_semi")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, dropped (line numbers) of the documents that lose lines."""
    lines = line_rows(docs).select("doc_id", "row_hash", "line_no", "n_tokens", F.xxhash64("line").alias("line_hash"), _leaf().alias("leaf"))
    digests = materialize(lines, "line-digests")
    made = materialize(templates(docs, digests), "line-templates")
    rows = digests.select("doc_id", "row_hash", "line_no", "line_hash").join(made, "line_hash", "left").withColumn("template", F.coalesce("template", "line_hash"))
    rows = materialize(rows.select("doc_id", "row_hash", "line_no", "template"), "lines")
    discard(digests)
    ends = [F.min("row_hash").alias("low"), F.max("row_hash").alias("high"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")]
    recurring = rows.groupBy("template").agg(*ends).where("low != high OR first_doc != last_doc").select("template", "first_doc")
    recurring = materialize(recurring, "line-recurring")
    found = rows.join(recurring, "template")
    # Of the first document the first line stays; a second row of that id with another text stays out.
    first = found.where("doc_id = first_doc").groupBy("template").agg(F.min(F.struct("row_hash", "line_no")).alias("first"))
    first = first.select(F.col("template").alias("f_template"), F.col("first.row_hash").alias("f_hash"), F.col("first.line_no").alias("f_line"))
    is_first = (F.col("template") == F.col("f_template")) & (F.col("doc_id") == F.col("first_doc")) & (F.col("row_hash") == F.col("f_hash")) & (F.col("line_no") == F.col("f_line"))
    dropped = found.join(first, is_first, "left_anti")
    # A document's own lines, each once even where the document's row is repeated.
    return dropped.groupBy("doc_id", "row_hash").agg(F.collect_set("line_no").alias("dropped"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, its text without the dropped lines, and n_lines, n_dropped.

    The text and columns that already have these two names are replaced; all others keep their values.
    """
    p = free_prefix(docs, "g_")
    doc, digest, gone = (F.col(f"{p}{c}") for c in ("doc", "hash", "gone"))
    found = dropped_lines(docs).select(F.col("doc_id").alias(f"{p}doc"), F.col("row_hash").alias(f"{p}hash"), F.col("dropped").alias(f"{p}gone"))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)) == doc) & (F.xxhash64("text") == digest)
    joined = docs.join(found.hint("shuffle_hash"), same, "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone, i)), "\n"))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    return joined.select(*others, kept.alias("text"), n_lines.cast("int").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).alias("n_dropped"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, text without the dropped lines, n_lines, n_dropped for every row of ``docs`` (doc_id, text)."""
    return drop_recurring_lines(docs.select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_dropped")
