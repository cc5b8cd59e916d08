"""Content-addressed identifiers; every one is a SHA-256 of text that any SQL engine can build."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PILOT_VERSION = "week1-pilot-v1"


def _joined(separator: str, *parts: Column) -> Column:
    """``concat_ws`` skips nulls; an absent part keeps its place as an empty one."""
    return F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def digest(separator: str, *parts: Column) -> Column:
    return F.sha2(_joined(separator, *parts), 256)


def document_id(sha256: Column) -> Column:
    return F.concat(F.lit("doc_"), F.lower(F.trim(sha256)))


def table_id(doc_id: Column, line_start: Column, line_end: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("tbl_"), digest("\n", doc_id, line_start, line_end, ordinal))


def cell_id(table: Column, row: Column, col: Column) -> Column:
    return F.concat(F.lit("cell_"), digest("\n", table, row, col))


def occurrence_id(path: Column, sha256: Column, ordinal: Column, line_start: Column, line_end: Column) -> Column:
    return digest("|", path, sha256, ordinal, line_start, line_end)


def annotation_id(doc_id: Column, line_start: Column, line_end: Column, statement: Column) -> Column:
    return F.concat(F.lit("ann_"), digest("\n", doc_id, line_start, line_end, statement))


def match_key(doc_id: Column, statement: Column, line_start: Column, line_end: Column) -> Column:
    return F.concat(F.lit("tblmatch_"), digest("\n", doc_id, F.lower(F.trim(F.coalesce(F.nullif(statement, F.lit("")), F.lit("unknown")))), line_start, line_end))


def sample_id(fingerprint: Column, code: Column, doc: Column, table: Column, cell: Column, field: Column, raw: Column) -> Column:
    return digest("|", fingerprint, code, doc, table, cell, field, raw)


def selection_rank(seed: str, sample: Column) -> Column:
    return digest("|", F.lit(seed), sample)


def stable_rank(namespace: str, *parts: Column) -> Column:
    return digest("\n", F.lit(PILOT_VERSION), F.lit(namespace), *parts)


def is_id(value: Column, prefix: str) -> Column:
    return value.rlike(f"^{prefix}[0-9a-f]{{64}}$")
