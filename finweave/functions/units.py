"""Units: aliases, evidence, resolution between cell, column and table, and scales, on normalized keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from finweave.functions.text import squeezed, steps

#: Fixed values.
MULTIPLIERS = {"VND": "1", "VND_thousand": "1000", "VND_million": "1000000", "VND_billion": "1000000000", "percent": "0.01", "ratio": "1"}
MONETARY = ("VND", "VND_thousand", "VND_million", "VND_billion")
PLAIN = ("percent", "ratio")
#: Spellings of each unit.
ALIASES = {
    "VND": ("vnd", "đồng", "dong", "vnđ", "đồng vn"),
    "VND_thousand": ("nghìn đồng", "ngàn đồng", "thousand vnd", "nghìn vnd", "1.000 vnd", "1,000 vnd", "nghìn vnđ", "ngàn vnđ"),
    "VND_million": ("triệu đồng", "triệu vnd", "million vnd", "1.000.000 vnd", "1,000,000 vnd", "triệu vnđ"),
    "VND_billion": ("tỷ đồng", "tỷ vnd", "billion vnd", "1.000.000.000 vnd", "1,000,000,000 vnd", "tỷ vnđ"),
    "percent": ("%", "phần trăm", "percent"),
    "ratio": ("lần", "ratio"),
}
PREFIX = r"^(?:đơn vị tính:|đơn vị:|đvt:)\s*"
PERIOD_LIKE = r"^(?:năm|ngay|ngày|tháng|thang|quý|quy|q)?\s*[0-9]{2,4}$|^(?:năm|ngày|tháng|quý) "
#: Substrings, so that words that hold one count too.
EVIDENCE = r"(?iu)(?:vnd|vnđ|đồng|dong|nghìn|ngàn|ngan|triệu|trieu|tỷ|ty|%|phần trăm|lần|lầ?n)"


def _lookup(key: Column) -> Column:
    out = F.lit(None).cast("string")
    for unit, names in ALIASES.items():
        out = F.when(key.isin(*names), F.lit(unit)).otherwise(out)
    return out


def _bare(key: Column) -> Column:
    return F.trim(F.regexp_replace(key, PREFIX, ""))


def has_unit_evidence(key: Column) -> Column:
    bare = _bare(key)
    return F.coalesce((key != "") & (key.rlike(PREFIX) | (~bare.rlike(PERIOD_LIKE) & bare.rlike(EVIDENCE))), F.lit(False))


def normalize_unit(key: Column) -> Column:
    """Canonical unit of a key, or null."""
    bare = _bare(key)
    inner = squeezed(F.regexp_extract(bare, r"\(([^)]+)\)", 1))
    return F.when(~bare.rlike(PERIOD_LIKE), F.coalesce(_lookup(bare), _lookup(inner)))


def unit_issue(key: Column) -> Column:
    """``unit_unknown`` where a key names something that is no period and no known unit."""
    return F.when((key != "") & ~_bare(key).rlike(PERIOD_LIKE) & normalize_unit(key).isNull(), F.lit("unit_unknown"))


def resolve_unit(cell_hint: Column, column_raw: Column, column_key: Column, table_key: Column) -> Column:
    """Struct of value and issue_code from a cell's hint, its column and its table.

    A column counts only where its raw text holds a unit word.  Of several units, percent or ratio of
    the cell wins, then of the column; other mixtures conflict.
    """
    counted = F.when(F.coalesce(column_raw.rlike(EVIDENCE), F.lit(False)), column_key)
    keys = F.array(cell_hint, counted, table_key, column_key)
    known = F.transform(keys, lambda k: F.struct(normalize_unit(k).alias("unit"), F.coalesce(unit_issue(k).isNotNull(), F.lit(False)).alias("unknown")))
    return steps(known, _told, _resolved)


def _told(known: Column) -> Column:
    """Of cell, counted column, table and plain column: the distinct units, and what may decide between them."""
    of = lambda i: F.get(known, F.lit(i))
    three = F.slice(known, 1, 3)
    units = F.array_distinct(F.filter(F.transform(three, lambda x: x["unit"]), lambda u: u.isNotNull()))
    return F.struct(units.alias("units"), of(0)["unit"].alias("cell"), of(3)["unit"].alias("column"), F.exists(three, lambda x: x["unknown"]).alias("unknown"))


def _resolved(x: Column) -> Column:
    plain = lambda u: F.when(u.isin(*PLAIN) & F.array_contains(x["units"], u), u)
    # Of a mixture the column's own unit counts even where its text gave no evidence.
    value = F.when(F.size(x["units"]) == 1, F.get(x["units"], F.lit(0))).when(F.size(x["units"]) > 1, F.coalesce(plain(x["cell"]), plain(x["column"])))
    issue = F.when((F.size(x["units"]) > 1) & value.isNull(), F.lit("unit_conflict")).when((F.size(x["units"]) == 0) & x["unknown"], F.lit("unit_unknown"))
    return F.struct(value.alias("value"), issue.alias("issue_code"))


def unit_multiplier(unit: Column) -> Column:
    out = F.lit(None).cast("decimal(12,2)")
    for name, m in MULTIPLIERS.items():
        out = F.when(unit == name, F.lit(m).cast("decimal(12,2)")).otherwise(out)
    return out


def economic_value(value: Column, unit: Column) -> Column:
    return value * unit_multiplier(unit)


def convert_scale(value: Column, source: Column, target: Column) -> Column:
    """The value in another unit of the same kind; mixing kinds is an error of the row."""
    fits = (source.isin(*MONETARY) & target.isin(*MONETARY)) | (source.isin(*PLAIN) & (source == target))
    return F.when(fits, value * unit_multiplier(source) / unit_multiplier(target)).otherwise(F.raise_error(F.lit("incompatible scale conversion")))
