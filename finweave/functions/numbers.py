"""Numbers as reports print them: grouping and decimal marks of either kind, brackets, percent, OCR slips.

A decision is built in steps, so each intermediate text is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.functions.text import once, plain_forms, squeezed, steps

#: Fixed values.
MISSING = ("-", "—", "–", "n/a", "na", "null", "none", "", ".")
VALUE_TYPE = "decimal(38,10)"


def _working(raw: Column) -> Column:
    return squeezed(plain_forms(raw))


def is_missing_number(raw: Column) -> Column:
    return F.lower(_working(raw)).isin(*MISSING)


def is_numeric_candidate(raw: Column) -> Column:
    return steps(_working(raw), _repaired, lambda x: ~x["blank"] & x["text"].rlike("[0-9]") & x["text"].rlike(r"^[0-9., +\-()%]+$"))


def _cut(text: Column, first: int, less: int) -> Column:
    return F.substring(text, F.lit(first), F.length(text) - less)


def _repaired(text: Column) -> Column:
    """A last O behind digits is a zero, and one last mark behind a digit goes."""
    zero = F.when(text.rlike("[0-9].*[Oo]$"), F.concat(_cut(text, 1, 1), F.lit("0"))).otherwise(text)
    return F.struct(F.lower(text).isin(*MISSING).alias("blank"), zero.alias("text"))


def _unmarked(x: Column) -> Column:
    return F.struct(x["blank"].alias("blank"), F.when(x["text"].rlike("[0-9][.,]$"), _cut(x["text"], 1, 1)).otherwise(x["text"]).alias("text"))


def _without_percent(x: Column) -> Column:
    t = x["text"]
    hit = t.endswith("%")
    return F.struct(x["blank"].alias("blank"), F.when(hit & ~x["blank"], F.lit("percent")).alias("hint"), F.when(hit, F.trim(_cut(t, 1, 1))).otherwise(t).alias("text"))


def _without_brackets(x: Column) -> Column:
    t = x["text"]
    both = t.startswith("(") & t.endswith(")")
    return F.struct(x["blank"].alias("blank"), x["hint"].alias("hint"), (t.startswith("(") != t.endswith(")")).alias("odd"), both.alias("minus"), F.when(both, F.trim(_cut(t, 2, 2))).otherwise(t).alias("text"))


def _without_sign(x: Column) -> Column:
    t = x["text"]
    return F.struct(x["blank"].alias("blank"), x["hint"].alias("hint"), x["odd"].alias("odd"), (x["minus"] | t.startswith("-")).alias("minus"), F.when(t.rlike(r"^[+\-]"), F.trim(_cut(t, 2, 1))).otherwise(t).alias("text"))


def _without_spaces(x: Column) -> Column:
    t = x["text"]
    grouped = t.rlike(r"^[0-9]{1,3}( [0-9]{3})+$")
    odd_spaces = F.contains(t, F.lit(" ")) & ~grouped
    return F.struct(x["blank"].alias("blank"), x["hint"].alias("hint"), x["odd"].alias("odd"), x["minus"].alias("minus"), odd_spaces.alias("spaced"), F.when(grouped, F.replace(t, F.lit(" "), F.lit(""))).otherwise(t).alias("text"))


def _decided(x: Column) -> Column:
    """Of one mark alone: groups of three are grouping, one mark with another number of digits is decimal.  Of both the last is decimal."""
    t = x["text"]
    dot, comma = F.contains(t, F.lit(".")), F.contains(t, F.lit(","))
    plain = lambda mark: F.replace(t, F.lit(mark), F.lit(""))
    number = (
        F.when(~dot & ~comma, t)
        .when(~comma & t.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), plain("."))
        .when(~comma & t.rlike(r"^[0-9]+\.([0-9]{1,2}|[0-9]{4,})$"), t)
        .when(~dot & t.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$"), plain(","))
        .when(~dot & t.rlike(r"^[0-9]+,([0-9]{1,2}|[0-9]{4,})$"), F.replace(t, F.lit(","), F.lit(".")))
        .when(dot & comma & t.rlike(r"^[0-9]{1,3}(\.[0-9]{3})*,[0-9]{1,2}$"), F.replace(plain("."), F.lit(","), F.lit(".")))
        .when(dot & comma & t.rlike(r"^[0-9]{1,3}(,[0-9]{3})*\.[0-9]{1,2}$"), plain(","))
    )
    code = (
        F.when(x["blank"], F.lit("number_missing"))
        .when(x["odd"], F.lit("number_invalid"))
        .when(t == "", F.lit("number_missing"))
        .when(~t.rlike("^[0-9., ]+$") | x["spaced"], F.lit("number_invalid"))
        .when(number.isNotNull(), F.lit(None).cast("string"))
        .when(~comma & t.rlike(r"\..*\."), F.lit("number_invalid"))
        .otherwise(F.lit("number_ambiguous"))
    )
    return F.struct(number.alias("number"), x["minus"].alias("minus"), x["hint"].alias("unit_hint"), code.alias("issue_code"))


def _fits(number: Column) -> Column:
    """The type holds the number in full: 28 digits before the mark and 10 after it, less zeros at the ends."""
    whole = F.length(F.ltrim(F.substring_index(number, ".", 1), F.lit("0")))
    after = F.when(F.contains(number, F.lit(".")), F.length(F.rtrim(F.substring_index(number, ".", -1), F.lit("0")))).otherwise(F.lit(0))
    return (whole <= 28) & (after <= 10)


def _checked(x: Column) -> Column:
    """A number that the type cannot hold in full is no value but an issue."""
    lost = x["issue_code"].isNull() & x["number"].isNotNull() & ~_fits(x["number"])
    return F.struct(x["number"].alias("number"), x["minus"].alias("minus"), x["unit_hint"].alias("unit_hint"), F.when(lost, F.lit("number_invalid")).otherwise(x["issue_code"]).alias("issue_code"))


def _valued(x: Column) -> Column:
    parsed = F.when(x["issue_code"].isNull(), x["number"].try_cast(VALUE_TYPE))
    return F.struct(F.when(x["minus"], -parsed).otherwise(parsed).cast(VALUE_TYPE).alias("value"), x["unit_hint"].alias("unit_hint"), x["issue_code"].alias("issue_code"))


def parse_number(raw: Column) -> Column:
    """Struct of value, unit_hint (percent) and issue_code; null text gives null."""
    found = steps(_working(raw), _repaired, _unmarked, _without_percent, _without_brackets, _without_sign, _without_spaces, _decided, _checked, _valued)
    return F.when(raw.isNotNull(), found)


def with_number(df: DataFrame, raw: str, value: str = "value_numeric", hint: str = "number_hint", issue: str = "number_issue") -> DataFrame:
    """Adds the fields of a raw text's decision as columns."""
    out = once(df, _number_decision=parse_number(F.col(raw)))
    return out.withColumns({value: F.col("_number_decision.value"), hint: F.col("_number_decision.unit_hint"), issue: F.col("_number_decision.issue_code")}).drop("_number_decision")
