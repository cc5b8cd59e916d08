"""Text columns: keys, predicates on lines and labels, and the few functions that need Python's Unicode tables."""

from __future__ import annotations

import html
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Patterns of lines and numbers.
PAGE_MARKER = r"^===== PAGE [1-9][0-9]* =====$"
NUMERIC_LOOKING = r"^\(?[+-]?[0-9][0-9., ]*%?\)?$"
LIST_PREFIX = r"^(?:[-•*] |[0-9]+\. )"

#: Words that mark headers, metric columns, auxiliary columns and unit lines.
HEADER_SIGNALS = ("chỉ tiêu", "mã số", "thuyết minh", "năm", "kỳ", "đơn vị", "đvt", "metric", "item", "description", "code", "year", "period")
DETECTION_SIGNALS = ("mã số", "chỉ tiêu", "thuyết minh", "năm", "kỳ", "đơn vị", "đvt")
METRIC_SIGNALS = ("chỉ tiêu", "khoản mục", "nội dung", "diễn giải", "metric", "item", "description")
AUXILIARY_SIGNALS = ("stt", "số thứ tự", "mã số", "code", "thuyết minh", "note")
AUXILIARY_KEYS = ("stt", "mã số", "thuyết minh", "code", "note", "notes")
#: Fixed values; the last three are the same words read with a wrong encoding, as the corpus has them.
UNIT_MARKERS = ("đơn vị tính", "đơn vị", "Ä‘Æ¡n vá»‹", "Ä‘Æ¡n vá»‹ tÃ­nh", "Ä‘vt")
NOTES_HEADINGS = ("thuyết minh", "thuyêt minh", "thuyết minh báo cáo tài chính", "thuyêt minh báo cáo tài chính")


def python_key(text: str) -> str:
    """NFKC, case folding, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def _mapped(f):
    @F.arrow_udf(StringType())
    def run(values: pa.Array) -> pa.Array:
        coded = values.dictionary_encode()
        return pa.array([f(v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return run


#: Exact keys; labels repeat, so each distinct one of a batch is computed once.
normalized_key = _mapped(python_key)
unescape_html = _mapped(html.unescape)
strip_accents = _mapped(lambda v: "".join(c for c in unicodedata.normalize("NFKD", v.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(c)))


def steps(value: Column, *each) -> Column:
    """Applies functions one after another; what a step makes is computed once, however often the next reads it.

    Chained columns would be written out in full wherever a filter is pushed through them; the value
    of a lambda is not.
    """
    out = F.array(value)
    for f in each:
        out = F.transform(out, f)
    return F.get(out, F.lit(0))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns as those of a generated row: filters and later columns read them and are never pushed below them, where they would be written out in full."""
    row = F.explode(F.array(F.struct(*[v.alias(name) for name, v in values.items()]))).alias("_once")
    return df.select("*", row).select(*df.columns, *[F.col("_once")[name].alias(name) for name in values])


def squeezed(text: Column) -> Column:
    """White space of any script runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", " "))


#: Dashes that compatibility forms may stand for, besides ASCII.
DASHES = "—–"


@lru_cache(maxsize=1)
def compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility form is ASCII (or a dash): of one character, and of several."""
    one, several = {}, {}
    for c in map(chr, range(0x80, 0x110000)):
        form = unicodedata.normalize("NFKC", c)
        if form != c and all(x < "\x80" or x in DASHES for x in form):
            (one if len(form) == 1 else several)[c] = form
    return one, several


def plain_forms(text: Column) -> Column:
    """Wide, raised, circled and other compatibility forms of ASCII characters as these, without leaving the JVM.

    Of text that is ASCII after NFKC this is NFKC; other text keeps a character beyond ASCII by either.
    """
    one, several = compatibility()
    single = F.translate(text, "".join(one), "".join(one.values()))
    of = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    each = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(F.try_element_at(of, c), c)), "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.when(text.rlike("[" + "".join(several) + "]"), each).otherwise(single)).otherwise(text)


def native_key(text: Column) -> Column:
    """The key of text that is in composed form already, without leaving the JVM."""
    return F.lower(squeezed(text))


def numeric_looking(text: Column) -> Column:
    return (F.trim(text) == "-") | F.trim(text).rlike(NUMERIC_LOOKING)


def predominantly_numeric(text: Column) -> Column:
    """At least half of the characters that are no space are digits or number marks."""
    compact = F.regexp_replace(text, r"(?U)\s", "")
    return (F.length(compact) > 0) & (F.length(F.regexp_replace(compact, r"[^\p{Nd}.,()\-+%]", "")) * 2 >= F.length(compact))


def contains_signal(key: Column, signals: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in signals:
        out = out | F.contains(key, F.lit(s))
    return out


def is_page_marker(line: Column) -> Column:
    return F.trim(line).rlike(PAGE_MARKER)


def is_list_line(line: Column, cells: Column) -> Column:
    """A bullet or number, and cells behind the first that are all numeric-looking or none."""
    tail = F.filter(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda c: c != "")
    return F.trim(line).rlike(LIST_PREFIX) & (F.forall(tail, numeric_looking) | ~F.exists(tail, numeric_looking))


def is_value_candidate(raw: Column, row_label: Column, column_key: Column) -> Column:
    """A cell that may hold a value: it has a row label, is not that label, and no auxiliary column's."""
    return row_label.isNotNull() & ~raw.eqNullSafe(row_label) & (column_key.isNull() | (column_key == "") | ~column_key.isin(*AUXILIARY_KEYS))


def is_eligible_value_cell(raw: Column, row_label: Column, column_label: Column, value: Column) -> Column:
    """A cell that an audit may ask for; text columns are compared by key."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return filled(raw) & filled(row_label) & filled(column_label) & (native_key(raw) != native_key(row_label)) & ~contains_signal(native_key(column_label), AUXILIARY_SIGNALS) & (value.isNotNull() | numeric_looking(raw))


def percentage_passes(n: Column, d: Column, threshold: int) -> Column:
    return (d > 0) & (n * 100 >= d * threshold)


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where some were cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def human_bytes(size: Column) -> Column:
    out = F.format_string("%d B", size)
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), start=1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / 1024.0**power)).otherwise(out)
    return out
