"""Companies, statement types and metrics from titles and labels, on normalized keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TICKER = r"(?:mã ck|mã chứng khoán|stock code|ticker)\s*[:\-=]?\s*([a-z0-9]{2,10})"
#: Title phrases of the statement families.
STATEMENTS = {
    "balance_sheet": ("bảng cân đối kế toán", "bảng cân đối số phát sinh", "balance sheet"),
    "income_statement": ("báo cáo kết quả hoạt động kinh doanh", "báo cáo kết quả kinh doanh", "income statement", "profit and loss"),
    "cash_flow_statement": ("báo cáo lưu chuyển tiền tệ", "lưu chuyển tiền tệ", "cash flow statement", "statement of cash flows"),
    "equity_changes": ("báo cáo thay đổi vốn chủ sở hữu", "biến động vốn chủ sở hữu", "statement of changes in equity"),
    "notes": ("thuyết minh báo cáo tài chính", "thuyết minh bctc", "notes to the financial statements"),
}
#: Spellings of the metrics.
METRICS = {
    "revenue": ("Doanh thu bán hàng và cung cấp dịch vụ", "Revenue"),
    "net_revenue": ("Doanh thu thuần về bán hàng và cung cấp dịch vụ", "Net revenue", "Doanh thu thuần"),
    "profit_before_tax": ("Lợi nhuận kế toán trước thuế", "Profit before tax"),
    "profit_after_tax": ("Lợi nhuận sau thuế thu nhập doanh nghiệp", "Profit after tax"),
    "total_assets": ("Tổng cộng tài sản", "Total assets"),
    "total_liabilities": ("Nợ phải trả", "Total liabilities"),
    "equity": ("Vốn chủ sở hữu", "Owners' equity"),
    "cash_and_cash_equivalents": ("Tiền và các khoản tương đương tiền", "Cash and cash equivalents"),
    "operating_cash_flow": ("Lưu chuyển tiền thuần từ hoạt động kinh doanh", "Net cash flows from operating activities"),
    "gross_profit": ("Lợi nhuận gộp", "Gross profit"),
    "cost_of_goods_sold": ("Giá vốn hàng bán", "Cost of goods sold"),
    "selling_expenses": ("Chi phí bán hàng",),
    "general_administration_expenses": ("Chi phí quản lý doanh nghiệp",),
    "net_operating_profit": ("Lợi nhuận thuần từ hoạt động kinh doanh",),
    "current_income_tax_expense": ("Chi phí thuế TNDN hiện hành", "Chi phí thuế thu nhập doanh nghiệp hiện hành"),
}
#: Row labels that structure a table and name no metric.
STRUCTURAL = ("stt", "số tt", "chỉ tiêu", "mã số", "thuyết minh", "ghi chú", "tổng cộng", "cộng", "a. tài sản", "b. nợ phải trả", "c. vốn chủ sở hữu")


def check_aliases(aliases: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Key of each spelling with its name; a key of two names is an error."""
    from finweave.functions.text import python_key

    out: dict[str, str] = {}
    for name, spellings in aliases.items():
        for s in spellings:
            if out.setdefault(python_key(s), name) != name:
                raise ValueError(f"alias {s!r} names {out[python_key(s)]!r} and {name!r}")
    return out


METRIC_KEYS = check_aliases(METRICS)


def company_issue(company_code: Column, title_key: Column) -> Column:
    """``company_conflict`` where the title names another ticker; the path's ticker always stands."""
    named = F.upper(F.regexp_extract(title_key, TICKER, 1))
    return F.when((named != "") & (named != F.upper(company_code)), F.lit("company_conflict"))


def normalize_statement(title_key: Column) -> Column:
    """Struct of value and issue_code."""
    found = F.array_compact(F.array(*[F.when(_any(title_key, phrases), F.lit(family)) for family, phrases in STATEMENTS.items()]))
    primary = F.filter(found, lambda f: f != "notes")
    several = F.when(F.array_contains(found, "notes") & ~title_key.startswith("thuyết minh") & (F.size(primary) == 1), F.get(primary, F.lit(0)))
    value = F.when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.size(found) > 1, several)
    return F.struct(value.alias("value"), F.when((F.size(found) > 1) & value.isNull(), F.lit("statement_conflict")).alias("issue_code"))


def _any(key: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(key, F.lit(p))
    return F.coalesce(out, F.lit(False))


def normalize_metric(label_key: Column) -> Column:
    """Canonical metric of a label, or null."""
    table = F.create_map(*[F.lit(x) for pair in METRIC_KEYS.items() for x in pair])
    return F.try_element_at(table, label_key)


def metric_issue(label_key: Column) -> Column:
    return F.when((label_key != "") & ~label_key.isin(*STRUCTURAL) & normalize_metric(label_key).isNull(), F.lit("metric_unknown"))


def metric_table(spark: SparkSession) -> DataFrame:
    """The aliases as a table, for joins."""
    return spark.createDataFrame(sorted(METRIC_KEYS.items()), "label_key string, metric string")
