from clientlens.functions import sql
from clientlens.functions.columns import (
    coerce_number,
    compact_amount,
    exact_money,
    exact_rate,
    in_window,
    key_text,
    midnight_date,
    report_money,
    safe_divide,
    safe_percent,
    zero_if_unusable,
)

__all__ = [
    "coerce_number",
    "compact_amount",
    "exact_money",
    "exact_rate",
    "in_window",
    "key_text",
    "midnight_date",
    "report_money",
    "safe_divide",
    "safe_percent",
    "sql",
    "zero_if_unusable",
]
