"""Money: exact decimals, minor units, and the text forms of both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, MatchConfig

MAX_SAFE_MINOR = 2**53 - 1
#: Currency marks.
SYMBOLS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥"}


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def tolerance(gateway_amount: Column, cfg: MatchConfig = DEFAULT) -> Column:
    """The larger of the share of the gateway amount and the floor, exact."""
    return F.greatest(F.abs(gateway_amount) * F.lit(cfg.amount_drift_pct), F.lit(cfg.amount_drift_floor))


def tolerance_text(gateway_amount: Column, cfg: MatchConfig = DEFAULT) -> Column:
    """The arm that wins, in its own scale; the share wins a tie."""
    share = F.abs(gateway_amount) * F.lit(cfg.amount_drift_pct)
    return F.when(share >= F.lit(cfg.amount_drift_floor), share.cast("string")).otherwise(F.lit(str(cfg.amount_drift_floor)))


def parse_minor(raw: Column, scale: int = 2) -> Column:
    """Decimal text to minor units; digits past the scale are cut, not rounded; else null."""
    text = F.regexp_replace(F.trim(raw), r"[,\s]", "")
    number = text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    whole = F.regexp_extract(text, r"^[+-]?(\d*)", 1)
    frac = F.regexp_extract(text, r"\.(\d*)$", 1)
    digits = F.concat(F.regexp_replace(whole, "^0+", ""), F.substring(F.rpad(frac, scale, "0"), 1, scale))
    short = F.when(F.length(digits) <= 16, digits.try_cast("long"))
    value = F.when(F.startswith(text, F.lit("-")), -short).otherwise(short)
    return F.when(number & (F.abs(value) <= MAX_SAFE_MINOR), value)


def to_decimal(minor: Column, scale: int = 2) -> Column:
    return (minor.cast("decimal(18,0)") / F.lit(10**scale).cast("decimal(5,0)")).cast(f"decimal(18,{scale})")


def to_decimal_string(minor: Column, scale: int = 2) -> Column:
    return to_decimal(minor, scale).cast("string")


def format_minor(minor: Column, scale: int = 2) -> Column:
    return F.format_number(to_decimal(minor, scale), scale)


def format_money(minor: Column, currency: Column, scale: int = 2) -> Column:
    """With the currency's mark before it, or its code behind."""
    marks = F.create_map(*(F.lit(x) for pair in SYMBOLS.items() for x in pair))
    mark = F.try_element_at(marks, F.upper(currency))
    shown = format_minor(minor, scale)
    return F.when(mark.isNotNull(), F.concat(mark, shown)).otherwise(F.concat_ws(" ", shown, currency))


def format_amount(text: Column, currency: Column) -> Column:
    """A decimal's text as money; text that is no number stands as it is; a dash for none."""
    minor = parse_minor(text)
    return F.when(F.coalesce(text, F.lit("")) == "", "—").when(minor.isNull(), text).otherwise(format_money(minor, F.coalesce(currency, F.lit(""))))


def half_up(amount: Column) -> Column:
    """To two decimals, halves away from zero."""
    return F.round(amount, 2).cast("decimal(18,2)")
