"""Instants: exact differences, parsing without guesses, and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def diff_us(a: Column, b: Column) -> Column:
    """b - a in microseconds."""
    return F.timestamp_diff("MICROSECOND", a, b)


def epoch_us(name: str) -> Column:
    """Microseconds since 1970 of a column, its name, without a zone."""
    return diff_us(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))


def time_delta_us(a: Column, b: Column) -> Column:
    return F.abs(diff_us(a, b))


def add_us(ts: Column, us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, ts)


def whole_ms(us: Column) -> Column:
    """Microseconds to milliseconds, cut toward zero."""
    return F.when(us >= 0, F.floor(us / 1000)).otherwise(F.ceil(us / 1000)).cast("long")


def match_latency_ms(gateway_received: Column, ledger_received: Column, resolved_at: Column) -> Column:
    """From the later arrival to the decision, cut to whole milliseconds, never below zero."""
    return F.greatest(whole_ms(diff_us(F.greatest(gateway_received, ledger_received), resolved_at)), F.lit(0).cast("long"))


def parse_timestamp_ms(raw: Column) -> Column:
    """Epoch milliseconds of ISO 8601 or epoch text; null for anything ambiguous.

    Ten digits are seconds, thirteen milliseconds; text without a zone is read as UTC.
    """
    text = F.trim(raw)
    iso = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
    part = lambda i: F.regexp_extract(text, iso, i)
    seconds = F.when(part(3) == "", ":00").otherwise(part(3))
    clock = F.concat(part(1), F.lit(" "), part(2), seconds)
    at = F.try_to_timestamp(F.concat(clock, F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    millis = F.rpad(F.substring(part(4), 2, 3), 3, "0").try_cast("long")
    zone = F.regexp_replace(part(5), ":", "")
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    offset = F.when(zone.isin("", "Z"), 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")))
    dated = F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit("yyyy-MM-dd XXX"))
    return (
        F.when(text.rlike(r"^\d{10}$"), text.try_cast("long") * 1000)
        .when(text.rlike(r"^\d{13}$"), text.try_cast("long"))
        .when(text.rlike(iso), F.unix_millis(at) + F.coalesce(millis, F.lit(0)) - offset.cast("long") * 60_000)
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_millis(dated))
    )


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def format_clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS")


def iso_utc(ms: Column) -> Column:
    """2026-03-14T09:30:00.000Z"""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def to_fixed(value: Column, digits: int) -> Column:
    """A double with so many decimals: rounded by its exact binary value, true ties upwards."""
    v = F.abs(value.cast("double"))
    # a tie needs a value that binary fractions of digits + 1 places can hold
    held = v * 2.0 ** (digits + 1)
    tie = (held == F.floor(held)) & (F.pmod(v * (2.0 * 10**digits), F.lit(2.0)) == 1.0)
    up = ((F.floor(v * 10.0**digits) + 1).cast("decimal(20,0)") / F.lit(10**digits).cast("decimal(10,0)")).cast(f"decimal(20,{digits})").cast("string")
    near = F.replace(F.format_number(v, digits), F.lit(","), F.lit(""))
    return F.concat(F.when(value < 0, "-").otherwise(""), F.when(tie, up).otherwise(near))


def format_skew(ms: Column) -> Column:
    """Signed, in milliseconds, seconds or minutes, whichever reads best."""
    size = F.abs(ms)
    text = F.when(size < 1000, F.concat(size.cast("string"), F.lit("ms"))).when(size < 60_000, F.concat(to_fixed(size / 1000.0, 2), F.lit("s"))).otherwise(F.concat(to_fixed(size / 60_000.0, 1), F.lit("m")))
    return F.concat(F.when(ms >= 0, "+").otherwise("-"), text)


def format_duration(ms: Column) -> Column:
    v = ms.cast("double")
    return F.when(v < 1, F.concat(to_fixed(v, 2), F.lit("ms"))).when(v < 1000, F.concat(F.floor(v + 0.5).cast("string"), F.lit("ms"))).otherwise(F.concat(to_fixed(v / 1000.0, 2), F.lit("s")))
