"""Column expressions: buckets, units, clamps, time formats, symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of each interval spelling. Weeks and months are epoch-aligned blocks.
INTERVAL_SECONDS = {
    "1m": 60, "3m": 180, "5m": 300, "10m": 600, "15m": 900, "1h": 3600, "4h": 14400, "6h": 21600, "8h": 28800, "12h": 43200,
    "24h": 86400, "1d": 86400, "1w": 604800, "1month": 2592000, "min": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000,
}

#: Spellings each family of datasets allows.
ALLOWED_INTERVALS = {
    "price": ("1m", "5m", "15m", "4h"),
    "flow": ("5m", "15m", "4h"),
    "metric": ("10m", "1h", "24h", "1w", "1month"),
    "window": ("min", "hour", "day", "week", "month"),
    "daily": ("day",),
}


def interval_seconds(name: str, family: str | None = None) -> int:
    """Seconds of an interval; unknown spellings and those the family doesn't allow are errors."""
    allowed = ALLOWED_INTERVALS[family] if family else tuple(INTERVAL_SECONDS)
    if name not in allowed or name not in INTERVAL_SECONDS:
        raise ValueError(f"unsupported interval {name!r}; allowed: {', '.join(sorted(allowed))}")
    return INTERVAL_SECONDS[name]


def epoch_seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def bucket(es: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket."""
    if seconds <= 0:
        raise ValueError("the interval must be positive")
    return es - F.pmod(es, F.lit(seconds).cast("long"))


def seconds_from_any(v: Column) -> Column:
    """Milliseconds become seconds; what is already in seconds, and null, stays."""
    return F.when(v > 10_000_000_000, F.floor(v / 1000).cast("long")).otherwise(v)


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def half_even(v: Column, digits: int) -> Column:
    return F.bround(v, digits)


def to_unit(v: Column, price: Column, unit: str) -> Column:
    """USD amounts as they are, or in coins at a price of at least 1."""
    if unit not in ("usd", "coin"):
        raise ValueError("unit must be 'usd' or 'coin'")
    return v if unit == "usd" else v / F.greatest(price, F.lit(1.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def iso(es: Column) -> Column:
    return F.date_format(F.timestamp_seconds(es), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def window_stamp(es: Column, window: str) -> Column:
    """The date pattern of a window: a day, or a minute for shorter ones."""
    return F.date_format(F.timestamp_seconds(es), "yyyy-MM-dd" if window in ("day", "week", "month") else "yyyy-MM-dd HH:mm:ss")


def parse_time(text: Column) -> Column:
    """Epoch seconds of compact and ISO dates; zone-less ones are UTC; others are null."""
    day = F.try_to_timestamp(text, F.lit("yyyyMMdd"))
    second = F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss"))
    dashed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    spaced = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    zoned = F.try_to_timestamp(text)
    return F.unix_seconds(F.coalesce(day, second, dashed, spaced, zoned))


def base_asset(symbol: Column) -> Column:
    return F.regexp_replace(F.upper(symbol), "USDT$", "")


def pair_symbol(symbol: Column) -> Column:
    up = F.upper(symbol)
    return F.when(up.endswith("USDT"), up).otherwise(F.concat(up, F.lit("USDT")))


def parsed_list(text: Column) -> Column:
    """The non-empty trimmed parts of a comma-separated text."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def number_text(v: Column) -> Column:
    """A double in 12 significant digits, no trailing zeros, exponent form from 1e12 on and below 1e-4.

    A value exactly half-way between two such numbers rounds away from zero.
    """
    mantissa = F.format_string("%.11e", v)
    digits = F.regexp_replace(F.split_part(mantissa, F.lit("e"), F.lit(1)), r"\.?0+$", "")
    power = F.split_part(mantissa, F.lit("e"), F.lit(2)).cast("int")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(digits, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    places = F.greatest(F.lit(0), F.lit(11) - power)
    plain = F.lit(None).cast("string")
    for n in range(16):
        fixed = F.format_string(f"%.{n}f", v)
        plain = F.when(places == n, F.regexp_replace(fixed, r"\.0+$|(\.\d*?[1-9])0+$", "$1") if n else fixed).otherwise(plain)
    return F.when(v == 0, F.lit("0")).when((power < -4) | (power >= 12), scientific).otherwise(plain)
