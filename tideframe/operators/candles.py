"""Candles and other per-bucket aggregates over time-ordered rows.

Order inside a bucket is that of ``order`` (time, then a sequence number that makes it total): first
and last values come from min_by / max_by, which combine on the map side; no window sorts raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.params import positive, time_range
from tideframe.functions.scalars import bucket

ORDER = ("ts", "seq")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_in(value: str | Column, order: tuple[str, ...] = ORDER) -> Column:
    return F.min_by(_col(value), F.struct(*order))


def last_in(value: str | Column, order: tuple[str, ...] = ORDER) -> Column:
    return F.max_by(_col(value), F.struct(*order))


def bucketed(df: DataFrame, seconds: int, es: str = "es") -> DataFrame:
    return df.withColumn("bucket", bucket(F.col(es), seconds))


def candles(df: DataFrame, keys: list[str], value: str | Column, seconds: int, volume: str | Column | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """open, high, low, close (and volume, 0 without one) of each key and bucket; empty buckets are absent."""
    v = _col(value)
    total = F.sum(_col(volume)) if volume is not None else F.lit(0.0)
    out = bucketed(df, seconds).groupBy(*keys, "bucket")
    return out.agg(first_in(v, order).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), last_in(v, order).alias("close"), total.alias("volume"))


def rollup(fine: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Coarser candles from finer ones of an interval that divides theirs."""
    out = fine.withColumn("_fine", F.col("bucket")).withColumn("bucket", bucket(F.col("bucket"), seconds)).groupBy(*keys, "bucket")
    return out.agg(F.min_by("open", "_fine").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "_fine").alias("close"), F.sum("volume").alias("volume"))


def chained(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Each candle opens at the close before it, its range widened to hold both."""
    before = F.lag("close").over(Window.partitionBy(*keys).orderBy("bucket"))
    out = bars.withColumn("_open", F.coalesce(before, F.col("open")))
    out = out.withColumn("high", F.greatest("high", "close", "_open")).withColumn("low", F.least("low", "close", "_open"))
    return out.withColumn("open", F.col("_open")).drop("_open")


def delta_chained(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Candles moved so that each opens at the (moved) close before it and keeps its own change."""
    order = Window.partitionBy(*keys).orderBy("bucket")
    change = F.col("close") - F.col("open")
    start = F.first("open").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = bars.withColumn("_c", change).withColumn("_close", start + F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_open", F.col("_close") - F.col("_c"))
    up = F.greatest(F.col("high") - F.col("open"), F.col("_c"), F.lit(0.0))
    down = F.least(F.col("low") - F.col("open"), F.col("_c"), F.lit(0.0))
    out = out.withColumn("_high", F.col("_open") + up).withColumn("_low", F.col("_open") + down)
    return out.select(*keys, "bucket", F.col("_open").alias("open"), F.col("_high").alias("high"), F.col("_low").alias("low"), F.col("_close").alias("close"), "volume")


def last_n(df: DataFrame, keys: list[str], n: int, order: list[str]) -> DataFrame:
    """The last n rows of each key in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= positive("n", n)).drop("_rank")


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows of the table, in time order; a top-n, never a full sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(positive("n", n)).orderBy(*order)


def between(df: DataFrame, start: int | None = None, end: int | None = None, es: str = "es") -> DataFrame:
    """Rows of a time range, inclusive at both ends; either end may be open."""
    time_range(start, end)
    df = df.where(F.col(es) >= start) if start is not None else df
    return df.where(F.col(es) <= end) if end is not None else df


def history(df: DataFrame, end: int, seconds: int, periods: int, es: str = "es") -> DataFrame:
    """Rows from the first of the last ``periods`` buckets up to ``end``."""
    positive("periods", periods)
    positive("seconds", seconds)
    return between(df, end // seconds * seconds - (periods - 1) * seconds, end, es)


def look_back(df: DataFrame, now: int, start: int | None = None, end: int | None = None, es: str = "es", span: int = 86_400) -> DataFrame:
    """A time range whose end defaults to now and whose start defaults to a day before the end."""
    end = now if end is None else end
    return between(df, end - span if start is None else start, end, es)


def violations(bars: DataFrame) -> Column:
    """Whether a candle breaks low <= open, close <= high or holds a value that isn't finite."""
    body_lo, body_hi = F.least("open", "close"), F.greatest("open", "close")
    good = (F.col("low") <= body_lo) & (body_hi <= F.col("high"))
    for c in ("open", "high", "low", "close"):
        good = good & ~F.isnan(c) & (F.abs(F.col(c).cast("double")) != float("inf"))
    return ~F.coalesce(good, F.lit(False))
