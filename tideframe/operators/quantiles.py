"""Exact order statistics of a key's values without holding or sorting them in one task.

A mergeable sketch guesses two values around the wanted one; a count of the rows below, between and above
them says, exactly, which of the three holds the wanted rank; the values there (normally some thousandths
of the rows) are counted by value, and a running count over distinct values finds the one of that rank.
A poor guess costs time, never exactness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The guesses lie this share of the rows below and above the wanted one; the sketch errs by a quarter of it.
_MARGIN = 1 / 1024


def _meet(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their key's row in ``table``; a table without keys is one row."""
    if not keys:
        return rows.join(F.broadcast(table))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(table.withColumnsRenamed({k: f"_k_{k}" for k in keys}), on).drop(*[f"_k_{k}" for k in keys])


def order_statistic(rows: DataFrame, keys: list[str], value: str | Column, share: float, position: Callable[[Column], Column] | None = None) -> DataFrame:
    """keys, at, next, part: the value of the rank below ``position(n)``, the next one, and what lies between.

    ``position`` (from 0, n rows of the key with a value; by default share * (n - 1)) may be fractional;
    ``share`` is about where it lies. NaN counts as the largest value.
    """
    v = F.col(value) if isinstance(value, str) else value
    held = rows.select(*keys, v.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    sides = F.array(*[F.lit(min(1.0, max(0.0, share + d))) for d in (-_MARGIN, _MARGIN)])
    guess = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", sides, int(4 / _MARGIN)).alias("_e"))
    place = position(F.col("_n")) if position else F.lit(share) * (F.col("_n") - 1)
    guess = guess.select(*keys, "_n", F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"), place.cast("double").alias("_at")).withColumn("_r", F.floor("_at"))
    part = F.when(F.col("_v") < F.col("_lo"), 0).when(F.col("_v") <= F.col("_hi"), 1).otherwise(2)
    marked = _meet(held, guess.select(*keys, "_lo", "_hi"), keys).withColumn("_part", part)
    of = lambda k, x: F.when(F.col("_part") == k, x)
    counts = marked.groupBy(*keys).agg(F.count(of(0, F.lit(1))).alias("_n0"), F.count(of(1, F.lit(1))).alias("_n1"), F.min(of(1, F.col("_v"))).alias("_m1"), F.min(of(2, F.col("_v"))).alias("_m2"))
    below, within = F.col("_n0"), F.col("_n0") + F.col("_n1")
    r = F.col("_r")
    which = F.when(r < below, 0).when(r < within, 1).otherwise(2)
    counts = _meet(counts, guess.select(*keys, "_n", "_at", "_r"), keys).withColumn("_which", which)
    base = F.when(F.col("_which") == 0, 0).when(F.col("_which") == 1, below).otherwise(within)
    counts = counts.withColumn("_rank", r - base)  # inside the part that holds it
    counts = counts.withColumn("_beyond", F.when(F.col("_which") == 0, F.coalesce("_m1", "_m2")).when(F.col("_which") == 1, F.col("_m2")))
    inside = _meet(marked, counts.select(*keys, "_which", "_rank"), keys).where(F.col("_part") == F.col("_which"))
    values = inside.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_rank").alias("_rank"))
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_upto", F.sum("_c").over(upto))
    holds = lambda rank: (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
    found = values.groupBy(*keys).agg(F.max(F.when(holds(F.col("_rank")), F.col("_v"))).alias("at"), F.max(F.when(holds(F.col("_rank") + 1), F.col("_v"))).alias("next"))
    out = _meet(found, counts.select(*keys, "_at", "_r", "_beyond"), keys)
    return out.select(*keys, "at", F.coalesce("next", "_beyond").alias("next"), (F.col("_at") - F.col("_r")).alias("part"))


def quantile(rows: DataFrame, keys: list[str], value: str | Column, share: float, name: str) -> DataFrame:
    """keys and the exact quantile, interpolated between neighbours, of each key with a value."""
    found = order_statistic(rows, keys, value, share)
    between = F.when(F.col("part") > 0, F.col("at") + F.col("part") * (F.col("next") - F.col("at"))).otherwise(F.col("at"))
    return found.select(*keys, between.alias(name))
