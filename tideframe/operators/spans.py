"""Ordered work over raw rows, the history of a key with many rows cut into spans of about equal numbers.

A window over a whole key sorts its history in one task. Keys with more than ``MOST_ROWS`` rows are
therefore cut at quantiles of their time (``at``), however unevenly their rows lie in it; rows are ordered
inside (key, span) only, and what a span takes over from those before it comes from one row for each
key and span. Rows of one time stay together, so one moment's rows are one task's.

Two small jobs find the cuts: the number of keys and rows by order of magnitude, and for keys above the
limit the quantiles (a mergeable sketch for each). The cuts are at most ``MOST_CUTS`` for a whole table:
where its heavy keys would need more, spans get longer. Tables without such keys are not cut at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
MOST_ROWS = 1 << 21
MOST_CUTS = 1 << 16
#: Quantiles known of a heavy key: it is cut into so many spans at most.
_STEPS = 1024


def _same(keys: list[str], other: str) -> Column:
    """Equality of keys, which may be null, with columns named by ``other`` and the key."""
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"{other}{c}"))
    return on


def cuts_of(rows: DataFrame, keys: list[str], at: str, most: int | None = None) -> list[tuple]:
    """(keys..., ascending cut points) of each key with more than ``most`` rows; at most ``MOST_CUTS`` points or so."""
    most = most or MOST_ROWS
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.col(at).isNotNull().cast("int")).alias("_some"))
    by_size = counts.groupBy(F.floor(F.log2("_n")).cast("int").alias("p")).agg(F.sum("_n").alias("rows"), F.max("_n").alias("largest")).collect()
    heavy = [r for r in by_size if r["largest"] > most]
    if not heavy:
        return []
    most = max(most, -(-sum(r["rows"] for r in heavy) // MOST_CUTS))
    large = counts.where((F.col("_n") > most) & (F.col("_some") == 1)).select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_n").alias("_rows"))
    found = rows.join(F.broadcast(large), _same(keys, "_h_"))  # at most MOST_CUTS keys
    shares = F.array(*[F.lit(i / _STEPS) for i in range(1, _STEPS)])
    found = found.groupBy(*keys).agg(F.percentile_approx(F.col(at).cast("long"), shares, 8 * _STEPS).alias("points"), F.max("_rows").alias("rows"))
    parts = F.least(F.ceil(F.col("rows") / F.lit(most)), F.lit(_STEPS)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at("points", F.greatest(F.lit(1), F.round(i * F.lit(_STEPS) / parts).cast("int"))))
    return [tuple(r) for r in found.select(*keys, F.array_sort(F.array_distinct(picked)).alias("cuts")).collect()]


def with_span(rows: DataFrame, keys: list[str], at: str, cuts: list[tuple]) -> DataFrame:
    """Adds ``_span``: how many cut points of its key lie at or below each row, looked up in two steps."""
    if not cuts:
        return rows.withColumn("_span", F.lit(0))
    table = []
    for *key, points in cuts:
        width = max(1, math.isqrt(len(points)))
        groups = [points[i : i + width] for i in range(0, len(points), width)]
        table.append((*key, [g[0] for g in groups], groups, width))
    kinds = ", ".join(f"`_c_{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    known = rows.sparkSession.createDataFrame(table, f"{kinds}, _firsts array<bigint>, _groups array<array<bigint>>, _width int")
    joined = rows.join(F.broadcast(known), _same(keys, "_c_"), "left")  # bounded by MOST_CUTS
    place = F.col(at).cast("long")
    group = F.size(F.filter("_firsts", lambda c: c <= place))
    inside = F.size(F.filter(F.element_at("_groups", F.greatest(group, F.lit(1))), lambda c: c <= place))
    span = F.when(group > 0, (group - 1) * F.col("_width") + inside)
    return joined.withColumn("_span", F.coalesce(span, F.lit(0)).cast("int")).select(*rows.columns, "_span")


class Ordered:
    """Rows of each key by ``order``; ``at``, a number or time, must not fall along it. Operations add columns.

    Several operations on one ``Ordered`` use the same spans, so that rows are sorted once for all of them.
    Finding the cuts evaluates ``rows`` once more, for keys and times only. Where that is dear, give ``cuts``
    found on a cheaper table with the same keys and times, or ``known``, a bound of the rows of a key (such
    as the buckets of the years that a series can span): below ``most`` nothing is counted.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("ts", "seq"), at: str = "es", most: int | None = None, cuts: list[tuple] | None = None, known: int | None = None):
        self.keys, self.order = keys, order
        if cuts is None:
            cuts = [] if known is not None and known <= (most or MOST_ROWS) else cuts_of(rows, keys, at, most)
        self.cut = bool(cuts)
        self.spanned = with_span(rows, keys, at, cuts) if cuts else rows
        self.inside = [*keys, "_span"] if cuts else keys

    @property
    def rows(self) -> DataFrame:
        return self.spanned.drop("_span")

    def window(self):
        return Window.partitionBy(*self.inside).orderBy(*self.order)

    def _with(self, column: Column, ends: Column, carry, joined) -> None:
        """Adds ``_in``; where keys are cut also ``_carry``: ``carry(window)`` over the spans' ``_end``. Then ``joined``."""
        inner = self.spanned.withColumn("_in", column)
        if self.cut:
            table = self.spanned.groupBy(*self.inside).agg(ends.alias("_end"))
            table = table.select(*[F.col(c).alias(f"_c_{c}") for c in self.inside], carry(Window.partitionBy(*self.keys).orderBy("_span")).alias("_carry"))
            inner = inner.join(table, _same(self.inside, "_c_")).drop(*[f"_c_{c}" for c in self.inside])
        self.spanned = joined(inner).drop("_in", "_carry")

    def previous(self, values: list[str], prefix: str = "prev_") -> Ordered:
        """The ``values`` of the row before (null for a key's first)."""
        taken = F.struct(*[F.col(v).alias(v) for v in values])
        got = F.coalesce("_in", "_carry") if self.cut else F.col("_in")
        add = lambda df: df.withColumns({prefix + v: got[v] for v in values})
        self._with(F.lag(taken).over(self.window()), F.max_by(taken, F.struct(*self.order)), lambda w: F.lag("_end").over(w), add)
        return self

    def latest(self, value: Column, name: str, known: Column) -> Ordered:
        """The last ``value`` that was not null up to each row, the row included; ``known`` orders those with one."""
        upto = self.window().rowsBetween(Window.unboundedPreceding, 0)
        before = lambda w: F.last("_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        add = lambda df: df.withColumn(name, F.coalesce("_in", "_carry") if self.cut else F.col("_in"))
        self._with(F.last(value, ignorenulls=True).over(upto), F.max_by(value, known), before, add)
        return self

    def running(self, value: Column, name: str) -> Ordered:
        """The sum of ``value`` over the key's rows up to each row."""
        upto = self.window().rowsBetween(Window.unboundedPreceding, 0)
        before = lambda w: F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        total = F.col("_in") + F.coalesce("_carry", F.lit(0)) if self.cut else F.col("_in")
        self._with(F.sum(value).over(upto), F.sum(value), before, lambda df: df.withColumn(name, total))
        return self

    def islands(self, begins: Column, name: str) -> Ordered:
        """Numbers runs of rows; one starts where ``begins`` holds or is null."""
        return self.running(F.when(F.coalesce(begins, F.lit(True)), 1).otherwise(0), name)


def with_previous(rows: DataFrame, keys: list[str], values: list[str], order: tuple[str, ...] = ("ts", "seq"), at: str = "es", prefix: str = "prev_") -> DataFrame:
    return Ordered(rows, keys, order, at).previous(values, prefix).rows


def with_running(rows: DataFrame, keys: list[str], value: Column, name: str, order: tuple[str, ...] = ("ts", "seq"), at: str = "es", known: int | None = None) -> DataFrame:
    return Ordered(rows, keys, order, at, known=known).running(value, name).rows


def most_buckets(seconds: int, years: int = 200) -> int:
    """How many buckets of a width a series of so many years has at most."""
    return years * 366 * DAY // seconds
