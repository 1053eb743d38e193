"""Recursions v -> min(high, max(low, a * v + b)) over a key's rows in order, by prefix composition.

One step is a clamped affine map, and maps of this kind compose to one of the same kind: four numbers
stand for any stretch of rows. So a key's rows are cut into spans (see ``spans``); each task composes the
maps of its rows from the span's beginning; what a span starts from follows from the maps of the spans
before it, of which a key has a bounded number. A key of any length is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.operators.spans import Ordered


class Maps(NamedTuple):
    """Maps v -> min(high, max(low, a * v + b)), a >= 0, low <= high, one for each element."""

    a: np.ndarray
    b: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def take(self, at) -> Maps:
        return Maps(*[x[at] for x in self])

    def then(self, after: Maps) -> Maps:
        """First this, then ``after``: clamps move through the affine part and meet those of ``after``."""
        moved = [np.clip(after.a * x + after.b, after.low, after.high) for x in (self.low, self.high)]
        return Maps(self.a * after.a, after.a * self.b + after.b, *moved)

    def of(self, v):
        return np.minimum(self.high, np.maximum(self.low, self.a * v + self.b))


def composed(maps: Maps, place: np.ndarray) -> Maps:
    """Each element's map after those before it in its stretch; ``place`` counts from 0 where a stretch begins.

    By doubling: after round k an element holds the composition of up to 2 ** k maps that end with its own.
    """
    maps, step = Maps(*[np.array(x, float) for x in maps]), 1
    while step <= (place.max() if len(place) else 0):
        at = np.flatnonzero(place >= step)
        for x, new in zip(maps, maps.take(at - step).then(maps.take(at)), strict=True):
            x[at] = new
        step *= 2
    return maps


def clamped_affine(rows: DataFrame, keys: list[str], a: float, b: Column, low: float, high: float, start: float, name: str, order: tuple[str, ...] = ("bucket",), at: str = "bucket", most: int | None = None, known: int | None = None) -> DataFrame:
    """Adds ``name``: the recursion's value after each row of its key, by ``order``, from ``start`` on.

    Null ``b`` counts as 0. Columns of ``rows`` pass through Python, so select those that are wanted.
    """
    ordered = Ordered(rows.withColumn("_b", F.coalesce(b.cast("double"), F.lit(0.0))), keys, order, at, most, known=known)
    numbered = ordered.spanned.withColumn("_i", F.row_number().over(ordered.window()))
    names = ("_a", "_b", "_low", "_high")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the composition up to the last row seen, for a span that goes on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            i = batch.column("_i").to_numpy()
            value = batch.column("_b").to_numpy()
            n = len(i)
            # rows before the batch are out of reach: places count inside it
            found = composed(Maps(np.full(n, a), value, np.full(n, low), np.full(n, high)), np.minimum(i - 1, np.arange(n)))
            goes_on = np.flatnonzero(i > np.arange(1, n + 1))  # of the span that began in an earlier batch
            if len(goes_on):
                for x, new in zip(found, last.then(found.take(goes_on)), strict=True):
                    x[goes_on] = new
            last = found.take(slice(n - 1, n))
            kept = [c for c in batch.schema.names if c not in ("_b", "_i")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(x) for x in found]], names=[*kept, *names])

    plain = numbered.drop("_b", "_i")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + "".join(f", {c} double" for c in names)
    mapped = numbered.select(*plain.columns, "_b", "_i").mapInArrow(compose, schema)
    apply = lambda v: F.least(F.col("_high"), F.greatest(F.col("_low"), F.col("_a") * v + F.col("_b")))
    if not ordered.cut:
        return mapped.withColumn(name, apply(F.lit(float(start)))).select(*rows.columns, name)
    ends = mapped.groupBy(*ordered.inside).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("m"))
    chain = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_span", "m"))).alias("spans"))  # as many as a key has spans, which is bounded

    def on(acc: Column, x: Column) -> Column:
        v = F.least(x["m"]["_high"], F.greatest(x["m"]["_low"], x["m"]["_a"] * acc["v"] + x["m"]["_b"]))
        began = F.struct(x["_span"].alias("_span"), acc["v"].alias("v"))
        return F.struct(v.alias("v"), F.concat(acc["begins"], F.array(began)).alias("begins"))

    zero = F.struct(F.lit(float(start)).alias("v"), F.array().cast("array<struct<_span:int,v:double>>").alias("begins"))
    begins = chain.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.inline(F.aggregate("spans", zero, on, lambda acc: acc["begins"])))
    begins = begins.withColumnsRenamed({"_span": "_c__span", "v": "_v0"})
    same = F.lit(True)
    for c in ordered.inside:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return mapped.join(begins, same).withColumn(name, apply(F.col("_v0"))).select(*rows.columns, name)
