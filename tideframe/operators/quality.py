"""Data quality, references, catalogs and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.operators.spans import with_previous


def quality_report(rows: DataFrame, keys: list[str], cadence: int, now: int, stale_after: int, id_column: str = "seq", received: str = "received") -> DataFrame:
    """Per key: coverage of the grid, gaps, duplicates, rows received out of order, age and staleness.

    ``received`` is a number that grows with receipt.
    """
    cell = F.col("es") - F.pmod("es", F.lit(cadence))
    # repeats of one row were received together, so their order does not matter
    seen = with_previous(rows, keys, ["es"], (received, id_column), at=received)
    marked = seen.withColumn("_late", F.when(F.col("prev_es") > F.col("es"), 1).otherwise(0))
    ids = rows.groupBy(*keys, id_column).agg(F.count(F.lit(1)).alias("k"))
    doubles = ids.groupBy(*keys).agg(F.sum(F.col("k") - 1).alias("duplicates"))
    # distinct cells by two aggregates, so a key's cells aren't one set in one task
    cells = rows.groupBy(*keys, cell.alias("cell")).agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count(F.lit(1)).alias("observed"), F.min("cell").alias("a"), F.max("cell").alias("b"))
    sums = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("_late").alias("out_of_order"), F.max("es").alias("last_es"))
    out = sums.join(doubles, keys).join(cells, keys).withColumn("expected", ((F.col("b") - F.col("a")) / cadence).cast("long") + 1)
    out = out.withColumn("gaps", F.col("expected") - F.col("observed")).withColumn("coverage", F.col("observed") / F.col("expected"))
    return out.withColumn("age", F.lit(now) - F.col("last_es")).withColumn("stale", F.col("age") > stale_after).drop("a", "b", "last_es")


def violation_codes(checks: dict[str, Column]) -> Column:
    """The codes of the checks that a row fails; a check that is null fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()]))


def unknown_references(rows: DataFrame, reference: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names nothing."""
    return rows.join(known.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def compared(expected: DataFrame, actual: DataFrame, key: str, value: str, tolerance: str) -> DataFrame:
    """Whether each expected value was met within its tolerance; missing ones weren't."""
    got = actual.select(F.col(key), F.col(value).alias("actual"))
    out = expected.join(got, key, "left").withColumn("difference", F.abs(F.col("actual") - F.col(value)))
    return out.withColumn("met", F.coalesce(F.col("difference") <= F.col(tolerance), F.lit(False)))
