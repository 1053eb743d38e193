"""As-of joins: the latest row of one table at or before each row of another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.operators.spans import Ordered


def asof(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], most_age: int | None = None, prefix: str = "q_") -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of its keys, at or before it, and its es.

    Both sides have ts, es and seq. Both are put in one order by key (heavy keys in spans, see
    ``spans``), so no key's whole history is sorted in one task. At one time right rows come first; of
    several the one of the highest seq counts.
    """
    taken = F.struct(F.col("ts").alias("ts"), F.col("es").alias("es"), *[F.col(v).alias(v) for v in values])
    l_rows = left.withColumn("_row", F.struct(*left.columns)).select(*keys, "ts", "es", "seq", F.lit(1).alias("_k"), "_row", F.lit(None).cast(right.select(taken.alias("t")).schema["t"].dataType).alias("_q"))
    r_rows = right.select(*keys, "ts", "es", "seq", F.lit(0).alias("_k"), F.lit(None).cast(l_rows.schema["_row"].dataType).alias("_row"), taken.alias("_q"))
    both = Ordered(l_rows.unionByName(r_rows), keys, ("ts", "_k", "seq"))
    met = both.latest(F.col("_q"), "_met", F.when(F.col("_k") == 0, F.struct("ts", "seq"))).rows.where("_k = 1")
    if most_age is not None:
        met = met.withColumn("_met", F.when(F.col("es") - F.col("_met.es") <= most_age, F.col("_met")))
    return met.select("_row.*", F.col("_met.es").alias(f"{prefix}es"), *[F.col(f"_met.{v}").alias(f"{prefix}{v}") for v in values])
