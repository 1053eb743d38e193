"""Quotes, depth and resting orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.operators.candles import bucketed
from tideframe.operators.spans import Ordered, cuts_of, with_previous


def quote_state(bid: str = "bid", ask: str = "ask") -> Column:
    b, a = F.col(bid), F.col(ask)
    return F.when(b.isNull() | a.isNull(), "incomplete").when(b > a, "crossed").when(b == a, "locked").otherwise("normal")


def midpoint(bid: str = "bid", ask: str = "ask", age: str | None = None, most_age: int | None = None) -> Column:
    """Half the sum of a valid quote's sides; null if crossed, incomplete or (given its ``age``) stale."""
    valid = F.col(bid) <= F.col(ask)
    if age is not None:
        valid = valid & (F.col(age) <= most_age)
    return F.when(valid, (F.col(bid) + F.col(ask)) / 2)


def quote_measures(quotes: DataFrame) -> DataFrame:
    """state, mid, spread, spread_bps, imbalance and microprice of each quote; null where undefined."""
    valid = F.col("bid") <= F.col("ask")
    sizes = F.col("bid_size") + F.col("ask_size")
    out = quotes.withColumn("state", quote_state()).withColumn("mid", midpoint()).withColumn("spread", F.when(valid, F.col("ask") - F.col("bid")))
    out = out.withColumn("spread_bps", F.try_divide(F.col("spread"), F.col("mid")) * 10_000)
    out = out.withColumn("imbalance", F.try_divide(F.col("bid_size") - F.col("ask_size"), sizes))
    return out.withColumn("microprice", F.when(valid, F.try_divide(F.col("bid") * F.col("ask_size") + F.col("ask") * F.col("bid_size"), sizes)))


def latest(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("ts", "seq")).alias("x")).select(*keys, "x.*")


def visible_depth(depth: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Size of the first ``levels`` of each side, their imbalance, and the concentration over all levels.

    The imbalance needs both sides to have all ``levels``; the concentration is the sum of squared shares.
    """
    near = F.col("level") <= levels

    def side(s: str, v: Column) -> Column:
        return F.when((F.col("side") == s) & near, v)

    size = F.col("size").cast("double")
    out = depth.groupBy(*keys).agg(
        F.sum(side("bid", size)).alias("bid_depth"),
        F.sum(side("ask", size)).alias("ask_depth"),
        F.count(side("bid", size)).alias("n_bid"),
        F.count(side("ask", size)).alias("n_ask"),
        F.try_divide(F.sum(size * size), F.sum(size) * F.sum(size)).alias("concentration"),
    )
    full = (F.col("n_bid") == levels) & (F.col("n_ask") == levels)
    share = F.try_divide(F.col("bid_depth") - F.col("ask_depth"), F.col("bid_depth") + F.col("ask_depth"))
    return out.withColumn("imbalance", F.when(full, share)).drop("n_bid", "n_ask")


def liquidity_change(depth: DataFrame, keys: list[str]) -> DataFrame:
    """Size added and removed at each side and price since it was last shown."""
    place = [*keys, "side", "price"]
    moved = with_previous(depth, place, ["size"]).withColumn("change", F.col("size") - F.col("prev_size"))
    return moved.groupBy(*place).agg(F.sum(F.when(F.col("change") > 0, F.col("change")).otherwise(0)).alias("added"), F.sum(F.when(F.col("change") < 0, -F.col("change")).otherwise(0)).alias("removed"))


def persistence(depth: DataFrame, keys: list[str], least_size: float, place: list[str]) -> DataFrame:
    """Islands of consecutive snapshots in which a place of the book holds at least ``least_size``.

    Snapshots are numbered by key; a place's island breaks where its numbers skip one.
    """
    cuts = cuts_of(depth, keys, "es")  # of all its rows: some more than snapshots need
    snaps = depth.select(*keys, "ts", "seq", "es").distinct()
    snaps = Ordered(snaps, keys, cuts=cuts).running(F.lit(1), "k").rows.drop("ts", "es")
    large = depth.where(F.col("size") >= least_size)
    cuts = cuts and cuts_of(large, [*keys, *place], "es")  # a place has no more rows than its key
    seen = Ordered(large.join(snaps, [*keys, "seq"]), [*keys, *place], cuts=cuts).previous(["k"]).islands(F.col("k") != F.col("prev_k") + 1, "island")
    islands = seen.rows.groupBy(*keys, *place, "island")
    return islands.agg(F.min("es").alias("start_es"), F.max("es").alias("end_es"), F.count(F.lit(1)).alias("snapshots")).drop("island")


def heatmap(depth: DataFrame, keys: list[str], seconds: int, least_levels: int = 15) -> DataFrame:
    """The last snapshot of each bucket as two ladders, best level first; thin books are left out."""
    rows = bucketed(depth, seconds)
    last = rows.groupBy(*keys, "bucket").agg(F.max(F.struct("ts", "seq")).alias("at")).select(*keys, "bucket", F.col("at.seq").alias("seq"))
    picked = rows.join(last, [*keys, "bucket", "seq"])

    def ladder(s: str) -> Column:
        both = F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("level", "price", "size"))))
        return F.transform(both, lambda x: F.struct(x["price"].alias("price"), x["size"].alias("qty")))

    out = picked.groupBy(*keys, "bucket").agg(ladder("bid").alias("bids"), ladder("ask").alias("asks"))
    return out.where((F.size("bids") >= least_levels) & (F.size("asks") >= least_levels))


#: Least notional of a large resting order.
LARGE = {"spot": 350_000.0, "perpetual": 1_000_000.0}


def large_orders(orders: DataFrame, fills: DataFrame, now: int, least: float) -> DataFrame:
    """Orders resting at ``now`` above a notional, with what was filled of them up to then."""
    open_ = orders.where(F.col("es") <= now).where(F.col("start_quantity") * F.col("price") >= least)
    done = fills.withColumnRenamed("es", "fill_es").where(F.col("fill_es") <= now).join(open_.select("id", "es"), "id").where("fill_es >= es")
    sums = done.groupBy("id").agg(F.sum("quantity").alias("executed_quantity"), F.count(F.lit(1)).alias("trade_count"))
    out = open_.join(sums, "id", "left").fillna(0, ["executed_quantity", "trade_count"])
    out = out.withColumn("current_quantity", F.greatest(F.col("start_quantity") - F.col("executed_quantity"), F.lit(0.0)))
    out = out.withColumn("start_usd", F.col("start_quantity") * F.col("price")).withColumn("current_usd", F.col("current_quantity") * F.col("price"))
    return out.withColumn("executed_usd", F.col("executed_quantity") * F.col("price")).withColumn("age", F.lit(now) - F.col("es"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """What became of each id between two snapshots: new, gone, changed or same."""
    a, b = before.select(key, F.col(value).alias("old")), after.select(key, F.col(value).alias("new"))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full_outer")
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return both.withColumn("state", state).drop("_a", "_b")
