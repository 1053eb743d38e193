"""Trade flow: cumulative delta, footprints, liquidations, long/short ratios, aggressor estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.scalars import clamp, half_even, ratio
from tideframe.operators.candles import bucketed, last_in
from tideframe.operators.quantiles import quantile
from tideframe.operators.spans import Ordered

#: What each venue counts in an aggregate over venues.
VENUE_WEIGHTS = {"Binance": 1.0, "OKX": 0.72, "Bybit": 0.64}
#: Base long percentage and output prefix of each kind of ratio.
RATIO_BASES = {"top_position": 58.0, "top_account": 61.0, "global_account": 55.0}


def signed(side: str = "side", amount: str | Column = "size") -> Column:
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.when(F.col(side) == "BUY", amount).when(F.col(side) == "SELL", -amount).otherwise(F.lit(0) * amount)


def cvd(trades: DataFrame, keys: list[str], seconds: int, amount: str | Column) -> DataFrame:
    """buy, sell and cumulative delta of each bucket. Buckets are summed first; the running total sees buckets only."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    sums = bucketed(trades, seconds).groupBy(*keys, "bucket")
    sums = sums.agg(F.sum(F.when(F.col("side") == "BUY", amount).otherwise(0)).alias("buy"), F.sum(F.when(F.col("side") == "SELL", amount).otherwise(0)).alias("sell"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("cvd", F.sum(F.col("buy") - F.col("sell")).over(upto))


def venue_weights(spark, weights: dict[str, float] = VENUE_WEIGHTS) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "exchange string, weight double")


def weighted_by_venue(sums: DataFrame, keys: list[str], values: list[str], weights: dict[str, float] = VENUE_WEIGHTS) -> DataFrame:
    """Per-venue sums rolled up with their weights; venues without a weight don't count."""
    joined = sums.join(F.broadcast(venue_weights(sums.sparkSession, weights)), "exchange")  # a row for each venue named
    return joined.groupBy(*keys).agg(*[F.sum(F.col(v) * F.col("weight")).alias(v) for v in values])


def footprint(trades: DataFrame, keys: list[str], seconds: int, step: float) -> DataFrame:
    """Base and quote volume and trades of each bucket and price bin, by side."""
    level = (F.floor(F.col("price") / step) * step).alias("price_start")
    quote = F.col("price") * F.col("size")
    cells = bucketed(trades, seconds).groupBy(*keys, "bucket", level)

    def of(side: str, v: Column) -> Column:
        return F.sum(F.when(F.col("side") == side, v).otherwise(0))

    out = cells.agg(
        *[of(s, F.col("size")).alias(f"{s.lower()}_base") for s in ("BUY", "SELL")],
        *[of(s, quote).alias(f"{s.lower()}_quote") for s in ("BUY", "SELL")],
        *[of(s, F.lit(1)).alias(f"{s.lower()}_trades") for s in ("BUY", "SELL")],
    )
    return out.withColumn("price_end", F.col("price_start") + step)


def footprint_spread(state: DataFrame, keys: list[str], seconds: int, levels: int = 5, scale: float = 1.0) -> DataFrame:
    """A bucket's taker volume spread over ``levels`` steps around its close, heaviest in the middle."""
    half, weights = levels // 2, [levels - abs(i - levels // 2) for i in range(levels)]
    bars = bucketed(state, seconds).groupBy(*keys, "bucket").agg(last_in("btc_price").alias("price"), F.sum("taker_buy_volume_usd").alias("buy"), F.sum("taker_sell_volume_usd").alias("sell"))
    bars = bars.withColumn("step", F.greatest(F.lit(1.0), F.col("price") * 0.00025)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    share = F.element_at(F.array(*[F.lit(w / sum(weights)) for w in weights]), F.col("i") + 1)
    start = F.col("price") + (F.col("i") - half) * F.col("step")
    out = bars.withColumn("start", start).withColumn("mid", F.col("start") + F.col("step") / 2)
    for side in ("buy", "sell"):
        out = out.withColumn(f"{side}_quote", F.col(side) * scale * share).withColumn(f"{side}_base", ratio(F.col(f"{side}_quote"), F.col("mid")))
        out = out.withColumn(f"{side}_trades", F.greatest(F.lit(1), F.floor(F.col(f"{side}_base") / 0.03).cast("long")))
    ends = [half_even(F.col("start"), 2).alias("price_start"), half_even(F.col("start") + F.col("step"), 2).alias("price_end")]
    return out.select(*keys, "bucket", "i", *ends, "buy_base", "sell_base", "buy_quote", "sell_quote", "buy_trades", "sell_trades")


def nested_levels(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each bucket, its levels as an array of structs in price order."""
    rest = [c for c in cells.columns if c not in (*keys, "bucket", "price_start")]
    return cells.groupBy(*keys, "bucket").agg(F.sort_array(F.collect_list(F.struct("price_start", *rest))).alias("levels"))


def liquidation_events(state: DataFrame, least_usd: float = 0.0, most: int = 500) -> DataFrame:
    """Each sample's long (side 2, just below the price) and short (side 1, just above) liquidations, newest first."""
    long_ = F.struct(F.lit(2).alias("side"), (F.col("btc_price") * 0.999).alias("price"), F.col("long_liquidations").alias("usd_value"))
    short = F.struct(F.lit(1).alias("side"), (F.col("btc_price") * 1.001).alias("price"), F.col("short_liquidations").alias("usd_value"))
    events = state.select("seq", "ts", "es", "symbol", "exchange", F.explode(F.array(long_, short)).alias("e")).select("seq", "ts", "es", "symbol", "exchange", "e.*")
    kept = events.where((F.col("usd_value") > 0) & (F.col("usd_value") >= least_usd))
    return kept.orderBy(F.desc("ts"), F.desc("seq"), F.desc("side")).limit(most)


def liquidation_history(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Long and short liquidations of each bucket and venue."""
    out = bucketed(events, seconds).groupBy(*keys, "exchange", "bucket")
    return out.agg(F.sum(F.when(F.col("side") == 2, F.col("usd_value")).otherwise(0)).alias("long_usd"), F.sum(F.when(F.col("side") == 1, F.col("usd_value")).otherwise(0)).alias("short_usd"))


def long_short_ratio(state: DataFrame, keys: list[str], seconds: int, kind: str, scale: float = 1.0) -> DataFrame:
    """Long and short percentage of the last row of each bucket, and their ratio."""
    base = RATIO_BASES[kind]
    picked = F.struct("taker_buy_volume_usd", "taker_sell_volume_usd", "funding_rate")
    last = bucketed(state, seconds).groupBy(*keys, "bucket").agg(last_in(picked).alias("x")).select(*keys, "bucket", "x.*")
    buy, sell = F.col("taker_buy_volume_usd"), F.col("taker_sell_volume_usd")
    pressure = (buy - sell) / F.greatest(buy + sell, F.lit(1.0))
    long_ = clamp(base + pressure * 18.0 + F.col("funding_rate") * 6000.0, 5.0, 95.0)
    last = last.withColumn("l", 50.0 + (long_ - 50.0) * scale).withColumn("s", 100.0 - F.col("l"))
    return last.select(*keys, "bucket", half_even(F.col("l"), 4).alias("long_percent"), half_even(F.col("s"), 4).alias("short_percent"), half_even(ratio(F.col("l"), F.col("s")), 6).alias("long_short_ratio"))


def tape_bars(trades: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Per bar: trades, volume, their rates a second, and the volume-weighted price."""
    out = bucketed(trades, seconds).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("trades"), F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("notional"))
    out = out.withColumn("wap", F.try_divide("notional", "volume")).withColumn("volume_rate", F.col("volume") / seconds)
    return out.withColumn("trade_rate", F.col("trades") / seconds)


def aggressor(joined: DataFrame) -> Column:
    """BUY at or above the ask, SELL at or below the bid, else UNKNOWN (also without a valid quote)."""
    valid = F.col("q_bid").isNotNull() & F.col("q_ask").isNotNull() & (F.col("q_bid") < F.col("q_ask"))
    return F.when(valid & (F.col("price") >= F.col("q_ask")), "BUY").when(valid & (F.col("price") <= F.col("q_bid")), "SELL").otherwise("UNKNOWN")


def large_trades(trades: DataFrame, keys: list[str], seconds: int, percentile: float | None = None, absolute: float | None = None) -> DataFrame:
    """Count and notional of trades at or above a size: a fixed one, or a percentile of each symbol's sizes."""
    if (percentile is None) == (absolute is None):
        raise ValueError("give one of percentile and absolute")
    if percentile is not None:
        trades = trades.join(quantile(trades, ["symbol"], "size", percentile, "limit"), "symbol")
    else:
        trades = trades.withColumn("limit", F.lit(absolute))
    large = trades.where(F.col("size") >= F.col("limit"))
    return bucketed(large, seconds).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("large_trades"), F.sum(F.col("price") * F.col("size")).alias("large_notional"))


def sweeps(trades: DataFrame, keys: list[str], most_gap: int, least_levels: int) -> DataFrame:
    """Runs of same-side trades, each within ``most_gap`` seconds of the last, that cross prices one way."""
    known = Ordered(trades.where(F.col("side").isin("BUY", "SELL")), keys).previous(["price", "side", "es"])
    up = F.col("price") - F.col("prev_price")
    away = F.when(F.col("side") == "BUY", up >= 0).otherwise(up <= 0)
    same = (F.col("prev_side") == F.col("side")) & (F.col("es") - F.col("prev_es") <= most_gap) & away
    out = known.islands(~same, "run").rows.groupBy(*keys, "run").agg(F.first("side").alias("side"), F.min("es").alias("start_es"), F.max("es").alias("end_es"), F.count(F.lit(1)).alias("trades"), F.countDistinct("price").alias("levels"), F.sum("size").alias("volume"))
    return out.where(F.col("levels") >= least_levels).drop("run")
