"""Fund flows and holdings, exchange transfers, on-chain metrics, supply and bridge flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.scalars import bucket, ratio
from tideframe.operators.candles import bucketed, last_in

_CENTS = "decimal(18,2)"


def cents(v: str | Column) -> Column:
    """Sums of two-decimal amounts, exact whatever the order."""
    return F.sum((F.col(v) if isinstance(v, str) else v).cast(_CENTS))


def daily_flows(flows: DataFrame, day: str = "day_s") -> DataFrame:
    """Per day the total flow and the flow of each ticker, as an array ordered by ticker."""
    parts = flows.groupBy(day, "ticker").agg(cents("flow_usd").cast("double").alias("flow_usd"))
    total = F.sum(F.col("flow_usd").cast(_CENTS)).cast("double")
    return parts.groupBy(day).agg(total.alias("flow_usd"), F.sort_array(F.collect_list(F.struct("ticker", "flow_usd"))).alias("breakdown"))


def catalog(holdings: DataFrame) -> DataFrame:
    """One row for each ticker, its latest version, with assets and shares derived."""
    newest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("version")))
    rows = holdings.withColumn("_n", newest).where("_n = 1").drop("_n").withColumn("aum", F.col("holding") * F.col("price"))
    shares = F.greatest(F.lit(1.0), F.col("aum") / F.greatest(F.col("nav").cast("double"), F.lit(1.0)))
    return rows.withColumn("shares", shares.cast("long"))


def exchange_flow(transfers: DataFrame, keys: list[str], seconds: int, direction: str, top: int = 10) -> DataFrame:
    """Total, mean and the sum of the ``top`` largest transfers of each bucket.

    The largest are found by rank inside (keys, bucket); Spark keeps no more than ``top`` rows of each
    task before the shuffle. The total and the mean are a plain aggregate of the same rows.
    """
    rows = bucketed(transfers.where(F.col("direction") == direction), seconds)
    order = Window.partitionBy(*keys, "bucket").orderBy(F.desc("amount"), "id")
    best = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    best = best.groupBy(*keys, "bucket").agg(cents("amount").cast("double").alias("top"))
    sums = rows.groupBy(*keys, "bucket").agg(cents("amount").cast("double").alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.join(best, [*keys, "bucket"]).withColumn("mean", F.col("total") / F.col("n"))


def fixed_share(total: Column, direction: str) -> Column:
    """The top-ten part as a fixed share of the total, for sources that publish no transfers."""
    return total * {"in": 0.63, "out": 0.61}[direction]


def metric(state: DataFrame, keys: list[str], value: str | Column, seconds: int, how: str = "close") -> DataFrame:
    """A scalar series: the last value of each bucket, its mean or its sum."""
    v = F.col(value) if isinstance(value, str) else value
    of = {"close": last_in(v), "mean": F.avg(v), "sum": F.sum(v)}
    if how not in of:
        raise ValueError("how must be close, mean or sum")
    return bucketed(state, seconds).groupBy(*keys, "bucket").agg(of[how].alias("value"))


def leverage_ratio(state: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    last = bucketed(state, seconds).groupBy(*keys, "bucket").agg(last_in(F.struct("open_interest", "exchange_reserve", "btc_price")).alias("x"))
    return last.select(*keys, "bucket", ratio(F.col("x.open_interest"), F.col("x.exchange_reserve") * F.col("x.btc_price")).alias("value"))


def log_returns(bars: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    before = F.lag("close", n).over(Window.partitionBy(*keys).orderBy("bucket"))
    out = bars.withColumn("simple_return", F.try_divide(F.col("close"), before) - 1)
    return out.withColumn("log_return", F.ln(F.try_divide(F.col("close"), before)))


def reconciled(stock: DataFrame, keys: list[str], change: Column, tolerance: float = 1e-6) -> DataFrame:
    """Whether the change of a stock since the row before equals the stated flow."""
    moved = F.col("stock") - F.lag("stock").over(Window.partitionBy(*keys).orderBy("bucket"))
    return stock.withColumn("residual", moved - change).withColumn("matches", F.abs("residual") <= tolerance)


def reanchored(series: DataFrame, keys: list[str], anchor: float, mode: str) -> DataFrame:
    """A series (bucket, value) moved so that its last value is ``anchor``."""
    every = Window.partitionBy(*keys)
    whole = every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last("value").over(whole)
    progress = F.row_number().over(every.orderBy("bucket")) / F.count(F.lit(1)).over(every)
    floor = F.greatest(last, F.lit(1e-9))
    new = {
        "geometric": F.col("value") * F.exp(F.ln(F.greatest(F.lit(anchor), F.lit(1e-9)) / floor) * progress),
        "additive_progressive": F.col("value") + (anchor - last) * progress,
        "additive_constant": F.col("value") + (anchor - last),
        "multiplicative": F.col("value") * (anchor / floor),
    }
    return series.withColumn("value", new[mode])


EPOCH_SECONDS = 1_209_600


def difficulty_epochs(state: DataFrame, keys: list[str], value: str = "difficulty") -> DataFrame:
    """The value at the end of each 14-day epoch, its step, and whether the step leaves 0.92 to 1.08."""
    out = metric(state, keys, value, EPOCH_SECONDS)
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy("bucket"))
    out = out.withColumn("step", F.try_divide(F.col("value"), before))
    return out.withColumn("flagged", F.coalesce((F.col("step") < 0.92) | (F.col("step") > 1.08), F.lit(False)))


def bridge_flows(events: DataFrame, seconds: int) -> DataFrame:
    """Deposits, withdrawals and pending of each bucket, net, and the running net."""
    sums = bucketed(events, seconds).groupBy("bucket")
    parts = [cents(F.when(F.col("kind") == k, F.col("amount")).otherwise(0)).alias(c) for k, c in (("deposit", "deposits"), ("withdrawal", "withdrawals"), ("pending", "pending"))]
    sums = sums.agg(*parts).withColumn("net", F.col("deposits") - F.col("withdrawals"))
    # one bridge is one series: its buckets, not its events, are what the running sum sees
    upto = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("cumulative", F.sum("net").over(upto))
    return sums.select("bucket", *[F.col(c).cast("double").alias(c) for c in ("deposits", "withdrawals", "pending", "net", "cumulative")])


def limit_use(flows: DataFrame, limits: DataFrame) -> DataFrame:
    """Each bucket's deposits against the limit in force: the last one set at or before it."""
    both = flows.select("bucket", "deposits", F.lit(None).cast("double").alias("limit_amount")).unionByName(limits.select(F.col("es").alias("bucket"), F.lit(None).cast("double").alias("deposits"), "limit_amount"))
    order = Window.partitionBy(F.lit(0)).orderBy("bucket", F.col("deposits").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("limit_amount", F.last("limit_amount", ignorenulls=True).over(order)).where("deposits is not null")
    return held.withColumn("use", F.try_divide("deposits", "limit_amount"))


def month_block(es: str = "es") -> Column:
    return bucket(F.col(es), 2_592_000)
