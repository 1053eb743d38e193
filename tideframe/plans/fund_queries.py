"""Queries over fund flows, transfers, on-chain metrics and the bridge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.operators import candles as C
from tideframe.operators import funds as U
from tideframe.operators import risk as R
from tideframe.operators.flow import signed
from tideframe.plans.registry import query, r6

_D = "DECIMAL(18,2)"


@query(
    "fund_flows",
    "fund_flows",
    sql=f"""WITH p AS (SELECT day_s, ticker, sum(flow_usd::{_D})::DOUBLE AS flow_usd FROM {{fund_flows}} GROUP BY ALL)
    SELECT day_s, (sum(flow_usd::{_D}) OVER (PARTITION BY day_s))::DOUBLE AS day_flow, ticker, flow_usd FROM p""",
)
def fund_flows(flows: DataFrame) -> DataFrame:
    """Day totals with their breakdown, flat again."""
    return U.daily_flows(flows).select("day_s", F.col("flow_usd").alias("day_flow"), F.inline("breakdown")).select("day_s", "day_flow", "ticker", "flow_usd")


@query(
    "fund_flows_wide",
    "fund_flows",
    sql=f"SELECT day_s, " + ", ".join(f"(sum(flow_usd::{_D}) FILTER (ticker = 'F{i}'))::DOUBLE AS f{i}" for i in range(8)) + " FROM {fund_flows} GROUP BY 1",
)
def fund_flows_wide(flows: DataFrame) -> DataFrame:
    wide = flows.groupBy("day_s").pivot("ticker", [f"F{i}" for i in range(8)]).agg(U.cents("flow_usd").cast("double"))
    return wide.select("day_s", *[F.col(f"F{i}").alias(f"f{i}") for i in range(8)])


@query(
    "fund_catalog",
    "fund_holdings",
    sql="""SELECT ticker, version, holding, round(holding * price, 4) AS aum, trunc(greatest(1.0, holding * price / greatest(nav, 1.0)))::BIGINT AS shares
    FROM {fund_holdings} QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY version DESC) = 1""",
)
def fund_catalog(holdings: DataFrame) -> DataFrame:
    return U.catalog(holdings).select("ticker", "version", "holding", F.round("aum", 4).alias("aum"), "shares")


for _name, _way in (("exchange_inflow", "in"), ("exchange_outflow", "out")):

    @query(
        _name,
        "transfers",
        sql=f"""WITH r AS (SELECT es // 86400 * 86400 AS bucket, amount, row_number() OVER (PARTITION BY es // 86400 ORDER BY amount DESC, id) AS k FROM {{transfers}} WHERE direction = '{_way}')
        SELECT bucket, sum(amount::{_D})::DOUBLE AS total, (sum(amount::{_D}) FILTER (k <= 10))::DOUBLE AS top10, round(sum(amount::{_D})::DOUBLE / count(*), 6) AS mean,
            round(sum(amount::{_D})::DOUBLE * {0.63 if _way == "in" else 0.61}, 4) AS top10_fixed FROM r GROUP BY 1""",
    )
    def _flow(transfers: DataFrame, way: str = _way) -> DataFrame:
        out = U.exchange_flow(transfers, [], 86400, way)
        fixed = F.round(U.fixed_share(F.col("total"), way), 4).alias("top10_fixed")
        return out.select("bucket", "total", F.col("top").alias("top10"), *r6("mean"), fixed)


def _last_sql(value: str, seconds: int = 86400, digits: int = 6) -> str:
    return f"SELECT symbol, es // {seconds} * {seconds} AS bucket, round(arg_max({value}, (ts, seq)), {digits}) AS value FROM {{market_state}} GROUP BY ALL"


@query(
    "exchange_reserve",
    "market_state",
    sql="""SELECT symbol, es // 86400 * 86400 AS bucket, arg_max(exchange_reserve, (ts, seq)) AS reserve, round(arg_max(exchange_reserve, (ts, seq)) * arg_max(btc_price, (ts, seq)), 4) AS reserve_usd FROM {market_state} GROUP BY ALL""",
)
def exchange_reserve(state: DataFrame) -> DataFrame:
    both = U.metric(state, ["symbol"], F.struct("exchange_reserve", "btc_price"), 86400)
    usd = F.round(F.col("value.exchange_reserve") * F.col("value.btc_price"), 4)
    return both.select("symbol", "bucket", F.col("value.exchange_reserve").alias("reserve"), usd.alias("reserve_usd"))


for _name, _value, _how, _sql in (
    ("mpi", "mpi", "close", _last_sql("mpi")),
    ("metric_sopr", "sopr", "close", _last_sql("sopr")),
    ("metric_hash_rate", "hash_rate", "close", _last_sql("hash_rate")),
    ("metric_difficulty", "difficulty", "close", _last_sql("difficulty")),
    ("metric_mean", "hash_rate", "mean", "SELECT symbol, es // 86400 * 86400 AS bucket, round(avg(hash_rate), 6) AS value FROM {market_state} GROUP BY ALL"),
    ("metric_sum", "volume", "sum", "SELECT symbol, es // 86400 * 86400 AS bucket, round(sum(volume), 6) AS value FROM {market_state} GROUP BY ALL"),
):

    @query(_name, "market_state", sql=_sql)
    def _metric(state: DataFrame, value: str = _value, how: str = _how) -> DataFrame:
        return U.metric(state, ["symbol"], value, 86400, how).select("symbol", "bucket", *r6("value"))


@query("metric_native_usd", "market_state", sql="SELECT symbol, es // 86400 * 86400 AS bucket, arg_max(volume, (ts, seq)) AS native, round(arg_max(volume, (ts, seq)) * arg_max(btc_price, (ts, seq)), 4) AS usd FROM {market_state} GROUP BY ALL")
def metric_native_usd(state: DataFrame) -> DataFrame:
    """A miner metric in coins and in dollars at the bucket's last price."""
    both = U.metric(state, ["symbol"], F.struct("volume", "btc_price"), 86400)
    return both.select("symbol", "bucket", F.col("value.volume").alias("native"), F.round(F.col("value.volume") * F.col("value.btc_price"), 4).alias("usd"))


@query(
    "leverage_ratio",
    "market_state",
    sql="""WITH b AS (SELECT symbol, es // 86400 * 86400 AS bucket, arg_max(open_interest, (ts, seq)) AS oi, arg_max(exchange_reserve, (ts, seq)) AS r, arg_max(btc_price, (ts, seq)) AS p FROM {market_state} GROUP BY ALL)
    SELECT symbol, bucket, round(CASE WHEN r * p = 0 THEN 0 ELSE oi / (r * p) END, 9) AS value FROM b""",
)
def leverage_ratio(state: DataFrame) -> DataFrame:
    return U.leverage_ratio(state, ["symbol"], 86400).select("symbol", "bucket", F.round("value", 9).alias("value"))


_DAILY = "b AS (SELECT symbol, es // 86400 * 86400 AS bucket, arg_min(price, (ts, seq)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts, seq)) AS c FROM {ticks} GROUP BY ALL)"


def daily(ticks: DataFrame) -> DataFrame:
    return C.candles(ticks, ["symbol"], "price", 86400)


@query("log_returns", "ticks", sql=f"WITH {_DAILY} SELECT symbol, bucket, round(ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY bucket)), 9) AS log_return FROM b")
def log_returns(ticks: DataFrame) -> DataFrame:
    return U.log_returns(daily(ticks), ["symbol"]).select("symbol", "bucket", F.round("log_return", 9).alias("log_return"))


_STOCK = f"""n AS (SELECT es // 86400 * 86400 AS bucket, sum(CASE direction WHEN 'in' THEN amount ELSE 0 END::{_D}) AS i, sum(CASE direction WHEN 'out' THEN amount ELSE 0 END::{_D}) AS o FROM {{transfers}} GROUP BY 1)"""


@query(
    "stock_flow_check",
    "transfers",
    sql=f"""WITH {_STOCK}, s AS (SELECT *, sum(i - o) OVER (ORDER BY bucket) AS stock FROM n)
    SELECT bucket, stock::DOUBLE AS stock, round((stock - lag(stock) OVER (ORDER BY bucket) - (i - o))::DOUBLE, 6) AS residual FROM s""",
)
def stock_flow(transfers: DataFrame) -> DataFrame:
    """The stock that daily flows add up to, and what its changes leave unexplained (nothing)."""
    signed = F.when(F.col("direction") == "in", F.col("amount")).otherwise(-F.col("amount"))
    days = C.bucketed(transfers, 86400).groupBy("bucket").agg(U.cents(signed).alias("net"))
    upto = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    stock = days.withColumn("stock", F.sum("net").over(upto)).withColumn("one", F.lit(0))
    out = U.reconciled(stock, ["one"], F.col("net"))
    return out.select("bucket", F.col("stock").cast("double").alias("stock"), *r6("residual"))


@query(
    "reserve_flow_residual",
    "market_state",
    "trades",
    sql="""WITH s AS (SELECT symbol, es // 86400 * 86400 AS bucket, arg_max(exchange_reserve, (ts, seq)) AS stock FROM {market_state} GROUP BY ALL),
    f AS (SELECT symbol, es // 86400 * 86400 AS bucket, sum(CASE side WHEN 'BUY' THEN size ELSE -size END)::DOUBLE AS net FROM {trades} GROUP BY ALL),
    b AS (SELECT s.symbol, s.bucket, stock, coalesce(net, 0) AS net, stock - lag(stock) OVER (PARTITION BY s.symbol ORDER BY s.bucket) AS moved FROM s LEFT JOIN f ON f.symbol = s.symbol AND f.bucket = s.bucket)
    SELECT symbol, bucket, stock, net, round(moved - net, 6) AS residual, abs(moved - net) <= 1e-6 AS matches FROM b""",
)
def reserve_flow(state: DataFrame, trades: DataFrame) -> DataFrame:
    """An observed reserve against the flows of the tape: what the day's flow leaves unexplained of its change."""
    stock = U.metric(state, ["symbol"], "exchange_reserve", 86400).select("symbol", "bucket", F.col("value").alias("stock"))
    flows = C.bucketed(trades, 86400).groupBy("symbol", "bucket").agg(F.sum(signed()).cast("double").alias("net"))
    both = stock.join(flows, ["symbol", "bucket"], "left").withColumn("net", F.coalesce("net", F.lit(0.0)))
    return U.reconciled(both, ["symbol"], F.col("net")).select("symbol", "bucket", "stock", "net", *r6("residual"), "matches")


for _mode, _sql in (
    ("geometric", "c * exp(ln(150.0 / greatest(z, 1e-9)) * k / n)"),
    ("additive_progressive", "c + (150.0 - z) * k / n"),
    ("additive_constant", "c + (150.0 - z)"),
    ("multiplicative", "c * (150.0 / greatest(z, 1e-9))"),
):

    @query(
        f"reanchor_{_mode}",
        "ticks",
        sql=f"""WITH {_DAILY}, w AS (SELECT symbol, bucket, c, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS k, count(*) OVER (PARTITION BY symbol) AS n,
            last_value(c) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM b) SELECT symbol, bucket, round({_sql}, 6) AS value FROM w""",
    )
    def _reanchor(ticks: DataFrame, mode: str = _mode) -> DataFrame:
        series = daily(ticks).select("symbol", "bucket", F.col("close").alias("value"))
        return U.reanchored(series, ["symbol"], 150.0, mode).select("symbol", "bucket", *r6("value"))


@query(
    "difficulty_epochs",
    "market_state",
    sql="""WITH b AS (SELECT symbol, es // 1209600 * 1209600 AS bucket, arg_max(difficulty, (ts, seq)) AS value FROM {market_state} GROUP BY ALL),
    s AS (SELECT *, value / lag(value) OVER (PARTITION BY symbol ORDER BY bucket) AS step FROM b)
    SELECT symbol, bucket, round(value, 6) AS value, round(step, 9) AS step, coalesce(step < 0.92 OR step > 1.08, false) AS flagged FROM s""",
)
def difficulty_epochs(state: DataFrame) -> DataFrame:
    return U.difficulty_epochs(state, ["symbol"]).select("symbol", "bucket", *r6("value"), F.round("step", 9).alias("step"), "flagged")


_BRIDGE = f"""f AS (SELECT es // 86400 * 86400 AS bucket, sum(CASE kind WHEN 'deposit' THEN amount ELSE 0 END::{_D}) AS d, sum(CASE kind WHEN 'withdrawal' THEN amount ELSE 0 END::{_D}) AS w, sum(CASE kind WHEN 'pending' THEN amount ELSE 0 END::{_D}) AS p FROM {{bridge_events}} GROUP BY 1)"""


@query("bridge_flow", "bridge_events", sql=f"WITH {_BRIDGE} SELECT bucket, d::DOUBLE AS deposits, w::DOUBLE AS withdrawals, p::DOUBLE AS pending, (d - w)::DOUBLE AS net, (sum(d - w) OVER (ORDER BY bucket))::DOUBLE AS cumulative FROM f")
def bridge_flow(events: DataFrame) -> DataFrame:
    return U.bridge_flows(events, 86400)


@query(
    "bridge_limit_use",
    "bridge_events",
    sql=f"""WITH {_BRIDGE}, m AS (SELECT es // 2592000 * 2592000 AS es, max(amount) AS lim FROM {{bridge_events}} GROUP BY 1)
    SELECT bucket, d::DOUBLE AS deposits, lim AS limit_amount, round(d::DOUBLE / lim, 6) AS use FROM f ASOF JOIN m ON f.bucket >= m.es""",
)
def bridge_limit_use(events: DataFrame) -> DataFrame:
    """The limit of a month block is its largest amount."""
    limits = events.groupBy(U.month_block().alias("es")).agg(F.max("amount").alias("limit_amount"))
    return U.limit_use(U.bridge_flows(events, 86400), limits).select("bucket", "deposits", "limit_amount", *r6("use"))


@query(
    "supply_reconciliation",
    "supply",
    sql=f"""WITH n AS (SELECT es // 86400 * 86400 AS bucket, sum(mint::{_D}) AS m, sum(burn::{_D}) AS b FROM {{supply}} GROUP BY 1), s AS (SELECT *, sum(m - b) OVER (ORDER BY bucket) AS stock FROM n)
    SELECT bucket, m::DOUBLE AS mint, b::DOUBLE AS burn, stock::DOUBLE AS supply, coalesce(abs(stock - lag(stock) OVER (ORDER BY bucket) - (m - b)) <= 1e-6, true) AS matches FROM s""",
)
def supply_reconciliation(supply: DataFrame) -> DataFrame:
    days = C.bucketed(supply, 86400).groupBy("bucket").agg(U.cents("mint").alias("mint"), U.cents("burn").alias("burn"))
    upto = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    stock = days.withColumn("stock", F.sum(F.col("mint") - F.col("burn")).over(upto)).withColumn("one", F.lit(0))
    out = U.reconciled(stock, ["one"], F.col("mint") - F.col("burn"))
    return out.select("bucket", *[F.col(a).cast("double").alias(b) for a, b in (("mint", "mint"), ("burn", "burn"), ("stock", "supply"))], F.coalesce("matches", F.lit(True)).alias("matches"))


@query(
    "supply_misreports",
    "supply",
    sql=f"""WITH n AS (SELECT es // 86400 * 86400 AS bucket, sum(mint::{_D}) AS m, sum(burn::{_D}) AS b, arg_max(id, (es, id)) AS report FROM {{supply}} GROUP BY 1),
    s AS (SELECT *, sum(m - b) OVER (ORDER BY bucket) + CASE WHEN report % 7 = 0 THEN 1 ELSE 0 END AS stock FROM n)
    SELECT bucket, stock::DOUBLE AS supply, round((stock - lag(stock) OVER (ORDER BY bucket) - (m - b))::DOUBLE, 6) AS residual FROM s QUALIFY abs(residual) > 1e-6""",
)
def supply_misreports(supply: DataFrame) -> DataFrame:
    """Days on which reported supply and the day's mint and burn disagree; reports of ids divisible by 7 are off by one."""
    days = C.bucketed(supply, 86400).groupBy("bucket").agg(U.cents("mint").alias("mint"), U.cents("burn").alias("burn"), F.max_by("id", F.struct("es", "id")).alias("report"))
    upto = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # days, not rows
    true = F.sum(F.col("mint") - F.col("burn")).over(upto)
    reported = days.withColumn("stock", true + F.when(F.col("report") % 7 == 0, 1).otherwise(0)).withColumn("one", F.lit(0))
    out = U.reconciled(reported, ["one"], F.col("mint") - F.col("burn")).where("NOT matches")
    return out.select("bucket", F.col("stock").cast("double").alias("supply"), *r6("residual"))


@query(
    "liquidation_ratio",
    "market_state",
    sql="""WITH r AS (SELECT seq, symbol, (long_liquidations + short_liquidations) / greatest(lag(open_interest) OVER (PARTITION BY symbol ORDER BY ts, seq), 1.0) AS q FROM {market_state})
    SELECT seq, symbol, round(q, 9) AS ratio, coalesce(q > 0.002, false) AS severe FROM r""",
)
def liquidation_ratio(state: DataFrame) -> DataFrame:
    out = R.liquidation_ratio(state, ["symbol"])
    return out.select("seq", "symbol", F.round("ratio", 9).alias("ratio"), "severe")
