"""Queries over trade flow, liquidations and long/short ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions import scalars as S
from tideframe.operators import candles as C
from tideframe.operators import flow as W
from tideframe.operators.asof import asof
from tideframe.plans.registry import query, r6

_VENUES = "v(exchange, weight) AS (VALUES ('Binance', 1.0::DOUBLE), ('OKX', 0.72::DOUBLE), ('Bybit', 0.64::DOUBLE))"


def _cvd_sql(market: str, amount: str = "price * size") -> str:
    return f"""WITH b AS (SELECT symbol, es // 14400 * 14400 AS bucket, sum(CASE WHEN side = 'BUY' THEN {amount} ELSE 0 END) AS buy,
        sum(CASE WHEN side = 'SELL' THEN {amount} ELSE 0 END) AS sell FROM {{trades}} WHERE market = '{market}' GROUP BY ALL)
    SELECT symbol, bucket, round(buy, 4) AS buy, round(sell, 4) AS sell, round(sum(buy - sell) OVER (PARTITION BY symbol ORDER BY bucket), 4) AS cvd FROM b"""


def _r4(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 4).alias(n) for n in names]


for _market in ("spot", "futures"):

    @query(f"cvd_{_market}", "trades", sql=_cvd_sql(_market))
    def _cvd(trades: DataFrame, market: str = _market) -> DataFrame:
        out = W.cvd(trades.where(F.col("market") == market), ["symbol"], 14400, F.col("price") * F.col("size"))
        return out.select("symbol", "bucket", *_r4("buy", "sell", "cvd"))


@query("cvd_coin_unit", "trades", sql=_cvd_sql("spot", "(price * size) / greatest(price, 1.0)"))
def cvd_coin(trades: DataFrame) -> DataFrame:
    coins = S.to_unit(F.col("price") * F.col("size"), F.col("price"), "coin")
    return W.cvd(trades.where("market = 'spot'"), ["symbol"], 14400, coins).select("symbol", "bucket", *_r4("buy", "sell", "cvd"))


@query("cvd_bucket_delta", "trades", sql=f"WITH c AS ({_cvd_sql('spot')}) SELECT symbol, bucket, round(buy - sell, 3) AS delta FROM c")
def cvd_bucket_delta(trades: DataFrame) -> DataFrame:
    """A bucket's delta read back from the running total by difference."""
    out = W.cvd(trades.where("market = 'spot'"), ["symbol"], 14400, F.col("price") * F.col("size"))
    before = F.coalesce(F.lag("cvd").over(Window.partitionBy("symbol").orderBy("bucket")), F.lit(0.0))
    return out.select("symbol", "bucket", F.round(F.col("cvd") - before, 3).alias("delta"))


@query(
    "venue_rollup",
    "trades",
    sql=f"""WITH {_VENUES}, b AS (SELECT symbol, exchange, es // 14400 * 14400 AS bucket, sum(CASE side WHEN 'BUY' THEN price * size ELSE 0 END) AS buy, sum(CASE side WHEN 'SELL' THEN price * size ELSE 0 END) AS sell FROM {{trades}} GROUP BY ALL)
    SELECT symbol, bucket, round(sum(buy * weight), 4) AS buy, round(sum(sell * weight), 4) AS sell FROM b JOIN v USING (exchange) GROUP BY ALL""",
)
def venue_rollup(trades: DataFrame) -> DataFrame:
    """Venue sums first, weights after: a few rows meet the weights."""
    sums = W.cvd(trades, ["symbol", "exchange"], 14400, F.col("price") * F.col("size"))
    return W.weighted_by_venue(sums, ["symbol", "bucket"], ["buy", "sell"]).select("symbol", "bucket", *_r4("buy", "sell"))


def _foot_sql(market: str) -> str:
    return f"""SELECT symbol, es // 14400 * 14400 AS bucket, floor(price / 5.0) * 5.0 AS price_start, sum(CASE side WHEN 'BUY' THEN size ELSE 0 END)::BIGINT AS buy_base,
        sum(CASE side WHEN 'SELL' THEN size ELSE 0 END)::BIGINT AS sell_base, round(sum(CASE side WHEN 'BUY' THEN price * size ELSE 0 END), 4) AS buy_quote,
        round(sum(CASE side WHEN 'SELL' THEN price * size ELSE 0 END), 4) AS sell_quote, count(*) FILTER (side = 'BUY') AS buy_trades,
        count(*) FILTER (side = 'SELL') AS sell_trades FROM {{trades}} WHERE market = '{market}' GROUP BY ALL"""


for _market in ("spot", "futures"):

    @query(f"footprint_{_market}", "trades", sql=_foot_sql(_market))
    def _footprint(trades: DataFrame, market: str = _market) -> DataFrame:
        """Nested by bucket, as it is stored, and flat again."""
        cells = W.footprint(trades.where(F.col("market") == market), ["symbol"], 14400, 5.0)
        flat = W.nested_levels(cells, ["symbol"]).select("symbol", "bucket", F.inline("levels"))
        return flat.select("symbol", "bucket", "price_start", "buy_base", "sell_base", *_r4("buy_quote", "sell_quote"), "buy_trades", "sell_trades")


@query(
    "footprint_spread",
    "market_state",
    sql="""WITH b AS (SELECT symbol, es // 14400 * 14400 AS bucket, arg_max(btc_price, (ts, seq)) AS p, sum(taker_buy_volume_usd) AS buy, sum(taker_sell_volume_usd) AS sell FROM {market_state} GROUP BY ALL),
    l AS (SELECT *, greatest(1.0, p * 0.00025) AS step, i, (5 - abs(i - 2)) / 19.0 AS w FROM b, range(0, 5) AS r(i)),
    m AS (SELECT *, p + (i - 2) * step AS a FROM l)
    SELECT symbol, bucket, i::INTEGER AS i, round(a, 5) AS price_start, round(buy * w, 4) AS buy_quote, round(sell * w, 4) AS sell_quote,
        round(buy * w / (a + step / 2), 6) AS buy_base, round(sell * w / (a + step / 2), 6) AS sell_base,
        greatest(1, floor(buy * w / (a + step / 2) / 0.03)::BIGINT) AS buy_trades FROM m""",
)
def footprint_spread(state: DataFrame) -> DataFrame:
    """Price ends are rounded half-even to cents by the operator; prices here have three decimals at most."""
    out = W.footprint_spread(state, ["symbol"], 14400)
    step = F.greatest(F.lit(1.0), F.col("p") * 0.00025)
    last = C.bucketed(state, 14400).groupBy("symbol", "bucket").agg(C.last_in("btc_price").alias("p"))
    out = out.join(last, ["symbol", "bucket"]).withColumn("price_start", F.round(F.col("p") + (F.col("i") - 2) * step, 5))
    return out.select("symbol", "bucket", "i", "price_start", *_r4("buy_quote", "sell_quote"), *r6("buy_base", "sell_base"), "buy_trades")


@query(
    "liquidation_history",
    "liquidations",
    sql=f"""WITH {_VENUES}, b AS (SELECT symbol, exchange, es // 14400 * 14400 AS bucket, sum(CASE side WHEN 2 THEN usd_value ELSE 0 END) AS l, sum(CASE side WHEN 1 THEN usd_value ELSE 0 END) AS s FROM {{liquidations}} GROUP BY ALL)
    SELECT symbol, bucket, round(sum(l * weight), 4) AS long_usd, round(sum(s * weight), 4) AS short_usd FROM b JOIN v USING (exchange) GROUP BY ALL""",
)
def liquidation_history(events: DataFrame) -> DataFrame:
    sums = W.liquidation_history(events, ["symbol"], 14400)
    return W.weighted_by_venue(sums, ["symbol", "bucket"], ["long_usd", "short_usd"]).select("symbol", "bucket", *_r4("long_usd", "short_usd"))


@query(
    "liquidation_events",
    "market_state",
    sql="""WITH e AS (SELECT seq, ts, symbol, 2 AS side, btc_price * 0.999 AS price, long_liquidations AS usd_value FROM {market_state} UNION ALL
        SELECT seq, ts, symbol, 1, btc_price * 1.001, short_liquidations FROM {market_state})
    SELECT seq, symbol, side::INTEGER AS side, round(price, 6) AS price, round(usd_value, 4) AS usd_value FROM e WHERE usd_value >= 1000 ORDER BY ts DESC, seq DESC, side DESC LIMIT 500""",
)
def liquidation_events(state: DataFrame) -> DataFrame:
    return W.liquidation_events(state, 1000.0).select("seq", "symbol", "side", *r6("price"), *_r4("usd_value"))


for _kind, _base in W.RATIO_BASES.items():

    @query(
        f"long_short_{_kind}",
        "market_state",
        sql=f"""WITH b AS (SELECT symbol, exchange, es // 14400 * 14400 AS bucket, arg_max(taker_buy_volume_usd, (ts, seq)) AS b, arg_max(taker_sell_volume_usd, (ts, seq)) AS s, arg_max(funding_rate, (ts, seq)) AS f FROM {{market_state}} GROUP BY ALL),
        l AS (SELECT *, greatest(5.0, least(95.0, {_base} + (b - s) / greatest(b + s, 1.0) * 18.0 + f * 6000.0)) AS l FROM b)
        SELECT symbol, exchange, bucket, round_even(l, 4) AS long_percent, round_even(100 - l, 4) AS short_percent, round_even(l / (100 - l), 6) AS long_short_ratio FROM l""",
    )
    def _ratio(state: DataFrame, kind: str = _kind) -> DataFrame:
        return W.long_short_ratio(state, ["symbol", "exchange"], 14400, kind)


@query("tape_bars", "trades", sql="""SELECT symbol, exchange, es // 3600 * 3600 AS bucket, count(*) AS trades, sum(size)::BIGINT AS volume, round(sum(price * size) / sum(size), 6) AS wap,
    round(sum(size) / 3600.0, 9) AS volume_rate, round(count(*) / 3600.0, 9) AS trade_rate FROM {trades} GROUP BY ALL""")
def tape_bars(trades: DataFrame) -> DataFrame:
    out = W.tape_bars(trades, ["symbol", "exchange"], 3600)
    return out.select("symbol", "exchange", "bucket", "trades", "volume", *r6("wap"), *[F.round(c, 9).alias(c) for c in ("volume_rate", "trade_rate")])


_ASOF = "FROM {trades} t ASOF LEFT JOIN (SELECT * FROM {quotes}) q ON t.symbol = q.symbol AND t.exchange = q.exchange AND t.ts >= q.ts"
_CLASS = "CASE WHEN q.bid < q.ask AND t.price >= q.ask THEN 'BUY' WHEN q.bid < q.ask AND t.price <= q.bid THEN 'SELL' ELSE 'UNKNOWN' END"


@query("asof_quotes", "trades", "quotes", sql=f"SELECT t.seq, q.es AS q_es, round(q.bid, 6) AS q_bid, round(q.ask, 6) AS q_ask {_ASOF}")
def asof_quotes(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    return asof(trades, quotes, ["symbol", "exchange"], ["bid", "ask"]).select("seq", "q_es", *r6("q_bid", "q_ask"))


@query(
    "asof_fresh_quotes",
    "trades",
    "quotes",
    sql=f"SELECT t.seq, CASE WHEN t.es - q.es <= 3600 THEN q.es END AS q_es, CASE WHEN t.es - q.es <= 3600 THEN round(q.bid, 6) END AS q_bid {_ASOF}",
)
def asof_fresh(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes older than an hour don't count."""
    return asof(trades, quotes, ["symbol", "exchange"], ["bid", "ask"], most_age=3600).select("seq", "q_es", *r6("q_bid"))


def classified(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    joined = asof(trades, quotes, ["symbol", "exchange"], ["bid", "ask"])
    return joined.withColumn("side", W.aggressor(joined))


@query("eq_c2_estimated_aggressor_volume", "trades", "quotes", sql=f"WITH c AS (SELECT t.*, {_CLASS} AS class {_ASOF}) SELECT symbol, class, sum(size)::BIGINT AS volume, count(*) AS trades FROM c GROUP BY ALL")
def aggressor_volume(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    out = classified(trades, quotes).groupBy("symbol", F.col("side").alias("class"))
    return out.agg(F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"))


@query(
    "eq_c2_estimated_cvd",
    "trades",
    "quotes",
    sql=f"""WITH c AS (SELECT t.symbol, t.es, t.size, {_CLASS} AS class {_ASOF}),
    b AS (SELECT symbol, es // 86400 * 86400 AS session, es // 3600 * 3600 AS bucket, sum(CASE class WHEN 'BUY' THEN size WHEN 'SELL' THEN -size ELSE 0 END)::BIGINT AS net FROM c GROUP BY ALL)
    SELECT symbol, bucket, net, (sum(net) OVER (PARTITION BY symbol, session ORDER BY bucket))::BIGINT AS cvd FROM b""",
)
def estimated_cvd(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Running BUY - SELL of each hour, starting again each day; UNKNOWN volume is in neither side."""
    rows = classified(trades, quotes).withColumn("session", S.bucket(F.col("es"), 86400)).withColumn("net", W.signed())
    sums = C.bucketed(rows, 3600).groupBy("symbol", "session", "bucket").agg(F.sum("net").alias("net"))
    upto = Window.partitionBy("symbol", "session").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("symbol", "bucket", "net", F.sum("net").over(upto).alias("cvd"))


@query(
    "eq_c2_classification_coverage",
    "trades",
    "quotes",
    sql=f"WITH c AS (SELECT t.symbol, t.size, {_CLASS} AS class {_ASOF}) SELECT symbol, round(sum(size) FILTER (class <> 'UNKNOWN') / sum(size), 9) AS coverage FROM c GROUP BY 1",
)
def coverage(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    known = F.sum(F.when(F.col("side") != "UNKNOWN", F.col("size")))
    return classified(trades, quotes).groupBy("symbol").agg(F.round(F.try_divide(known, F.sum("size")), 9).alias("coverage"))


@query(
    "eq_c2_large_trade_activity",
    "trades",
    sql="""WITH p AS (SELECT symbol, quantile_cont(size, 0.95) AS lim FROM {trades} GROUP BY 1)
    SELECT symbol, es // 86400 * 86400 AS bucket, count(*) AS large_trades, round(sum(price * size), 4) AS large_notional FROM {trades} t JOIN p USING (symbol) WHERE size >= lim GROUP BY ALL""",
)
def large_trade_activity(trades: DataFrame) -> DataFrame:
    return W.large_trades(trades, ["symbol"], 86400, percentile=0.95).select("symbol", "bucket", "large_trades", *_r4("large_notional"))


@query(
    "eq_c8_observable_sweep_behavior",
    "trades",
    sql="""WITH t AS (SELECT *, lag(side) OVER w AS ls, lag(price) OVER w AS lp, lag(es) OVER w AS le FROM {trades} WINDOW w AS (PARTITION BY symbol, exchange ORDER BY ts, seq)),
    n AS (SELECT *, CASE WHEN ls = side AND es - le <= 7200 AND (CASE side WHEN 'BUY' THEN price >= lp ELSE price <= lp END) THEN 0 ELSE 1 END AS new FROM t),
    r AS (SELECT *, sum(new) OVER (PARTITION BY symbol, exchange ORDER BY ts, seq) AS run FROM n)
    SELECT symbol, exchange, any_value(side) AS side, min(es) AS start_es, max(es) AS end_es, count(*) AS trades, count(DISTINCT price) AS levels, sum(size)::BIGINT AS volume
    FROM r GROUP BY symbol, exchange, run HAVING count(DISTINCT price) >= 3""",
)
def sweep_behavior(trades: DataFrame) -> DataFrame:
    return W.sweeps(trades, ["symbol", "exchange"], 7200, 3)


for _name, _column in (("eq_c2_trade_count", "trades"), ("eq_c2_volume_rate", "volume_rate"), ("eq_c2_trade_rate", "trade_rate"), ("eq_c1_wap", "wap")):
    _expr = {"trades": "count(*)", "volume_rate": "round(sum(size) / 3600.0, 9)", "trade_rate": "round(count(*) / 3600.0, 9)", "wap": "round(sum(price * size) / sum(size), 9)"}[_column]

    @query(_name, "trades", sql=f"SELECT symbol, es // 3600 * 3600 AS bucket, {_expr} AS value FROM {{trades}} GROUP BY ALL")
    def _bar(trades: DataFrame, column: str = _column) -> DataFrame:
        value = F.col(column) if column == "trades" else F.round(column, 9)
        return W.tape_bars(trades, ["symbol"], 3600).select("symbol", "bucket", value.alias("value"))


@query("eq_c2_trade_size", "trades", sql="SELECT seq, symbol, size AS value, 'units' AS units FROM {trades}")
def trade_size(trades: DataFrame) -> DataFrame:
    return trades.select("seq", "symbol", F.col("size").alias("value"), F.lit("units").alias("units"))


@query("eq_c8_time_sales", "trades", sql="SELECT seq, symbol, exchange, side, ts AS event_ts, es + seq % 3 AS received_es, round(price, 6) AS price, size FROM {trades}")
def time_sales(trades: DataFrame) -> DataFrame:
    """The normalised tape, in order, with event and receipt time."""
    rows = trades.withColumn("received_es", F.col("es") + F.col("seq") % 3).orderBy("ts", "seq")
    return rows.select("seq", "symbol", "exchange", "side", F.col("ts").alias("event_ts"), "received_es", *r6("price"), "size")
