"""Queries over options, volatility, regimes and liquidation risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.operators import candles as C
from tideframe.operators import funds as U
from tideframe.operators import risk as R
from tideframe.operators.quantiles import quantile
from tideframe.operators.spans import most_buckets, with_previous
from tideframe.plans.registry import query, r6
from tideframe.sources import dims


_GREEKS = """WITH RECURSIVE o AS (SELECT *, (ln(spot / strike) + (rate + vol * vol / 2) * tenor) / (vol * sqrt(tenor)) AS d1, vol * sqrt(tenor) AS w FROM {option_chain}),
    x AS (SELECT id, 1 AS which, d1 AS d FROM o UNION ALL SELECT id, 2, d1 - w FROM o),
    t AS (SELECT id, which, d, 0 AS k, d AS term, d AS total FROM x
        UNION ALL SELECT id, which, d, k + 1, term * d * d / (2 * k + 3), total + term * d * d / (2 * k + 3) FROM t WHERE k < 400),
    n AS (SELECT id, which, 0.5 + exp(-d * d / 2) / sqrt(2 * pi()) * total AS cdf FROM t WHERE k = 400),
    p AS (SELECT o.*, a.cdf AS n1, b.cdf AS n2, strike * exp(-rate * tenor) AS present, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS density FROM o JOIN n a ON a.id = o.id AND a.which = 1 JOIN n b ON b.id = o.id AND b.which = 2)
    SELECT id, round(spot, 6) AS spot, round(strike, 6) AS strike, round(tenor, 6) AS tenor, round(vol, 6) AS vol, round(greatest(0.0, spot * n1 - present * n2), 4) AS call_price,
        round(greatest(0.0, present * (1 - n2) - spot * (1 - n1)), 4) AS put_price, round(n1, 6) AS call_delta, round(n1 - 1, 6) AS put_delta, round(density / (spot * w), 6) AS gamma, round(spot * density * sqrt(tenor), 4) AS vega FROM p"""


@query("option_greeks", "option_chain", sql=_GREEKS)
def option_greeks(chain: DataFrame) -> DataFrame:
    """The SQL sums the distribution function's power series instead."""
    out = R.option_greeks(chain)
    return out.select("id", *r6("spot", "strike", "tenor", "vol"), *[F.round(c, 4).alias(c) for c in ("call_price", "put_price", "vega")], *r6("call_delta", "put_delta", "gamma"))


@query("parity_audit", "option_chain", sql="SELECT count(*) AS options, true AS within FROM {option_chain}")
def parity_audit(chain: DataFrame) -> DataFrame:
    """Put-call parity holds for every row to 1e-6."""
    priced = R.option_greeks(chain)
    return priced.agg(F.count(F.lit(1)).alias("options"), (F.max(F.abs(R.parity_residual(priced))) < 1e-6).alias("within"))


@query("parity_residual", "option_chain", sql=_GREEKS[: _GREEKS.rindex("SELECT id")] + "SELECT count(*) AS options, round(max(abs((spot * n1 - present * n2) - (present * (1 - n2) - spot * (1 - n1)) - (spot - present))), 6) AS largest, round(sum(spot * n1 - present * n2 - (present * (1 - n2) - spot * (1 - n1))), 3) AS spread FROM p")
def parity_residual(chain: DataFrame) -> DataFrame:
    """The largest departure from put-call parity, and the summed difference of calls and puts, which SQL's own prices must meet."""
    priced = R.option_greeks(chain)
    spread = F.sum(F.col("call_price") - F.col("put_price"))
    return priced.agg(F.count(F.lit(1)).alias("options"), F.round(F.max(F.abs(R.parity_residual(priced))), 6).alias("largest"), F.round(spread, 3).alias("spread"))


@query("atm_strike", "market_state", sql="SELECT seq, greatest(1000.0, round_even(btc_price * 100 / 1000.0, 0) * 1000.0) AS strike FROM {market_state}")
def atm_strike(state: DataFrame) -> DataFrame:
    return state.select("seq", R.atm_strike(F.col("btc_price") * 100).alias("strike"))


_REG = dims.values_sql([(r, v[0]) for r, v in dims.REGIMES.items()])


@query(
    "iv_index",
    "market_state",
    sql=f"""WITH r(regime, rv) AS (VALUES {_REG}) SELECT seq, round(greatest(0.2, least(1.8, (0.72 * dvol / 100 + 0.2 * rv + 0.08 * abs(sopr - 1)) * (1 + 0.28 * abs(order_flow_imbalance)))) * 100, 6) AS iv_index FROM {{market_state}} JOIN r USING (regime)""",
)
def iv_index(state: DataFrame) -> DataFrame:
    joined = state.join(F.broadcast(dims.regimes(state.sparkSession)), "regime")  # six rows
    iv = R.implied_vol(F.col("dvol") / 100, F.col("regime_vol"), F.abs(F.col("sopr") - 1), F.abs("order_flow_imbalance"))
    return joined.select("seq", F.round(iv * 100, 6).alias("iv_index"))


@query(
    "gamma_pressure",
    "market_state",
    sql="""SELECT seq, round(greatest(-1.0, least(1.0, -tanh(1.8 * futures_order_flow_imbalance + 4200 * funding_rate + 65 * (sopr - 1) / 100) * greatest(0.0, least(1.0, 65 * 0.0001 * btc_price)))), 6) AS value FROM {market_state}""",
)
def gamma_pressure(state: DataFrame) -> DataFrame:
    v = R.gamma_pressure(F.col("futures_order_flow_imbalance"), F.col("funding_rate"), (F.col("sopr") - 1) / 100, F.lit(0.0001), F.col("btc_price"))
    return state.select("seq", F.round(v, 6).alias("value"))


_VAR = f"""WITH r(regime, rv) AS (VALUES {_REG}),
    d AS (SELECT symbol, es // 86400 * 86400 AS bucket, arg_max(btc_price, (ts, seq)) AS c, arg_max(regime, (ts, seq)) AS regime FROM {{market_state}} GROUP BY ALL),
    x AS (SELECT symbol, bucket, least(3.24, coalesce(power(ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY bucket)), 2) * 365.0, 0.0)) AS v, rv FROM d JOIN r USING (regime)),"""


def daily_variance(state: DataFrame) -> DataFrame:
    """Per day: the annualised squared return, capped, and the volatility of the day's last regime."""
    days = C.candles(state, ["symbol"], "btc_price", 86400).join(U.metric(state, ["symbol"], "regime", 86400).withColumnRenamed("value", "regime"), ["symbol", "bucket"])
    r = U.log_returns(days, ["symbol"]).withColumn("var", F.least(F.lit(3.24), F.coalesce(F.col("log_return") * F.col("log_return") * 365.0, F.lit(0.0))))
    return r.join(F.broadcast(dims.regimes(state.sparkSession)), "regime").select("symbol", "bucket", "log_return", "var", "regime_vol")  # six rows


_FOLD = _VAR + """
    n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS i FROM x)"""
_EWMA = _FOLD.replace("WITH r(", "WITH RECURSIVE r(") + """,
    w AS (SELECT symbol, bucket, i, greatest(0.15, least(1.8, sqrt(0.92 * 0.25 + 0.055 * rv * rv + 0.025 * v))) AS s FROM n WHERE i = 1
        UNION ALL SELECT n.symbol, n.bucket, n.i, greatest(0.15, least(1.8, sqrt(0.92 * w.s * w.s + 0.055 * n.rv * n.rv + 0.025 * n.v))) FROM w JOIN n ON n.symbol = w.symbol AND n.i = w.i + 1)
    SELECT symbol, bucket, round(s, 9) AS volatility FROM w"""


@query("ewma_variance", "market_state", sql=_EWMA)
def ewma_variance(state: DataFrame) -> DataFrame:
    return R.ewma_variance(daily_variance(state), ["symbol"], known=most_buckets(86400)).select("symbol", "bucket", F.round("volatility", 9).alias("volatility"))


@query("ewma_variance_blocks", "market_state", sql=_EWMA)
def ewma_blocks(state: DataFrame) -> DataFrame:
    """The same with every key cut into spans of about four bars."""
    return R.ewma_variance(daily_variance(state), ["symbol"], most=4).select("symbol", "bucket", F.round("volatility", 9).alias("volatility"))


@query(
    "stress",
    "market_state",
    sql=f"""WITH RECURSIVE r(regime, rv) AS (VALUES {_REG}),
    d AS (SELECT symbol, es // 86400 * 86400 AS bucket, arg_max(btc_price, (ts, seq)) AS c, arg_max(regime, (ts, seq)) AS regime, arg_max(order_flow_imbalance, (ts, seq)) AS a, arg_max(futures_order_flow_imbalance, (ts, seq)) AS b FROM {{market_state}} GROUP BY ALL),
    x AS (SELECT symbol, a, b, rv, bucket, coalesce(ln(c / lag(c) OVER w), 0.0) AS lr, row_number() OVER w AS i FROM d JOIN r USING (regime) WINDOW w AS (PARTITION BY symbol ORDER BY bucket)),
    w AS (SELECT symbol, 0::BIGINT AS bucket, 0::BIGINT AS i, 0.5::DOUBLE AS v, 0.1::DOUBLE AS s FROM x WHERE i = 1
        UNION ALL SELECT x.symbol, x.bucket, x.i, greatest(0.15, least(1.8, sqrt(0.92 * w.v * w.v + 0.055 * rv * rv + 0.025 * least(3.24, lr * lr * 365.0)))),
            greatest(0.02, least(1.0, 0.82 * w.s + 0.18 * greatest(0.02, least(1.0, 0.1 + 0.16 * abs(a) + 0.12 * abs(b) + 0.1 * least(abs(lr) / (w.v * sqrt(1.0 / 365.0)), 5.0)))))
        FROM w JOIN x ON x.symbol = w.symbol AND x.i = w.i + 1)
    SELECT symbol, bucket, round(s, 9) AS stress FROM w WHERE i > 0""",
)
def stress(state: DataFrame) -> DataFrame:
    """Daily; the shock is the day's move in deviations of the volatility up to the day before."""
    days = daily_variance(state)
    before = F.lag("volatility", 1, 0.5).over(Window.partitionBy("symbol").orderBy("bucket"))
    known = R.ewma_variance(days, ["symbol"], known=most_buckets(86400)).select("symbol", "bucket", before.alias("known"))
    last = U.metric(state, ["symbol"], F.struct("order_flow_imbalance", "futures_order_flow_imbalance"), 86400)
    joined = days.join(known, ["symbol", "bucket"]).join(last.select("symbol", "bucket", "value"), ["symbol", "bucket"])
    shock = R.standardised_move(F.coalesce("log_return", F.lit(0.0)), F.col("known"), 1 / 365)
    target = R.stress_target(F.col("value.order_flow_imbalance"), F.col("value.futures_order_flow_imbalance"), shock)
    return R.stress(joined.select("symbol", "bucket", target.alias("target")), ["symbol"], known=most_buckets(86400)).select("symbol", "bucket", F.round("stress", 9).alias("stress"))


_BAR = "b AS (SELECT symbol, es // 3600 * 3600 AS bucket, arg_min(price, (ts, seq)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts, seq)) AS c, sum(size) AS v FROM {ticks} GROUP BY ALL)"


@query(
    "series_profile",
    "ticks",
    sql=f"""WITH {_BAR}, r AS (SELECT *, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY bucket)) AS r FROM b)
    SELECT symbol, round(stddev_pop(r), 9) AS deviation, round(corr(r, v), 9) AS volume_correlation, count(*) FILTER (r = 0) AS flat, count(*) FILTER (r > 0) AS up, count(*) FILTER (r < 0) AS down,
        count(*) FILTER (h > l AND h > greatest(o, c) AND l < least(o, c)) AS wick_bars, round(quantile_cont(CASE WHEN h > l THEN abs(c - o) / (h - l) END, 0.5), 9) AS median_body FROM r GROUP BY 1""",
)
def series_profile(ticks: DataFrame) -> DataFrame:
    bars = C.candles(ticks, ["symbol"], "price", 3600, volume="size")
    r = U.log_returns(bars, ["symbol"])
    x, span = F.col("log_return"), F.col("high") - F.col("low")
    wick = (span > 0) & (F.col("high") > F.greatest("open", "close")) & (F.col("low") < F.least("open", "close"))
    body = F.when(span > 0, F.abs(F.col("close") - F.col("open")) / span)
    profile = r.groupBy("symbol").agg(
        F.round(F.stddev_pop(x), 9).alias("deviation"),
        F.round(F.corr(x, F.when(x.isNotNull(), F.col("volume"))), 9).alias("volume_correlation"),
        F.count(F.when(x == 0, 1)).alias("flat"),
        F.count(F.when(x > 0, 1)).alias("up"),
        F.count(F.when(x < 0, 1)).alias("down"),
        F.count(F.when(wick, 1)).alias("wick_bars"),
    )
    median = quantile(r, ["symbol"], body, 0.5, "median_body")
    return profile.join(median, "symbol", "left").withColumn("median_body", F.round("median_body", 9))


@query(
    "autocorrelation",
    "ticks",
    sql=f"""WITH {_BAR}, r AS (SELECT symbol, bucket, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY bucket)) AS r FROM b),
    n AS (SELECT symbol, r - avg(r) OVER (PARTITION BY symbol) AS d, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE r IS NOT NULL),
    t AS (SELECT symbol, sum(d * d) AS t FROM n GROUP BY 1)
    SELECT a.symbol, (b.i - a.i)::INTEGER AS lag, round(sum(a.d * b.d) / any_value(t), 6) AS autocorrelation FROM n a JOIN n b ON a.symbol = b.symbol AND b.i - a.i BETWEEN 8 AND least(80, a.n // 3) JOIN t ON t.symbol = a.symbol GROUP BY ALL""",
)
def autocorrelation(ticks: DataFrame) -> DataFrame:
    r = U.log_returns(C.candles(ticks, ["symbol"], "price", 3600), ["symbol"])
    return R.autocorrelation(r, ["symbol"], "log_return", known=most_buckets(3600)).select("symbol", "lag", *r6("autocorrelation"))


_RUNS = """n AS (SELECT *, CASE WHEN lag(regime) OVER w = regime THEN 0 ELSE 1 END AS new FROM {market_state} WINDOW w AS (PARTITION BY symbol, exchange ORDER BY ts, seq)),
    k AS (SELECT *, sum(new) OVER (PARTITION BY symbol, exchange ORDER BY ts, seq) AS run FROM n),
    g AS (SELECT symbol, exchange, run, any_value(regime) AS regime, min(es) AS a, max(es) AS b, count(*) AS n FROM k GROUP BY symbol, exchange, run)"""


@query("regime_runs", "market_state", sql=f"WITH {_RUNS} SELECT regime, count(*) AS runs, sum(n)::BIGINT AS rows, round(avg(b - a), 6) AS mean_dwell FROM g GROUP BY 1")
def regime_runs(state: DataFrame) -> DataFrame:
    found = R.runs(state, ["symbol", "exchange"])
    dwell = F.avg(F.col("end_es") - F.col("start_es"))
    return found.groupBy("regime").agg(F.count(F.lit(1)).alias("runs"), F.sum("rows").alias("rows"), F.round(dwell, 6).alias("mean_dwell"))


_W = dims.values_sql([(a, b, w) for a, of in dims.TRANSITIONS.items() for b, w in of.items()])


@query(
    "regime_transitions",
    "market_state",
    sql=f"""WITH {_RUNS}, d(regime, next, weight) AS (VALUES {_W}), t AS (SELECT regime, lead(regime) OVER (PARTITION BY symbol, exchange ORDER BY run) AS next FROM g),
    c AS (SELECT regime, next, count(*) AS n FROM t WHERE next IS NOT NULL GROUP BY ALL)
    SELECT c.regime, c.next, n, round(n / sum(n) OVER (PARTITION BY c.regime), 9) AS share, weight FROM c LEFT JOIN d ON c.regime = d.regime AND c.next = d.next""",
)
def regime_transitions(state: DataFrame) -> DataFrame:
    """Observed shares of the next regime beside the declared weights."""
    seen = R.transitions(R.runs(state, ["symbol", "exchange"]), ["symbol", "exchange"])
    declared = dims.regime_weights(state.sparkSession)
    return seen.join(F.broadcast(declared), ["regime", "next"], "left").select("regime", "next", "n", F.round("share", 9).alias("share"), "weight")  # 24 rows


_LIQ = """SELECT floor((entry * (1 + (CASE side WHEN 'LONG' THEN -1.0 ELSE 1.0 END) / leverage)) / 5.0) * 5.0 AS price_bin, {lev}round(sum(notional), 4) AS notional
    FROM {{positions}} WHERE es <= 1706659200 AND es > 1706659200 - 30 * 86400 GROUP BY ALL"""


@query("liquidation_map_pair", "positions", sql=_LIQ.format(lev="leverage, ").replace("{{", "{").replace("}}", "}"))
def liquidation_map_pair(positions: DataFrame) -> DataFrame:
    out = R.liquidation_map(positions, 1706659200, "30d", 5.0)
    return out.select("price_bin", "leverage", F.round("notional", 4).alias("notional"))


@query("liquidation_map_aggregate", "positions", sql=_LIQ.format(lev="").replace("{{", "{").replace("}}", "}"))
def liquidation_map_aggregate(positions: DataFrame) -> DataFrame:
    out = R.liquidation_map(positions, 1706659200, "30d", 5.0, by_leverage=False)
    return out.select("price_bin", F.round("notional", 4).alias("notional"))


@query(
    "severe_tail",
    "market_state",
    sql="""WITH d AS (SELECT CAST(long_liquidations + short_liquidations AS DECIMAL(18,2)) AS z, ln(open_interest / lag(open_interest) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS r FROM {market_state} QUALIFY r IS NOT NULL),
    g AS (SELECT z, count(*)::DOUBLE AS n, sum(r) AS s FROM d GROUP BY 1),
    c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM g),
    p AS (SELECT *, greatest(0.0, least(1.0, (t - floor(t * 0.95) - b) / n)) AS w FROM c)
    SELECT round(sum(s * w) / sum(n * w), 9) AS severe_mean, round(sum(s * (1 - w)) / sum(n * (1 - w)), 9) AS normal_mean, sum(n * w)::BIGINT AS severe_rows FROM p""",
)
def severe_tail(state: DataFrame) -> DataFrame:
    size = (F.col("long_liquidations") + F.col("short_liquidations")).cast("decimal(18,2)")
    seen = with_previous(state, ["symbol"], ["open_interest"]).where("prev_open_interest is not null")
    rows = seen.select(size.alias("size"), F.ln(F.col("open_interest") / F.col("prev_open_interest")).alias("value"))
    return R.severe_tail(rows, "size", "value").select(*[F.round(c, 9).alias(c) for c in ("severe_mean", "normal_mean")], "severe_rows")
