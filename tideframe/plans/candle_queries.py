"""Queries over candles, scans and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions import scalars as S
from tideframe.operators import candles as C
from tideframe.operators.spans import with_running
from tideframe.plans.registry import query, r6

KEYS = ["symbol", "exchange"]
OHLC = ("open", "high", "low", "close")


def _ohlc_sql(view: str, value: str, seconds: int, keys: str = "symbol, exchange", volume: str = "0.0", digits: int = 6) -> str:
    return f"""SELECT {keys}, es // {seconds} * {seconds} AS bucket, round(arg_min({value}, (ts, seq)), {digits}) AS open, round(max({value}), {digits}) AS high,
        round(min({value}), {digits}) AS low, round(arg_max({value}, (ts, seq)), {digits}) AS close, round({volume}, {digits}) AS volume FROM {{{view}}} GROUP BY ALL"""


for _name, _seconds in (("1m", "1m"), ("1h", "1h"), ("1w", "1w"), ("30d", "1month")):
    _s = S.interval_seconds(_seconds)

    @query(f"ohlcv_{_name}", "ticks", sql=_ohlc_sql("ticks", "price", _s, volume="sum(price * size)"))
    def _ohlcv(ticks: DataFrame, seconds: int = _s) -> DataFrame:
        bars = C.candles(ticks, KEYS, "price", seconds, volume=F.col("price") * F.col("size"))
        return bars.select(*KEYS, "bucket", *r6(*OHLC, "volume"))


for _name, _column in (("oi_ohlc", "open_interest"), ("funding_ohlc", "funding_rate")):

    @query(_name, "market_state", sql=_ohlc_sql("market_state", _column, 14400, digits=9))
    def _metric(state: DataFrame, column: str = _column) -> DataFrame:
        return C.candles(state, KEYS, column, 14400).select(*KEYS, "bucket", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in (*OHLC, "volume")])


@query("dvol_ohlc", "market_state", sql=_ohlc_sql("market_state", "dvol", 3600, "symbol"))
def dvol(state: DataFrame) -> DataFrame:
    """Candles of the volatility index as one struct for each bucket, and flat again."""
    nested = C.candles(state, ["symbol"], "dvol", 3600).select("symbol", "bucket", F.struct(*OHLC, "volume").alias("o"))
    return nested.select("symbol", "bucket", "o.*").select("symbol", "bucket", *r6(*OHLC, "volume"))


SUPPLY = 19_800_000


@query("marketcap", "market_state", sql=f"SELECT symbol, es // 86400 * 86400 AS bucket, round(arg_max(btc_price, (ts, seq)) * {SUPPLY}, 2) AS value FROM {{market_state}} GROUP BY ALL")
def marketcap(state: DataFrame) -> DataFrame:
    return C.candles(state, ["symbol"], "btc_price", 86400).select("symbol", "bucket", F.round(F.col("close") * SUPPLY, 2).alias("value"))


@query(
    "funding_ohlc_weighted",
    "market_state",
    sql="""WITH w AS (SELECT symbol, es // 60 * 60 AS es, min(ts) AS ts, min(seq) AS seq, sum(funding_rate * open_interest) / sum(open_interest) AS f FROM {market_state} GROUP BY ALL)
    SELECT symbol, es // 14400 * 14400 AS bucket, round(arg_min(f, es), 9) AS open, round(max(f), 9) AS high, round(min(f), 9) AS low, round(arg_max(f, es), 9) AS close FROM w GROUP BY 1, es // 14400""",
)
def funding_weighted(state: DataFrame) -> DataFrame:
    """Funding weighted by open interest over the venues of a minute, then candles."""
    minute = state.withColumn("es", S.bucket(F.col("es"), 60)).groupBy("symbol", "es")
    weighted = minute.agg(F.try_divide(F.sum(F.col("funding_rate") * F.col("open_interest")), F.sum("open_interest")).alias("f"))
    bars = C.candles(weighted, ["symbol"], "f", 14400, order=("es",))
    return bars.select("symbol", "bucket", *[F.round(c, 9).alias(c) for c in OHLC])


@query("candle_rollup", "ticks", sql=_ohlc_sql("ticks", "price", 14400, volume="sum(price * size)"))
def candle_rollup(ticks: DataFrame) -> DataFrame:
    """Four-hour candles from one-minute candles: one scan of the ticks serves all intervals."""
    fine = C.candles(ticks, KEYS, "price", 60, volume=F.col("price") * F.col("size"))
    return C.rollup(fine, KEYS, 14400).select(*KEYS, "bucket", *r6(*OHLC, "volume"))


_BARS = "b AS (SELECT symbol, es // 3600 * 3600 AS bucket, arg_min(price, (ts, seq)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts, seq)) AS c FROM {ticks} GROUP BY ALL)"


@query(
    "candle_chain",
    "ticks",
    sql=f"""WITH {_BARS}, p AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY symbol ORDER BY bucket), o) AS q FROM b)
    SELECT symbol, bucket, round(q, 6) AS open, round(greatest(h, c, q), 6) AS high, round(least(l, c, q), 6) AS low, round(c, 6) AS close FROM p""",
)
def candle_chain(ticks: DataFrame) -> DataFrame:
    return C.chained(C.candles(ticks, ["symbol"], "price", 3600), ["symbol"]).select("symbol", "bucket", *r6(*OHLC))


@query(
    "candle_delta_chain",
    "ticks",
    sql=f"""WITH {_BARS}, p AS (SELECT *, first_value(o) OVER w + sum(c - o) OVER w AS nc FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS UNBOUNDED PRECEDING))
    SELECT symbol, bucket, round(nc - (c - o), 6) AS open, round(nc - (c - o) + greatest(h - o, c - o, 0), 6) AS high,
           round(nc - (c - o) + least(l - o, c - o, 0), 6) AS low, round(nc, 6) AS close FROM p""",
)
def candle_delta_chain(ticks: DataFrame) -> DataFrame:
    return C.delta_chained(C.candles(ticks, ["symbol"], "price", 3600), ["symbol"]).select("symbol", "bucket", *r6(*OHLC))


@query(
    "last_500",
    "ticks",
    sql=f"""WITH {_BARS.replace("3600", "60")} SELECT symbol, bucket, round(c, 6) AS close FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) <= 500""",
)
def last_500(ticks: DataFrame) -> DataFrame:
    bars = C.candles(ticks, ["symbol"], "price", 60)
    return C.last_n(bars, ["symbol"], 500, ["bucket"]).select("symbol", "bucket", *r6("close"))


@query(
    "record_count",
    "ticks",
    sql=f"""WITH {_BARS.replace("3600", "60")}, k AS (SELECT symbol, count(*) AS buckets FROM b GROUP BY 1) SELECT symbol, buckets, least(buckets, 500) AS records, least(buckets, 500) = 500 AS full_window FROM k""",
)
def record_count(ticks: DataFrame) -> DataFrame:
    """How many records the 500-bucket window of each key holds, and whether it is full."""
    bars = C.candles(ticks, ["symbol"], "price", 60)
    kept = C.last_n(bars, ["symbol"], 500, ["bucket"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("records"))
    sizes = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("buckets"))
    return sizes.join(kept, "symbol").select("symbol", "buckets", "records", (F.col("records") == 500).alias("full_window"))


@query("time_range", "ticks", sql="SELECT seq, symbol, round(price, 6) AS price FROM {ticks} WHERE es BETWEEN 1704500000 AND 1704900000")
def time_range(ticks: DataFrame) -> DataFrame:
    return C.between(ticks, 1704500000, 1704900000).select("seq", "symbol", *r6("price"))


@query("history_scan", "ticks", sql="SELECT symbol, count(*) AS n, min(es) AS first_es, max(es) AS last_es FROM {ticks} WHERE es >= 1705000000 // 3600 * 3600 - 99 * 3600 AND es <= 1705000000 GROUP BY 1")
def history_scan(ticks: DataFrame) -> DataFrame:
    rows = C.history(ticks, 1705000000, 3600, 100).groupBy("symbol")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("es").alias("first_es"), F.max("es").alias("last_es"))


@query("look_back", "ticks", sql="SELECT seq, es FROM {ticks} WHERE es BETWEEN 1705000000 - 86400 AND 1705000000")
def look_back(ticks: DataFrame) -> DataFrame:
    return C.look_back(ticks, now=1705000000).select("seq", "es")


@query("bounded_tail", "ticks", sql="SELECT seq, es, round(price, 6) AS price FROM {ticks} ORDER BY ts DESC, seq DESC LIMIT 500")
def bounded_tail(ticks: DataFrame) -> DataFrame:
    return C.tail(ticks, 500, ["ts", "seq"]).select("seq", "es", *r6("price"))


@query("newest_first", "ticks", sql="SELECT seq, ts, symbol FROM {ticks} ORDER BY ts DESC, seq DESC LIMIT 500")
def newest_first(ticks: DataFrame) -> DataFrame:
    return ticks.orderBy(F.desc("ts"), F.desc("seq")).limit(500).select("seq", "ts", "symbol")


@query("timeline", "ticks", sql="SELECT seq, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS place FROM {ticks} ORDER BY ts, seq")
def timeline(ticks: DataFrame) -> DataFrame:
    """Events in order of time and id, numbered inside their symbol."""
    placed = with_running(ticks.select("seq", "ts", "es", "symbol"), ["symbol"], F.lit(1), "place")
    return placed.select("seq", "ts", F.col("place").cast("long").alias("place")).orderBy("ts", "seq")


@query(
    "candle_invariants",
    "ticks",
    sql=f"""WITH {_BARS} SELECT symbol, count(*) AS bars, count(*) FILTER (NOT (l <= least(o, c) AND greatest(o, c) <= h)) AS broken, count(*) FILTER (h = l) AS flat FROM b GROUP BY 1""",
)
def candle_invariants(ticks: DataFrame) -> DataFrame:
    bars = C.candles(ticks, ["symbol"], "price", 3600)
    flat = F.count(F.when(F.col("high") == F.col("low"), 1))
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count(F.when(C.violations(bars), 1)).alias("broken"), flat.alias("flat"))


@query(
    "scenario_spine",
    "ticks",
    sql="""WITH k AS (SELECT symbol, min(es) // 3600 * 3600 AS a, max(es) // 3600 * 3600 AS b FROM {ticks} GROUP BY 1)
    SELECT symbol, unnest(range(a, b + 1, 3600)) AS bucket FROM k""",
)
def scenario_spine(ticks: DataFrame) -> DataFrame:
    """The hourly grid of each symbol from its first to its last hour."""
    ends = ticks.groupBy("symbol").agg(S.bucket(F.min("es"), 3600).alias("a"), S.bucket(F.max("es"), 3600).alias("b"))
    return ends.select("symbol", F.explode(F.sequence("a", "b", F.lit(3600).cast("long"))).alias("bucket"))


@query(
    "spine_gaps",
    "ticks",
    sql="""WITH k AS (SELECT symbol, exchange, min(es) // 3600 * 3600 AS a, max(es) // 3600 * 3600 AS b FROM {ticks} GROUP BY ALL),
    g AS (SELECT symbol, exchange, unnest(range(a, b + 1, 3600)) AS bucket FROM k),
    o AS (SELECT symbol, exchange, es // 3600 * 3600 AS bucket, count(*) AS n FROM {ticks} GROUP BY ALL)
    SELECT symbol, exchange, count(*) AS expected, count(n) AS observed, count(*) - count(n) AS gaps FROM g LEFT JOIN o USING (symbol, exchange, bucket) GROUP BY ALL""",
)
def spine_gaps(ticks: DataFrame) -> DataFrame:
    """Expected, observed and missing hours of each key."""
    ends = ticks.groupBy(*KEYS).agg(S.bucket(F.min("es"), 3600).alias("a"), S.bucket(F.max("es"), 3600).alias("b"))
    grid = ends.select(*KEYS, F.explode(F.sequence("a", "b", F.lit(3600).cast("long"))).alias("bucket"))
    seen = C.bucketed(ticks, 3600).groupBy(*KEYS, "bucket").agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(seen, [*KEYS, "bucket"], "left").groupBy(*KEYS)
    out = out.agg(F.count(F.lit(1)).alias("expected"), F.count("n").alias("observed"))
    return out.withColumn("gaps", F.col("expected") - F.col("observed"))


@query(
    "normalised_units",
    "market_state",
    sql="""SELECT seq, CASE WHEN seq % 2 = 0 THEN es * 1000 ELSE es END AS raw, es AS seconds, greatest(-0.3, least(0.3, order_flow_imbalance)) AS clamped,
        round(taker_buy_volume_usd / greatest(btc_price, 1.0), 6) AS coin, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d') AS day,
        replace(symbol, 'USDT', '') AS base, symbol AS pair FROM {market_state}""",
)
def normalised_units(state: DataFrame) -> DataFrame:
    """Milliseconds to seconds, clamps, coin units, ISO times and symbols of every row."""
    raw = F.when(F.col("seq") % 2 == 0, F.col("es") * 1000).otherwise(F.col("es"))
    return state.withColumn("raw", raw).select(
        "seq",
        "raw",
        S.seconds_from_any(F.col("raw")).alias("seconds"),
        S.clamp(F.col("order_flow_imbalance"), -0.3, 0.3).alias("clamped"),
        F.round(S.to_unit(F.col("taker_buy_volume_usd"), F.col("btc_price"), "coin"), 6).alias("coin"),
        S.iso(F.col("es")).alias("iso"),
        S.window_stamp(F.col("es"), "day").alias("day"),
        S.base_asset(F.col("symbol")).alias("base"),
        S.pair_symbol(S.base_asset(F.col("symbol"))).alias("pair"),
    )


@query(
    "parsed_times",
    "ticks",
    sql="""SELECT seq, es // 86400 * 86400 AS compact_day, es AS compact_second, es AS iso_zone, NULL::BIGINT AS unreadable FROM {ticks}""",
)
def parsed_times(ticks: DataFrame) -> DataFrame:
    """Epoch seconds read back from three spellings of every row's time, and from one that is none."""
    ts = F.timestamp_seconds("es")
    return ticks.select(
        "seq",
        S.parse_time(F.date_format(ts, "yyyyMMdd")).alias("compact_day"),
        S.parse_time(F.date_format(ts, "yyyyMMdd'T'HHmmss")).alias("compact_second"),
        S.parse_time(S.iso(F.col("es"))).alias("iso_zone"),
        S.parse_time(F.concat(F.lit("on "), F.col("symbol"))).alias("unreadable"),
    )


@query(
    "allowed_split",
    "ticks",
    sql="""SELECT exchange, count(*) FILTER (exchange IN ('Binance', 'OKX')) AS valid, count(*) FILTER (exchange NOT IN ('Binance', 'OKX')) AS quarantined FROM {ticks} GROUP BY 1""",
)
def allowed_split(ticks: DataFrame) -> DataFrame:
    """Rows with an allowed exchange and rows set aside; the allowed list is a parsed text column."""
    listed = ticks.withColumn("allowed", S.parsed_list(F.lit(" Binance ,OKX,, ")))
    ok = F.array_contains("allowed", F.col("exchange"))
    return listed.groupBy("exchange").agg(F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~ok, 1)).alias("quarantined"))


@query(
    "interval_lookup",
    "ticks",
    sql="""WITH i(k, interval_name, seconds) AS (VALUES (0, '1m', 60), (1, '15m', 900), (2, '1h', 3600), (3, '1w', 604800))
    SELECT interval_name, es // seconds * seconds AS bucket, count(*) AS n FROM {ticks} JOIN i ON seq % 4 = k GROUP BY ALL""",
)
def interval_lookup(ticks: DataFrame) -> DataFrame:
    """Buckets of an interval that is a column: its spelling meets the table of spellings in a join."""
    spark = ticks.sparkSession
    dim = spark.createDataFrame(list(S.INTERVAL_SECONDS.items()), "interval_name string, seconds long")
    named = ticks.withColumn("interval_name", F.element_at(F.array(*map(F.lit, ("1m", "15m", "1h", "1w"))), (F.col("seq") % 4 + 1).cast("int")))
    found = named.join(F.broadcast(dim), "interval_name")  # 19 rows
    return found.groupBy("interval_name", (F.col("es") - F.pmod("es", "seconds")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
