"""Queries over quotes, depth, resting orders and the catalogued equities observables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.operators import book as B
from tideframe.operators import candles as C
from tideframe.operators import flow as W
from tideframe.operators import funds as U
from tideframe.operators.asof import asof
from tideframe.plans.registry import query, r6

_VALID = "bid <= ask"


@query("eq_c1_trade_price", "trades", sql="SELECT symbol, exchange, arg_max(seq, (ts, seq)) AS seq, round(arg_max(price, (ts, seq)), 6) AS value FROM {trades} GROUP BY ALL")
def trade_price(trades: DataFrame) -> DataFrame:
    return B.latest(trades, ["symbol", "exchange"], ["seq", "price"]).select("symbol", "exchange", "seq", F.round("price", 6).alias("value"))


@query(
    "eq_c1_best_quote",
    "quotes",
    sql="""SELECT symbol, exchange, round(arg_max(bid, (ts, seq)), 6) AS bid, round(arg_max(ask, (ts, seq)), 6) AS ask, arg_max(bid_size, (ts, seq)) AS bid_size, arg_max(ask_size, (ts, seq)) AS ask_size,
    arg_max(CASE WHEN bid > ask THEN 'crossed' WHEN bid = ask THEN 'locked' ELSE 'normal' END, (ts, seq)) AS state FROM {quotes} GROUP BY ALL""",
)
def best_quote(quotes: DataFrame) -> DataFrame:
    last = B.latest(quotes, ["symbol", "exchange"], ["bid", "ask", "bid_size", "ask_size"])
    return last.withColumn("state", B.quote_state()).select("symbol", "exchange", *r6("bid", "ask"), "bid_size", "ask_size", "state")


@query("quote_states", "quotes", sql="SELECT symbol, CASE WHEN bid > ask THEN 'crossed' WHEN bid = ask THEN 'locked' ELSE 'normal' END AS state, count(*) AS n FROM {quotes} GROUP BY ALL")
def quote_states(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("symbol", B.quote_state().alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "eq_c1_ohlcv_bar",
    "trades",
    sql="""SELECT symbol, es // 3600 * 3600 AS bucket, round(arg_min(price, (ts, seq)), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, (ts, seq)), 6) AS close, sum(size)::BIGINT AS volume FROM {trades} GROUP BY ALL""",
)
def ohlcv_bar(trades: DataFrame) -> DataFrame:
    return C.candles(trades, ["symbol"], "price", 3600, volume="size").select("symbol", "bucket", *r6("open", "high", "low", "close"), "volume")


_DAY = "b AS (SELECT symbol, es // 86400 * 86400 AS bucket, arg_min(price, (ts, seq)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts, seq)) AS c FROM {trades} GROUP BY ALL)"


def _days(trades: DataFrame) -> DataFrame:
    return C.candles(trades, ["symbol"], "price", 86400)


def _by_day(c: str):
    return F.lag(c).over(Window.partitionBy("symbol").orderBy("bucket"))


@query("eq_c1_previous_close", "trades", sql=f"WITH {_DAY} SELECT symbol, bucket, round(lag(c) OVER (PARTITION BY symbol ORDER BY bucket), 6) AS value FROM b")
def previous_close(trades: DataFrame) -> DataFrame:
    return _days(trades).select("symbol", "bucket", F.round(_by_day("close"), 6).alias("value"))


@query("eq_c1_return", "trades", sql=f"WITH {_DAY} SELECT symbol, bucket, round(c / lag(c, 5) OVER w - 1, 9) AS simple_return, round(ln(c / lag(c, 5) OVER w), 9) AS log_return FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bucket)")
def returns(trades: DataFrame) -> DataFrame:
    """Over five bars."""
    out = U.log_returns(_days(trades), ["symbol"], 5)
    return out.select("symbol", "bucket", *[F.round(c, 9).alias(c) for c in ("simple_return", "log_return")])


@query(
    "eq_c6_realized_volatility",
    "trades",
    sql=f"""WITH {_DAY}, r AS (SELECT symbol, bucket, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY bucket)) AS r FROM b)
    SELECT symbol, bucket, round(CASE WHEN count(r) OVER w = 5 THEN sqrt(sum(r * r) OVER w * 365.0 / 5) END, 9) AS value FROM r WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS 4 PRECEDING)""",
)
def realized_volatility(trades: DataFrame) -> DataFrame:
    """Annualised over the last five daily returns; null before there are five."""
    out = U.log_returns(_days(trades), ["symbol"])
    five = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(-4, 0)
    r = F.col("log_return")
    value = F.when(F.count(r).over(five) == 5, F.sqrt(F.sum(r * r).over(five) * 365.0 / 5))
    return out.select("symbol", "bucket", F.round(value, 9).alias("value"))


@query("eq_c6_intraday_range", "trades", sql=f"WITH {_DAY} SELECT symbol, bucket, round(h - l, 6) AS value, round((h - l) / o * 10000, 6) AS bps FROM b")
def intraday_range(trades: DataFrame) -> DataFrame:
    span = F.col("high") - F.col("low")
    return _days(trades).select("symbol", "bucket", F.round(span, 6).alias("value"), F.round(F.try_divide(span, "open") * 10_000, 6).alias("bps"))


@query("eq_c6_gap", "trades", sql=f"WITH {_DAY} SELECT symbol, bucket, round(o - lag(c) OVER w, 6) AS value, round((o - lag(c) OVER w) / lag(c) OVER w * 10000, 6) AS bps FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bucket)")
def gap(trades: DataFrame) -> DataFrame:
    out = _days(trades).withColumn("gap", F.col("open") - _by_day("close"))
    return out.select("symbol", "bucket", F.round("gap", 6).alias("value"), F.round(F.try_divide(F.col("gap"), _by_day("close")) * 10_000, 6).alias("bps"))


for _name, _ref, _asset in (("eq_c1_reference_quote", "ETHUSDT", "BTCUSDT"), ("eq_c6_vix_reference", "BTCUSDT", "ETHUSDT")):

    @query(
        _name,
        "trades",
        "quotes",
        sql=f"""SELECT t.seq, round(q.bid, 6) AS ref_bid, round(q.ask, 6) AS ref_ask FROM (SELECT * FROM {{trades}} WHERE symbol = '{_asset}') t
        ASOF LEFT JOIN (SELECT * FROM {{quotes}} WHERE symbol = '{_ref}') q ON t.exchange = q.exchange AND t.ts >= q.ts""",
    )
    def _reference(trades: DataFrame, quotes: DataFrame, ref: str = _ref, asset: str = _asset) -> DataFrame:
        """The reference instrument's quote at each time of the asset's tape."""
        grid, marks = trades.where(F.col("symbol") == asset), quotes.where(F.col("symbol") == ref)
        out = asof(grid, marks, ["exchange"], ["bid", "ask"], prefix="ref_")
        return out.select("seq", *r6("ref_bid", "ref_ask"))


_MEASURES = {
    "eq_c8_top_imbalance": ("imbalance", "(bid_size - ask_size) / (bid_size + ask_size)"),
    "eq_c8_microprice": ("microprice", f"CASE WHEN {_VALID} THEN (bid * ask_size + ask * bid_size) / (bid_size + ask_size) END"),
}
_FRESH = 7200  # a quote older than this at the time of a trade is stale


@query(
    "eq_c1_midpoint",
    "trades",
    "quotes",
    sql=f"""SELECT t.seq, t.symbol, round(CASE WHEN q.bid <= q.ask AND t.es - q.es <= {_FRESH} THEN (q.bid + q.ask) / 2 END, 9) AS value
    FROM {{trades}} t ASOF LEFT JOIN {{quotes}} q ON t.symbol = q.symbol AND t.exchange = q.exchange AND t.ts >= q.ts""",
)
def quote_midpoint(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """At each time of the tape; null where the quote in force is missing, crossed or stale."""
    met = asof(trades, quotes, ["symbol", "exchange"], ["bid", "ask"]).withColumn("age", F.col("es") - F.col("q_es"))
    return met.select("seq", "symbol", F.round(B.midpoint("q_bid", "q_ask", "age", _FRESH), 9).alias("value"))


@query("quote_midpoint", "quotes", sql=f"SELECT seq, symbol, round(CASE WHEN {_VALID} THEN (bid + ask) / 2 END, 9) AS value FROM {{quotes}}")
def own_midpoint(quotes: DataFrame) -> DataFrame:
    """Of each quote as it came in."""
    return B.quote_measures(quotes).select("seq", "symbol", F.round("mid", 9).alias("value"))


for _name, (_column, _expr) in _MEASURES.items():

    @query(_name, "quotes", sql=f"SELECT seq, symbol, round({_expr}, 9) AS value FROM {{quotes}}")
    def _measure(quotes: DataFrame, column: str = _column) -> DataFrame:
        return B.quote_measures(quotes).select("seq", "symbol", F.round(column, 9).alias("value"))


@query("eq_c8_spread", "quotes", sql=f"SELECT seq, symbol, round(CASE WHEN {_VALID} THEN ask - bid END, 9) AS value, round(CASE WHEN {_VALID} THEN (ask - bid) / ((bid + ask) / 2) * 10000 END, 6) AS bps FROM {{quotes}}")
def spread(quotes: DataFrame) -> DataFrame:
    return B.quote_measures(quotes).select("seq", "symbol", F.round("spread", 9).alias("value"), F.round("spread_bps", 6).alias("bps"))


@query("eq_c8_top_of_book_size", "quotes", sql="SELECT symbol, exchange, arg_max(bid_size, (ts, seq)) AS bid_size, arg_max(ask_size, (ts, seq)) AS ask_size FROM {quotes} GROUP BY ALL")
def top_size(quotes: DataFrame) -> DataFrame:
    return B.latest(quotes, ["symbol", "exchange"], ["bid_size", "ask_size"])


@query("eq_c3_shortable_shares", "quotes", sql="SELECT symbol, es // 86400 * 86400 AS bucket, arg_max(ask_size, (ts, seq)) * 100 AS value FROM {quotes} GROUP BY ALL")
def shortable(quotes: DataFrame) -> DataFrame:
    """The day's last indicative quantity, in lots of 100."""
    return U.metric(quotes, ["symbol"], F.col("ask_size") * 100, 86400)


@query("eq_c8_depth_level", "depth", sql="SELECT symbol, exchange, side, level, round(arg_max(price, (ts, seq)), 6) AS price, arg_max(size, (ts, seq)) AS size FROM {depth} GROUP BY ALL")
def depth_level(depth: DataFrame) -> DataFrame:
    out = B.latest(depth, ["symbol", "exchange", "side", "level"], ["price", "size"])
    return out.select("symbol", "exchange", "side", "level", *r6("price"), "size")


_SNAP = """s AS (SELECT seq, symbol, es, sum(size) FILTER (side = 'bid' AND level <= 5) AS b, sum(size) FILTER (side = 'ask' AND level <= 5) AS a,
    sum(size::DOUBLE * size) / (sum(size)::DOUBLE * sum(size)) AS h FROM {depth} GROUP BY ALL)"""
for _name, _column, _expr in (
    ("eq_c8_visible_bid_depth", "bid_depth", "b::DOUBLE"),
    ("eq_c8_visible_ask_depth", "ask_depth", "a::DOUBLE"),
    ("eq_c8_depth_imbalance", "imbalance", "round((b - a) / (b + a)::DOUBLE, 9)"),
    ("eq_c8_depth_concentration", "concentration", "round(h, 9)"),
):

    @query(_name, "depth", sql=f"WITH {_SNAP} SELECT seq, symbol, {_expr} AS value FROM s")
    def _depth(depth: DataFrame, column: str = _column) -> DataFrame:
        return B.visible_depth(depth, ["symbol", "seq"], 5).select("seq", "symbol", F.round(column, 9).alias("value"))


@query(
    "eq_c8_displayed_liquidity_change",
    "depth",
    sql="""WITH d AS (SELECT symbol, exchange, side, round(price, 6) AS price, size - lag(size) OVER (PARTITION BY symbol, exchange, side, round(price, 6) ORDER BY ts, seq) AS ch FROM {depth})
    SELECT symbol, exchange, side, price, sum(greatest(coalesce(ch, 0), 0))::BIGINT AS added, sum(greatest(-coalesce(ch, 0), 0))::BIGINT AS removed FROM d GROUP BY ALL""",
)
def liquidity_change(depth: DataFrame) -> DataFrame:
    return B.liquidity_change(depth.withColumn("price", F.round("price", 6)), ["symbol", "exchange"])


@query("eq_c8_large_visible_order", "depth", sql="SELECT seq, symbol, side, level, size FROM {depth} WHERE size >= 300")
def large_visible(depth: DataFrame) -> DataFrame:
    return depth.where("size >= 300").select("seq", "symbol", "side", "level", "size")


@query(
    "eq_c8_visible_liquidity_persistence",
    "depth",
    sql="""WITH s AS (SELECT DISTINCT symbol, exchange, ts, seq FROM {depth}), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, exchange ORDER BY ts, seq) AS k FROM s),
    l AS (SELECT d.* REPLACE (round(d.price, 6) AS price), k.k, k.k - row_number() OVER (PARTITION BY d.symbol, d.exchange, d.side, round(d.price, 6) ORDER BY k.k) AS island FROM {depth} d JOIN k ON d.symbol = k.symbol AND d.exchange = k.exchange AND d.seq = k.seq WHERE size >= 300)
    SELECT symbol, exchange, side, price, min(es) AS start_es, max(es) AS end_es, count(*) AS snapshots FROM l GROUP BY symbol, exchange, side, price, island""",
)
def liquidity_persistence(depth: DataFrame) -> DataFrame:
    return B.persistence(depth.withColumn("price", F.round("price", 6)), ["symbol", "exchange"], 300, ["side", "price"])


@query(
    "eq_c8_large_liquidity_activity",
    "trades",
    "depth",
    sql="""WITH t AS (SELECT seq, symbol, es FROM {trades} WHERE size >= 95), b AS (SELECT DISTINCT symbol, es, seq AS snap FROM {depth} WHERE size >= 400)
    SELECT t.seq, count(*) AS nearby FROM t JOIN b ON t.symbol = b.symbol AND abs(t.es - b.es) <= 1800 GROUP BY 1""",
)
def large_activity(trades: DataFrame, depth: DataFrame) -> DataFrame:
    """Large trades with large visible orders within half an hour: an interval join on time cells.

    Each book snapshot goes to its own cell of half an hour and both neighbours; trades meet one cell.
    """
    cell = 1800
    large = trades.where("size >= 95").select("seq", "symbol", "es", F.expr(f"es div {cell}").alias("cell"))
    shown = depth.where("size >= 400").select("symbol", F.col("es").alias("book_es"), F.col("seq").alias("snap")).distinct()
    shown = shown.withColumn("cell", F.explode(F.expr(f"sequence(book_es div {cell} - 1, book_es div {cell} + 1)")))
    met = large.join(shown, ["symbol", "cell"]).where(F.abs(F.col("es") - F.col("book_es")) <= cell)
    return met.groupBy("seq").agg(F.count(F.lit(1)).alias("nearby"))


@query(
    "eq_c8_depth_tape_alignment",
    "trades",
    "quotes",
    "depth",
    sql=f"""WITH {_SNAP}, e AS (SELECT t.symbol, t.es, t.size, CASE WHEN q.bid < q.ask AND t.price >= q.ask THEN 'BUY' WHEN q.bid < q.ask AND t.price <= q.bid THEN 'SELL' ELSE 'UNKNOWN' END AS side
        FROM {{trades}} t ASOF LEFT JOIN {{quotes}} q ON t.symbol = q.symbol AND t.exchange = q.exchange AND t.ts >= q.ts),
    d AS (SELECT symbol, es // 3600 * 3600 AS bucket, avg((b - a) / (b + a)::DOUBLE) AS i FROM s GROUP BY ALL),
    n AS (SELECT symbol, es // 3600 * 3600 AS bucket, sum(CASE side WHEN 'BUY' THEN size WHEN 'SELL' THEN -size ELSE 0 END) AS net FROM e GROUP BY ALL)
    SELECT symbol, count(*) AS bars, count(*) FILTER (sign(round(i, 9)) = sign(net)) AS aligned FROM d JOIN n USING (symbol, bucket) GROUP BY 1""",
)
def alignment(trades: DataFrame, quotes: DataFrame, depth: DataFrame) -> DataFrame:
    """Hours in which the mean depth imbalance and the net estimated aggressor volume point the same way."""
    book = B.visible_depth(depth, ["symbol", "seq", "es"], 5)
    book = C.bucketed(book, 3600).groupBy("symbol", "bucket").agg(F.avg("imbalance").alias("i"))
    met = asof(trades.drop("side"), quotes, ["symbol", "exchange"], ["bid", "ask"])
    tape = C.bucketed(met.withColumn("side", W.aggressor(met)), 3600).groupBy("symbol", "bucket").agg(F.sum(W.signed()).alias("net"))
    same = F.signum(F.round("i", 9)) == F.signum("net")
    return book.join(tape, ["symbol", "bucket"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count(F.when(same, 1)).alias("aligned"))


@query(
    "book_heatmap",
    "depth",
    sql="""WITH l AS (SELECT symbol, es // 14400 * 14400 AS bucket, arg_max(seq, (ts, seq)) AS seq FROM {depth} GROUP BY ALL)
    SELECT d.symbol, l.bucket, d.side, d.level, round(d.price, 6) AS price, d.size AS qty FROM {depth} d JOIN l ON d.symbol = l.symbol AND d.seq = l.seq""",
)
def book_heatmap(depth: DataFrame) -> DataFrame:
    """Both ladders as they are stored, and flat again."""
    nested = B.heatmap(depth, ["symbol"], 14400)
    sides = [nested.select("symbol", "bucket", F.lit(s).alias("side"), F.posexplode(c).alias("p", "x")) for s, c in (("bid", "bids"), ("ask", "asks"))]
    return sides[0].union(sides[1]).select("symbol", "bucket", "side", (F.col("p") + 1).alias("level"), F.round("x.price", 6).alias("price"), F.col("x.qty").alias("qty"))


for _name, _market in (("book_heatmap_spot", "spot"), ("book_heatmap_perpetual", "futures")):

    @query(
        _name,
        "depth",
        sql=f"""WITH m AS (SELECT * FROM {{depth}} WHERE market = '{_market}'), l AS (SELECT symbol, exchange, es // 14400 * 14400 AS bucket, arg_max(seq, (ts, seq)) AS seq FROM m GROUP BY ALL)
        SELECT m.symbol, m.exchange, l.bucket, m.side, m.level, round(m.price, 6) AS price, m.size AS qty FROM m JOIN l ON m.symbol = l.symbol AND m.exchange = l.exchange AND m.seq = l.seq""",
    )
    def _heatmap(depth: DataFrame, market: str = _market) -> DataFrame:
        """By venue; both ladders flat, best level first."""
        nested = B.heatmap(depth.where(F.col("market") == market), ["symbol", "exchange"], 14400)
        sides = [nested.select("symbol", "exchange", "bucket", F.lit(s).alias("side"), F.posexplode(c).alias("p", "x")) for s, c in (("bid", "bids"), ("ask", "asks"))]
        return sides[0].union(sides[1]).select("symbol", "exchange", "bucket", "side", (F.col("p") + 1).alias("level"), F.round("x.price", 6).alias("price"), F.col("x.qty").alias("qty"))


_NOW = 915148800
for _name, _least in (("spot", B.LARGE["spot"]), ("perpetual", B.LARGE["perpetual"])):

    @query(
        f"large_orders_{_name}",
        "limit_orders",
        "fills",
        sql=f"""WITH o AS (SELECT * FROM {{limit_orders}} WHERE es <= {_NOW} AND start_quantity * price >= {_least}),
        f AS (SELECT o.id, sum(quantity) AS q, count(*) AS n FROM {{fills}} x JOIN o ON x.id = o.id WHERE x.es <= {_NOW} AND x.es >= o.es GROUP BY 1)
        SELECT id, order_side, round(start_quantity, 6) AS start_quantity, coalesce(q, 0) AS executed_quantity, round(greatest(start_quantity - coalesce(q, 0), 0), 6) AS current_quantity,
            round(start_quantity * price, 4) AS start_usd, coalesce(n, 0) AS trade_count, {_NOW} - es AS age FROM o LEFT JOIN f USING (id)""",
    )
    def _large(orders: DataFrame, fills: DataFrame, least: float = _least) -> DataFrame:
        out = B.large_orders(orders, fills, _NOW, least)
        return out.select("id", "order_side", *r6("start_quantity"), "executed_quantity", *r6("current_quantity"), F.round("start_usd", 4).alias("start_usd"), "trade_count", "age")


@query(
    "order_diff",
    "limit_orders",
    sql="""WITH a AS (SELECT id, start_quantity AS q FROM {limit_orders} WHERE es <= 880000000), b AS (SELECT id, CASE WHEN id % 7 = 0 THEN start_quantity + 1 ELSE start_quantity END AS q FROM {limit_orders} WHERE es BETWEEN 820000000 AND 910000000)
    SELECT CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'gone' WHEN a.q = b.q THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1""",
)
def order_diff(orders: DataFrame) -> DataFrame:
    before = orders.where("es <= 880000000")
    after = orders.where("es BETWEEN 820000000 AND 910000000").withColumn("start_quantity", F.when(F.col("id") % 7 == 0, F.col("start_quantity") + 1).otherwise(F.col("start_quantity")))
    return B.snapshot_diff(before, after, "id", "start_quantity").groupBy("state").agg(F.count(F.lit(1)).alias("n"))

