"""Market tables from the shared test tables, each from one template for Spark and for DuckDB.

``table`` gives a DataFrame, ``duck`` the same rows as a DuckDB sub-query. ``$k`` is the number in the
JSON column ``props``; ``$es(c)`` is a column's epoch second.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMON = {
    "seq": "event_id",
    "ts": "ts",
    "es": "$es(ts)",
    "symbol": "CASE WHEN user_id % 2 = 0 THEN 'BTCUSDT' ELSE 'ETHUSDT' END",
    "exchange": "CASE user_id % 3 WHEN 0 THEN 'Binance' WHEN 1 THEN 'OKX' ELSE 'Bybit' END",
    "market": "CASE WHEN CAST(floor(user_id / 6e0) AS BIGINT) % 2 = 0 THEN 'spot' ELSE 'futures' END",
}
_TICKS = _COMMON | {
    "side": "CASE WHEN event_type IN ('purchase', 'signup') THEN 'BUY' WHEN event_type IN ('click', 'error') THEN 'SELL' ELSE 'UNKNOWN' END",
    "price": "1e2 + value / 1e1",
    "size": "$k + 1",
}
_QUOTES = _COMMON | {"bid": "1e2 + value / 1e1", "ask": "1e2 + value / 1e1 + ($k - 2) / 1e2", "bid_size": "$k + 1", "ask_size": "100 - $k"}
_BUY = "CASE WHEN event_type IN ('purchase', 'signup') THEN value * 1e2 ELSE 0e0 END"
_SELL = "CASE WHEN event_type IN ('click', 'error') THEN value * 1e2 ELSE 0e0 END"
_STATE = _COMMON | {
    "btc_price": "1e2 + value / 1e1",
    "volume": "$k + 1",
    "open_interest": "1e6 + 1e3 * value",
    "funding_rate": "(value - 5e1) / 1e6",
    "exchange_reserve": "CAST(1000 + $k AS DOUBLE)",
    "sopr": "1e0 + (value - 5e1) / 1e3",
    "mpi": "($k - 50) / 1e1",
    "hash_rate": "1e6 + value",
    "difficulty": "1e7 + 1e1 * value",
    "dvol": "40 + $k / 2e0",
    "taker_buy_volume_usd": _BUY,
    "taker_sell_volume_usd": _SELL,
    "long_liquidations": "CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN value * 1e2 ELSE 0e0 END",
    "short_liquidations": "CASE WHEN event_type = 'error' AND user_id % 2 = 1 THEN value * 1e2 ELSE 0e0 END",
    "order_flow_imbalance": "($k - 50) / 1e2",
    "futures_order_flow_imbalance": "(50 - $k) / 1e2",
    "regime": "CASE CAST(floor($k / 17e0) AS BIGINT) WHEN 0 THEN 'lateral' WHEN 1 THEN 'bullish' WHEN 2 THEN 'bearish' WHEN 3 THEN 'high_volatility' WHEN 4 THEN 'reversal' ELSE 'liquidation_event' END",
}
_NOTE = {"event_id": "event_id", "ts": "ts", "es": "$es(ts)"}

#: name -> (table, filter, columns)
VIEWS: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "ticks": ("events", None, _TICKS),
    "trades": ("events", "event_type <> 'view'", _TICKS),
    "quotes": ("events", "event_type = 'view'", _QUOTES),
    "market_state": ("events", None, _STATE),
    "liquidations": ("events", "event_type = 'error'", _COMMON | {"side": "CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END", "usd_value": "value * 1e2"}),
    "positions": (
        "events",
        "event_type = 'purchase'",
        _COMMON | {"entry": "1e2 + value / 1e1", "leverage": "CASE $k % 4 WHEN 0 THEN 10 WHEN 1 THEN 25 WHEN 2 THEN 50 ELSE 100 END", "side": "CASE WHEN user_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END", "notional": "(1e2 + value / 1e1) * ($k + 1)"},
    ),
    "transfers": (
        "orders",
        "o_orderstatus IN ('F', 'O')",
        {"id": "o_orderkey", "es": "$es(o_orderdate)", "entity": "'all'", "direction": "CASE WHEN o_orderstatus = 'F' THEN 'in' ELSE 'out' END", "amount": "o_totalprice"},
    ),
    "limit_orders": (
        "orders",
        None,
        {"id": "o_orderkey", "es": "$es(o_orderdate)", "price": "1e2", "start_quantity": "o_totalprice / 1e2", "order_side": "o_custkey % 2 + 1", "symbol": "'BTCUSDT'"},
    ),
    "fills": ("lineitem", None, {"id": "l_orderkey", "es": "$es(l_shipdate)", "quantity": "CAST(l_quantity AS DOUBLE)"}),
    "fund_flows": (
        "lineitem",
        None,
        {"day_s": "$es(l_shipdate)", "ticker": "concat('F', CAST(l_suppkey % 8 AS VARCHAR(1)))", "flow_usd": "CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END"},
    ),
    "fund_holdings": (
        "supplier",
        None,
        {"ticker": "concat('F', CAST(s_suppkey % 8 AS VARCHAR(1)))", "holding": "s_acctbal", "version": "s_suppkey", "price": "5e1 + s_suppkey % 10", "nav": "2e1 + s_suppkey % 7"},
    ),
    "option_chain": (
        "part",
        None,
        {
            "id": "p_partkey",
            "spot": "CAST(p_retailprice AS DOUBLE)",
            "strike": "floor(p_retailprice * CASE p_partkey % 5 WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.95e0 WHEN 2 THEN 1e0 WHEN 3 THEN 1.05e0 ELSE 1.1e0 END / 1e1 + 5e-1) * 1e1",
            "tenor": "p_size / 365.25e0",
            "rate": "4e-2",
            "vol": "2e-1 + (p_partkey % 100) / 1e2",
        },
    ),
    "bridge_events": (
        "orders",
        None,
        {"id": "o_orderkey", "es": "$es(o_orderdate)", "kind": "CASE o_orderstatus WHEN 'F' THEN 'deposit' WHEN 'O' THEN 'withdrawal' ELSE 'pending' END", "amount": "o_totalprice"},
    ),
    "raw_events": ("events", "event_type = 'view'", _COMMON | {"event_id": "event_id", "mode": "CASE WHEN event_id % 71 = 0 THEN 'LIVE' ELSE 'REPLAY' END", "values_bid": "1e2 + value / 1e1", "values_ask": "1e2 + value / 1e1 + ($k - 2) / 1e2"}),
    "observables": (
        "events",
        "event_type = 'view'",
        _NOTE
        | {
            "observable_id": "CASE WHEN event_id % 53 = 0 THEN 'eq_unlisted' ELSE 'eq_c8_spread' END",
            "asset": "CASE WHEN user_id % 2 = 0 THEN 'BTCUSDT' ELSE 'ETHUSDT' END",
            "market": "CASE WHEN event_id % 83 = 0 THEN 'option' WHEN CAST(floor(user_id / 6e0) AS BIGINT) % 2 = 0 THEN 'spot' ELSE 'futures' END",
            "family": "CASE WHEN event_id % 59 = 0 THEN 'C4' ELSE 'C8' END",
            "value": "($k - 2) / 1e2 + CASE WHEN event_id % 89 = 0 THEN 1e0 ELSE 0e0 END",
            "source_event_id": "CASE WHEN event_id % 97 = 0 THEN -event_id ELSE event_id END",
            "method_version": "CASE WHEN event_id % 61 = 0 THEN '' ELSE 'spread-absolute-v1' END",
            "tolerance": "1e-6",
        },
    ),
    "supply": (
        "orders",
        None,
        {"id": "o_orderkey", "es": "$es(o_orderdate)", "mint": "CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0e0 END", "burn": "CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0e0 END"},
    ),
}


def _spark(text: str) -> str:
    text = re.sub(r"\$es\((\w+)\)", r"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1)", text)
    text = text.replace("AS VARCHAR(1))", "AS STRING)")
    return text.replace("$k", "CAST(get_json_object(props, '$.k') AS BIGINT)")


def _duck(text: str) -> str:
    text = re.sub(r"\$es\((\w+)\)", r"(epoch_us(\1) // 1000000)", text).replace("AS VARCHAR(1))", "AS VARCHAR)")
    return text.replace("$k", "CAST(json_extract_string(props, '$.k') AS BIGINT)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A market table, or one of the raw tables by its own name."""
    if name == "depth":
        quotes = table(spark, sf_dir, "quotes").withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(20))))
        return quotes.selectExpr("seq", "ts", "es", "symbol", "exchange", "market", f"inline(array({', '.join(_DEPTH_SPARK)}))")
    if name == "dirty_ticks":
        ticks = table(spark, sf_dir, "ticks")
        again = ticks.where("seq % 50 = 0")
        return ticks.unionAll(again).withColumn("received", F.expr("CASE WHEN seq % 31 = 0 THEN seq + 40 ELSE seq END"))
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, where, columns = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    rows = rows.where(_spark(where)) if where else rows
    return rows.selectExpr(*[f"{_spark(e)} AS {c}" for c, e in columns.items()])


_SIZE = "(1 + (level * 7) % 5)"
_DEPTH = (("'bid'", "bid - 1e-2 * (level - 1)", f"bid_size * {_SIZE}"), ("'ask'", "ask + 1e-2 * (level - 1)", f"ask_size * {_SIZE}"))
_DEPTH_SPARK = [f"named_struct('side', {s}, 'level', level, 'price', {p}, 'size', {z})" for s, p, z in _DEPTH]


def duck(name: str) -> str:
    """The same rows as a DuckDB sub-query."""
    if name == "depth":
        parts = [f"SELECT seq, ts, es, symbol, exchange, market, {s} AS side, level::INTEGER AS level, {p} AS price, {z} AS size FROM {duck('quotes')}, range(1, 21) AS l(level)" for s, p, z in _DEPTH]
        return f"({' UNION ALL '.join(parts)})"
    if name == "dirty_ticks":
        again = f"SELECT * FROM {duck('ticks')} UNION ALL SELECT * FROM {duck('ticks')} WHERE seq % 50 = 0"
        return f"(SELECT *, CASE WHEN seq % 31 = 0 THEN seq + 40 ELSE seq END AS received FROM ({again}))"
    base, where, columns = VIEWS[name]
    picked = ", ".join(f"{_duck(e)} AS {c}" for c, e in columns.items())
    return f"(SELECT {picked} FROM {base}{f' WHERE {_duck(where)}' if where else ''})"


def oracle(text: str) -> str:
    """DuckDB SQL with ``{view}`` replaced by the view's sub-query."""
    return re.sub(r"\{(\w+)\}", lambda m: duck(m[1]), text)
