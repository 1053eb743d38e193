"""Small dimension tables, as literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Published datasets (provider, family, dataset id, path); several families by "|".
DATASETS = [
    ("coinglass", "prices", "spot_ohlcv", "/api/spot/price/history"),
    ("coinglass", "cvd_volume_orderflow", "spot_aggregated_cvd", "/api/spot/aggregated-cvd/history"),
    ("coinglass", "cvd_volume_orderflow", "futures_aggregated_cvd", "/api/futures/aggregated-cvd/history"),
    ("coinglass", "cvd_volume_orderflow|liquidity_microstructure", "spot_footprint", "/api/spot/volume/footprint-history"),
    ("coinglass", "cvd_volume_orderflow|liquidity_microstructure", "futures_footprint", "/api/futures/volume/footprint-history"),
    ("coinglass", "open_interest_and_funding", "aggregated_open_interest_ohlc", "/api/futures/open-interest/aggregated-history"),
    ("coinglass", "open_interest_and_funding", "oi_weighted_funding_rate_ohlc", "/api/futures/funding-rate/oi-weight-history"),
    ("coinglass", "etf_exchange_flows", "bitcoin_etf_flows", "/api/etf/bitcoin/flow-history"),
    ("coinglass", "etf_exchange_flows", "bitcoin_etf_list", "/api/etf/bitcoin/list"),
    ("coinglass", "liquidations", "aggregated_liquidation_history", "/api/futures/liquidation/aggregated-history"),
    ("coinglass", "liquidations", "liquidation_order_events", "/api/futures/liquidation/order"),
    ("coinglass", "liquidations", "aggregated_liquidation_map", "/api/futures/liquidation/aggregated-map"),
    ("coinglass", "liquidations", "pair_liquidation_map", "/api/futures/liquidation/map"),
    ("coinglass", "liquidations", "top_position_long_short_ratio", "/api/futures/top-long-short-position-ratio/history"),
    ("coinglass", "liquidations", "top_account_long_short_ratio", "/api/futures/top-long-short-account-ratio/history"),
    ("coinglass", "liquidations", "global_account_long_short_ratio", "/api/futures/global-long-short-account-ratio/history"),
    ("coinglass", "liquidity_microstructure", "spot_orderbook_heatmap", "/api/spot/orderbook/history"),
    ("coinglass", "liquidity_microstructure", "perpetual_orderbook_heatmap", "/api/futures/orderbook/history"),
    ("coinglass", "liquidity_microstructure", "spot_large_limit_orders", "/api/spot/orderbook/large-limit-order"),
    ("coinglass", "liquidity_microstructure", "perpetual_large_limit_orders", "/api/futures/orderbook/large-limit-order"),
    ("cryptoquant", "etf_exchange_flows", "exchange_inflow", "/btc/exchange-flows/inflow"),
    ("cryptoquant", "etf_exchange_flows", "exchange_outflow", "/btc/exchange-flows/outflow"),
    ("cryptoquant", "etf_exchange_flows", "exchange_reserve", "/btc/exchange-flows/reserve"),
    ("cryptoquant", "on_chain_miners", "mpi", "/btc/flow-indicator/mpi"),
    ("glassnode", "prices", "marketcap_usd", "/v1/metrics/market/marketcap_usd"),
    ("glassnode", "open_interest_and_funding", "futures_estimated_leverage_ratio", "/v1/metrics/derivatives/futures_estimated_leverage_ratio"),
    ("glassnode", "volatility_market_regimes", "dvol_ohlc", "/v1/metrics/derivatives/dvol_ohlc"),
    ("glassnode", "on_chain_miners", "balance_miners_sum", "/v1/metrics/distribution/balance_miners_sum"),
    ("glassnode", "on_chain_miners", "sopr", "/v1/metrics/indicators/sopr"),
    ("glassnode", "on_chain_miners", "hash_rate_mean", "/v1/metrics/mining/hash_rate_mean"),
    ("glassnode", "on_chain_miners", "difficulty_latest", "/v1/metrics/mining/difficulty_latest"),
    ("glassnode", "on_chain_miners", "transfers_volume_from_miners_sum", "/v1/metrics/transactions/transfers_volume_from_miners_sum"),
    ("glassnode", "on_chain_miners", "revenue_sum", "/v1/metrics/mining/revenue_sum"),
]

#: Catalogued equities observables (id, family, class, capability).
OBSERVABLES = [
    ("eq_c1_trade_price", "C1", "RAW", "COMPLETE"),
    ("eq_c1_best_quote", "C1", "RAW", "COMPLETE"),
    ("eq_c1_ohlcv_bar", "C1", "RAW", "COMPLETE"),
    ("eq_c1_previous_close", "C1", "RAW", "COMPLETE"),
    ("eq_c1_wap", "C1", "RAW", "COMPLETE"),
    ("eq_c1_reference_quote", "C1", "RAW", "PARTIAL"),
    ("eq_c1_midpoint", "C1", "DERIVED", "COMPLETE"),
    ("eq_c1_return", "C1", "DERIVED", "COMPLETE"),
    ("eq_c2_trade_size", "C2", "RAW", "PARTIAL"),
    ("eq_c2_trade_count", "C2", "RAW", "PARTIAL"),
    ("eq_c2_volume_rate", "C2", "DERIVED", "PARTIAL"),
    ("eq_c2_trade_rate", "C2", "DERIVED", "PARTIAL"),
    ("eq_c2_estimated_aggressor_volume", "C2", "INFERRED", "PARTIAL"),
    ("eq_c2_estimated_cvd", "C2", "INFERRED", "PARTIAL"),
    ("eq_c2_classification_coverage", "C2", "DERIVED", "PARTIAL"),
    ("eq_c2_large_trade_activity", "C2", "DERIVED", "PARTIAL"),
    ("eq_c3_shortable_shares", "C3", "RAW", "PARTIAL"),
    ("eq_c6_realized_volatility", "C6", "DERIVED", "PARTIAL"),
    ("eq_c6_intraday_range", "C6", "DERIVED", "PARTIAL"),
    ("eq_c6_gap", "C6", "DERIVED", "PARTIAL"),
    ("eq_c6_vix_reference", "C6", "RAW", "PARTIAL"),
    ("eq_c8_top_of_book_size", "C8", "RAW", "COMPLETE"),
    ("eq_c8_depth_level", "C8", "RAW", "PARTIAL"),
    ("eq_c8_spread", "C8", "DERIVED", "COMPLETE"),
    ("eq_c8_top_imbalance", "C8", "DERIVED", "COMPLETE"),
    ("eq_c8_microprice", "C8", "DERIVED", "COMPLETE"),
    ("eq_c8_visible_bid_depth", "C8", "DERIVED", "PARTIAL"),
    ("eq_c8_visible_ask_depth", "C8", "DERIVED", "PARTIAL"),
    ("eq_c8_depth_imbalance", "C8", "DERIVED", "PARTIAL"),
    ("eq_c8_depth_concentration", "C8", "DERIVED", "PARTIAL"),
    ("eq_c8_displayed_liquidity_change", "C8", "DERIVED", "PARTIAL"),
    ("eq_c8_large_visible_order", "C8", "DERIVED", "PARTIAL"),
    ("eq_c8_visible_liquidity_persistence", "C8", "DERIVED", "PARTIAL"),
    ("eq_c8_time_sales", "C8", "RAW", "PARTIAL"),
    ("eq_c8_large_liquidity_activity", "C8", "INFERRED", "PARTIAL"),
    ("eq_c8_observable_sweep_behavior", "C8", "INFERRED", "PARTIAL"),
    ("eq_c8_depth_tape_alignment", "C8", "INFERRED", "PARTIAL"),
]

#: What each market supports of each family.
CAPABILITIES = {
    "CRYPTO": {**{f"C{i}": "COMPLETE" for i in range(1, 9)}, "C9": "UNSUPPORTED"},
    "EQUITIES": {"C1": "COMPLETE", "C2": "PARTIAL", "C3": "PARTIAL", "C4": "UNSUPPORTED", "C5": "NOT_APPLICABLE", "C6": "PARTIAL", "C7": "UNSUPPORTED", "C8": "COMPLETE", "C9": "NOT_APPLICABLE"},
}

#: Limits of what a market supports of a family.
LIMITATIONS = {
    ("CRYPTO", "C9"): "proposed only",
    ("EQUITIES", "C2"): "the aggressor side is an estimate; unknown volume stays unknown",
    ("EQUITIES", "C3"): "shortable shares only",
    ("EQUITIES", "C4"): "no source for fund flows",
    ("EQUITIES", "C5"): "market data is no chain data",
    ("EQUITIES", "C6"): "realised volatility and reference prices only",
    ("EQUITIES", "C7"): "no source for forced liquidations",
    ("EQUITIES", "C8"): "complete for the visible depth and tape only",
    ("EQUITIES", "C9"): "another line of work",
}

#: Annual volatility and mean duration in seconds of each regime.
REGIMES = {
    "bullish": (0.60, 8 * 3600.0),
    "bearish": (0.72, 7 * 3600.0),
    "lateral": (0.44, 5 * 3600.0),
    "high_volatility": (1.10, 2 * 3600.0),
    "reversal": (0.88, 75 * 60.0),
    "liquidation_event": (1.55, 25 * 60.0),
}

#: Declared weights of the next regime.
TRANSITIONS = {
    "lateral": {"bullish": 0.25, "bearish": 0.25, "high_volatility": 0.22, "reversal": 0.28},
    "bullish": {"lateral": 0.34, "high_volatility": 0.22, "reversal": 0.32, "bearish": 0.12},
    "bearish": {"lateral": 0.30, "high_volatility": 0.26, "reversal": 0.30, "bullish": 0.14},
    "high_volatility": {"lateral": 0.30, "bullish": 0.18, "bearish": 0.24, "reversal": 0.20, "liquidation_event": 0.08},
    "reversal": {"lateral": 0.34, "bullish": 0.26, "bearish": 0.26, "high_volatility": 0.14},
    "liquidation_event": {"high_volatility": 0.48, "reversal": 0.32, "lateral": 0.20},
}


def datasets(spark: SparkSession) -> DataFrame:
    """A row for each dataset and family."""
    rows = spark.createDataFrame(DATASETS, "provider string, family string, dataset string, path string")
    return rows.withColumn("family", F.explode(F.split("family", "\\|")))


def observables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OBSERVABLES, "observable_id string, family string, class string, capability string")


def capabilities(spark: SparkSession) -> DataFrame:
    rows = [(market, family, status, LIMITATIONS.get((market, family), "")) for market, of in CAPABILITIES.items() for family, status in of.items()]
    return spark.createDataFrame(rows, "market string, family string, status string, limitation string")


def regimes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, *v) for r, v in REGIMES.items()], "regime string, regime_vol double, mean_seconds double")


def regime_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, w) for a, of in TRANSITIONS.items() for b, w in of.items()], "regime string, next string, weight double")


def values_sql(rows: list[tuple]) -> str:
    """Literal rows as the body of a SQL VALUES clause."""
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in row) + ")" for row in rows)
