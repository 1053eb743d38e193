"""Hand-computed rows, invariants, and order independence."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideframe.functions import params, scalars
from tideframe.operators import book, candles, flow, funds, quality, risk
from tideframe.operators.asof import asof
from tideframe.sources import dims, payload

T0 = datetime(2024, 1, 1)


def ticks(spark, rows):
    data = [(i, T0 + timedelta(seconds=s), 1704067200 + s, "BTCUSDT", "Binance", side, float(p), z) for i, (s, side, p, z) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, ts timestamp_ntz, es long, symbol string, exchange string, side string, price double, size long")


def test_candle_ties_and_empty_buckets(spark):
    rows = ticks(spark, [(0, "BUY", 10, 1), (0, "SELL", 12, 2), (59, "BUY", 9, 1), (180, "BUY", 11, 5)])
    got = candles.candles(rows, ["symbol"], "price", 60, volume="size").orderBy("bucket").collect()
    assert [tuple(r)[2:] for r in got] == [(10.0, 12.0, 9.0, 9.0, 4), (11.0, 11.0, 11.0, 11.0, 5)]
    assert [r["bucket"] - 1704067200 for r in got] == [0, 180]


def test_order_and_partitions_change_nothing(spark):
    rows = ticks(spark, [(i * 7 % 300, "BUY" if i % 3 else "SELL", 100 + (i * 37) % 11, i % 5 + 1) for i in range(200)])
    one = candles.candles(rows.coalesce(1), ["symbol"], "price", 60).collect()
    many = candles.candles(rows.orderBy(F.rand(3)).repartition(7), ["symbol"], "price", 60).collect()
    assert sorted(one) == sorted(many)


def test_rollup_equals_direct(spark):
    rows = ticks(spark, [(i * 13, "BUY", 100 + (i * 29) % 17, 1) for i in range(300)])
    fine = candles.candles(rows, ["symbol"], "price", 60, volume="size")
    assert sorted(candles.rollup(fine, ["symbol"], 300).collect()) == sorted(candles.candles(rows, ["symbol"], "price", 300, volume="size").collect())


def test_chains(spark):
    bars = spark.createDataFrame([("a", 0, 10.0, 12.0, 9.0, 11.0, 0.0), ("a", 60, 20.0, 21.0, 18.0, 19.0, 0.0)], "symbol string, bucket long, open double, high double, low double, close double, volume double")
    assert tuple(candles.chained(bars, ["symbol"]).orderBy("bucket").collect()[1])[2:6] == (11.0, 21.0, 11.0, 19.0)
    assert tuple(candles.delta_chained(bars, ["symbol"]).orderBy("bucket").collect()[1])[2:6] == (11.0, 12.0, 9.0, 10.0)


def test_parameters():
    with pytest.raises(ValueError, match="Allowed values: a, b"):
        params.allowed("x", "c", ["b", "a"])
    assert params.allowed_list("x", " a ,b,", ["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        params.allowed_list("x", " , ", ["a"])
    with pytest.raises(ValueError):
        params.time_range(2, 1)
    with pytest.raises(ValueError):
        params.positive("n", 0)
    with pytest.raises(ValueError):
        scalars.interval_seconds("1m", "flow")
    assert scalars.interval_seconds("1month", "metric") == 2_592_000


def test_numbers_as_text(spark):
    values = [0.0, 1.0, -2.5, 1234567.125, 123456789012.7, 1e12, 1.5e-7, 0.00012, 100000.0, 99999.9999999999, 0.1 + 0.2]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalars.number_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == [format(r["v"], ".12g") for r in rows]


def test_times(spark):
    texts = ["20240102", "20240102T030405", "2024-01-02 03:04:05", "2024-01-02T03:04:05+02:00", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.parse_time(F.col("t"))).collect()]
    assert got == [1704153600, 1704164645, 1704164645, 1704157445, None, None]


def test_asof_carries_over_spans_and_ages(spark):
    trades = ticks(spark, [(5, "BUY", 10, 1), (90_000, "BUY", 10, 1), (200_000, "BUY", 10, 1)])
    quotes = ticks(spark, [(5, "BUY", 1, 1), (6, "BUY", 2, 1)]).withColumn("bid", F.col("price"))
    got = asof(trades, quotes, ["symbol"], ["bid"]).orderBy("seq").collect()
    assert [r["q_bid"] for r in got] == [1.0, 2.0, 2.0]
    got = asof(trades, quotes, ["symbol"], ["bid"], most_age=100_000).orderBy("seq").collect()
    assert [r["q_bid"] for r in got] == [1.0, 2.0, None]


def test_quote_states_and_zero_sizes(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 0, 0), (2.0, 1.0, 1, 1), (1.0, 1.0, 1, 3), (None, 1.0, 1, 1)], "bid double, ask double, bid_size long, ask_size long")
    got = book.quote_measures(rows).collect()
    assert [r["state"] for r in got] == ["normal", "crossed", "locked", "incomplete"]
    assert [r["mid"] for r in got] == [1.5, None, 1.0, None]
    assert got[0]["imbalance"] is None and got[2]["imbalance"] == -0.5


def test_footprint_nests(spark):
    rows = ticks(spark, [(0, "BUY", 10, 1), (1, "SELL", 12, 2), (2, "BUY", 17, 4)])
    cells = flow.nested_levels(flow.footprint(rows, ["symbol"], 60, 5.0), ["symbol"]).collect()
    assert [(x["price_start"], x["buy_base"], x["sell_base"]) for x in cells[0]["levels"]] == [(10.0, 1, 2), (15.0, 4, 0)]


def test_heatmap_drops_thin_books(spark):
    rows = [(s, T0, 0, "a", side, lv, float(lv), 1) for s in (1, 2) for side in ("bid", "ask") for lv in range(1, 17)]
    depth = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, es long, symbol string, side string, level int, price double, size long")
    assert book.heatmap(depth, ["symbol"], 60).count() == 1
    assert book.heatmap(depth.where("level < 15"), ["symbol"], 60).count() == 0


def test_option_prices(spark):
    chain = spark.createDataFrame([(100000.0, 100000.0, 30 / 365.25, 0.04, 0.6)], "spot double, strike double, tenor double, rate double, vol double")
    row = risk.option_greeks(chain).collect()[0]
    spread = 0.6 * math.sqrt(30 / 365.25)
    d1 = (0.04 + 0.18) * (30 / 365.25) / spread
    n = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    assert row["call_price"] == pytest.approx(100000 * n(d1) - 100000 * math.exp(-0.04 * 30 / 365.25) * n(d1 - spread))
    assert row["call_price"] - row["put_price"] == pytest.approx(100000 - 100000 * math.exp(-0.04 * 30 / 365.25), abs=1e-6)


def test_liquidation_price_bins(spark):
    rows = spark.createDataFrame([(100.0, 10, "LONG", 5.0, 86_000), (100.0, 10, "SHORT", 7.0, 86_000), (100.0, 10, "LONG", 1.0, -100)], "entry double, leverage int, side string, notional double, es long")
    got = {r["price_bin"]: r["notional"] for r in risk.liquidation_map(rows, 86_400, "1d", 5.0).collect()}
    assert got == {90.0: 5.0, 105.0: 7.0} or got == {90.0: 5.0, 110.0: 7.0}


def test_leverage_without_reserve(spark):
    rows = ticks(spark, [(0, "BUY", 10, 1)]).selectExpr("*", "5D AS open_interest", "0D AS exchange_reserve", "10D AS btc_price")
    assert funds.leverage_ratio(rows, ["symbol"], 60).collect()[0]["value"] == 0.0


def test_violation_codes_treat_null_as_failed(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    got = df.select(quality.violation_codes({"positive": F.col("x") > 0}).alias("c")).collect()
    assert [r["c"] for r in got] == [[], ["positive"]]


def test_dimensions(spark):
    assert len(dims.DATASETS) == 33 and len({d[2] for d in dims.DATASETS}) == 33
    assert len(dims.OBSERVABLES) == 37 and dims.datasets(spark).count() == 35
    by = dims.observables(spark).groupBy("class").count().collect()
    assert {r["class"]: r["count"] for r in by} == {"RAW": 13, "DERIVED": 19, "INFERRED": 5}
    assert all(abs(sum(of.values()) - 1) < 1e-9 for of in dims.TRANSITIONS.values())


def test_payload_files(spark, tmp_path):
    good = '{"code":"0","msg":"ok","data":[{"time":1704067200000,"open":"1","high":"2","low":"0.5","close":"1.5"}]}'
    for name, body in (("a", good), ("b", '{"code":"400","msg":"no","data":null}'), ("c", "not json")):
        (tmp_path / f"{name}.json").write_text(body)
    rows, rejects = payload.ingest(payload.read_files(spark, f"file://{tmp_path}"), "coded")
    assert [tuple(r)[1:] for r in rows.collect()] == [(1704067200, 1.0, 2.0, 0.5, 1.5)]
    assert rejects.count() == 2
    points, _ = payload.ingest(spark.createDataFrame([("p", '[{"t": 1704067200, "v": 1.5}]'), ("e", '{"error": "x"}')], "name string, body string"), "points")
    assert [tuple(r) for r in points.collect()] == [("p", 1704067200, 1.5)]


def test_payloads_are_written_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 60, 1.5), ("a", 0, 2.0), ("b", 0, -3.0)], "key string, es long, value double")
    payload.write_payloads(payload.export(rows, "key", "points"), f"file://{tmp_path}/out")
    back = {r["name"]: r["value"] for r in spark.read.text(f"file://{tmp_path}/out").collect()}
    assert back == {"a": '[{"t":0,"v":2.0},{"t":60,"v":1.5}]', "b": '[{"t":0,"v":-3.0}]'}


def test_normal_distribution(spark):
    xs = [-40.0, -9.5, -7.5, -3.0, -1e-9, 0.0, 0.5, 2.0, 7.0, 7.2, 12.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(risk.normal_cdf(F.col("x"))).collect()]
    for x, y in zip(xs, got, strict=True):
        assert y == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-7, abs=1e-15)
