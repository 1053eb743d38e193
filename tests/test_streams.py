"""Streams over several micro-batches give the batch operators' rows."""

import datetime
import math
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideframe.operators import candles as C
from tideframe.operators.quality import quality_report
from tideframe.plans import registry
from tideframe.sources.adapters import table
from tideframe.streaming import live, stateful
from tideframe.streaming.sink import MergeTable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in four files, in order of time."""
    path = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(4):
        events.where(F.col("event_id") * 4 / events.count() >= i).where(F.col("event_id") * 4 / events.count() < i + 1).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path, view="ticks"):
    return live.tick_stream(spark, path, view, files_per_trigger=1)


def test_live_candles(spark, parts):
    bars = live.live_candles(stream(spark, parts), ["symbol"], "price", "1 hour", "40 days")
    got = live.run_upserted(bars, "t", ["symbol", "bucket"]).drop("volume")
    want = C.candles(table(spark, SF, "ticks"), ["symbol"], "price", 3600).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_closed_buckets_never_change(spark, parts):
    bars = live.live_candles(stream(spark, parts), ["symbol"], "price", "1 hour", "1 hour")
    got = live.run_appended(bars, "t").drop("volume").collect()
    want = set(C.candles(table(spark, SF, "ticks"), ["symbol"], "price", 3600).drop("volume").collect())
    assert got and len({(r["symbol"], r["bucket"]) for r in got}) == len(got)
    assert set(got) <= want


def test_running_total_over_batches(spark, parts):
    got = {r["symbol"]: r["cvd"] for r in live.run_upserted(stateful.live_cvd(stream(spark, parts), ["symbol"]), "t", ["symbol"]).collect()}
    signed = F.sum(F.when(F.col("side") == "BUY", F.col("size")).when(F.col("side") == "SELL", -F.col("size")).otherwise(0))
    want = {r["symbol"]: float(r["n"]) for r in table(spark, SF, "ticks").groupBy("symbol").agg(signed.alias("n")).collect()}
    assert got == want


def test_bucket_totals_over_batches(spark, parts):
    flow = live.live_flow(stream(spark, parts), ["symbol"], "1 hour", "40 days", F.col("size"))
    got = live.anchored_cvd(live.run_upserted(flow, "t", ["symbol", "bucket"]), ["symbol"]).collect()
    want = registry.QUERIES["stream_cvd_candles"](spark, SF).collect()
    assert sorted(got) == sorted(want)
    last = max((r for r in got if r["symbol"] == "BTCUSDT"), key=lambda r: r["bucket"])
    assert last["close"] == sum(r["buy"] - r["sell"] for r in got if r["symbol"] == "BTCUSDT")


def test_metric_candles_over_batches(spark, parts):
    bars = live.live_candles(stream(spark, parts, "market_state"), ["symbol"], "funding_rate", "1 hour", "40 days")
    got = live.run_upserted(bars, "t", ["symbol", "bucket"]).drop("volume")
    want = C.candles(table(spark, SF, "market_state"), ["symbol"], "funding_rate", 3600).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_quality_over_batches(spark, parts):
    """Counters over four batches are those over one, and the batch report's."""
    make = lambda s: live.run_upserted(stateful.live_quality(s, ["symbol", "exchange"], 3600, 3600, horizon=31 * 86400), "t", ["symbol", "exchange"])
    got = {(r["symbol"], r["exchange"]): r for r in make(stream(spark, parts)).collect()}
    ticks = table(spark, SF, "ticks").withColumn("received", F.col("seq"))
    for r in quality_report(ticks, ["symbol", "exchange"], 3600, 1707000000, 600000).collect():
        g = got.pop((r["symbol"], r["exchange"]))
        assert (g["rows"], g["duplicates"], g["out_of_order"], g["observed"], g["gaps"]) == (r["rows"], r["duplicates"], r["out_of_order"], r["observed"], r["gaps"])
    assert not got


def test_late_rows_are_counted(spark, tmp_path):
    """A clock that goes back: within the delay late, beyond it dropped; repeats across batches."""
    base = 1_700_000_000
    for i, rows in enumerate(([(1, 0), (2, 7200), (3, 7000)], [(4, 60), (5, 7300), (2, 7200)])):
        values = [(s, datetime.datetime.fromtimestamp(base + t, datetime.UTC).replace(tzinfo=None), 0, "click", 1.0, '{"k": 1}') for s, t in rows]
        spark.createDataFrame(values, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{i}")
    keys = ["symbol", "exchange"]
    r = live.run_upserted(stateful.live_quality(live.tick_stream(spark, f"{tmp_path}/*", files_per_trigger=1), keys, 3600, 3600), "t", keys).first()
    assert (r["rows"], r["duplicates"], r["dropped"]) == (6, 1, 1) and r["out_of_order"] >= 2


def test_orders_go_when_unseen(spark, parts):
    ids = stream(spark, parts).withColumn("order_id", F.col("seq") % 7)
    sets = {r["order_id"]: r for r in live.run_upserted(stateful.live_orders(ids, ["order_id"], "0 seconds", 40 * 86400), "t", ["order_id"]).collect()}
    want = table(spark, SF, "ticks").withColumn("order_id", F.col("seq") % 7).groupBy("order_id").agg(F.min("es").alias("a"), F.max("es").alias("b"), F.count(F.lit(1)).alias("n"))
    for r in want.collect():
        g = sets[r["order_id"]]
        assert (g["first_es"], g["age"], g["seen"], g["gone"]) == (r["a"], r["b"] - r["a"], r["n"], False)
    old = stream(spark, parts).withColumn("order_id", F.when(F.col("seq") < 30, 1).otherwise(2))  # the first id ends early
    rows = {r["order_id"]: r for r in live.run_upserted(stateful.live_orders(old, ["order_id"], "0 seconds", 3600), "t", ["order_id"]).collect()}
    assert rows[1]["gone"] and not rows[2]["gone"]


def test_orders_go_one_by_one_and_come_again(spark, tmp_path):
    """Ids of two columns, one of them null at times and large, by a timer of a block that they share."""
    base, big = 1_700_006_400, 2**53 + 1
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    batches = ([(big, 0), (0, 5), (big + 1, 100), (big, 200)], [(big + 1, 4000)], [(big + 1, 4001)], [(big, 9000)], [(0, 9100)])
    for i, rows in enumerate(batches):
        values = [(s, datetime.datetime.fromtimestamp(base + t, datetime.UTC).replace(tzinfo=None), 0, "click", 1.0, '{"k": 1}') for s, t in rows]
        spark.createDataFrame(values, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{i}")
    stateful.ORDER_BLOCKS, blocks = 1, stateful.ORDER_BLOCKS
    try:
        ids = live.tick_stream(spark, f"{tmp_path}/*", files_per_trigger=1).withColumn("order_id", F.when(F.col("seq") > 0, F.col("seq")))
        out = live.run_upserted(stateful.live_orders(ids, ["symbol", "order_id"], "0 seconds", 3600), "t", ["symbol", "order_id"])
    finally:
        stateful.ORDER_BLOCKS = blocks
    assert out.schema["order_id"].dataType.simpleString() == "bigint"
    got = {(r["order_id"], r["first_es"] - base, r["last_es"] - base, r["age"], r["seen"], r["gone"]) for r in out.collect()}
    assert {(big, 9000, 9000, 0, 1, False), (big + 1, 100, 4001, 3901, 3, True), (None, 5, 5, 0, 1, True), (None, 9100, 9100, 0, 1, False)} <= got


def test_orders_share_state_by_blocks(spark, tmp_path):
    """Many ids in one batch cost at most as many groups as there are blocks, not one each."""
    rows = spark.range(20_000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "0L AS user_id", "'click' AS event_type", "1e0 AS value", "'{\"k\": 1}' AS props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    ids = stateful.live_orders(live.tick_stream(spark, f"{tmp_path}/in"), ["seq"], "0 seconds", 3600)
    writer = ids.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").outputMode("update")
    run = writer.trigger(availableNow=True).start()
    run.awaitTermination()
    assert max(op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"]) <= 4 * stateful.ORDER_BLOCKS


def test_risk_over_batches(spark, parts):
    make = lambda s: live.run_upserted(stateful.live_risk(s, ["symbol"], 1 / 8766), "t", ["symbol"]).collect()
    four = sorted(make(stream(spark, parts, "market_state")))
    one = sorted(make(live.tick_stream(spark, parts, "market_state")))
    assert [r["symbol"] for r in four] == [r["symbol"] for r in one]
    for a, b in zip(four, one, strict=True):
        assert (a["volatility"], a["stress"], a["last_es"]) == pytest.approx((b["volatility"], b["stress"], b["last_es"]), rel=1e-12)
    state = table(spark, SF, "market_state").orderBy("ts", "seq").toPandas()
    for r in four:  # the batch steps over the same rows
        mine = state[state["symbol"] == r["symbol"]]
        v, s, last = 0.5, 0.1, None
        for x in mine.itertuples():
            move = math.log(x.btc_price / last) if last else 0.0
            shock = min(abs(move) / (v * math.sqrt(1 / 8766)), 5.0)
            target = max(0.02, min(1.0, 0.1 + 0.16 * abs(x.order_flow_imbalance) + 0.12 * abs(x.futures_order_flow_imbalance) + 0.1 * shock))
            s = max(0.02, min(1.0, 0.82 * s + 0.18 * target))
            v = max(0.15, min(1.8, math.sqrt(0.92 * v * v + 0.055 * 0.36 + 0.025 * min(3.24, move * move * 8766))))
            last = x.btc_price
        assert r["volatility"] == pytest.approx(v) and r["stress"] == pytest.approx(s)


def test_deduplicated(spark, parts):
    twice = stream(spark, parts).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    got = live.run_appended(live.deduplicated(twice, "40 days"), "t")
    assert got.count() == table(spark, SF, "ticks").count()


def test_cvd_candles_leave_the_stream_once(spark, parts):
    got = live.run_appended(stateful.closed_cvd_candles(stream(spark, parts), ["symbol"], "1 hour", "1 hour", F.col("size")), "t").collect()
    want = {(r["symbol"], r["bucket"]): (r["buy"], r["sell"], r["open"], r["close"]) for r in registry.QUERIES["stream_cvd_candles"](spark, SF).collect()}
    assert len({(r["symbol"], r["bucket"]) for r in got}) == len(got) > 100
    for r in got:
        assert (r["buy"], r["sell"], r["open"], r["close"]) == want[r["symbol"], r["bucket"]]


def test_quality_forgets_what_the_horizon_has_passed(spark, tmp_path):
    """An id that comes again within the horizon is a duplicate; its block's state is gone after it."""
    base = 1_700_006_400
    make = lambda i, rows: spark.createDataFrame(
        [(s, datetime.datetime.fromtimestamp(base + t, datetime.UTC).replace(tzinfo=None), 0, "click", 1.0, '{"k": 1}') for s, t in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{i}")
    for i, rows in enumerate(([(1, 0), (2, 10)], [(1, 20)], [(3000, 90_000)], [(5000, 90_010)], [(1, 90_020)])):
        make(i, rows)
    keys = ["symbol", "exchange"]
    r = live.run_upserted(stateful.live_quality(live.tick_stream(spark, f"{tmp_path}/*", files_per_trigger=1), keys, 3600, 3600, horizon=7200), "t", keys).first()
    assert (r["rows"], r["duplicates"], r["observed"], r["gaps"]) == (6, 1, 2, 24)


def test_nearby_counts_are_those_of_the_pairs(spark, parts):
    """Four batches, on buckets' borders too: per trade the snapshots that the interval join pairs it with."""
    trades, quotes = table(spark, SF, "trades"), table(spark, SF, "quotes")
    near = trades.alias("t").join(quotes.alias("q"), F.expr("t.symbol = q.symbol AND abs(t.es - q.es) <= 7200"))
    want = sorted(near.groupBy("t.seq").count().collect())
    met = live.nearby(stream(spark, parts, "trades"), stream(spark, parts, "quotes"), "1 hour", 7200)
    got = live.run_upserted(met, "t", ["symbol", "bucket"]).select(F.inline("trades"))
    assert sorted(got.where("nearby > 0").collect()) == want and got.count() == trades.count()
    pairs = live.run_appended(live.concurrent(stream(spark, parts, "trades"), stream(spark, parts, "quotes"), "40 days", 7200), "t")
    assert sorted(pairs.groupBy("seq").count().collect()) == want and pairs.distinct().count() == pairs.count()


def test_nearby_makes_no_pairs(spark, tmp_path):
    """3,000 trades and 3,000 snapshots within ten minutes: 9 million pairs, in a bucket and across two."""
    rows = spark.range(6000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:05:00' + make_dt_interval(0, 0, 0, id % 600) AS ts", "0L AS user_id", "IF(id < 3000, 'view', 'click') AS event_type", "1e0 AS value", "'{\"k\": 1}' AS props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    met = live.nearby(*[live.tick_stream(spark, f"{tmp_path}/in", v) for v in ("trades", "quotes")], "1 hour", 600)
    plan = met._jdf.queryExecution().analyzed().toString()
    got = live.run_upserted(met, "t", ["symbol", "bucket"]).select(F.inline("trades"))
    assert "Join" not in plan and {r["nearby"] for r in got.collect()} == {3000} and got.count() == 3000


def test_quality_holds_numbers_only():
    """A key's rows of one batch, in many slices: counters as by pandas, and memory of some numbers a row."""
    rng = np.random.default_rng(3)
    n = 400_000
    frame = pd.DataFrame({"es": np.sort(rng.integers(0, 10**6, n)), "seq": rng.integers(0, 20_000, n), "received": np.arange(n) + rng.integers(0, 5, n)})
    frame = frame.sample(frac=1, random_state=1)

    class Kept(dict):
        getValue, containsKey, updateValue = dict.__getitem__, dict.__contains__, dict.__setitem__  # noqa: N815

    class Handle:
        registerTimer = staticmethod(lambda *_: None)  # noqa: N815

    made = stateful._Quality(["symbol"], ["symbol", "rows", "duplicates", "out_of_order", "dropped", "observed", "gaps", "last_es"], ("received", "seq"))
    made.sums, made.blocks, made.cells, made.handle, kept = SimpleNamespace(get=lambda: None, update=lambda v: kept.append(v)), Kept(), Kept(), Handle, []

    def frames():
        for lo in range(0, n, 10_000):
            yield frame.iloc[lo : lo + 10_000].assign(symbol=[f"BTC-{i}" for i in range(10_000)], ts=pd.Timestamp(0))

    tracemalloc.start()
    out = next(iter(made.handleInputRows(("BTC",), frames(), None))).iloc[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    es = frame.sort_values(["received", "seq"], kind="stable")["es"]
    want = (n, n - frame["seq"].nunique(), int((es < es.shift()).sum()), int((es < es.cummax().shift() - 3600).sum()), (es // 3600).nunique())
    assert tuple(out[["rows", "duplicates", "out_of_order", "dropped", "observed"]]) == want
    assert most < 80 * n  # pandas' frames, their texts and their sorted copy took some 200 bytes a row


def _rows(table):
    return sorted(tuple(r) for r in table.collect())


def test_merge_rewrites_touched_parts_only(spark, tmp_path):
    table = MergeTable(spark, f"file://{tmp_path}/t", ["symbol", "bucket"], groups=4)
    make = lambda rows: spark.createDataFrame(rows, "symbol string, bucket long, close double")
    table.merge(make([(s, d * 86_400 + h, 1.0) for s in "abcdefgh" for d in range(5) for h in (0, 3600)]), 0)
    before = table.manifest(0)["parts"]
    written = table.merge(make([("a", 4 * 86_400, 2.0), ("a", 5 * 86_400, 3.0)]), 1)
    after = table.manifest(1)["parts"]
    assert len(written) == 2 and len(before) > 10 and {p for p in before if after[p] != before[p]} == set(written) & set(before)
    rows = {r[:2]: r[2] for r in _rows(table.read())}
    assert len(rows) == 81 and rows["a", 4 * 86_400] == 2.0 and rows["b", 4 * 86_400] == 1.0


def test_merge_survives_reruns_lost_batches_and_readers(spark, tmp_path):
    table = MergeTable(spark, f"file://{tmp_path}/t", ["symbol", "bucket"])
    make = lambda rows: spark.createDataFrame(rows, "symbol string, bucket long, close double")
    table.merge(make([("a", 0, 1.0), ("b", 0, 1.0)]), 0)
    reader = table.read()  # planned before the batches that follow
    commit, table._commit = table._commit, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        table.merge(make([("a", 0, 9.0)]), 1)  # its files are there, its manifest is not
    assert _rows(table.read()) == [("a", 0, 1.0), ("b", 0, 1.0)]
    table._commit = commit
    for _ in range(2):
        table.merge(make([("a", 0, 2.0)]), 1)
    assert _rows(table.read()) == [("a", 0, 2.0), ("b", 0, 1.0)]
    table.merge(make([("c", 0, 3.0)]), 2)
    assert _rows(reader) == [("a", 0, 1.0), ("b", 0, 1.0)] and len(table.read().collect()) == 3
    for v in range(3, 9):
        table.merge(make([("a", 0, float(v))]), v)
    assert len(table.versions()) == 3 and len(table._names("data")) <= 5  # old files are gone
    assert _rows(table.read()) == [("a", 0, 8.0), ("b", 0, 1.0), ("c", 0, 3.0)]


def test_merge_retains_the_newest_buckets(spark, tmp_path):
    table = MergeTable(spark, f"file://{tmp_path}/t", ["symbol", "bucket"], keep_last=2)
    make = lambda rows: spark.createDataFrame(rows, "symbol string, bucket long, close double")
    table.merge(make([("a", 0, 1.0), ("a", 60, 2.0), ("b", 0, 5.0)]), 0)
    table.merge(make([("a", 60, 3.0), ("a", 200_000, 4.0)]), 1)
    assert _rows(table.read()) == [("a", 60, 3.0), ("a", 200_000, 4.0), ("b", 0, 5.0)]
    table.merge(make([("a", 300_000, 6.0), ("a", 400_000, 7.0)]), 2)
    assert _rows(table.read()) == [("a", 300_000, 6.0), ("a", 400_000, 7.0), ("b", 0, 5.0)]
