"""Ordered work with heavy keys cut by row counts gives the rows of plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideframe.operators import book, flow, risk, spans
from tideframe.operators.asof import asof
from tideframe.sources.adapters import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """One key with nearly all rows, all of them in one day; light keys; a null key; ties in time."""
    made = spark.range(3000).select(
        F.when(F.col("id") % 100 < 90, "hot").when(F.col("id") % 100 < 97, F.concat(F.lit("k"), F.col("id") % 7)).alias("key"),
        (1_700_000_000 + (F.pow(F.col("id") / 3000, 6) * 80_000).cast("long")).alias("es"), F.col("id").alias("seq"), (F.col("id") * 37 % 11).alias("v"),
    )
    return made.withColumn("ts", F.timestamp_seconds("es")).repartition(4).cache()


@pytest.fixture(params=[1 << 21, 100])
def most(request, monkeypatch):
    monkeypatch.setattr(spans, "MOST_ROWS", request.param)
    return request.param


def test_heavy_keys_are_cut_by_counts(rows):
    cuts = spans.cuts_of(rows, ["key"], "es", 100)
    assert [c[0] for c in cuts] == ["hot"] and 10 < len(cuts[0][1]) < 40
    sizes = spans.with_span(rows, ["key"], "es", cuts).groupBy("key", "_span").count().collect()
    hot = [r["count"] for r in sizes if r["key"] == "hot"]
    assert len(hot) > 10 and max(hot) <= 700  # the densest second holds some hundred rows
    assert {r["_span"] for r in sizes if r["key"] != "hot"} == {0}
    assert spans.cuts_of(rows, ["key"], "es", 10_000) == []


def test_few_cuts_for_many_heavy_keys(rows, monkeypatch):
    monkeypatch.setattr(spans, "MOST_CUTS", 4)
    assert sum(len(c[-1]) for c in spans.cuts_of(rows, ["key"], "es", 10)) <= 8


def test_operations(rows, most):
    w = Window.partitionBy("key").orderBy("ts", "seq")
    begins = F.col("v") < F.col("prev_v")
    got = spans.Ordered(rows, ["key"]).previous(["v", "seq"]).running(F.col("v"), "total").islands(begins, "run").latest(F.when(F.col("v") > 8, F.col("v")), "high", F.when(F.col("v") > 8, F.struct("ts", "seq")))
    assert got.cut == (most == 100)
    want = rows.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_seq", F.lag("seq").over(w)).withColumn("total", F.sum("v").over(w))
    want = want.withColumn("run", F.sum(F.when(F.coalesce(begins, F.lit(True)), 1).otherwise(0)).over(w)).withColumn("high", F.last(F.when(F.col("v") > 8, F.col("v")), ignorenulls=True).over(w))
    names = ["key", "seq", "prev_v", "prev_seq", "total", "run", "high"]
    assert sorted(got.rows.select(names).collect(), key=repr) == sorted(want.select(names).collect(), key=repr)
    assert set(got.rows.columns) == set(want.columns)


def test_operators_do_not_depend_on_the_cut(spark, monkeypatch):
    trades, quotes, state, depth = (table(spark, SF, v).cache() for v in ("trades", "quotes", "market_state", "depth"))
    keys = ["symbol", "exchange"]
    made = {
        "asof": lambda: asof(trades, quotes, keys, ["bid"]).select("seq", "q_es", "q_bid"),
        "runs": lambda: risk.runs(state, keys),
        "sweeps": lambda: flow.sweeps(trades, ["symbol"], 86_400, 2),
        "persistence": lambda: book.persistence(depth, ["symbol"], 100.0, ["side", "level"]),
        "change": lambda: book.liquidity_change(depth, keys),
    }
    for name, make in made.items():
        monkeypatch.setattr(spans, "MOST_ROWS", 1 << 21)
        whole = sorted(make().collect(), key=repr)
        monkeypatch.setattr(spans, "MOST_ROWS", 40)
        assert sorted(make().collect(), key=repr) == whole and whole, name
