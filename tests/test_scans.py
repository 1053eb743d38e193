"""Recursions, order statistics and lagged products over keys in many tasks, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.operators import quantiles, risk, spans
from tideframe.operators.scans import Maps, clamped_affine, composed

KINDS = "key string, bucket long, var double, regime_vol double, target double, x double"


@pytest.fixture(scope="module")
def bars(spark):
    """A heavy key all of whose rows lie close together, light ones, a null key; flat, rising and spiky values."""
    rng, rows = np.random.default_rng(4), []
    for key, n in (("hot", 3000), ("a", 1), ("b", 40), (None, 25)):
        for i in range(n):
            rows.append((key, int(1000 + i * (1 if key == "hot" else 60)), float(rng.choice([0, 0.1, 3.24, 50])), float(rng.choice([0.2, 0.6, 1.4])), float(rng.choice([0, 0.02, 0.3, 1, 4])), float(rng.choice([1, 2, 2.5]) * rng.integers(-3, 4))))
    return spark.createDataFrame(rows, KINDS).repartition(5).cache()


def folded(bars, start, step):
    out, last = {}, {}
    for r in sorted(bars.collect(), key=lambda r: r["bucket"]):
        last[r["key"]] = out[r["key"], r["bucket"]] = step(last.get(r["key"], start), r)
    return out


@pytest.mark.parametrize("most", [None, 7, 100])
def test_variance_and_stress_in_spans(spark, bars, most):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)  # spans go over several batches
    try:
        got = {(r["key"], r["bucket"]): r["volatility"] for r in risk.ewma_variance(bars, ["key"], most=most).collect()}
        calm = {(r["key"], r["bucket"]): r["stress"] for r in risk.stress(bars, ["key"], most=most).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(folded(bars, 0.5, lambda v, r: min(1.8, max(0.15, math.sqrt(0.92 * v * v + 0.055 * r["regime_vol"] ** 2 + 0.025 * r["var"])))))
    assert calm == pytest.approx(folded(bars, 0.1, lambda v, r: min(1.0, max(0.02, 0.82 * v + 0.18 * r["target"]))))


def test_no_rows_and_null_steps(spark, bars):
    none = bars.where("bucket < 0")
    assert clamped_affine(none, ["key"], 0.5, F.col("x"), 0.0, 1.0, 0.5, "v").count() == 0
    gaps = bars.where("key = 'b'").withColumn("x", F.when(F.col("bucket") % 120 == 0, F.col("x")))
    got = {r["bucket"]: r["v"] for r in clamped_affine(gaps, ["key"], 0.5, F.col("x"), -1.0, 1.0, 0.5, "v").collect()}
    want = folded(gaps, 0.5, lambda v, r: min(1.0, max(-1.0, 0.5 * v + (r["x"] or 0))))
    assert got == pytest.approx({b: v for (_, b), v in want.items()})


def test_maps_compose_like_functions():
    rng = np.random.default_rng(1)
    low = rng.normal(size=60)
    maps = Maps(rng.random(60) * 2, rng.normal(size=60), low, low + rng.random(60))
    place = np.concatenate([np.arange(1), np.arange(37), np.arange(22)])
    found = composed(maps, place)
    for v0 in (-5.0, 0.0, 0.3, 9.0):
        v = v0
        for i in range(60):
            v = maps.take(i).of(v0 if place[i] == 0 else v)
            assert found.take(i).of(v0) == pytest.approx(v)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.953, 1.0])
def test_quantiles(bars, share):
    for column in ("x", "var"):
        got = {r["key"]: r["q"] for r in quantiles.quantile(bars, ["key"], column, share, "q").collect()}
        want = {}
        for r in bars.select("key", column).collect():
            want.setdefault(r["key"], []).append(r[column])
        assert got == pytest.approx({k: float(np.quantile(v, share)) for k, v in want.items()})


def test_quantiles_of_distinct_values_and_poor_guesses(spark, monkeypatch):
    table = spark.range(5001).select((F.col("id") * 7919 % 5001).cast("double").alias("v"), F.lit(None).cast("double").alias("n"))
    assert quantiles.quantile(table, [], "v", 0.5, "q").first()["q"] == 2500
    assert quantiles.quantile(table, [], "v", 0.3333, "q").first()["q"] == pytest.approx(0.3333 * 5000)
    assert quantiles.quantile(table, [], "n", 0.5, "q").where("q is not null").count() == 0
    for rank in (0, 17, 2499, 2500, 2501, 4990, 5000):  # the guess lies elsewhere: still exact
        r = quantiles.order_statistic(table, [], "v", 0.5, lambda n, k=rank: F.lit(k)).first()
        assert (r["at"], r["next"]) == (rank, rank + 1 if rank < 5000 else None)


@pytest.mark.parametrize("block", [1 << 16, 90, 256])
def test_autocorrelation_in_blocks(bars, block, monkeypatch):
    monkeypatch.setattr(spans, "MOST_ROWS", 500)
    got = {(r["key"], r["lag"]): r["autocorrelation"] for r in risk.autocorrelation(bars.where("key is not null"), ["key"], "x", 8, 80, block).collect()}
    want = {}
    for key in ("hot", "a", "b"):
        x = np.array([r["x"] for r in sorted(bars.where(F.col("key") == key).collect(), key=lambda r: r["bucket"])])
        d = x - x.mean()
        for lag in range(8, min(80, len(x) // 3) + 1):
            want[key, lag] = float((d[:-lag] * d[lag:]).sum() / (d * d).sum())
    assert got == pytest.approx(want)


def test_severe_tail_takes_a_share_of_ties(spark):
    rows = spark.createDataFrame([(float(z), float(z * z % 5)) for z in [1] * 6 + [2] * 30 + [3] * 4], "z double, x double")
    r = risk.severe_tail(rows, "z", "x", 0.25).first()  # ten rows: the four of 3 and six of the thirty of 2
    assert r["severe_rows"] == 10 and r["severe_mean"] == pytest.approx((4 * 4 + 6 * 4) / 10) and r["normal_mean"] == pytest.approx((24 * 4 + 6 * 1) / 30)
