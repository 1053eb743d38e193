"""Options, volatility and stress recursions, regimes, series profiles, liquidation maps."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.scalars import clamp
from tideframe.operators.quantiles import order_statistic
from tideframe.operators.scans import clamped_affine
from tideframe.operators.spans import Ordered, with_previous, with_running


#: Hart's rational approximation of the normal distribution function, highest power first.
_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, to about 1e-15; Spark has no error function."""

    def polynomial(of: tuple[float, ...], a: Column) -> Column:
        value = F.lit(of[0])
        for c in of[1:]:
            value = value * a + c
        return value

    a = F.abs(x)
    density = F.exp(-a * a / 2)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + k / fraction
    near = density * polynomial(_ABOVE, a) / polynomial(_BELOW, a)
    tail = F.when(a < 7.07106781186547, near).otherwise(density / fraction / math.sqrt(2 * math.pi))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def option_greeks(chain: DataFrame) -> DataFrame:
    """Prices and greeks of European calls and puts of each row (spot, strike, tenor, rate, vol)."""
    floors = {"spot": 1e-9, "strike": 1e-9, "tenor": 1e-9, "vol": 1e-6}
    out = chain.withColumns({c: F.greatest(F.col(c).cast("double"), F.lit(lo)) for c, lo in floors.items()})
    spread = F.col("vol") * F.sqrt("tenor")
    out = out.withColumn("d1", (F.ln(F.col("spot") / F.col("strike")) + (F.col("rate") + F.col("vol") * F.col("vol") / 2) * F.col("tenor")) / spread)
    out = out.withColumn("n1", normal_cdf(F.col("d1"))).withColumn("n2", normal_cdf(F.col("d1") - spread))
    out = out.withColumn("present", F.col("strike") * F.exp(-F.col("rate") * F.col("tenor")))
    density = F.exp(-F.col("d1") * F.col("d1") / 2) / math.sqrt(2 * math.pi)
    call = F.col("spot") * F.col("n1") - F.col("present") * F.col("n2")
    put = F.col("present") * (1 - F.col("n2")) - F.col("spot") * (1 - F.col("n1"))
    zero = F.lit(0.0)
    out = out.withColumns({"call_price": F.greatest(zero, call), "put_price": F.greatest(zero, put), "call_delta": F.col("n1"), "put_delta": F.col("n1") - 1})
    out = out.withColumns({"gamma": F.greatest(zero, density / (F.col("spot") * spread)), "vega": F.greatest(zero, F.col("spot") * density * F.sqrt("tenor"))})
    return out.drop("d1", "n1", "n2")


def parity_residual(priced: DataFrame) -> Column:
    return (F.col("call_price") - F.col("put_price")) - (F.col("spot") - F.col("present"))


def atm_strike(price: Column) -> Column:
    return F.greatest(F.lit(1000.0), F.bround(price / 1000.0, 0) * 1000.0)


def implied_vol(annual: Column, regime: Column, realised: Column, stress: Column) -> Column:
    return clamp((0.72 * annual + 0.20 * regime + 0.08 * realised) * (1 + 0.28 * stress), 0.20, 1.80)


def gamma_pressure(futures_imbalance: Column, funding: Column, basis: Column, gamma: Column, spot: Column) -> Column:
    lean = -F.tanh(1.8 * futures_imbalance + 4200.0 * funding + 65.0 * basis)
    return clamp(lean * clamp(65.0 * gamma * spot, 0.0, 1.0), -1.0, 1.0)


def ewma_variance(bars: DataFrame, keys: list[str], start: float = 0.5, most: int | None = None, known: int | None = None) -> DataFrame:
    """Annual volatility by the clamped variance recursion over bars (bucket, var, regime_vol).

    ``var`` is the bar's annualised squared return, capped. The recursion is one of squares: 0.92 of the
    last, 0.055 of the regime's and 0.025 of the bar's, between 0.15 and 1.80 squared.
    """
    b = 0.055 * F.col("regime_vol") * F.col("regime_vol") + 0.025 * F.col("var")
    squares = clamped_affine(bars.select(*keys, "bucket", "var", "regime_vol"), keys, 0.92, b, 0.15**2, 1.80**2, start * start, "_v", most=most, known=known)
    return squares.select(*keys, "bucket", F.sqrt("_v").alias("volatility"))


def stress(bars: DataFrame, keys: list[str], start: float = 0.1, most: int | None = None, known: int | None = None) -> DataFrame:
    """Liquidity stress over bars (bucket, target): 0.82 of the last value and 0.18 of the target."""
    out = clamped_affine(bars.select(*keys, "bucket", "target"), keys, 0.82, 0.18 * F.col("target"), 0.02, 1.0, start, "stress", most=most, known=known)
    return out.select(*keys, "bucket", "stress")


def standardised_move(log_return: Column, volatility: Column, years: float) -> Column:
    """A bar's move in deviations of the volatility known before it."""
    return F.abs(log_return) / F.greatest(volatility * math.sqrt(years), F.lit(1e-8))


def stress_target(spot: Column, futures: Column, shock: Column) -> Column:
    return clamp(0.10 + 0.16 * F.abs(spot) + 0.12 * F.abs(futures) + 0.10 * F.least(shock, F.lit(5.0)), 0.02, 1.0)


def autocorrelation(series: DataFrame, keys: list[str], value: str, first: int = 8, last: int = 80, block: int = 1 << 16, known: int | None = None) -> DataFrame:
    """Autocorrelation of each lag from ``first`` to min(last, n / 3), over the whole series' mean and variance.

    Rows are numbered by key (see ``spans``) and dealt in blocks; a block also has the ``last`` rows that
    follow it, and sums its products for every lag at once.
    """
    rows = series.where(F.col(value).isNotNull()).select(*keys, "bucket", F.col(value).cast("double").alias("x"))
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))
    numbered = with_running(rows, keys, F.lit(1), "i", ("bucket",), "bucket", known).join(sums, keys)
    numbered = numbered.select(*keys, (F.col("i") - 1).alias("i"), (F.col("x") - F.col("mean")).alias("d"), "n")
    own = F.expr(f"i div {block}")
    halo = F.when((own > 0) & (F.col("i") % block < last), F.array(own - 1, own)).otherwise(F.array(own))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def products(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        held = held.sort_by("i")
        d, n = held.column("d").to_numpy(), held.column("n")[0].as_py()
        size = min(block, n - held.column("i")[0].as_py())  # rows of the block itself
        lags = np.arange(first, last + 1)
        s = [float((d[: max(0, min(size, len(d) - k))] * d[k : k + size]).sum()) for k in lags.tolist()]
        columns = [pa.array([k.as_py()] * (len(lags) + 1), k.type) for k in key[:-1]]
        own_sum = float((d[:size] * d[:size]).sum())
        return pa.table([*columns, pa.array([0, *lags.tolist()], pa.int32()), pa.array([own_sum, *s]), pa.array([n] * (len(lags) + 1), pa.int64())], names=[*keys, "lag", "s", "n"])

    blocks = numbered.withColumn("block", F.explode(halo)).groupBy(*keys, "block").applyInArrow(products, f"{kinds}, lag int, s double, n long")
    out = blocks.groupBy(*keys, "lag").agg(F.sum("s").alias("s"), F.first("n").alias("n"))
    total = out.where("lag = 0").select(*keys, F.col("s").alias("total"))
    top = F.least(F.lit(last), F.floor(F.col("n") / 3))
    return out.where((F.col("lag") > 0) & (F.col("lag") <= top)).join(total, keys).select(*keys, "lag", F.try_divide("s", "total").alias("autocorrelation"))


def runs(rows: DataFrame, keys: list[str], label: str = "regime", es: str = "es", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Maximal runs of one label: start, end, rows."""
    seen = Ordered(rows.withColumn("_some", F.lit(1)), keys, order, es).previous([label, "_some"])
    begins = F.col("prev__some").isNull() | ~F.col(f"prev_{label}").eqNullSafe(F.col(label))
    return seen.islands(begins, "run").rows.groupBy(*keys, "run").agg(F.first(label).alias(label), F.min(es).alias("start_es"), F.max(es).alias("end_es"), F.count(F.lit(1)).alias("rows"))


def transitions(found: DataFrame, keys: list[str], label: str = "regime") -> DataFrame:
    """How often each label follows another, and the share among its successors."""
    after = found.select(*keys, (F.col("run") - 1).alias("run"), F.col(label).alias("next"))  # runs are numbered in order
    pairs = found.select(*keys, "run", label).join(after, [*keys, "run"]).groupBy(label, "next").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def liquidation_ratio(state: DataFrame, keys: list[str], severe: float = 0.002) -> DataFrame:
    """Liquidations of each row over the open interest before it (at least 1), and whether that is severe."""
    seen = with_previous(state, keys, ["open_interest"])
    q = (F.col("long_liquidations") + F.col("short_liquidations")) / F.greatest(F.coalesce("prev_open_interest", F.lit(1.0)), F.lit(1.0))
    return seen.withColumn("ratio", q).withColumn("severe", F.coalesce(F.col("ratio") > severe, F.lit(False))).drop("prev_open_interest")


#: Horizons of a liquidation map, in days.
HORIZONS = {"1d": 1, "7d": 7, "30d": 30, "180d": 180, "365d": 365}


def liquidation_map(positions: DataFrame, now: int, horizon: str, step: float, by_leverage: bool = True) -> DataFrame:
    """Notional by the price bin where it would be liquidated: entry * (1 -+ 1 / leverage), no margin."""
    recent = positions.where((F.col("es") <= now) & (F.col("es") > now - HORIZONS[horizon] * 86_400))
    way = F.when(F.col("side") == "LONG", -1.0).otherwise(1.0)
    price = F.col("entry") * (1 + way / F.col("leverage"))
    keys = ["price_bin", *(["leverage"] if by_leverage else [])]
    return recent.withColumn("price_bin", F.floor(price / step) * step).groupBy(*keys).agg(F.sum("notional").alias("notional"))


def severe_tail(rows: DataFrame, size: str, value: str, share: float = 0.05) -> DataFrame:
    """Mean ``value`` of the largest ``share`` of rows by ``size``, and of the rest.

    The cut is an exact order statistic of the sizes (see ``quantiles``); ties at the cut are settled by
    the share of them that the tail still takes.
    """
    known = rows.where(F.col(size).isNotNull()).select(F.col(size).cast("double").alias("z"), F.col(value).alias("x"))
    first = lambda n: F.floor(n * (1 - share))
    cut = order_statistic(known, [], "z", 1 - share, lambda n: F.least(first(n), n - 1)).select(F.col("at").alias("cut"))
    side = F.when(F.col("z") > F.col("cut"), "above").when(F.col("z") == F.col("cut"), "tied").otherwise("below")
    sums = known.join(F.broadcast(cut)).groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))  # one row
    of = lambda s, c: F.coalesce(F.sum(F.when(F.col("side") == s, F.col(c))), F.lit(0)).cast("double").alias(f"{c}_{s}")
    flat = sums.agg(*[of(s, c) for s in ("above", "tied", "below") for c in ("n", "s")]).withColumn("n", F.col("n_above") + F.col("n_tied") + F.col("n_below"))
    flat = flat.withColumn("want", F.col("n") - first(F.col("n")))
    part = F.coalesce(F.try_divide(F.col("want") - F.col("n_above"), F.col("n_tied")), F.lit(0.0))
    flat = flat.withColumn("part", clamp(part, 0.0, 1.0))
    mean = lambda at, w: F.try_divide(F.col(f"s_{at}") + F.col("s_tied") * w, F.col(f"n_{at}") + F.col("n_tied") * w)
    severe = F.round(F.col("n_above") + F.col("n_tied") * F.col("part")).cast("long")
    return flat.select(mean("above", F.col("part")).alias("severe_mean"), mean("below", 1 - F.col("part")).alias("normal_mean"), severe.alias("severe_rows"))
