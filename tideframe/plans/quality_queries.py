"""Queries over data quality, references, sets, catalogs and payload text."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.functions import scalars as S
from tideframe.operators import candles as C
from tideframe.operators import quality as Q
from tideframe.plans.registry import query, r6
from tideframe.sources import dims, payload
from tideframe.sources.storage import shared_folder

_CELL = "es // 3600 * 3600"


@query(
    "quality_report",
    "dirty_ticks",
    sql=f"""WITH o AS (SELECT *, CASE WHEN lag(es) OVER (PARTITION BY symbol, exchange ORDER BY received, seq) > es THEN 1 ELSE 0 END AS late FROM {{dirty_ticks}}),
    r AS (SELECT symbol, exchange, count(*) AS rows, sum(late)::BIGINT AS out_of_order, count(*) - count(DISTINCT seq) AS duplicates, count(DISTINCT {_CELL}) AS observed,
        (max({_CELL}) - min({_CELL})) // 3600 + 1 AS expected, 1707000000 - max(es) AS age FROM o GROUP BY ALL)
    SELECT symbol, exchange, rows, out_of_order, duplicates, observed, expected, expected - observed AS gaps, round(observed / expected, 9) AS coverage, age, age > 600000 AS stale FROM r""",
)
def quality_report(ticks: DataFrame) -> DataFrame:
    out = Q.quality_report(ticks, ["symbol", "exchange"], 3600, 1707000000, 600000)
    return out.withColumn("coverage", F.round("coverage", 9))


@query(
    "constraint_violations",
    "observables",
    sql="""WITH v AS (SELECT event_id, unnest(list_filter([CASE WHEN length(trim(observable_id)) > 0 THEN NULL ELSE 'empty_id' END, CASE WHEN es >= 0 THEN NULL ELSE 'negative_time' END,
        CASE WHEN value BETWEEN -0.5 AND 0.9 THEN NULL ELSE 'value_range' END, CASE WHEN length(trim(method_version)) > 0 THEN NULL ELSE 'method_version_missing' END], lambda x: x IS NOT NULL)) AS code FROM {observables})
    SELECT code, count(*) AS n FROM v GROUP BY 1""",
)
def constraint_violations(rows: DataFrame) -> DataFrame:
    checks = {
        "empty_id": F.length(F.trim("observable_id")) > 0,
        "negative_time": F.col("es") >= 0,
        "value_range": F.col("value").between(-0.5, 0.9),
        "method_version_missing": F.length(F.trim("method_version")) > 0,
    }
    return rows.select(F.explode(Q.violation_codes(checks)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("unknown_references", "observables", "raw_events", sql="SELECT o.event_id, o.source_event_id FROM {observables} o WHERE source_event_id NOT IN (SELECT event_id FROM {raw_events})")
def unknown_references(rows: DataFrame, events: DataFrame) -> DataFrame:
    return Q.unknown_references(rows, "source_event_id", events, "event_id").select("event_id", "source_event_id")


@query(
    "fixture_integrity",
    "observables",
    "raw_events",
    sql="""SELECT 'repeated_event_ids' AS check_name, (SELECT count(*) FROM (SELECT event_id FROM {raw_events} GROUP BY 1 HAVING count(*) > 1)) AS n
    UNION ALL SELECT 'unknown_references', (SELECT count(*) FROM {observables} WHERE source_event_id NOT IN (SELECT event_id FROM {raw_events}))
    UNION ALL SELECT 'asset_mismatch', (SELECT count(*) FROM {observables} o JOIN {raw_events} e ON o.source_event_id = e.event_id WHERE o.asset <> e.symbol)
    UNION ALL SELECT 'market_mismatch', (SELECT count(*) FROM {observables} o JOIN {raw_events} e ON o.source_event_id = e.event_id WHERE o.market <> e.market)
    UNION ALL SELECT 'live_mode', (SELECT count(*) FROM {raw_events} WHERE mode = 'LIVE')""",
)
def fixture_integrity(rows: DataFrame, events: DataFrame) -> DataFrame:
    events_of = events.select(F.col("event_id").alias("source_event_id"), "symbol", F.col("market").alias("event_market"))
    met = rows.join(events_of, "source_event_id")
    found = {
        "repeated_event_ids": Q.repeated(events, ["event_id"]),
        "unknown_references": Q.unknown_references(rows, "source_event_id", events, "event_id"),
        "asset_mismatch": met.where("asset <> symbol"),
        "market_mismatch": met.where("market <> event_market"),
        "live_mode": events.where("mode = 'LIVE'"),  # a fixture is synthetic or a replay
    }
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n") for name, df in found.items()]
    return functools.reduce(DataFrame.union, parts)


@query(
    "expected_vs_actual",
    "observables",
    "quotes",
    sql="""SELECT o.event_id, round(q.ask - q.bid, 6) AS actual, abs(q.ask - q.bid - o.value) <= o.tolerance AS met FROM {observables} o JOIN {quotes} q ON o.event_id = q.seq""",
)
def expected_vs_actual(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    computed = quotes.select(F.col("seq").alias("event_id"), (F.col("ask") - F.col("bid")).alias("value"))
    out = Q.compared(rows, computed, "event_id", "value", "tolerance")
    return out.select("event_id", F.round("actual", 6).alias("actual"), "met")


_CAP = dims.values_sql([(m, f, s, dims.LIMITATIONS.get((m, f), "")) for m, of in dims.CAPABILITIES.items() for f, s in of.items()])


@query(
    "capability_matrix",
    "observables",
    sql=f"""WITH c(market, family, status, limitation) AS (VALUES {_CAP}), o AS (SELECT family, count(*) AS n FROM {{observables}} GROUP BY 1)
    SELECT market, family, status, limitation, coalesce(n, 0) AS rows, status IN ('UNSUPPORTED', 'NOT_APPLICABLE') AND coalesce(n, 0) > 0 AS violation FROM c LEFT JOIN o USING (family)""",
)
def capability_matrix(rows: DataFrame) -> DataFrame:
    seen = rows.groupBy("family").agg(F.count(F.lit(1)).alias("rows"))
    out = dims.capabilities(rows.sparkSession).join(seen, "family", "left").fillna(0, ["rows"])
    barred = F.col("status").isin("UNSUPPORTED", "NOT_APPLICABLE") & (F.col("rows") > 0)
    return out.withColumn("violation", barred).select("market", "family", "status", "limitation", "rows", "violation")


@query(
    "capability_wide",
    "observables",
    sql=f"""WITH c(market, family, status, limitation) AS (VALUES {_CAP}), o AS (SELECT family, count(*) AS n FROM {{observables}} GROUP BY 1)
    SELECT market, {", ".join(f"coalesce(sum(n) FILTER (family = 'C{i}'), 0)::BIGINT AS c{i}" for i in range(1, 10))} FROM c LEFT JOIN o USING (family) GROUP BY 1""",
)
def capability_wide(rows: DataFrame) -> DataFrame:
    matrix = capability_matrix(rows)
    wide = matrix.groupBy("market").pivot("family", [f"C{i}" for i in range(1, 10)]).agg(F.sum("rows"))
    return wide.select("market", *[F.coalesce(f"C{i}", F.lit(0)).alias(f"c{i}") for i in range(1, 10)])


_CAT = dims.values_sql(dims.OBSERVABLES)


@query(
    "catalog_coverage",
    "observables",
    sql=f"""WITH c(observable_id, family, class, capability) AS (VALUES {_CAT}), o AS (SELECT observable_id, count(*) AS n, count(DISTINCT asset) AS assets FROM {{observables}} GROUP BY 1)
    SELECT coalesce(c.observable_id, o.observable_id) AS observable_id, c.family, c.class, coalesce(n, 0) AS rows, coalesce(assets, 0) AS assets,
        CASE WHEN o.observable_id IS NULL THEN 'never_produced' WHEN c.observable_id IS NULL THEN 'not_catalogued' ELSE 'covered' END AS state FROM c FULL JOIN o USING (observable_id)""",
)
def catalog_coverage(rows: DataFrame) -> DataFrame:
    seen = rows.groupBy("observable_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("asset").alias("assets"))
    both = dims.observables(rows.sparkSession).join(seen, "observable_id", "full_outer")
    state = F.when(F.col("rows").isNull(), "never_produced").when(F.col("class").isNull(), "not_catalogued").otherwise("covered")
    return both.withColumn("state", state).fillna(0, ["rows", "assets"]).select("observable_id", "family", "class", "rows", "assets", "state")


_SETS = dims.values_sql(dims.DATASETS)
_DATASET_IDS = [d[2] for d in dims.DATASETS]
_NAMED = f"['{"', '".join(_DATASET_IDS[:30])}']"


@query(
    "dataset_volumes",
    "ticks",
    sql=f"""WITH r(provider, families, dataset, path) AS (VALUES {_SETS}), d AS (SELECT provider, unnest(string_split(families, '|')) AS family, dataset FROM r),
    f AS (SELECT {_NAMED}[(seq % 30 + 1)::BIGINT] AS dataset, count(*) AS n, count(DISTINCT symbol) AS symbols, min(es) AS first_es, max(es) AS last_es FROM {{ticks}} GROUP BY 1)
    SELECT provider, family, d.dataset, coalesce(n, 0) AS rows, coalesce(symbols, 0) AS symbols, first_es, last_es FROM d LEFT JOIN f USING (dataset)""",
)
def dataset_volumes(ticks: DataFrame) -> DataFrame:
    """Rows, keys and time span of each registered dataset; three datasets have none."""
    named = ticks.withColumn("dataset", F.element_at(F.array(*map(F.lit, _DATASET_IDS[:30])), (F.col("seq") % 30 + 1).cast("int")))
    facts = named.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("es").alias("first_es"), F.max("es").alias("last_es"))
    out = dims.datasets(ticks.sparkSession).join(facts, "dataset", "left").fillna(0, ["rows", "symbols"])
    return out.select("provider", "family", "dataset", "rows", "symbols", "first_es", "last_es")


@query("set_union", "trades", sql="SELECT DISTINCT symbol, exchange, market FROM {trades} WHERE market = 'spot' UNION SELECT DISTINCT symbol, exchange, market FROM {trades} WHERE market = 'futures'")
def set_union(trades: DataFrame) -> DataFrame:
    of = trades.select("symbol", "exchange", "market")
    return of.where("market = 'spot'").unionByName(of.where("market = 'futures'")).distinct()


@query("set_difference", "ticks", sql="SELECT DISTINCT es // 60 AS minute FROM {ticks} WHERE symbol = 'BTCUSDT' EXCEPT SELECT DISTINCT es // 60 FROM {ticks} WHERE symbol = 'ETHUSDT'")
def set_difference(ticks: DataFrame) -> DataFrame:
    minutes = ticks.select(F.expr("es div 60").alias("minute"), "symbol")
    return minutes.where("symbol = 'BTCUSDT'").select("minute").subtract(minutes.where("symbol = 'ETHUSDT'").select("minute"))


@query("set_intersection", "limit_orders", sql="SELECT id FROM {limit_orders} WHERE es <= 880000000 INTERSECT SELECT id FROM {limit_orders} WHERE es >= 820000000")
def set_intersection(orders: DataFrame) -> DataFrame:
    return orders.where("es <= 880000000").select("id").intersect(orders.where("es >= 820000000").select("id"))


@query("repeated_ids", "dirty_ticks", sql="SELECT seq, count(*) AS n FROM {dirty_ticks} GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(ticks: DataFrame) -> DataFrame:
    return Q.repeated(ticks, ["seq"])


@query("number_text", "market_state", sql="SELECT seq, btc_price AS value, round(btc_price, 9) AS read_back FROM {market_state}")
def number_text(state: DataFrame) -> DataFrame:
    """Numbers as texts of 12 digits, as payloads carry them, and read back."""
    text = S.number_text(F.col("btc_price"))
    return state.select("seq", F.col("btc_price").alias("value"), text.cast("double").alias("read_back"))


_LAST = "WITH b AS (SELECT symbol, es // 3600 * 3600 AS es, arg_min(price, (ts, seq)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts, seq)) AS c FROM {ticks} GROUP BY symbol, es // 3600), k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY es DESC) <= 500)"


def _window(ticks: DataFrame) -> DataFrame:
    return C.last_n(C.candles(ticks, ["symbol"], "price", 3600), ["symbol"], 500, ["bucket"]).withColumnRenamed("bucket", "es")


@query("payload_candles", "ticks", sql=f"{_LAST} SELECT symbol AS name, es, round(o, 6) AS open, round(h, 6) AS high, round(l, 6) AS low, round(c, 6) AS close FROM k")
def payload_candles(ticks: DataFrame) -> DataFrame:
    """The last 500 candles of each symbol written as coded payloads and read back."""
    rows, _ = payload.ingest(payload.export(_window(ticks), "symbol", "coded"), "coded")
    return rows.select("name", "es", *r6("open", "high", "low", "close"))


for _envelope in ("windowed", "points"):

    @query(f"payload_{_envelope}", "ticks", sql=f"{_LAST} SELECT symbol AS name, es, round(c, 6) AS value FROM k")
    def _payload(ticks: DataFrame, envelope: str = _envelope) -> DataFrame:
        series = _window(ticks).select("symbol", "es", F.col("close").alias("value"))
        rows, _ = payload.ingest(payload.export(series, "symbol", envelope), envelope)
        return rows.select("name", "es", *r6("value"))


@query(
    "payload_pages",
    "ticks",
    sql="""WITH b AS (SELECT symbol, es // 3600 * 3600 AS es, arg_max(price, (ts, seq)) AS c FROM {ticks} GROUP BY symbol, es // 3600)
    SELECT symbol AS name, ((row_number() OVER (PARTITION BY symbol ORDER BY es) - 1) // 100)::INTEGER AS page, es, round(c, 6) AS value FROM b""",
)
def payload_pages(ticks: DataFrame) -> DataFrame:
    """All hourly closes in pages of 100 records, written as files under the commit protocol and read back."""
    series = C.candles(ticks, ["symbol"], "price", 3600).select("symbol", F.col("bucket").alias("es"), F.col("close").alias("value"))
    path = shared_folder(ticks.sparkSession, "payload-pages")
    payload.write_payload_files(payload.export(series, "symbol", "points", page_rows=100), path)
    files = payload.read_payload_files(ticks.sparkSession, path)
    rows, _ = payload.ingest(files.select(F.concat_ws("/", "name", "page").alias("name"), "body"), "points")
    parts = F.split("name", "/")
    return rows.select(parts[0].alias("name"), parts[1].cast("int").alias("page"), "es", *r6("value"))


_PAYLOADS = """SELECT CASE WHEN seq % 3 = 0 THEN 'no_records' WHEN seq % 3 = 1 THEN 'unreadable_time' ELSE 'read' END AS outcome, count(*) AS n FROM {ticks} GROUP BY 1"""


@query("payload_quarantine", "ticks", sql=_PAYLOADS)
def payload_quarantine(ticks: DataFrame) -> DataFrame:
    """The payloads of ``payload_rejects`` as a stream: records go to one folder, rejects to another."""
    spark, path = ticks.sparkSession, shared_folder(ticks.sparkSession, "payload-quarantine")
    _bodies(ticks).write.parquet(f"{path}/in")
    arrived = spark.readStream.schema("name string, body string").option("maxFilesPerTrigger", 1 << 10).parquet(f"{path}/in")
    writer = payload.ingest_stream(arrived, "windowed", f"{path}/records", f"{path}/rejects", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    records = spark.read.parquet(f"{path}/records").select(F.lit("read").alias("outcome"))
    return records.unionByName(spark.read.parquet(f"{path}/rejects").select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("payload_rejects", "ticks", sql="SELECT CASE WHEN seq % 3 = 0 THEN 'no_records' ELSE 'unreadable_time' END AS reason, count(*) AS n FROM {ticks} WHERE seq % 3 <> 2 GROUP BY 1")
def payload_rejects(ticks: DataFrame) -> DataFrame:
    """Of a payload for each tick a third is an error and a third has no readable date."""
    _, rejects = payload.ingest(_bodies(ticks), "windowed")
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _bodies(ticks: DataFrame) -> DataFrame:
    error = F.lit('{"status": {"code": 400, "message": "bad"}, "result": null}')
    record = F.concat(F.lit('{"status": {"code": 200, "message": "ok"}, "result": {"window": "day", "data": [{"date": "'), F.when(F.col("seq") % 3 == 2, S.iso(F.col("es"))).otherwise("soon"), F.lit('", "value": 1.5}]}}'))
    return ticks.select(F.col("seq").cast("string").alias("name"), F.when(F.col("seq") % 3 == 0, error).otherwise(record).alias("body"))


@query(
    "dataset_registry",
    "ticks",
    sql=f"""WITH r(provider, families, dataset, path) AS (VALUES {_SETS}), f AS (SELECT {_NAMED}[(seq % 30 + 1)::BIGINT] AS dataset, count(*) AS n FROM {{ticks}} GROUP BY 1)
    SELECT provider, count(*) AS entries, count(DISTINCT dataset) AS datasets, count(*) - count(DISTINCT dataset) AS repeated, sum(coalesce(n, 0))::BIGINT AS rows FROM r LEFT JOIN f USING (dataset) GROUP BY 1""",
)
def dataset_registry(ticks: DataFrame) -> DataFrame:
    """Whether (provider, dataset) is unique in the registry, and what rows the provider's datasets have."""
    named = ticks.withColumn("dataset", F.element_at(F.array(*map(F.lit, _DATASET_IDS[:30])), (F.col("seq") % 30 + 1).cast("int")))
    facts = named.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    entries = ticks.sparkSession.createDataFrame(dims.DATASETS, "provider string, families string, dataset string, path string")
    out = entries.join(facts, "dataset", "left").groupBy("provider")
    distinct = F.countDistinct("dataset")
    return out.agg(F.count(F.lit(1)).alias("entries"), distinct.alias("datasets"), (F.count(F.lit(1)) - distinct).alias("repeated"), F.sum(F.coalesce("n", F.lit(0))).alias("rows"))
