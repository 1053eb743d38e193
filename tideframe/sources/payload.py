"""JSON payloads of data providers: read into rows, and written from rows.

Three envelopes: ``coded`` {code, msg, data: [...]}, ``windowed`` {status: {code, message}, result:
{window, data: [...]}} and ``points`` [...]. Error payloads carry no data, or an error text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.functions.scalars import iso, number_text, parse_time, seconds_from_any
from tideframe.operators.spans import with_running
from tideframe.sources.payload_files import PayloadFiles

#: The declared records of each envelope.
RECORDS = {
    "coded": "time LONG, open STRING, high STRING, low STRING, close STRING",
    "windowed": "date STRING, value DOUBLE",
    "points": "t LONG, v DOUBLE",
}
_SHAPES = {
    "coded": f"STRUCT<code: STRING, msg: STRING, data: ARRAY<STRUCT<{RECORDS['coded'].replace(' ', ': ').replace(',:', ',')}>>>",
    "windowed": f"STRUCT<status: STRUCT<code: INT, message: STRING>, result: STRUCT<window: STRING, data: ARRAY<STRUCT<{RECORDS['windowed'].replace(' ', ': ').replace(',:', ',')}>>>>",
    "points": f"ARRAY<STRUCT<{RECORDS['points'].replace(' ', ': ').replace(',:', ',')}>>",
}


def _records(envelope: str) -> Column:
    parsed = F.from_json("body", _SHAPES[envelope], {"mode": "PERMISSIVE"})
    return {"coded": parsed["data"], "windowed": parsed["result"]["data"], "points": parsed}[envelope]


def ingest(payloads: DataFrame, envelope: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of payloads (name, body); a payload without readable records is a reject.

    Records have es (epoch seconds) and numbers; those whose time can't be read are rejects too.
    """
    read = payloads.withColumn("_records", F.filter(_records(envelope), lambda r: r.isNotNull()))
    bad = F.col("_records").isNull() | (F.size("_records") == 0)
    rows = read.where(~bad).select("name", F.inline("_records"))
    if envelope == "coded":
        numbers = [F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("open", "high", "low", "close")]
        rows = rows.select("name", seconds_from_any(F.col("time")).alias("es"), *numbers)
    elif envelope == "windowed":
        rows = rows.select("name", parse_time(F.col("date")).alias("es"), "value")
    else:
        rows = rows.select("name", seconds_from_any(F.col("t")).alias("es"), F.col("v").alias("value"))
    rejects = read.where(bad).select("name", "body", F.lit("no_records").alias("reason"))
    undated = rows.where("es is null").select("name", F.lit(None).cast("string").alias("body"), F.lit("unreadable_time").alias("reason"))
    return rows.where("es is not null"), rejects.unionByName(undated)


def read_files(spark, path: str) -> DataFrame:
    """Payload files, one a row: name, body."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("body"))


def pages(rows: DataFrame, key: str, page_rows: int, order: tuple[str, ...] = ("es",)) -> DataFrame:
    """Adds ``page``, from 0: which ``page_rows`` rows of its series, in time order, a row belongs to."""
    numbered = with_running(rows, [key], F.lit(1), "_i", order, "es")
    return numbered.withColumn("page", F.expr(f"cast((_i - 1) div {page_rows} as int)")).drop("_i")


def export(rows: DataFrame, key: str, envelope: str, window: str = "day", page_rows: int = 500) -> DataFrame:
    """Payloads (name, page, body) of each ``key``: ``page_rows`` records at most, in time order.

    ``rows``: es and open, high, low, close (coded) or value. A series of any length is as many payloads
    as it has pages, so no list outgrows one.
    """
    if envelope == "coded":
        record = F.struct((F.col("es") * 1000).alias("time"), *[number_text(F.col(c)).alias(c) for c in ("open", "high", "low", "close")])
    elif envelope == "windowed":
        record = F.struct(iso(F.col("es")).alias("date"), F.col("value").alias("value"))
    else:
        record = F.struct(F.col("es").alias("t"), F.col("value").alias("v"))
    data = F.sort_array(F.collect_list(record))
    shaped = {
        "coded": F.struct(F.lit("0").alias("code"), F.lit("success").alias("msg"), data.alias("data")),
        "windowed": F.struct(F.struct(F.lit(200).alias("code"), F.lit("success").alias("message")).alias("status"), F.struct(F.lit(window).alias("window"), data.alias("data")).alias("result")),
        "points": data,
    }[envelope]
    return pages(rows, key, page_rows).groupBy(F.col(key).alias("name"), "page").agg(F.to_json(shaped).alias("body"))


def write_payloads(payloads: DataFrame, path: str) -> None:
    """One text file part for each task, a payload a line, in a folder by name."""
    payloads.select(F.col("body").alias("value"), "name").write.partitionBy("name").text(path)


def write_payload_files(payloads: DataFrame, path: str) -> None:
    """Each payload a file of its own below ``path``, all or none of them: see ``payload_files``."""
    payloads.sparkSession.dataSource.register(PayloadFiles)
    payloads.select("name", "page", "body").write.format("payload_files").mode("append").option("path", path).save()


def read_payload_files(spark, path: str) -> DataFrame:
    """name, page, body of what was committed below ``path``."""
    spark.dataSource.register(PayloadFiles)
    return spark.read.format("payload_files").option("path", path).load()


def ingest_stream(payloads: DataFrame, envelope: str, records: str, rejects: str, checkpoint: str):
    """A streaming query that reads payloads (name, body) as they arrive: records to one folder, rejects to another.

    Each micro-batch owns a sub-folder named by its number and writes it whole, so a batch that runs
    again replaces what it wrote. Start it with the trigger wanted: this returns the stream's writer.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for frame, folder in zip(ingest(batch, envelope), (records, rejects), strict=True):
                frame.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        finally:
            batch.unpersist()

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
