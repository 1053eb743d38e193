"""What the engine itself counts while streams run: rows received, and rows that a watermark has dropped."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tideframe.sources.storage import shared_folder


class RowCounts(StreamingQueryListener):
    """Totals over all micro-batches of each query (by its id): ``received`` by observation, ``dropped`` by watermarks.

    The engine counts drops where rows reach a stateful operator. Aggregations see rows that were summed
    before, so put a de-duplication (or another operator on single rows) first where rows are to be counted.
    """

    def __init__(self, observed: str = "received"):
        super().__init__()
        self.observed, self.totals, self.ended, self.lock = observed, {}, set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self.observed)
        with self.lock:
            total = self.totals.setdefault(str(progress.id), Counter())
            total["received"] += row["rows"] if row is not None else 0
            total["dropped"] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.add(str(event.runId))
            self.lock.notify_all()

    def wait(self, run_id: str, seconds: float = 60) -> None:
        """Events come some time after a query has ended."""
        end = time.monotonic() + seconds
        with self.lock:
            while run_id not in self.ended:
                if not self.lock.wait(end - time.monotonic()) and time.monotonic() > end:
                    raise TimeoutError("the engine's events did not arrive")


@contextmanager
def row_counts(spark: SparkSession, observed: str = "received") -> Iterator[RowCounts]:
    listener = RowCounts(observed)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def observed(stream: DataFrame, name: str = "received") -> DataFrame:
    return stream.observe(name, F.count(F.lit(1)).alias("rows"))


def run_counted(stream: DataFrame, name: str, arrivals: list) -> tuple[DataFrame, Counter]:
    """Runs an append-mode stream once after each of ``arrivals`` (functions that bring new files), with one
    checkpoint; returns what its sink holds, and the engine's counts."""
    spark = stream.sparkSession
    path = shared_folder(spark, name)
    with row_counts(spark) as counts:
        for arrive in arrivals:
            arrive()
            writer = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append")
            query = writer.trigger(availableNow=True).start()
            query.awaitTermination()
            counts.wait(str(query.runId))
        total = counts.totals.get(str(query.id), Counter())
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), total
