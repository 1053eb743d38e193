"""A stream source that replays a history of ticks: each micro-batch is the next stretch of event time.

    spark.dataSource.register(TickReplay)
    spark.readStream.format("tick_replay").option("path", ...).option("step", 3600).option("progress", ...).load()

Offsets are epoch seconds, so a restart from a checkpoint goes on at the second where the last batch
ended, without loss or repeats. The engine does not tell a source where a restart begins; ``progress``
names a file in which the source notes how far it has given out batches, and ``step`` holds only with it
(without, a batch goes up to the end of the history). A batch is cut into ``tasks`` equal stretches, each of which
reads only the row groups whose time statistics meet it. Also a batch source: the whole history in
``tasks`` stretches. ``path`` is a Parquet file or folder (``*`` is not expanded) on a file system that Arrow opens.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


class Stretch(InputPartition):
    """Rows with begin <= time < end, in epoch seconds."""

    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class _History:
    def __init__(self, options: dict[str, str]):
        self.path, self.tasks = options["path"], int(options.get("tasks", 4))

    def dataset(self) -> pyarrow.dataset.Dataset:
        if "://" in self.path or self.path.startswith("file:"):
            fs, path = pyarrow.fs.FileSystem.from_uri(self.path)
            return pyarrow.dataset.dataset(path, filesystem=fs, format="parquet")
        return pyarrow.dataset.dataset(self.path, format="parquet")

    def span(self) -> tuple[int, int]:
        """First second, and the one after the last, from the row groups' statistics (no rows are read)."""
        low, high = [], []
        for fragment in self.dataset().get_fragments():
            for group in fragment.row_groups:
                if group.num_rows:
                    found = (group.statistics or {}).get("ts")
                    if found is None:
                        raise ValueError(f"{self.path}: the column ts needs statistics")
                    low.append(found["min"])
                    high.append(found["max"])
        if not low:
            return 0, 0
        second = lambda t: int(t.replace(tzinfo=datetime.UTC).timestamp() // 1)
        return second(min(low)), second(max(high)) + 1

    def stretches(self, begin: int, end: int) -> list[Stretch]:
        width = max(1, -(-(end - begin) // self.tasks))
        return [Stretch(b, min(b + width, end)) for b in range(begin, end, width)]

    def rows(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        data = self.dataset()
        kind = data.schema.field("ts").type
        at = lambda s: pa.scalar(datetime.datetime.fromtimestamp(s, datetime.UTC).replace(tzinfo=None), pa.timestamp("us")).cast(kind)
        inside = (pc.field("ts") >= at(part.begin)) & (pc.field("ts") < at(part.end))
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in data.to_batches(columns=columns, filter=inside):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(c).cast(pa.timestamp("us")) if c == "ts" else batch.column(c) for c in columns], names=columns)


class _Whole(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.history = _History(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.history.stretches(*self.history.span())

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.history.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.history, self.step, self.progress = _History(options), int(options.get("step", 86_400)), options.get("progress")
        self.at = self._noted()  # how far batches were given out

    def _file(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.progress) if ":/" in self.progress else (pyarrow.fs.LocalFileSystem(), self.progress)

    def _noted(self) -> int | None:
        if not self.progress:
            return None
        fs, path = self._file()
        if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return None
        with fs.open_input_stream(path, compression=None) as held:
            return int(held.read())

    def initialOffset(self) -> dict:
        return {"second": self.history.span()[0]}

    def latestOffset(self) -> dict:
        begin, end = self.history.span()
        last, self.at = self.at, min(end, (begin if self.at is None else self.at) + self.step) if self.progress else end
        if self.progress and self.at != last:  # noted before the engine logs it: never behind the log
            fs, path = self._file()
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(f"{path}.pending", compression=None) as out:
                out.write(str(self.at).encode())
            fs.move(f"{path}.pending", path)
        return {"second": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.history.stretches(start["second"], end["second"])

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.history.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class TickReplay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tick_replay"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Whole(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
