"""Topics kept as logs on storage: partitions of messages with offsets, as a Spark data source.

A log stands for a broker where none runs. Every append adds one Parquet file to each
partition it touches, and offsets go on where the partition ended, so a range of offsets
can be read again at any time. Streams start at the newest offset or the earliest; later
starts go on from the offsets in the query's checkpoint.
"""

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "topiclog"
SCHEMA = "topic string, partition int, offset long, timestamp timestamp, key string, value string"
_COLUMNS = ["offset", "timestamp", "key", "value"]


@dataclass
class Span(InputPartition):
    """Offsets of one partition, from ``low`` to before ``high``."""

    partition: int
    low: int
    high: int


class Log:
    """The files of a log, seen from Python."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        if "://" in self.path and not self.path.startswith("file:"):
            self.files, self.root = fs.FileSystem.from_uri(self.path)
        else:  # Hadoop also writes file:/folder
            self.files, self.root = fs.LocalFileSystem(), re.sub("^file:/+", "/", self.path)

    def _data(self, folder: str) -> ds.Dataset:
        return ds.dataset(folder, filesystem=self.files, format="parquet", exclude_invalid_files=False)

    def ends(self) -> dict[str, int]:
        """The next offset of every partition, by its number; from the files' statistics."""
        found = {}
        selector = fs.FileSelector(self.root, allow_not_found=True)
        for info in self.files.get_file_info(selector):
            if not info.base_name.startswith("partition="):
                continue
            parts = [f.metadata.row_group(g) for f in self._data(info.path).get_fragments() for g in range(f.metadata.num_row_groups)]
            at = [p.column(k).statistics.max for p in parts for k in range(p.num_columns) if p.column(k).path_in_schema == "offset"]
            found[info.base_name.removeprefix("partition=")] = max(at, default=-1) + 1
        return found

    def read(self, span: Span):
        """The messages of a span as Arrow batches; files of other offsets are not opened."""
        offset = pc.field("offset")
        rows = self._data(f"{self.root}/partition={span.partition}")
        for batch in rows.to_batches(columns=_COLUMNS, filter=(offset >= span.low) & (offset < span.high)):
            if batch.num_rows:
                same = [pa.array([self.path] * batch.num_rows), pa.array([span.partition] * batch.num_rows, pa.int32())]
                moments = batch.column("timestamp").cast(pa.timestamp("us", "UTC"))
                columns = [*same, batch.column("offset"), moments, batch.column("key"), batch.column("value")]
                yield pa.RecordBatch.from_arrays(columns, names=["topic", "partition", *_COLUMNS])


def spans(start: dict, end: dict) -> list[Span]:
    """What lies between two sets of offsets."""
    return [Span(int(p), start.get(p, 0), high) for p, high in sorted(end.items()) if high > start.get(p, 0)]


class LogStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.starting = options["path"], options.get("startingoffsets", "latest")

    def initialOffset(self) -> dict:
        return Log(self.path).ends() if self.starting == "latest" else {}

    def latestOffset(self) -> dict:
        return Log(self.path).ends()

    def partitions(self, start: dict, end: dict):
        return spans(start, end)

    def read(self, partition: Span):
        return Log(self.path).read(partition)


class LogTable(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return spans({}, Log(self.path).ends())

    def read(self, partition: Span):
        return Log(self.path).read(partition)


class LogSource(DataSource):
    """``spark.read`` gives the whole log, ``spark.readStream`` what is new."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogTable(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStream(self.options)


def append(df: DataFrame, path: str, partitions: int) -> None:
    """Add messages (``key``, ``value``, ``timestamp``) to a log, ordered by time in each partition.

    Messages of a key stay in one partition, so it is one task that orders it, as in a
    broker. There may be one writer at a time.
    """
    ends = Log(path).ends()
    place = F.pmod(F.xxhash64(F.coalesce("key", "value")), F.lit(partitions)).cast("int")
    starts = F.create_map(*[F.lit(x) for p, end in (ends or {"-1": 0}).items() for x in (int(p), end)])
    order = Window.partitionBy("partition").orderBy("timestamp", "key", "value")
    offset = F.coalesce(F.try_element_at(starts, F.col("partition")), F.lit(0)) + F.row_number().over(order) - 1
    placed = df.select("key", "value", "timestamp").withColumn("partition", place)
    placed.withColumn("offset", offset.cast("long")).write.partitionBy("partition").mode("append").parquet(path)
