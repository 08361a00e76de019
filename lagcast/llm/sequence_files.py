"""Token ids as Arrow files of equal-length sequences.

Documents are sorted by key, and by text where keys are equal, into ranges; each range
becomes one file in the Arrow file format. Its batches hold fixed-size lists: ``ids`` of ``LENGTH`` ids and ``mask``,
false where a file's last sequence is padded, so any sequence is read without a copy
at a position that follows from its number. ``keys`` and ``starts`` say which documents
begin in a sequence, and where. Ids take 16 bits if the vocabulary allows it.

A task writes under a name of its own; the list of the files that count is a table
written when all are done. A repeated task leaves only an unlisted file.
"""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.llm.arrays import Texts
from lagcast.llm.tokenizing import with_end, worker_encoder

LENGTH = 2048
BATCH = 256  # sequences of a record batch

LISTED = "part long, file string, documents long, sequences long, tokens long"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


def file_schema(length: int, id_type: pa.DataType, key_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            pa.field("ids", pa.list_(id_type, length)),
            pa.field("mask", pa.list_(pa.bool_(), length)),
            pa.field("keys", pa.list_(key_type)),
            pa.field("starts", pa.list_(pa.int32())),
        ]
    )


class SequenceWriter:
    """One file; ids come in runs of whole documents and leave as full batches."""

    def __init__(self, folder: str, name: str, schema: pa.Schema):
        system, path = file_system(folder)
        self.schema, self.length = schema, schema.field("ids").type.list_size
        self.sink = system.open_output_stream(f"{path}/{name}")
        self.writer = pa.ipc.new_file(self.sink, schema)
        self.ids: list[np.ndarray] = []
        self.keys: list[pa.Array] = []
        self.begins: list[np.ndarray] = []
        self.held = self.tokens = self.documents = self.sequences = 0

    def add(self, keys: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.ids.append(ids)
        self.keys.append(keys)
        self.begins.append(bounds[:-1] + self.held)
        self.held += len(ids)
        self.tokens += len(ids)
        self.documents += len(keys)
        if self.held >= self.length * BATCH:
            self._write(self.held // self.length)

    def _write(self, n: int) -> None:
        """Writes ``n`` sequences; what is left begins the next batch."""
        ids, begins = np.concatenate(self.ids), np.concatenate(self.begins)
        keys = pa.chunked_array(self.keys).combine_chunks()
        size = n * self.length
        row = begins // self.length
        gone = int(np.searchsorted(row, n))
        padded = np.zeros(size, dtype=self.schema.field("ids").type.value_type.to_pandas_dtype())
        used = min(size, len(ids))
        padded[:used] = ids[:used]
        mask = np.arange(size) < used
        of_row = pa.array(np.searchsorted(row[:gone], np.arange(n + 1)).astype(np.int32))
        for low in range(0, n, BATCH):
            high = min(n, low + BATCH)
            part = slice(low * self.length, high * self.length)
            bounds = of_row[low : high + 1]
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(padded[part]), type=self.schema.field("ids").type),
                pa.FixedSizeListArray.from_arrays(pa.array(mask[part]), type=self.schema.field("mask").type),
                pa.ListArray.from_arrays(bounds, keys, type=self.schema.field("keys").type),
                pa.ListArray.from_arrays(
                    bounds, pa.array((begins % self.length).astype(np.int32)), type=self.schema.field("starts").type
                ),
            ]
            self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.sequences += n
        self.ids, self.keys, self.begins = [ids[used:]], [keys[gone:]], [begins[gone:] - size]
        self.held -= used

    def close(self) -> None:
        if self.held:
            self._write(-(-self.held // self.length))
        self.writer.close()
        self.sink.close()


def write_sequences(
    df: DataFrame,
    tokenizer: str,
    folder: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    length: int = LENGTH,
    small_ids: bool = True,
) -> DataFrame:
    """Writes all documents in ascending order of their keys; returns the table of the files.

    Every document is its token ids and the end id; a null or empty text is the end id
    alone. Null keys come first; documents with equal keys, and repeated rows, are
    ordered by a hash of their text. The table has a row per file: its part number,
    path, documents, sequences and tokens; it is stored in the folder too. ``small_ids``
    says that all ids are below 65,536; a larger one is an error then.
    One shuffle sorts the texts; their ids are made behind it and never shuffled. The
    texts of one key may lie in several ranges, so a key of many rows is several tasks.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer)
    id_type = pa.uint16() if small_ids else pa.uint32()
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)

    def write(batches):
        from pyspark import TaskContext

        encoder, part = worker_encoder(shared.value), TaskContext.get().partitionId()
        name, writer = f"{part:08d}-{uuid.uuid4().hex}.arrow", None
        for batch in batches:
            keys = batch.column(0)
            if writer is None and len(keys):
                writer = SequenceWriter(folder, name, file_schema(length, id_type, keys.type))
            for low, high, block in Texts.of(batch.column(1)).blocks():
                ids, bounds = with_end(*encoder.encode(block), end_id)
                if small_ids and len(ids) and ids.max() >= 1 << 16:
                    raise ValueError("an id does not fit into 16 bits")
                writer.add(keys[low:high], ids, bounds)
        if writer is not None:
            writer.close()
            row = [part, name, writer.documents, writer.sequences, writer.tokens]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, kinds)], names=["part", "file", "documents", "sequences", "tokens"]
            )

    chosen = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = chosen.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(write, LISTED).write.parquet(f"{folder}/listed")
    return spark.read.parquet(f"{folder}/listed").select("part", F.concat(F.lit(f"{folder}/"), "file").alias("file"), "documents", "sequences", "tokens")


def open_sequences(path: str) -> pa.ipc.RecordBatchFileReader:
    """A file's batches, mapped rather than read where the file system allows it."""
    system, inner = file_system(path)
    if isinstance(system, pafs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(inner))
    return pa.ipc.open_file(system.open_input_file(inner))


def documents_in(reader: pa.ipc.RecordBatchFileReader):
    """Each document of a file in order: its key and its ids."""
    key, held = None, None
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        lists, mask = batch.column(0), batch.column(1)
        length = lists.type.list_size
        ids = lists.flatten().to_numpy()
        used = mask.flatten().true_count
        rows, keys = batch.column(3), batch.column(2).flatten().to_pylist()
        row = np.repeat(np.arange(len(batch)), rows.value_lengths().to_numpy())
        begins = row * length + rows.flatten().to_numpy()
        if held is not None:
            held.append(ids[: begins[0] if len(begins) else used])
        for i, begin in enumerate(begins):
            if held is not None:
                yield key, np.concatenate(held)
            key, held = keys[i], [ids[begin : begins[i + 1] if i + 1 < len(begins) else used]]
    if held is not None:
        yield key, np.concatenate(held)


def read_documents(spark: SparkSession, files: DataFrame, key_type: str = "long") -> DataFrame:
    """The documents of written files: key, start, n_tokens, ids.

    ``files`` is what ``write_sequences`` returned. ``start`` counts the ids of all
    documents before, over all files. ``ids`` holds little-endian unsigned 32-bit ids.
    A task per file; only the files' totals pass through the driver.
    """
    totals = files.orderBy("part").collect()  # a row per written file
    starts, done = [], 0
    for r in totals:
        starts.append((r.file, done))
        done += r.tokens
    schema = f"key {key_type}, start long, n_tokens long, ids binary"
    if not starts:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(starts, "file string, base long").repartition(len(starts), "file")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                size = 0
                for key, ids in documents_in(open_sequences(path)):
                    rows.append((key, base, len(ids), ids.astype("<u4").tobytes()))
                    base += len(ids)
                    size += len(ids)
                    if size > 1 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow_key = to_arrow_type(_parse_datatype_string(schema)[0].dataType)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [arrow_key, pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["key", "start", "n_tokens", "ids"]
        )

    return listed.mapInArrow(read, schema)
