"""Token ids of whole texts by a tokenizer file of the tokenizers library.

The driver reads the file and sends it to the tasks; its size is bounded by its
vocabulary. A worker encodes each pre-token it meets once (see ``pretokens``): the
split pattern keeps pre-tokens apart, so the ids of a text are those of its
pre-tokens one after the other.
"""

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lagcast.llm.arrays import Texts, add_columns
from lagcast.llm.pretokens import Memory, encode

TOKENIZER_BYTES = 64 << 20


def read_tokenizer(path: str) -> str:
    """The text of a tokenizer file, whose size is checked before it is sent to tasks."""
    if os.path.getsize(path) > TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {TOKENIZER_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        return file.read()


class FileEncoder:
    """Ids of pre-tokens from the tokenizers library.

    Texts that hold one of the file's added tokens are encoded whole by the library, which
    cuts them there first.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.memory = Memory()
        added = [t["content"].encode() for t in json.loads(content).get("added_tokens") or [] if t["content"]]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        ids = [e.ids for e in found]
        counts = np.fromiter(map(len, ids), np.int32, len(ids))
        return counts, np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        found = [m.span() for m in self.added.finditer(texts.data.tobytes())] if self.added else []
        if not found:
            return encode(texts, self, self.memory)
        at = np.array(found) - [0, 1]  # first and last byte; what spans two texts sends both to the library
        ids, sizes, low = [], [np.zeros(1, np.int64)], 0
        for k in [*np.unique(np.searchsorted(texts.offsets, at, "right") - 1).tolist(), len(texts)]:
            if low < k:
                part, bounds = encode(texts.part(low, k), self, self.memory)
                ids.append(part)
                sizes.append(np.diff(bounds))
            if k < len(texts):
                own = self.tokenizer.encode(bytes(texts.bytes_of(k)).decode(), add_special_tokens=False).ids
                ids.append(np.array(own, np.uint32))
                sizes.append(np.array([len(own)]))
            low = k + 1
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))


_ENCODERS: dict[int, FileEncoder] = {}


def worker_encoder(content: str) -> FileEncoder:
    """This worker's encoder; it lives on over tasks."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = FileEncoder(content)
    return _ENCODERS[key]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id behind each text."""
    if end_id is None:
        return ids, bounds
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, dtype=ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return out, bounds + np.arange(n + 1)


def encode_column(column: pa.Array, encoder, end_id: int | None = None):
    """Ids and bounds of a column's texts, block by block: first row, ids, bounds."""
    for low, _, block in Texts.of(column).blocks():
        yield low, *with_end(*encoder.encode(block), end_id)


def tokenize(df: DataFrame, tokenizer: str, *, text: str = "text", end_id: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``ids``, the token ids of every whole text (null: empty).

    An existing column ``ids`` is replaced. One narrow pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def make(batch: pa.RecordBatch) -> dict:
        encoder = worker_encoder(shared.value)
        column = batch.column(batch.schema.get_field_index(text))
        return {"ids": id_lists(len(column), encode_column(column, encoder, end_id))}

    return add_columns(df, StructType([StructField("ids", ArrayType(IntegerType(), False))]), make, keep=keep)


def id_lists(rows: int, blocks) -> pa.Array:
    """One list of ids for each text of a batch."""
    values, bounds, done = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
    for _, ids, ends in blocks:
        values.append(ids.astype(np.int32))
        bounds.append(ends[1:] + done)
        done += len(ids)
    field = pa.field("element", pa.int32(), nullable=False)
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate(bounds).astype(np.int32)), pa.array(np.concatenate(values)), type=pa.list_(field)
    )
