"""Packing into sequences by minimum bin slack.

Documents are cut into pieces of the sequence length and a rest. The number of
rests of each length is all that packing needs: a histogram with one row per length,
however many documents there are. For the longest rest left, subset sums over the
remaining lengths are kept as one bitset; the reachable sum closest to the free
space is traced back to counts of lengths. If more than ``TOLERANCE`` ids stay free, as
when one length is far more frequent than its partners, one more rest is cut to fill
them. That combination serves as many sequences as its counts allow, so there are about
as many combinations as lengths. Every piece then finds its place from its rank among
the pieces of its length.
"""

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lagcast.llm.components import stored
from lagcast.llm.tokenizing import encode_column, worker_encoder

CAPACITY = 2048
GROUP_ROWS = 1000  # pieces of one length that are ranked in one sort, or the root of their number
BATCH_ROWS = 1000  # texts that a task holds at once
BROADCAST_ROWS = 100_000  # keys and hashes of documents that are sent to all tasks
TOLERANCE = 16  # ids of a sequence that may stay free before a piece is cut


class Place(NamedTuple):
    """Where the pieces of one length with ranks from ``rank`` on go.

    If ``cut`` is above 0, only so many ids of each go there; what is left of a piece is
    one of its new length, with a rank counted from ``rest`` on.
    """

    length: int
    rank: int
    repeats: int
    sequence: int
    offset: int
    cut: int
    rest: int


def closest_fill(counts: dict[int, int], lengths: list[int], space: int) -> dict[int, int]:
    """Counts of lengths whose sum comes closest to ``space`` without passing it.

    Lengths are taken in the given order, each no more often than it is there, as
    powers of two of its count; the search ends when ``space`` itself is reached.
    """
    if space <= 0:
        return {}
    reach, mask, steps = 1, (1 << space + 1) - 1, []
    for length in lengths:
        if length > space:
            continue
        left, size = min(counts[length], space // length), 1
        while left > 0:
            taken = min(size, left)
            steps.append((length, taken, reach))
            reach |= reach << length * taken & mask
            left, size = left - taken, size * 2
        if reach >> space & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, taken, without in reversed(steps):
        if not without >> best & 1:
            chosen[length] = chosen.get(length, 0) + taken
            best -= length * taken
    return chosen


def minimum_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Place]:
    """Places for all pieces counted in ``histogram``."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    made, used = Counter(counts), Counter()
    places, sequence = [], 0
    while counts:
        lengths = sorted(counts, reverse=True)
        longest = lengths[0]
        counts[longest] -= 1
        chosen = Counter(closest_fill(counts, lengths, capacity - longest))
        counts[longest] += 1
        chosen[longest] += 1
        free = capacity - sum(k * m for k, m in chosen.items())
        cuts = [k for k in lengths if k > free and counts[k] > chosen[k]] if free > TOLERANCE else []
        needed = chosen + Counter(cuts[:1])
        repeats = min(counts[k] // m for k, m in needed.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            places.append(Place(length, used[length], repeats, sequence, offset, 0, 0))
            offset += length * chosen[length]
            used[length] += repeats * chosen[length]
        if cuts:
            rest = cuts[0] - free
            places.append(Place(cuts[0], used[cuts[0]], repeats, sequence, offset, free, made[rest]))
            used[cuts[0]] += repeats
            made[rest] += repeats
            counts[rest] = counts.get(rest, 0) + repeats
        for length, m in needed.items():
            counts[length] -= repeats * m
        counts = {k: v for k, v in counts.items() if v}
        sequence += repeats
    return places


def cut_documents(
    df: DataFrame, tokenizer: str, *, text: str = "text", end_id: int = 1, capacity: int = CAPACITY, keep: list[str] | None = None
) -> DataFrame:
    """Pieces of the token ids of every whole text: start, length, doc_tokens, ids.

    ``ids`` holds little-endian unsigned 32-bit ids. A document's ids, with the end
    id, are cut into pieces of ``capacity`` and a rest; a null or empty text is one
    piece of the end id. Columns of the same names are replaced. One narrow pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    added = StructType(
        [*(StructField(n, LongType()) for n in ("start", "length", "doc_tokens")), StructField("ids", BinaryType())]
    )
    fresh = {n.lower() for n in added.names}
    kept = [f for f in df.schema.fields if f.name.lower() not in fresh and (keep is None or f.name in keep)]

    def cut(batches):
        encoder = worker_encoder(shared.value)
        for batch in batches:
            for low, ids, bounds in encode_column(batch.column(batch.schema.get_field_index(text)), encoder, end_id):
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, sizes[row] - start)
                ends = 4 * np.concatenate([[0], np.cumsum(length)])
                content = pa.Array.from_buffers(
                    pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]
                )
                rows = pa.array(row + low)
                columns = [batch.column(batch.schema.get_field_index(f.name)).take(rows) for f in kept]
                columns += [pa.array(x.astype(np.int64)) for x in (start, length, sizes[row])]
                yield pa.RecordBatch.from_arrays([*columns, content], names=[f.name for f in kept] + added.names)

    return df.mapInArrow(cut, StructType(kept + added.fields))


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, order: list[str]) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, by minimum bin slack.

    Pieces have a ``start`` and a ``length``, which must lie between 1 and ``capacity``; a
    null length is an error. A piece that is cut comes back as several, with their own
    starts and lengths; its other columns are repeated. ``order`` names the columns that
    tell pieces apart; rows equal in them, repeated ones too, get places of their own.
    Existing columns of the added names are replaced.

    The pieces are settled on shared storage, since they are counted and then placed.
    Only the histogram comes to the driver, ``capacity`` rows at most. Ranks are taken in
    groups of the pieces of one length, as many groups as it is frequent, so a length that
    a third of all pieces have is no burden for one task.
    """
    taken = {"sequence_id", "offset"}
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in taken])
    mark = "__"
    while any(c.lower().startswith(mark) for c in pieces.columns):
        mark += "_"
    group, count, base, row_, rank_ = (mark + n for n in ("group", "n", "base", "row", "rank"))
    held = stored(pieces, "pieces", BATCH_ROWS)
    histogram = {r[0]: r[1] for r in held.groupBy("length").count().collect()}
    if None in histogram:
        raise ValueError("a piece has no length")
    places = sorted(minimum_slack(histogram, capacity))
    groups = [1] * (capacity + 1)
    for length, n in histogram.items():
        groups[length] = max(1, n // max(GROUP_ROWS, math.isqrt(n)))
    of_length = F.element_at(F.lit(np.array(groups, dtype=np.int32)), F.col("length").cast("int") + 1)
    salted = held.withColumn(group, F.pmod(F.xxhash64(*order), of_length).cast("int"))
    within = Window.partitionBy("length", group)
    sizes = salted.groupBy("length", group).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy("length").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", group, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    ranked = (
        salted.withColumn(row_, F.row_number().over(within.orderBy(*order)))
        .join(starts, ["length", group])
        .select(*held.columns, (F.col(base) + F.col(row_) - 1).alias(rank_))
    )
    table = np.array(places, dtype=np.int64).reshape(-1, len(Place._fields))
    shared = held.sparkSession.sparkContext.broadcast(table)
    names = held.columns

    def place(batches):
        for batch in batches:
            start, length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("start", "length", rank_))
            row, new = _placed(shared.value, start, length, rank)
            columns = {n: batch.column(batch.schema.get_field_index(n)).take(pa.array(row)) for n in names}
            columns |= {n: pa.array(x) for n, x in new.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    added = [StructField(n, LongType()) for n in ("sequence_id", "offset")]
    kinds = {"start": LongType(), "length": LongType()}
    schema = StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in held.schema.fields] + added)
    return ranked.mapInArrow(place, schema)


def _placed(table: np.ndarray, start: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, dict]:
    """The row that each resulting piece comes from, and its start, length and place."""
    row, parts = np.arange(len(start)), []
    while len(row):
        _, first, repeats, sequence, offset, cut, rest = table[_find(table, length, rank)].T
        copy, turn = np.divmod(rank - first, repeats)
        here = np.where(cut > 0, cut, length)
        parts.append((row, start, here, sequence + turn, offset + copy * length))
        more = cut > 0
        row, start, length = row[more], (start + cut)[more], (length - cut)[more]
        rank = (rest + turn)[more]
    row, *new = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
    return row, dict(zip(("start", "length", "sequence_id", "offset"), new))


def pack_documents(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces in packed sequences, with a checksum of the ids of each.

    Returns the key, start, length, ids_crc32 (of little-endian unsigned 32-bit ids),
    doc_tokens, sequence_id and offset. Ids are not shuffled: checksums are made with the
    pieces, and again for the few documents of which packing cuts a piece. A document is
    known by its key and a hash of its text.
    """
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    pieces = cut_documents(chosen, tokenizer, end_id=end_id, capacity=capacity, keep=["key", "mark"])
    summed = pieces.select("key", "mark", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"))
    summed = summed.withColumn("whole", F.col("length"))
    packed = stored(pack(summed, capacity=capacity, order=["key", "mark", "start"]), "packed")
    cut = packed.where(F.col("length") < F.col("whole"))
    rest = packed.where(F.col("length") == F.col("whole")).drop("mark", "whole").withColumnRenamed("key", key)
    marks = stored(cut.select("key", "mark").distinct(), "cut")
    n = marks.count()
    if n == 0:
        return rest
    few = F.broadcast(marks) if n <= BROADCAST_ROWS else marks
    known = F.col("docs.key").eqNullSafe(F.col("cut.key")) & (F.col("docs.mark") == F.col("cut.mark"))
    again = chosen.alias("docs").join(few.alias("cut"), known, "left_semi").dropDuplicates(["key", "mark"])
    again = cut_documents(again, tokenizer, end_id=end_id, capacity=capacity, keep=["key", "mark"])
    again = again.select("key", "mark", F.col("start").alias("from"), "ids")
    from_ = F.floor(F.col("start") / capacity) * capacity
    same = F.col("cut.key").eqNullSafe(F.col("again.key")) & (F.col("cut.mark") == F.col("again.mark"))
    part = F.substring(F.col("ids"), (4 * (F.col("start") - F.col("from")) + 1).cast("int"), (4 * F.col("length")).cast("int"))
    mended = (
        cut.withColumn("at", from_).alias("cut").join(again.alias("again"), same & (F.col("at") == F.col("from")))
        .select("cut.key", "start", "length", F.crc32(part).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    )
    return rest.unionByName(mended.withColumnRenamed("key", key))


def _find(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of each piece: the last one of its length that does not begin beyond its rank."""
    known = np.unique(table[:, 0])
    span = int(max(table[:, 1].max(), rank.max(initial=0))) + 1
    keys = np.searchsorted(known, table[:, 0]) * span + table[:, 1]
    return np.searchsorted(keys, np.searchsorted(known, length) * span + rank, "right") - 1


def sequences(packed: DataFrame, *, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, used.

    Each is made in one group of at most ``capacity`` ids. Sequences are padded to
    ``capacity``, unless the ids used are a power of two in number.
    """
    part = F.struct("offset", "ids")
    joined = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.sum("length").alias("used")
    )
    content = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    short = F.when(F.col("used").bitwiseAND(F.col("used") - 1) == 0, 0).otherwise(capacity - F.col("used"))
    padding = F.lit(pad_id.to_bytes(4, "little"))
    padded = F.aggregate(F.sequence(F.lit(1), short.cast("int")), content, lambda a, _: F.concat(a, padding))
    return joined.select("sequence_id", F.when(short > 0, padded).otherwise(content).alias("ids"), "used")
