"""Byte-level BPE with two tiers: a minimal perfect hash, then a heap over linked bytes.

Most pre-tokens are whole entries of the vocabulary. A minimal perfect hash sends
each of them to its own slot, where one comparison settles whether the pre-token is
that entry. Any other pre-token is a chain of bytes whose neighbours merge in the
order of their ranks, kept in a heap, leftmost first among equal ranks; a merge
touches only its two neighbours, so long pre-tokens take n log n steps.
"""

import base64
import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lagcast.llm.arrays import U64, Spans, Texts, add_columns, mix
from lagcast.llm.pretokens import Memory, encode
from lagcast.llm.tokenizing import TOKENIZER_BYTES, encode_column, id_lists

LOAD = 4  # keys of a bucket of the minimal perfect hash, on average


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, in the order of their ranks, which are its ids."""
    if os.path.getsize(path) > TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {TOKENIZER_BYTES} bytes")
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"{path} leaves out ranks")
    return [token for _, token in ranked]


def hashes_of(pieces: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    return Spans(data).hashes(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


class PerfectHash:
    """A slot of its own for each of n keys, in n slots.

    Keys fall into buckets. The largest buckets come first; each gets the first
    shift that sends its keys to free slots. A bucket of one key names a free slot.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.size, self.buckets = n, max(1, n // LOAD)
        self.shifts = np.zeros(self.buckets, dtype=np.int64)  # below 0: the slot -1 - shift
        hashes = hashes_of(keys)
        bucket = (hashes % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        taken = np.zeros(n, dtype=bool)
        self.entry = np.zeros(n, dtype=np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[bounds[b] : bounds[b + 1]]
            if len(members) < 2:
                break
            slots = self._find_shift(int(b), hashes[members], taken)
            taken[slots] = True
            self.entry[slots] = members
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(sizes == 1):
            slot = next(free)
            self.shifts[b] = -1 - slot
            self.entry[slot] = order[bounds[b]]

    def _find_shift(self, b: int, hashes: np.ndarray, taken: np.ndarray) -> np.ndarray:
        base, step = 0, 64
        while True:
            tries = np.arange(base, base + step, dtype=np.int64)
            slots = self._slots(hashes[None, :], tries[:, None])
            ordered = np.sort(slots, axis=1)
            good = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                k = int(good.argmax())
                self.shifts[b] = tries[k]
                return slots[k]
            base, step = base + step, min(step * 2, 4096)

    def _slots(self, hashes: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        return (mix(hashes + shifts.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) % U64(self.size)).astype(np.int64)

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """The only entry that each key can be."""
        shifts = self.shifts[(hashes % U64(self.buckets)).astype(np.int64)]
        return self.entry[np.where(shifts < 0, -1 - shifts, self._slots(hashes, shifts))]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merging neighbouring pieces, lowest rank first."""
    n, get = len(piece), ranks.get
    after, before, alive = list(range(1, n + 2)), list(range(-1, n)), [True] * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = after[i]
        if not alive[i] or middle >= n or after[middle] != end:
            continue  # one of the two has merged with another neighbour
        alive[middle] = False
        after[i] = end
        if end < n:
            before[end] = i
            beyond = after[end]
            if (rank := get(piece[i:beyond])) is not None:
                heapq.heappush(heap, (rank, i, beyond))
        left = before[i]
        if left >= 0 and (rank := get(piece[left:end])) is not None:
            heapq.heappush(heap, (rank, left, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Vocabulary:
    """A rank vocabulary with its minimal perfect hash; bounded by the vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.table = tokens, PerfectHash(tokens)
        ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.starts, self.sizes = ends[:-1], np.diff(ends)
        self.content = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each pre-token has, and all ids."""
        tokens, ranks, ids, counts = self.tokens, self.ranks, [], []
        for piece, candidate in zip(pieces, self.table.candidates(hashes_of(pieces)).tolist()):
            if tokens[candidate] == piece:
                ids.append(candidate)
                counts.append(1)
            else:
                merged = merge_bytes(piece, ranks)
                ids += merged
                counts.append(len(merged))
        return np.array(counts, np.int32), np.array(ids, np.uint32)

    @property
    def ranks(self) -> dict[bytes, int]:
        if "_ranks" not in self.__dict__:
            self._ranks = {t: k for k, t in enumerate(self.tokens)}
        return self._ranks

    @property
    def memory(self) -> Memory:
        if "_memory" not in self.__dict__:
            self._memory = Memory()
        return self._memory

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        return encode(texts, self, self.memory)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where those of each id end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.content[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)], ends


def encode_bpe(df: DataFrame, vocabulary: Vocabulary, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``ids``, the ids of every whole text; none for a null or empty text.

    An existing column ``ids`` is replaced. One narrow pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.get_field_index(text))
        return {"ids": id_lists(len(column), encode_column(column, shared.value))}

    return add_columns(df, StructType([StructField("ids", ArrayType(IntegerType(), False))]), make, keep=keep)


def decode_bpe(df: DataFrame, vocabulary: Vocabulary, *, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``decoded``, the bytes of each list of ids; a null list has none.

    Ids outside the vocabulary and null ids are an error. An existing column
    ``decoded`` is replaced. One narrow pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.get_field_index(ids)).fill_null([])
        values = column.flatten()
        if values.null_count:
            raise ValueError("null ids cannot be decoded")
        bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
        numbers = values.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(numbers) and not 0 <= numbers.min() <= numbers.max() < len(shared.value.tokens):
            raise ValueError("ids outside the vocabulary")
        out: list[bytes] = []
        low = 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + (1 << 18), "right")) - 1)
            content, ends = shared.value.decode(numbers[bounds[low] : bounds[high]])
            ends = np.concatenate([[0], ends])[bounds[low : high + 1] - bounds[low]].tolist()
            view = content.tobytes()
            out += [view[a:b] for a, b in zip(ends, ends[1:])]
            low = high
        return {"decoded": pa.array(out, pa.binary())}

    return add_columns(df, StructType([StructField("decoded", BinaryType())]), make, keep=keep)
