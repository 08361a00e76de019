"""Texts of an Arrow batch as NumPy arrays: words, lines and 64-bit hashes of spans.

A batch's texts stay one run of UTF-8 bytes; words and hashes come from whole-run
array operations, so no Python object is made per word. Hashes of spans are
polynomials over random byte values modulo 2**64, taken from one running sum and
finished by a mixing step: equal spans have equal hashes, and two different spans
collide with a chance of about 2**-64.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Bytes of text handled at once; a longer text is handled alone.
BLOCK = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a new array)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class _Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 1, 2 * len(self.up))
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                powers = np.full(size, U64(base), dtype=U64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Spans:
    """Hashes of any spans of one run of bytes."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        up, self.down = _POWERS.upto(len(data) + 1)
        table = BYTES[LOWER] if lower else BYTES
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        values = table[data]
        values *= up[: len(data)]
        np.cumsum(values, out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


class Texts:
    """One run of bytes and the bounds of its texts; null texts are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, column: pa.Array) -> "Texts":
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_binary())
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)
        return cls(data[offsets[0] : offsets[-1]], offsets - offsets[0])

    def part(self, low: int, high: int) -> "Texts":
        a, b = self.offsets[low], self.offsets[high]
        return Texts(self.data[a:b], self.offsets[low : high + 1] - a)

    def blocks(self, size: int = BLOCK) -> Iterator[tuple[int, int, "Texts"]]:
        """Runs of whole texts of at most ``size`` bytes, or one longer text."""
        low, n = 0, len(self)
        while low < n:
            high = int(np.searchsorted(self.offsets, self.offsets[low] + size, "right")) - 1
            high = min(n, max(high, low + 1))
            yield low, high, self.part(low, high)
            low = high

    def bytes_of(self, k: int) -> memoryview:
        return memoryview(self.data[self.offsets[k] : self.offsets[k + 1]])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the index of each text's first word."""
        data, offsets = self.data, self.offsets
        inside = ~SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offsets[1:][offsets[1:] > 0] - 1
        last[edges] = inside[edges]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        return per_group(flags, self.offsets)


def per_group(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between neighbouring bounds."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def groups(bounds: np.ndarray) -> np.ndarray:
    """The group number of every item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` items in each group, and the groups' bounds in them."""
    n = np.diff(bounds)
    made = np.maximum(n - width + 1, 0)
    total = len(hashes) - width + 1
    if total <= 0:
        return np.zeros(0, dtype=U64), np.zeros(len(bounds), dtype=np.int64)
    joined = hashes[:total].copy()
    for k in range(1, width):
        joined *= U64(0xFF51AFD7ED558CCD)
        joined += hashes[k : k + total]
    new = np.concatenate([[0], np.cumsum(made)])
    positions = np.arange(new[-1]) + np.repeat(bounds[:-1] - new[:-1], made)
    return mix(joined[positions]), new


def add_columns(df: DataFrame, added: StructType, make: Callable, *, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the columns that ``make`` computes from each Arrow batch.

    ``make`` takes a record batch and returns arrays by name. Columns of ``df``
    that have the name of an added column, in any case, are replaced. ``keep``
    names the columns to carry on; all of them by default.
    """
    fresh = {name.lower() for name in added.names}
    kept = [f for f in df.schema.fields if f.name.lower() not in fresh and (keep is None or f.name in keep)]
    names, types = [f.name for f in kept], added

    def run(batches):
        for batch in batches:
            new = make(batch)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns += [pa.array(new[f.name], type=_arrow(f)) if not isinstance(new[f.name], pa.Array) else new[f.name] for f in types]
            yield pa.RecordBatch.from_arrays(columns, names=names + types.names)

    return df.mapInArrow(run, StructType(kept + added.fields))


def _arrow(field) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)
