"""Byte-level pre-tokens of a block of texts, and a memory of their token ids.

Pre-tokens follow the split pattern of byte-level BPE vocabularies: contractions,
runs of letters, digits or other characters with one leading space, and runs of
white space. They come from array operations over character classes. A worker keeps
the ids of the pre-tokens it has seen in a bounded open-addressing table, so an
encoder sees each pre-token once, not once per occurrence.
"""

from collections.abc import Callable

import numpy as np
import regex

from lagcast.llm.arrays import U64, Spans, Texts

LETTER, DIGIT, OTHER, BLANK, WHITE = range(5)

# What may follow an apostrophe to make a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_PATTERNS = ((WHITE, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}"))


def _class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for plane in range(17):
        points = [p for p in range(plane << 16, (plane + 1) << 16) if not 0xD800 <= p < 0xE000]
        text = "".join(map(chr, points))
        for kind, pattern in _PATTERNS:
            for m in regex.finditer(pattern + "+", text):
                table[points[m.start()] : points[m.end() - 1] + 1] = kind
    table[0x20] = BLANK
    return table


_TABLE: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_class_table())
    return _TABLE[0]


def split(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of all pre-tokens (one more than pre-tokens), and the index of each text's first one."""
    data, table = texts.data, classes()
    lead = (data & 0xC0) != 0x80
    if lead.all():
        at, kind = None, table[data]
        begins = texts.offsets
    else:
        at = np.flatnonzero(lead)
        points = data[at].astype(np.uint32)
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        for size, mask, low in ((2, 0x1F, 0xC0), (3, 0x0F, 0xE0), (4, 0x07, 0xF0)):
            some = np.flatnonzero((data[at] >= low) & (data[at] < (0xE0, 0xF0, 0x100)[size - 2]))
            if len(some):
                value = points[some] & mask
                for k in range(1, size):
                    value = value << 6 | padded[at[some] + k] & 0x3F
                points[some] = value
        kind = table[points]
        begins = np.searchsorted(at, texts.offsets)
    n = len(kind)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(texts.offsets), np.int64)
    white = kind >= BLANK
    blank = kind == BLANK
    group = np.where(white, WHITE, kind)
    edge = np.zeros(n + 1, dtype=bool)  # first characters of texts, and the end
    edge[begins] = True
    changes = np.ones(n + 1, dtype=bool)  # first characters of runs, and the end
    changes[1:n] = group[1:] != group[:-1]
    changes |= edge
    start = changes.copy()
    after = np.flatnonzero(changes[1:n] & ~edge[1:n] & white[:-1] & ~white[1:]) + 1  # what follows white space
    start[after - 1] = True  # the last white character is cut off its run
    start[after[blank[after - 1]]] = False  # and a space belongs to what follows

    quote = np.flatnonzero((data if at is None else data[at]) == 39)
    if len(quote):
        quote = quote[start[quote]]
        chars = data if at is None else np.where(data[at] < 128, data[at], 0)
        padded = np.concatenate([chars, np.zeros(3, np.uint8)])
        ends = np.concatenate([edge, np.ones(3, bool)])
        inside = ~ends[quote + 1]
        for tail in CONTRACTIONS:
            fits = inside & (padded[quote + 1] == ord(tail[0]))
            if len(tail) == 2:
                fits &= ~ends[quote + 2] & (padded[quote + 2] == ord(tail[1]))
            found = quote[fits]
            start[found + 1] = False
            start[found + 1 + len(tail)] = True
    bounds = np.flatnonzero(start)
    first = np.searchsorted(bounds, begins)
    if at is not None:
        bounds = np.append(at, len(data))[bounds]
    return bounds, first


class Memory:
    """Ids of pre-tokens by their hash; forgets everything when it is full."""

    def __init__(self, bits: int = 21):
        self.shift, self.size = U64(64 - bits), 1 << bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.size, dtype=U64)
        self.heads = np.zeros(self.size, dtype=U64)
        self.starts = np.zeros(self.size, dtype=np.int64)
        self.counts = np.zeros(self.size, dtype=np.int32)
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = self.held = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slots = (keys >> self.shift).astype(np.int64)
        seen = self.keys[slots]
        open_ = np.flatnonzero(seen != keys)
        while len(open_):
            missing = self.keys[slots[open_]] == 0
            slots[open_[missing]] = -1
            open_ = open_[~missing]
            slots[open_] = (slots[open_] + 1) & (self.size - 1)
            open_ = open_[self.keys[slots[open_]] != keys[open_]]
        return slots

    def add(self, keys: np.ndarray, heads: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Takes in different keys, none of which it has."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.held += len(keys)
        slots, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] == 0]
            self.keys[slots[free]] = keys[free]
            placed = free[self.keys[slots[free]] == keys[free]]
            at = slots[placed]
            self.heads[at], self.starts[at], self.counts[at] = heads[placed], starts[placed], counts[placed]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & (self.size - 1)


Encoder = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def encode(texts: Texts, encoder: Encoder, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one run, and the bounds of each text in it.

    ``encoder`` takes pre-tokens and returns how many ids each has, and all ids.
    Hashes of 64 bits find a pre-token's slot; its first eight bytes and its length
    are compared as well.
    """
    bounds, first = split(texts)
    starts, ends = bounds[:-1], bounds[1:]
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    keys = Spans(texts.data).hashes(starts, ends) | U64(1)  # never 0, which marks a free slot
    size = ends - starts
    words = np.ndarray(len(texts.data), "<u8", np.concatenate([texts.data, np.zeros(8, np.uint8)]), strides=(1,))
    heads = words[starts] & ~U64(0) >> (U64(8) * (U64(8) - np.minimum(size, 8).astype(U64)))
    heads ^= size.astype(U64) << U64(56)
    slots = memory.find(keys)
    missed = np.flatnonzero(slots < 0)
    if len(missed):
        new, where = np.unique(keys[missed], return_index=True)
        where = missed[where]
        if memory.held + len(new) > memory.size // 2:
            memory.clear()
            missed = np.arange(len(keys))
            new, where = np.unique(keys, return_index=True)
        view = texts.data.tobytes()
        counts, ids = encoder([view[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())])
        if len(new) > memory.size // 2:
            return _apart(new, keys, heads, heads[where], counts, ids, first, lambda: (texts, starts, ends, encoder))
        memory.add(new, heads[where], counts, ids)
        slots[missed] = memory.find(keys[missed])
    if (memory.heads[slots] != heads).any():
        return _one_by_one(texts, starts, ends, first, encoder)
    return _gather(memory.starts[slots], memory.counts[slots], memory.pool, first)


def _gather(starts: np.ndarray, counts: np.ndarray, pool: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` one after the other, and each text's bounds."""
    stops = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=stops[1:])
    ids = pool[np.repeat(starts - stops[:-1], counts) + np.arange(stops[-1])]
    return ids, stops[first]


def _apart(new, keys, heads, new_heads, counts, ids, first, rest):
    """A block with more kinds of pre-tokens than the memory holds (one very long text)."""
    kind = np.searchsorted(new, keys)
    if (new_heads[kind] != heads).any():
        texts, starts, ends, encoder = rest()
        return _one_by_one(texts, starts, ends, first, encoder)
    return _gather((np.cumsum(counts) - counts)[kind], counts[kind], ids, first)


def _one_by_one(texts: Texts, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, encoder: Encoder):
    """Without hashes, for a block in which two pre-tokens share one."""
    view = texts.data.tobytes()
    counts, ids = encoder([view[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
    return _gather(np.cumsum(counts) - counts, counts, ids, first)
