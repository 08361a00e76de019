"""Quality rules: text statistics and bands of zstandard compression ratios.

The ratio is compressed size over size. A text is judged as a whole, by limits for
its length, and in half-overlapping chunks up to its last byte: text that repeats itself
compresses too well, noise too badly. Short texts compress badly whatever they hold, so
limits depend on the length, and shorter texts have smaller chunks. A text is rejected if
its whole ratio is outside the band, or if chunks outside theirs cover more than
``CHUNK_SHARE`` of its bytes.

Limits can be fitted to a corpus: all its different texts give, for each quarter of an
octave of lengths and for each size of chunks, the median ratio and the spread between
its quartiles, and what lies far outside is rejected. The limits are a list, to be kept
or changed like any parameter.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from lagcast.llm.arrays import SPACE, Spans, Texts, add_columns, groups, mix, per_group, shingles
from lagcast.llm.components import arrow_rows
from lagcast.operators.ordering import preceding_totals
from lagcast.session import settled

BATCH_ROWS = 1000  # texts that a task holds at once
LEVEL = 3
CHUNK = 4096
SMALLER = (1, 4, 16)  # what a chunk is divided by until a text has two
CHUNK_SHARE = 0.25
MIN_WORDS = 50
WINDOW = 3

# Least size in bytes, least and greatest ratio of whole texts at least that long.
BANDS = [
    (0, 0.20, 1.10),
    (256, 0.28, 0.88),
    (1024, 0.28, 0.76),
    (4096, 0.25, 0.66),
    (16384, 0.22, 0.62),
    (65536, 0.20, 0.58),
]

PER_OCTAVE = 4
QUARTILES = (0.25, 0.5, 0.75)
LEAST_ROWS = 40  # a length with fewer texts keeps the limits of BANDS
SPREADS = 4.5  # how far from the median, in standard deviations as the quartiles tell them
LEAST_SPREAD = 0.005

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

ADDED = StructType(
    [
        *(StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        StructField("base_failed", BooleanType()),
        StructField("ratio", DoubleType()),
        StructField("odd_chunks", DoubleType()),
        StructField("kept", BooleanType()),
    ]
)


def text_counts(texts: Texts) -> dict[str, np.ndarray]:
    """Words, their characters, symbols, repeated lines and repeated words of each text."""
    data, offsets, n = texts.data, texts.offsets, len(texts)
    starts, ends, first = texts.words()
    spans = Spans(data)
    characters = ((data & 0xC0) != 0x80) & ~SPACE[data]

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    of_text = np.searchsorted(breaks, offsets) + np.arange(n + 1)  # a text has one line more than breaks
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_text = groups(of_text)[has_word]
    lines = spans.hashes(line_starts[has_word], line_ends[has_word])
    order = np.lexsort((lines, line_text))
    line_text, lines = line_text[order], lines[order]
    again = (line_text[1:] == line_text[:-1]) & (lines[1:] == lines[:-1])

    windows, bounds = shingles(spans.hashes(starts, ends), first, WINDOW)
    window_text = groups(bounds)
    windows = windows + mix(window_text.astype(np.uint64))  # equal only within a text
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    place = np.flatnonzero(twice)
    place += (first[:-1] - bounds[:-1])[window_text[place]]  # the window's first word
    covered = np.zeros(len(starts), dtype=bool)
    for k in range(WINDOW):
        covered[place + k] = True
    return {
        "n_words": np.diff(first),
        "word_chars": texts.counts(characters),
        "n_symbols": texts.counts(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_text[1:][again], minlength=n).astype(np.int64),
        "n_repeat_words": per_group(covered, first),
    }


def band(size: np.ndarray, bands: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest ratio for each size."""
    least, low, high = (np.array(x) for x in zip(*bands))
    k = np.searchsorted(least, size, "right") - 1
    return low[k], high[k]


def chunk_ratios(text: memoryview, compress, chunk: int) -> tuple[int, list[int], list[float]]:
    """The size of a text's chunks, where they start, and their ratios; none for a text shorter than two."""
    for part in SMALLER:
        width = chunk // part
        if width and len(text) >= 2 * width:
            starts = [*range(0, len(text) - width, max(width // 2, 1)), len(text) - width]  # the last ends with the text
            return width, starts, [len(compress(text[at : at + width])) / width for at in starts]
    return 0, [], []


def ratios(texts: Texts, compressor, chunk_bands: list[tuple], chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole ratio of each text, and the share of its bytes in chunks outside their band."""
    whole, odd = np.ones(len(texts)), np.zeros(len(texts))
    compress = compressor.compress
    limits = {w: [x[0] for x in band(np.array([w]), chunk_bands)] for w in (chunk // part for part in SMALLER)}
    for k, size in enumerate(np.diff(texts.offsets).tolist()):
        if size:
            text = texts.bytes_of(k)
            whole[k] = len(compress(text)) / size
            covered = done = 0
            width, starts, found = chunk_ratios(text, compress, chunk)
            for at, ratio in zip(starts, found):
                if not limits[width][0] <= ratio <= limits[width][1]:
                    covered += at + width - max(at, done)
                    done = at + width
            odd[k] = covered / size
    return whole, odd


def failed_base(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def _limits(low: float, middle: float, high: float) -> tuple[float, float]:
    """How small and how great a ratio may be, by median and quartiles."""
    reach = SPREADS * max((high - low) / 1.349, LEAST_SPREAD)
    return middle - reach, middle + reach


def _ratio_counts(docs: DataFrame, text: str, chunk: int, level: int) -> DataFrame:
    """How often each ratio occurs among the different texts that pass the base rules.

    Columns ``width`` (of chunks; 0 for whole texts), ``step`` (of whole texts' lengths, else 0),
    ``ratio`` and ``n``. A row of lengths for each text is shuffled, no text.
    """
    least = BANDS[1][0]
    named = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("rank")).where(F.octet_length("text") >= least)

    def measure(batches):
        compress, seen = zstandard.ZstdCompressor(level=level).compress, set()
        for batch in batches:
            ranks = batch.column(1).to_pylist()
            fresh = [k for k, r in enumerate(ranks) if not (r in seen or seen.add(r))]
            texts = Texts.of(batch.column(0).take(pa.array(fresh, pa.int64())))
            for low, _, block in texts.blocks():
                rows = []
                for k in np.flatnonzero(~failed_base(text_counts(block))).tolist():
                    content = block.bytes_of(k)
                    step = int(np.floor(np.log2(len(content) / least) * PER_OCTAVE))
                    width, _, found = chunk_ratios(content, compress, chunk)
                    rows.append((ranks[fresh[low + k]], step, len(compress(content)) / len(content), width, found))
                columns = list(zip(*rows)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.float64()))
                names = ["rank", "step", "ratio", "width", "found"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    measured = named.mapInArrow(measure, "rank long, step int, ratio double, width int, found array<double>")
    different = measured.dropDuplicates(["rank"])  # copies that other tasks have met
    whole = F.array(F.struct(F.lit(0).alias("width"), "step", "ratio"))
    pieces = F.transform("found", lambda x: F.struct(F.col("width").alias("width"), F.lit(0).alias("step"), x.alias("ratio")))
    return different.select(F.inline(F.concat(whole, pieces))).groupBy("width", "step", "ratio").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(counts: DataFrame) -> dict[tuple[int, int], tuple[int, list[float]]]:
    """For each width and step the number of ratios and their quartiles, interpolated between neighbours.

    Exact: running totals tell which ratios stand at the places asked for, six of a group at most,
    and only those reach the driver.
    """
    placed = preceding_totals(counts, [F.asc("ratio")], {"below": "n"}, within=("width", "step"))
    sizes = counts.groupBy("width", "step").agg(F.sum("n").alias("total"))
    place = (F.col("total") - 1) * F.col("share")
    shares = F.array(*[F.lit(x) for x in QUARTILES])
    asked = sizes.withColumn("share", F.explode(shares)).select(
        "width", "step", "total", "share", F.explode(F.array(F.floor(place), F.ceil(place))).alias("at")
    ).distinct()
    here = (F.col("below") <= F.col("at")) & (F.col("at") < F.col("below") + F.col("n"))
    found: dict[tuple[int, int], tuple[int, dict]] = {}
    for r in placed.join(F.broadcast(asked), ["width", "step"]).where(here).select("width", "step", "total", "at", "ratio").collect():
        found.setdefault((r.width, r.step), (r.total, {}))[1][r.at] = r.ratio
    out = {}
    for key, (total, at) in found.items():
        places = [(total - 1) * x for x in QUARTILES]
        pairs = [(at[int(np.floor(x))], at[int(np.ceil(x))], x - np.floor(x)) for x in places]
        out[key] = total, [float(a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)) for a, b, t in pairs]
    return out


def fit_bands(docs: DataFrame, *, text: str = "text", chunk: int = CHUNK, level: int = LEVEL) -> tuple[list[tuple], list[tuple]]:
    """Bands of whole texts and of chunks, fitted to the texts of ``docs`` that pass the base rules.

    All different texts (copies, as 64-bit hashes tell them, count once) and all their chunks are
    measured; quartiles are exact. Lengths and chunks with fewer than ``LEAST_ROWS`` have the limits
    of ``BANDS``; of an empty table all do.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        counts = settled(_ratio_counts(docs, text, chunk, level))
    found = _quartiles(counts)

    def limits(width: int, step: int, size: int) -> tuple[float, float]:
        total, quartiles = found.get((width, step), (0, []))
        return _limits(*quartiles) if total >= LEAST_ROWS else tuple(float(x[0]) for x in band(np.array([size]), BANDS))

    least = BANDS[1][0]
    steps = max((step for width, step in found if not width), default=-1) + 1
    edges = [int(np.ceil(least * 2 ** (k / PER_OCTAVE))) for k in range(steps + 1)]
    fitted = [BANDS[0], *((edge, *limits(0, k, edge)) for k, edge in enumerate(edges))]
    fitted += [b for b in BANDS if b[0] > edges[-1]]
    return fitted, [(width, *limits(width, 0, width)) for width in sorted(chunk // part for part in SMALLER)]


def compression_bands(
    df: DataFrame,
    *,
    text: str = "text",
    bands: list[tuple] = BANDS,
    chunk_bands: list[tuple] | None = None,
    chunk: int = CHUNK,
    chunk_share: float = CHUNK_SHARE,
    level: int = LEVEL,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with the counts, the ratios and the verdict ``kept`` of every whole text.

    A null text counts as an empty one: no words, ratio 1, rejected for having
    under 50 words. ``bands`` are rows of a least size, the smallest ratio and the
    greatest; ``chunk_bands`` those of chunks, by default the same. Repeated rows get the same verdict each. Columns of the added
    names are replaced. One narrow pass over the texts; no shuffle.
    """

    def judge(batch: pa.RecordBatch) -> dict:
        texts = Texts.of(batch.column(batch.schema.get_field_index(text)))
        compressor = zstandard.ZstdCompressor(level=level)
        parts: list[dict] = []
        for _, _, block in texts.blocks():
            found = text_counts(block)
            found["ratio"], found["odd_chunks"] = ratios(block, compressor, chunk_bands or bands, chunk)
            found["base_failed"] = failed_base(found)
            low, high = band(np.diff(block.offsets), bands)
            inside = (found["ratio"] >= low) & (found["ratio"] <= high)
            found["kept"] = ~found["base_failed"] & inside & (found["odd_chunks"] <= chunk_share)
            parts.append(found)
        return {n: np.concatenate([p[n] for p in parts]) if parts else [] for n in ADDED.names}

    return add_columns(df, ADDED, judge, keep=keep)
