"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

A document is the set of its distinct word shingles. SuperMinHash draws for each
element one random permutation of the signature's slots, step by step, and one random
number per step; a slot keeps the least step plus number that reaches it. Slots of one
signature never compete for the same rank, which lowers the variance, and steps end as
soon as every slot holds a value no later step can beat. Bands of slots give candidates.

Documents with equal sets are one node from then on. In each bucket of a band the node
that shares most buckets with others is the pivot, and every other node is compared
with it on full sets. What a pivot misses is found afterwards: candidates that hang
together but lie in several components are compared in blocks across components, so
every pair of a bucket is either compared or known to be in one component.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagcast.llm.arrays import U64, Spans, Texts, groups, mix, per_group, shingles
from lagcast.llm.components import Forest, components, passing_tables, stored

WIDTH = 5
PERCENT = 80
MISS = 1e-6  # greatest chance that no band of two documents at the threshold agrees
MAX_BANDS = 28
BLOCK_ROWS = 256  # nodes of a block in comparisons across components
BLOCK_HASHES = 1 << 19  # about as many hashes in a block
BATCH_ROWS, PAIR_ROWS = 1000, 200  # rows with a text, or with two sets, that a task holds at once
SALTS = 16  # parts in which the members of a cluster meet their cluster's blocks
COLUMNS = 1 << 12  # shared hashes of two blocks that are counted at once


def banding(percent: int, miss: float = MISS) -> tuple[int, int]:
    """Bands and slots per band: the longest bands that still miss little enough."""
    for rows in range(8, 0, -1):
        alike = (percent / 100) ** rows
        bands = math.ceil(math.log(miss) / math.log1p(-alike)) if alike < 1 else 1
        if bands <= MAX_BANDS or rows == 1:
            return bands, rows
    raise AssertionError


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in one run, and each text's bounds.

    A text of fewer words than ``width`` has one shingle, all its words.
    """
    starts, ends, first = texts.words()
    words = Spans(texts.data, lower=True).hashes(starts, ends)
    windows, bounds = shingles(words, first, width)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = n[short].astype(U64)
        for k in range(width - 1):
            more = n[short] > k
            whole[more] = mix(whole[more] * U64(0xC2B2AE3D27D4EB4F) + words[first[short[more]] + k])
        windows = np.insert(windows, bounds[short], whole)
        bounds = bounds + np.concatenate([[0], np.cumsum((n > 0) & (n < width))])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        windows[a:b].sort()
    fresh = np.ones(len(windows), dtype=bool)
    fresh[1:] = windows[1:] != windows[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(windows)]] = True
    sums = np.concatenate([[0], np.cumsum(fresh)])
    return windows[fresh], sums[bounds]


def super_minhash(hashes: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """Signatures of the sets, one row each; rows of empty sets are all ones."""
    n = len(bounds) - 1
    signature = np.full((n, slots), ~U64(0))
    flat = signature.reshape(-1)
    owner, element = groups(bounds), hashes
    order = None
    for step in range(slots):
        draw = mix(element + U64((2 * step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = step + ((draw & U64(0xFFFFFFFF)) * U64(slots - step) >> U64(32)).astype(np.int64)
        rows = np.arange(len(element))
        if order is None:
            slot = pick
        else:
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, step]
            order[:, step] = slot
        np.minimum.at(flat, owner * slots + slot, draw >> U64(32) | U64(step) << U64(40))
        full = signature.max(axis=1) < U64(step + 1) << U64(40)
        going = ~full[owner]
        if not going.any():
            break
        owner, element = owner[going], element[going]
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(element), 1))
            order[np.arange(len(element)), slot[going]] = 0
            order[:, 0] = slot[going]
        else:
            order = order[going]
    return signature


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of each signature; hashes of different bands differ."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0xA0761D6478BD642F), parts.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * U64(0xC2B2AE3D27D4EB4F) + parts[:, :, k])
    return out.view(np.int64)


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """128 bits that stand for each set; null for empty sets."""
    n = len(bounds) - 1
    out = np.zeros((n, 2), dtype=U64)
    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        sums = np.zeros(len(hashes) + 1, dtype=U64)
        np.cumsum(mix(hashes ^ U64(salt)), out=sums[1:])
        out[:, k] = mix(sums[bounds[1:]] - sums[bounds[:-1]] + U64(salt))
    empty = np.diff(bounds) == 0
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
    return pa.compute.if_else(pa.array(empty), pa.scalar(None, pa.binary()), flat)


def _signed(width: int, bands: int, rows: int):
    """Key, digest, set size, node and bands of every document."""

    def run(batches):
        for batch in batches:
            for low, high, block in Texts.of(batch.column(1)).blocks():
                hashes, bounds = shingle_sets(block, width)
                some = np.diff(bounds) > 0
                hashed = band_hashes(super_minhash(hashes, bounds, bands * rows), bands, rows)[some]
                ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[low:high],
                        batch.column(2)[low:high],
                        pa.array(np.diff(bounds).astype(np.int64)),
                        fingerprints(hashes, bounds),
                        pa.ListArray.from_arrays(
                            pa.array(ends), pa.array(hashed.reshape(-1)), type=pa.list_(pa.field("element", pa.int64(), nullable=False))
                        ),
                    ],
                    names=["key", "digest", "n_shingles", "node", "bands"],
                )

    return run


def _sets(width: int):
    """The set of each document that stands for its node: node, hashes."""

    def run(batches):
        for batch in batches:
            wanted = batch.column(1)
            for low, high, block in Texts.of(batch.column(0)).blocks():
                hashes, bounds = shingle_sets(block, width)
                nodes = fingerprints(hashes, bounds)
                ends = (8 * bounds).astype(np.int32)
                content = pa.Array.from_buffers(
                    pa.binary(), len(nodes), [None, pa.py_buffer(ends), pa.py_buffer(hashes.astype("<u8"))]
                )
                same = pa.compute.fill_null(pa.compute.equal(nodes, wanted[low:high]), False)
                yield pa.RecordBatch.from_arrays([nodes.filter(same), content.filter(same)], names=["node", "hashes"])

    return run


def _views(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u8") for x in column]


def _linked(percent: int):
    """Pairs of nodes whose sets are alike enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(_views(batch.column(2)), _views(batch.column(3))):
                least, most = sorted((len(a), len(b)))
                if 100 * least < percent * most:
                    keep.append(False)
                    continue
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], names=["a", "b"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one block with all of another."""
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    found = np.zeros((len(left), len(right)), dtype=np.int64)
    for low in range(0, len(shared), COLUMNS):
        here = (place[column] >= low) & (place[column] < low + COLUMNS)
        matrix = np.zeros((len(left) + len(right), min(len(shared) - low, COLUMNS)), dtype=np.float32)
        matrix[owner[here], place[column[here]] - low] = 1
        found += np.rint(matrix[: len(left)] @ matrix[len(left) :].T).astype(np.int64)
    return found


def _across(percent: int):
    """Links between different components from two blocks of one cluster, as few as join them."""

    def run(frame):
        import pandas as pd

        first, second = (frame[frame["side"] == k] for k in (0, 1))
        left, right = ([np.frombuffer(x, "<u8") for x in f["hashes"]] for f in (first, second))
        out: list[tuple] = []
        if left and right:
            both = overlaps(left, right)
            union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - both
            labels = {x: k for k, x in enumerate(dict.fromkeys([*first["label"], *second["label"]]))}
            forest = Forest(len(labels))
            a, b = first[["node", "label"]].values.tolist(), second[["node", "label"]].values.tolist()
            for i, j in np.argwhere(100 * both >= percent * union):
                if forest.join(labels[a[i][1]], labels[b[j][1]]):
                    out.append((a[i][0], b[j][0]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def near_duplicates(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, digest: str | None = None
) -> DataFrame:
    """``doc_id``-like key, ``n_shingles``, ``component_id`` and ``kept`` of every document.

    Words are runs of non-space bytes, A-Z lower-cased; a shingle is ``width`` words.
    Two documents are linked if ``100 * intersection >= percent * union`` of their sets.
    ``component_id`` is the smallest key that links lead to, ``kept`` whether it is the
    own key. Null, empty and all-space texts have no shingle and no link: they are
    kept. A row with a null key is kept too, with a null ``component_id`` unless it is
    linked to a document with one. Rows with equal keys are judged each by its own text, so
    repeated rows stay or go together; ``digest`` names a column to add with the xxhash64 of
    the text, which tells them apart. Only ``key`` and ``text`` are read.
    """
    bands, rows = banding(percent)
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    read = docs.withColumn("digest", F.xxhash64("text"))
    kind = docs.schema["key"].dataType.simpleString()
    schema = f"key {kind}, digest long, n_shingles long, node binary, bands array<bigint>"
    signed = stored(read.mapInArrow(_signed(width, bands, rows), schema), "signatures", BATCH_ROWS, lasting=True)
    with passing_tables(df.sparkSession):
        found = _groups(read, signed, width, percent)
    out = signed.select("key", "digest", "n_shingles", "node").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    more = [F.col("digest").alias(digest)] if digest else []
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), *more).withColumn(
        "kept", F.coalesce(F.col(key) == F.col("component_id"), F.col(key).isNull())
    )


def _groups(read: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """A row ``node, component_id`` for every node of the signed documents, whose texts ``read`` has."""
    nodes = signed.where(F.col("node").isNotNull()).groupBy("node")
    row = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "digest"))  # one that holds the node's text
    nodes = nodes.agg(F.min("key").alias("least"), row.alias("row"), F.first("bands").alias("bands"))
    nodes = stored(nodes, "nodes")

    banded = nodes.select("node", F.explode("bands").alias("band"))
    crowds = banded.groupBy("band").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > 1)
    crowded = stored(banded.join(crowds, "band"), "crowded")
    popular = crowded.groupBy("node").agg(F.sum("crowd").alias("popularity"))
    rated = crowded.join(popular, "node")
    pivots = rated.groupBy("band").agg(F.max_by("node", F.struct("popularity", "node")).alias("pivot"))
    pairs = crowded.join(pivots, "band").where(F.col("node") != F.col("pivot"))
    pairs = stored(pairs.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")

    chosen = nodes.join(popular.select("node"), "node", "left_semi")
    chosen = chosen.select(F.col("row.key").alias("of"), F.col("row.digest").alias("holds"), "node")
    same = F.col("key").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("holds"))
    wanted = read.join(chosen.hint("shuffle_hash"), same).select("text", "node")
    sets = wanted.mapInArrow(_sets(width), "node binary, hashes binary")
    sets = stored(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets", BATCH_ROWS)

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    links = stored(joined.mapInArrow(_linked(percent), "a binary, b binary"), "links", PAIR_ROWS)
    labels = components(links)
    more = _links_across(pairs, labels, sets, percent)
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))

    least = nodes.select("node", "least").join(labels, "node", "left")
    least = least.select("node", "least", F.coalesce("label", "node").alias("label"))
    smallest = least.groupBy("label").agg(F.min("least").alias("component_id"))
    return stored(least.join(smallest, "label").select("node", "component_id"), "found", lasting=True)


def _links_across(pairs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of one cluster of candidates that no pivot showed.

    All nodes of a cluster but those of its largest component are compared with all its
    nodes of other components, in blocks whose size is bounded in nodes and in hashes.
    """
    clusters = components(pairs).select("node", F.col("label").alias("cluster"))
    sized = sets.select("node", (F.length("hashes") / 8).alias("size"))
    placed = clusters.join(labels, "node", "left").join(sized, "node")
    placed = stored(placed.select("node", "cluster", F.coalesce("label", "node").alias("label"), "size"), "clusters")
    parts = placed.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    whole = parts.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("components"),
        F.sum("n").alias("n"),
        F.sum("size").alias("size"),
        F.max_by("label", F.struct("n", "label")).alias("largest"),
        F.max("n").alias("most"),
        F.max_by("size", F.struct("n", "label")).alias("most_size"),
    )
    # Clusters of two nodes have been compared already.
    open_ = whole.where((F.col("components") > 1) & (F.col("n") > 2))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_HASHES), F.lit(1)).cast("int")
    open_ = open_.select(
        "cluster",
        "largest",
        blocks(F.col("n") - F.col("most"), F.col("size") - F.col("most_size")).alias("few"),
        blocks(F.col("n"), F.col("size")).alias("many"),
    )
    spot = F.xxhash64("node")
    salted = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = placed.select("node", "cluster", "label", F.pmod(F.xxhash64("label", "node"), F.lit(SALTS)).cast("int").alias("salt"))
    members = members.join(salted, ["cluster", "salt"]).drop("salt")
    one = members.where(F.col("label") != F.col("largest")).select(
        "node", "cluster", "label", F.lit(0).alias("side"),
        F.pmod(spot, "few").alias("x"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("y"),
    )
    all_ = members.select(
        "node", "cluster", "label", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("x"), F.pmod(spot, "many").alias("y"),
    )
    dealt = one.withColumn("x", F.col("x").cast("int")).unionByName(all_.withColumn("y", F.col("y").cast("int")))
    filled = dealt.join(sets, "node")
    found = filled.groupBy("cluster", "x", "y").applyInPandas(_across(percent), "a binary, b binary")
    return stored(found, "links")
