"""Boosted trees where a category has many values.

MLlib looks up the values of a category, sorted by their mean, by place in a linked list:
its work for a node grows with the square of the values (0.5 s at 15,000, and each round
has 31 nodes). Here each level of a tree is one pass that sums rows per node, feature and
bin, and each feature of a node is searched by running sums. Bins, order of categories,
gains, leaves and weights of rounds are MLlib's, so are the trees up to rounding. What a task
holds does not grow with the rows, and the driver keeps a bit for each value a node may name.
"""

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.session import scratch_path, settled

BLOCK_ROWS = 100_000  # that lie and are worked on together
SORTED_BLOCKS = 5  # that are put in order at a time: what a partition has at most
SOURCE = "x binary, label binary, weight binary"
BLOCK = "bins binary, label binary, weight binary, margin binary"
COUNTS = "feature int, value double, n long, weight double"
STORED_VALUES = 1 << 20  # values of categories that nodes of a model name in one batch of its writing
SPARSE = 8  # cells for each row from which only those that occur are counted
NARROW = 4_096  # bins of a feature up to which a task adds its blocks up
CHUNK = 1 << 16  # bins of a feature that are added up together where tasks have many cells in common
EPSILON = np.finfo(float).eps  # impurity below which a node is pure
HISTOGRAM = "slot int, feature int, chunk int, bins binary, cells binary"
# A row is megabytes long: Parquet is to look at each, not at every hundredth, whether a page or a group of rows is full.
LONG_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
BATCH_BYTES = "16m"  # of such rows that are sent to Python together
FOUND = "slot int, feature int, gain double, bins binary, left array<double>, right array<double>"


@dataclass
class Node:
    """Rows, weight, sum and sum of squares of the targets, and a split if it has one."""

    stats: list[float]
    gain: float = -1.0
    feature: int = -1
    left_bins: np.ndarray | None = None

    @property
    def prediction(self) -> float:
        return self.stats[2] / self.stats[1]

    @property
    def impurity(self) -> float:
        _, w, s, q = self.stats
        return (q - s * s / w) / w


def bits(left: np.ndarray, values: int) -> np.ndarray:
    """A bit for each value, 1 for those in ``left``."""
    goes = np.zeros(values, dtype=bool)
    goes[left.astype(np.int64)] = True
    return np.packbits(goes)


def among(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bits of values are set."""
    return (table[values >> 3] >> (7 - (values & 7)) & 1).astype(bool)


@dataclass
class Tree:
    """A grown tree: its weight, and its nodes by number."""

    weight: float
    prediction: np.ndarray
    impurity: np.ndarray
    stats: np.ndarray  # weight, sum and sum of squares of the targets
    count: np.ndarray
    gain: np.ndarray
    children: np.ndarray  # left and right, -1 at a leaf
    feature: np.ndarray
    threshold: np.ndarray
    values: np.ndarray  # of a category, -1 at other nodes
    left: dict[int, np.ndarray]  # of nodes that split a category, bits: the values that go left; the last for unseen ones

    @classmethod
    def of(cls, weight: float, nodes: list[dict]) -> "Tree":
        nodes = sorted(nodes, key=lambda n: n["id"])
        columns = {c: np.array([n[c] for n in nodes]) for c in ("prediction", "impurity", "stats", "count", "gain", "feature", "threshold", "values")}
        left = {n["id"]: np.frombuffer(n["bits"], dtype=np.uint8) for n in nodes if n["bits"] is not None}
        return cls(weight, children=np.array([(n["one"], n["other"]) for n in nodes]), left=left, **columns)

    def nodes(self) -> Iterator[dict]:
        """The nodes in the form in which MLlib stores them."""
        for k, (one, other) in enumerate(self.children.tolist()):
            values = int(self.values[k])
            named = np.flatnonzero(np.unpackbits(self.left[k], count=values)).astype(float) if k in self.left else [self.threshold[k]] if one >= 0 else []
            yield {
                "id": k, "prediction": self.prediction[k], "impurity": self.impurity[k], "impurityStats": self.stats[k], "rawCount": self.count[k],
                "gain": self.gain[k], "leftChild": one, "rightChild": other,
                "split": {"featureIndex": self.feature[k], "leftCategoriesOrThreshold": named, "numCategories": values},
            }

    def add(self, x: np.ndarray, margin: np.ndarray) -> None:
        """Adds the weighted predictions for rows (columns of ``x``) to their margins."""
        ahead = [(0, np.arange(len(margin)))]
        while ahead:
            node, rows = ahead.pop()
            if self.children[node, 0] < 0:
                margin[rows] += self.weight * self.prediction[node]
            elif len(rows):
                value = x[self.feature[node]][rows]
                left = among(self.left[node], value.astype(np.int64)) if node in self.left else value <= self.threshold[node]
                ahead += [(self.children[node, 0], rows[left]), (self.children[node, 1], rows[~left])]


def left_bits(left: np.ndarray, values: int) -> bytes:
    """The bits of a node's values; the last is for unseen ones, which go where values are not named.

    MLlib names the side with fewer values.
    """
    return bits(np.append(left, values) if len(left) > values // 2 else left, values + 1).tobytes()


@dataclass
class Walk:
    """The splits of a tree by heap place, as tasks look them up: feature, and a bit for each bin, 1 to go left."""

    splits: dict[int, tuple[int, np.ndarray]]

    @classmethod
    def of(cls, tree: dict[int, Node], sizes: list[int]) -> "Walk":
        inner = {place: node for place, node in tree.items() if node.feature >= 0}
        return cls({p: (n.feature, bits(n.left_bins, sizes[n.feature])) for p, n in inner.items()})

    def reached(self, bins: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """The heap places that rows end at, each with its rows; ``bins`` has an array for each feature."""
        ahead = [(0, np.arange(len(bins[0])))]
        while ahead:
            place, rows = ahead.pop()
            if place not in self.splits:
                yield place, rows
                continue
            feature, table = self.splits[place]
            left = among(table, bins[feature][rows])
            ahead += [(2 * place + 1, rows[left]), (2 * place + 2, rows[~left])]


def fits(estimator) -> bool:
    """Whether an estimator asks for nothing but what is done here."""
    return (
        isinstance(estimator, GBTClassifier)
        and estimator.getSubsamplingRate() == 1.0
        and estimator.getFeatureSubsetStrategy() == "all"
        and estimator.getLossType() == "logistic"
        and not estimator.isSet("validationIndicatorCol")
        and not estimator.isSet("thresholds")
    )


def _gathered(batches, rows: int, size) -> Iterator[list]:
    """Batches together that have ``rows`` rows or a few more; ``size`` tells how many one has."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += size(batch)
        if n >= rows:
            yield held
            held, n = [], 0
    if n:
        yield held


def _packed(blocks, names: tuple[str, ...] = ("bins", "label", "weight", "margin")):
    """Batches of one block of rows each, its arrays as bytes."""
    for block in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block], names=list(names))


def _arrays(batches, *kinds: tuple[str, type]) -> Iterator[list[np.ndarray]]:
    """The arrays of each row of batches, without a copy."""
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c, _ in kinds)):
            yield [np.frombuffer(x.as_buffer(), dtype=kind) for x, (_, kind) in zip(row, kinds)]


def _source(df: DataFrame, weighted: bool) -> DataFrame:
    """Rows in blocks of bytes: features one after the other, labels, and weights if there are any."""

    def pack(batches):
        for held in _gathered(batches, BLOCK_ROWS, lambda batch: batch.num_rows):
            table = pa.Table.from_batches(held).combine_chunks()
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["x"].chunks]).reshape(table.num_rows, -1)
            weight = table["weight"].to_numpy().astype(float) if weighted else np.zeros(0)
            label = (table["label"].to_numpy() * 2 - 1).astype(np.int8)
            yield from _packed([(np.ascontiguousarray(x.T).tobytes(), label.tobytes(), weight.tobytes())], ("x", "label", "weight"))

    return df.mapInArrow(pack, SOURCE)


def _source_blocks(batches):
    for x, label, weight in _arrays(batches, ("x", float), ("label", np.int8), ("weight", float)):
        yield x.reshape(-1, len(label)), label, weight


def _counts(source: DataFrame, features: list[int]) -> DataFrame:
    """Rows and weight of each value of some features."""

    def count(batches):
        for x, label, weight in _source_blocks(batches):
            for feature in features:
                values, at, n = np.unique(x[feature], return_inverse=True, return_counts=True)
                w = np.bincount(at, weight) if len(weight) else n.astype(float)
                columns = [np.full(len(values), feature, np.int32), values, n, w]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "value", "n", "weight"])

    counted = source.mapInArrow(count, COUNTS)
    return counted.groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def _thresholds(counts: DataFrame, continuous: list[int], bins: int) -> dict[int, np.ndarray]:
    """Where each continuous feature is cut: between its values, or by equal weights if these are too many."""

    def cut(key, table):
        order = np.argsort(table["value"].to_numpy())
        value, weight = table["value"].to_numpy()[order], table["weight"].to_numpy()[order]
        between = (value[1:] + value[:-1]) / 2
        if len(between) >= bins:
            total = np.cumsum(weight)
            stride = total[-1] / bins
            middle, chosen, target = ((total[1:] + total[:-1]) / 2).tolist(), [], stride
            for k, at in enumerate(middle):
                if at > target:
                    chosen.append(k)
                    target += stride
            between = between[chosen[: bins - 1]]
        return pa.table({"feature": [key[0].as_py()], "cuts": [between]}, schema=pa.schema([("feature", pa.int32()), ("cuts", pa.list_(pa.float64()))]))

    wanted = counts.where(F.col("feature").isin(continuous))
    rows = wanted.groupBy("feature").applyInArrow(cut, "feature int, cuts array<double>").collect()
    return {r.feature: np.array(r.cuts) for r in rows}


def _kinds(sizes: list[int]) -> list[np.dtype]:
    """The narrowest numbers that hold the bins of each feature."""
    return [np.min_scalar_type(size - 1) for size in sizes]


def _blocks(batches, sizes: list[int]):
    """The blocks of rows of a task: bins (an array for each feature), labels, weights (or none) and margins."""
    kinds = _kinds(sizes)
    for bins, label, weight, margin in _arrays(batches, ("bins", np.uint8), ("label", np.int8), ("weight", float), ("margin", float)):
        ends = np.cumsum([len(label) * kind.itemsize for kind in kinds])[:-1]
        yield [b.view(kind) for b, kind in zip(np.split(bins, ends), kinds)], label, weight, margin


def _bytes(bins: list[np.ndarray], *others: np.ndarray) -> tuple[bytes, ...]:
    return b"".join(b.tobytes() for b in bins), *(x.tobytes() for x in others)


def _targets(label: np.ndarray, margin: np.ndarray, first: bool) -> np.ndarray:
    """What a round fits: the label (-1 or 1), later the falling direction of the logistic loss."""
    return label.astype(float) if first else 4.0 * label / (1.0 + np.exp(2.0 * label * margin))


def _clustered(source: DataFrame, cuts: dict[int, np.ndarray], sizes: list[int], widest: int, before: np.ndarray, parts: int) -> DataFrame:
    """Blocks of rows with their bins and a margin of 0, the values of the widest feature side by side.

    So tasks have few cells in common. ``before`` counts the rows before each value of the widest
    feature, and all of them at its end; partitions are equal parts of that, so a value of many rows
    spreads over several. Blocks are dealt out in pieces, as bytes, and put in order where they arrive.
    """
    kinds, per = _kinds(sizes), max(before[-1] / parts, 1.0)

    def deal(batches):
        for x, label, weight in _source_blocks(batches):
            bins = [(np.searchsorted(cuts[k], v) if k in cuts else v).astype(kind) for k, (v, kind) in enumerate(zip(x, kinds))]
            order = np.argsort(bins[widest], kind="stable")
            value = bins[widest][order].astype(np.int64)
            first = np.searchsorted(value, value)
            share = (np.arange(len(value)) - first + 0.5) / (np.searchsorted(value, value, side="right") - first)
            part = np.minimum((before[value] + share * (before[value + 1] - before[value])) / per, parts - 1).astype(np.int64)
            edges = np.searchsorted(part, np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(edges)):
                rows = order[edges[k] : edges[k + 1]]
                of_rows = [x[rows] if len(x) else x for x in (label, weight)]
                piece = _bytes([b[rows] for b in bins], *of_rows, np.zeros(len(rows)))
                columns = [pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in piece)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "bins", "label", "weight", "margin"])

    def sort(batches):
        for held in _gathered(_blocks(batches, sizes), SORTED_BLOCKS * BLOCK_ROWS, lambda block: len(block[1])):
            bins = [np.concatenate(b) for b in zip(*(block[0] for block in held))]
            others = [np.concatenate(x) for x in zip(*(block[1:] for block in held))]
            order = np.argsort(bins[widest], kind="stable")
            for start in range(0, len(order), BLOCK_ROWS):
                rows = order[start : start + BLOCK_ROWS]
                yield from _packed([_bytes([b[rows] for b in bins], *(x[rows] if len(x) else x for x in others))])

    dealt = source.mapInArrow(deal, f"part int, {BLOCK}").repartitionById(parts, F.col("part"))
    return dealt.drop("part").mapInArrow(sort, BLOCK)


def _cells(bins: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins that occur, and for each its rows and the totals of ``sums``."""
    low = int(bins.min())
    if int(bins.max()) - low <= SPARSE * len(bins):
        at = bins - low if low else bins
        n = np.bincount(at)
        some = np.flatnonzero(n)
        return some + low, np.stack([n[some].astype(float), *(np.bincount(at, x)[some] for x in sums)])
    names, at, n = np.unique(bins, return_inverse=True, return_counts=True)
    return names, np.stack([n.astype(float), *(np.bincount(at, x) for x in sums)])


def _added(bins: list[np.ndarray], cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of several tasks as one, in the order of bins."""
    names, at = np.unique(np.concatenate(bins), return_inverse=True)
    return names, np.stack([np.bincount(at, x) for x in np.concatenate(cells, axis=1)])


_HISTOGRAM = pa.schema([("slot", pa.int32()), ("feature", pa.int32()), ("chunk", pa.int32()), ("bins", pa.binary()), ("cells", pa.binary())])


def _rows_of_cells(found) -> pa.Table:
    """Slots, features, chunks, bins and their cells (rows, weights, sums of targets and of squares) as a table."""
    rows = [(slot, feature, chunk, bins.astype(np.int32).tobytes(), cells.tobytes()) for slot, feature, chunk, bins, cells in found]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _HISTOGRAM.types)], schema=_HISTOGRAM) if rows else _HISTOGRAM.empty_table()


def _unpacked(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The slot, feature, bins and cells of each row."""
    for slot, feature, (bins, cells) in zip(table["slot"].to_pylist(), table["feature"].to_pylist(), _arrays(table.to_batches(), ("bins", np.int32), ("cells", float))):
        yield slot, feature, bins, cells.reshape(4, -1)


def _together(found) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Each slot's bins and cells of each feature, added up."""
    groups: dict[tuple[int, int], list] = {}
    for slot, feature, bins, cells in found:
        groups.setdefault((slot, feature), []).append((bins, cells))
    for (slot, feature), several in sorted(groups.items()):
        yield slot, feature, *_added(*map(list, zip(*several)))


def _histogram(rows: DataFrame, walk: Walk, active: list[int], sizes: list[int], first: bool, widest: int) -> DataFrame:
    """Rows, weights and sums of targets per active node, feature and bin, bins and their cells as bytes.

    A task adds up the cells of narrow features; of others a block sends those it has. Where tasks may
    share many of these, as of a wide feature by which rows do not lie, they are added up in chunks of bins.
    """
    slots = {place: slot for slot, place in enumerate(active)}
    shared = [f for f, size in enumerate(sizes) if size > CHUNK and f != widest]

    def chunked(slot, feature, bins, cells):
        if feature not in shared:
            return [(slot, feature, 0, bins, cells)]
        chunks = np.unique(bins // CHUNK)
        edges = np.searchsorted(bins, [*(chunks * CHUNK), bins[-1] + 1])
        return [(slot, feature, int(c), bins[i:j], cells[:, i:j]) for c, i, j in zip(chunks, edges[:-1], edges[1:])]

    def count(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for bins, label, weight, margin in _blocks(batches, sizes):
            target, found = _targets(label, margin, first), []
            for place, here in walk.reached(bins):
                if place not in slots or not len(here):
                    continue
                slot, t = slots[place], target[here]
                w = weight[here] if len(weight) else None
                parts = [t, t * t] if w is None else [w, w * t, w * t * t]
                for feature, size in enumerate(sizes):
                    at = bins[feature][here].astype(np.int64)
                    if size > NARROW:
                        names, cells = _cells(at, *parts)
                        found += chunked(slot, feature, names, cells if w is not None else cells[[0, 0, 1, 2]])
                        continue
                    total = sums.setdefault((slot, feature), np.zeros((4, size)))
                    n = np.bincount(at, minlength=size)
                    total[0] += n
                    total[1] += n if w is None else np.bincount(at, w, size)
                    total[2] += np.bincount(at, parts[-2], size)
                    total[3] += np.bincount(at, parts[-1], size)
            if found:
                yield from _rows_of_cells(found).to_batches()
        some = {key: np.flatnonzero(total[0]) for key, total in sums.items()}
        yield from _rows_of_cells((*key, 0, at, sums[key][:, at]) for key, at in some.items()).to_batches()

    def merge(table):
        return _rows_of_cells((slot, feature, 0, bins, cells) for slot, feature, bins, cells in _together(_unpacked(table)))

    counted = rows.mapInArrow(count, HISTOGRAM)
    return counted.groupBy("feature", "chunk").applyInArrow(merge, HISTOGRAM) if shared else counted


def _variance(w: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (q - s * s / w) / w


def _best_splits(histogram: DataFrame, categories: set[int], least: tuple[int, float, float]) -> DataFrame:
    """The best split of each node that has one, of equally good ones that by the first feature."""
    least_rows, least_weight, least_gain = least
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    schema = pa.schema(list(zip(("slot", "feature", "gain", "bins", "left", "right"), kinds)))

    def by(feature, bins, stats):
        order = np.lexsort((bins, stats[2] / stats[1])) if feature in categories else np.argsort(bins)
        bins, stats = bins[order], stats[:, order]
        total = stats.sum(axis=1)
        left = np.cumsum(stats, axis=1)[:, :-1]
        right = total[:, None] - left
        allowed = (left[0] >= least_rows) & (right[0] >= least_rows) & (left[1] >= least_weight) & (right[1] >= least_weight)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = (left[1] * _variance(*left[1:]) + right[1] * _variance(*right[1:])) / total[1]
        gain = np.where(allowed, _variance(*total[1:]) - spread, -np.inf)
        if not len(gain) or not gain.max() >= least_gain:
            return None
        k = int(np.argmax(gain))
        chosen = bins[: k + 1] if feature in categories else bins[k : k + 1]
        return feature, float(gain[k]), chosen.astype(np.int32).tobytes(), left[:, k].tolist(), right[:, k].tolist()

    def best(table):
        splits = [split for _, *cells in _together(_unpacked(table)) if (split := by(*cells))]
        if not splits:
            return schema.empty_table()
        row = (table["slot"][0].as_py(), *min(splits, key=lambda split: (-split[1], split[0])))
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds)], schema=schema)

    return histogram.groupBy("slot").applyInArrow(best, FOUND)


def _grow(rows: DataFrame, sizes: list[int], categories: set[int], depth: int, least: tuple, first: bool, widest: int) -> dict[int, Node]:
    """One tree, a pass for each level; nodes by heap place."""
    tree: dict[int, Node] = {}
    active = [0]
    for _ in range(depth):
        histogram = _histogram(rows, Walk.of(tree, sizes), active, sizes, first, widest)
        following = []
        for best in sorted(_best_splits(histogram, categories, least).collect(), key=lambda r: r.slot):
            if best.gain <= 0:
                continue
            place = active[best.slot]
            node = tree.setdefault(place, Node([a + b for a, b in zip(best.left, best.right)]))
            bins = np.frombuffer(best.bins, dtype=np.int32)
            node.gain, node.feature = best.gain, best.feature
            node.left_bins = bins if best.feature in categories else np.arange(bins[0] + 1)
            for child, stats in ((2 * place + 1, best.left), (2 * place + 2, best.right)):
                tree[child] = Node(list(stats))
                if abs(tree[child].impurity) >= EPSILON:
                    following.append(child)
        active = following
        if not active:
            break
    if not tree:
        tree[0] = Node(_sums(rows, sizes, first))
    return tree


def _sums(rows: DataFrame, sizes: list[int], first: bool) -> list[float]:
    """Rows, weight and sums of targets of all rows."""

    def add(batches):
        for _, label, weight, margin in _blocks(batches, sizes):
            t, w = _targets(label, margin, first), weight if len(weight) else np.ones(len(label))
            yield pa.RecordBatch.from_pydict({"n": [float(len(t))], "w": [w.sum()], "s": [(w * t).sum()], "q": [(w * t * t).sum()]})

    return list(rows.mapInArrow(add, "n double, w double, s double, q double").agg(*[F.sum(c) for c in "nwsq"]).first())


def _moved(rows: DataFrame, tree: dict[int, Node], weight: float, sizes: list[int]) -> DataFrame:
    """``rows`` with a tree's predictions added to the margins."""
    walk, values = Walk.of(tree, sizes), {place: weight * node.prediction for place, node in tree.items()}

    def add(batches):
        for bins, label, w, margin in _blocks(batches, sizes):
            moved = margin.copy()
            for place, here in walk.reached(bins):
                moved[here] += values[place]
            yield from _packed([_bytes(bins, label, w, moved)])

    return rows.mapInArrow(add, BLOCK)


def _written(rows: DataFrame, old: str | None = None) -> tuple[DataFrame, str]:
    """Rows on shared storage, in place of the ones of the round before."""
    spark = rows.sparkSession
    path = scratch_path(spark, "boosted")
    rows.write.options(**LONG_ROWS).parquet(path)
    if old is not None:
        gone = spark._jvm.org.apache.hadoop.fs.Path(old)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return spark.read.schema(rows.schema).parquet(path), path


def _preorder(tree: dict[int, Node], cuts: dict[int, np.ndarray], sizes: list[int], weight: float) -> Tree:
    """Nodes in the order of MLlib's; two leaves that say the same become one."""

    def same(place: int) -> float | None:
        node = tree[place]
        if node.feature < 0:
            return node.prediction
        one, other = same(2 * place + 1), same(2 * place + 2)
        return one if one is not None and one == other else None

    out: list[dict] = []

    def visit(place: int) -> int:
        node, said = tree[place], same(place)
        row = {
            "id": len(out), "prediction": node.prediction if said is None else said, "impurity": max(node.impurity, 0.0), "stats": node.stats[1:],
            "count": int(node.stats[0]), "gain": -1.0, "one": -1, "other": -1, "feature": -1, "threshold": 0.0, "values": -1, "bits": None,
        }
        out.append(row)
        if said is None:
            at = node.feature
            split = {"threshold": float(cuts[at][len(node.left_bins) - 1])} if at in cuts else {"values": sizes[at], "bits": left_bits(node.left_bins, sizes[at])}
            row |= {"gain": node.gain, "feature": at, **split}
            row["one"] = visit(2 * place + 1)
            row["other"] = visit(2 * place + 2)
        return row["id"]

    visit(0)
    return Tree.of(weight, out)


SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
NODE = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
    ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", SPLIT),
])


def _runs(trees: Iterable[list[dict]]) -> Iterator[list[tuple[int, dict]]]:
    """The nodes of lists with the lists' numbers, so many whole lists at a time as name ``STORED_VALUES`` or one."""
    run, values = [], 0
    for k, nodes in enumerate(trees):
        more = sum(len(n["split"]["leftCategoriesOrThreshold"]) for n in nodes)
        if run and values + more > STORED_VALUES:
            yield run
            run, values = [], 0
        run += [(k, n) for n in nodes]
        values += more
    yield run


def stored_nodes(tree: Tree) -> Iterator[pa.StructArray]:
    """A tree as MLlib stores it, a few nodes at a time: wide categories make long lists."""
    for run in _runs([node] for node in tree.nodes()):
        yield pa.array([node for _, node in run], NODE)


@contextmanager
def _small_batches(spark: SparkSession):
    """Batches of long rows stay small: Spark's bound is 64 MB for each task, and twice that while a batch grows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def boost(df: DataFrame, estimator: GBTClassifier, categories: dict[int, int]) -> tuple[list[Tree], int]:
    """The trees of ``estimator`` for the assembled ``df``, and how many features these have.

    ``categories`` has the values of each indexed feature.

    Rows with their bins and margins lie in blocks on shared storage and are rewritten each round, so a
    lost executor undoes nothing. The driver gets the best split of each node and feature.
    """
    with _small_batches(df.sparkSession):
        return _boost(df, estimator, categories)


def _boost(df: DataFrame, estimator: GBTClassifier, categories: dict[int, int]) -> tuple[list[Tree], int]:
    spark = df.sparkSession
    weighted = estimator.isDefined("weightCol")
    weight = F.col(estimator.getWeightCol()).cast("double") if weighted else F.lit(1.0)
    chosen = df.select(vector_to_array("features").alias("x"), F.col(estimator.getLabelCol()).alias("label"), weight.alias("weight"))
    source, read = _written(_source(chosen, weighted))
    width = chosen.select(F.size("x")).first()[0]
    widest = max(categories, key=categories.get)
    continuous = [k for k in range(width) if k not in categories]
    counts = settled(_counts(source, [*continuous, widest]))
    of_widest = counts.where(F.col("feature") == widest).select("value", "n", "weight").toArrow()
    before = np.zeros(categories[widest] + 1, dtype=np.int64)
    before[of_widest["value"].to_numpy().astype(np.int64) + 1] = of_widest["n"].to_numpy()
    before = np.cumsum(before)
    cuts = _thresholds(counts, continuous, min(estimator.getMaxBins(), int(before[-1])))
    sizes = [categories.get(k) or len(cuts[k]) + 1 for k in range(width)]
    depth, total = estimator.getMaxDepth(), float(np.sum(of_widest["weight"].to_numpy()))
    least = (estimator.getMinInstancesPerNode(), estimator.getMinWeightFractionPerNode() * total, estimator.getMinInfoGain())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(before[-1]) // (SORTED_BLOCKS * BLOCK_ROWS)))
    rows, path = _written(_clustered(source, cuts, sizes, widest, before, parts), read)
    trees = []
    for k in range(estimator.getMaxIter()):
        tree, weight = _grow(rows, sizes, set(categories), depth, least, first=not k, widest=widest), estimator.getStepSize() if k else 1.0
        trees.append(_preorder(tree, cuts, sizes, weight))
        rows, path = _written(_moved(rows, tree, weight, sizes), path)
    return trees, width
