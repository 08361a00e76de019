"""Connected components by union-find in tasks.

Each task joins its edges, as they come, in a union-find forest and gives one row per
node: its root. Only nodes are held, and a forest that holds many is given out and a new
one begun. A node of several forests has several roots; these are the edges of a
much smaller graph, treated the same way. A node of any degree gives each forest
one row only, so no group and no task grows with it.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.session import scratch_path

HELD_NODES = 1 << 19  # nodes of a forest, but for those that one Arrow batch adds
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside go when the block ends, but for lasting ones.

    Nothing may read them later: what the block gives must be a lasting table.
    """
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None):
    """Jobs inside have at most ``rows`` rows in an Arrow batch, or as many as before."""
    before = spark.conf.get(ARROW_ROWS)
    if rows is not None:
        spark.conf.set(ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def stored(df: DataFrame, name: str, batch_rows: int | None = None, lasting: bool = False) -> DataFrame:
    """The rows of ``df`` as Parquet in the shared folder, with the lineage cut.

    ``batch_rows`` bounds the Arrow batches on the way, for rows of many bytes. A
    ``lasting`` table stays after a block of ``passing_tables``.
    """
    path = scratch_path(df.sparkSession, name)
    if not lasting and (paths := _passing.get()) is not None:
        paths.append(path)
    with arrow_rows(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Forest:
    """Union-find over numbered nodes, by size and with path halving."""

    def __init__(self, n: int):
        self.parent, self.size = list(range(n)), [1] * n

    def add(self) -> int:
        """The number of a new tree of one node."""
        self.parent.append(len(self.parent))
        self.size.append(1)
        return len(self.parent) - 1

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Joins two trees; False if they are one already."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.parent[y] = x
        self.size[x] += self.size[y]
        return True


class _Held:
    """A forest over named nodes."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.numbers, self.forest = kind, {}, Forest(0)

    def _number(self, name) -> int:
        number = self.numbers.get(name)
        if number is None:
            number = self.numbers[name] = self.forest.add()
        return number

    def join(self, batch: pa.RecordBatch) -> None:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            self.forest.join(self._number(a), self._number(b))

    def rooted(self) -> Iterator[pa.RecordBatch]:
        """Each node with its root."""
        names = pa.array(list(self.numbers), self.kind)
        roots = np.fromiter(map(self.forest.find, range(len(names))), np.int64, len(names))
        for low in range(0, len(names), 50_000):
            part = slice(low, low + 50_000)
            yield pa.RecordBatch.from_arrays([names[part], names.take(pa.array(roots[part]))], names=["node", "root"])


def _forest(held_nodes: int):
    """The nodes of a task's edges with their roots."""

    def run(batches):
        held = None
        for batch in batches:
            held = held or _Held(batch.schema.types[0])
            held.join(batch)
            if len(held.numbers) >= held_nodes:
                yield from held.rooted()
                held = None
        if held is not None:
            yield from held.rooted()

    return run


def components(edges: DataFrame, held_nodes: int = HELD_NODES) -> DataFrame:
    """A row ``node, label`` for every node of the edges ``a, b``; labels are nodes.

    Edges with a null end are left out; repeated edges and loops do no harm. A task
    gives its forest out when it holds ``held_nodes``.
    """
    kind = edges.schema["a"].dataType.simpleString()
    proper = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    rooted = proper.mapInArrow(_forest(held_nodes), f"node {kind}, root {kind}")
    # A node has as many roots as forests have met it.
    met = rooted.groupBy("node").agg(F.min("root").alias("label"), F.collect_set("root").alias("roots"))
    met = stored(met, "roots")
    least = met.select("node", "label")
    joins = met.where(F.size("roots") > 1).select("label", F.explode("roots").alias("root")).where("label <> root")
    if joins.isEmpty():
        return least
    above = components(joins.select(F.col("root").alias("a"), F.col("label").alias("b")), held_nodes)
    above = above.select(F.col("node").alias("label"), F.col("label").alias("above"))
    return least.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
