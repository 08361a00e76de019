"""Running totals and next values over a whole table without a one-task window."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagcast.session import settled

_PART = "_part"


def _placed(df: DataFrame, *order) -> DataFrame:
    """Rows range-partitioned and settled, with the number of their partition.

    The partitions are files then, so their numbers stay true on every read.
    """
    return settled(df.repartitionByRange(*order)).withColumn(_PART, F.spark_partition_id())


def preceding_totals(
    df: DataFrame, order: list, totals: dict[str, str], within: tuple[str, ...] = ()
) -> DataFrame:
    """For each row the sums over all rows before it in ``order``.

    ``totals`` maps a result column to the column summed, ``within`` restarts
    the sums per group (a handful of groups, such as category names). Rows must
    be distinct in ``within`` and ``order``; callers aggregate first.

    Each range partition's total is one row; their running sums are broadcast
    (rows: partitions plus groups), and what remains is a window inside each
    partition.
    """
    placed = _placed(df, *within, *order)
    groups = [*within, _PART]
    earlier = Window.partitionBy(*within).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    per_part = placed.groupBy(*groups).agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    offsets = per_part.select(
        *groups, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals]
    )
    inside = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(offsets), groups)
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_before_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n)
            for n, c in totals.items()
        ],
    )


def next_values(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """For each row the first ``value`` that is not null in its group, from its own on in ``order``.

    Rows must be distinct in ``group`` and ``order``; callers aggregate first. A group
    of any size spreads over range partitions. Inside one, the next value is a running
    one from its end. The last group of a partition may go on in later ones: there it is
    the first group, so the first value of every partition is all that has to be carried
    back: a row at the end of a partition. Nothing is carried to rows without a group.
    """
    placed = _placed(df, group, order)
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(group, order, value)))
    edges = placed.groupBy(_PART).agg(first.alias("first"), F.max(group).alias("last"))
    nothing = F.lit(None).cast(df.schema[value].dataType)
    events = edges.select(F.col(f"first.{group}").alias("of"), _PART, F.col(f"first.{value}").alias("value"), F.lit(False).alias("asks"))
    events = events.unionByName(edges.select(F.col("last").alias("of"), _PART, nothing.alias("value"), F.lit(True).alias("asks")))
    later = Window.partitionBy("of").orderBy(F.desc(_PART)).rangeBetween(Window.unboundedPreceding, -1)
    carried = events.where(F.col("of").isNotNull()).withColumn("carried", F.last("value", ignorenulls=True).over(later))
    carried = carried.where(F.col("asks") & F.col("carried").isNotNull()).select(
        F.col("of").alias(group), F.col("carried").alias(value), _PART, F.lit(True).alias("_after")
    )
    both = placed.withColumn("_after", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    from_end = Window.partitionBy(_PART, group).orderBy(F.desc("_after"), F.desc(order))
    running = F.last(value, ignorenulls=True).over(from_end.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn(name, running).where(~F.col("_after")).select(*df.columns, name)
