"""Exact ordered analytics within groups, whatever the size of the table or of its largest group.

A window function sends each group to one task, and a table without groups to a single one.  The
functions here range-partition the rows on (group, order) instead, so that every group is spread over
as many tasks as its rows need.  Within a partition a row's place is its position; what earlier
partitions hold of a group is one offset per partition and group.  There is one path at every size.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from listwatch.session import materialise


def _placed(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows range-partitioned on (group, order), with their partition and position.

    Ranges are sampled, so they are written once: the rows and their offsets have to agree on them.
    """
    keys = [F.col(g) for g in group]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return materialise(placed.withColumn("_pos", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_pos", 33)))


def _with_runs(placed: DataFrame, group: list[str], held: Column, before: Column) -> DataFrame:
    """Each row with the start of its (partition, group) run and what earlier runs of the group hold."""
    runs = placed.groupBy("_part", *group).agg(F.min("_pos").alias("_first"), held.alias("_held"))
    # A group has a run per partition that it reaches, few rows; AQE broadcasts them by their size.
    runs = runs.withColumn("_before", before.over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    runs = runs.select(*[F.col(c).alias(f"_r{c}") for c in runs.columns])
    match = placed["_part"] == runs["_r_part"]
    for g in group:
        match = match & placed[g].eqNullSafe(runs[f"_r{g}"])
    return placed.join(runs, match)


def _local(group: list[str]):
    return W.partitionBy("_part", *group).orderBy("_pos")


def row_number_within(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Exact ``row_number()``; ``order`` must be unique within the group."""
    numbered = _with_runs(_placed(df, group, order), group, F.count(F.lit(1)), F.sum("_held"))
    place = F.coalesce("_r_before", F.lit(0)) + F.col("_pos") - F.col("_r_first") + 1
    return numbered.select(*df.columns, place.cast("bigint").alias(out))


def running_sum_within(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows up to and including the current one."""
    summed = _with_runs(_placed(df.withColumn("_v", value), group, order), group, F.sum("_v"), F.sum("_held"))
    local = F.sum("_v").over(_local(group).rowsBetween(W.unboundedPreceding, W.currentRow))
    upto = F.when(local.isNotNull() | F.col("_r_before").isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce("_r_before", F.lit(0)))
    return summed.withColumn(out, upto).select(*df.columns, out)


def previous_within(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """``value`` of the preceding row of the group, NULL on its first row."""
    linked = _with_runs(_placed(df.withColumn("_v", value), group, order), group, F.max_by(F.struct("_v"), "_pos"), F.last("_held"))
    before = F.when(F.col("_pos") == F.col("_r_first"), F.col("_r_before._v")).otherwise(F.lag("_v").over(_local(group)))
    return linked.withColumn(out, before).select(*df.columns, out)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of each group; every map task keeps at most ``n`` rows of a group."""
    ranked = df.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(out) <= n)


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The whole row that comes first per key, as an aggregate with map-side combine.

    ``order`` lists ascending expressions; negate numbers to prefer the largest.
    """
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*key, *[F.col("_best")[c].alias(c) for c in rest])
