"""Work queues: priority classes, fair interleaving, batches and shared budgets."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from listwatch.operators.scan import row_number_within, top_per_group


def priority_class(preferred: Column, overlaps_default: Column, procedural: Column) -> Column:
    """0 for the default selection, 1 for matters of substance, 2 for procedural ones."""
    return F.when(F.coalesce(preferred | overlaps_default, F.lit(False)), 0).when(procedural, 2).otherwise(1)


def fair_queue(items: DataFrame, source: str, source_order: str, order: list[Column]) -> DataFrame:
    """Round-robin over sources: ``turn`` is the rank inside the source, ``place`` the overall order."""
    turns = row_number_within(items, [source], order, "turn")
    return row_number_within(turns, [], [F.col("turn"), F.col(source_order)], "place")


def capped_queue(items: DataFrame, source: str, source_order: str, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` places of the fair queue: what one run takes on.

    No source can fill more than ``cap`` of them, so every map task keeps that many rows of a source.
    """
    turns = top_per_group(items, [source], order, cap, "turn").withColumn("turn", F.col("turn").cast("bigint"))
    taken = turns.orderBy("turn", source_order).limit(cap)
    # At most ``cap`` rows, a number that the budget of a run sets.
    return taken.withColumn("place", F.row_number().over(W.orderBy("turn", source_order)).cast("bigint"))


def batches(items: DataFrame, order: list[Column], size: int, max_batches: int | None = None) -> DataFrame:
    """Fixed-size batches in the given order, optionally only the first ``max_batches``."""
    if max_batches is not None:
        items = items.orderBy(*order).limit(size * max_batches)
    numbered = row_number_within(items, [], order, "place")
    return numbered.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int"))


def share_budget(needs: DataFrame, claimant: str, need: str, order: str, budget: int) -> DataFrame:
    """Water-filling: everyone gets min(need, level), the remainder goes one each in ``order``.

    The level is read off a histogram of needs capped at the budget, so the ordered part of the
    computation has at most ``budget`` + 1 rows whatever the number of claimants.
    """
    capped = needs.withColumn("_need", F.least(F.greatest(F.col(need), F.lit(0)), F.lit(budget)))
    hist = capped.groupBy("_need").agg(F.count(F.lit(1)).alias("_n"))
    below = W.orderBy("_need").rowsBetween(W.unboundedPreceding, -1)
    above = W.orderBy("_need").rowsBetween(0, W.unboundedFollowing)
    steps = hist.select(
        "_need", F.coalesce(F.sum(F.col("_need") * F.col("_n")).over(below), F.lit(0)).alias("_met"),
        F.sum("_n").over(above).alias("_open"))
    # With the needs below fully met, the others can share this level; it is valid up to their need.
    level = steps.select(F.least(F.floor((budget - F.col("_met")) / F.col("_open")), F.col("_need")).alias("l"))
    top = level.agg(F.greatest(F.coalesce(F.max("l"), F.lit(0)), F.lit(0)).cast("bigint").alias("_level"))
    levelled = capped.withColumn("_level", top.scalar())
    given = F.least(F.col("_need"), F.col("_level"))
    left = levelled.agg((budget - F.coalesce(F.sum(given), F.lit(0))).cast("bigint").alias("_left")).scalar()
    # At most ``budget`` claimants can receive one of the remaining units.
    waiting = levelled.where(F.col("_need") > F.col("_level")).orderBy(order).limit(budget)
    extra = (waiting.select(claimant, F.row_number().over(W.orderBy(order)).alias("_rank"))
             .where(F.col("_rank") <= left).select(claimant))
    return (levelled.join(extra.withColumn("_extra", F.lit(1)), claimant, "left")
            .withColumn("granted", (given + F.coalesce(F.col("_extra"), F.lit(0))).cast("bigint"))
            .drop("_need", "_level", "_extra"))
