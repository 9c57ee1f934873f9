"""Calendar shapes: day expansion, grids, month sections, timelines."""

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.dates import minutes_of_day, monday_of
from listwatch.operators.scan import row_number_within, top_per_group

MAX_SPAN_DAYS = 7


def by_day(events: DataFrame, first: str = "day", last: str = "last_day") -> DataFrame:
    """One row per event and day; an event longer than a week shows on its first day only."""
    end = F.coalesce(F.col(last), F.col(first))
    end = F.when(F.datediff(end, F.col(first)) > MAX_SPAN_DAYS, F.col(first)).otherwise(end)
    days = F.when(end >= F.col(first), F.sequence(F.col(first), end))
    return events.withColumn("shown_on", F.explode(days))


def grid(events: DataFrame, day: str, any_day: Column, weeks: int = 3) -> DataFrame:
    """Days of the grid starting on the Monday of ``any_day`` with event counts.

    Five days a week, seven when any weekend day inside the grid has an event.  ``events`` is
    aggregated per day first; the grid itself has ``weeks`` * 7 rows.
    """
    spark = events.sparkSession
    start = monday_of(any_day)
    days = spark.range(weeks * 7).select(
        F.date_add(start, F.col("id").cast("int")).alias("grid_day"),
        F.floor(F.col("id") / 7).cast("int").alias("week"), (F.col("id") % 7).cast("int").alias("column"))
    counts = (events.where(F.col(day).between(start, F.date_add(start, weeks * 7 - 1)))
              .groupBy(F.col(day).alias("grid_day")).agg(F.count(F.lit(1)).alias("events")))
    cells = days.join(counts, "grid_day", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    weekend = cells.agg(F.coalesce(F.bool_or((F.col("column") >= 5) & (F.col("events") > 0)), F.lit(False)))
    return cells.where((F.col("column") < 5) | weekend.scalar())


def order_within_day(events: DataFrame, day: list[str], clock: str, tie: list[Column]) -> DataFrame:
    """Position of each event in its day: by minutes, missing last, then the tie-break."""
    timed = events.withColumn("_m", minutes_of_day(F.col(clock)))
    return row_number_within(timed, day, [F.col("_m"), *tie], "position").drop("_m")


def calendar_order(events: DataFrame, day: list[str], clock: str, mark: str, tie: list[Column]) -> DataFrame:
    """Position in the day by minutes, missing last, then by mark as Czech sorts it (c, č, d, h, ch, i)."""
    return order_within_day(events, day, clock, [F.collate(F.col(mark), "cs"), *tie])


def month_section(shown: Column, window_first: Column, today: Column) -> Column:
    """Month ``yyyy-MM`` of the section: earlier dates go to the oldest, later ones to the newest."""
    oldest, newest = F.trunc(window_first, "MM"), F.trunc(today, "MM")
    month = F.coalesce(F.trunc(shown, "MM"), oldest)
    return F.date_format(F.least(F.greatest(month, oldest), newest), "yyyy-MM")


def month_sections(items: DataFrame, shown: str, window_first: Column, today: Column) -> DataFrame:
    """Count per month of the window, empty months included (at most twelve)."""
    # Items older than the oldest month shown count there.
    first = F.greatest(F.trunc(window_first, "MM"), F.add_months(F.trunc(today, "MM"), -11))
    months = items.sparkSession.range(1).select(F.explode(F.sequence(
        first, F.trunc(today, "MM"),
        F.expr("INTERVAL 1 MONTH"))).alias("_m")).select(F.date_format("_m", "yyyy-MM").alias("month"))
    counts = items.groupBy(month_section(F.col(shown), first, today).alias("month")).agg(
        F.count(F.lit(1)).alias("items"))
    return months.join(counts, "month", "left").withColumn("items", F.coalesce("items", F.lit(0)))


def folded_history(history: DataFrame, group: list[str], order: list[Column], reverse: list[Column],
                   tail: int = 3) -> DataFrame:
    """First and last ``tail`` entries of each history; ``hidden`` counts the folded ones.

    Both ends are limited per group before the shuffle, the count is an aggregate.
    """
    sizes = history.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    head = top_per_group(history, group, order, 1, "_i").withColumn("from_start", F.col("_i").cast("bigint")).drop("_i")
    last = top_per_group(history, group, reverse, tail, "_j")
    last = last.join(sizes, group).withColumn("from_start", (F.col("_n") - F.col("_j") + 1).cast("bigint"))
    last = last.where(F.col("from_start") > 1).drop("_j", "_n")
    both = head.unionByName(last).join(sizes, group)
    return both.withColumn("hidden", F.greatest(F.col("_n") - 1 - tail, F.lit(0)).cast("bigint")).drop("_n")


def next_and_last(events: DataFrame, group: list[str], day: str, tie: str, today: Column) -> DataFrame:
    """Next entry on or after today and the last entry of each group."""
    d, at = F.col(day), F.struct(F.col(day), F.col(tie))
    return events.groupBy(*group).agg(
        F.min(F.when(d >= today, d)).alias("next_day"), F.max(d).alias("last_day"),
        F.max_by(F.col(tie), at).alias("last_entry"))


def published_until(period_ends: DataFrame, end: str, events: DataFrame, day: str) -> DataFrame:
    """Latest period end, or the latest event when no period is known (one row)."""
    latest = events.agg(F.max(day)).scalar()
    return period_ends.agg(F.max(end).alias("_p")).select(F.coalesce("_p", latest).alias("published_until"))


def derived_period(rows: DataFrame, group: list[str], day: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.min(day).alias("start"), F.max(day).alias("end"))
