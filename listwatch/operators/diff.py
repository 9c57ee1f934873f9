"""Differences between successive snapshots of a calendar, and merging a snapshot in."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from listwatch.functions.text import empty_array, missing
from listwatch.operators.scan import first_per_key, running_sum_within

CHANGE_DAYS, CHANGE_MAX = 30, 200
# Codes and wording of changes.
CHANGE_TEXT = {
    "nove": "nové jednání",
    "presun": "přeloženo",
    "zruseno": "vypadlo z přehledu",
    "cas": "jiný čas",
    "sin": "jiná síň",
}


def _wording(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CHANGE_TEXT.items() for x in kv]), code)


def snapshot_diff(old: DataFrame, new: DataFrame, listed: DataFrame, mark: list[str], day: str = "day",
                  carried: tuple[str, ...] = ("title", "clock"),
                  attributes: tuple[tuple[str, str], ...] = (("clock", "cas"), ("room", "sin"))) -> DataFrame:
    """Changes between stored rows and a new snapshot of the same period.

    ``old`` and ``new`` hold the relevant rows, one per (mark, day); ``listed`` is the whole new
    document, so a row that is merely no longer relevant does not count as cancelled.  Vanished and
    appeared days of a mark are paired in date order: a pair is a move, a leftover a cancellation
    or a new entry.  Rows kept on the same day are compared attribute by attribute.
    """
    key = [*mark, day]
    kept = list(dict.fromkeys([*carried, *[a for a, _ in attributes]]))
    value = F.struct(*[F.col(c).cast("string").alias(c) for c in kept])
    nothing, no_row = F.lit(None).cast("string"), F.lit(None).cast(T.StructType([T.StructField(c, T.StringType()) for c in kept]))
    # One aggregate over the three inputs says for each (mark, day) where it occurs and with what values.
    tagged = (old.select(*key, value.alias("_o"), no_row.alias("_n"), F.lit(False).alias("_l"))
              .unionByName(new.select(*key, no_row.alias("_o"), value.alias("_n"), F.lit(False).alias("_l")))
              .unionByName(listed.select(*key, no_row.alias("_o"), no_row.alias("_n"), F.lit(True).alias("_l"))))
    days = tagged.groupBy(*key).agg(F.max("_o").alias("_o"), F.max("_n").alias("_n"), F.bool_or("_l").alias("_l"))
    in_old, in_new = F.col("_o").isNotNull(), F.col("_n").isNotNull()
    side = F.when(in_old & ~F.col("_l"), "gone").when(in_new & ~in_old, "come")
    loose = days.select(*key, side.alias("_side"), "_o").where(F.col("_side").isNotNull())
    # A mark has one row per day, so its groups are days of a published period.
    paired = loose.withColumn("_i", F.row_number().over(W.partitionBy(*mark, "_side").orderBy(day)))
    gone, come = F.col("_side") == "gone", F.col("_side") == "come"
    pairs = paired.groupBy(*mark, "_i").agg(
        F.max(F.when(gone, F.col(day))).alias("_from"), F.max(F.when(come, F.col(day))).alias("_to"),
        F.max(F.when(gone, F.col("_o"))).alias("_o"))
    moved, dropped = F.col("_from").isNotNull() & F.col("_to").isNotNull(), F.col("_to").isNull()
    moves = pairs.select(
        *mark, F.when(moved, "presun").when(dropped, "zruseno").otherwise("nove").alias("change"),
        F.coalesce("_to", "_from").alias(day),
        F.when(moved, F.col("_from").cast("string")).alias("was"), F.when(moved, F.col("_to").cast("string")).alias("becomes"),
        *[F.when(dropped & ~missing(F.col(f"_o.{c}")), F.col(f"_o.{c}")).alias(c) for c in carried])
    edits = F.array_compact(F.array(*[
        F.when(~missing(F.col(f"_n.{a}")) & (F.coalesce(F.col(f"_o.{a}"), F.lit("")) != F.col(f"_n.{a}")), F.struct(
            F.lit(code).alias("change"), F.coalesce(F.col(f"_o.{a}"), F.lit("")).alias("was"), F.col(f"_n.{a}").alias("becomes")))
        for a, code in attributes]))
    edited = days.where(in_old & in_new).select(*key, F.explode(edits).alias("_e")).select(
        *mark, "_e.change", day, "_e.was", "_e.becomes", *[nothing.alias(c) for c in carried])
    return moves.unionByName(edited).withColumn("wording", _wording(F.col("change")))


def carry_over(new: DataFrame, archive: DataFrame, key: list[str], parties: str = "parties",
               title: str = "title") -> DataFrame:
    """Rows with neither parties nor a title take both from the archived row of the same key."""
    before = archive.select(*key, F.col(parties).alias("_p"), F.col(title).alias("_t"))
    blank = empty_array(F.col(parties)) & missing(F.col(title))
    use = blank & ~empty_array(F.col("_p"))
    return (new.join(before, key, "left")
            .withColumns({parties: F.when(use, F.col("_p")).otherwise(F.col(parties)),
                          title: F.when(use, F.coalesce("_t", F.lit(""))).otherwise(F.col(title))})
            .drop("_p", "_t"))


def merge_snapshot(existing: DataFrame, listed: DataFrame, periods: DataFrame, source: list[str],
                   mark: str = "mark", day: str = "day", relevant: str = "relevant") -> DataFrame:
    """Calendar after a snapshot: other rows stay, listed rows are replaced by their fresh version,
    rows of a day the snapshot covers but does not list are dropped.

    ``periods`` has one row per snapshot: source, start, end (NULL when unknown) and ``complete``;
    an incomplete snapshot deletes nothing.
    """
    key = [*source, mark, day]
    kept = existing.join(listed.select(*key).distinct(), key, "left_anti")
    kept = uncovered(kept, periods.where("complete"), source, day).select(*existing.columns)
    return kept.unionByName(listed.where(F.col(relevant)).select(*existing.columns))


def uncovered(rows: DataFrame, periods: DataFrame, source: list[str], day: str) -> DataFrame:
    """Rows whose day lies in no period (``start`` to ``end``) of their source.

    One pass in day order: a period counts from its start to its end, and a row is covered while any
    is open.  A source with many periods costs their number, not pairs of rows and periods.  Rows without a
    source or a day are covered by nothing; periods without one, a start or an end cover nothing.
    """
    known = periods.dropna(subset=[*source, "start", "end"]).where("start <= end")
    row, none = F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(None)
    items = rows.select(*source, F.col(day).cast("date").alias("_day"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_open"), row.alias("_row"))
    edge = lambda at, kind, step: known.select(
        *source, F.col(at).cast("date").alias("_day"), F.lit(kind).alias("_kind"), F.lit(step).cast("bigint").alias("_open"),
        none.cast(items.schema["_row"].dataType).alias("_row"))
    # Of a day, periods open before its rows and close behind them.
    events = items.unionByName(edge("start", 0, 1)).unionByName(edge("end", 2, -1))
    swept = running_sum_within(events, source, [F.col("_day"), F.col("_kind")], F.col("_open"), "_cover")
    return swept.where((F.col("_kind") == 1) & ((F.col("_cover") == 0) | F.col("_day").isNull())).select("_row.*")


def trim_changes(changes: DataFrame, key: list[str], found: str, day: str, today: Column,
                 days: int = CHANGE_DAYS, cap: int | None = CHANGE_MAX) -> DataFrame:
    """Change log: each change once with its earliest find, recent ones, newest first, capped."""
    recent = changes.where(F.col(found) >= F.date_sub(today, days))
    once = first_per_key(recent, key, [F.col(found), *[F.col(c) for c in sorted(set(recent.columns) - {*key, found})]])
    if cap is None:
        return once
    tie = [F.col(c) for c in key if c != day]
    return once.orderBy(F.col(found).desc(), F.col(day).desc(), *tie).limit(cap)


def complete_enough(parsed: Column, expected: Column, ratio: float = 0.8) -> Column:
    return (expected <= 0) | (parsed >= expected * ratio)


def reported_total(parsed: Column, reported: Column) -> Column:
    """error when a page reports rows but none parse, warning when fewer parse, else ok."""
    return (F.when((reported > 0) & (parsed == 0), "error").when(parsed < reported, "warning").otherwise("ok"))
