"""Events of several organisers: matching to their history and to each other."""

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.events import completeness
from listwatch.functions.text import empty_array, missing, squeeze

PAST_DAYS, AHEAD_DAYS = 45, 400
MIN_SHARE = 0.5
FRAGILE = "ai"


def horizon(events: DataFrame, today: Column, day: str = "day") -> DataFrame:
    return events.where(F.col(day).between(F.date_sub(today, PAST_DAYS), F.date_add(today, AHEAD_DAYS)))


def prune_past(events: DataFrame, today: Column) -> DataFrame:
    return events.where(F.coalesce("last_day", "day") >= F.date_sub(today, PAST_DAYS))


def suspicious_drop(old: DataFrame, new: DataFrame, paths: DataFrame, today: Column) -> DataFrame:
    """Per organiser: did the listing return suspiciously few upcoming events?"""
    upcoming = F.col("day") >= today
    counts = (old.where(upcoming).select("organiser", F.lit(1).alias("o"), F.lit(0).alias("n"))
              .unionByName(new.where(upcoming).select("organiser", F.lit(0).alias("o"), F.lit(1).alias("n")))
              .groupBy("organiser").agg(F.sum("o").alias("old_upcoming"), F.sum("n").alias("new_upcoming")))
    few = (F.col("new_upcoming") == 0) | ((F.col("path") == FRAGILE)
                                          & (F.col("new_upcoming") < F.col("old_upcoming") * MIN_SHARE))
    return paths.join(counts, "organiser", "left").fillna(0, ["old_upcoming", "new_upcoming"]).withColumn(
        "suspicious", (F.col("old_upcoming") > 0) & few)


def unique_urls(events: DataFrame, listing_urls: DataFrame) -> DataFrame:
    """(organiser, url) used by exactly one event and not the address of a listing."""
    once = (events.where(~missing(F.col("url"))).groupBy("organiser", "url")
            .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).drop("_n"))
    return once.join(listing_urls.select("url"), "url", "left_anti")


def reconcile(old: DataFrame, new: DataFrame, paths: DataFrame, listing_urls: DataFrame, today: Column,
              fields: list[str], note: str = "note", last_day: str = "last_day") -> DataFrame:
    """Events after a reading of the listings.

    A new event matches an old one by id, else by its own page and day; it then inherits the old id
    and the fields it lacks.  Past and today's events stay; a vanished upcoming one is dropped
    unless the reading is suspicious.  On the fragile path the old note and the fields corrected
    from the detail page (``from_detail``) win.
    """
    state = suspicious_drop(old, new, paths, today).select("organiser", "path", "suspicious")
    own = unique_urls(old, listing_urls).join(unique_urls(new, listing_urls), ["organiser", "url"])
    by_url = (old.join(own, ["organiser", "url"], "left_semi")
              .join(new.select("organiser", "id"), ["organiser", "id"], "left_anti")
              .select("organiser", "url", "day", F.col("id").alias("_url_id")))
    known = old.select("organiser", "id", F.lit(True).alias("_known"))
    located = (new.join(known, ["organiser", "id"], "left").join(by_url, ["organiser", "url", "day"], "left")
               .withColumn("id", F.when(F.col("_known"), F.col("id")).otherwise(F.coalesce("_url_id", "id")))
               .drop("_known", "_url_id"))
    before = old.select("organiser", "id", "from_detail", *[F.col(f).alias(f"_o_{f}") for f in fields])
    joined = located.drop("from_detail").join(before, ["organiser", "id"], "left").join(state, "organiser", "left")
    fragile = F.col("path") == FRAGILE
    merged = {}
    for f in fields:
        n, o = F.col(f), F.col(f"_o_{f}")
        blank = n.isNull() if f == last_day else missing(n)
        old_wins = fragile & ~(o.isNull() if f == last_day else missing(o)) & (
            F.lit(f == note) | F.coalesce(F.array_contains("from_detail", f), F.lit(False)))
        inherit = blank & fragile if f == last_day else blank
        merged[f] = F.when(F.coalesce(old_wins, F.lit(False)), o).when(F.coalesce(inherit, F.lit(False)), F.coalesce(o, n)).otherwise(n)
    updated = joined.withColumns(merged).select(*old.columns)
    stay = (old.join(state, "organiser", "left")
            .where((F.col("day") <= today) | F.coalesce(F.col("suspicious"), F.lit(False)))
            .join(updated.select("organiser", "id"), ["organiser", "id"], "left_anti").select(*old.columns))
    return stay.unionByName(updated)


def needs_detail(url: Column, tries: Column, *wanted: Column, max_tries: int = 2) -> Column:
    """Has a page, tries left, and lacks at least one of the wanted fields."""
    lacking = F.lit(False)
    for w in wanted:
        lacking = lacking | missing(w)
    return ~missing(url) & (F.coalesce(tries, F.lit(0)) < max_tries) & lacking


def detail_result(tries: Column, read: Column, complete: Column, max_tries: int = 2) -> Column:
    """Tries after reading a detail page: done when read in full, one more otherwise."""
    return F.when(read & complete, max_tries).otherwise(F.coalesce(tries, F.lit(0)) + 1)


def corrected_fields(before: Column, *changed: tuple[str, Column]) -> Column:
    """Names of fields overwritten from the detail page, added to those already recorded."""
    names = F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in changed]))
    return F.array_sort(F.array_union(F.coalesce(before, F.array().cast("array<string>")), names))


def cross_publisher(events: DataFrame, key: str, organisers: DataFrame, filled: list[str],
                    scored: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same event published by several organisers: (shown, duplicates, links of duplicates).

    Events meet on (day, key).  The winner is not a reseller, is the most complete, and comes first
    in the organisers' order; others of a different organiser duplicate it when the place is equal
    or unknown.  The winner takes the first non-blank value of each ``filled`` field from them.
    Every group is reduced to one row by aggregation; members never meet each other.
    """
    group = ["day", key]
    rank = F.struct(F.col("_reseller"), -F.col("_score"), F.col("_ord"), F.col("organiser"), F.col("id"))
    ranked = (events.join(organisers.select("organiser", F.col("reseller").alias("_reseller"),
                                            F.col("ord").alias("_ord")), "organiser", "left")
              .withColumn("_reseller", F.coalesce("_reseller", F.lit(False)))
              .withColumn("_ord", F.coalesce("_ord", F.lit(2147483647)))
              .withColumn("_score", completeness(*[F.col(c) for c in scored])).withColumn("_rank", rank))
    winners = (ranked.groupBy(*group)
               .agg(F.min("_rank").alias("_w"), (F.min("organiser") != F.max("organiser")).alias("_several")))
    place = F.lower(squeeze(F.col("place")))
    members = (ranked.join(winners, group).withColumn("_place", place)
               .withColumn("_is_winner", ~F.col("_several") | (F.col("_rank") == F.col("_w")))
               .withColumn("_rival", F.col("_several") & ~F.col("_is_winner") & (F.col("organiser") != F.col("_w.organiser"))))
    in_play = (F.col("_is_winner") | F.col("_rival")) & F.col("_several") & (F.col("_place") != "")
    places = members.groupBy(*group).agg(
        F.min_by(F.when(in_play, F.col("_place")), F.when(in_play, F.col("_rank"))).alias("_shared_place"))
    judged = members.join(places, group).withColumn("_dup", F.col("_rival") & (
        (F.col("_place") == "") | F.col("_shared_place").isNull() | (F.col("_place") == F.col("_shared_place"))))
    offers = judged.groupBy(*group).agg(*[
        F.min_by(F.when(F.col("_dup") & ~missing(F.col(f)), F.col(f)),
                 F.when(F.col("_dup") & ~missing(F.col(f)), F.col("_rank"))).alias(f"_f_{f}") for f in filled])
    shown = judged.where(~F.col("_dup")).join(offers, group)
    take = F.col("_several") & F.col("_is_winner")
    shown = shown.withColumns({f: F.when(take & missing(F.col(f)), F.coalesce(F.col(f"_f_{f}"), F.col(f)))
                               .otherwise(F.col(f)) for f in filled}).select(*events.columns)
    duplicates = judged.where(F.col("_dup")).withColumn("same_as", F.col("_w.id"))
    links = duplicates.where(~missing(F.col("url"))).select(F.col("same_as").alias("id"), "organiser", "url")
    return shown, duplicates.select(*events.columns, "same_as"), links


def clean_lecturers(names: Column, limit: int = 8) -> Column:
    tidy = F.filter(F.transform(names, lambda n: squeeze(n)), lambda n: n != "")
    return F.when(empty_array(names), F.array().cast("array<string>")).otherwise(F.slice(tidy, 1, limit))
