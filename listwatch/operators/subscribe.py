"""What each subscriber sees, and summaries of their selections."""

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.operators.scan import first_per_key


def canonical(areas: Column, aliases: dict[str, str], known: list[str]) -> Column:
    """Areas renamed through their aliases, unknown ones and repetitions dropped."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    renamed = F.transform(areas, lambda a: F.coalesce(F.try_element_at(table, a), a)) if aliases else areas
    return F.array_distinct(F.filter(renamed, lambda a: a.isin(*known)))


def normalise_profiles(profiles: DataFrame, aliases: dict[str, str], known: list[str], default_areas: list[str],
                       default_panels: list[int]) -> DataFrame:
    """Stored selections with aliases resolved; what a profile does not say takes the default."""
    areas = F.when(F.col("areas").isNull(), F.array(*[F.lit(a) for a in default_areas])).otherwise(
        canonical(F.col("areas"), aliases, known))
    panels = F.when(F.col("panels").isNull(), F.array(*[F.lit(p) for p in default_panels])).otherwise(
        F.array_distinct(F.filter("panels", lambda p: p > 0)))
    return profiles.withColumns({"areas": areas, "panels": panels,
                                 "hidden": F.coalesce("hidden", F.array().cast("array<string>"))})


def _chosen(rows: DataFrame, key: str, panels: Column) -> DataFrame:
    """(key, choices): the distinct areas and panels of each key, with their courts, in one order."""
    by_area = rows.select(key, "court", F.explode("areas").alias("area"))
    by_panel = rows.select(key, "court", F.explode(panels).alias("panel"))
    known = F.col("court").isNotNull() & (F.col("area").isNotNull() | F.col("panel").isNotNull())
    choice = F.struct("court", "area", "panel")
    return by_area.unionByName(by_panel, allowMissingColumns=True).where(known).groupBy(key).agg(
        F.sort_array(F.collect_set(choice)).alias(f"{key}_choices"))


def visible_classes(items: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, profile_choices), (profile_choices, id_choices) and (id, id_choices).

    Profiles with the same choices see the same items, and items with the same choices are seen by the
    same profiles, so only distinct choices meet.
    """
    selections, kinds = _chosen(profiles, "profile", F.col("panels")), _chosen(items, "id", F.array("panel"))

    def each(rows: DataFrame, choices: str) -> DataFrame:
        return rows.select(choices).distinct().select(choices, F.explode(choices).alias("c")).select(choices, "c.*")

    wanted, held = each(selections, "profile_choices"), each(kinds, "id_choices")
    by_area = wanted.drop("panel").join(held.drop("panel"), ["court", "area"])
    by_panel = wanted.drop("area").join(held.drop("area"), ["court", "panel"])
    both = by_area.select("profile_choices", "id_choices").unionByName(by_panel.select("profile_choices", "id_choices")).distinct()
    return selections, both, kinds


def visible(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, id) pairs: the item's panel is selected, or one of its areas is; each pair once."""
    selections, matches, kinds = visible_classes(items, profiles)
    return selections.join(matches, "profile_choices").join(kinds, "id_choices").select("profile", "id")


def visible_counts(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, visible): pairs of :func:`visible` per profile, counted per selection without forming them."""
    selections, matches, kinds = visible_classes(items, profiles)
    sizes = kinds.groupBy("id_choices").agg(F.count(F.lit(1)).alias("_n"))
    counts = matches.join(sizes, "id_choices").groupBy("profile_choices").agg(F.sum("_n").alias("visible"))
    return selections.join(counts, "profile_choices").select("profile", "visible")


def visible_journals(profiles: DataFrame, journals: DataFrame) -> DataFrame:
    """(profile, journal) a profile has not hidden; articles follow by joining on the journal.

    Both sides are dimensions: hidden journals per profile, and the registry.
    """
    wanted = profiles.select("profile", F.explode(F.array_except(
        journals.agg(F.collect_set("journal")).scalar(), F.col("hidden"))).alias("journal"))
    return wanted


def area_facet(items: DataFrame, chosen: list[str], aliases: dict[str, str], exempt: Column) -> DataFrame:
    """Items of the chosen areas; nothing chosen means everything, exempt items always pass."""
    if not chosen:
        return items
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    renamed = F.transform("areas", lambda a: F.coalesce(F.try_element_at(table, a), a)) if aliases else F.col("areas")
    return items.where(exempt | F.coalesce(F.arrays_overlap(renamed, F.array(*[F.lit(c) for c in chosen])), F.lit(False)))


def selectable_panels(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """Registered panels plus those that occur in the data without being registered."""
    extra = seen.select("panel").where(F.col("panel").isNotNull()).distinct().join(registry.select("panel"), "panel", "left_anti")
    return registry.select("panel", F.lit(True).alias("registered")).unionByName(
        extra.withColumn("registered", F.lit(False)))


def whole_groups(options: DataFrame, group: str, chosen: str) -> DataFrame:
    """Per group: options, chosen ones, and whether the whole group is chosen."""
    return options.groupBy(group).agg(
        F.count(F.lit(1)).alias("options"), F.count_if(F.col(chosen)).alias("chosen"), F.bool_and(chosen).alias("whole"))


def selection_summary(chosen: Column, mixed: Column, total: Column) -> Column:
    text = F.concat(chosen, F.lit(" z "), total, F.when(mixed > 0, F.concat(
        F.lit(", "), mixed, F.lit(" jen u některých soudů"))).otherwise(""))
    return F.when((chosen == 0) & (mixed == 0), "žádná").otherwise(text)


def followed(hearings: DataFrame, cases: DataFrame, key: list[str]) -> DataFrame:
    return hearings.join(cases.select(*key), key, "left_semi")


def with_changes(hearings: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Hearings with the number of their changes and the latest one, one aggregate row per key."""
    per = changes.groupBy(*key).agg(F.count(F.lit(1)).alias("changes"),
                                    F.max_by("wording", F.struct("found", "wording")).alias("latest_change"))
    return hearings.join(per, key, "left").fillna(0, ["changes"]).fillna("", ["latest_change"])


def change_rows(hearings: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """A row per hearing and change of it, ``found`` and ``wording`` null for a hearing without changes.

    Rows instead of a list: the changes of a hearing have no bound.
    """
    return hearings.join(changes.select(*key, "found", "wording"), key, "left")


def timeline(events: DataFrame, hearings: DataFrame, labels: DataFrame, case: list[str]) -> DataFrame:
    """Procedural events (codes labelled through a dimension) and hearings of each case."""
    named = (events.join(labels, "code", "left")
             .select(*case, "day", F.coalesce("label", "name", "code").alias("text"), "cancelled"))
    held = hearings.select(*case, "day", F.concat(F.lit("Jednání"), F.when(
        F.coalesce("clock", F.lit("")) != "", F.concat(F.lit(" v "), "clock")).otherwise("")).alias("text"),
        F.lit(False).alias("cancelled"))
    return named.unionByName(held)


def distinct_by_id(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row per id in source order."""
    return first_per_key(rows, [key], order)

