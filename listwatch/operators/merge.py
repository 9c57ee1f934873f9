"""Merging rediscovered, provisional, cached and archived records."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from listwatch.functions.text import blank_to_null, describe, first_text, missing
from listwatch.operators.scan import top_per_group


def _given(c: Column, kind: T.DataType) -> Column:
    """The value, or NULL when it is blank for its type."""
    if isinstance(kind, T.StringType):
        return blank_to_null(c)
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(c) > 0, c)
    return c


def merge_records(archive: DataFrame, found: DataFrame, key: list[str], updatable: list[str],
                  meta: str | None = None) -> DataFrame:
    """Field-level upsert: a non-blank rediscovered value wins, everything else stays as archived.

    Adds ``is_new`` and ``changed``.  Both sides hold one row per key.
    """
    a, n = archive.alias("a"), found.alias("n")
    joined = a.withColumn("_in_a", F.lit(True)).alias("a").join(
        n.withColumn("_in_n", F.lit(True)).alias("n"), key, "full_outer")
    is_new = F.col("_in_a").isNull()
    touched = F.lit(False)
    out = []
    for field in archive.schema:
        name = field.name
        if name in key:
            out.append(F.col(name))
            continue
        old = F.col(f"a.{name}")
        if name not in found.columns:
            out.append(old.alias(name))
        elif name == meta:
            new = F.map_filter(F.col(f"n.{name}"), lambda k, v: ~missing(v))
            empty = F.create_map().cast(field.dataType)
            both = F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, o, v: F.coalesce(v, o))
            differs = F.exists(F.map_entries(F.coalesce(new, empty)),
                               lambda e: ~e["value"].eqNullSafe(F.try_element_at(old, e["key"])))
            touched = touched | F.coalesce(differs, F.lit(False))
            out.append(both.alias(name))
        else:
            new = _given(F.col(f"n.{name}"), field.dataType)
            if name in updatable:
                touched = touched | (new.isNotNull() & ~new.eqNullSafe(old))
                out.append(F.coalesce(new, old).alias(name))
            else:
                out.append(F.when(is_new, F.col(f"n.{name}")).otherwise(old).alias(name))
    return joined.select(*out, is_new.alias("is_new"), (~is_new & touched).alias("changed"))


def hand_over(records: DataFrame, key: list[str], provisional: Column, always_inherits: Column) -> DataFrame:
    """Provisional records give way to the official record of the same key.

    Expects ``id``, ``first_seen`` (TIMESTAMP), ``summary`` and ``replaced_by`` (blank when live).
    The earliest official record takes over the summary and, where ``always_inherits`` or the
    provisional one has a summary, the earliest first-seen time; provisional records get
    ``replaced_by``.  Each side is reduced to one row per key before joining: no pairs are formed.
    """
    flagged = records.withColumn("_prov", provisional).withColumn("_inherits", always_inherits)
    live = missing(F.col("replaced_by")) & ~missing(F.col(key[0]))
    has_summary = ~missing(F.col("summary"))
    by_key = flagged.where(live).groupBy(*key).agg(
        F.min_by(F.when(~F.col("_prov"), F.col("id")),
                 F.when(~F.col("_prov"), F.struct("first_seen", "id"))).alias("_official"),
        F.min(F.when(F.col("_prov") & (F.col("_inherits") | has_summary), F.col("first_seen"))).alias("_seen"),
        F.min_by(F.when(F.col("_prov") & has_summary, F.col("summary")),
                 F.when(F.col("_prov") & has_summary, F.struct("first_seen", "id"))).alias("_summary"),
        F.max("_prov").alias("_any_prov"))
    # Only keys that have both kinds can change anything.
    by_key = by_key.where(F.col("_official").isNotNull() & F.col("_any_prov"))
    joined = flagged.join(by_key, key, "left")
    takes = live & (F.col("id") == F.col("_official"))
    gives = live & F.col("_prov") & F.col("_official").isNotNull()
    keep = [c for c in records.columns if c not in ("first_seen", "summary", "replaced_by")]
    return joined.select(
        *keep,
        F.when(takes, F.least(F.col("first_seen"), F.col("_seen"))).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(takes, first_text(F.col("summary"), F.col("_summary"))).otherwise(F.col("summary")).alias("summary"),
        F.when(gives, F.col("_official")).otherwise(F.col("replaced_by")).alias("replaced_by"))


def hand_over_enrichment(records: DataFrame, key: list[str], provisional: Column, always_inherits: Column, kind: Column,
                         enrichment: str = "enrichment") -> DataFrame:
    """``hand_over`` for records whose whole ``enrichment`` (a nullable struct with ``summary``) passes on.

    ``kind`` is an additional part of the key where it is not null, for courts whose provisional record gives way
    to an official one of the same kind only; null matches any kind.  The earliest official record without an
    enrichment takes that of the earliest provisional record that has one, and, where ``always_inherits`` or
    a provisional one has a summary, the earliest first-seen time.  An enrichment without a summary passes on too.
    """
    parts = [*key, "_kind"]
    rows = records.withColumns({"_kind": F.coalesce(kind, F.lit("")), "_prov": F.coalesce(provisional, F.lit(False)),
                                "_inherits": F.coalesce(always_inherits, F.lit(False)) | ~missing(F.col(f"{enrichment}.summary")),
                                "_live": missing(F.col("replaced_by")) & ~missing(F.col(key[0]))})
    age, gives = F.struct("first_seen", "id"), F.col("_prov") & F.col(enrichment).isNotNull()
    by_key = rows.where("_live").groupBy(*parts).agg(
        F.min(F.when(~F.col("_prov"), age))["id"].alias("_official"),
        F.min(F.when(F.col("_prov") & F.col("_inherits"), F.col("first_seen"))).alias("_seen"),
        F.min_by(F.when(gives, F.col(enrichment)), F.when(gives, age)).alias("_given"),
        F.bool_or("_prov").alias("_any")).where("_any and _official is not null")
    takes = F.col("_live") & ~F.col("_prov") & (F.col("id") == F.col("_official"))
    done = rows.join(by_key, parts, "left").select(
        *[c for c in records.columns if c not in ("first_seen", enrichment, "replaced_by")],
        F.when(takes, F.least("first_seen", "_seen")).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(takes, F.coalesce(enrichment, "_given")).otherwise(F.col(enrichment)).alias(enrichment),
        F.when(F.col("_live") & F.col("_prov"), F.coalesce("_official", "replaced_by")).otherwise(F.col("replaced_by")).alias("replaced_by"))
    return done.select(*records.columns)


def fill_from_pages(items: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Items without a summary and without a base text, given the abstract of their page, else its text.

    items(key, title, description, summary, base), pages(key, abstract, text), one row per key.  Only an abstract
    becomes the description.  ``filled`` is null where nothing was wanted, false where the page had nothing.
    """
    wanted = missing(F.col("summary")) & missing(F.col("base"))
    found = F.col("_abstract"), F.col("_text")
    has = wanted & (first_text(*found) != "")
    side = pages.select(key, F.col("abstract").alias("_abstract"), F.col("text").alias("_text"))
    return items.join(side, key, "left").withColumns({
        "filled": F.when(wanted, has),
        "description": F.when(has & ~missing(found[0]), found[0]).otherwise(F.col("description")),
        "base": F.when(has, F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), first_text(*found))).otherwise(F.col("base")),
    }).drop("_abstract", "_text")


def suppress_provisional(new: DataFrame, archive_official: DataFrame, key: list[str]) -> DataFrame:
    """New provisional records for which no official record exists."""
    return new.join(archive_official.select(*key), key, "left_anti")


def overlay_cache(items: DataFrame, cache: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of the item, filled from the cache where the item has none."""
    side = cache.select(key, *[F.col(f).alias(f"_c_{f}") for f in fields])
    joined = items.join(side, key, "left")
    filled = {f: first_text(F.col(f) if f in items.columns else F.lit(None), F.col(f"_c_{f}")) for f in fields}
    return joined.withColumns(filled).drop(*[f"_c_{f}" for f in fields])


# Notes shown instead of a summary.
NO_CONTENT_NOTE = "Obsah není dostupný."
NO_SUMMARY_NOTE = "Shrnutí není k dispozici."


def backfill(archive: DataFrame, today: DataFrame, state: DataFrame, cache: DataFrame, start: Column,
             enriching: bool = True) -> DataFrame:
    """Archived rows missing from today's set but still in the window, with cached summaries overlaid.

    archive(id, title, authors, heading, summary, note, text), state(id, first_seen),
    cache(id, summary, tag, authors, no_content).  A summary the cache has lost is retracted.
    """
    live = state.where(F.col("first_seen") >= start).select("id", "first_seen")
    c = cache.select("id", F.lit(True).alias("_hit"), *[F.col(x).alias(f"_c_{x}") for x in
                                                        ("summary", "tag", "authors", "no_content")])
    rows = (archive.drop("first_seen").join(today.select("id"), "id", "left_anti")
            .join(live, "id").join(c, "id", "left"))
    given = ~missing(F.col("_c_summary"))
    hit = F.col("_hit").isNotNull()
    summary = F.when(hit & given, F.col("_c_summary")).when(hit, "").otherwise(F.coalesce("summary", F.lit("")))
    lost = hit & ~given & ~missing(F.col("summary"))
    heading = (F.when(hit & given, first_text(F.col("_c_tag"), F.col("heading"))).when(lost, "")
               .otherwise(F.coalesce("heading", F.lit(""))))
    note = F.when(F.coalesce(F.col("_c_no_content"), F.lit(False)), NO_CONTENT_NOTE).otherwise(NO_SUMMARY_NOTE)
    authors = first_text(F.col("authors"), F.when(hit, F.col("_c_authors")))
    return rows.select(
        "id", "title", authors.alias("authors"),
        heading.alias("heading"), summary.alias("summary"),
        F.when(summary != "", "").otherwise(note if enriching else F.lit("")).alias("note"),
        F.when(summary != "", "").otherwise(first_text(F.col("text"), describe(F.col("title"), authors))).alias("text"),
        "first_seen")


def prefer_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of ``first`` plus those of ``second`` whose key (any case) ``first`` lacks."""
    have = first.select(F.lower(key).alias("_k")).distinct()
    extra = second.join(have, F.lower(second[key]) == have["_k"], "left_anti")
    return first.unionByName(extra, allowMissingColumns=True)


def first_available(candidates: DataFrame, group: list[str], priority: str) -> DataFrame:
    """Rows of the best priority that has any rows, per group."""
    best = candidates.groupBy(*group).agg(F.min(priority).alias("_best"))
    return candidates.join(best, group).where(F.col(priority) == F.col("_best")).drop("_best")


def fold_history(versions: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """Snapshots of a feed folded to one row per key: earliest time, latest non-blank value per field."""
    latest = [F.max_by(F.when(~missing(F.col(f)), F.col(f)), F.when(~missing(F.col(f)), F.col(at))).alias(f)
              for f in fields]
    return versions.groupBy(key).agg(F.min(at).alias("first_seen"), *latest)


def enrich_newest(items: DataFrame, lookup: DataFrame, key: str, field: str, group: list[str],
                  order: list[Column], n: int) -> DataFrame:
    """Fill ``field`` from a lookup for the ``n`` newest rows per group that lack it."""
    lacking = items.where(missing(F.col(field)))
    chosen = top_per_group(lacking, group, order, n).select(key)
    found = chosen.join(lookup.select(key, F.col(field).alias("_found")), key)
    return items.join(found, key, "left").withColumn(field, first_text(F.col(field), F.col("_found"))).drop("_found")
