"""State kept between runs: first-seen times, retry counters, outages, verdicts, versions."""

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.dates import is_new, noon, window_start
from listwatch.functions.text import missing

LATE_AFTER_DAYS = 14
KEEP_STATE_DAYS = 120
MAX_ATTEMPTS = 6
MAX_BACKOFF_HOURS = 20
OUTAGE_HOURS = 36
LOOKBACK_DAYS, BOOTSTRAP_DAYS = 10, 7
LAUNCH_DAYS, LAUNCH_SHIFT_DAYS, LAUNCH_FRESH_DAYS = 3, 15, 3
BULK_MIN, BULK_OLD_DAYS = 5, 60
COMPANY_VALID_DAYS = 7
REGENERATE_UNTIL_DAY = 7
NO_TEXT = "bez-textu"


def assigned_first_seen(published: Column, now: Column, bootstrap: Column | None = None) -> Column:
    """Now for a record found within 14 days of publication, else noon of its publication day."""
    day = noon(published)
    late = day < now - F.expr(f"INTERVAL {LATE_AFTER_DAYS} DAYS")
    if bootstrap is not None:
        late = late | bootstrap
    return F.when(day.isNotNull() & late, F.least(day, now)).otherwise(now)


def look_back(state_is_empty: Column, today: Column) -> Column:
    """First day to search: a short look-back on an empty state, an overlapping one later."""
    return F.date_sub(today, F.when(state_is_empty, BOOTSTRAP_DAYS).otherwise(LOOKBACK_DAYS))


def update_first_seen(items: DataFrame, state: DataFrame, guid: str, assigned: Column) -> DataFrame:
    """State after the run: known guids keep their time, new ones get the earliest assigned one.

    One aggregation with map-side combine, so a guid repeated in most of the items costs nothing.
    """
    nothing = F.lit(None).cast("timestamp")
    known = state.select(guid, F.col("first_seen").alias("_known"), nothing.alias("_new"))
    found = items.where(~missing(F.col(guid))).select(guid, nothing.alias("_known"), assigned.alias("_new"))
    return known.unionByName(found).groupBy(guid).agg(
        F.coalesce(F.min("_known"), F.min("_new")).alias("first_seen"),
        F.min("_known").isNotNull().alias("known"))


def with_first_seen(items: DataFrame, state: DataFrame, guid: str, assigned: Column) -> DataFrame:
    """Items with ``first_seen`` and ``known``; items without a guid are dropped."""
    return items.join(update_first_seen(items, state, guid, assigned), guid)


def in_window(items: DataFrame, now: Column, days: int | None = None) -> DataFrame:
    """Items first seen in the published window (or within ``days``), flagged ``is_new``."""
    start = window_start(now) if days is None else now - F.expr(f"INTERVAL {days} DAYS")
    return items.where(F.col("first_seen") >= start).withColumn("is_new", is_new(F.col("first_seen"), now))


def prune_state(state: DataFrame, now: Column, days: int | None = KEEP_STATE_DAYS) -> DataFrame:
    """Drop unreadable times and those older than ``days`` (None keeps everything readable)."""
    seen = F.col("first_seen").try_cast("timestamp")
    kept = state.where(seen.isNotNull())
    return kept if days is None else kept.where(seen >= now - F.expr(f"INTERVAL {days} DAYS"))


def prune_cache(cache: DataFrame, state: DataFrame, key: str, now: Column, days: int = KEEP_STATE_DAYS) -> DataFrame:
    """Cache entries whose key was first seen within ``days``; kept whole while the state is empty."""
    live = prune_state(state, now, days).select(key).distinct().withColumn("_live", F.lit(True))
    empty = state.limit(1).agg(F.count(F.lit(1))).scalar() == 0
    return cache.join(live, key, "left").where(F.col("_live") | empty).drop("_live")


# --- launches and bulk returns -------------------------------------------------------------

def launching(registry: DataFrame, state: DataFrame, now: Column, source: str = "source") -> DataFrame:
    """Sources introduced within three days, or of which the state knows nothing yet."""
    known = state.select(source).distinct()
    recent = F.col("introduced") > now - F.expr(f"INTERVAL {LAUNCH_DAYS} DAYS")
    fresh = registry.where(F.coalesce(recent, F.lit(False))).select(source)
    unseen = registry.join(known, source, "left_anti").select(source)
    return fresh.unionByName(unseen).distinct()


def bulk_returns(unknown: DataFrame, now: Column, source: str = "source") -> DataFrame:
    """Per source: unknown items, old ones among them, and whether they returned in bulk."""
    old = ~F.col("estimated") & (F.col("published") < now - F.expr(f"INTERVAL {BULK_OLD_DAYS} DAYS"))
    return (unknown.groupBy(source)
            .agg(F.count(F.lit(1)).alias("unknown"), F.count_if(old).alias("old"))
            .withColumn("bulk", (F.col("unknown") >= BULK_MIN) & (F.col("old") * 2 > F.col("unknown"))))


def backdated_first_seen(published: Column, estimated: Column, launching_source: Column,
                         bulk_source: Column, now: Column) -> Column:
    """First-seen time for unknown items; content of a launching or returning source is set back."""
    shifted = now - F.expr(f"INTERVAL {LAUNCH_SHIFT_DAYS} DAYS")
    stale = ~estimated & (published < now - F.expr(f"INTERVAL {BULK_OLD_DAYS} DAYS"))
    fresh = ~estimated & (published >= now - F.expr(f"INTERVAL {LAUNCH_FRESH_DAYS} DAYS"))
    no = F.lit(False)
    return (F.when(F.coalesce(bulk_source & stale, no), shifted)
            .when(~F.coalesce(launching_source, no), now)
            .when(F.coalesce(fresh, no), now).otherwise(shifted))


# --- retries -------------------------------------------------------------------------------

def attempts_spent(failures: Column, text_waits: Column, reason: Column) -> Column:
    """Enrichment attempts used; old rows with one counter spent it waiting for a text."""
    return F.when(F.coalesce(reason == NO_TEXT, F.lit(False)) & text_waits.isNull(), 0).otherwise(
        F.coalesce(failures, F.lit(0)))


def backoff_hours(attempt: Column) -> Column:
    """1, 2, 4, 8, 16, 20, 20 …"""
    return F.least(F.pow(F.lit(2), F.least(attempt, F.lit(6)) - 1), F.lit(MAX_BACKOFF_HOURS)).cast("int")


def defer(failures: Column, text_waits: Column, last_reason: Column, reason: Column, now: Column) -> Column:
    """Retry state after one more failure: separate counters for a missing text and for failures."""
    legacy = text_waits.isNull()
    waited = F.coalesce(last_reason == NO_TEXT, F.lit(False))
    spent = F.coalesce(failures, F.lit(0))
    waits = F.when(legacy, F.when(waited, spent).otherwise(0)).otherwise(F.coalesce(text_waits, F.lit(0)))
    fails = F.when(legacy & waited, 0).otherwise(spent)
    for_text = reason == NO_TEXT
    waits = waits + F.when(for_text, 1).otherwise(0)
    fails = fails + F.when(for_text, 0).otherwise(1)
    hours = backoff_hours(F.when(for_text, waits).otherwise(fails))
    return F.struct(fails.alias("failures"), waits.alias("text_waits"), hours.alias("hours"),
                    F.timestamp_add("HOUR", hours, now).alias("next_attempt"), reason.alias("reason"))


def needs_enrichment(replaced: Column, has_summary: Column, prompt_version: Column, failures: Column,
                     text_waits: Column, reason: Column, next_attempt: Column, now: Column,
                     current_version: int) -> Column:
    """Not replaced, no current summary, attempts left, and the next attempt is due."""
    current = has_summary & (F.coalesce(prompt_version, F.lit(0)) >= current_version)
    return (~replaced & ~current & (attempts_spent(failures, text_waits, reason) < MAX_ATTEMPTS)
            & (next_attempt.isNull() | (next_attempt <= now)))


# --- source health -------------------------------------------------------------------------

def outage_status(checks: DataFrame, source: str, at: str, ok: str) -> DataFrame:
    """Per source: start of the current outage and whether it is a warning or an error at its last check."""
    last_ok = F.max(F.when(F.col(ok), F.col(at)))
    per = checks.groupBy(source).agg(last_ok.alias("last_ok"), F.max(at).alias("last_check"))
    # Only the first failure after the last success matters, so failures are joined to one row per source.
    since = (checks.where(~F.col(ok)).join(per, source)
             .where(F.col("last_ok").isNull() | (F.col(at) > F.col("last_ok")))
             .groupBy(source).agg(F.min(at).alias("down_since")))
    return per.join(since, source, "left").withColumn(
        "status", F.when(F.col("down_since").isNull(), "ok")
        .when(F.col("last_check") < F.col("down_since") + F.expr(f"INTERVAL {OUTAGE_HOURS} HOURS"), "warning")
        .otherwise("error"))


def split_deferred(found: DataFrame, published: str, detail_failed: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows put off): no publication date and no detail page means try again later."""
    put_off = missing(F.col(published)) & detail_failed
    return found.where(~put_off), found.where(put_off)


# --- caches, versions, decisions -----------------------------------------------------------

def valid_verdicts(cache: DataFrame, today: Column, current_version: str) -> DataFrame:
    """Persons are remembered for good, manual entries too, companies for a week and one version."""
    recent = (F.col("asof") > F.date_sub(today, COMPANY_VALID_DAYS)) & (F.col("version") == current_version)
    return cache.where((F.col("verdict") == "person") | F.col("manual") | ((F.col("verdict") == "company") & recent))


def regenerate_reason(previous: dict[str, Column], current: dict[str, Column], day_of_month: Column) -> Column:
    """Why a published report has to be produced again; NULL when it stands."""
    shrank = (previous["pending"] > 0) & ~previous["fingerprint"].eqNullSafe(current["fingerprint"])
    still = (current["pending"].isNotNull() & (current["pending"] >= previous["pending"])) | (
        day_of_month > REGENERATE_UNTIL_DAY)
    return (F.when(previous["generated"].isNull(), "none yet")
            .when(previous["blocks"] == 0, "empty")
            .when(previous["failed"], "failed")
            .when(~previous["period"].eqNullSafe(current["period"]), "other period")
            .when(F.coalesce(shrank & ~still, F.lit(False)), "pending shrank"))


def set_change(old: DataFrame, new: DataFrame, group: list[str], member: str) -> DataFrame:
    """Per group: size of the symmetric difference and whether it exceeds an ordinary change."""
    a = old.select(*group, member).distinct().withColumn("_old", F.lit(1))
    b = new.select(*group, member).distinct().withColumn("_new", F.lit(1))
    sizes = a.join(b, [*group, member], "full_outer").groupBy(*group).agg(
        F.count("_old").alias("old_size"), F.count("_new").alias("new_size"),
        F.count_if(F.col("_old").isNull() | F.col("_new").isNull()).alias("difference"))
    limit = F.greatest(F.lit(3), F.floor(F.col("old_size") / 2))
    return sizes.withColumn("large", (F.col("old_size") > 0) & (F.col("difference") > limit))


def accept_versions(current: DataFrame, offered: DataFrame, key: str, change: DataFrame) -> DataFrame:
    """Guarded replacement of a versioned dimension: decision per key, with the reason to refuse."""
    now_valid = current.select(key, F.col("valid_from").alias("_current"))
    joined = offered.join(now_valid, key, "left").join(change.select(key, "large"), key, "left")
    return joined.withColumn("decision", (
        F.when(F.col("valid_from").isNull() & F.col("_current").isNotNull(), "no date")
        .when(F.col("valid_from") <= F.col("_current"), "not newer")
        .when(F.coalesce(F.col("large"), F.lit(False)), "too different")
        .otherwise("accept"))).drop("_current", "large")


def changed_snapshots(snapshots: DataFrame, known: DataFrame, source: list[str], fingerprint: str) -> DataFrame:
    """Snapshots whose fingerprint differs from the stored one."""
    return snapshots.join(known.select(*source, fingerprint), [*source, fingerprint], "left_anti")


def heading_versions(version: Column, tries: Column, offered: Column, acceptable: Column, current: int,
                     max_tries: int = 2) -> Column:
    """struct(version, tries, use_offered) after one rewrite round: accepted, retried, or frozen."""
    spent = F.coalesce(tries, F.lit(0)) + 1
    good = offered.isNotNull() & F.coalesce(acceptable, F.lit(False))
    done = good | (spent >= max_tries)
    return F.struct(F.when(done, F.lit(current)).otherwise(version).alias("version"),
                    F.when(done, F.lit(0)).otherwise(spent).alias("tries"), good.alias("use_offered"))
