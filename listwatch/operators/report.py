"""Counts, fingerprints and summaries published next to the data."""

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.dates import USAGE_ZONE, local_day
from listwatch.functions.links import link_shape
from listwatch.functions.text import missing


def row_hash(columns: list[str]) -> Column:
    """60-bit number from the digest of the columns, the same wherever it is computed."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """Row count and content fingerprint, per group when given.

    The sum of row digests does not depend on row order, so it is one map-side aggregate; put a
    position among the columns to make the order count.
    """
    return df.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.concat_ws(":", F.count(F.lit(1)), F.sum(row_hash(columns))).alias("fingerprint"))


def pending_counts(items: DataFrame, source: str) -> DataFrame:
    """Per source: waiting for enrichment, waiting without areas, waiting for a text, all."""
    waiting = F.col("status") == "pripravuje"
    return items.groupBy(source).agg(
        F.count_if(waiting).alias("waiting"), F.count_if(waiting & (F.col("areas") == 0)).alias("without_area"),
        F.count_if(F.col("status") == "ceka_na_text").alias("without_text"), F.count(F.lit(1)).alias("total"))


def usage_by_day(calls: DataFrame, at: str, model: str, amounts: list[str]) -> DataFrame:
    """Calls and amounts per accounting day and model."""
    return calls.groupBy(local_day(F.col(at), USAGE_ZONE).alias("day"), model).agg(
        F.count(F.lit(1)).alias("calls"), *[F.sum(a).alias(a) for a in amounts])


def add_usage(stored: DataFrame, run: DataFrame, model: str, amounts: list[str], today: Column,
              keep_days: int = 14) -> DataFrame:
    """Stored usage plus that of this run, additive per (day, model), with retention."""
    every = ["calls", *amounts]
    return (stored.unionByName(run).where(F.col("day") >= F.date_sub(today, keep_days))
            .groupBy("day", model).agg(*[F.sum(a).alias(a) for a in every]))


def link_shapes(links: DataFrame, href: str, limit: int = 8) -> DataFrame:
    """Most frequent shapes of links."""
    return (links.groupBy(link_shape(F.col(href)).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "shape").limit(limit))


def line_ups(panels: DataFrame) -> DataFrame:
    """Senates sharing chair, members, agenda and note form one line-up.

    A group holds the senates of one chair: a registry dimension, so the list stays small.
    """
    return panels.groupBy("chair", "members", "agenda", "note").agg(
        F.array_sort(F.collect_set(F.struct("number", "register"))).alias("senates"))


def source_failures(sources: DataFrame, failed: str, limit: float = 0.5) -> DataFrame:
    """One row: share of failed sources and the run status."""
    share = F.avg(F.col(failed).cast("int"))
    return sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col(failed)).alias("failed"),
                       F.when(share > limit, "error").otherwise("ok").alias("status"))


def run_health(found: DataFrame, previous: DataFrame, source: str) -> DataFrame:
    """Per source: found, new, put off, and the warnings that follow from them."""
    per = found.groupBy(source).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("is_new")).alias("new"),
        F.count_if(F.col("deferred")).alias("deferred"))
    both = previous.select(source, F.col("found").alias("_before")).join(per, source, "full_outer").fillna(
        0, ["found", "new", "deferred"])
    warning = (F.when((F.col("deferred") > 0) & (F.col("new") == 0), "only deferred")
               .when((F.col("found") == 0) & (F.col("_before") == 0), "empty twice").otherwise(""))
    return both.select(source, "found", "new", "deferred", warning.alias("warning"))


def run_report(found: DataFrame, errors: DataFrame, previous: DataFrame, source: str) -> DataFrame:
    """Health of every source after a run, to be kept as ``previous`` of the next one.

    found(source, is_new, deferred) one row per item, errors(source, error) any number of rows, previous(source, found,
    error) one row per source.  A source that found nothing twice is suspicious only if no error explains either run.
    Sources of all three inputs are reported; errors are counted and shown by the first one in text order.
    """
    zero = F.lit(0).cast("bigint")
    facts = found.select(source, F.lit(1).alias("one"), F.col("is_new").cast("int").alias("new"), F.col("deferred").cast("int").alias("late"),
                         F.lit(None).cast("string").alias("error"))
    facts = facts.unionByName(errors.select(source, F.lit(0).alias("one"), F.lit(0).alias("new"), F.lit(0).alias("late"), "error"))
    now = facts.groupBy(source).agg(F.sum("one").alias("found"), F.sum("new").alias("new"), F.sum("late").alias("deferred"),
                                    F.count("error").alias("errors"), F.min("error").alias("error"))
    before = previous.select(source, F.col("found").alias("_found"), F.col("error").alias("_error"))
    both = before.join(now, source, "full_outer").withColumns({n: F.coalesce(n, zero) for n in ("found", "new", "deferred", "errors")})
    calm = (F.col("errors") == 0) & missing(F.col("_error"))
    warning = (F.when((F.col("deferred") > 0) & (F.col("new") == 0), "only deferred")
               .when((F.col("found") == 0) & (F.col("_found") == 0) & calm, "empty twice").otherwise(""))
    return both.select(source, "found", "new", "deferred", "errors", F.coalesce("error", F.lit("")).alias("error"), warning.alias("warning"))


def tri_state(selected: DataFrame, option: str, holder: str, holders: int) -> DataFrame:
    """Option selected for all, some or none of the holders."""
    n = F.count_if(F.col("selected"))
    return selected.groupBy(option).agg(
        F.when(n == holders, "true").when(n > 0, "mixed").otherwise("false").alias("state"), n.alias("chosen"))


def newest_catch(items: DataFrame, run_starts: DataFrame, now: Column, seen: str = "first_seen",
                 run_hours: int = 16, max_hours: int = 48) -> DataFrame:
    """Flag the latest catch: within 16 h of the newest sighting or run, and of the last 48 h."""
    latest = (items.select(F.max(seen).alias("m")).unionByName(run_starts.select(F.max("started").alias("m")))
              .agg(F.max("m"))).scalar()
    start = F.greatest(latest - F.expr(f"INTERVAL {run_hours} HOURS"), now - F.expr(f"INTERVAL {max_hours} HOURS"))
    return items.withColumn("newest", F.coalesce(F.col(seen) >= start, F.lit(False)))


def facet_counts(items: DataFrame, source: str, facets: dict[str, Column]) -> DataFrame:
    return items.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in facets.items()])
