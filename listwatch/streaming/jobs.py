"""Streaming forms of the stateful operators.

Every job is a ``foreachBatch`` over keyed state: one row per key, in buckets by the hash of the key.  A
batch reads the buckets of its keys as they were before it and writes their next version, so a batch that is run
again after a failure gives the same files, and the state is as large as its keys however many batches it
took.  Rows are reduced per key by aggregates with map-side combine before anything is joined: a
key that fills a batch costs one row.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from listwatch.operators import state as S
from listwatch.session import configure, materialise
from listwatch.sources.archive import _exists
from listwatch.sources.keyed import KeyedTable


class EpochTable:
    """Append-only table with one partition per batch."""

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path, schema

    def before(self, spark: SparkSession, epoch: int) -> DataFrame:
        """Rows of earlier batches."""
        wanted = T.StructType.fromDDL(self.schema).add("epoch", T.LongType())
        if not _exists(spark, self.path):
            return spark.createDataFrame([], wanted)
        return spark.read.schema(wanted).parquet(self.path).where(F.col("epoch") < epoch)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.before(spark, 1 << 62)

    def write(self, df: DataFrame, epoch: int) -> None:
        (df.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(self.path))


def run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that is available and stop."""
    def each(df: DataFrame, epoch: int) -> None:
        configure(df.sparkSession)
        batch(df, epoch)

    (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def _known_first(known: DataFrame, found: DataFrame, key: list[str], at: str) -> DataFrame:
    """One row per key: what is known, else the earliest that was found."""
    both = known.select(*key, at, F.lit(False).alias("new")).unionByName(found.select(*key, at, F.lit(True).alias("new")))
    return both.groupBy(*key).agg(F.min(F.struct("new", at))[at].alias(at))


def first_seen_job(state: KeyedTable, out: EpochTable, guid: str, assigned: Callable[[DataFrame], Column],
                   keep_since: Column | None = None) -> Callable[[DataFrame, int], None]:
    """Items get the time their guid was first seen; the state, keyed by guid, takes in new ones.

    State rows from before ``keep_since`` count as unknown.  They are deleted when their bucket is
    written, and each batch writes one further bucket in turn, so none stays for good.
    """
    def batch(items: DataFrame, epoch: int) -> None:
        spark = items.sparkSession
        items = items.persist()
        found = materialise(items.where(F.coalesce(F.col(guid), F.lit("")) != "").groupBy(guid).agg(F.min(assigned(items)).alias("first_seen")))
        keep = F.lit(True) if keep_since is None else F.col("first_seen") >= keep_since
        known = state.before(spark, epoch, state.touched(found)).where(keep).join(found.select(guid), guid, "left_semi")
        first = materialise(_known_first(known, found, [guid], "first_seen"))
        state.replace(first, epoch, None if keep_since is None else epoch, keep)
        out.write(items.join(first, guid), epoch)
        items.unpersist()

    return batch


RETRY_STATE = "id string, failures bigint, text_waits bigint, next_attempt timestamp, reason string, done boolean, ok_at timestamp"


def retry_job(state: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Retry state from outcomes (id, reason, at); a blank reason is a success and clears it.

    An outcome that comes late, from before the last known success, says nothing new.
    """
    def batch(outcomes: DataFrame, epoch: int) -> None:
        spark = outcomes.sparkSession
        last = state.before(spark, epoch, state.touched(outcomes)).select(
            "id", F.col("ok_at").alias("_ok_at"), *[F.when(F.col("done"), 0).otherwise(F.col(c)).alias(f"_{c}") for c in ("failures", "text_waits")])
        known = last.select(F.col("id").alias("_id"), "_ok_at")
        outcomes = outcomes.join(known, (F.col("id") == F.col("_id")) & (F.col("at") <= F.col("_ok_at")), "left_anti")
        success = F.max(F.when(F.col("reason") == "", F.col("at"))).alias("ok_at")
        ok = outcomes.groupBy("id").agg(success)
        # Only outcomes after the last success of the batch count.
        counted = outcomes.join(ok, "id").where(F.col("reason") != "").withColumn(
            "live", F.col("ok_at").isNull() | (F.col("at") > F.col("ok_at")))
        per = counted.groupBy("id").agg(
            F.count_if(F.col("live") & (F.col("reason") != S.NO_TEXT)).alias("f"), F.count_if(F.col("live") & (F.col("reason") == S.NO_TEXT)).alias("w"),
            F.max_by(F.struct("reason", "at"), F.struct("at", "reason")).alias("l"))
        merged = ok.join(per, "id", "left").join(last, "id", "left")
        base = F.when(F.col("ok_at").isNotNull(), 0).otherwise(1)
        fails = F.coalesce("_failures", F.lit(0)) * base + F.coalesce("f", F.lit(0))
        waits = F.coalesce("_text_waits", F.lit(0)) * base + F.coalesce("w", F.lit(0))
        done = fails + waits == 0
        hours = S.backoff_hours(F.when(F.col("l.reason") == S.NO_TEXT, waits).otherwise(fails))
        state.replace(merged.select(
            "id", fails.cast("bigint").alias("failures"), waits.cast("bigint").alias("text_waits"),
            F.when(~done, F.timestamp_add("HOUR", hours, F.col("l.at"))).alias("next_attempt"),
            F.when(~done, F.col("l.reason")).alias("reason"), done.alias("done"), F.greatest("ok_at", "_ok_at").alias("ok_at")), epoch)

    return batch


OUTAGE_STATE = "source string, last_ok timestamp, last_check timestamp, down_since timestamp, status string"


def outage_job(state: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Per source: since when it is down, warning below 36 hours, then error; cleared by a success."""
    def batch(checks: DataFrame, epoch: int) -> None:
        spark = checks.sparkSession
        before = state.before(spark, epoch, state.touched(checks)).select(
            "source", F.col("last_ok").alias("_ok"), F.col("last_check").alias("_check"), F.col("down_since").alias("_down"))
        # A check that comes late, from before the last known success, says nothing new.
        known = before.select(F.col("source").alias("_source"), F.col("_ok").alias("_last"))
        late = (F.col("source") == F.col("_source")) & (F.col("at") <= F.col("_last"))
        now = S.outage_status(checks.join(known, late, "left_anti"), "source", "at", "ok")
        both = now.join(before, "source", "left")
        ok = F.greatest("last_ok", "_ok")
        carried = F.col("last_ok").isNull() & F.col("_down").isNotNull()
        since = F.when(carried, F.least("_down", "down_since")).otherwise(F.col("down_since"))
        checked = F.greatest("last_check", "_check")
        status = (F.when(since.isNull(), "ok")
                  .when(checked < since + F.expr(f"INTERVAL {S.OUTAGE_HOURS} HOURS"), "warning").otherwise("error"))
        state.replace(both.select("source", ok.alias("last_ok"), checked.alias("last_check"), since.alias("down_since"), status.alias("status")), epoch)

    return batch


def change_log_job(state: KeyedTable, found: str) -> Callable[[DataFrame, int], None]:
    """Change log: every change, a key of the state, is taken in once, with the time it was first found."""
    def batch(changes: DataFrame, epoch: int) -> None:
        fresh = materialise(changes.groupBy(*state.key).agg(F.min(found).alias(found)))
        known = state.before(changes.sparkSession, epoch, state.touched(fresh))
        state.replace(_known_first(known, fresh, state.key, found), epoch)

    return batch
