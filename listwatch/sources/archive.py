"""Month-partitioned archive of records, its id index, and publishing only what changed."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from listwatch.functions.dates import month_key
from listwatch.functions.text import missing
from listwatch.operators.report import fingerprint
from listwatch.session import materialise
from listwatch.sources.keyed import KeyedTable


def read_archive(spark: SparkSession, root: str, schema: T.StructType, months: list[str] | None = None,
                 first: str | None = None, last: str | None = None) -> DataFrame:
    """Archive rows; a list or range of months prunes the partitions that are read."""
    df = spark.read.schema(schema).json(root)
    if months is not None:
        df = df.where(F.col("month").isin(*months))
    if first is not None:
        df = df.where(F.col("month") >= first)
    if last is not None:
        df = df.where(F.col("month") <= last)
    return df


def recent_months(now: Column, count: int = 3) -> Column:
    """The month of ``now`` and those before it."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: month_key(F.add_months(F.trunc(now, "MM"), -i)))


def route(found: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with the partition they belong to: the indexed month, or that of their first sighting."""
    known = index.select("court", "id", F.col("month").alias("_m"))
    return found.join(known, ["court", "id"], "left").withColumn(
        "month", F.coalesce("_m", month_key(F.col("first_seen")))).drop("_m")


def _partitions(rows: DataFrame) -> list[tuple[str, str]]:
    """The (court, month) partitions of some rows: never more than the folders of the archive, which
    listing it brings to the driver anyway."""
    return [(r["court"], r["month"]) for r in rows.select("court", "month").distinct().collect()]


def _only(df: DataFrame, pairs) -> DataFrame:
    """Rows of the listed (court, month) partitions, as a filter that prunes the scan."""
    by_court: dict[str, list[str]] = {}
    for court, month in pairs:
        by_court.setdefault(court, []).append(month)
    tests = [(F.col("court") == c) & F.col("month").isin(*sorted(m)) for c, m in sorted(by_court.items())]
    return df.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def upsert(spark: SparkSession, root: str, schema: T.StructType, rows: DataFrame, index_root: str) -> int:
    """Append new rows and replace known ones, rewriting only the partitions they fall into.

    ``rows`` hold one row per id with ``court``, ``id`` and ``first_seen``.  Rows of a partition are
    spread by id ranges, so a partition with a large share of the archive becomes several sorted
    files.  Returns the number of rewritten partitions.
    """
    index = id_index(index_root)
    # The batch is read several times below, and the index it depends on is about to change.
    rows = materialise(rows)
    known = index.before(spark, buckets=index.touched(rows))
    routed = materialise(route(rows, known))
    dirty = _partitions(routed)
    if not dirty:
        return 0
    columns = [f.name for f in schema]
    incoming = routed.select(*columns)
    if _exists(spark, root):
        kept = _only(read_archive(spark, root, schema), dirty).join(incoming.select("court", "id"), ["court", "id"], "left_anti")
        incoming = kept.select(*columns).unionByName(incoming)
    # The index is written first: an interrupted run leaves ids that the next run still replaces in place.
    index.replace(routed.join(known.select("court", "id"), ["court", "id"], "left_anti"), index.next_version(spark))
    (incoming.repartitionByRange("court", "month", "id").sortWithinPartitions("court", "month", "id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("court", "month").json(root))
    return len(dirty)


def id_index(root: str) -> KeyedTable:
    """The month of every id, in buckets by (court, id)."""
    return KeyedTable(root, ["court", "id"], "court string, id string, month string")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return id_index(root).read(spark)


def lookup(spark: SparkSession, root: str, schema: T.StructType, index_root: str, ids: DataFrame) -> DataFrame:
    """Records by id, whatever their age: the index buckets of the ids name the partitions, only those are read."""
    index = id_index(index_root)
    wanted = index.before(spark, buckets=index.touched(ids)).join(ids.select("court", "id"), ["court", "id"], "left_semi")
    return _only(read_archive(spark, root, schema), _partitions(wanted)).join(ids.select("court", "id"), ["court", "id"], "left_semi")


def window_rows(archive: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """Published window: first seen from ``start`` (before ``end``), not replaced."""
    seen = F.col("first_seen")
    inside = (seen >= start) & missing(F.col("replaced_by"))
    return archive.where(inside if end is None else inside & (seen < end))


def publish(df: DataFrame, root: str, dataset: str, volatile: tuple[str, ...] = ("generated",)) -> bool:
    """Replace a published dataset unless its content, volatile columns aside, is what is there.

    Each dataset is one partition, so readers see either the old or the new files.  True when written.
    """
    spark = df.sparkSession
    stable = sorted(c for c in df.columns if c not in volatile)
    if _exists(spark, root):
        old = spark.read.schema(T.StructType([*df.schema, T.StructField("dataset", T.StringType())])).parquet(root).where(
            F.col("dataset") == dataset)
        if fingerprint(_flat(old, stable), stable).first() == fingerprint(_flat(df, stable), stable).first():
            return False
    (df.withColumn("dataset", F.lit(dataset)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset").parquet(root))
    return True


def _flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as text; nested ones as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[(F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, nested) else F.col(c).cast("string")).alias(c)
                       for c in columns])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
