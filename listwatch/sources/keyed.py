"""Table with one row per key, for state that batches look up and change.

Rows lie in buckets by the hash of their key.  A batch reads the buckets of its keys and writes new
versions of them, so its cost follows the buckets it touches and not the age of the table, and a bucket is
one version long however many batches there were.  The version before the newest stays, so a batch
that runs again reads what it read before and replaces its own files.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from listwatch.session import materialise

NEWEST = 1 << 62


class KeyedTable:
    """Folders ``of=<buckets>/bucket=<b>/version=<v>`` under ``path``.

    The bucket count of an existing table is read from its folder; ``buckets`` is for a new one.  There
    should be so many that a task holds one.  One writer at a time; versions are numbers that grow.
    """

    def __init__(self, path: str, key: list[str], schema: str, buckets: int = 64):
        self.path, self.key, self.schema, self.new_buckets = path, key, schema, buckets

    def buckets(self, spark: SparkSession) -> int:
        found = [int(m[1]) for p in _glob(spark, f"{self.path}/of=*") if (m := re.search("of=([0-9]+)$", p))]
        return min(found, default=self.new_buckets)

    def _bucket(self, spark: SparkSession) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets(spark))).cast("int")

    def versions(self, spark: SparkSession) -> dict[int, list[int]]:
        """The versions of every bucket, oldest first."""
        found: dict[int, list[int]] = {}
        for p in _glob(spark, f"{self.path}/of={self.buckets(spark)}/bucket=*/version=*"):
            bucket, version = map(int, re.search("bucket=([0-9]+)/version=([0-9]+)$", p).groups())
            found.setdefault(bucket, []).append(version)
        return {b: sorted(v) for b, v in found.items()}

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some keys: never more than the table has."""
        return sorted(r[0] for r in rows.select(self._bucket(rows.sparkSession)).distinct().collect())

    def before(self, spark: SparkSession, version: int = NEWEST, buckets: list[int] | None = None) -> DataFrame:
        """Rows as they were before a version, of some buckets or all; other buckets are not opened."""
        schema, root = T.StructType.fromDDL(self.schema), f"{self.path}/of={self.buckets(spark)}"
        paths = [f"{root}/bucket={b}/version={max(older)}" for b, all_ in sorted(self.versions(spark).items())
                 if (buckets is None or b in set(buckets)) and (older := [v for v in all_ if v < version])]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.before(spark)

    def next_version(self, spark: SparkSession) -> int:
        return max((v[-1] for v in self.versions(spark).values()), default=-1) + 1

    def write(self, rows: DataFrame, version: int) -> None:
        """New versions of the buckets that ``rows`` fill; the rows are all that stays in them."""
        spark = rows.sparkSession
        n, names = self.buckets(spark), T.StructType.fromDDL(self.schema).names
        placed = rows.select(*names, self._bucket(spark).alias("bucket"), F.lit(version).cast("bigint").alias("version"))
        # A row per key, so buckets are even.
        (placed.repartition(n, "bucket").sortWithinPartitions("bucket", *self.key).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{self.path}/of={n}"))
        for bucket, versions in self.versions(spark).items():
            for old in versions[:-2]:
                _delete(spark, f"{self.path}/of={n}/bucket={bucket}/version={old}")

    def replace(self, changes: DataFrame, version: int, sweep: int | None = None, keep: Column | None = None) -> list[int]:
        """Put one row per key in place of those there; of the others in the buckets, those with ``keep`` stay.

        ``sweep`` names a bucket to rewrite in any case.  Returns the buckets written.
        """
        changes = materialise(changes.select(*T.StructType.fromDDL(self.schema).names))
        spark, buckets = changes.sparkSession, self.touched(changes)
        if sweep is not None:
            buckets = sorted({*buckets, sweep % self.buckets(spark)})
        old = self.before(spark, version, buckets)
        same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in self.key])
        rest = (old if keep is None else old.where(keep)).alias("o").join(changes.select(*self.key).alias("c"), same, "left_anti")
        self.write(rest.unionByName(changes), version)
        return buckets


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    files, p = _folder(spark, pattern)
    return [s.getPath().toString() for s in files.globStatus(p) or []]


def _delete(spark: SparkSession, path: str) -> None:
    files, p = _folder(spark, path)
    files.delete(p, True)
