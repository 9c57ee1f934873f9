"""Session settings and the checkpoint folder every multi-pass operator relies on."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans assume.  All of them can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Parquet timestamps without a zone are UTC instants here, so filters on them push down.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A key holding a large share of the rows is split at run time, even when that costs a shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Texts may be long: a batch for Python holds few of them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Top-k per group cuts every map task to k rows before the shuffle, up to this k.
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
}


#: File bytes and rows that a task has at most after ``spread``, where these make more tasks than there are cores.
TASK_BYTES = 4 << 20
TASK_ROWS = 50_000


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; invent one only for a local session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.split("[")[0] == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="listwatch-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before using this operator")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """New folder next to the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Input for CPU-heavy parsing, split over all cores and into tasks of bounded size, the rows are the same either way.

    The splits of files say little: a split in which no row group begins is empty, and another one has the rows.  Nor do their
    bytes alone, as values that repeat take little room.  The rows are counted in the files' footers.
    """
    cores, size = df.sparkSession.sparkContext.defaultParallelism, _file_bytes(df)
    return df.repartition(max(cores, -(-size // TASK_BYTES), -(-df.count() // TASK_ROWS)))


def _file_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
