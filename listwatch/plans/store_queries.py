"""Archives, published datasets, dimension files and streaming jobs over the driver tables.

Each query writes into a folder of its own next to the session's checkpoints and reads it back.
"""

from pyspark.sql import functions as F, types as T

from listwatch.functions.text import distinct_ignoring_case
from listwatch.plans.registry import Tables, query
from listwatch.session import scratch_dir
from listwatch.sources import archive as AR, dims as DI
from listwatch.sources.keyed import KeyedTable
from listwatch.streaming import jobs as J

SECOND = "yyyy-MM-dd HH:mm:ss"


def archive_schema() -> T.StructType:
    text = [T.StructField(n, T.StringType()) for n in ("id", "name")]
    return T.StructType([*text, T.StructField("first_seen", T.TimestampType()), T.StructField("court", T.StringType()),
                         T.StructField("month", T.StringType())])


def archived_orders(t: Tables, twice: bool = False) -> tuple[str, str]:
    """Archive of the orders; with ``twice``, a first run that knows only the finished ones precedes."""
    place = scratch_dir(t.spark, "archive")
    root, index = f"{place}/records", f"{place}/index"
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus", F.col("o_custkey").cast("string").alias("name"),
                           F.col("o_orderdate").alias("first_seen"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("court"))
    first = rows.where(F.col("o_orderstatus") == "F").withColumn("name", F.lit("")).drop("o_orderstatus")
    second = rows.withColumn("first_seen", F.add_months("first_seen", 1).cast("timestamp")).drop("o_orderstatus")
    for batch in (first, second) if twice else (second,):
        AR.upsert(t.spark, root, archive_schema(), batch, index)
    return root, index


ARCHIVE_SQL = """
WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, lower(substr(o_orderpriority, 3, 20)) AS court, CAST(o_custkey AS VARCHAR) AS name,
  strftime(CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE o_orderdate + INTERVAL 1 MONTH END, '%Y-%m') AS month FROM orders)
"""


@query("s2_archive_upsert", "S1 S2 S3", sql=ARCHIVE_SQL + "SELECT id, court, name, month FROM a")
def archive_upsert(t):
    root, _ = archived_orders(t, twice=True)
    return AR.read_archive(t.spark, root, archive_schema()).select("id", "court", "name", "month")


ONCE_SQL = ARCHIVE_SQL.replace("CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE o_orderdate + INTERVAL 1 MONTH END", "o_orderdate + INTERVAL 1 MONTH")


@query("s3_archive_lookup", "S3 S1", sql=ONCE_SQL + "SELECT id, court, month FROM a JOIN customer ON c_name = 'Customer#' || lpad(name, 9, '0') WHERE c_mktsegment = 'BUILDING'")
def archive_lookup(t):
    root, index = archived_orders(t)
    wanted = t.orders.join(t.customer.where(F.col("c_mktsegment") == "BUILDING"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("id"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("court"))
    return AR.lookup(t.spark, root, archive_schema(), index, wanted).select("id", "court", "month")


@query("s21_window_export", "S21 S1 S4 F1", sql=ONCE_SQL + "SELECT id, court, month FROM a WHERE month BETWEEN '1998-03' AND '1998-05'")
def window_export(t):
    root, _ = archived_orders(t)
    kept = AR.read_archive(t.spark, root, archive_schema(), first="1998-03", last="1998-05")
    out = f"{scratch_dir(t.spark, 'export')}/window"
    written = AR.publish(kept, out, "all")
    again = AR.publish(kept.withColumn("name", F.col("name")), out, "all")
    if not written or again:
        raise AssertionError("an unchanged window must be published exactly once")
    return t.spark.read.parquet(out).select("id", "court", "month")


@query("s20_taxonomy_file", "S20 P8", sql="SELECT 'N' || n_nationkey AS id, n_name AS name, r_name AS \"group\", n_nationkey < 5 AS is_default FROM nation JOIN region ON n_regionkey = r_regionkey")
def taxonomy_file(t):
    # The taxonomy is a dimension: one document, as many entries as there are nations.
    entry = F.struct(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("nazev"), F.col("r_name").alias("skupina"),
                     (F.col("n_nationkey") < 5).alias("vychozi"))
    doc = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).agg(
        F.lit(1).alias("verze"), F.collect_list(entry).alias("oblasti"), F.create_map(F.lit("old"), F.lit("N1")).alias("alias"))
    path = f"{scratch_dir(t.spark, 'taxonomy')}/doc"
    doc.write.json(path)
    areas, _ = DI.read_taxonomy(t.spark, path)
    return areas.select("id", "name", "group", "is_default")


@query("p8_tracked_dimensions", "P8", sql="""
SELECT s_nationkey AS court, string_agg(s_name, ',' ORDER BY s_name) FILTER (WHERE s_acctbal >= 0) || '|' || coalesce(string_agg(s_name, ',' ORDER BY s_name) FILTER (WHERE s_acctbal < 0), '') AS line_ups
FROM supplier GROUP BY 1 HAVING count(*) FILTER (WHERE s_acctbal >= 0) > 0""")
def tracked_dimensions(t):
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("s_name"))))
    rich = F.col("s_acctbal") >= 0
    courts = t.supplier.groupBy(F.col("s_nationkey").alias("court")).agg(
        F.array(F.array_join(names(rich), ",")).alias("line_ups"), F.array(F.array_join(names(~rich), ",")).alias("shown_only"),
        F.count_if(rich).alias("n"), F.lit(None).cast("array<string>").alias("senates"), F.lit(None).cast("array<string>").alias("judges"),
        F.lit("").alias("validity"), F.lit("").alias("schedule_url"))
    return DI.tracked(courts.where("n > 0")).select("court", F.array_join("line_ups", "|").alias("line_ups"))


@query("u6_distinct_names", "U6", sql="""
SELECT p_partkey, CASE WHEN lower(split_part(p_name, ' ', 1)) = lower(p_type) THEN upper(split_part(p_name, ' ', 1)) || ',' || split_part(p_name, ' ', 2)
  ELSE upper(split_part(p_name, ' ', 1)) || ',' || split_part(p_name, ' ', 2) || ',' || p_type END AS names FROM part""")
def distinct_names(t):
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    names = F.array(F.upper(first), first, second, F.initcap(second), F.col("p_type"))
    return t.part.select("p_partkey", F.array_join(distinct_ignoring_case(names), ",").alias("names"))


def run_in_batches(t: Tables, place: str, columns: list, job, batches: int = 3) -> None:
    """The events as inputs that arrive one after another, each a micro-batch that meets the state of those before."""
    low, high = t.events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    step = ((high or 0) - (low or 0)) // batches + 1
    number = F.coalesce(F.floor((F.unix_micros("ts") - F.lit(low)) / F.lit(step)), F.lit(0))
    for k in range(batches):
        t.events.where(number == k).write.mode("append").parquet(f"{place}/in")
        J.run(t.spark.readStream.schema(t.events.schema).parquet(f"{place}/in").select(*columns), job, f"{place}/checkpoint")


@query("t1_streaming_first_seen", "T1 J1", sql="""
SELECT user_id || '-' || event_type AS guid, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, count(*) AS items FROM events GROUP BY 1""")
def streaming_first_seen(t):
    place = scratch_dir(t.spark, "first-seen")
    state = KeyedTable(f"{place}/state", ["guid"], "guid string, first_seen timestamp")
    out = J.EpochTable(f"{place}/out", "event_id bigint, guid string, ts timestamp, first_seen timestamp")
    items = [F.col("event_id"), F.concat_ws("-", "user_id", "event_type").alias("guid"), F.col("ts")]
    run_in_batches(t, place, items, J.first_seen_job(state, out, "guid", lambda df: F.col("ts")))
    return out.read(t.spark).groupBy("guid", F.date_format("first_seen", SECOND).alias("first_seen")).agg(F.count("*").alias("items"))


@query("t5_streaming_retry", "T5", sql="""
WITH o AS (SELECT CAST(user_id AS VARCHAR) AS id, ts, CASE event_type WHEN 'purchase' THEN '' WHEN 'click' THEN 'bez-textu' ELSE 'ai-selhani' END AS reason FROM events),
k AS (SELECT id, max(ts) FILTER (WHERE reason = '') AS ok FROM o GROUP BY 1)
SELECT id, count(*) FILTER (WHERE reason = 'ai-selhani' AND (ok IS NULL OR ts > ok)) AS failures, count(*) FILTER (WHERE reason = 'bez-textu' AND (ok IS NULL OR ts > ok)) AS text_waits
FROM o JOIN k USING (id) GROUP BY 1""")
def streaming_retry(t):
    place = scratch_dir(t.spark, "retry")
    state = KeyedTable(f"{place}/state", ["id"], J.RETRY_STATE)
    reason = F.when(F.col("event_type") == "purchase", "").when(F.col("event_type") == "click", "bez-textu").otherwise("ai-selhani")
    run_in_batches(t, place, [F.col("user_id").cast("string").alias("id"), reason.alias("reason"), F.col("ts").alias("at")], J.retry_job(state))
    return state.read(t.spark).select("id", "failures", "text_waits")


@query("t6_streaming_outage", "T6", sql="""
WITH c AS (SELECT CAST(user_id AS VARCHAR) AS source, ts, event_type <> 'error' AS ok FROM events),
p AS (SELECT source, max(ts) FILTER (WHERE ok) AS last_ok, max(ts) AS last_check FROM c GROUP BY 1),
d AS (SELECT c.source, min(ts) AS since FROM c JOIN p USING (source) WHERE NOT ok AND (last_ok IS NULL OR ts > last_ok) GROUP BY 1)
SELECT source, CASE WHEN since IS NULL THEN 'ok' WHEN last_check < since + INTERVAL 36 HOUR THEN 'warning' ELSE 'error' END AS status FROM p LEFT JOIN d USING (source)""")
def streaming_outage(t):
    place = scratch_dir(t.spark, "outage")
    state = KeyedTable(f"{place}/state", ["source"], J.OUTAGE_STATE)
    checks = [F.col("user_id").cast("string").alias("source"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok")]
    run_in_batches(t, place, checks, J.outage_job(state))
    return state.read(t.spark).select("source", "status")


@query("t8_streaming_change_log", "T8", sql="""
SELECT CAST(user_id AS VARCHAR) AS mark, event_type AS change, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS found FROM events GROUP BY 1, 2""")
def streaming_change_log(t):
    place = scratch_dir(t.spark, "changes")
    state = KeyedTable(f"{place}/state", ["mark", "change"], "mark string, change string, found timestamp")
    changes = [F.col("user_id").cast("string").alias("mark"), F.col("event_type").alias("change"), F.col("ts").alias("found")]
    run_in_batches(t, place, changes, J.change_log_job(state, "found"))
    return state.read(t.spark).select("mark", "change", F.date_format("found", SECOND).alias("found"))
