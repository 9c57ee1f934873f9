"""State between runs: first-seen times, retention, retries, outages, versions."""

from pyspark.sql import functions as F

from listwatch.functions import dates as D
from listwatch.operators import report as R, state as S
from listwatch.plans.registry import Tables, query

TS = "yyyy-MM-dd HH:mm:ss"


def run_time():
    return F.lit("2024-02-05 10:00:00").cast("timestamp")


def event_items(t: Tables):
    guid = F.concat_ws("-", "user_id", "event_type", F.date_format("ts", "MMdd"))
    return t.events.select("event_id", guid.alias("guid"), "ts")


@query("j1_first_seen", "J1 F3 T2 F7", sql="""
WITH items AS (SELECT event_id, user_id || '-' || event_type || '-' || strftime(ts, '%m%d') AS guid, ts FROM events),
state AS (SELECT guid, min(ts) AS fs FROM items WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
assigned AS (
  SELECT guid, CASE WHEN date_trunc('day', ts) + INTERVAL 12 HOUR < TIMESTAMP '2024-02-05 10:00:00' - INTERVAL 14 DAY
    THEN date_trunc('day', ts) + INTERVAL 12 HOUR ELSE TIMESTAMP '2024-02-05 10:00:00' END AS a FROM items),
seen AS (SELECT g.guid, coalesce(s.fs, g.a) AS fs, s.fs IS NOT NULL AS known
  FROM (SELECT guid, min(a) AS a FROM assigned GROUP BY 1) g LEFT JOIN state s USING (guid))
SELECT event_id, guid, strftime(fs, '%Y-%m-%d %H:%M:%S') AS first_seen, known,
  fs >= TIMESTAMP '2024-02-04 10:00:00' AS is_new
FROM items JOIN seen USING (guid) WHERE fs >= TIMESTAMP '2024-02-05 10:00:00' - INTERVAL 25 DAY""")
def first_seen(t):
    items = event_items(t)
    state = items.where(F.col("ts") < "2024-01-16").groupBy("guid").agg(F.min("ts").alias("first_seen"))
    assigned = S.assigned_first_seen(F.col("ts").cast("date"), run_time())
    seen = S.with_first_seen(items, state, "guid", assigned)
    return S.in_window(seen, run_time(), 25).select(
        "event_id", "guid", F.date_format("first_seen", TS).alias("first_seen"), "known", "is_new")


@query("f1_window_bounds", "F1 F2 X27 X6", sql="""
WITH m AS (SELECT o_orderkey, o_orderdate + INTERVAL '22 hours 30 minutes' AS now FROM orders),
l AS (SELECT o_orderkey, date_trunc('month', timezone('Europe/Prague', now AT TIME ZONE 'UTC')) AS first FROM m)
SELECT strftime(timezone('UTC', timezone('Europe/Prague', first - INTERVAL 1 MONTH)), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(timezone('UTC', timezone('Europe/Prague', first - INTERVAL 2 MONTH)), '%Y-%m-%d %H:%M:%S') AS older_start,
  strftime(first - INTERVAL 1 DAY, '%Y-%m-%d') AS last_day, strftime(first - INTERVAL 1 MONTH, '%Y-%m') AS month,
  count(*) AS n
FROM l GROUP BY ALL""")
def window_bounds(t):
    now = F.col("o_orderdate") + F.expr("INTERVAL '22:30' HOUR TO MINUTE")
    month = D.previous_month(now)
    return t.orders.groupBy(
        F.date_format(D.window_start(now), TS).alias("window_start"),
        F.date_format(D.older_window_start(now), TS).alias("older_start"),
        F.date_format(month["last_day"], "yyyy-MM-dd").alias("last_day"),
        F.date_format(month["first_day"], "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("f4_half_open_period", "F4 F2", sql="""
SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2023-12-31 23:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00') AS inside,
  count(*) FILTER (WHERE value IS NULL OR value < 5 OR (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20')) AS with_unknown,
  count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-20' + INTERVAL 1 DAY) AS not_future
FROM events GROUP BY 1""")
def half_open_period(t):
    def at(s):
        return F.lit(s).cast("timestamp")
    known = F.when(F.col("value") >= 5, F.col("ts"))
    return t.events.groupBy("event_type").agg(
        F.count_if(D.in_period(F.col("ts"), at("2023-12-31 23:00:00"), at("2024-01-15"))).alias("inside"),
        F.count_if(D.in_period(known, at("2024-01-10"), at("2024-01-20"))).alias("with_unknown"),
        F.count_if(F.col("ts") <= at("2024-01-20") + F.expr("INTERVAL 1 DAY")).alias("not_future"))


@query("f7_state_retention", "F7", sql="""
WITH s AS (SELECT user_id || '-' || event_type AS guid, event_type, max(ts) AS fs FROM events GROUP BY 1, 2)
SELECT guid, strftime(fs, '%Y-%m-%d %H:%M:%S') AS first_seen FROM s
WHERE event_type <> 'error' AND fs >= TIMESTAMP '2024-05-28 00:00:00' - INTERVAL 120 DAY""")
def state_retention(t):
    guid = F.concat_ws("-", "user_id", "event_type").alias("guid")
    state = t.events.groupBy(guid, "event_type").agg(F.max("ts").alias("fs")).select(
        "guid", F.when(F.col("event_type") == "error", "unreadable").otherwise(
            F.col("fs").cast("string")).alias("first_seen"))
    kept = S.prune_state(state, F.lit("2024-05-28 00:00:00").cast("timestamp"))
    return kept.select("guid", F.date_format(F.col("first_seen").cast("timestamp"), TS).alias("first_seen"))


@query("f7_cache_retention", "F7", sql="""
WITH s AS (SELECT user_id, max(ts) AS fs FROM events GROUP BY 1)
SELECT event_id, user_id FROM events JOIN s USING (user_id)
WHERE fs >= TIMESTAMP '2024-05-29 12:00:00' - INTERVAL 120 DAY""")
def cache_retention(t):
    state = t.events.groupBy("user_id").agg(F.max("ts").alias("first_seen"))
    return S.prune_cache(t.events.select("event_id", "user_id"), state, "user_id",
                         F.lit("2024-05-29 12:00:00").cast("timestamp"))


LAUNCH_SQL = """
WITH params AS (SELECT TIMESTAMP '2024-03-20 12:00:00' AS now),
e AS (SELECT event_id, user_id, ts, event_type = 'signup' AS estimated, ts < TIMESTAMP '2024-01-03' AS in_state FROM events),
registry AS (SELECT user_id, date_trunc('day', min(ts)) + INTERVAL 76 DAY AS introduced FROM e GROUP BY 1),
launch AS (SELECT r.user_id FROM registry r, params WHERE introduced > now - INTERVAL 3 DAY
  OR r.user_id NOT IN (SELECT user_id FROM e WHERE in_state)),
unknown AS (SELECT * FROM e WHERE NOT in_state),
bulk AS (SELECT user_id, count(*) AS unknown,
  count(*) FILTER (WHERE NOT estimated AND ts < now - INTERVAL 60 DAY) AS old FROM unknown, params GROUP BY 1)
"""


def launch_inputs(t):
    now = F.lit("2024-03-20 12:00:00").cast("timestamp")
    e = t.events.select("event_id", F.col("user_id").alias("source"), F.col("ts").alias("published"),
                        (F.col("event_type") == "signup").alias("estimated"))
    known = F.col("published") < "2024-01-03"
    registry = e.groupBy("source").agg(
        (F.date_trunc("day", F.min("published")) + F.expr("INTERVAL 76 DAYS")).alias("introduced"))
    return now, e.where(~known), registry, e.where(known).select("source")


@query("a7_bulk_returns", "A7", sql=LAUNCH_SQL + """
SELECT user_id AS source, unknown, old, unknown >= 5 AND old * 2 > unknown AS bulk FROM bulk""")
def bulk_returns(t):
    now, unknown, _, _ = launch_inputs(t)
    return S.bulk_returns(unknown, now)


@query("a8_launching_sources", "A8", sql=LAUNCH_SQL + "SELECT DISTINCT user_id AS source FROM launch")
def launching(t):
    now, _, registry, state = launch_inputs(t)
    return S.launching(registry, state, now)


@query("t4_backdated_first_seen", "T4 A7 A8", sql=LAUNCH_SQL + """
SELECT u.event_id, strftime(CASE
    WHEN b.unknown >= 5 AND b.old * 2 > b.unknown AND NOT estimated AND ts < now - INTERVAL 60 DAY THEN now - INTERVAL 15 DAY
    WHEN l.user_id IS NULL THEN now
    WHEN NOT estimated AND ts >= now - INTERVAL 3 DAY THEN now
    ELSE now - INTERVAL 15 DAY END, '%Y-%m-%d %H:%M:%S') AS first_seen
FROM unknown u JOIN bulk b USING (user_id) LEFT JOIN (SELECT DISTINCT user_id FROM launch) l USING (user_id), params""")
def backdated(t):
    now, unknown, registry, state = launch_inputs(t)
    launch = S.launching(registry, state, now).withColumn("launch", F.lit(True))
    flagged = (unknown.join(S.bulk_returns(unknown, now).select("source", "bulk"), "source")
               .join(launch, "source", "left"))
    seen = S.backdated_first_seen(F.col("published"), F.col("estimated"), F.col("launch"), F.col("bulk"), now)
    return flagged.select("event_id", F.date_format(seen, TS).alias("first_seen"))


@query("t3_look_back", "T3", sql="""
SELECT n_nationkey, strftime(DATE '2024-03-01' - CASE WHEN count(c_custkey) = 0 THEN 7 ELSE 10 END, '%Y-%m-%d') AS search_from,
  count(c_custkey) AS known
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < -900 GROUP BY 1""")
def look_back(t):
    known = t.customer.where(F.col("c_acctbal") < -900).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count("*").alias("known"))
    per = t.nation.select("n_nationkey").join(known, "n_nationkey", "left").fillna(0, ["known"])
    first = S.look_back(F.col("known") == 0, F.lit("2024-03-01").cast("date"))
    return per.select("n_nationkey", F.date_format(first, "yyyy-MM-dd").alias("search_from"), "known")


@query("t5_retry_state", "T5", sql="""
WITH r AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS INTEGER) % 8 AS f,
    CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_custkey % 9 AS INTEGER) END AS w,
    o_orderpriority IN ('1-URGENT', '2-HIGH') AS was_text, o_orderstatus <> 'P' AS for_text, o_orderdate AS now FROM orders),
d AS (SELECT o_orderkey, now, for_text,
    CASE WHEN w IS NULL THEN CASE WHEN was_text THEN f ELSE 0 END ELSE w END + CASE WHEN for_text THEN 1 ELSE 0 END AS waits,
    CASE WHEN w IS NULL AND was_text THEN 0 ELSE f END + CASE WHEN for_text THEN 0 ELSE 1 END AS fails FROM r),
h AS (SELECT *, CAST(least(2 ** (CASE WHEN for_text THEN waits ELSE fails END - 1), 20) AS INTEGER) AS hours FROM d)
SELECT o_orderkey, fails AS failures, waits AS text_waits, hours,
  strftime(now + to_hours(hours), '%Y-%m-%d %H:%M:%S') AS next_attempt FROM h""")
def retry_state(t):
    failures = F.floor("o_totalprice").cast("int") % 8
    waits = F.when(F.col("o_orderstatus") != "F", (F.col("o_custkey") % 9).cast("int"))
    last = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), S.NO_TEXT).otherwise("ai-selhani")
    reason = F.when(F.col("o_orderstatus") != "P", S.NO_TEXT).otherwise("ai-selhani")
    s = S.defer(failures, waits, last, reason, F.col("o_orderdate"))
    return t.orders.select("o_orderkey", s.alias("s")).select(
        "o_orderkey", "s.failures", "s.text_waits", "s.hours",
        F.date_format("s.next_attempt", TS).alias("next_attempt"))


@query("f8_needs_enrichment", "F8", sql="""
WITH r AS (SELECT o_orderkey, o_orderstatus = 'P' AS replaced, o_totalprice > 200000 AS has_summary,
    CAST(o_custkey % 4 AS INTEGER) AS pv, CAST(floor(o_totalprice) AS INTEGER) % 8 AS f,
    o_orderstatus = 'F' AS legacy, o_orderpriority IN ('1-URGENT', '2-HIGH') AS was_text,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS due FROM orders)
SELECT o_orderkey FROM r WHERE NOT replaced AND NOT (has_summary AND pv >= 2)
  AND CASE WHEN was_text AND legacy THEN 0 ELSE f END < 6 AND (due IS NULL OR due <= TIMESTAMP '1999-01-01')""")
def needs_enrichment(t):
    last = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), S.NO_TEXT).otherwise("ai-selhani")
    need = S.needs_enrichment(
        F.col("o_orderstatus") == "P", F.col("o_totalprice") > 200000, (F.col("o_custkey") % 4).cast("int"),
        F.floor("o_totalprice").cast("int") % 8, F.when(F.col("o_orderstatus") != "F", 1), last,
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")),
        F.lit("1999-01-01").cast("timestamp"), 2)
    return t.orders.where(need).select("o_orderkey")


@query("t6_outage_status", "T6", sql="""
WITH c AS (SELECT user_id, ts, event_type <> 'error' AS ok FROM events),
p AS (SELECT user_id, max(ts) FILTER (WHERE ok) AS last_ok, max(ts) AS last_check FROM c GROUP BY 1),
d AS (SELECT c.user_id, min(ts) AS since FROM c JOIN p USING (user_id) WHERE NOT ok AND (last_ok IS NULL OR ts > last_ok) GROUP BY 1)
SELECT user_id, coalesce(strftime(since, '%Y-%m-%d %H:%M:%S'), '') AS down_since,
  CASE WHEN since IS NULL THEN 'ok' WHEN last_check < since + INTERVAL 36 HOUR THEN 'warning' ELSE 'error' END AS status
FROM p LEFT JOIN d USING (user_id)""")
def outages(t):
    checks = t.events.select("user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return S.outage_status(checks, "user_id", "ts", "ok").select(
        "user_id", F.coalesce(F.date_format("down_since", TS), F.lit("")).alias("down_since"), "status")


@query("t7_deferred_records", "T7", sql="""
SELECT source, count(*) FILTER (WHERE NOT put_off) AS stored, count(*) FILTER (WHERE put_off) AS deferred
FROM (SELECT source, l.doc_id IS NULL AND n_chars < 600 AS put_off FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def deferred(t):
    found = t.documents.select("doc_id", "source", "n_chars").join(
        t.labels.select("doc_id", F.lit("2024-01-01").alias("published")), "doc_id", "left")
    stored, put_off = S.split_deferred(found, "published", F.col("n_chars") < 600)
    both = stored.select("source", F.lit(1).alias("s"), F.lit(0).alias("d")).unionByName(
        put_off.select("source", F.lit(0).alias("s"), F.lit(1).alias("d")))
    return both.groupBy("source").agg(F.sum("s").alias("stored"), F.sum("d").alias("deferred"))


@query("t9_verdict_cache", "T9", sql="""
WITH v AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'person' WHEN 'FURNITURE' THEN 'unknown' ELSE 'company' END AS verdict,
  c_acctbal > 9500 AS manual, DATE '2024-01-01' + CAST(c_custkey % 30 AS INTEGER) AS seen_on, 'v' || (c_nationkey % 3) AS version FROM customer)
SELECT c_custkey, verdict FROM v WHERE verdict = 'person' OR manual
  OR (verdict = 'company' AND seen_on > DATE '2024-01-31' - 7 AND version = 'v1')""")
def verdict_cache(t):
    verdict = (F.when(F.col("c_mktsegment") == "BUILDING", "person")
               .when(F.col("c_mktsegment") == "FURNITURE", "unknown").otherwise("company"))
    cache = t.customer.select(
        "c_custkey", verdict.alias("verdict"), (F.col("c_acctbal") > 9500).alias("manual"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")).alias("asof"),
        F.concat(F.lit("v"), F.col("c_nationkey") % 3).alias("version"))
    return S.valid_verdicts(cache, F.lit("2024-01-31").cast("date"), "v1").select("c_custkey", "verdict")


@query("t10_regenerate_reason", "T10", sql="""
WITH o AS (SELECT o_custkey,
    max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS generated,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS blocks, bool_or(o_totalprice > 490000) AS failed,
    min(o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS prev_period, min(o_orderpriority) AS period,
    count(*) FILTER (WHERE o_orderstatus = 'F') AS prev_pending, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending,
    CAST(max(o_orderkey) % 12 AS INTEGER) AS dom FROM orders GROUP BY 1)
SELECT o_custkey, coalesce(CASE WHEN generated IS NULL THEN 'none yet' WHEN blocks = 0 THEN 'empty' WHEN failed THEN 'failed'
  WHEN prev_period IS DISTINCT FROM period THEN 'other period'
  WHEN prev_pending > 0 AND blocks <> pending AND NOT (pending >= prev_pending OR dom > 7) THEN 'pending shrank' END, '') AS reason FROM o""")
def regenerate(t):
    is_f = F.col("o_orderstatus") == "F"
    o = t.orders.groupBy("o_custkey").agg(
        F.max(F.when(is_f, F.col("o_orderdate"))).alias("generated"),
        F.count_if(F.col("o_orderstatus") == "P").alias("blocks"),
        F.bool_or(F.col("o_totalprice") > 490000).alias("failed"),
        F.min(F.when(is_f, F.col("o_orderpriority"))).alias("prev_period"), F.min("o_orderpriority").alias("period"),
        F.count_if(is_f).alias("prev_pending"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"),
        (F.max("o_orderkey") % 12).cast("int").alias("dom"))
    reason = S.regenerate_reason(
        {"generated": F.col("generated"), "blocks": F.col("blocks"), "failed": F.col("failed"),
         "period": F.col("prev_period"), "pending": F.col("prev_pending"), "fingerprint": F.col("blocks")},
        {"period": F.col("period"), "pending": F.col("pending"), "fingerprint": F.col("pending")}, F.col("dom"))
    return o.select("o_custkey", F.coalesce(reason, F.lit("")).alias("reason"))


SETS_SQL = """
WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority AS m FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT o_custkey, o_orderpriority AS m FROM orders WHERE o_orderstatus <> 'F'),
x AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS k, a.m AS am, b.m AS bm FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.m = b.m),
c AS (SELECT k, count(am) AS old_size, count(bm) AS new_size, count(*) FILTER (WHERE am IS NULL OR bm IS NULL) AS difference FROM x GROUP BY 1),
s AS (SELECT *, old_size > 0 AND difference > greatest(3, old_size // 2) AS large FROM c)
"""


def member_sets(t):
    members = t.orders.select("o_custkey", F.col("o_orderpriority").alias("m"), "o_orderstatus")
    is_f = F.col("o_orderstatus") == "F"
    return members.where(is_f), members.where(~is_f)


@query("a18_set_change", "A18 U3", sql=SETS_SQL + "SELECT k AS o_custkey, old_size, new_size, difference, large FROM s")
def set_change(t):
    old, new = member_sets(t)
    return S.set_change(old, new, ["o_custkey"], "m")


@query("t11_version_guard", "T11 A18", sql=SETS_SQL + """,
cur AS (SELECT o_custkey AS k, max(o_orderdate) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
off AS (SELECT o_custkey AS k, max(o_orderdate) FILTER (WHERE o_totalprice > 100000) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT off.k AS o_custkey, CASE WHEN off.v IS NULL AND cur.v IS NOT NULL THEN 'no date' WHEN off.v <= cur.v THEN 'not newer'
  WHEN large THEN 'too different' ELSE 'accept' END AS decision
FROM off LEFT JOIN cur USING (k) LEFT JOIN s USING (k)""")
def version_guard(t):
    old, new = member_sets(t)
    is_f = F.col("o_orderstatus") == "F"
    current = t.orders.where(is_f).groupBy("o_custkey").agg(F.max("o_orderdate").alias("valid_from"))
    offered = t.orders.where(~is_f).groupBy("o_custkey").agg(
        F.max(F.when(F.col("o_totalprice") > 100000, F.col("o_orderdate"))).alias("valid_from"))
    change = S.set_change(old, new, ["o_custkey"], "m")
    return S.accept_versions(current, offered, "o_custkey", change).select("o_custkey", "decision")


@query("t12_changed_snapshots", "T12 A10", sql="""
WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority AS m FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT o_custkey, o_orderpriority AS m FROM orders WHERE o_orderstatus <> 'F'),
x AS (SELECT o_custkey, list_sort(list(m)) AS l FROM a GROUP BY 1), y AS (SELECT o_custkey, list_sort(list(m)) AS l FROM b GROUP BY 1)
SELECT y.o_custkey, CAST(len(y.l) AS BIGINT) AS rows FROM y LEFT JOIN x USING (o_custkey) WHERE x.l IS NULL OR x.l <> y.l""")
def changed_snapshots(t):
    old, new = member_sets(t)
    known = R.fingerprint(old.select("o_custkey", "m").distinct(), ["m"], ["o_custkey"])
    fresh = R.fingerprint(new.select("o_custkey", "m").distinct(), ["m"], ["o_custkey"])
    return S.changed_snapshots(fresh, known, ["o_custkey"], "fingerprint").select("o_custkey", "rows")


@query("t14_heading_rewrite", "T14", sql="""
WITH d AS (SELECT doc_id, CAST(n_chars % 5 AS INTEGER) AS version, CAST(n_chars % 3 AS INTEGER) AS tries,
  quality IS NOT NULL AS offered, coalesce(quality = 1, false) AS good FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN (offered AND good) OR tries + 1 >= 2 THEN 4 ELSE version END AS version,
  CASE WHEN (offered AND good) OR tries + 1 >= 2 THEN 0 ELSE tries + 1 END AS tries, offered AND good AS use_offered
FROM d WHERE version < 4""")
def heading_rewrite(t):
    d = t.documents.select("doc_id", (F.col("n_chars") % 5).cast("int").alias("version"),
                           (F.col("n_chars") % 3).cast("int").alias("tries")).join(
        t.labels.select("doc_id", "quality"), "doc_id", "left").where(F.col("version") < 4)
    s = S.heading_versions(F.col("version"), F.col("tries"), F.col("quality"), F.col("quality") == 1, 4)
    return d.select("doc_id", s.alias("s")).select("doc_id", "s.version", "s.tries", "s.use_offered")
