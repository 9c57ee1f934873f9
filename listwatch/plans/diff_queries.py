"""Snapshot differences, event reconciliation and cross-publisher duplicates."""

from pyspark.sql import functions as F

from listwatch.functions import events as E
from listwatch.operators import diff as X, reconcile as C
from listwatch.plans.registry import Tables, query

SNAP_SQL = """
WITH o AS (SELECT l_orderkey AS k, CAST(l_shipdate AS DATE) AS d, CAST(min(l_linenumber) AS VARCHAR) AS clock, CAST(min(l_suppkey) AS VARCHAR) AS room
  FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2),
n AS (SELECT l_orderkey AS k, CAST(l_shipdate AS DATE) AS d, CAST(min(l_linenumber + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS VARCHAR) AS clock,
    CAST(max(l_suppkey) AS VARCHAR) AS room FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY 1, 2),
l AS (SELECT DISTINCT l_orderkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_returnflag IN ('R', 'N') OR l_linestatus = 'O')
"""


def snapshots(t: Tables):
    lines = t.heavy("lineitem")
    day = F.col("l_shipdate").cast("date").alias("day")
    mark = F.col("l_orderkey").alias("mark")
    late = F.col("l_linenumber") + F.when(F.col("l_quantity") > 25, 1).otherwise(0)
    old = lines.where(F.col("l_returnflag").isin("A", "N")).groupBy(mark, day).agg(
        F.min("l_linenumber").cast("string").alias("clock"), F.min("l_suppkey").cast("string").alias("room"))
    new = lines.where(F.col("l_returnflag").isin("R", "N")).groupBy(mark, day).agg(
        F.min(late).cast("string").alias("clock"), F.max("l_suppkey").cast("string").alias("room"))
    listed = lines.where(F.col("l_returnflag").isin("R", "N") | (F.col("l_linestatus") == "O")).select(mark, day).distinct()
    return old, new, listed


@query("j14_snapshot_diff", "J14 W10", sql=SNAP_SQL + """,
g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM o WHERE (k, d) NOT IN (SELECT k, d FROM l)),
c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM n WHERE (k, d) NOT IN (SELECT k, d FROM o)),
p AS (SELECT coalesce(g.k, c.k) AS k, g.d AS f, c.d AS t, g.clock FROM g FULL JOIN c ON g.k = c.k AND g.i = c.i),
s AS (SELECT o.k, o.d, o.clock AS oc, n.clock AS nc, o.room AS orm, n.room AS nr FROM o JOIN n ON o.k = n.k AND o.d = n.d)
SELECT k AS mark, CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN 'presun' WHEN t IS NULL THEN 'zruseno' ELSE 'nove' END AS change,
  strftime(coalesce(t, f), '%Y-%m-%d') AS day,
  CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN strftime(f, '%Y-%m-%d') ELSE '' END AS was,
  CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN strftime(t, '%Y-%m-%d') ELSE '' END AS becomes,
  CASE WHEN t IS NULL THEN clock ELSE '' END AS clock FROM p
UNION ALL SELECT k, 'cas', strftime(d, '%Y-%m-%d'), oc, nc, '' FROM s WHERE oc <> nc
UNION ALL SELECT k, 'sin', strftime(d, '%Y-%m-%d'), orm, nr, '' FROM s WHERE orm <> nr""")
def snapshot_diff(t):
    old, new, listed = snapshots(t)
    blank = F.lit("")
    return X.snapshot_diff(old, new, listed, ["mark"], carried=("clock",)).select(
        "mark", "change", F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("was", blank).alias("was"),
        F.coalesce("becomes", blank).alias("becomes"), F.coalesce("clock", blank).alias("clock"))


@query("j15_merge_snapshot", "J15 A11", sql="""
WITH e AS (SELECT l_suppkey AS s, l_orderkey AS k, CAST(l_shipdate AS DATE) AS d, CAST(min(l_linenumber) AS VARCHAR) AS clock FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2, 3),
n AS (SELECT l_suppkey AS s, l_orderkey AS k, CAST(l_shipdate AS DATE) AS d, CAST(max(l_linenumber) AS VARCHAR) AS clock,
    bool_or(l_linestatus = 'O') AS rel FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3),
p AS (SELECT s, min(d) + 300 AS a, max(d) - 300 AS b, s % 3 <> 0 AS complete FROM n GROUP BY 1)
SELECT s AS source, k AS mark, strftime(d, '%Y-%m-%d') AS day, clock FROM e LEFT JOIN p USING (s)
WHERE (s, k, d) NOT IN (SELECT s, k, d FROM n) AND NOT coalesce(complete AND d BETWEEN a AND b, false)
UNION ALL SELECT s, k, strftime(d, '%Y-%m-%d'), clock FROM n WHERE rel""")
def merge_snapshot(t):
    from listwatch.operators.calendar import derived_period
    lines = t.heavy("lineitem")
    day = F.col("l_shipdate").cast("date").alias("day")
    key = [F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("mark"), day]
    existing = lines.where(F.col("l_returnflag").isin("A", "N")).groupBy(*key).agg(
        F.min("l_linenumber").cast("string").alias("clock"))
    listed = lines.where(F.col("l_returnflag") == "R").groupBy(*key).agg(
        F.max("l_linenumber").cast("string").alias("clock"), F.bool_or(F.col("l_linestatus") == "O").alias("relevant"))
    periods = derived_period(listed, ["source"], "day").select(
        "source", F.date_add("start", 300).alias("start"), F.date_sub("end", 300).alias("end"),
        (F.col("source") % 3 != 0).alias("complete"))
    return X.merge_snapshot(existing, listed, periods, ["source"]).select(
        "source", "mark", F.date_format("day", "yyyy-MM-dd").alias("day"), "clock")


@query("j15_many_snapshots", "J15", sql="""
WITH p AS (SELECT l_returnflag AS source, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + CAST(l_linenumber % 3 AS INTEGER) AS b FROM lineitem
  WHERE dayofyear(l_shipdate) % 40 < 20 AND l_linestatus = 'F')
SELECT o_orderkey AS mark, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT *, CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS source FROM orders) o
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source = o.source AND CAST(o_orderdate AS DATE) BETWEEN a AND b)""")
def many_snapshots(t):
    """Thousands of snapshots of each source against the rows of its calendar."""
    source = F.when(F.col("o_custkey") % 3 == 0, "A").when(F.col("o_custkey") % 3 == 1, "N").otherwise("R")
    rows = t.orders.select(source.alias("source"), F.col("o_orderkey").alias("mark"), F.col("o_orderdate").cast("date").alias("day"))
    start = F.col("l_shipdate").cast("date")
    periods = t.lineitem.where((F.dayofyear(start) % 40 < 20) & (F.col("l_linestatus") == "F")).select(
        F.col("l_returnflag").alias("source"), start.alias("start"), F.date_add(start, (F.col("l_linenumber") % 3).cast("int")).alias("end"))
    return X.uncovered(rows, periods, ["source"], "day").select("mark", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("j13_carry_over", "J13", sql="""
WITH a AS (SELECT o_custkey AS k, max(o_orderpriority) AS title, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ';') AS parties FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN c_acctbal < 5000 THEN coalesce(a.parties, '') ELSE c_mktsegment END AS parties,
  CASE WHEN c_acctbal < 5000 THEN coalesce(a.title, '') ELSE c_name END AS title FROM customer LEFT JOIN a ON a.k = c_custkey""")
def carry_over(t):
    poor = F.col("c_acctbal") < 5000
    new = t.customer.select(
        "c_custkey", F.when(poor, F.array().cast("array<string>")).otherwise(F.array("c_mktsegment")).alias("parties"),
        F.when(poor, "").otherwise(F.col("c_name")).alias("title"))
    archive = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderpriority").alias("title"), F.sort_array(F.collect_set("o_orderstatus")).alias("parties"))
    return X.carry_over(new, archive, ["c_custkey"]).select(
        "c_custkey", F.array_join("parties", ";").alias("parties"), "title")


CHANGES_SQL = """
WITH c AS (SELECT user_id, event_type, DATE '2024-02-01' + CAST(floor(value) AS INTEGER) % 10 AS day, CAST(ts AS DATE) AS found FROM events),
o AS (SELECT user_id, event_type, day, min(found) AS found FROM c WHERE found >= DATE '2024-02-10' - 30 GROUP BY 1, 2, 3)
"""


def change_log(t: Tables):
    day = F.date_add(F.lit("2024-02-01").cast("date"), F.floor("value").cast("int") % 10)
    return t.events.select("user_id", "event_type", day.alias("day"), F.col("ts").cast("date").alias("found"))


@query("w4_change_log", "W4 T8", sql=CHANGES_SQL + """
SELECT user_id, event_type, strftime(day, '%Y-%m-%d') AS day, strftime(found, '%Y-%m-%d') AS found FROM o
ORDER BY o.found DESC, o.day DESC, user_id, event_type LIMIT 200""")
def change_log_capped(t):
    out = X.trim_changes(change_log(t), ["user_id", "event_type", "day"], "found", "day", F.lit("2024-02-10").cast("date"))
    return out.select("user_id", "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"),
                      F.date_format("found", "yyyy-MM-dd").alias("found"))


@query("t8_whole_change_log", "T8 W4", sql=CHANGES_SQL + """
SELECT user_id, event_type, strftime(day, '%Y-%m-%d') AS day, strftime(found, '%Y-%m-%d') AS found FROM o""")
def change_log_whole(t):
    out = X.trim_changes(change_log(t), ["user_id", "event_type", "day"], "found", "day", F.lit("2024-02-10").cast("date"), cap=None)
    return out.select("user_id", "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"),
                      F.date_format("found", "yyyy-MM-dd").alias("found"))


@query("f25_completeness_gate", "F25", sql="""
WITH p AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_returnflag <> 'R') AS parsed, count(*) AS expected FROM lineitem GROUP BY 1)
SELECT k AS l_orderkey, parsed, expected, parsed >= expected * 0.8 AS complete,
  CASE WHEN expected > 0 AND parsed = 0 THEN 'error' WHEN parsed < expected THEN 'warning' ELSE 'ok' END AS status FROM p""")
def completeness_gate(t):
    p = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("parsed"), F.count("*").alias("expected"))
    return p.select("l_orderkey", "parsed", "expected", X.complete_enough(F.col("parsed"), F.col("expected")).alias("complete"),
                    X.reported_total(F.col("parsed"), F.col("expected")).alias("status"))


EVENTS_SQL = """
WITH ev AS (SELECT o_orderpriority AS org, 'e' || o_orderkey AS id, 'https://x.example/' || (o_orderkey // 2) AS url, make_date(year(o_orderdate), 1, 1) AS d,
    CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN '' ELSE 'title ' || o_orderstatus || o_custkey END AS title,
    CASE WHEN o_totalprice > 250000 THEN 'place' || o_orderkey ELSE '' END AS place, o_orderstatus AS st, o_totalprice AS tp, o_custkey AS ck FROM orders),
old AS (SELECT org, id, url, d, title, place, 'note ' || ck AS note, CASE WHEN ck % 3 = 0 THEN d + 5 END AS ld, ck % 2 = 0 AS fixed FROM ev WHERE st IN ('F', 'P')),
new AS (SELECT org, id, url, d, CASE WHEN st = 'P' THEN title || '!' ELSE title END AS title, CASE WHEN st = 'P' THEN '' ELSE place END AS place,
    CASE WHEN ck % 5 = 0 THEN '' ELSE 'fresh ' || ck END AS note, CAST(NULL AS DATE) AS ld FROM ev WHERE st IN ('O', 'P')),
path AS (SELECT DISTINCT org, CASE WHEN org < '3' THEN 'ai' ELSE 'parser' END AS path FROM ev),
cnt AS (SELECT org, path, (SELECT count(*) FROM old o WHERE o.org = p.org AND d >= DATE '1999-01-01') AS oc,
    (SELECT count(*) FROM new n WHERE n.org = p.org AND d >= DATE '1999-01-01') AS nc FROM path p),
sus AS (SELECT *, oc > 0 AND (nc = 0 OR (path = 'ai' AND nc < oc * 0.5)) AS sus FROM cnt)
"""


def event_sides(t: Tables):
    st, tp, ck = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_custkey")
    ev = t.orders.select(
        F.col("o_orderpriority").alias("organiser"), F.concat(F.lit("e"), "o_orderkey").alias("id"),
        F.concat(F.lit("https://x.example/"), F.floor(F.col("o_orderkey") / 2)).alias("url"),
        F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("day"),
        F.when((st == "P") & (tp > 200000), "").otherwise(F.concat(F.lit("title "), st, ck)).alias("title"),
        F.when(tp > 250000, F.concat(F.lit("place"), "o_orderkey")).otherwise("").alias("place"), st.alias("st"), ck.alias("ck"))
    cols = ["organiser", "id", "url", "day", "title", "place", "note", "last_day", "from_detail"]
    nobody = F.array().cast("array<string>")
    old = ev.where(F.col("st").isin("F", "P")).withColumns({
        "note": F.concat(F.lit("note "), "ck"), "last_day": F.when(F.col("ck") % 3 == 0, F.date_add("day", 5)),
        "from_detail": F.when(F.col("ck") % 2 == 0, F.array(F.lit("place"))).otherwise(nobody)}).select(cols)
    again = F.col("st") == "P"
    new = ev.where(F.col("st").isin("O", "P")).withColumns({
        "title": F.when(again, F.concat("title", F.lit("!"))).otherwise(F.col("title")),
        "place": F.when(again, "").otherwise(F.col("place")),
        "note": F.when(F.col("ck") % 5 == 0, "").otherwise(F.concat(F.lit("fresh "), "ck")),
        "last_day": F.lit(None).cast("date"), "from_detail": nobody}).select(cols)
    paths = ev.select("organiser").distinct().withColumn("path", F.when(F.col("organiser") < "3", "ai").otherwise("parser"))
    return old, new, paths


@query("f23_suspicious_drop", "F23", sql=EVENTS_SQL + "SELECT org AS organiser, path, oc AS old_upcoming, nc AS new_upcoming, sus AS suspicious FROM sus")
def suspicious_drop(t):
    old, new, paths = event_sides(t)
    return C.suspicious_drop(old, new, paths, F.lit("1999-01-01").cast("date"))


@query("j16_reconcile_events", "J16 A6 T15", sql=EVENTS_SQL + """,
uo AS (SELECT org, url FROM old GROUP BY 1, 2 HAVING count(*) = 1), un AS (SELECT org, url FROM new GROUP BY 1, 2 HAVING count(*) = 1),
bu AS (SELECT o.org, o.url, o.d, o.id FROM old o JOIN uo USING (org, url) JOIN un USING (org, url) WHERE (o.org, o.id) NOT IN (SELECT org, id FROM new)),
loc AS (SELECT n.*, CASE WHEN k.id IS NOT NULL THEN n.id ELSE coalesce(bu.id, n.id) END AS nid FROM new n LEFT JOIN old k ON k.org = n.org AND k.id = n.id
  LEFT JOIN bu ON bu.org = n.org AND bu.url = n.url AND bu.d = n.d),
up AS (SELECT loc.org, nid AS id, loc.url, loc.d,
    CASE WHEN loc.title = '' THEN coalesce(b.title, loc.title) ELSE loc.title END AS title,
    CASE WHEN path = 'ai' AND b.place <> '' AND fixed THEN b.place WHEN loc.place = '' THEN coalesce(b.place, '') ELSE loc.place END AS place,
    CASE WHEN path = 'ai' AND b.note <> '' THEN b.note WHEN loc.note = '' THEN coalesce(b.note, '') ELSE loc.note END AS note,
    CASE WHEN path = 'ai' THEN coalesce(loc.ld, b.ld) ELSE loc.ld END AS ld
  FROM loc LEFT JOIN old b ON b.org = loc.org AND b.id = nid JOIN sus ON sus.org = loc.org)
SELECT org AS organiser, id, url, strftime(d, '%Y-%m-%d') AS day, title, place, note, coalesce(strftime(ld, '%Y-%m-%d'), '') AS last_day FROM up
UNION ALL SELECT org, id, url, strftime(d, '%Y-%m-%d'), title, place, note, coalesce(strftime(ld, '%Y-%m-%d'), '') FROM old JOIN sus USING (org)
WHERE (d <= DATE '1999-01-01' OR sus) AND (org, id) NOT IN (SELECT org, id FROM up)""")
def reconcile(t):
    old, new, paths = event_sides(t)
    listing = t.region.select(F.concat(F.lit("https://x.example/listing/"), "r_name").alias("url"))
    out = C.reconcile(old, new, paths, listing, F.lit("1999-01-01").cast("date"), ["title", "place", "note", "last_day"])
    return out.select("organiser", "id", "url", F.date_format("day", "yyyy-MM-dd").alias("day"), "title", "place", "note",
                      F.coalesce(F.date_format("last_day", "yyyy-MM-dd"), F.lit("")).alias("last_day"))


@query("a6_unique_urls", "A6", sql="""
SELECT o_orderpriority AS organiser, 'u' || o_custkey AS url FROM orders GROUP BY 1, 2
HAVING count(*) = 1 AND 'u' || o_custkey NOT IN (SELECT 'u' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def unique_urls(t):
    events = t.orders.select(F.col("o_orderpriority").alias("organiser"), F.concat(F.lit("u"), "o_custkey").alias("url"))
    listing = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.concat(F.lit("u"), "c_custkey").alias("url"))
    return C.unique_urls(events, listing)


@query("f5_horizon", "F5", sql="""
SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN DATE '1998-06-15' - 45 AND DATE '1998-06-15' + 400
  AND o_orderdate + to_days(CAST(o_custkey % 4 AS INTEGER)) >= DATE '1998-06-20' - 45""")
def horizon(t):
    e = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"),
                        F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 4).cast("int")).alias("last_day"))
    near = C.horizon(e, F.lit("1998-06-15").cast("date"))
    return C.prune_past(near, F.lit("1998-06-20").cast("date")).select("o_orderkey")


PART_EVENTS_SQL = """
WITH e AS (SELECT p_partkey AS id, p_brand AS org, p_size % 10 AS d, p_name AS k, CASE WHEN p_retailprice < 950 THEN '' ELSE p_type END AS place,
    CASE WHEN p_size > 25 THEN '' ELSE 'price ' || p_size END AS price, 'https://x.example/' || p_partkey AS url FROM part),
b AS (SELECT DISTINCT org, CAST(regexp_extract(org, '([0-9]+)', 1) AS INTEGER) AS ord FROM e),
r AS (SELECT e.*, (ord % 4 = 0, -(CASE WHEN place <> '' THEN 1 ELSE 0 END + CASE WHEN price <> '' THEN 1 ELSE 0 END), ord, org, id) AS rank FROM e JOIN b USING (org)),
w AS (SELECT d, k, min(rank) AS w, min(org) <> max(org) AS several FROM r GROUP BY 1, 2),
wo AS (SELECT d, k, r.org AS worg, r.id AS wid, several FROM w JOIN r USING (d, k) WHERE r.rank = w.w),
m AS (SELECT r.*, worg, wid, several, NOT several OR r.id = wid AS winner, several AND r.id <> wid AND r.org <> worg AS rival FROM r JOIN wo USING (d, k)),
pl AS (SELECT d, k, arg_min(lower(place), rank) FILTER (WHERE (winner OR rival) AND several AND place <> '') AS sp FROM m GROUP BY 1, 2),
j AS (SELECT m.*, rival AND (place = '' OR sp IS NULL OR lower(place) = sp) AS dup FROM m JOIN pl USING (d, k)),
f AS (SELECT d, k, arg_min(place, rank) FILTER (WHERE dup AND place <> '') AS fplace, arg_min(price, rank) FILTER (WHERE dup AND price <> '') AS fprice FROM j GROUP BY 1, 2)
"""


def part_events(t: Tables):
    e = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("organiser"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size") % 10).alias("day"), F.col("p_name").alias("title"),
        F.when(F.col("p_retailprice") < 950, "").otherwise(F.col("p_type")).alias("place"),
        F.when(F.col("p_size") > 25, "").otherwise(F.concat(F.lit("price "), "p_size")).alias("price"),
        F.concat(F.lit("https://x.example/"), "p_partkey").alias("url")).withColumn("key", E.event_key(F.col("title")))
    orgs = t.part.select(F.col("p_brand").alias("organiser")).distinct().withColumn(
        "ord", F.regexp_extract("organiser", r"(\d+)", 1).cast("int")).withColumn("reseller", F.col("ord") % 4 == 0)
    return C.cross_publisher(e, "key", orgs, ["place", "price"], ["place", "price"])


@query("j17_shown_events", "J17 A14 X20", sql=PART_EVENTS_SQL + """
SELECT id, CASE WHEN several AND winner AND place = '' THEN coalesce(fplace, '') ELSE place END AS place,
  CASE WHEN several AND winner AND price = '' THEN coalesce(fprice, '') ELSE price END AS price FROM j JOIN f USING (d, k) WHERE NOT dup""")
def shown_events(t):
    return part_events(t)[0].select("id", "place", "price")


@query("j17_duplicate_events", "J17", sql=PART_EVENTS_SQL + "SELECT id, wid AS same_as, url FROM j WHERE dup")
def duplicate_events(t):
    _, duplicates, _ = part_events(t)
    return duplicates.select("id", "same_as", "url")


@query("j17_duplicate_links", "J17", sql=PART_EVENTS_SQL + "SELECT wid AS id, org AS organiser, url FROM j WHERE dup")
def duplicate_links(t):
    return part_events(t)[2]


@query("t15_detail_state", "T15 F27", sql="""
SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 2 ELSE o_custkey % 2 + 1 END AS INTEGER) AS tries,
  concat_ws(',', CASE WHEN o_totalprice > 300000 THEN 'form' END, CASE WHEN o_custkey % 3 = 0 OR o_orderpriority = '5-LOW' THEN 'place' END) AS from_detail FROM orders""")
def detail_state(t):
    tries = C.detail_result((F.col("o_custkey") % 2).cast("int"), F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000)
    before = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("place")))
    fixed = C.corrected_fields(before, ("form", F.col("o_totalprice") > 300000), ("place", F.col("o_orderpriority") == "5-LOW"))
    return t.orders.select("o_orderkey", tries.cast("int").alias("tries"), F.array_join(fixed, ",").alias("from_detail"))
