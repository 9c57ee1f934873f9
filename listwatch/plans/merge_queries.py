"""Merging: rediscovered, provisional, cached, archived and alternative records; work queues."""

from pyspark.sql import functions as F

from listwatch.operators import merge as M, queues as Q, scan
from listwatch.plans.registry import Tables, query


def order_archive(t: Tables):
    known = F.col("o_orderstatus") != "P"
    return t.orders.where(known).select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.create_map(F.lit("customer"), F.col("o_custkey").cast("string"), F.lit("kind"), F.lit("order")).alias("meta"))


def order_findings(t: Tables):
    returned = F.bool_or(F.col("l_returnflag") == "R")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(returned, "").otherwise(F.min("l_linestatus")).alias("status"), F.lit("").alias("priority"),
        F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("day"),
        F.create_map(F.lit("lines"), F.count("*").cast("string"), F.lit("kind"),
                     F.when(returned, "").otherwise("shipped")).alias("meta"))


@query("j2_field_merge", "J2", sql="""
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS day,
    CAST(o_custkey AS VARCHAR) AS customer FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT l_orderkey AS k, CASE WHEN bool_or(l_returnflag = 'R') THEN NULL ELSE min(l_linestatus) END AS status,
    strftime(max(l_shipdate), '%Y-%m-%d') AS day, CAST(count(*) AS VARCHAR) AS lines, bool_or(l_returnflag = 'R') AS returned
  FROM lineitem GROUP BY 1)
SELECT k AS o_orderkey, coalesce(f.status, a.status, '') AS status, coalesce(a.priority, '') AS priority, coalesce(f.day, a.day) AS day,
  concat_ws(',', 'customer=' || a.customer, 'kind=' || CASE WHEN f.k IS NULL THEN 'order' WHEN NOT f.returned THEN 'shipped'
    WHEN a.k IS NOT NULL THEN 'order' END, 'lines=' || f.lines) AS meta,
  a.k IS NULL AS is_new,
  a.k IS NOT NULL AND f.k IS NOT NULL AS changed
FROM a FULL JOIN f USING (k)""")
def field_merge(t):
    merged = M.merge_records(order_archive(t), order_findings(t), ["o_orderkey"], ["status", "day", "priority"], "meta")
    entries = F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return merged.select("o_orderkey", F.coalesce("status", F.lit("")).alias("status"),
                         F.coalesce("priority", F.lit("")).alias("priority"), "day",
                         F.array_join(entries, ",").alias("meta"), "is_new", "changed")


@query("j3_hand_over", "J3 J4 S19", sql="""
WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS court, o_custkey AS k, o_orderstatus = 'O' AS prov, o_orderdate AS fs,
    CASE WHEN o_totalprice > 250000 THEN 'S' || o_orderkey ELSE '' END AS summary, o_orderpriority < '3' AS inherits FROM orders),
g AS (SELECT court, k, arg_min(id, (fs, id)) FILTER (WHERE NOT prov) AS official,
    min(fs) FILTER (WHERE prov AND (inherits OR summary <> '')) AS seen,
    arg_min(summary, (fs, id)) FILTER (WHERE prov AND summary <> '') AS s, bool_or(prov) AS any_prov FROM r GROUP BY 1, 2)
SELECT CAST(id AS BIGINT) AS id, strftime(CASE WHEN id = official AND any_prov THEN least(fs, coalesce(seen, fs)) ELSE fs END, '%Y-%m-%d') AS first_seen,
  CASE WHEN id = official AND any_prov AND summary = '' THEN coalesce(s, '') ELSE summary END AS summary,
  CAST(coalesce(CASE WHEN prov THEN official END, '-1') AS BIGINT) AS replaced_by
FROM r JOIN g USING (court, k)""")
def hand_over(t):
    r = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("court"), F.col("o_custkey").cast("string").alias("mark"),
        F.col("o_orderstatus").alias("st"), F.col("o_orderdate").alias("first_seen"),
        F.when(F.col("o_totalprice") > 250000, F.concat(F.lit("S"), F.col("o_orderkey"))).otherwise("").alias("summary"),
        F.lit("").alias("replaced_by"))
    done = M.hand_over(r, ["mark", "court"], F.col("st") == "O", F.col("court") < "3")
    return done.select(F.col("id").cast("bigint").alias("id"), F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), "summary",
                       F.coalesce(F.col("replaced_by").try_cast("bigint"), F.lit(-1).cast("bigint")).alias("replaced_by"))


@query("j4_suppress_provisional", "J4", sql="""
SELECT o_orderkey FROM orders p WHERE o_orderstatus = 'O' AND NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderstatus <> 'O' AND o.o_custkey = p.o_custkey AND o.o_orderpriority = p.o_orderpriority)""")
def suppress(t):
    key = ["o_custkey", "o_orderpriority"]
    provisional = F.col("o_orderstatus") == "O"
    return M.suppress_provisional(t.orders.where(provisional), t.orders.where(~provisional).select(*key).distinct(),
                                  key).select("o_orderkey")


@query("j5_cache_overlay", "J5 J27", sql="""
SELECT doc_id, CASE WHEN lang = 'en' THEN source WHEN quality IS NOT NULL THEN 'q' || quality ELSE '' END AS summary,
  coalesce('t' || toxic, '') AS tag FROM documents LEFT JOIN labels USING (doc_id)""")
def cache_overlay(t):
    items = t.documents.select("doc_id", F.when(F.col("lang") == "en", F.col("source")).otherwise("").alias("summary"))
    cache = t.labels.select("doc_id", F.concat(F.lit("q"), "quality").alias("summary"), F.concat(F.lit("t"), "toxic").alias("tag"))
    return M.overlay_cache(items, cache, "doc_id", ["summary", "tag"])


@query("j6_backfill", "J6", sql="""
WITH s AS (SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS fs FROM labels),
c AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 10 <> 0)
SELECT d.doc_id AS id, d.source || ' ' || d.doc_id AS title, CASE WHEN c.doc_id IS NOT NULL THEN 'A' || c.toxic ELSE '' END AS authors,
  CASE WHEN c.quality = 1 THEN 'T' WHEN c.quality = 0 THEN '' WHEN n_chars > 1000 THEN 'H' ELSE '' END AS heading,
  CASE WHEN c.quality = 1 THEN 'new' WHEN c.quality = 0 THEN '' WHEN n_chars > 1000 THEN 'old' ELSE '' END AS summary,
  CASE WHEN (c.quality = 1) IS TRUE OR (c.doc_id IS NULL AND n_chars > 1000) THEN '' WHEN c.toxic = 1 THEN 'Obsah není dostupný.'
    ELSE 'Shrnutí není k dispozici.' END AS note,
  CASE WHEN (c.quality = 1) IS TRUE OR (c.doc_id IS NULL AND n_chars > 1000) THEN ''
    ELSE d.source || ' ' || d.doc_id || CASE WHEN c.doc_id IS NOT NULL THEN chr(10) || 'Autor: A' || c.toxic ELSE '' END END AS text
FROM documents d JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
WHERE lang <> 'en' AND fs >= DATE '2024-01-10'""")
def backfill(t):
    d = t.documents.select(
        F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "doc_id").alias("title"), F.lit("").alias("authors"),
        F.when(F.col("n_chars") > 1000, "H").otherwise("").alias("heading"),
        F.when(F.col("n_chars") > 1000, "old").otherwise("").alias("summary"), F.lit("").alias("note"),
        F.lit("").alias("text"), "lang")
    state = t.labels.select(F.col("doc_id").alias("id"), F.date_add(
        F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).cast("timestamp").alias("first_seen"))
    cache = t.labels.where(F.col("doc_id") % 10 != 0).select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "new").otherwise("").alias("summary"),
        F.lit("T").alias("tag"), F.concat(F.lit("A"), "toxic").alias("authors"), (F.col("toxic") == 1).alias("no_content"))
    today = d.where(F.col("lang") == "en")
    out = M.backfill(d.drop("lang"), today, state, cache, F.lit("2024-01-10").cast("timestamp"))
    return out.drop("first_seen")


@query("j7_prioritised_union", "J7 J31", sql="""
WITH a AS (SELECT 'SRC' || doc_id AS guid, 'first' AS origin FROM labels),
b AS (SELECT 'src' || doc_id AS guid, 'second' AS origin FROM documents)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE lower(guid) NOT IN (SELECT lower(guid) FROM a)""")
def prioritised_union(t):
    a = t.labels.select(F.concat(F.lit("SRC"), "doc_id").alias("guid"), F.lit("first").alias("origin"))
    b = t.documents.select(F.concat(F.lit("src"), "doc_id").alias("guid"), F.lit("second").alias("origin"))
    return M.prefer_first(a, b, "guid")


@query("j8_enrich_newest", "J8 W5 O4", sql="""
WITH lack AS (SELECT doc_id FROM documents WHERE lang <> 'de' QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 20)
SELECT d.doc_id, CASE WHEN lang = 'de' THEN 'de' WHEN lack.doc_id IS NOT NULL AND quality IS NOT NULL THEN 'q' || quality ELSE '' END AS authors
FROM documents d LEFT JOIN lack USING (doc_id) LEFT JOIN labels USING (doc_id)""")
def enrich_newest(t):
    items = t.documents.select("doc_id", "source", "n_chars", F.when(F.col("lang") == "de", "de").otherwise("").alias("authors"))
    lookup = t.labels.select("doc_id", F.concat(F.lit("q"), "quality").alias("authors"))
    return M.enrich_newest(items, lookup, "doc_id", "authors", ["source"], [F.col("n_chars").desc(), F.col("doc_id")],
                           20).select("doc_id", "authors")


@query("j28_first_available", "J28", sql="""
SELECT doc_id, source, prio FROM (SELECT doc_id, source, CASE lang WHEN 'de' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS prio,
  min(CASE lang WHEN 'de' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END) OVER (PARTITION BY source, quality) AS best
  FROM documents JOIN labels USING (doc_id)) WHERE prio = best""")
def first_available(t):
    prio = F.when(F.col("lang") == "de", 1).when(F.col("lang") == "es", 2).when(F.col("lang") == "fr", 3).otherwise(4)
    d = t.documents.select("doc_id", "source", prio.alias("prio")).join(t.labels.select("doc_id", "quality"), "doc_id")
    return M.first_available(d, ["source", "quality"], "prio").select("doc_id", "source", "prio")


@query("j29_ranked_text_pick", "J29 W3", sql="""
SELECT source, lang, doc_id, n_chars FROM (SELECT *, CASE lang WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS prio FROM documents)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY prio, n_chars DESC, doc_id) = 1""")
def ranked_text_pick(t):
    prio = F.when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    d = t.documents.select("source", "lang", "doc_id", "n_chars", prio.alias("prio"))
    best = scan.first_per_key(d, ["source"], [F.col("prio"), -F.col("n_chars"), F.col("doc_id")])
    return best.select("source", "lang", "doc_id", "n_chars")


@query("s19_fold_history", "S19 W2", sql="""
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen,
  coalesce(arg_max(event_type, ts) FILTER (WHERE event_type <> 'error'), '') AS event_type,
  coalesce(arg_max(props, ts) FILTER (WHERE value >= 10), '') AS props FROM events GROUP BY 1""")
def fold_history(t):
    versions = t.events.select(
        "user_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("event_type"),
        F.when(F.col("value") >= 10, F.col("props")).otherwise("").alias("props"))
    return M.fold_history(versions, "user_id", "ts", ["event_type", "props"]).select(
        "user_id", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.coalesce("event_type", F.lit("")).alias("event_type"), F.coalesce("props", F.lit("")).alias("props"))


def queue_items(t: Tables):
    cls = Q.priority_class(F.col("lang") == "de", F.col("quality") == 1, F.col("toxic") == 1)
    return (t.documents.select("doc_id", "source", "lang", "n_chars")
            .join(t.labels, "doc_id", "left").fillna(0, ["quality", "toxic"])
            .select("doc_id", "source", cls.alias("class"), "n_chars",
                    F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("source_order")))


QUEUE_SQL = """
WITH q AS (SELECT doc_id, source, CASE WHEN lang = 'de' OR coalesce(quality, 0) = 1 THEN 0 WHEN coalesce(toxic, 0) = 1 THEN 2 ELSE 1 END AS class,
    n_chars, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS so
  FROM documents LEFT JOIN labels USING (doc_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, n_chars DESC, doc_id) AS turn FROM q)
"""


@query("w1_fair_queue", "W1 F9 O1", sql=QUEUE_SQL + """
SELECT doc_id, source, class, turn, row_number() OVER (ORDER BY turn, so) AS place FROM t""")
def fair_queue(t):
    order = [F.col("class"), F.col("n_chars").desc(), F.col("doc_id")]
    return Q.fair_queue(queue_items(t), "source", "source_order", order).select(
        "doc_id", "source", "class", "turn", "place")


@query("t13_run_budget", "T13 W1", sql=QUEUE_SQL + """
SELECT doc_id, source, turn, row_number() OVER (ORDER BY turn, so) AS place FROM t QUALIFY place <= 60""")
def run_budget(t):
    order = [F.col("class"), F.col("n_chars").desc(), F.col("doc_id")]
    return Q.capped_queue(queue_items(t), "source", "source_order", order, 60).select("doc_id", "source", "turn", "place")


@query("w5_newest_per_group", "W5 O4", sql="""
SELECT source, doc_id, rank FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank
FROM documents) WHERE rank <= 20""")
def newest_per_group(t):
    return scan.top_per_group(t.documents.select("source", "doc_id", "n_chars"), ["source"],
                              [F.col("n_chars").desc(), F.col("doc_id")], 20).select("source", "doc_id", "rank")


@query("w6_rewrite_batches", "W6 O6", sql="""
SELECT doc_id, CAST((p - 1) // 20 AS INTEGER) AS batch FROM (
  SELECT doc_id, row_number() OVER (ORDER BY n_chars >= 500, n_chars DESC, doc_id) AS p FROM documents) WHERE p <= 300""")
def rewrite_batches(t):
    order = [F.col("n_chars") >= 500, F.col("n_chars").desc(), F.col("doc_id")]
    return Q.batches(t.documents.select("doc_id", "n_chars"), order, 20, 15).select("doc_id", "batch")


@query("w6_all_batches", "W6", sql="""
SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_name) - 1) // 40 AS INTEGER) AS batch FROM customer""")
def all_batches(t):
    return Q.batches(t.customer.select("c_custkey", "c_name"), [F.col("c_name")], 40).select("c_custkey", "batch")


@query("w13_shared_budget", "W13", sql="""
WITH n AS (SELECT c_nationkey AS k, CAST(count(*) FILTER (WHERE c_acctbal < 500) AS BIGINT) AS need FROM customer GROUP BY 1),
l AS (SELECT max(l) AS level FROM range(0, 81) g(l) WHERE (SELECT sum(least(need, l)) FROM n) <= 80),
r AS (SELECT 80 - sum(least(need, level)) AS rest FROM n, l),
x AS (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY k) AS i FROM n, l WHERE need > level), r WHERE i <= rest)
SELECT n.k AS claimant, need, CAST(least(need, level) + CASE WHEN x.k IS NULL THEN 0 ELSE 1 END AS BIGINT) AS granted
FROM n CROSS JOIN l LEFT JOIN x ON x.k = n.k""")
def shared_budget(t):
    needs = t.customer.groupBy(F.col("c_nationkey").alias("claimant")).agg(F.count_if(F.col("c_acctbal") < 500).alias("need"))
    return Q.share_budget(needs, "claimant", "need", "claimant", 80).select("claimant", "need", "granted")


@query("o1_window_order", "O1 O3", sql="""
SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END, '2000') DESC,
  strftime(o_orderdate, '%Y-%m') DESC, o_orderkey DESC) AS place FROM orders""")
def window_order(t):
    o = t.orders.select(
        "o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")),
                                 F.lit("2000")).alias("shown"), F.date_format("o_orderdate", "yyyy-MM").alias("seen"))
    return scan.row_number_within(o, [], [F.col("shown").desc(), F.col("seen").desc(), F.col("o_orderkey").desc()],
                                  "place").select("o_orderkey", "place")


@query("o7_nearest_first", "O7 F27", sql="""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 4 < 2
  AND NOT (o_totalprice > 300000 AND o_orderpriority <> '5-LOW') ORDER BY o_orderdate, o_orderkey LIMIT 80""")
def nearest_first(t):
    from listwatch.operators.reconcile import needs_detail
    need = needs_detail(F.when(F.col("o_orderstatus") != "P", "u").otherwise(""), F.col("o_custkey") % 4,
                        F.when(F.col("o_totalprice") > 300000, "x").otherwise(""),
                        F.when(F.col("o_orderpriority") != "5-LOW", "x").otherwise(""))
    return (t.orders.where(need).orderBy("o_orderdate", "o_orderkey").limit(80)
            .select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")))
