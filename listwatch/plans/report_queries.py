"""Calendars, counts, digests and enrichment answers."""

from pyspark.sql import functions as F

from listwatch.functions import dates as D
from listwatch.operators import answers as AN, calendar as CA, digest as DG, islands as IS, report as R, scan, subscribe as SB
from listwatch.plans.registry import Tables, query


def lit_day(s):
    return F.lit(s).cast("date")


def order_events(t: Tables):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", day.alias("day"),
                           F.date_add(day, (F.col("o_custkey") % 12).cast("int")).alias("last_day"))


@query("j24_events_by_day", "J24 A2", sql="""
WITH e AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey % 12 AS INTEGER) AS n FROM orders)
SELECT strftime(d + i, '%Y-%m-%d') AS shown_on, count(*) AS events, count(DISTINCT o_custkey) AS customers
FROM e, LATERAL (SELECT CAST(unnest(generate_series(0, CASE WHEN n > 7 THEN 0 ELSE n END)) AS INTEGER) AS i) GROUP BY 1""")
def events_by_day(t):
    days = CA.by_day(order_events(t))
    return days.groupBy(F.date_format("shown_on", "yyyy-MM-dd").alias("shown_on")).agg(
        F.count("*").alias("events"), F.countDistinct("o_custkey").alias("customers"))


@query("j25_calendar_grid", "J25", sql="""
WITH g AS (SELECT DATE '1998-06-08' + CAST(i AS INTEGER) AS d, CAST(i // 7 AS INTEGER) AS week, CAST(i % 7 AS INTEGER) AS col FROM range(21) r(i)),
c AS (SELECT g.*, (SELECT count(*) FROM lineitem WHERE l_shipdate = d) AS events FROM g)
SELECT strftime(d, '%Y-%m-%d') AS grid_day, week, col AS "column", events FROM c WHERE col < 5 OR (SELECT bool_or(col >= 5 AND events > 0) FROM c)""")
def calendar_grid(t):
    e = t.lineitem.select(F.col("l_shipdate").cast("date").alias("day"))
    return CA.grid(e, "day", lit_day("1998-06-11")).withColumn("grid_day", F.date_format("grid_day", "yyyy-MM-dd"))


@query("a16_month_sections", "A16", sql="""
WITH m AS (SELECT strftime(DATE '2001-03-01' + to_months(CAST(i AS INTEGER)), '%Y-%m') AS month FROM range(8) r(i)),
c AS (SELECT strftime(least(greatest(date_trunc('month', CASE WHEN l_returnflag <> 'R' THEN l_shipdate ELSE DATE '1990-01-01' END), DATE '2001-03-01'), DATE '2001-10-01'), '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1)
SELECT m.month, coalesce(n, 0) AS items FROM m LEFT JOIN c USING (month)""")
def month_sections(t):
    items = t.lineitem.select(F.when(F.col("l_returnflag") != "R", F.col("l_shipdate").cast("date")).alias("shown"))
    return CA.month_sections(items, "shown", lit_day("2001-03-01"), lit_day("2001-10-20"))


@query("w11_folded_history", "W11", sql="""
WITH h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, i AS from_start, greatest(n - 4, 0) AS hidden FROM h WHERE i = 1 OR i > n - 3""")
def folded_history(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return CA.folded_history(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")],
                             [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).drop("o_orderdate")


@query("w12_next_and_last", "W12 F17", sql="""
SELECT o_custkey, coalesce(strftime(min(o_orderdate) FILTER (WHERE o_orderdate >= DATE '2001-01-01'), '%Y-%m-%d'), '') AS next_day,
  strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_entry FROM orders GROUP BY 1""")
def next_and_last(t):
    out = CA.next_and_last(order_events(t), ["o_custkey"], "day", "o_orderkey", lit_day("2001-01-01"))
    return out.select("o_custkey", F.coalesce(F.date_format("next_day", "yyyy-MM-dd"), F.lit("")).alias("next_day"),
                      F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), "last_entry")


@query("a20_day_order", "A20 O2 X10", sql="""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY CASE WHEN o_custkey % 10 = 0 THEN 1441 ELSE (o_custkey % 24) * 60 + o_custkey % 60 END, o_orderkey) AS position FROM orders""")
def day_order(t):
    k = F.col("o_custkey")
    clock = F.when(k % 10 != 0, F.concat((k % 24).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))).otherwise("")
    e = t.orders.select("o_orderkey", "o_orderdate", clock.alias("clock"))
    return CA.order_within_day(e, ["o_orderdate"], "clock", [F.col("o_orderkey")]).select("o_orderkey", "position")


@query("a12_published_until", "A12", sql="""
SELECT strftime(coalesce(max(o_orderdate) FILTER (WHERE o_totalprice > 499000), (SELECT max(l_shipdate) FROM lineitem)), '%Y-%m-%d') AS published_until FROM orders""")
def published_until(t):
    ends = t.orders.select(F.when(F.col("o_totalprice") > 499000, F.col("o_orderdate").cast("date")).alias("e"))
    ev = t.lineitem.select(F.col("l_shipdate").cast("date").alias("day"))
    return CA.published_until(ends, "e", ev, "day").select(F.date_format("published_until", "yyyy-MM-dd").alias("published_until"))


@query("j19_hearing_changes", "J19", sql="""
WITH c AS (SELECT l_orderkey AS k, count(*) AS changes, arg_max(l_returnflag, (l_shipdate, l_returnflag)) AS latest FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey, coalesce(changes, 0) AS changes, coalesce(latest, '') AS latest_change FROM orders LEFT JOIN c ON k = o_orderkey""")
def hearing_changes(t):
    changes = t.lineitem.where(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("wording"), F.col("l_shipdate").alias("found"))
    return SB.with_changes(t.orders.select("o_orderkey"), changes, ["o_orderkey"])


@query("j20_followed_cases", "J20", sql="""
SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def followed(t):
    cases = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return SB.followed(t.lineitem.select("l_orderkey"), cases, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("j21_case_timeline", "J21", sql="""
SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS day, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS text, l_linestatus = 'O' AS cancelled FROM lineitem
UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_custkey % 2 = 0 THEN 'Jednání v 9:' || (o_custkey % 50 + 10) ELSE 'Jednání' END, false FROM orders""")
def case_timeline(t):
    events = t.lineitem.select("l_orderkey", F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("code"),
                               F.lit(None).cast("string").alias("name"), (F.col("l_linestatus") == "O").alias("cancelled"))
    clock = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("9:"), F.col("o_custkey") % 50 + 10)).otherwise("")
    held = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("day"), clock.alias("clock"))
    labels = t.spark.createDataFrame([("A", "accepted"), ("R", "returned")], "code string, label string")
    return SB.timeline(events, held, labels, ["l_orderkey"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a1_pending_counts", "A1", sql="""
WITH d AS (SELECT source, CASE WHEN quality IS NULL THEN 'pripravuje' WHEN toxic = 1 THEN 'ceka_na_text' ELSE '' END AS st, lang = 'en' AS bare FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, count(*) FILTER (WHERE st = 'pripravuje') AS waiting, count(*) FILTER (WHERE st = 'pripravuje' AND bare) AS without_area,
  count(*) FILTER (WHERE st = 'ceka_na_text') AS without_text, count(*) AS total FROM d GROUP BY 1""")
def pending_counts(t):
    st = F.when(F.col("quality").isNull(), "pripravuje").when(F.col("toxic") == 1, "ceka_na_text").otherwise("")
    d = t.documents.join(t.labels, "doc_id", "left").select("source", st.alias("status"), F.when(F.col("lang") == "en", 0).otherwise(1).alias("areas"))
    return R.pending_counts(d, "source")


@query("a3_usage_accounting", "A3", sql="""
WITH c AS (SELECT CAST(timezone('America/Los_Angeles', ts AT TIME ZONE 'UTC') AS DATE) AS d, event_type, user_id, event_id FROM events)
SELECT strftime(d, '%Y-%m-%d') AS day, event_type, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS input, CAST(sum(event_id) AS BIGINT) AS output FROM c WHERE d >= DATE '2024-01-30' - 14 GROUP BY 1, 2""")
def usage_accounting(t):
    e = t.events.select("ts", "event_type", F.col("user_id").alias("input"), F.col("event_id").alias("output"))
    early = F.col("ts") < "2024-01-22 12:00:00"
    stored = R.usage_by_day(e.where(early), "ts", "event_type", ["input", "output"])
    run = R.usage_by_day(e.where(~early), "ts", "event_type", ["input", "output"])
    out = R.add_usage(stored, run, "event_type", ["input", "output"], lit_day("2024-01-30"))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a5_line_ups", "A5 O5", sql="""
SELECT CAST(c_nationkey AS VARCHAR) || ' ' || c_mktsegment AS line_up, count(*) AS members,
  string_agg(DISTINCT lpad(CAST(c_custkey % 7 AS VARCHAR), 2, '0') || ' ' || CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'Cm' END, ',' ORDER BY lpad(CAST(c_custkey % 7 AS VARCHAR), 2, '0') || ' ' || CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'Cm' END) AS senates
FROM customer GROUP BY 1""")
def line_ups(t):
    p = t.customer.select(
        F.col("c_nationkey").cast("string").alias("chair"), F.col("c_mktsegment").alias("agenda"), F.lit("").alias("members"), F.lit("").alias("note"),
        (F.col("c_custkey") % 7).cast("int").alias("number"), F.when(F.col("c_custkey") % 2 == 0, "C").otherwise("Cm").alias("register"))
    counts = p.groupBy("chair", "agenda").agg(F.count("*").alias("n"))
    shown = F.array_join(F.transform("senates", lambda s: F.concat_ws(" ", F.lpad(s["number"].cast("string"), 2, "0"), s["register"])), ",")
    return R.line_ups(p).join(counts, ["chair", "agenda"]).select(
        F.concat_ws(" ", "chair", "agenda").alias("line_up"), F.col("n").alias("members"), shown.alias("senates"))


@query("a10_table_fingerprint", "A10 S4", sql="""
SELECT l_suppkey, count(*) AS rows, count(*) || ':' || sum(CAST('0x' || substr(md5(l_orderkey || chr(31) || l_linenumber || chr(31) || l_returnflag), 1, 15) AS BIGINT)) AS fingerprint
FROM lineitem GROUP BY 1""")
def table_fingerprint(t):
    return R.fingerprint(t.lineitem, ["l_orderkey", "l_linenumber", "l_returnflag"], ["l_suppkey"])


@query("a13_source_failures", "A13", sql="""
SELECT count(*) AS sources, count(*) FILTER (WHERE bad) AS failed, CASE WHEN avg(CAST(bad AS INTEGER)) > 0.5 THEN 'error' ELSE 'ok' END AS status
FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') > 14 AS bad FROM events GROUP BY 1)""")
def source_failures(t):
    s = t.events.groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") > 14).alias("bad"))
    return R.source_failures(s, "bad")


@query("a15_run_health", "A15", sql="""
WITH f AS (SELECT user_id AS s, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-29'),
p AS (SELECT user_id AS s, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-02') AS found FROM events GROUP BY 1),
c AS (SELECT s, count(*) AS found, count(*) FILTER (WHERE event_type = 'signup') AS new, count(*) FILTER (WHERE event_type = 'error') AS deferred FROM f GROUP BY 1)
SELECT p.s AS user_id, coalesce(c.found, 0) AS found, coalesce(new, 0) AS new, coalesce(deferred, 0) AS deferred,
  CASE WHEN coalesce(deferred, 0) > 0 AND coalesce(new, 0) = 0 THEN 'only deferred' WHEN c.found IS NULL AND p.found = 0 THEN 'empty twice' ELSE '' END AS warning FROM p LEFT JOIN c USING (s)""")
def run_health(t):
    found = t.events.where(F.col("ts") >= "2024-01-29").select(
        "user_id", (F.col("event_type") == "signup").alias("is_new"), (F.col("event_type") == "error").alias("deferred"))
    previous = t.events.groupBy("user_id").agg(F.count_if(F.col("ts") < "2024-01-02").alias("found"))
    return R.run_health(found, previous, "user_id")


@query("w14_newest_catch", "W14 A19", sql="""
WITH m AS (SELECT greatest(max(ts), TIMESTAMP '2024-01-30 12:00:00') AS latest FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 20) AS decisions, count(*) FILTER (WHERE value < 20) AS articles FROM events, m
WHERE ts >= greatest(latest - INTERVAL 16 HOUR, TIMESTAMP '2024-01-31 20:00:00' - INTERVAL 48 HOUR) GROUP BY 1""")
def newest_catch(t):
    runs = t.spark.range(1).select(F.lit("2024-01-30 12:00:00").cast("timestamp").alias("started"))
    flagged = R.newest_catch(t.events, runs, F.lit("2024-01-31 20:00:00").cast("timestamp"), "ts")
    return R.facet_counts(flagged.where("newest"), "event_type", {"decisions": F.col("value") >= 20, "articles": F.col("value") < 20})


@query("w8_records_from_lines", "W8", sql="""
WITH n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT conv_id, CAST(r AS BIGINT) AS record, count(*) AS lines, string_agg(role, '>' ORDER BY turn) AS roles FROM n WHERE r > 0 GROUP BY 1, 2""")
def records_from_lines(t):
    n = IS.number_records(t.conversations, ["conv_id"], [F.col("turn")], F.col("role") == "user")
    joined = IS.join_lines(n.where(F.col("record") > 0), ["conv_id", "record"], "turn", "role", ">")
    return joined.select("conv_id", "record", "lines", F.col("role").alias("roles"))


@query("w9_continued_lines", "W9", sql="""
WITH l AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'a.s.' WHEN 'system' THEN 'Systém' ELSE 'Firma ' || turn END AS line FROM conversations),
n AS (SELECT *, sum(CASE WHEN line = 'a.s.' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM l)
SELECT conv_id, CAST(r AS BIGINT) AS record, count(*) AS lines, string_agg(line, ' ' ORDER BY turn) AS line FROM n GROUP BY 1, 2""")
def continued_lines(t):
    line = F.when(F.col("role") == "assistant", "a.s.").when(F.col("role") == "system", "Systém").otherwise(
        F.concat(F.lit("Firma "), "turn"))
    return IS.merge_continued(t.conversations.select("conv_id", "turn", line.alias("line")), ["conv_id"], "turn", "line")


@query("w16_wrapped_names", "W16", sql="""
WITH y AS (SELECT DISTINCT conv_id, 800.0 - turn * 20 + CASE WHEN role = 'assistant' THEN 7 ELSE 0 END AS y FROM conversations),
p AS (SELECT *, lag(y) OVER (PARTITION BY conv_id ORDER BY y DESC) AS above FROM y)
SELECT conv_id, CAST(y AS DOUBLE) AS y, CAST(sum(CASE WHEN above IS NULL OR above - y >= 16 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY y DESC) AS BIGINT) AS name_no FROM p""")
def wrapped_names(t):
    y = (F.lit(800.0) - F.col("turn") * 20 + F.when(F.col("role") == "assistant", 7).otherwise(0)).cast("double")
    return IS.wrapped_lines(t.conversations.select("conv_id", y.alias("y")).distinct(), ["conv_id"], "y")


@query("w7_unsorted_rows", "W7", sql="""
SELECT c.conv_id, c.turn FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn + 1 = c.turn WHERE c.text <= p.text""")
def unsorted_rows(t):
    return IS.unsorted_rows(t.conversations.select("conv_id", "turn", "text"), ["conv_id"], "turn", "text").select("conv_id", "turn")


def digest_candidates(t: Tables):
    day = F.date_add(lit_day("2024-01-01"), (F.col("n_chars") % 31).cast("int"))
    d = t.documents.select(
        F.col("doc_id").alias("id"), day.alias("day"), F.concat_ws(" ", "source", "doc_id").alias("title"), "lang", "n_chars")
    decisions = d.where(F.col("lang") != "en").select(
        F.concat(F.lit("d"), "id").alias("guid"), "day", "title", F.lit("NS").alias("label"), F.lit("").alias("tag"),
        F.col("lang").alias("heading"), F.when(F.col("n_chars") > 900, "s").otherwise("").alias("summary"))
    articles = d.where(F.col("lang") == "en").select(
        F.concat(F.lit("a"), "id").alias("guid"), "day", "title", F.lit("Časopis").alias("label"), F.lit("IIC").alias("tag"),
        F.lit("").alias("heading"), F.when(F.col("n_chars") > 900, "s").otherwise("").alias("summary"))
    return DG.digest_items(decisions, articles, [F.col("day").desc(), F.col("guid")])


DIGEST_SQL = """
WITH c AS (SELECT CASE WHEN lang = 'en' THEN 'a' ELSE 'd' END || doc_id AS guid, DATE '2024-01-01' + CAST(n_chars % 31 AS INTEGER) AS day, source || ' ' || doc_id AS title,
    CASE WHEN lang = 'en' THEN 'Časopis' ELSE 'NS' END AS label, CASE WHEN lang = 'en' THEN 'IIC' ELSE '' END AS tag, CASE WHEN lang = 'en' THEN '' ELSE lang END AS heading,
    CASE WHEN n_chars > 900 THEN 's' ELSE '' END AS summary FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY day DESC, guid) AS number FROM c QUALIFY number <= 300)
"""


@query("u7_digest_items", "U7 O3 W15", sql=DIGEST_SQL + """
SELECT number, guid, number || '. [' || label || CASE WHEN tag <> '' THEN ' / ' || tag ELSE '' END || ', ' || strftime(day, '%d.%m.%Y') || '] ' || title ||
  CASE WHEN heading <> '' THEN ' — heslo: ' || heading ELSE '' END || CASE WHEN summary <> '' THEN chr(10) || '   ' || summary ELSE '' END AS line FROM n""")
def digest_items(t):
    line = DG.prompt_line(*[F.col(c) for c in ("label", "tag", "day", "title", "heading", "summary", "number")])
    return digest_candidates(t).select("number", "guid", line.alias("line"))


@query("a10_digest_fingerprint", "A10", sql=DIGEST_SQL + """
SELECT sha256('v5' || chr(10) || string_agg(guid || '|' || summary || chr(10), '' ORDER BY number)) AS fingerprint FROM n""")
def digest_fingerprint(t):
    return DG.input_fingerprint(digest_candidates(t), "guid", "summary")


def digest_citations(t):
    """Sections of the answers, and the entries that they cite."""
    k = F.col("c_custkey")
    raw = F.concat(F.lit("**PŘEHLED:** Úvod "), "c_nationkey", F.lit(".\n\nTÉMA: "), "c_mktsegment", F.lit("\nTEXT: Text  o "), "c_name",
                   F.lit(" s.r.o. ZDROJE: "), k % 7 + 1, F.lit(", "), k % 3 + 1, F.lit(", 99, 4, "), k % 7 + 1, F.lit("\n\nTÉMA: \nTEXT: nic"))
    blocks = DG.parse_answers(t.heavy("customer").select("c_custkey", raw.alias("raw")), "c_custkey", "raw")
    items = t.nation.select((F.col("n_nationkey") + 1).alias("number"), "n_name")
    return blocks, DG.resolve_citations(blocks, items, ["c_custkey", "block"], F.lit(25), ["n_name"])


@query("e5_digest_answers", "E5 J18", sql="""
WITH a AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, [c_custkey % 7 + 1, c_custkey % 3 + 1, 99, 4, c_custkey % 7 + 1] AS nums FROM customer),
u AS (SELECT c_custkey, unnest(nums) AS n, generate_subscripts(nums, 1) AS i FROM a),
f AS (SELECT c_custkey, n, min(i) AS i FROM u WHERE n BETWEEN 1 AND (SELECT count(*) FROM nation) GROUP BY 1, 2)
SELECT c_custkey, CAST(1 AS INTEGER) AS block, c_mktsegment AS title, 'Text o ' || c_name || '.' AS text, string_agg('NATION_' || (n - 1), ',' ORDER BY i) AS cited
FROM a JOIN f USING (c_custkey) GROUP BY ALL UNION ALL SELECT c_custkey, 0, '', 'Úvod ' || c_nationkey || '.', '' FROM a""")
def digest_answers(t):
    blocks, cited = digest_citations(t)
    per = cited.groupBy("c_custkey", "block").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "n_name"))), lambda s: s["n_name"]), ",").alias("cited"))
    return blocks.join(per, ["c_custkey", "block"], "left").select("c_custkey", "block", "title", "text", F.coalesce("cited", F.lit("")).alias("cited"))


@query("e1_requests", "E1", sql="""
SELECT o_orderkey, 'Soud: ' || CASE o_orderstatus WHEN 'F' THEN 'Nejvyšší soud' WHEN 'O' THEN 'Ústavní soud' ELSE 'Soudní dvůr EU' END || chr(10) || 'Druh: ' ||
  CASE WHEN o_custkey % 2 = 0 THEN 'stanovisko' ELSE 'rozsudek' END || chr(10) || 'Spisová značka: ' || o_custkey || chr(10) || 'Datum rozhodnutí: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) ||
  'Úřední údaje (vodítko, nemusí být úplné): p: ' || o_orderpriority || chr(10) || 'Pokyn ke shrnutí: ' ||
  CASE o_orderstatus WHEN 'O' THEN 'us' WHEN 'F' THEN CASE WHEN o_custkey % 2 = 0 THEN 'stanovisko_ns' ELSE 'obecny' END ELSE CASE WHEN o_custkey % 2 = 0 THEN 'stanovisko' ELSE 'sdeu' END END ||
  chr(10) || chr(10) || '--- TEXT ---' || chr(10) || 'T' || o_orderkey AS prompt FROM orders""")
def requests(t):
    court = F.when(F.col("o_orderstatus") == "F", "ns").when(F.col("o_orderstatus") == "O", "us").otherwise("sdeu")
    kind = F.when(F.col("o_custkey") % 2 == 0, "stanovisko").otherwise("rozsudek")
    header = AN.request_header(court, kind, F.col("o_custkey").cast("string"), F.lit(""), F.date_format("o_orderdate", "yyyy-MM-dd"),
                               F.array(F.concat(F.lit("p: "), "o_orderpriority"), F.lit("")), AN.instruction_kind(court, kind, F.lit("Cdo")))
    return t.heavy("orders").select("o_orderkey", AN.request(header, F.concat(F.lit(" T"), "o_orderkey", F.lit("\n"))).alias("prompt"))


@query("e2_parsed_answers", "E2 E3 X14 X15 X16 X25", sql="""
SELECT o_orderkey, 'Předkupní právo ' || o_custkey AS heading, 'Alfa se soudila s Betou o pohledávky číslo ' || o_orderkey || '.' AS summary,
  CASE WHEN o_orderstatus = 'P' THEN 'trestni' ELSE 'autorske,it' END AS areas, o_orderpriority = '5-LOW' AS procedural FROM orders
WHERE o_orderpriority <> '1-URGENT'""")
def parsed_answers(t):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    head = F.concat(F.lit("**Předkupní právo "), cust, F.lit(" – dovolání odmítnuto.**"))
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "Krátké.").otherwise(
        F.concat(F.lit("Alfa s.r.o. se soudila s Betou a.s. o pohledávki  číslo "), key, F.lit(".")))
    areas = F.when(F.col("o_orderstatus") == "P", "").otherwise("autorske; it")
    flag = F.when(F.col("o_orderpriority") == "5-LOW", "Ano.").otherwise("ne")
    tagged = F.concat(F.lit("HESLO: "), head, F.lit("\nSHRNUTÍ: "), text, F.lit("\nOBLASTI: "), areas, F.lit("\nPROCESNÍ: "), flag)
    as_json = F.concat(F.lit("```json "), F.to_json(F.struct(
        head.alias("heslo"), text.alias("shrnuti"), F.filter(F.split(areas, "; "), lambda a: a != "").alias("oblasti"),
        (F.col("o_orderpriority") == "5-LOW").alias("procesni"))), F.lit(" ```"))
    raw = F.when(F.col("o_orderkey") % 2 == 0, as_json).otherwise(tagged)
    p = AN.parse_answers(t.heavy("orders").select("o_orderkey", raw.alias("raw")), "raw")
    found = AN.fallback_areas(F.col("area_tokens"), F.array().cast("array<string>"), F.lit("ns"), F.lit("Tdo"))
    return p.select("o_orderkey", "heading", "summary", F.array_join(found, ",").alias("areas"), "procedural")


@query("e2_tagged_summaries", "E2", sql="""
SELECT doc_id, CASE WHEN lang = 'en' THEN 'Téma ' || source ELSE '' END AS heading, 'O čem je ' || doc_id AS summary FROM documents""")
def tagged_summaries(t):
    raw = F.when(F.col("lang") == "en", F.concat(F.lit("**HESLO:** Téma "), "source", F.lit(".\nShrnutí:  O čem je "), "doc_id")).otherwise(
        F.concat(F.lit("O čem  je "), "doc_id"))
    return t.heavy("documents").select("doc_id", AN.parse_tagged_summary(raw).alias("a")).select("doc_id", "a.heading", "a.summary")


@query("e4_batch_headings", "E4 W6", sql="""
SELECT doc_id, batch, CASE WHEN quality = 1 THEN 'Nadpis ' || doc_id ELSE '' END AS new_heading
FROM (SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 20 AS INTEGER) AS batch FROM documents) LEFT JOIN labels USING (doc_id)""")
def batch_headings(t):
    from listwatch.operators.queues import batches
    asked = batches(t.documents.select("doc_id"), [F.col("doc_id")], 20).select("batch", F.col("doc_id").cast("string").alias("id"))
    answer = asked.join(t.labels.select(F.col("doc_id").cast("string").alias("id"), "quality"), "id").groupBy("batch").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.when(F.col("quality") == 1, F.concat(F.lit("Nadpis "), "id")).otherwise("Zastavení řízení"))))).alias("j"))
    raw = answer.select("batch", F.concat(F.lit("Tady: "), F.regexp_replace("j", r"\}$", ',"999999999":"Cizí"}')).alias("raw"))
    done = AN.accept_headings(asked, AN.batch_answers(raw, "batch", "raw"), "batch")
    return done.select(F.col("id").cast("bigint").alias("doc_id"), "batch", F.coalesce("new_heading", F.lit("")).alias("new_heading"))


@query("e6_applied_answers", "E6 T14", sql="""
SELECT doc_id, CASE WHEN quality = 0 THEN 'Ručně ' || doc_id WHEN lang = 'de' THEN 'Odmítnutí stížnosti' ELSE 'Smlouva ' || doc_id END AS heading,
  coalesce(quality = 0, false) AS manual, CASE WHEN quality = 0 OR lang <> 'de' THEN 4 ELSE 0 END AS version FROM documents LEFT JOIN labels USING (doc_id)""")
def applied_answers(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    new = F.when(F.col("lang") == "de", "Odmítnutí stížnosti").otherwise(F.concat(F.lit("Smlouva "), "doc_id"))
    s = AN.apply_answer(new, F.col("quality") == 0, F.concat(F.lit("Ručně "), "doc_id"), 4)
    return d.select("doc_id", s.alias("s")).select("doc_id", "s.heading", "s.manual", "s.version")


@query("e7_extracted_rows", "E7 P6 X3", sql="""
SELECT o_orderkey, CAST(o_custkey % 90 + 1 AS VARCHAR) || ' Cm ' || o_custkey || '/' || year(o_orderdate) AS mark, strftime(o_orderdate, '%Y-%m-%d') AS day,
  'Firma' || o_custkey || ' v. Beta' AS label FROM orders WHERE o_orderstatus <> 'P'""")
def extracted_rows(t):
    from listwatch.sources.rosters import hearings
    good = F.to_json(F.array(F.struct(
        F.date_format("o_orderdate", "d. M. yyyy").alias("datum"), F.lit("5").alias("sin"), F.lit("Jan Soudce").alias("predseda"),
        F.concat(F.col("o_custkey") % 90 + 1, F.lit("cm "), "o_custkey", F.lit(" / "), F.year("o_orderdate")).alias("spisova_znacka"),
        F.lit("9:00").alias("hodina"), F.array(F.concat(F.lit("Firma"), "o_custkey", F.lit(" s.r.o.")), F.lit("Beta a.s.")).alias("ucastnici"))))
    raw = F.when(F.col("o_orderstatus") == "P", '[{"datum":"32. 1. 2024","spisova_znacka":"x"},{"bad":1}]').otherwise(F.concat(F.lit("```"), good, F.lit("```")))
    rows = AN.extracted_rows(t.heavy("orders").select("o_orderkey", raw.alias("raw")), "o_orderkey", "raw",
                             "datum string, sin string, predseda string, spisova_znacka string, hodina string, ucastnici array<string>")
    h = hearings(rows, ["o_orderkey"], F.col("datum"), F.col("sin"), F.col("predseda"), F.col("spisova_znacka"), F.col("hodina"), F.col("ucastnici"))
    return h.select("o_orderkey", "mark", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("title").alias("label"))


@query("u5_distinct_by_id", "U5", sql="""
SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def distinct_by_id(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return scan.first_per_key(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("x23_labels", "X23", sql="""
SELECT o_orderkey, day(o_orderdate) || '. ' || month(o_orderdate) || '. ' || year(o_orderdate) AS czech,
  CASE o_custkey % 6 WHEN 0 THEN 'dnes' WHEN 1 THEN 'zítra' ELSE 'za ' || (o_custkey % 6) || CASE WHEN o_custkey % 6 <= 4 THEN ' dny' ELSE ' dní' END END AS relative,
  strftime(o_orderdate - INTERVAL (isodow(o_orderdate) - 1) DAY, '%Y-%m-%d') AS monday FROM orders""")
def labels(t):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", D.czech_day(day).alias("czech"),
                           D.relative_day(F.date_add(day, (F.col("o_custkey") % 6).cast("int")), day).alias("relative"),
                           F.date_format(D.monday_of(day), "yyyy-MM-dd").alias("monday"))


@query("a9_covered_titles", "A9", sql="""
WITH u AS (SELECT c_custkey, unnest([c_custkey % 7 + 1, c_custkey % 3 + 1, 99, 4, c_custkey % 7 + 1]) AS n FROM customer)
SELECT c_custkey, count(DISTINCT n) AS covered FROM u WHERE n <= (SELECT count(*) FROM nation) GROUP BY 1""")
def covered_titles(t):
    return DG.covered(digest_citations(t)[1], ["c_custkey"], "n_name")


@query("o2_calendar_order", "O2 A20", sql="""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY CASE WHEN o_custkey % 10 = 0 THEN 1441 ELSE (o_custkey % 3) * 60 END,
  (['Ch', 'Č', 'H', 'C', 'Z', 'Ž', 'cz', 'D'][o_orderkey % 8 + 1] || ' ' || o_custkey % 5) COLLATE cs, o_orderkey) AS position FROM orders""")
def calendar_order(t):
    k = F.col("o_custkey")
    clock = F.when(k % 10 != 0, F.concat((k % 3).cast("string"), F.lit(":00"))).otherwise("")
    marks = F.array(*[F.lit(m) for m in ("Ch", "Č", "H", "C", "Z", "Ž", "cz", "D")])
    mark = F.concat_ws(" ", F.get(marks, (F.col("o_orderkey") % 8).cast("int")), (k % 5).cast("string"))
    e = t.orders.select("o_orderkey", "o_orderdate", clock.alias("clock"), mark.alias("mark"))
    return CA.calendar_order(e, ["o_orderdate"], "clock", "mark", [F.col("o_orderkey")]).select("o_orderkey", "position")
