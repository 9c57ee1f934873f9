"""Whole records: enrichment handed over, page texts, windows of the archive, journals, health of a run, changes as rows."""

from pyspark.sql import Window as W, functions as F

from listwatch.functions.dates import link_period, older_window_start, range_label, window_start
from listwatch.functions.events import hearing_uid
from listwatch.operators import answers as A, events as EV, merge as M, publish as P, report as R, subscribe as SB
from listwatch.plans.registry import query
from listwatch.session import scratch_dir
from listwatch.sources import ical as IC, pages as PG
from listwatch.sources.archive import window_rows


@query("j3_enrichment_hand_over", "J3", sql="""
WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS court, o_custkey AS mark, o_orderstatus = 'O' AS prov, o_orderdate AS fs,
    CASE WHEN o_totalprice > 250000 THEN 'S' || o_orderkey WHEN o_totalprice > 150000 THEN '' END AS summary,
    CASE WHEN o_orderpriority < '3' THEN 'K' || (o_orderkey % 2) ELSE '' END AS kind FROM orders),
g AS (SELECT court, mark, kind, arg_min(id, (fs, id)) FILTER (WHERE NOT prov) AS official, bool_or(prov) AS any_prov,
    min(fs) FILTER (WHERE prov AND (court >= '3' OR summary <> '')) AS seen,
    arg_min(id, (fs, id)) FILTER (WHERE prov AND summary IS NOT NULL) AS giver FROM r GROUP BY ALL)
SELECT r.id, strftime(CASE WHEN r.id = official AND any_prov THEN least(r.fs, coalesce(seen, r.fs)) ELSE r.fs END, '%Y-%m-%d') AS first_seen,
  CASE WHEN r.id = official AND any_prov AND r.summary IS NULL THEN w.summary ELSE r.summary END AS summary,
  CASE WHEN r.id = official AND any_prov AND r.summary IS NULL THEN w.id WHEN r.summary IS NOT NULL THEN r.id END AS model,
  CASE WHEN r.prov THEN official END AS replaced_by
FROM r JOIN g USING (court, mark, kind) LEFT JOIN r w ON w.id = g.giver""")
def enrichment_hand_over(t):
    price = F.col("o_totalprice")
    given = F.struct(F.when(price > 250000, F.concat(F.lit("S"), "o_orderkey")).otherwise("").alias("summary"),
                     F.col("o_orderkey").cast("string").alias("model"))
    rows = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("mark"), F.col("o_orderpriority").alias("court"),
        (F.col("o_orderstatus") == "O").alias("early"), F.col("o_orderdate").alias("first_seen"),
        F.when(price > 150000, given).alias("enrichment"), F.lit(None).cast("string").alias("replaced_by"))
    # Courts of a priority under 3 hand over within a kind only, and the time only along with a summary.
    kind = F.when(F.col("court") < "3", F.concat(F.lit("K"), F.col("id").cast("bigint") % 2))
    done = M.hand_over_enrichment(rows, ["mark", "court"], F.col("early"), F.col("court") >= "3", kind)
    return done.select("id", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), "enrichment.summary", "enrichment.model", "replaced_by")


@query("j27_page_texts", "J27", sql="""
WITH i AS (SELECT doc_id, source || ' ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'S' ELSE '' END AS summary,
    CASE WHEN doc_id % 5 = 0 THEN text ELSE '' END AS base FROM documents),
p AS (SELECT page_id AS doc_id, CASE WHEN page_id % 2 = 0 THEN 'About ' || url ELSE '' END AS abstract,
    CASE WHEN page_id % 7 = 0 THEN NULL ELSE html END AS body FROM pages),
j AS (SELECT *, summary = '' AND base = '' AS wanted, CASE WHEN abstract <> '' THEN abstract ELSE coalesce(body, '') END AS got FROM i LEFT JOIN p USING (doc_id))
SELECT doc_id, CASE WHEN wanted THEN got <> '' END AS filled, CASE WHEN wanted AND abstract <> '' THEN abstract ELSE 'd' END AS description,
  md5(CASE WHEN wanted AND got <> '' THEN title || chr(10) || chr(10) || got ELSE base END) AS base_md5 FROM j""")
def page_texts(t):
    items = t.documents.select(
        "doc_id", F.concat_ws(" ", "source", "doc_id").alias("title"), F.lit("d").alias("description"),
        F.when(F.col("doc_id") % 3 == 0, "S").otherwise("").alias("summary"), F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise("").alias("base"))
    pages = t.pages.select(
        F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("About "), "url")).otherwise("").alias("abstract"),
        F.when(F.col("page_id") % 7 != 0, F.col("html")).alias("text"))
    return M.fill_from_pages(items, pages, "doc_id").select("doc_id", "filled", "description", F.md5("base").alias("base_md5"))


@query("f1_window_rows", "F1 F3", sql="""
SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-03-31 22:00:00' THEN 'current' ELSE 'older' END AS part FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-02-28 23:00:00' AND o_custkey % 4 <> 0""")
def window_of_archive(t):
    archive = t.orders.select("o_orderkey", F.col("o_orderdate").alias("first_seen"),
                              F.when(F.col("o_custkey") % 4 == 0, F.col("o_custkey").cast("string")).alias("replaced_by"))
    now = F.lit("1998-05-20 12:00:00").cast("timestamp")
    start, older = window_start(now), older_window_start(now)
    return (window_rows(archive, start).select("o_orderkey", F.lit("current").alias("part"))
            .unionByName(window_rows(archive, older, start).select("o_orderkey", F.lit("older").alias("part"))))


@query("a15_run_report", "A15", sql="""
WITH f AS (SELECT user_id, count(*) AS found, count(*) FILTER (WHERE event_type = 'signup') AS new, count(*) FILTER (WHERE event_type = 'error') AS deferred
    FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1),
e AS (SELECT user_id, count(*) AS errors, min('HTTP ' || json_extract_string(props, '$.k')) AS error FROM events WHERE ts < TIMESTAMP '2024-01-03' AND event_type = 'error' GROUP BY 1),
p AS (SELECT user_id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-02') AS before FROM events GROUP BY 1)
SELECT user_id, coalesce(found, 0) AS found, coalesce(new, 0) AS new, coalesce(deferred, 0) AS deferred, coalesce(errors, 0) AS errors, coalesce(error, '') AS error,
  CASE WHEN deferred > 0 AND new = 0 THEN 'only deferred'
    WHEN found IS NULL AND before = 0 AND errors IS NULL AND user_id % 7 <> 0 THEN 'empty twice' ELSE '' END AS warning
FROM p LEFT JOIN f USING (user_id) LEFT JOIN e USING (user_id)""")
def run_report(t):
    failed = F.col("event_type") == "error"
    found = t.events.where(F.col("ts") >= "2024-01-29").select("user_id", (F.col("event_type") == "signup").alias("is_new"), failed.alias("deferred"))
    errors = t.events.where(failed & (F.col("ts") < "2024-01-03")).select(
        "user_id", F.concat(F.lit("HTTP "), F.get_json_object("props", "$.k")).alias("error"))
    previous = t.events.groupBy("user_id").agg(F.count_if(F.col("ts") < "2024-01-02").alias("found")).withColumn(
        "error", F.when(F.col("user_id") % 7 == 0, "timeout"))
    return R.run_report(found, errors, previous, "user_id")


@query("p3_registered_journals", "P3 F15", sql="""
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'OLD' || upper(source) WHEN doc_id % 3 = 2 AND doc_id % 2 = 0 THEN 'NONE' ELSE upper(source) END AS abbreviation,
  CASE WHEN doc_id % 3 = 2 AND doc_id % 2 = 0 THEN '' ELSE 'j-' || source END AS journal, 'Title ' || doc_id AS title FROM documents WHERE source IS NOT NULL""")
def registered_journals(t):
    d = t.documents.where(F.col("source").isNotNull())
    registry = d.select("source").distinct().select(
        F.concat(F.lit("j-"), "source").alias("journal"), F.upper("source").alias("abbreviation"),
        F.array(F.concat(F.lit("OLD"), F.upper("source"))).alias("former"))
    third = F.col("doc_id") % 3
    code = (F.when(third == 1, F.concat(F.lit("OLD"), F.upper("source"))).when((third == 2) & (F.col("doc_id") % 2 == 0), "NONE")
            .otherwise(F.upper("source")))
    cols = P.journal_row(F.concat(F.lit("["), code, F.lit("] Title "), "doc_id"), F.lit(""), F.lit(""), F.lit(""))
    rows = d.select("doc_id", *[c.alias(n) for n, c in cols.items()])
    return P.in_registry(rows, registry).select("doc_id", "abbreviation", "journal", "title")


@query("p7_recent_referrals", "P7 P2", sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'J' || o_custkey WHEN o_orderstatus = 'F' THEN 'M' || o_custkey ELSE '' END AS judge
FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-06-01'""")
def recent_referrals(t):
    rows = P.recent_referrals(t.orders, "o_orderdate", F.lit("1998-07-15").cast("date"))
    own = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("J"), "o_custkey"))
    meta = F.create_map(F.when(F.col("o_orderstatus") == "F", "judge").otherwise("panel"), F.concat(F.lit("M"), "o_custkey"))
    return rows.select("o_orderkey", P.shown_judge(own, meta).alias("judge"))


@query("j19_change_rows", "J19", sql="""
SELECT o_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS found, l_returnflag || l_linenumber AS wording
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linestatus = 'F') l ON l_orderkey = o_orderkey""")
def change_rows(t):
    changes = t.lineitem.where(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").alias("o_orderkey"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("found"),
        F.concat("l_returnflag", "l_linenumber").alias("wording"))
    return SB.change_rows(t.orders.select("o_orderkey"), changes, ["o_orderkey"])


@query("p5_event_rows", "P5", sql="""
WITH r AS (SELECT *, 'Seminář číslo ' || o_orderkey AS name, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT substr(sha1('org' || (o_custkey % 9) || '|' || strftime(d, '%Y-%m-%d') || '|seminar cislo ' || o_orderkey), 1, 20) AS id, name AS title, strftime(d, '%Y-%m-%d') AS day,
  CASE WHEN o_custkey % 3 = 0 THEN strftime(d + 2, '%Y-%m-%d') END AS last_day, '09:05' AS starts, CASE WHEN o_custkey % 2 = 0 THEN '17:30' ELSE '' END AS ends,
  CASE WHEN o_orderkey % 4 = 0 THEN 'hybridne' WHEN o_orderkey % 4 = 1 THEN 'online' ELSE 'prezencne' END AS form,
  CASE WHEN o_custkey % 5 = 0 THEN 8 ELSE 2 END AS lecturers, 600 AS note,
  CASE o_custkey % 3 WHEN 0 THEN 'https://www.example.org/a%20' || o_orderkey WHEN 1 THEN 'https://example.org/' || o_orderkey ELSE '' END AS url
FROM r WHERE o_orderstatus <> 'P' AND o_totalprice >= 1000""")
def event_rows(t):
    key, day, odd = F.col("o_orderkey").cast("string"), F.col("o_orderdate").cast("date"), F.col("o_custkey") % 3
    prefix = F.when(F.col("o_orderkey") % 4 == 0, "HYBRIDNÍ FORMA: ").when(F.col("o_orderkey") % 4 == 1, "Online – ").otherwise("")
    raw = t.heavy("orders").select(
        F.concat(F.lit("org"), F.col("o_custkey") % 9).alias("organiser"),
        F.concat(F.when(F.col("o_orderstatus") == "P", "ZRUŠENO ").otherwise(""), prefix, F.lit(" Seminář  číslo "), key).alias("title"),
        F.when(F.col("o_totalprice") >= 1000, F.date_format(day, "d. M. yyyy")).otherwise("brzy").alias("day"),
        F.when(odd == 0, F.date_add(day, 2).cast("string")).when(odd == 1, F.date_sub(day, 1).cast("string")).alias("last_day"),
        F.lit("od 9.05 hod.").alias("starts"), F.when(F.col("o_custkey") % 2 == 0, "17:30").alias("ends"), F.lit(" Praha ").alias("place"),
        F.when(F.col("o_custkey") % 5 == 0, "A;B;C; D;E;F;G;H;I;J").otherwise("Jan Novák;\n Eva Malá ; ").alias("lecturers"),
        F.repeat(F.lit("Anotace "), 90).alias("note"),
        F.when(odd == 0, F.concat(F.lit("/a "), key)).when(odd == 1, F.concat(F.lit("https://example.org/"), key))
        .otherwise(F.concat(F.lit("https://badexample.org/"), key)).alias("url"))
    done = EV.normalise_events(raw, "organiser", F.array(F.lit("example.org")), "https://www.example.org")
    return done.select("id", "title", F.col("day").cast("string").alias("day"), F.col("last_day").cast("string").alias("last_day"), "starts",
                       "ends", "form", F.size("lecturers").alias("lecturers"), F.length("note").alias("note"), "url")


@query("e7_event_answers", "E7 P5", sql="""
SELECT user_id, 'Kurz ' || event_type AS title, strftime(CAST(min(ts) AS DATE), '%Y-%m-%d') AS day, strftime(min(ts), '%H:%M') AS starts, 'online' AS form
FROM events WHERE user_id % 10 <> 0 AND event_type <> 'error' GROUP BY user_id, event_type""")
def event_answers(t):
    # An answer holds one object per kind of event of the user, so its size is bounded.
    kinds = t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))
    entry = F.struct(F.concat(F.lit("Kurz "), "event_type").alias("title"),
                     F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("day"),
                     F.date_format("ts", "H:mm").alias("starts"), F.lit("webinář").alias("form"))
    listed = kinds.groupBy("user_id").agg(F.to_json(F.collect_list(entry)).alias("json"))
    raw = listed.select("user_id", F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("Nalezeno:\n"), "json", F.lit("\nKonec.")))
                        .otherwise("Nic jsem nenašel.").alias("raw"))
    rows = A.extracted_rows(raw, "user_id", "raw", ", ".join(f"{n}: string" for n in EV.RAW_FIELDS))
    done = EV.normalise_events(rows, "user_id", F.array().cast("array<string>"), "")
    return done.select("user_id", "title", F.col("day").cast("string").alias("day"), "starts", "form")


@query("e4_batch_areas", "E4", sql="""
SELECT o_orderkey // 20 AS batch, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey // 20 % 4 = 0 OR o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN ''
  WHEN o_orderstatus = 'P' THEN 'it' ELSE o_orderstatus || ',it' END AS areas FROM orders""")
def batch_areas(t):
    batch = F.floor(F.col("o_orderkey") / 20).alias("batch")
    asked = t.orders.select(batch, F.col("o_orderkey").cast("string").alias("id"))
    value = F.when(F.col("o_orderkey") % 5 == 0, F.lit('"none"')).otherwise(
        F.to_json(F.array("o_orderstatus", F.lit("it"), F.lit("unknown"), F.lit("it"))))
    entry = F.concat(F.lit('"'), "o_orderkey", F.lit('":'), value)
    # Twenty ids make a batch.
    texts = t.orders.where("o_orderkey % 7 <> 0").groupBy(batch).agg(F.array_join(F.collect_list(entry), ",").alias("body"))
    answers = texts.select("batch", F.when(F.col("batch") % 4 != 0, F.concat(F.lit('{"stranger":["it"],'), "body", F.lit("}"))).alias("raw"))
    known = F.array(*map(F.lit, ("it", "F", "O")))
    done = A.accept_areas(asked, A.batch_answers(answers, "batch", "raw"), "batch", known)
    return done.select("batch", "id", F.array_join("areas", ",").alias("areas"))


@query("e4_batch_people", "E4", sql="""
SELECT c_custkey // 25 AS batch, c_name AS name, CASE WHEN c_custkey // 25 % 5 = 0 THEN 'open' WHEN c_acctbal > 0 THEN 'person' ELSE 'other' END AS verdict FROM customer""")
def batch_people(t):
    batch = F.floor(F.col("c_custkey") / 25).alias("batch")
    asked = t.customer.select(batch, F.col("c_name").alias("name"))
    # Twenty-five names make a batch.
    lists = t.customer.groupBy(batch).agg(F.to_json(F.collect_list(F.when(F.col("c_acctbal") > 0, F.col("c_name")))).alias("json"))
    answers = lists.select("batch", F.when(F.col("batch") % 5 != 0, F.concat(F.lit("Osoby: "), "json")).otherwise("Nevím.").alias("raw"))
    return A.judged_people(asked, answers, "batch", "raw")


@query("s14_calendar_file", "S14", sql=r"""
SELECT o_orderkey, sha1(o_orderpriority || '|' || o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || clock) AS uid, strftime(o_orderdate, '%Y%m%d') AS day,
  'Jednání\, č. ' || o_orderkey || '\; ' || o_orderpriority AS summary, true AS in_order, true AS framed
FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN '' ELSE '9:30' END AS clock FROM orders)""")
def calendar_file(t):
    day, empty = F.col("o_orderdate").cast("date"), F.lit("")
    events = t.orders.select(
        "o_orderkey", day.alias("day"), F.when(F.col("o_orderstatus") == "F", "").otherwise("9:30").alias("clock"),
        F.col("o_orderpriority").alias("court"), F.col("o_custkey").cast("string").alias("mark"))
    title = F.concat(F.lit("Jednání, č. "), "o_orderkey", F.lit("; "), "court")
    uid = hearing_uid(F.col("court"), F.col("mark"), F.col("day"), F.col("clock"))
    blocks = IC.with_event_block(events, "block", uid, "20240101T000000Z", F.col("day"), F.lit(None).cast("date"), F.col("clock"), empty,
                                 title, empty, empty, empty)
    lines = IC.calendar_lines(blocks, "block", ["day", "o_orderkey"], "Jednání", "listwatch")
    path = f"{scratch_dir(t.spark, 'calendar')}/file"
    IC.write_calendar(lines, ["day", "o_orderkey"], path)
    # Parts in the order of their names are the file; it is read an event at a time, in the order of parts, splits and rows.
    read = IC.read_calendar(t.spark, path)
    at = F.struct("part", "block", "at")
    frame = read.agg(F.min_by("text", at).startswith("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n")
                     & F.max_by("text", at).endswith("END:VCALENDAR\r\n")).scalar()
    each = read.where(F.col("text").contains("BEGIN:VEVENT\r\n")).select(
        "part", "block", "at", F.regexp_extract("text", r"(?s)BEGIN:VEVENT\r\n(.*)", 1).alias("event"))
    found = each.select(
        "part", "block", "at", F.regexp_extract("event", r"(?m)^UID:(\S+)", 1).alias("uid"), F.regexp_extract("event", r"(?m)^DTSTART[^:]*:(\d{8})", 1).alias("day"),
        F.regexp_extract("event", r"(?m)^SUMMARY:([^\r\n]*)", 1).alias("summary"))
    key = F.regexp_extract("summary", r"č\. (\d+)", 1).cast("bigint")
    place, bounds = W.partitionBy("part", "block").orderBy("at"), F.struct("day", key.alias("key"))
    found = found.withColumns({"o_orderkey": key, "in_part": F.coalesce(F.lag(bounds).over(place) <= bounds, F.lit(True))})
    # Between splits: the last event of all earlier ones, one row per split.
    ends = found.groupBy("part", "block").agg(F.min(bounds).alias("first"), F.max(bounds).alias("last"))
    ends = ends.select("part", "block", (F.col("first") >= F.coalesce(F.lag("last").over(W.orderBy("part", "block")), "first")).alias("after"))
    return found.join(ends, ["part", "block"]).select(
        "o_orderkey", "uid", "day", "summary", (F.col("in_part") & F.col("after")).alias("in_order"), frame.alias("framed"))


@query("x8_link_periods", "X8 X23", sql="""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, least(day(o_orderdate) + o_custkey % 9, 28) AS last FROM orders WHERE o_orderstatus <> 'P'),
p AS (SELECT *, make_date(year(d), month(d), last) AS e FROM o)
SELECT o_orderkey, CASE WHEN e >= d THEN strftime(d, '%Y-%m-%d') END AS start, CASE WHEN e >= d THEN strftime(e, '%Y-%m-%d') END AS stop,
  CASE WHEN e >= d THEN day(d) || '. ' || month(d) || '. – ' || day(e) || '. ' || month(e) || '. ' || year(e) END AS label FROM p
UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderstatus = 'P'""")
def link_periods(t):
    day = F.col("o_orderdate").cast("date")
    last = F.least(F.dayofmonth(day) + F.col("o_custkey") % 9, F.lit(28))
    dates = F.concat_ws("-", F.dayofmonth(day), last, F.month(day), F.year(day))
    url = F.concat(F.lit("https://example.org/hearings-"), dates, F.when(F.col("o_orderstatus") == "P", "-draft").when(F.col("o_custkey") % 2 == 0, "/").otherwise(""))
    rows = t.orders.select("o_orderkey", link_period(url).alias("p"))
    return rows.select("o_orderkey", F.col("p.start").cast("string").alias("start"), F.col("p.end").cast("string").alias("stop"),
                       range_label(F.col("p.start"), F.col("p.end")).alias("label"))


@query("s18_link_kinds", "S18", sql="""
SELECT o_orderkey, 'calendar' AS kind, 'https://x.example/feed/' || o_orderkey || '.ics?x=1' AS href FROM orders WHERE o_custkey % 2 = 0
UNION ALL SELECT o_orderkey, 'document', '/documents/' || o_orderkey FROM orders
UNION ALL SELECT o_orderkey, 'document', 'https://x.example/p' || o_custkey || '.PDF' FROM orders
UNION ALL SELECT o_orderkey, 'invitation', 'https://x.example/p' || o_custkey || '.PDF' FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, 'invitation', 'https://sub.x.example/i' FROM orders""")
def link_kinds(t):
    key, mark = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    anchors = (
        (F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("webcal://x.example/feed/"), key, F.lit(".ics?x=1"))).otherwise("/feed"), F.lit("Kalendář")),
        (F.concat(F.lit("/documents/"), key), F.lit("Rozvrh")),
        (F.concat(F.lit("https://x.example/p"), mark, F.lit(".PDF")), F.when(F.col("o_orderstatus") == "P", "Ceník").otherwise("Program (program.pdf)")),
        (F.lit("https://sub.x.example/i"), F.lit("<b>Pozvánka</b> na seminář")), (F.lit("https://badx.example/i"), F.lit("Pozvánka")))
    html = F.concat(*[F.concat(F.lit('<a class="l" href="'), href, F.lit('">'), text, F.lit("</a> ")) for href, text in anchors])
    links = PG.extract_links(t.heavy("orders").select("o_orderkey", html.alias("html")), ["o_orderkey"], "html")
    return PG.link_kinds(links, ["o_orderkey"], F.array(F.lit("x.example"))).select("o_orderkey", "kind", "href")
