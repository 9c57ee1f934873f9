"""Sources and scalar functions over text that Spark derives from the driver tables."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from listwatch.functions import dates as D, events as E, legal as L, links as LK, loose as LO, marks as M, names as N, text as T, titles as TI
from listwatch.plans.registry import Tables, query
from listwatch.sources import feeds as FE, ical as IC, pages as PG, rosters as RO
from listwatch.sources.parsers import ParserRegistry

def blank():
    return F.lit("")


def day_text(c, fmt="yyyy-MM-dd"):
    return F.coalesce(F.date_format(c, fmt), blank())


LINK_SQL = r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h,
   regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS x FROM pages),
l AS (SELECT page_id, CAST(unnest(range(len(h))) AS INTEGER) AS pos, unnest(h) AS href, unnest(x) AS inner_html FROM a)
"""


def page_links(t: Tables):
    return PG.extract_links(t.heavy("pages"), ["page_id"], "html")


@query("s10_page_links", "S10", sql=LINK_SQL + "SELECT page_id, pos, replace(href, '&amp;', '&') AS href FROM l")
def page_link_rows(t):
    return page_links(t).select("page_id", "pos", "href")


@query("s10_article_links", "S10 W3 O4", sql=LINK_SQL + r""",
g AS (SELECT page_id, pos, href, lower(href) AS guid, trim(regexp_replace(replace(regexp_replace(inner_html, '<[^>]+>', '', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM l WHERE href LIKE '/%'),
b AS (SELECT page_id, guid, arg_min(text, (-length(text), pos)) AS text, min(pos) AS first_pos FROM g WHERE text <> '' GROUP BY 1, 2)
SELECT page_id, guid, text, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_pos, guid) AS INTEGER) AS rank FROM b QUALIFY rank <= 25""")
def article_links(t):
    return PG.article_links(page_links(t), ["page_id"], "^/", F.lower("href"), 25).select("page_id", "guid", "text", "rank")


@query("a4_link_shapes", "A4", sql=LINK_SQL + r"""
SELECT regexp_replace(split_part(split_part(href, '#', 1), '?', 1), '[0-9]+', 'N', 'g') AS shape, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, shape LIMIT 8""")
def link_shapes(t):
    from listwatch.operators.report import link_shapes as shapes
    return shapes(page_links(t), "href")


@query("a4_url_shapes", "A4 X19", sql=r"""
SELECT page_id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '[0-9]+', 'N', 'g') ||
  CASE WHEN contains(split_part(url, '#', 1), '?') THEN '?' || array_to_string(list_sort(list_distinct(list_transform(split(split_part(split_part(url, '#', 1), '?', 2), '&'), lambda p: split_part(p, '=', 1)))), '&') ELSE '' END AS shape,
  regexp_replace(url, '[?#].*$', '') AS address FROM pages""")
def url_shapes(t):
    return t.heavy("pages").select("page_id", LK.link_shape(F.col("url")).alias("shape"), LK.without_query(F.col("url")).alias("address"))


@query("f22_allowed_hosts", "F22", sql=r"""
SELECT page_id, regexp_matches(url, '^https?://([a-z0-9-]+\.)*example\.(com|net)([/?#:]|$)') AS allowed FROM pages""")
def allowed_hosts(t):
    hosts = F.array(F.lit("example.com"), F.lit("example.net"))
    return t.heavy("pages").select("page_id", LK.allowed_link(F.col("url"), hosts).alias("allowed"))


@query("s18_picked_links", "S18", sql=LINK_SQL + r""",
k AS (SELECT page_id, pos, href, CASE WHEN contains(t, 'the') THEN 0 WHEN contains(t, 'und') THEN 1 WHEN contains(t, 'de') OR contains(t, 'la') THEN 2 ELSE 3 END AS pass
  FROM (SELECT *, strip_accents(lower(href)) AS t FROM l))
SELECT page_id, arg_min(replace(href, '&amp;', '&'), (pass, pos)) AS href, CAST(min(pass) AS INTEGER) AS pass FROM k GROUP BY 1""")
def picked_links(t):
    links = page_links(t).withColumn("haystack", T.fold(F.col("href")))
    return PG.pick_links(links, ["page_id"], ["the", "und"], ["de", "la"]).select("page_id", "href", "pass")


@query("s17_page_text", "S17 F18", sql=r"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
  '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<nav\b[^>]*>.*?</nav\s*>', '', 'g'),
  '(?is)<header\b[^>]*>.*?</header\s*>', '', 'g'), '(?is)<footer\b[^>]*>.*?</footer\s*>', '', 'g'), '(?is)<form\b[^>]*>.*?</form\s*>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<br\s*/?>|</p\s*>|</div\s*>|</tr\s*>|</h\d\s*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS h FROM s),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(h, '[\t\r\f\v\p{Zs}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM e""")
def page_text(t):
    return t.heavy("pages").select("page_id", PG.page_text(F.col("html")).alias("text"))


@query("s17_text_with_links", "S17", sql=r"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
  '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<nav\b[^>]*>.*?</nav\s*>', '', 'g'),
  '(?is)<header\b[^>]*>.*?</header\s*>', '', 'g'), '(?is)<footer\b[^>]*>.*?</footer\s*>', '', 'g'), '(?is)<form\b[^>]*>.*?</form\s*>', '', 'g') AS h FROM pages),
l AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<a\b[^>]*?href\s*=\s*["'']/([^"'']*)["''][^>]*>(.*?)</a>', '\2 &lt;https://listing.example/\1&gt;', 'g'),
  '(?is)<a\b[^>]*?href\s*=\s*["''](http[^"'']*)["''][^>]*>(.*?)</a>', '\2 &lt;\1&gt;', 'g') AS h FROM s),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<br\s*/?>|</p\s*>|</div\s*>|</tr\s*>|</h\d\s*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS h FROM l),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM b)
SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(h, '[\t\r\f\v\p{Zs}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' ' || chr(10)), '\n{2,}', chr(10), 'g') AS text FROM e""")
def text_with_links(t):
    return t.heavy("pages").select("page_id", PG.page_text_with_links(F.col("html"), "https://listing.example").alias("text"))


def order_table(t: Tables):
    """One page per customer: a table with a row per order, in the shape of a notice board."""
    row = F.concat(F.lit("<tr><td>"), F.col("o_custkey") % 40 + 1, F.lit("&nbsp;Cdo "), "o_orderkey", F.lit(" / "), F.year("o_orderdate"),
                   F.when(F.col("o_orderstatus") == "P", "- II.").otherwise(""), F.lit("</td><td><b>"), F.date_format("o_orderdate", "d. M. yyyy"),
                   F.lit("</b></td><td>"), "o_orderstatus", F.lit("</td><td><a href='/doc/"), "o_orderkey", F.lit(" a.pdf'>PDF</a></td></tr>"))
    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("rs"))
    html = F.concat(F.lit("<table><tr><th>h</th></tr>"), F.array_join(F.transform("rs", lambda r: r["r"]), "\n"), F.lit("</table>"))
    return rows.select(F.col("o_custkey").alias("page"), html.alias("html"))


@query("s9_table_rows", "S9", sql="""
SELECT o_custkey AS page, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS row_no, CAST(4 AS INTEGER) AS cells, o_orderstatus AS third FROM orders
UNION ALL SELECT DISTINCT o_custkey, 0, 0, '' FROM orders""")
def table_rows(t):
    rows = PG.table_rows(order_table(t), ["page"], "html")
    return rows.select("page", "row_no", PG.cell_text(2).alias("third"), F.size("cells").alias("n")).withColumnRenamed("n", "cells")


@query("s9_board_decisions", "S9 F28 X3 X5 P7", sql="""
SELECT 'ns:deska:' || (o_custkey % 40 + 1) || 'cdo' || o_orderkey || '/' || year(o_orderdate) || CASE WHEN o_orderstatus = 'P' THEN '-II' ELSE '' END AS id,
  (o_custkey % 40 + 1) || ' Cdo ' || o_orderkey || '/' || year(o_orderdate) || CASE WHEN o_orderstatus = 'P' THEN ' - II.' ELSE '' END AS mark,
  CAST(o_custkey % 40 + 1 AS INTEGER) AS senate, 'Cdo' AS register, 'https://court.example/doc/' || o_orderkey || '%20a.pdf' AS document, strftime(o_orderdate, '%Y-%m-%d') AS decided
FROM orders WHERE o_orderdate BETWEEN DATE '1996-03-01' AND DATE '2000-02-28'""")
def board_decisions(t):
    rows = PG.table_rows(order_table(t), ["page"], "html")
    board = PG.board_decisions(rows, ["page"], "https://court.example")
    return PG.on_board(board, F.lit("1996-03-01"), F.lit("2000-02-28")).select("id", "mark", "senate", "register", "document", "decided")


@query("s9_event_rows", "S9 X5 X11", sql="""
SELECT o_orderkey, 'Seminář ' || o_custkey || CASE WHEN o_orderstatus = 'O' THEN ' online' ELSE '' END AS title, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN o_custkey % 2 = 0 THEN strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') ELSE '' END AS last_day, '9:00' AS starts,
  CASE WHEN o_orderstatus = 'F' THEN '12:30' ELSE '' END AS ends, 'https://bar.example/akce/' || o_orderkey AS url,
  CASE WHEN o_orderstatus = 'O' THEN 'online' ELSE 'prezencne' END AS form FROM orders""")
def event_rows(t):
    html = F.concat(F.lit("<tr><td><a href=\"/akce/"), "o_orderkey", F.lit("\">Seminář "), "o_custkey", F.when(F.col("o_orderstatus") == "O", " online").otherwise(""),
                    F.lit("</a></td><td>"), F.date_format("o_orderdate", "dd.MM.yyyy"),
                    F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("-"), F.date_format(F.date_add("o_orderdate", 3), "dd.MM.yyyy"))).otherwise(""),
                    F.lit(" (9.00"), F.when(F.col("o_orderstatus") == "F", " - 12:30").otherwise(""), F.lit(")</td><td>Praha</td></tr>"))
    rows = PG.table_rows(t.heavy("orders").select("o_orderkey", html.alias("html")), ["o_orderkey"], "html")
    return PG.event_rows(rows, ["o_orderkey"], "https://bar.example").select(
        "o_orderkey", "title", day_text("day").alias("day"), day_text("last_day").alias("last_day"), "starts", "ends", "url", "form")


@query("s9_register_rows", "S9 X3", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS decided, '21 Afs ' || o_custkey || '/' || year(o_orderdate) || '-32' AS mark, '1 NSS' AS panel, lower(o_orderpriority) AS kind, o_orderstatus AS outcome, 'Alfa, Beta' AS parties FROM orders""")
def register_rows(t):
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    html = F.concat(F.lit("<tr><td>x</td><td><input type='hidden' name='row[0].ID' value='"), "o_orderkey", F.lit("'/></td>"),
                    cell(F.date_format("o_orderdate", "d.M.yyyy")), cell(F.concat(F.lit("21 Afs &nbsp; "), "o_custkey", F.lit(" / "), F.year("o_orderdate"), F.lit(" -  32"))),
                    cell(F.lit("1  NSS")), cell("o_orderpriority"), cell("o_orderstatus"), cell(F.lit("a")), cell(F.lit("b")), cell(F.lit("Alfa,<br>Beta")), F.lit("</tr>"))
    rows = PG.table_rows(t.heavy("orders").select("o_orderkey", html.alias("html")), ["o_orderkey"], "html")
    return PG.register_rows(rows, ["o_orderkey"]).drop("o_orderkey", "row_no")


@query("s9_search_rows", "S9 P7", sql="""
SELECT upper('unid' || o_orderkey) AS unid, (o_custkey % 30 + 1) || ' Cdo ' || o_orderkey || '/' || year(o_orderdate) AS mark, 'https://court.example/WebSearch/' || o_orderkey AS url,
  'https://court.example/f/' || o_orderkey || '.pdf' AS pdf FROM orders WHERE o_orderstatus <> 'P'""")
def search_rows(t):
    html = F.concat(F.lit("<table id='tabl'><tr><td><input name='ids' value='unid"), "o_orderkey", F.lit("'></td><td class=\"td-short-wrap\">"),
                    F.when(F.col("o_orderstatus") == "P", "Krajský soud").otherwise("Nejvyšší soud"), F.lit("</td><td><a class=\"odk\" href='/WebSearch/"), "o_orderkey", F.lit("'>"),
                    F.col("o_custkey") % 30 + 1, F.lit(" Cdo "), "o_orderkey", F.lit(" / "), F.year("o_orderdate"), F.lit("</a></td><td class='icons'><a href='/f/"), "o_orderkey", F.lit(".pdf'>x</a></td></tr></table>"))
    rows = PG.table_rows(t.heavy("orders").select("o_orderkey", html.alias("html")), ["o_orderkey"], "html")
    return PG.search_decisions(rows, ["o_orderkey"], "https://court.example", "Nejvyšší soud").select("unid", "mark", "url", "pdf")


@query("s11_labelled_values", "S11", sql="""
SELECT o_orderkey, 'Druh' AS label, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'Heslo', CASE WHEN o_custkey % 2 = 0 THEN 'A; B' ELSE 'A' END FROM orders""")
def labelled_values(t):
    html = F.concat(F.lit("<table><tr><td>Druh :</td><td>"), "o_orderstatus", F.lit("</td></tr><tr><td>Heslo</td><td>A</td></tr><tr><td>Heslo</td><td>"),
                    F.when(F.col("o_custkey") % 2 == 0, "B").otherwise("A"), F.lit("</td></tr></table>"))
    rows = PG.table_rows(t.heavy("orders").select("o_orderkey", html.alias("html")), ["o_orderkey"], "html")
    return PG.labelled_values(rows, ["o_orderkey"])


@query("s11_field_values", "S11", sql="""
SELECT o_orderkey, 'cj' AS field, 'M' || o_custkey AS value FROM orders UNION ALL SELECT o_orderkey, 'predpisy', '§ 36 odst. ' || (o_custkey % 5 + 1) || ' zákona č. 500/' || year(o_orderdate) || ' Sb.' FROM orders""")
def field_values(t):
    law = PG.statute_citation(blank(), F.lit("36"), (F.col("o_custkey") % 5 + 1).cast("string"), blank(), F.lit("zákona"), F.lit("500"), F.year("o_orderdate").cast("string"))
    html = F.concat(F.lit("<div data-field-id='cj'><span class='det-textval'> M"), "o_custkey", F.lit("</span></div><div data-field-id='predpisy'><span class='det-textval'>"),
                    law, F.lit("</span></div>"))
    return PG.field_values(t.heavy("orders").select("o_orderkey", html.alias("html")), ["o_orderkey"], "html")


@query("s12_embedded_events", "S12 X7 X24", sql="""
SELECT o_orderkey, 'Akce ' || o_custkey AS title, strftime(timezone('Europe/Prague', (o_orderdate + INTERVAL 23 HOUR) AT TIME ZONE 'UTC'), '%Y-%m-%d') AS day,
  strftime(timezone('Europe/Prague', (o_orderdate + INTERVAL 23 HOUR) AT TIME ZONE 'UTC'), '%H:%M') AS starts,
  CASE WHEN o_orderstatus = 'F' THEN 'Sál, Ulice 1, Praha' ELSE '' END AS place, CASE WHEN o_orderstatus = 'F' THEN 'hybridne' ELSE 'online' END AS form,
  'Jan,Eva' AS lecturers, CASE WHEN o_custkey % 3 = 0 THEN 'zdarma' ELSE (o_custkey % 3 * 100) || ' Kč' END AS price FROM orders""")
def embedded_events(t):
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'23:00:00'Z'")
    virtual = F.lit('{"@type":"VirtualLocation","url":"x"}')
    where = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('[{"@type":"Place","name":"Sál","address":{"streetAddress":"Ulice 1","addressLocality":"Praha"}},'), virtual, F.lit("]"))).otherwise(virtual)
    event = F.concat(F.lit('{"@type":"EducationEvent","name":"Akce '), "o_custkey", F.lit('","startDate":"'), at, F.lit('","location":'), where,
                     F.lit(',"performer":[{"name":"Jan"},"Eva"],"offers":{"price":"'), F.col("o_custkey") % 3 * 100, F.lit('"}}'))
    shape = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit('{"@graph":[{"@type":"WebPage"},{"@type":"ItemList","itemListElement":[{"item":'), event, F.lit("}]}]}"))).otherwise(
        F.concat(F.lit("["), event, F.lit("]")))
    html = F.concat(F.lit('<html><script type="application/ld+json">'), shape, F.lit('</script><script type="application/ld+json">{broken</script></html>'))
    out = PG.embedded_events(t.heavy("orders").select("o_orderkey", html.alias("html")), ["o_orderkey"], "html")
    return out.select("o_orderkey", "title", day_text("day").alias("day"), "starts", "place", "form", F.array_join("lecturers", ",").alias("lecturers"), "price")


@query("s5_feed_items", "S5 F6 X5 X12 X13 X19", sql="""
SELECT o_orderkey, 'Title ' || o_custkey || ' & more' AS title, CASE WHEN o_orderstatus = 'F' THEN '10.1093/x' || o_orderkey ELSE '' END AS doi,
  CASE WHEN o_orderstatus = 'F' THEN 'https://doi.org/10.1093/x' || o_orderkey ELSE 'https://j.example/a/' || o_orderkey END AS link, 'Jan Novák, Eva Malá' AS authors,
  'Text ' || o_orderpriority AS abstract, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY""")
def feed_items(t):
    rss = F.concat(F.lit("<rss><channel><title>c</title><lastBuildDate>Fri, 03 Aug 2001 10:00:00 GMT</lastBuildDate><item><title><![CDATA[Title "), "o_custkey", F.lit(" &amp; more]]></title><link>https://j.example/a/"), "o_orderkey",
                   F.lit("?rss=1</link><pubDate>Po, "), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(" 02:00:00 +0200</pubDate><dc:creator>Jan Novák (Author)</dc:creator><dc:creator>Eva Malá; jan novák</dc:creator><description>&lt;p&gt;Abstract Text "), "o_orderpriority",
                   F.lit("&lt;/p&gt;</description>"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("<prism:doi>10.1093/X"), "o_orderkey", F.lit("</prism:doi>"))).otherwise(""), F.lit("</item></channel></rss>"))
    atom = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title type='html'>Title "), "o_custkey", F.lit(" &amp;amp; more</title><link rel='self' href='https://j.example/feed'/><link href='https://j.example/a/"), "o_orderkey",
                    F.lit("'/><published>"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'"), F.lit("</published><author><name>Jan Novák</name></author><author><name>Eva Malá</name></author><summary>Text "), "o_orderpriority",
                    F.lit(" Volume 63 Online ISSN 0165-075X</summary>"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("<id>x</id><dc:identifier>doi:10.1093/x"), "o_orderkey", F.lit("</dc:identifier>"))).otherwise(""), F.lit("</entry></feed>"))
    feeds = t.heavy("orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, rss).otherwise(atom).alias("xml"))
    items = FE.feed_items(feeds, ["o_orderkey"], "xml", F.lit("2001-08-01").cast("timestamp"))
    return items.select("o_orderkey", "title", "doi", "link", "authors", "abstract", day_text("published").alias("published"))


@query("s6_works", "S6 X13", sql="""
SELECT '10.1/' || o_custkey AS doi, arg_min('Title ' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN ' – Decision of X' ELSE '' END, o_orderkey) AS title, 'Jan Novák, Eva Malá' AS authors,
  arg_min(o_orderstatus = 'F', o_orderkey) AS is_decision, strftime(arg_min(o_orderdate, o_orderkey), '%Y-%m') || '-01' AS published FROM orders GROUP BY o_custkey""")
def works(t):
    raw = F.concat(F.lit('{"message":{"items":[{"DOI":"10.1/'), "o_custkey", F.lit('","title":["Title <i>'), "o_orderkey", F.lit('</i>"],"author":[{"given":"Jan","family":"Novák"},{"given":"Eva","family":"Malá"}],'),
                   F.when(F.col("o_orderstatus") == "F", '"subtitle":["Decision of X; ECLI:1"],').otherwise(""), F.lit('"issued":{"date-parts":[['), F.year("o_orderdate"), F.lit(","), F.month("o_orderdate"), F.lit(']]}},{"DOI":""}]}}'))
    out = FE.works(t.heavy("orders").select("o_orderkey", raw.alias("raw")), "raw", "o_orderkey")
    return out.select("doi", "title", "authors", "is_decision", day_text("published").alias("published"))


@query("s7_query_bindings", "S7 X4 F13", sql="""
SELECT '6' || (1990 + o_custkey // 10000) || 'CJ' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS celex, 'C-' || o_custkey % 10000 || '/' || substr(CAST(1990 + o_custkey // 10000 AS VARCHAR), 3, 2) AS mark,
  CASE WHEN min(o_orderkey) % 2 = 0 THEN 'rozsudek' ELSE 'usnesení' END AS kind FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey""")
def query_bindings(t):
    celex = F.concat(F.lit("6"), F.expr("1990 + o_custkey div 10000"), F.lit("CJ"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"))
    kind = F.when(F.col("o_orderstatus") == "P", "REPORT").when(F.col("o_orderkey") % 2 == 0, "JUDG").otherwise("ORDER")
    raw = F.concat(F.lit('{"results":{"bindings":[{"celex":{"type":"x","value":"'), celex, F.lit('"},"typ":{"value":"http://t/'), kind, F.lit('"}}]}}'))
    rows = FE.bindings(t.heavy("orders").select("o_orderkey", raw.alias("raw")), ["o_orderkey"], "raw").withColumn("pos", F.col("o_orderkey"))
    return FE.decision_bindings(rows).select("celex", "mark", "kind")


@query("s7_notice_bindings", "S7 F13", sql="""
SELECT '6' || (1990 + o_orderkey // 10000) || 'CN' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS celex, 'Firma' || o_custkey AS parties, 'Soud ' || o_orderstatus AS referring_court, strftime(o_orderdate, '%Y-%m-%d') AS filed FROM orders
WHERE o_orderpriority <> '5-LOW'""")
def notice_bindings(t):
    celex = F.concat(F.lit("6"), F.expr("1990 + o_orderkey div 10000"), F.lit("CN"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    title = F.when(F.col("o_orderpriority") == "5-LOW", "Žaloba").otherwise(F.concat(
        F.lit("Věc C-1/26, Firma"), "o_custkey", F.lit(": Žádost o rozhodnutí o předběžné otázce, kterou podal Soud "), "o_orderstatus", F.lit(" dne 1. ledna")))
    raw = F.concat(F.lit('{"results":{"bindings":[{"celex":{"value":"'), celex, F.lit('"},"nazev_cs":{"value":"'), title, F.lit('"},"podano":{"value":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"}}]}}'))
    rows = FE.bindings(t.heavy("orders").select("o_orderkey", raw.alias("raw")), ["o_orderkey"], "raw").withColumn("pos", F.col("o_orderkey"))
    return FE.notice_bindings(rows).select("celex", "parties", "referring_court", "filed")


@query("s8_search_documents", "S8 J29", sql="""
SELECT 'C-' || doc_id || '/26' AS "case", CASE WHEN lang = 'de' THEN 'Name' ELSE 'Název' END AS name, lang AS kind, CASE WHEN lang = 'de' THEN 'lang text' WHEN lang = 'es' THEN 'en text' ELSE 'cs ' || source END AS text FROM documents""")
def search_documents(t):
    case = F.concat(F.lit("C-"), "doc_id", F.lit("/26"))
    texts = F.when(F.col("lang") == "de", '[{"pl":"lang"},{"de":"lang text"}]').when(F.col("lang") == "es", '[{"en":"en text"},{"es":"x"}]').otherwise(
        F.concat(F.lit('[{"en":"x"},{"cs":"null cs '), "source", F.lit('"}]')))
    raw = F.concat(F.lit('{"searchHits":[{"content":{"publishedId":"other"}},{"content":{"publishedId":"'), case, F.lit(' (PPU)","usualNameML":['), F.when(F.col("lang") == "de", '{"en":"Name"}').otherwise('{"cs":"Název"}'),
                   F.lit(']},"innerHits":{"document":{"searchHits":[{"content":{"docTypeCode":"'), "lang", F.lit('","celex":"1","contentML":'), texts, F.lit("}}]}}}]}"))
    return FE.search_documents(t.heavy("documents").select(case.alias("c"), raw.alias("raw")), "c", "raw").select("case", "name", "kind", "text")


def calendar_blocks(t: Tables):
    day = F.col("o_orderdate").cast("date")
    note = F.concat(F.lit("Řádek; první, č. "), "o_orderkey", F.lit("\nPoznámka "), F.repeat(F.lit("příliš žluťoučký kůň "), (F.col("o_custkey") % 4).cast("int")))
    starts = F.when(F.col("o_orderstatus") == "F", "").otherwise("9:30")
    last = F.when(F.col("o_custkey") % 3 == 0, F.date_add(day, (F.col("o_custkey") % 12).cast("int")))
    events = t.heavy("orders").select(
        "o_orderkey", day.alias("day"), last.alias("last_day"), starts.alias("starts"), F.when(F.col("o_orderstatus") == "P", "11:00").otherwise("").alias("ends"),
        F.concat(F.lit("Akce, "), "o_custkey").alias("title"), F.when(F.col("o_orderstatus") == "O", "online").otherwise("Praha").alias("place"), note.alias("note"))
    return IC.with_event_block(events, "block", F.concat(F.lit("e"), "o_orderkey"), "20240101T000000Z", *[F.col(c) for c in (
        "day", "last_day", "starts", "ends", "title", "place", "note")], F.lit("https://x.example/1")).select("o_orderkey", "block")


@query("s14_calendar_blocks", "S14", sql="""
SELECT o_orderkey, CAST(regexp_extract(x, 'z', 0) = '' AS BOOLEAN) AS folded, day, span_end FROM (SELECT o_orderkey, '' AS x,
  CASE WHEN o_orderstatus <> 'F' AND (o_custkey % 3 <> 0 OR o_custkey % 12 > 7) THEN 'DTSTART;TZID=Europe/Prague:' || strftime(o_orderdate, '%Y%m%d') || 'T093000' ELSE 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d') END AS day,
  CASE WHEN o_orderstatus <> 'F' AND (o_custkey % 3 <> 0 OR o_custkey % 12 > 7) THEN 'DTEND;TZID=Europe/Prague:' || strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderstatus = 'P' THEN 'T110000' ELSE 'T103000' END
    ELSE 'DTEND;VALUE=DATE:' || strftime(o_orderdate + to_days(CAST(1 + CASE WHEN o_custkey % 3 = 0 AND o_custkey % 12 <= 7 THEN o_custkey % 12 ELSE 0 END AS INTEGER)), '%Y%m%d') END AS span_end FROM orders)""")
def calendar_block_rows(t):
    lines = F.split("block", "\r\n")
    return calendar_blocks(t).select(
        "o_orderkey", F.forall(lines, lambda x: F.octet_length(x) <= 75).alias("folded"),
        F.filter(lines, lambda x: x.startswith("DTSTART"))[0].alias("day"), F.filter(lines, lambda x: x.startswith("DTEND"))[0].alias("span_end"))


@query("s13_calendar_events", "S13 S14 X7", sql="""
SELECT o_orderkey, 'Akce, ' || o_custkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN o_custkey % 3 = 0 AND o_custkey % 12 BETWEEN 1 AND 7 THEN strftime(o_orderdate + to_days(CAST(o_custkey % 12 AS INTEGER)), '%Y-%m-%d') ELSE '' END AS last_day,
  CASE WHEN o_orderstatus <> 'F' AND (o_custkey % 3 <> 0 OR o_custkey % 12 > 7) THEN '09:30' ELSE '' END AS starts,
  CASE WHEN o_orderstatus = 'O' THEN 'online' ELSE 'prezencne' END AS form, 'Řádek; první, č. ' || o_orderkey || chr(10) || 'Poznámka ' || repeat('příliš žluťoučký kůň ', CAST(o_custkey % 4 AS INTEGER)) AS note FROM orders""")
def calendar_events(t):
    files = calendar_blocks(t).select("o_orderkey", F.concat(F.lit("BEGIN:VCALENDAR\r\n"), "block", F.lit("\r\nEND:VCALENDAR\r\n")).alias("text"))
    return IC.calendar_events(files, ["o_orderkey"], "text").select(
        "o_orderkey", "title", day_text("day").alias("day"), day_text("last_day").alias("last_day"), "starts", "form", "note")


def roster_lines(t: Tables):
    """Roster of each customer as numbered text lines: a header, then hearings of two or three lines."""
    first = F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" 101 JUDr. Eva Nová "), F.col("o_custkey") % 20 + 1, F.lit(" Cmo "), "o_orderkey", F.lit("/"), F.year("o_orderdate"), F.lit(" 9:30 Firma"), "o_custkey")
    lines = F.array(F.lit("Datum síň"), first, F.lit("s.r.o."), F.concat(F.lit("Strana"), "o_orderkey", F.lit(" a.s.")), F.lit("12"))
    return t.heavy("orders").select("o_custkey", "o_orderkey", F.posexplode(lines).alias("i", "line")).select(
        "o_custkey", (F.col("o_orderkey") * 10 + F.col("i")).alias("pos"), "line")


@query("s15_roster_hearings", "S15 W8 P6 X17 X18", sql="""
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, (o_custkey % 20 + 1) || ' Cmo ' || o_orderkey || '/' || year(o_orderdate) AS mark, '9:30' AS clock, 'JUDr. Eva Nová' AS chair,
  'Firma' || o_custkey || ' v. Strana' || o_orderkey AS title, 'Firma' || o_custkey || ' s.r.o.;Strana' || o_orderkey || ' a.s.' AS parties FROM orders""")
def roster_hearings(t):
    out = RO.roster_hearings(roster_lines(t), "o_custkey", "pos", "line")
    return out.select("o_custkey", day_text("day").alias("day"), "mark", "clock", "chair", "title", F.array_join("parties", ";").alias("parties"))


@query("s15_expected_rows", "S15 F25", sql="SELECT o_custkey, count(*) AS expected FROM orders GROUP BY 1")
def expected_rows(t):
    lines = roster_lines(t)
    return RO.expected_rows(lines, "o_custkey", "line", D.header_period(F.col("line")))


def order_files(t: Tables):
    """A word-processor file per order, packed in the tasks that read the orders."""
    def word_file(rows: list[list[str]]) -> bytes:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        cells = "".join("<w:tr>" + "".join(
            "<w:tc>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in c.split("\n")) + "</w:tc>" for c in r) + "</w:tr>" for r in rows)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:tbl>{cells}</w:tbl></w:body></w:document>')
        return out.getvalue()

    def pack(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["o_orderkey"].astype(str), "content": [
                word_file([["Datum", "Síň", "Předseda", "Značka", "Hodina", "Účastníci"],
                       [d, "5", "Jan  Soudce", m, "9:00 hod", f"Firma{c}\ns.r.o.\nBeta a.s."]]) for d, m, c in zip(b["d"], b["m"], b["o_custkey"])]})
    src = t.heavy("orders").select("o_orderkey", F.date_format("o_orderdate", "d. M. yyyy").alias("d"),
                          F.concat(F.col("o_custkey") % 20 + 1, F.lit(" C "), "o_orderkey", F.lit("/"), F.year("o_orderdate")).alias("m"), "o_custkey")
    return src.mapInPandas(pack, "path string, content binary")


@query("s16_document_hearings", "S16 P6", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS document, strftime(o_orderdate, '%Y-%m-%d') AS day, (o_custkey % 20 + 1) || ' C ' || o_orderkey || '/' || year(o_orderdate) AS mark, '9:00' AS clock, 'Jan Soudce' AS chair,
  'Firma' || o_custkey || ' v. Beta' AS title FROM orders""")
def document_hearings(t):
    return RO.table_hearings(RO.document_cells(order_files(t))).select("document", day_text("day").alias("day"), "mark", "clock", "chair", "title")


@query("s16_cell_text", "S16", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS document, 'Datum | Síň | Předseda | Značka | Hodina | Účastníci' AS line FROM orders UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), day(o_orderdate) || '. ' || month(o_orderdate) || '. ' || year(o_orderdate) || ' | 5 | Jan  Soudce | ' || (o_custkey % 20 + 1) || ' C ' || o_orderkey || '/' || year(o_orderdate) || ' | 9:00 hod | Firma' || o_custkey || '; s.r.o.; Beta a.s.' FROM orders""")
def cell_text(t):
    return RO.cells_as_text(RO.document_cells(order_files(t))).select("document", "line")


# --- scalar functions over whole tables ----------------------------------------------------

@query("x1_folded_text", "X1", sql="SELECT doc_id, md5(replace(lower(strip_accents(text)), 'ß', 'ss')) AS digest FROM documents")
def folded_text(t):
    return t.heavy("documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("digest"))


@query("x2_squeezed_text", "X2 X22", sql=r"""
SELECT doc_id, CASE WHEN length(s) <= 300 THEN s ELSE substr(s, 1, 297) || '...' END AS note, md5(s) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}\v]+', ' ', 'g')) AS s FROM documents)""")
def squeezed_text(t):
    s = T.squeeze(F.col("text"))
    return t.heavy("documents").select("doc_id", T.shorten(s).alias("note"), F.md5(s).alias("digest"))


@query("x3_case_marks", "X3 X26 O5", sql="""
SELECT o_orderkey, (o_custkey % 50 + 1) || 'nscr' || o_orderkey || '/' || year(o_orderdate) AS key, CASE WHEN o_orderstatus = 'P' THEN 'IV' ELSE '' END AS part,
  (o_custkey % 50 + 1) || ' NSČR ' || o_orderkey || '/' || year(o_orderdate) || CASE WHEN o_orderstatus = 'P' THEN ' - IV.' ELSE '' END AS shown, CAST(o_custkey % 50 + 1 AS INTEGER) AS senate, 'NSČR' AS register,
  (o_custkey % 50 + 1) || ' ECm' AS senate_key FROM orders""")
def case_marks(t):
    raw = F.concat(F.lit(" "), F.col("o_custkey") % 50 + 1, F.lit("  NSČR "), "o_orderkey", F.lit(" / "), F.year("o_orderdate"), F.when(F.col("o_orderstatus") == "P", "-  IV.").otherwise("/ "))
    k, p = M.mark_key(raw), M.mark_parts(raw)
    return t.heavy("orders").select("o_orderkey", k["key"].alias("key"), k["part"].alias("part"), M.display_mark(raw).alias("shown"), p["senate"].alias("senate"), p["register"].alias("register"),
                           M.senate_key(F.col("o_custkey") % 50 + 1, F.lit("eCm")).alias("senate_key"))


@query("x4_eu_cases", "X4", sql="""
SELECT o_orderkey, 'C-' || o_orderkey || '/' || substr(CAST(year(o_orderdate) AS VARCHAR), 3, 2) AS mark, '620' || substr(CAST(year(o_orderdate) AS VARCHAR), 3, 2) || 'CN' || CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS notice FROM orders""")
def eu_cases(t):
    short = F.substring(F.year("o_orderdate").cast("string"), 3, 2)
    mark = F.concat(F.lit("C-"), "o_orderkey", F.lit("/"), short)
    return t.heavy("orders").select("o_orderkey", mark.alias("mark"), M.eu_notice(mark).alias("notice"))


@query("x5_parsed_dates", "X5 X6 X7 X10", sql="""
SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS day, strftime(l_shipdate, '%Y-%m-%d') AS raw_day, strftime(l_shipdate + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS mailed,
  strftime(timezone('Europe/Prague', (l_shipdate + INTERVAL 22 HOUR) AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M') AS local_time, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ':05' AS clock FROM lineitem""")
def parsed_dates(t):
    d = F.col("l_shipdate")
    cz = F.concat(F.lit("dne "), F.date_format(d, "d. M. yyyy"), F.lit(" v 9:00"))
    local = D.to_business_clock(F.date_format(d, "yyyy-MM-dd'T'22:00:00'Z'"))
    return t.heavy("lineitem").select(
        "l_orderkey", "l_linenumber", day_text(D.any_date(cz)).alias("day"), D.czech_date_text(cz).alias("raw_day"),
        F.date_format(D.feed_time(F.concat(F.lit("Út, "), F.date_format(d, "d MMM yyyy"), F.lit(" 10:00:00 +0200"))), "yyyy-MM-dd HH:mm").alias("mailed"),
        F.concat_ws(" ", day_text(local["day"]), local["clock"]).alias("local_time"), D.clock(F.concat(F.lit("od "), "l_linenumber", F.lit(".05 hod"))).alias("clock"))


@query("x8_periods", "X8 X9", sql="""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS start, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d') END AS stop,
  'úplné znění od ' || day(o_orderdate) || '. ' || month(o_orderdate) || '. ' || year(o_orderdate) AS validity FROM orders""")
def periods(t):
    d = F.col("o_orderdate").cast("date")
    end = F.date_add(d, F.when(F.col("o_custkey") % 5 == 0, -3).otherwise(14))
    p = D.header_period(F.concat(F.lit("Přehled v období od "), F.date_format(d, "dd.MM.yyyy"), F.lit(" do "), F.date_format(end, "d. M. yyyy")))
    word = F.element_at(F.array(*[F.lit(m) for m in ("ledna", "února", "března", "dubna", "května", "června", "července", "srpna", "září", "října", "listopadu", "prosince")]), F.month(d))
    v = D.validity(F.concat(F.lit("Rozvrh práce, ÚPLNÉ ZNĚNÍ s účinností od "), F.dayofmonth(d), F.lit(". "), word, F.lit(" "), F.year(d)))
    return t.heavy("orders").select("o_orderkey", day_text(F.coalesce(p["start"], F.when(F.col("o_custkey") % 5 == 0, d))).alias("start"), day_text(p["end"]).alias("stop"), v["label"].alias("validity"))


@query("x11_event_attributes", "X11 X20 X21 F21 P5", sql="""
SELECT p_partkey, 'konference ' || p_name AS title_key, p_name AS event_key, CASE WHEN p_size % 3 = 0 THEN 'hybridne' WHEN p_size % 3 = 1 THEN 'online' ELSE 'prezencne' END AS form,
  p_size % 7 = 0 AS cancelled, substr(sha1(p_brand || '|2024-01-01|konference ' || p_name), 1, 20) AS id FROM part""")
def event_attributes(t):
    title = F.concat(F.lit("Konference: "), F.initcap("p_name"), F.lit("!"))
    form = F.when(F.col("p_size") % 3 == 0, "Webinář i prezenčně").when(F.col("p_size") % 3 == 1, "ZOOM").otherwise("sál")
    return t.part.select(
        "p_partkey", E.title_key(title).alias("title_key"), E.event_key(title).alias("event_key"), E.attendance_form(form).alias("form"),
        E.is_cancelled(F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("POZOR: seminář "), "p_name", F.lit(" se nebude konat"))).otherwise("Zrušení společnosti")).alias("cancelled"),
        E.event_id(F.col("p_brand"), F.lit("2024-01-01"), title).alias("id"))


@query("x12_sentence_case", "X12", sql="""
SELECT p_partkey, 'The ' || upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || ' of EU Law: A Study' AS title FROM part""")
def sentence_case(t):
    return t.part.select("p_partkey", TI.clean_title(F.concat(F.lit("<b>THE</b> "), F.upper("p_name"), F.lit(" OF EU LAW: A STUDY"))).alias("title"))


@query("x14_legal_forms", "X14 X15 X16 F19", sql="""
SELECT c_custkey, 'Spor ' || c_mktsegment || ' Alfa a Beta o záruky' AS summary, 'Předkupní právo ' || c_nationkey AS heading, c_acctbal < 0 AS generic FROM customer""")
def legal_forms(t):
    s = F.concat(F.lit("Spor "), "c_mktsegment", F.lit(" Alfa, a. s., a Beta GmbH o záruki"))
    h = F.concat(F.lit("Předkupní právo "), "c_nationkey", F.lit(" – dovolání odmítnuto."))
    generic = L.generic_heading(F.when(F.col("c_acctbal") < 0, "Přípustnost dovolání").otherwise(h))
    return t.customer.select("c_custkey", L.fix_ki_ending(L.without_legal_forms(s)).alias("summary"), L.strip_outcome(h).alias("heading"), generic.alias("generic"))


@query("f20_scripts", "F20", sql=r"""
SELECT doc_id, regexp_matches(regexp_replace(text, '[a-zA-ZáčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ]', '', 'g'), '\p{L}') AS foreign_letters, regexp_matches(text, '[\p{Latin}][\p{L}\p{N}_]*[\p{Greek}\p{Cyrillic}]|[\p{Greek}\p{Cyrillic}][\p{L}\p{N}_]*\p{Latin}') AS mixed FROM documents""")
def scripts(t):
    return t.heavy("documents").select("doc_id", T.foreign_letters(F.col("text")).alias("foreign_letters"), T.mixed_script(F.col("text")).alias("mixed"))


@query("x17_party_labels", "X17 X18", sql="""
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'Jan Novák' || c_nationkey || ' v. ÚPV' ELSE 'Bayer v. ' || c_mktsegment || ' a další' END AS label, 'J. N.' AS initials, 'petr dubovák' || c_nationkey AS judge, 'Adam Vymyšlený' AS judge_name FROM customer""")
def party_labels(t):
    person = F.concat(F.lit("Ing. Jan Novák"), "c_nationkey")
    parties = F.when(F.col("c_nationkey") % 2 == 0, F.array(person, F.lit("Úřad průmyslového vlastnictví ČR"))).otherwise(
        F.array(F.lit("Bayer AG"), F.lit("Bayer IP GmbH"), F.concat("c_mktsegment", F.lit(" a.s.")), F.lit("Další")))
    return t.customer.select("c_custkey", N.party_label(parties).alias("label"), N.initials(F.concat(person, F.lit(" Ph.D. MBA"))).alias("initials"),
                             N.judge_key(F.concat(F.lit("JUDr. Mgr. Petr Dubovák"), "c_nationkey", F.lit(", Ph.D."))).alias("judge"), N.given_name_first(F.lit("VYMYŠLENÝ Adam")).alias("judge_name"))


@query("x19_article_keys", "X19", sql="""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '10.1093/jip/' || page_id ELSE '' END AS doi, CASE WHEN page_id % 2 = 0 THEN '10.1093/jip/' || page_id ELSE regexp_replace(url, '[?#].*$', '') END AS article FROM pages""")
def article_keys(t):
    doi = LK.doi_of(blank(), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://doi.org/10.1093/JIP/"), "page_id", F.lit("."))).otherwise(F.col("url")))
    return t.heavy("pages").select("page_id", doi.alias("doi"), LK.article_key(doi, LK.without_query(F.col("url"))).alias("article"))


@query("x24_loose_json", "X24 X25", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type || ' ' || json_extract_string(props, '$.k') AS joined, event_type IN ('click', 'view') AS yes FROM events""")
def loose_json(t):
    v = F.try_parse_json(F.concat(F.lit('{"p":'), "props", F.lit(',"l":["'), "event_type", F.lit('", '), F.get_json_object("props", "$.k"), F.lit(', null]}')))
    answer = F.when(F.col("event_type").isin("click", "view"), "Ano, jistě").otherwise("ne")
    return t.events.select("event_id", LO.as_text(F.try_variant_get(v, "$.p.k", "variant")).alias("k"), LO.as_text(F.try_variant_get(v, "$.l", "variant")).alias("joined"), LO.yes_no(answer).alias("yes"))


@query("x26_case_links", "X26 X21", sql="""
SELECT o_orderkey, 'https://infosoud.gov.cz/InfoSoud/detail-rizeni?typOrganizace=VSECHNY_KRAJE&druhOrganizace=MSPHAAB&cisloSenatu=' || (o_custkey % 30) || '&druhVeci=cm&bcVec=' || o_orderkey || '&rocnik=' || year(o_orderdate) AS url,
  sha1('MS|' || o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|9:00') AS uid FROM orders""")
def case_links(t):
    return t.heavy("orders").select("o_orderkey", M.case_link(F.lit("MSPHAAB"), F.col("o_custkey") % 30, F.lit("Cm"), F.col("o_orderkey"), F.year("o_orderdate")).alias("url"),
                           E.hearing_uid(F.lit("MS"), F.col("o_custkey").cast("string"), F.col("o_orderdate").cast("date"), F.lit("9:00")).alias("uid"))


@query("v2_parsed_sources", "V2 V1", sql="""
SELECT CASE o_orderkey % 5 WHEN 0 THEN 'feed' WHEN 1 THEN 'works' WHEN 2 THEN 'page' WHEN 3 THEN 'other' END AS source,
  CASE o_orderkey % 5 WHEN 0 THEN 'https://j.example/a/' || o_orderkey WHEN 1 THEN '10.1/' || o_orderkey WHEN 2 THEN '/p/' || o_orderkey END AS guid,
  CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'Title ' || o_custkey END AS title, CASE o_orderkey % 5 WHEN 0 THEN '2001-07-01' WHEN 1 THEN strftime(o_orderdate, '%Y') || '-01-01' END AS seen,
  o_orderkey % 5 < 3 AS parsed FROM orders""")
def parsed_sources(t):
    k = F.col("o_orderkey")
    feed = F.concat(F.lit("<rss><channel><item><title>Title "), "o_custkey", F.lit("</title><link>https://j.example/a/"), k,
                    F.lit("?rss=1</link><pubDate>Sun, 01 Jul 2001 02:00:00 +0200</pubDate></item></channel></rss>"))
    works = F.concat(F.lit('{"message":{"items":[{"DOI":"10.1/'), k, F.lit('","title":["Title '), "o_custkey", F.lit('"],"issued":{"date-parts":[['),
                     F.year("o_orderdate"), F.lit("]]}}]}}"))
    page = F.concat(F.lit("<p><a href='/p/"), k, F.lit("'>x</a></p>"))
    which = k % 5
    source = F.when(which == 0, "feed").when(which == 1, "works").when(which == 2, "page").when(which == 3, "other")
    raw = t.heavy("orders").select(k, source.alias("source"), F.when(which == 0, feed).when(which == 1, works).otherwise(page).alias("raw"))
    parsers = ParserRegistry()
    parsers.register("feed", F.col("link"), F.col("published").cast("date"))(
        lambda rows: FE.feed_items(rows, ["o_orderkey"], "raw", F.lit("2001-08-01").cast("timestamp")))
    parsers.register("works", F.col("doi"), F.col("published").cast("date"))(lambda rows: FE.works(rows, "raw", "o_orderkey"))
    parsers.register("page", F.col("href"), F.lit(None).cast("date"))(lambda rows: PG.extract_links(rows, ["o_orderkey"], "raw"))
    found = parsers.parse(raw, "source").select("source", "guid", "title", F.date_format("first_seen", "yyyy-MM-dd").alias("seen"), F.lit(True).alias("parsed"))
    nothing = F.lit(None).cast("string")
    left = parsers.rejected(raw, "source").select("source", nothing.alias("guid"), nothing.alias("title"), nothing.alias("seen"), F.lit(False).alias("parsed"))
    return found.unionByName(left)
