"""Feeds and API payloads: RSS, RDF and Atom items, works, query bindings, search hits."""

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.dates import feed_time
from listwatch.functions.links import article_key, doi_of, without_query
from listwatch.functions.names import clean_authors
from listwatch.functions.text import first_text, squeeze, strip_space, unescape
from listwatch.functions.titles import clean_title
from listwatch.operators.classify import QUESTION_TITLE, work_kind
from listwatch.functions.marks import eu_case
from listwatch.operators.scan import first_per_key
from listwatch.operators.staging import where_computed

MAX_AGE_DAYS = 365
# Note in front of titles published early, ISSN footer of abstracts.
EARLY = r"(?i)\s*\[pre-?publication\]"
ISSN_FOOTER = r"\s*Volume\s+\d+\s+(?:Online\s+)?ISSN\s+[\dXx-]+\s*$"
DECISION_SUBTITLE = r"(?i)^\s*(decision|judgment|judgement|order|opinion|ruling)\b|case no\."


def _elements(xml: Column, name: str) -> Column:
    """Contents of all elements with the local name, whatever their prefix."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:[\w.-]+:)?{name}\b[^>]*(?<!/)>(.*?)</(?:[\w.-]+:)?{name}\s*>"), F.lit(1))


def _text(content: Column) -> Column:
    literal = F.regexp_replace(content, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return strip_space(F.when(content.contains("<![CDATA["), literal).otherwise(unescape(content)))


def plain_abstract(html: Column) -> Column:
    s = squeeze(unescape(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")))
    return F.regexp_replace(s, r"(?i)^\s*Abstract\s*", "")


def _address(xml: Column) -> Column:
    """Address of the first Atom link to the page itself, else of the first link; blank without one."""
    links = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:[\w.-]+:)?link\b([^>]*\bhref=[^>]*)>"), F.lit(1))
    page = F.filter(links, lambda a: ~a.rlike(r"\brel\s*=") | a.rlike(r"\brel\s*=\s*[\"']alternate[\"']"))
    chosen = F.coalesce(F.get(page, F.lit(0)), F.get(links, F.lit(0)), F.lit(""))
    return F.regexp_extract(chosen, r"\bhref=[\"']([^\"']*)[\"']", 1)


def feed_items(feeds: DataFrame, key: list[str], xml: str, now: Column) -> DataFrame:
    """Articles of RSS 2.0, RSS 1.0 and Atom feeds.

    An item dated with the build time of its feed counts as undated; undated items stay (with
    ``estimated``), dated ones older than a year are dropped.
    """
    x = F.col(xml)
    head = F.regexp_extract(x, r"(?s)<channel\b[^>]*>(.*?)<(?:[\w.-]+:)?(?:item|entry)\b", 1)
    rows = feeds.select(*key, F.regexp_extract(x, r"(?s)<lastBuildDate>(.*?)</lastBuildDate>", 1).alias("_b"), head.alias("_head"),
                        F.concat(_with_tag(x, "item"), _with_tag(x, "entry")).alias("_items"))
    rows = rows.select(*key, feed_time(F.col("_b")).alias("_built"), first_text(_first(F.col("_head"), "pubDate"), _first(F.col("_head"), "date")).alias("_c"),
                       F.posexplode("_items").alias("pos", "_item"))
    item = F.col("_item")
    names = ("title", "link", "doi", "identifier", "guid", "pubDate", "date", "published", "updated", "description", "summary", "content")
    raw = rows.select(
        *key, "pos", "_built", "_c", *[_first(item, n).alias(f"_{n}") for n in names],
        _address(item).alias("_href"),
        _elements(item, "creator").alias("_creators"), _elements(item, "name").alias("_names"))
    # One column per step: each field is cut out, decoded and read once.
    plain = raw.select(*key, "pos", "_built", "_href", feed_time(F.col("_c")).alias("_channel"), *[_text(F.col(f"_{n}")).alias(f"_{n}") for n in names],
                       F.array_join(F.transform(F.when(F.size("_creators") > 0, F.col("_creators")).otherwise(F.col("_names")), _text), ", ").alias("_people"))
    read = plain.select(
        *key, "pos", "_built", "_channel", F.regexp_replace("_title", EARLY, "").alias("_title"), first_text(F.col("_link"), F.col("_href")).alias("_link"),
        "_doi", "_identifier", "_guid", clean_authors(F.col("_people")).alias("authors"),
        *[feed_time(F.col(f"_{n}")).alias(f"_{n}") for n in ("pubDate", "date", "published", "updated")],
        first_text(F.col("_description"), F.col("_summary"), F.col("_content")).alias("_abstract"))
    named = read.select(
        *key, "pos", "_built", "_channel", "_link", "authors", clean_title(F.col("_title")).alias("title"),
        doi_of(F.col("_doi"), F.col("_identifier"), F.col("_guid"), F.col("_link")).alias("doi"),
        squeeze(F.regexp_replace(plain_abstract(F.col("_abstract")), ISSN_FOOTER, "")).alias("abstract"),
        F.coalesce("_pubDate", "_date", "_published", "_updated").alias("_dated"))
    address = F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), "doi")).otherwise(
        F.replace(without_query(F.col("_link")), F.lit(" "), F.lit("%20")))
    same = F.col("_dated").eqNullSafe(F.col("_built")) | F.col("_dated").eqNullSafe(F.col("_channel"))
    out = named.withColumn("link", address).select(
        *key, "pos", "title", "doi", "link", "authors", "abstract", article_key(F.col("doi"), F.col("link")).alias("article"),
        F.when(~same, F.col("_dated")).alias("published"))
    old = F.col("published") < now - F.expr(f"INTERVAL {MAX_AGE_DAYS} DAYS")
    fresh = where_computed(out, (F.col("title") != "") & (F.col("link") != "") & ~F.coalesce(old, F.lit(False)))
    return fresh.withColumn("estimated", F.col("published").isNull())


def _first(xml: Column, name: str) -> Column:
    """Content of the first element with the local name; blank when there is none."""
    return F.regexp_extract(xml, rf"(?s)<(?:[\w.-]+:)?{name}\b[^>]*(?<!/)>(.*?)</(?:[\w.-]+:)?{name}\s*>", 1)


def _with_tag(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)(<(?:[\w.-]+:)?{name}[\s>].*?</(?:[\w.-]+:)?{name}\s*>)"), F.lit(1))


_DATE = "struct<`date-parts`:array<array<int>>>"
WORKS_SCHEMA = ("message struct<items:array<struct<DOI:string,title:array<string>,subtitle:array<string>,abstract:string,"
                "author:array<struct<given:string,family:string>>,"
                f"`published-online`:{_DATE},published:{_DATE},issued:{_DATE},created:{_DATE}>>>")


def _parts_date(*fields: Column) -> Column:
    """First readable date of date-parts fields; missing month and day count as one."""
    days = []
    for f in fields:
        p = F.get(f["date-parts"], F.lit(0))
        y, m, d = (F.get(p, F.lit(i)) for i in range(3))
        days.append(F.when(y.isNotNull(), F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(F.coalesce(m, F.lit(1)).cast("string"), 2, "0"),
                                              F.lpad(F.coalesce(d, F.lit(1)).cast("string"), 2, "0")), "yyyy-MM-dd")))
    return F.coalesce(*days)


def works(payloads: DataFrame, raw: str, order: str) -> DataFrame:
    """Works of one or more query answers, one row per DOI, the earlier query winning."""
    w = payloads.select(order, F.from_json(raw, WORKS_SCHEMA)["message"]["items"].alias("i")).select(
        order, F.posexplode("i").alias("pos", "w"))
    doi = F.lower(F.trim(F.coalesce("w.DOI", F.lit(""))))
    w = w.select(order, "pos", doi.alias("doi"), "w").where(F.col("doi") != "")
    title, sub = (clean_title(F.get(F.col(f"w.{n}"), F.lit(0))) for n in ("title", "subtitle"))
    people = F.array_join(F.transform("w.author", lambda a: F.concat_ws(" ", a["given"], a["family"])), "; ")
    rows = first_per_key(w, ["doi"], [F.col(order), F.col("pos")]).withColumn("_title", title).withColumn("_sub", sub)
    title, sub = F.col("_title"), F.col("_sub")
    return where_computed(rows, F.coalesce(title, F.lit("")) != "").select(
        "doi", F.when(sub != "", F.concat(title, F.lit(" – "), F.trim(F.substring_index(sub, ";", 1)))).otherwise(title).alias("title"),
        clean_authors(people).alias("authors"), plain_abstract(F.col("w.abstract")).alias("abstract"),
        (F.coalesce(sub, F.lit("")).rlike(DECISION_SUBTITLE)).alias("is_decision"),
        _parts_date(F.col("w.published-online"), F.col("w.published"), F.col("w.issued"), F.col("w.created")).alias("published"))


def bindings(payloads: DataFrame, key: list[str], raw: str) -> DataFrame:
    """(key, pos, row MAP): query results as variable -> value."""
    parsed = F.from_json(raw, "results struct<bindings:array<map<string,struct<value:string>>>>")
    rows = payloads.select(*key, F.posexplode(parsed["results"]["bindings"]).alias("pos", "b"))
    return rows.select(*key, "pos", F.transform_values("b", lambda k, v: F.coalesce(v["value"], F.lit(""))).alias("row"))


def _var(name: str) -> Column:
    return F.coalesce(F.try_element_at("row", F.lit(name)), F.lit(""))


def decision_bindings(rows: DataFrame) -> DataFrame:
    """Decisions: kinds that are kept, one row per work."""
    out = rows.select("pos", _var("celex").alias("celex"), eu_case(_var("celex")).alias("mark"), work_kind(_var("typ")).alias("kind"),
                      _var("ecli").alias("ecli"), F.substring(_var("datum"), 1, 10).alias("decided"))
    return first_per_key(out.where((F.col("mark") != "") & F.col("kind").isNotNull()), ["celex"], [F.col("pos")])


def notice_bindings(rows: DataFrame) -> DataFrame:
    """Notices of new questions, with the parties and the referring court read off the Czech title."""
    czech = squeeze(_var("nazev_cs"))
    out = rows.select(
        "pos", _var("celex").alias("celex"), eu_case(_var("celex")).alias("mark"), first_text(czech, squeeze(_var("nazev_en"))).alias("notice"),
        F.regexp_extract(czech, r"^Věc\s+[^,:]+,\s*(.+?):", 1).alias("parties"),
        F.regexp_extract(czech, r"(?:kterou|který)\s+podal[ao]?\s+(.+?)\s+dne\s+\d", 1).alias("referring_court"),
        F.substring(_var("podano"), 1, 10).alias("filed"), F.substring(_var("vlozeno"), 1, 10).alias("published"))
    return first_per_key(out.where((F.col("mark") != "") & F.col("notice").rlike(QUESTION_TITLE)), ["celex"], [F.col("pos")])


HITS_SCHEMA = ("searchHits array<struct<content:struct<publishedId:string,publishedAffId:string,usualNameML:array<map<string,string>>>,"
               "innerHits:struct<document:struct<searchHits:array<struct<content:struct<docTypeCode:string,celex:string,"
               "contentML:array<map<string,string>>>>>>>>>")


def preferred_language(texts: Column) -> Column:
    """Czech, English, French, else the longest text of an array of language maps."""
    merged = F.map_from_entries(F.array_distinct(F.flatten(F.transform(texts, lambda m: F.map_entries(m)))))
    longest = F.aggregate(F.map_values(merged), F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    picked = first_text(*[F.try_element_at(merged, F.lit(code)) for code in ("cs", "en", "fr")], longest)
    return strip_space(F.regexp_replace(picked, r"^\s*null\s+", ""))


def search_documents(payloads: DataFrame, case: str, raw: str) -> DataFrame:
    """(case, name, kind, celex, text) of the hit whose id is the case asked for."""
    hits = payloads.select(F.col(case).alias("case"), F.explode(F.from_json(raw, HITS_SCHEMA)["searchHits"]).alias("h"))
    c = F.col("h.content")
    same = F.lit(False)
    for name in ("publishedId", "publishedAffId"):
        same = same | F.coalesce(F.substring_index(c[name], " ", 1) == F.col("case"), F.lit(False))
    docs = hits.where(same).select("case", preferred_language(c["usualNameML"]).alias("name"),
                                   F.posexplode_outer(F.col("h.innerHits.document.searchHits")).alias("pos", "d"))
    return docs.select("case", "name", "pos", F.col("d.content.docTypeCode").alias("kind"), F.col("d.content.celex").alias("celex"),
                       preferred_language(F.col("d.content.contentML")).alias("text"))
