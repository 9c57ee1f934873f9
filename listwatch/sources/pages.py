"""Published HTML pages: visible text, links, tables, labelled pairs, embedded events."""

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.dates import CZECH_DATE, czech_date, czech_date_text, to_business_clock
from listwatch.functions.events import attendance_form
from listwatch.functions.links import absolute, allowed_link
from listwatch.functions.loose import as_names, as_text
from listwatch.functions.marks import display_mark, docket_number, mark_key, mark_parts
from listwatch.functions.text import first_text, fold, let, missing, squeeze, strip_space, unescape
from listwatch.operators.scan import first_per_key, top_per_group
from listwatch.operators.staging import where_computed
from listwatch.session import materialise

JUNK = ("script", "style", "nav", "header", "footer", "form")
HEAD_JUNK = ("head", "script", "style", "noscript")


def lines_of(html: Column) -> Column:
    """Text of an HTML fragment, block ends and line breaks as new lines, blank runs collapsed."""
    def without_tags(h: Column) -> Column:
        s = F.regexp_replace(h, r"(?i)<br\s*/?>|</p\s*>|</div\s*>|</tr\s*>|</h\d\s*>", "\n")
        return F.when(h.contains("<"), F.regexp_replace(s, r"<[^>]+>", "")).otherwise(h)

    def lines(s: Column) -> Column:
        return F.when(s.contains("\n"), F.regexp_replace(F.regexp_replace(s, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")).otherwise(s)

    s = unescape(let(F.coalesce(html, F.lit("")), without_tags))
    return strip_space(let(F.regexp_replace(s, r"(?U)[^\S\n]+", " "), lines))


def without_elements(html: Column, tags: tuple[str, ...] = JUNK) -> Column:
    """Page without comments and the listed elements."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    for tag in tags:
        s = F.regexp_replace(s, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return s


def page_text(html: Column, tags: tuple[str, ...] = JUNK) -> Column:
    return lines_of(without_elements(html, tags))


def page_text_with_links(html: Column, base: str, tags: tuple[str, ...] = JUNK) -> Column:
    """Visible text in which every link keeps its address: ``text <address>``."""
    s = F.regexp_replace(without_elements(html, tags), r"(?is)<a\b[^>]*?href\s*=\s*[\"']/([^\"']*)[\"'][^>]*>(.*?)</a>",
                         f"$2 &lt;{base}/$1&gt;")
    s = F.regexp_replace(s, r"(?is)<a\b[^>]*?href\s*=\s*[\"'](http[^\"']*)[\"'][^>]*>(.*?)</a>", "$2 &lt;$1&gt;")
    return F.regexp_replace(lines_of(s), r"\n{2,}", "\n")


LINK = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def extract_links(pages: DataFrame, key: list[str], html: str) -> DataFrame:
    """(key, pos, href, text) of every anchor."""
    h = F.col(html)
    found = F.arrays_zip(F.regexp_extract_all(h, F.lit(LINK), F.lit(1)).alias("href"),
                         F.regexp_extract_all(h, F.lit(LINK), F.lit(2)).alias("inner"))
    rows = pages.select(*key, F.posexplode(found).alias("pos", "a"))
    return rows.select(*key, "pos", unescape(F.col("a.href")).alias("href"), squeeze(lines_of(F.col("a.inner"))).alias("text"))


def article_links(links: DataFrame, source: list[str], pattern: str, guid: Column, cap: int) -> DataFrame:
    """Articles behind links of a given shape: per guid the longest text, at most ``cap`` per source."""
    hits = links.where(F.col("href").rlike(pattern) & (F.col("text") != "")).withColumn("guid", guid)
    best = first_per_key(hits.select(*source, "guid", "pos", "href", "text"), [*source, "guid"],
                         [-F.length("text"), F.col("pos")])
    first = hits.groupBy(*source, "guid").agg(F.min("pos").alias("first_pos"))
    return top_per_group(best.join(first, [*source, "guid"]), source, [F.col("first_pos"), F.col("guid")], cap, "rank")


def _is_document() -> Column:
    path = F.lower("href")
    return path.contains("/documents/") | path.rlike(r"\.(docx?|pdf)([?#]|$)")


def document_links(links: DataFrame) -> DataFrame:
    """Links to documents, with the folded text that keywords are matched against."""
    return links.where(_is_document()).withColumn("haystack", fold(F.concat_ws(" ", "href", "text")))


def pick_links(links: DataFrame, page: list[str], preferences: list[str], keywords: list[str], strict: bool = False) -> DataFrame:
    """One document link per page: the first preference that matches any link decides.

    Preferences are tried one by one in their order, then all keywords together (not when strict
    and there are preferences), then the first document on the page (not when strict).
    """
    passes = [[p] for p in preferences]
    if not strict or not passes:
        passes.append(list(keywords))
    rank = F.lit(None).cast("int")
    for i, words in reversed(list(enumerate(passes))):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.col("haystack").contains(w)
        rank = F.when(hit, i).otherwise(rank)
    if not strict:
        rank = F.coalesce(rank, F.lit(len(passes)))
    ranked = links.withColumn("pass", rank).where(F.col("pass").isNotNull())
    return first_per_key(ranked, page, [F.col("pass"), F.col("pos")])


CALENDAR_HREF = r"(?i)\.ics([?#]|$)|[?&](ical|ics)="


def _calendar_href() -> Column:
    return F.regexp_replace("href", "^webcal:", "https:")


def calendar_links(links: DataFrame) -> DataFrame:
    return links.withColumn("href", _calendar_href()).where(F.col("href").rlike(CALENDAR_HREF))


def _is_invitation(hosts: Column) -> Column:
    wanted = let(fold(F.col("text")), lambda t: t.contains("pozvank") | (t.contains("program") & t.contains(".pdf")))
    return wanted & allowed_link(F.col("href"), hosts)


def invitation_links(links: DataFrame, hosts: Column) -> DataFrame:
    return links.where(_is_invitation(hosts))


def link_kinds(links: DataFrame, key: list[str], hosts: Column) -> DataFrame:
    """(key, pos, kind, href): the calendar, document and invitation links in one pass over the pages."""
    calendar = _calendar_href()
    kinds = F.array(F.when(calendar.rlike(CALENDAR_HREF), F.struct(F.lit("calendar").alias("kind"), calendar.alias("href"))),
                    F.when(_is_document(), F.struct(F.lit("document").alias("kind"), "href")),
                    F.when(_is_invitation(hosts), F.struct(F.lit("invitation").alias("kind"), "href")))
    return links.select(*key, "pos", F.inline(F.array_compact(kinds)))


# --- tables --------------------------------------------------------------------------------

def table_rows(pages: DataFrame, key: list[str], html: str) -> DataFrame:
    """(key, row_no, row, next_row, cells): table rows as HTML with their cells."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    out = pages.select(*key, rows.alias("_rows")).select(*key, "_rows", F.posexplode("_rows").alias("row_no", "row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    return out.select(*key, "row_no", "row", F.coalesce(F.get("_rows", F.col("row_no") + 1), F.lit("")).alias("next_row"),
                      cells.alias("cells"))


def cell_text(i: int) -> Column:
    return squeeze(lines_of(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))))


def _href(html: Column) -> Column:
    return unescape(F.regexp_extract(html, r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"']", 1))


def board_decisions(rows: DataFrame, key: list[str], base: str) -> DataFrame:
    """Notice board: mark, announcement date and document of each row that has a decision mark."""
    cells = rows.where(F.size("cells") >= 2).select(
        *key, "row_no", cell_text(0).alias("_t"), cell_text(1).alias("_d"), _href(F.col("row")).alias("_href"))
    read = cells.select(*key, "row_no", display_mark(F.col("_t")).alias("mark"), czech_date_text(F.col("_d")).alias("decided"), "_href")
    mark = F.col("mark")
    read = read.select(*key, "row_no", "mark", mark_parts(mark).alias("_p"), mark_key(mark).alias("_k"), "_href", "decided")
    part = F.when(F.col("_k.part") != "", F.concat(F.lit("-"), "_k.part")).otherwise("")
    out = read.select(
        *key, "row_no", F.concat(F.lit("ns:deska:"), "_k.key", part).alias("id"), "mark", F.col("_p.senate").alias("senate"),
        F.col("_p.register").alias("register"), absolute(F.col("_href"), base).alias("document"), "decided",
        F.col("decided").alias("published"))
    return where_computed(out, F.col("senate").isNotNull())


def on_board(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Board rows with a document, announced inside the period or without a date."""
    day = F.col("published")
    return where_computed(rows, (F.col("document") != "") & ((day == "") | day.between(start, end)))


def search_decisions(rows: DataFrame, key: list[str], base: str, court: str) -> DataFrame:
    """Search results with a decision link; rows of other courts are left out."""
    row = F.col("row")
    cut = rows.select(
        *key, "row_no", F.regexp_extract(row, r"(?is)(<a\b[^>]*class=\"[^\"]*\bodk\b[^\"]*\"[^>]*>.*?</a>)", 1).alias("_link"),
        F.regexp_extract(row, r"(?is)<td\b[^>]*class=\"[^\"]*td-short-wrap[^\"]*\"[^>]*>(.*?)</td>", 1).alias("_owner"),
        F.regexp_extract(row, r"(?is)<input\b[^>]*name=[\"']ids[\"'][^>]*value=[\"']([^\"']*)[\"']", 1).alias("_ids"),
        F.regexp_extract(row, r"(?is)href=[\"']([^\"']*\.pdf(?:\?openelement[^\"']*)?)[\"']", 1).alias("_pdf"))
    cut = cut.where(F.col("_link") != "").select(
        *key, "row_no", lines_of(F.col("_link")).alias("_text"), lines_of(F.col("_owner")).alias("_owner"), _href(F.col("_link")).alias("_href"),
        first_text(F.col("_ids"), F.regexp_extract("_link", r"(?i)/WebSearch/([0-9A-F]{32})", 1)).alias("_id"), "_pdf")
    cut = where_computed(cut, ((F.col("_owner") == "") | F.col("_owner").contains(court)) & (F.col("_id") != ""))
    read = cut.withColumn("mark", display_mark(F.col("_text"))).withColumn("_p", mark_parts(F.col("mark")))
    register = first_text(F.col("_p.register"), F.regexp_extract("mark", r"^\s*([^\d\s/]+)\s+\d+\s*/", 1))
    return read.select(
        *key, "row_no", F.upper("_id").alias("unid"), "mark", F.col("_p.senate").alias("senate"), register.alias("register"),
        absolute(F.col("_href"), base).alias("url"), absolute(F.col("_pdf"), base).alias("pdf"))


def register_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """Register listing: the eight cells after the one that holds the record id."""
    ident = r"(?is)<input\b(?=[^>]*name=[\"'][^\"']*\.ID[\"'])[^>]*value=[\"']\s*(\d+)\s*[\"']"
    at = F.array_position(F.transform("cells", lambda c: c.rlike(ident)), True)
    offset = at.cast("int")
    texts = F.transform(F.slice("cells", offset + 1, F.lit(8)), lambda c: squeeze(lines_of(c)))
    return rows.where((at > 0) & (F.size("cells") >= at + 8)).select(
        *key, "row_no", F.regexp_extract(F.get("cells", offset - 1), ident, 1).alias("id"), texts.alias("t")).select(
        *key, "row_no", "id", czech_date_text(F.get("t", F.lit(0))).alias("decided"), docket_number(F.get("t", F.lit(1))).alias("mark"),
        F.get("t", F.lit(2)).alias("panel"), F.lower(F.get("t", F.lit(3))).alias("kind"), F.get("t", F.lit(4)).alias("outcome"),
        F.get("t", F.lit(7)).alias("parties"))


def break_parts(cell: Column) -> Column:
    """Cell content split at line breaks; empty parts stay, they separate sections."""
    return F.transform(F.split(cell, r"(?i)<br\s*/?>"), lambda c: squeeze(lines_of(c)))


def event_rows(rows: DataFrame, key: list[str], base: str) -> DataFrame:
    """Event table: title with link, date or range with clock times in brackets, place."""
    first = F.get("cells", F.lit(0))
    read = rows.where(F.size("cells") >= 3).select(
        *key, "row_no", _href(first).alias("_href"), squeeze(lines_of(first)).alias("title"), cell_text(1).alias("_when"), cell_text(2).alias("place"))
    when = F.col("_when")
    bracket = F.when(when.contains("("), F.regexp_replace(when, r"^[^(]*\(", "")).otherwise("")
    read = read.select(
        *key, "row_no", "_href", "title", "place", F.regexp_extract_all(when, F.lit("(" + CZECH_DATE + ")"), F.lit(1)).alias("_days"),
        F.regexp_extract_all(bracket, F.lit(r"(\d{1,2}[:.]\d{2})"), F.lit(1)).alias("_clocks"))

    def clock(i: int) -> Column:
        return F.translate(F.coalesce(F.get("_clocks", F.lit(i)), F.lit("")), ".", ":")

    out = read.select(
        *key, "row_no", "title", czech_date(F.get("_days", F.lit(0))).alias("day"), czech_date(F.get("_days", F.lit(1))).alias("last_day"),
        clock(0).alias("starts"), clock(1).alias("ends"), "_href", absolute(F.col("_href"), base).alias("url"), "place",
        attendance_form(F.col("title"), F.col("place")).alias("form"))
    return where_computed(out, F.col("day").isNotNull() & (F.col("_href") != "")).drop("_href")


def labelled_values(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, label, value): two-cell rows as metadata, repeated labels joined distinct in order.

    A page has as many pairs as its metadata table has rows.
    """
    label = F.regexp_replace(cell_text(0), r"\s*:\s*$", "")
    pairs = rows.where(F.size("cells") >= 2).select(*key, "row_no", label.alias("label"), cell_text(1).alias("v")).where(F.col("label") != "")
    return pairs.groupBy(*key, "label").agg(F.array_join(F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.struct("row_no", "v"))), lambda s: s["v"])), "; ").alias("value"))


def field_values(pages: DataFrame, key: list[str], html: str) -> DataFrame:
    """(key, field, value) from elements that name their field in ``data-field-id``; the first one counts."""
    shape = r"(?is)data-field-id=[\"']([^\"']+)[\"'][^>]*>(.*?)(?=<[^>]*data-field-id=|\z)"
    found = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(shape), F.lit(1)).alias("f"),
                         F.regexp_extract_all(F.col(html), F.lit(shape), F.lit(2)).alias("v"))
    rows = pages.select(*key, F.posexplode(found).alias("pos", "p")).select(
        *key, "pos", F.col("p.f").alias("field"), squeeze(lines_of(F.col("p.v"))).alias("value"))
    return rows.groupBy(*key, "field").agg(F.min_by("value", "pos").alias("value"))


def statute_citation(article: Column, section: Column, paragraph: Column, letter: Column, name: Column, number: Column,
                     year: Column) -> Column:
    """``§ 36 odst. 3 zákona č. 500/2004 Sb.``; blank without a number and a year."""
    parts = [F.when(~missing(v), F.concat(F.lit(label + " "), v)) for label, v in
             (("čl.", article), ("§", section), ("odst.", paragraph), ("písm.", letter))]
    law = F.when(missing(name), F.lit("předpisu")).otherwise(name)
    return F.when(missing(number) | missing(year), F.lit("")).otherwise(
        F.concat_ws(" ", *parts, F.concat(law, F.lit(" č. "), number, F.lit("/"), year, F.lit(" Sb."))))


# --- embedded schema.org events ------------------------------------------------------------

#: Levels of nesting that are walked before a checkpoint.
LEVELS = 4
CONTAINERS = ("@graph", "itemListElement", "item", "event", "events", "subEvent")


def _listed(v: Column) -> Column:
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    return F.when(is_list, F.try_variant_get(v, "$", "array<variant>")).when(v.isNotNull(), F.array(v)).otherwise(
        F.array().cast("array<variant>"))


def _is_event(v: Column) -> Column:
    types = _listed(F.try_variant_get(v, "$['@type']", "variant"))
    return F.coalesce(F.exists(types, lambda t: F.coalesce(F.try_variant_get(t, "$", "string").endswith("Event"), F.lit(False))), F.lit(False))


def embedded_events(pages: DataFrame, key: list[str], html: str) -> DataFrame:
    """schema.org events of the pages' JSON-LD, found through lists, graphs and item lists at any depth.

    ``LEVELS`` levels are walked in one pass and cut with a reliable checkpoint, so a page is parsed once; what is
    still open after them goes on with further ones until nothing is left.
    """
    script = r"(?is)<script\b[^>]*type\s*=\s*[\"'][^\"']*ld\+json[^\"']*[\"'][^>]*>(.*?)</script>"
    blocks = pages.select(*key, F.explode(F.regexp_extract_all(F.col(html), F.lit(script), F.lit(1))).alias("json"))

    def inside(rows: DataFrame) -> DataFrame:
        for _ in range(LEVELS):
            v = F.col("v")
            held = F.flatten(F.array(*[_listed(F.try_variant_get(v, f"$['{c}']", "variant")) for c in CONTAINERS]))
            children = F.when(F.schema_of_variant(v).startswith("ARRAY"), _listed(v)).otherwise(held)
            # An event stays a row of its own, anything else gives way to what it holds.
            rows = rows.select(*key, "is_event", F.explode(F.when(F.col("is_event"), F.array(v)).otherwise(children)).alias("v")).select(
                *key, "v", F.when(F.col("is_event"), True).otherwise(_is_event(F.col("v"))).alias("is_event"))
        return materialise(rows)

    first = blocks.select(*key, F.explode(_listed(F.try_parse_json("json"))).alias("v"))
    level = inside(first.withColumn("is_event", _is_event(F.col("v"))))
    found = level.where("is_event")
    while not (left := level.where("not is_event")).isEmpty():
        level = inside(left)
        found = found.unionByName(level.where("is_event"))
    return found.select(*key, *_event_fields(F.col("v")))


def _event_fields(v: Column) -> list[Column]:
    def get(path, of=v):
        return F.try_variant_get(of, path, "variant")

    def text(path, of=v):
        return F.coalesce(F.try_variant_get(of, path, "string"), F.lit(""))

    start, end = to_business_clock(text("$.startDate")), to_business_clock(text("$.endDate"))
    places = _listed(get("$.location"))
    virtual = F.exists(places, lambda p: text("$['@type']", p).contains("Virtual"))

    def address(p):
        plain = F.when(~F.schema_of_variant(get("$.address", p)).startswith("OBJECT"), text("$.address", p))
        street, town = (F.nullif(squeeze(text(f"$.address.{f}", p)), F.lit("")) for f in ("streetAddress", "addressLocality"))
        return F.coalesce(plain, F.concat_ws(", ", street, town))

    def place(p):
        named = F.concat_ws(", ", F.nullif(squeeze(text("$.name", p)), F.lit("")), F.nullif(squeeze(address(p)), F.lit("")))
        return F.when(F.schema_of_variant(p).startswith("OBJECT"), named).otherwise(squeeze(as_text(p)))

    physical = F.filter(F.transform(F.filter(places, lambda p: ~text("$['@type']", p).contains("Virtual")), place), lambda p: p != "")
    mode = text("$.eventAttendanceMode")
    form = (F.when(mode.contains("Mixed"), "hybridne").when(mode.contains("Online"), "online").when(mode.contains("Offline"), "prezencne")
            .when(virtual & (F.size(physical) > 0), "hybridne").when(virtual, "online").when(F.size(physical) > 0, "prezencne").otherwise(""))
    offers = F.filter(_listed(get("$.offers")), lambda o: text("$.price", o) != "")
    amount, currency = text("$.price", F.get(offers, F.lit(0))), F.try_variant_get(F.get(offers, F.lit(0)), "$.priceCurrency", "string")
    price = (F.when(amount == "", "").when(amount.isin("0", "0.0", "0.00"), "zdarma").otherwise(F.concat(
        amount, F.lit(" "), F.when(F.coalesce(currency, F.lit("CZK")) == "CZK", "Kč").otherwise(currency))))
    people = F.coalesce(as_names(get("$.performer")), F.array().cast("array<string>"))
    return [
        squeeze(text("$.name")).alias("title"), start["day"].alias("day"), start["clock"].alias("starts"),
        F.when(end["day"] != start["day"], end["day"]).alias("last_day"), end["clock"].alias("ends"), text("$.url").alias("url"),
        F.array_join(physical, "; ").alias("place"), form.alias("form"), people.alias("lecturers"),
        F.coalesce(price, F.lit("")).alias("price"), squeeze(lines_of(text("$.description"))).alias("note")]


