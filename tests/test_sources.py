"""Archive, publishing, dimension files and calendars on temporary folders."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F, types as T

from listwatch.sources import archive as AR, dims as DI, feeds as FE, ical as IC, pages as PG, rosters as RO

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("first_seen", T.TimestampType()),
                       T.StructField("court", T.StringType()), T.StructField("month", T.StringType())])


def rec(spark, *rows):
    return spark.createDataFrame([(i, n, dt.datetime.fromisoformat(s), c) for i, n, s, c in rows],
                                 "id string, name string, first_seen timestamp, court string")


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.json")}


@pytest.fixture
def place(tmp_path):
    return tmp_path / "archive", str(tmp_path / "archive"), str(tmp_path / "index")


def test_feed_takes_the_page_link_and_cuts_the_issn_footer(spark):
    entry = ("<feed><entry><title>First</title><link rel='self' href='https://j.example/feed'/><link rel=\"alternate\" href=\"https://j.example/a\"/>"
             "<summary>About it Volume 63 Online ISSN 0165-075X</summary></entry>"
             "<entry><title>Second</title><link rel='self' href='https://j.example/b'/></entry></feed>")
    rss = ("<rdf><channel><title>c</title><dc:date>2026-08-01T00:00:00Z</dc:date></channel><item><title>Third</title>"
           "<link>https://j.example/c</link><dc:date>2026-08-01T00:00:00Z</dc:date></item></rdf>")
    feeds = spark.createDataFrame([(1, entry), (2, rss)], "k int, x string")
    rows = FE.feed_items(feeds, ["k"], "x", F.lit("2026-08-02").cast("timestamp")).orderBy("title").collect()
    assert [(r["link"], r["abstract"], r["estimated"]) for r in rows] == [
        ("https://j.example/a", "About it", True), ("https://j.example/b", "", True), ("https://j.example/c", "", True)]


def test_upsert_rewrites_only_touched_months(spark, place):
    folder, root, index = place
    assert AR.upsert(spark, root, SCHEMA, rec(spark, ("1", "a", "2026-08-01", "ns"), ("2", "b", "2026-09-01", "ns"), ("3", "c", "2026-09-02", "nss")), index) == 3
    before = files(folder)
    # A known id stays in its month even when it is found again later; a new one opens its own.
    assert AR.upsert(spark, root, SCHEMA, rec(spark, ("1", "A", "2026-10-05", "ns"), ("4", "d", "2026-10-06", "ns")), index) == 2
    after = files(folder)
    untouched = {f for f in before if "month=2026-09" in f}
    assert untouched and all(after[f] == before[f] for f in untouched)
    got = {(r["id"], r["name"], r["month"]) for r in AR.read_archive(spark, root, SCHEMA).collect()}
    assert got == {("1", "A", "2026-08"), ("2", "b", "2026-09"), ("3", "c", "2026-09"), ("4", "d", "2026-10")}
    assert AR.read_index(spark, index).count() == 4
    pruned = AR.read_archive(spark, root, SCHEMA, first="2026-09", last="2026-09")
    assert pruned.count() == 2 and "PartitionFilters: [isnotnull(month" in pruned._jdf.queryExecution().toString()
    ids = spark.createDataFrame([("ns", "1")], "court string, id string")
    assert [r["name"] for r in AR.lookup(spark, root, SCHEMA, index, ids).collect()] == ["A"]


def test_upsert_twice_is_the_same(spark, place):
    _, root, index = place
    batch = rec(spark, ("1", "a", "2026-08-01", "ns"), ("2", "b", "2026-09-01", "ns"))
    AR.upsert(spark, root, SCHEMA, batch, index)
    once = sorted(map(tuple, AR.read_archive(spark, root, SCHEMA).collect()))
    AR.upsert(spark, root, SCHEMA, batch, index)
    assert sorted(map(tuple, AR.read_archive(spark, root, SCHEMA).collect())) == once
    assert AR.read_index(spark, index).count() == 2


def test_publish_only_when_content_changed(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, ["a"], "t1"), (2, [], "t1")], "id int, areas array<string>, generated string")
    assert AR.publish(rows, root, "ns")
    assert not AR.publish(rows.withColumn("generated", F.lit("t2")), root, "ns")
    assert AR.publish(rows.withColumn("areas", F.array(F.lit("b"))), root, "ns")
    assert AR.publish(rows, root, "nss")
    assert spark.read.parquet(root).count() == 4


def test_export_window_from_archive(spark, place):
    _, root, index = place
    AR.upsert(spark, root, SCHEMA, rec(spark, ("1", "a", "2026-08-01", "ns"), ("2", "b", "2026-10-10", "ns")), index)
    arch = AR.read_archive(spark, root, SCHEMA).withColumn("replaced_by", F.lit(""))
    start = F.lit("2026-09-30 22:00:00").cast("timestamp")
    assert [r["id"] for r in AR.window_rows(arch, start).collect()] == ["2"]
    assert [r["id"] for r in AR.window_rows(arch, F.lit("2026-07-31").cast("timestamp"), start).collect()] == ["1"]


def test_recent_months(value):
    assert value(AR.recent_months(F.lit("2026-01-15").cast("timestamp"))) == ["2026-01", "2025-12", "2025-11"]


def test_dimension_files(spark, tmp_path):
    tax = {"verze": 2, "alias": {"stare": "it"}, "oblasti": [{"id": "it", "nazev": "IT a služby", "skupina": "Tech", "vychozi": True},
                                                              {"id": "dane", "nazev": "Daně", "skupina": "Veřejné"}]}
    (tmp_path / "t.json").write_text(json.dumps(tax), encoding="utf-8")
    areas, aliases = DI.read_taxonomy(spark, str(tmp_path / "t.json"))
    assert [(r["id"], r["is_default"]) for r in areas.orderBy("ord").collect()] == [("it", True), ("dane", False)]
    assert aliases.first()["new"] == "it"
    (tmp_path / "m.json").write_text(json.dumps({"x": "note", "rules": {"b": ["it"], "a": ["dane", "it"]}}), encoding="utf-8")
    rules = DI.read_rules(spark, str(tmp_path / "m.json"), "rules").orderBy("ord").collect()
    assert [(r["key"], r["areas"]) for r in rules] == [("b", ["it"]), ("a", ["dane", "it"])]


def test_calendar_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(i, dt.date(2026, 9, 1 + i), f"Akce {i}; část, první " + "ř" * 60) for i in range(5)], "id int, day date, title string")
    none = F.lit(None).cast("date")
    blocks = IC.with_event_block(e, "block", F.concat(F.lit("e"), "id"), "20260901T000000Z", F.col("day"), none, F.lit("9:30"), F.lit(""),
                                 F.col("title"), F.lit("Praha"), F.lit("a\nb"), F.lit("https://x/1"))
    lines = IC.calendar_lines(blocks.select("id", "day", "block"), "block", ["day", "id"], "Test", "x")
    path = str(tmp_path / "cal")
    IC.write_calendar(lines, ["day", "id"], path)
    text = "".join(p.read_text(encoding="utf-8", newline="") for p in sorted((tmp_path / "cal").glob("part-*")))
    assert text.startswith("BEGIN:VCALENDAR\r\n") and text.endswith("END:VCALENDAR\r\n")
    assert all(len(line.encode()) <= 75 for line in text.split("\r\n"))
    back = IC.calendar_events(spark.createDataFrame([(text,)], "t string"), [], "t").orderBy("day").collect()
    assert [(r["title"], r["starts"], r["ends"], r["note"]) for r in back] == [
        (r["title"], "09:30", "10:30", "a\nb") for r in e.orderBy("day").collect()]


def test_calendar_is_read_an_event_at_a_time(spark, tmp_path):
    blocks = spark.range(40).selectExpr("id", "concat('BEGIN:VEVENT\r\nUID:e', id, '\r\nSUMMARY:END:VEVENT', '\r\nEND:VEVENT') as block")
    path = str(tmp_path / "cal")
    IC.write_calendar(IC.calendar_lines(blocks, "block", ["id"], "Test", "x"), ["id"], path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        read = IC.read_calendar(spark, path).orderBy("part", "block", "at").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    texts = [r["text"] for r in read]
    assert len({(r["part"], r["block"]) for r in read}) > 2
    assert texts[0].startswith("BEGIN:VCALENDAR\r\n") and texts[-1].endswith("END:VCALENDAR\r\n")
    events = [x.split("BEGIN:VEVENT\r\n")[1] for x in texts if "BEGIN:VEVENT\r\n" in x]
    assert events == [f"UID:e{i}\r\nSUMMARY:END:VEVENT" for i in range(40)]


def test_calendar_zones(spark):
    text = ("BEGIN:VEVENT\r\nDTSTART;TZID=America/New_York:20260701T090000\r\nDTEND:20260701T140000Z\r\nSUMMARY:A\r\nEND:VEVENT\r\n"
            "BEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20260701\r\nDTEND;VALUE=DATE:20260703\r\nSUMMARY:Dlouhý\r\n  název\r\nEND:VEVENT\r\n")
    got = IC.calendar_events(spark.createDataFrame([(text,)], "t string"), [], "t").orderBy("pos").collect()
    assert [(r["starts"], r["ends"], r["last_day"], r["title"]) for r in got] == [
        ("15:00", "16:00", None, "A"), ("", "", dt.date(2026, 7, 2), "Dlouhý název")]


def test_calendar_unknown_zones(spark):
    zones = (";TZID=Central European Standard Time", ";TZID=No/Such_Zone", ';TZID="Europe/Prague"', ";tzid=UTC",
             ";TZID=America/Argentina/Buenos_Aires", "")
    text = "".join(f"BEGIN:VEVENT\r\nDTSTART{z}:20260701T100000\r\nSUMMARY:A\r\nEND:VEVENT\r\n" for z in zones)
    got = IC.calendar_events(spark.createDataFrame([(text,)], "t string"), [], "t").orderBy("pos").collect()
    assert [r["starts"] for r in got] == ["10:00", "10:00", "10:00", "12:00", "15:00", "10:00"]


def test_embedded_events_at_any_depth(spark):
    event = '{"@type":"Event","name":"%s","startDate":"2026-07-01T10:00:00"}'
    deep = event % "deep"
    for c in ("item", "itemListElement", "events", "@graph", "subEvent", "event"):
        deep = '{"@type":"ItemList","%s":[%s]}' % (c, deep)
    page = lambda *json: "".join(f'<script type="application/ld+json">{j}</script>' for j in json)
    rows = [(1, page(deep, f"[[[{event % 'listed'}]], null, 3]")), (2, page("{broken", "[]")), (3, ""), (4, None)]
    got = PG.embedded_events(spark.createDataFrame(rows, "page int, html string"), ["page"], "html").collect()
    assert sorted((r["page"], r["title"]) for r in got) == [(1, "deep"), (1, "listed")]
    assert PG.embedded_events(spark.createDataFrame([], "page int, html string"), ["page"], "html").count() == 0


def test_document_choice(spark):
    links = spark.createDataFrame([(1, 0, "/documents/zmena.pdf", "Změna rozvrhu"), (1, 1, "/documents/uplne.pdf", "Úplné znění"), (2, 0, "/x", "nic"),
                                   (3, 0, "/documents/a.docx", "Přehled jednání")], "page int, pos int, href string, text string")
    docs = PG.document_links(links)
    pick = lambda **k: {r["page"]: r["href"] for r in PG.pick_links(docs, ["page"], **k).collect()}
    assert pick(preferences=["uplne zneni"], keywords=["rozvrh"]) == {1: "/documents/uplne.pdf", 3: "/documents/a.docx"}
    assert pick(preferences=["uplne zneni"], keywords=["rozvrh"], strict=True) == {1: "/documents/uplne.pdf"}


def test_links_of_all_kinds_in_one_pass(spark):
    html = ('<a href="webcal://x.example/1">Kalendář</a><a href="webcal://x.example/a.ics">K</a><a href="/documents/1">D</a>'
            '<a href="https://x.example/p.PDF">Program&nbsp;(a.pdf)</a><a href="https://y.example/p">Pozvánka</a>')
    links = PG.extract_links(spark.createDataFrame([(1, html)], "page int, html string"), ["page"], "html")
    hosts = F.array(F.lit("x.example"))
    got = sorted((r["kind"], r["href"]) for r in PG.link_kinds(links, ["page"], hosts).collect())
    apart = {"calendar": PG.calendar_links(links), "document": PG.document_links(links), "invitation": PG.invitation_links(links, hosts)}
    assert got == sorted((kind, r["href"]) for kind, rows in apart.items() for r in rows.collect()) and len(got) == 4
    plan = PG.link_kinds(links, ["page"], hosts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_embedded_events_deeper_than_one_pass(spark):
    event = '{"@type":"Event","name":"E%d"}'
    deep = event % 0
    for i in range(1, 11):
        deep = '{"@graph":[%s,%s]}' % (event % i, deep)
    page = f'<script type="application/ld+json">{deep}</script>'
    got = PG.embedded_events(spark.createDataFrame([(1, page)], "page int, html string"), ["page"], "html").collect()
    assert sorted(r["title"] for r in got) == sorted(f"E{i}" for i in range(11))


def test_document_cells_are_a_row_per_table_row(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda *ps: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in ps) + "</w:tc>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:tbl><w:tr/><w:tr>{cell('a', '', 'b')}{cell()}{cell('c')}</w:tr></w:tbl></w:document>")
    cells = RO.document_cells(spark.createDataFrame([("x", out.getvalue())], "path string, content binary"))
    assert [tuple(r) for r in cells.collect()] == [("x", 0, 1, [["a", "b"], [], ["c"]])]
    assert [r["line"] for r in RO.cells_as_text(cells).collect()] == ["a; b |  | c"]


def test_small_tasks_for_parsing(spark, tmp_path, monkeypatch):
    from listwatch import session
    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    monkeypatch.setattr(session, "TASK_BYTES", 10)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 64)
    spread = session.spread(spark.read.parquet(path))
    assert spread.rdd.getNumPartitions() > 64 and spread.count() == 1000


def test_small_tasks_for_many_rows_in_small_files(spark, tmp_path, monkeypatch):
    from listwatch import session
    path = str(tmp_path / "t")
    spark.range(20_000).selectExpr("id % 2 AS a").coalesce(1).write.parquet(path)
    monkeypatch.setattr(session, "TASK_ROWS", 1000, raising=False)
    spread = session.spread(spark.read.parquet(path))
    assert spread.rdd.getNumPartitions() == 20
    assert max(r["n"] for r in spread.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) <= 1100
    assert sorted(r["a"] for r in spread.collect()) == [0] * 10_000 + [1] * 10_000
