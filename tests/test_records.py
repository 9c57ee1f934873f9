"""Hand-over of whole enrichments, page texts, journals, run reports and change rows on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from listwatch.operators import answers as A, events as EV, merge as M, publish as P, report as R, subscribe as SB

DAY = dt.datetime


def test_enrichment_hand_over(spark):
    schema = ("id string, mark string, court string, kind string, early boolean, first_seen timestamp, "
              "enrichment struct<summary: string, areas: array<string>>, replaced_by string")
    full, bare = ("S", ["it"]), ("", ["ip"])
    rows = spark.createDataFrame([
        ("n1", "1", "ns", "rozsudek", True, DAY(2026, 3, 1), bare, ""), ("n2", "1", "ns", "usnesení", False, DAY(2026, 3, 9), None, None),
        ("e1", "2", "eu", "otázka", True, DAY(2026, 1, 1), full, ""), ("e2", "2", "eu", "rozsudek", False, DAY(2026, 2, 1), None, ""),
        ("e3", "3", "eu", "otázka", True, DAY(2026, 1, 1), bare, ""), ("e4", "3", "eu", "otázka", False, DAY(2026, 2, 1), None, ""),
        ("x1", "4", "ns", "a", True, DAY(2026, 1, 1), full, "gone"), ("x2", "4", "ns", "a", False, DAY(2026, 2, 1), None, ""),
        ("k1", "5", "ns", "a", True, DAY(2026, 1, 1), full, ""), ("k2", "5", "ns", "a", False, DAY(2025, 2, 1), ("own", None), "")], schema)
    done = M.hand_over_enrichment(rows, ["mark", "court"], F.col("early"), F.col("court") == "ns", F.when(F.col("court") == "eu", F.col("kind")))
    assert done.columns == rows.columns
    got = {r["id"]: (r["first_seen"], tuple(r["enrichment"] or ()), r["replaced_by"]) for r in done.collect()}
    assert got["n2"] == (DAY(2026, 3, 1), bare, None) and got["n1"][2] == "n2"
    # Another kind of an EU court takes nothing and replaces nothing.
    assert got["e2"] == (DAY(2026, 2, 1), (), "") and got["e1"][2] == ""
    # Without a summary the EU notice keeps its own time, but takes the enrichment.
    assert got["e4"] == (DAY(2026, 2, 1), bare, "") and got["e3"][2] == "e4"
    assert got["x1"][2] == "gone" and got["x2"] == (DAY(2026, 2, 1), (), "")
    assert got["k2"] == (DAY(2025, 2, 1), ("own", None), "")


def test_fill_from_pages(spark):
    items = spark.createDataFrame([(1, "T", "old", "", ""), (2, "T", "old", None, None), (3, "T", "old", "s", ""), (4, None, "old", "", ""),
                                   (5, "T", "old", "", "kept"), (6, "T", "old", "", "")],
                                  "id int, title string, description string, summary string, base string")
    pages = spark.createDataFrame([(1, "A", "B"), (2, "", "B"), (3, "A", "B"), (4, "A", None), (5, "A", "B"), (6, None, "")],
                                  "id int, abstract string, text string")
    got = {r["id"]: (r["description"], r["base"], r["filled"]) for r in M.fill_from_pages(items, pages, "id").collect()}
    assert got == {1: ("A", "T\n\nA", True), 2: ("old", "T\n\nB", True), 3: ("old", "", None), 4: ("A", "\n\nA", True),
                   5: ("old", "kept", None), 6: ("old", "", False)}


def test_registry_prefers_present_abbreviations(spark):
    registry = spark.createDataFrame([("j1", "AB", ["OLD", "CD"]), ("j2", "CD", [])], "journal string, abbreviation string, former array<string>")
    rows = spark.createDataFrame([("AB",), ("OLD",), ("CD",), ("",), (None,)], "abbreviation string")
    got = {r["abbreviation"]: r["journal"] for r in P.in_registry(rows, registry).collect()}
    assert got == {"AB": "j1", "OLD": "j1", "CD": "j2", "": "", None: ""}


def test_run_report(spark):
    found = spark.createDataFrame([("a", True, False), ("a", False, True), ("b", False, True)], "s string, is_new boolean, deferred boolean")
    errors = spark.createDataFrame([("c", "y"), ("c", "x")], "s string, error string")
    previous = spark.createDataFrame([("a", 1, None), ("c", 0, None), ("d", 0, None), ("e", 0, "down"), ("f", 3, "")],
                                     "s string, found long, error string")
    got = {r["s"]: (r["found"], r["errors"], r["error"], r["warning"]) for r in R.run_report(found, errors, previous, "s").collect()}
    assert got == {"a": (2, 0, "", ""), "b": (1, 0, "", "only deferred"), "c": (0, 2, "x", ""), "d": (0, 0, "", "empty twice"),
                   "e": (0, 0, "", ""), "f": (0, 0, "", "")}


def test_change_rows_and_referrals(spark):
    hearings = spark.createDataFrame([(1,), (2,)], "mark int")
    changes = spark.createDataFrame([(1, "d1", "w1"), (1, "d2", "w2"), (3, "d", "w")], "mark int, found string, wording string")
    assert sorted(map(tuple, SB.change_rows(hearings, changes, ["mark"]).collect())) == [(1, "d1", "w1"), (1, "d2", "w2"), (2, None, None)]
    days = spark.createDataFrame([("2025-11-30",), ("2025-12-01",), (None,)], "day string")
    assert P.recent_referrals(days, "day", F.lit("2026-01-31").cast("date")).count() == 1


def test_normalise_events(spark):
    schema = "org string, title string, day string, last_day string, starts string, form string, place string, lecturers array<string>, note string, url string"
    blank = (None,) * 6
    rows = spark.createDataFrame([
        ("o", "HYBRIDNÍ FORMA: Smlouvy", "1. 2. 2026", "2026-02-03", "9.00", None, "Brno", [" A  B ", "", *"cdefghij"], "x" * 700, "/k 1"),
        ("o", "ONLINE: AI", "2026-02-01", "2026-01-01", "25:00", "prezencne", None, None, None, "http://evil.org/a"),
        ("o", "Kurz byl zrušen – kurz je zrušen", "2026-02-01", *blank, None), ("o", " ", "2026-02-01", *blank, None),
        ("o", "Bez data", "brzy", *blank, None), ("o", None, None, *blank, None),
        ("o", "Seminář", "2026-02-01", None, None, "webinář", None, [], None, "https://sub.ok.cz/x")], schema)
    got = {r["title"]: r.asDict() for r in EV.normalise_events(rows, "org", F.array(F.lit("ok.cz")), "https://ok.cz").collect()}
    assert set(got) == {"Smlouvy", "ONLINE: AI", "Seminář"}
    one = got["Smlouvy"]
    assert (one["form"], str(one["day"]), str(one["last_day"]), one["starts"], one["url"]) == ("hybridne", "2026-02-01", "2026-02-03", "09:00", "https://ok.cz/k%201")
    assert one["lecturers"] == ["A B", *"cdefghi"] and len(one["note"]) == 600 and one["price"] == "" and one["ends"] == ""
    # Too little would be left of this title; the organiser's own form stays.
    assert got["ONLINE: AI"]["form"] == "prezencne" and got["ONLINE: AI"]["url"] == "" and got["ONLINE: AI"]["last_day"] is None
    assert (got["Seminář"]["form"], got["Seminář"]["url"], got["Seminář"]["lecturers"]) == ("online", "https://sub.ok.cz/x", [])
    few = EV.normalise_events(spark.createDataFrame([("o", "A", "2026-02-01", "x; y\nz")], "org string, title string, day string, lecturers string"),
                              "org", F.array().cast("array<string>"), "").first()
    assert few["lecturers"] == ["x", "y", "z"] and few["form"] == ""


def test_batch_answers(spark):
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d")], "batch int, id string")
    answers = spark.createDataFrame([(1, 'So: {"a": ["it", "x", "it", "ip"], "b": "it", "z": ["it"]}'), (2, "none")], "batch int, raw string")
    done = A.accept_areas(asked, A.batch_answers(answers, "batch", "raw"), "batch", F.array(F.lit("ip"), F.lit("it")))
    assert {r["id"]: r["areas"] for r in done.collect()} == {"a": ["it", "ip"], "b": [], "c": None, "d": None}
    names = asked.withColumnRenamed("id", "name")
    lists = spark.createDataFrame([(1, 'ok ["a", "stranger"]'), (2, "[broken")], "batch int, raw string")
    assert {r["name"]: r["verdict"] for r in A.judged_people(names, lists, "batch", "raw").collect()} == {
        "a": "person", "b": "other", "c": "other", "d": "open"}
