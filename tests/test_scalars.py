"""Scalar functions against hand-checked pairs."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from listwatch.functions import dates as D, events as E, legal as L, links as K, loose as O, marks as M, names as N, text as T, titles as I
from listwatch.operators import state as S

DAY = dt.date


def lit(s):
    return F.lit(s)


@pytest.mark.parametrize("now, start", [
    ("2026-11-06 10:00:00", dt.datetime(2026, 9, 30, 22)),
    ("2027-01-15 10:00:00", dt.datetime(2026, 11, 30, 23)),
    ("2026-11-30 23:30:00", dt.datetime(2026, 10, 31, 23)),
    ("2026-11-30 22:30:00", dt.datetime(2026, 9, 30, 22)),
])
def test_window_start_follows_the_business_calendar(value, now, start):
    got = value(D.window_start(lit(now).cast("timestamp")).cast("string"))
    assert got == str(start)


@pytest.mark.parametrize("raw, key, part", [
    ("28 Cdo 3880/2023- II.", "28cdo3880/2023", "II"),
    ("23 Cdo 418 / 2026", "23cdo418/2026", ""),
    ("30 Cdo 239/2026/", "30cdo239/2026", ""),
    ("29 NSČR 18/2024", "29nscr18/2024", ""),
])
def test_mark_key(value, raw, key, part):
    assert tuple(value(M.mark_key(lit(raw)))) == (key, part)


def test_marks(value):
    assert value(M.display_mark(lit(" 28 Cdo  3880 / 2023- II."))) == "28 Cdo 3880/2023 - II."
    assert tuple(value(M.mark_parts(lit("29 NSČR 18/2024")))) == (29, "NSČR")
    assert tuple(value(M.mark_parts(lit("Cpjn 202/2025")))) == (None, "")
    assert value(M.docket_number(lit("21 Afs    31/2026 -   32"))) == "21 Afs 31/2026-32"
    assert value(M.constitutional_mark(lit("IV.ÚS 465/26 #1"), lit(""))) == "IV. ÚS 465/26"
    assert value(M.constitutional_mark(lit("x"), lit("nález sp. zn. IV. ÚS 465/26 ze dne 1. 1."))) == "IV. ÚS 465/26"
    assert value(M.senate_key(F.lit(12), lit("eCm"))) == "12 ECm"
    assert value(M.typed_mark(lit("9  c 10 / 2024"))) == "9 C 10/2024"
    assert value(M.typed_mark(lit("nic"))) is None
    assert value(M.eu_case(lit("62025CJ0151"))) == "C-151/25"
    assert value(M.eu_notice(lit("C-1009/26"))) == "62026CN1009"


def test_dates(value):
    assert value(D.czech_date(lit("dne 31. 2. 2026"))) is None
    assert value(D.czech_date_text(lit("31. 2. 2026"))) == "2026-02-31"
    assert value(D.any_date(lit("2026-10-01T09:00+02:00"))) == DAY(2026, 10, 1)
    assert value(D.any_date(lit("1. 10. 2026"))) == DAY(2026, 10, 1)
    assert value(D.english_date(lit("20  Sep 2026"))) == DAY(2026, 9, 20)
    assert value(D.feed_time(lit("Út, 22 Sep 2026 10:00:00 +0200")).cast("string")) == "2026-09-22 08:00:00"
    assert value(D.feed_time(lit("nesmysl"))) is None
    assert tuple(value(D.to_business_clock(lit("2026-07-01T23:30:00Z")))) == (DAY(2026, 7, 2), "01:30")
    assert tuple(value(D.to_business_clock(lit("2026-07-01T09:30")))) == (DAY(2026, 7, 1), "09:30")
    assert tuple(value(D.to_business_clock(lit("1. 7. 2026")))) == (DAY(2026, 7, 1), "")
    assert value(D.clock(lit("09.05"))) == "09:05"
    assert value(D.clock(lit("25:00"))) == ""
    assert value(D.minutes_of_day(lit(""))) == 24 * 60 + 1
    assert tuple(value(D.header_period(lit("v období od 16.08.2026 do 31.08.2026")))) == (DAY(2026, 8, 16), DAY(2026, 8, 31))
    assert value(D.header_period(lit("období 30. 9. 2026 – 16. 9. 2026"))) is None
    assert tuple(value(D.link_period(lit("https://x/spravni-usek-16-30-9-2026")))) == (DAY(2026, 9, 16), DAY(2026, 9, 30))
    assert tuple(value(D.validity(lit("změna č. 3 od 1. září 2026")))) == ("změna č. 3 od 1. 9. 2026", DAY(2026, 9, 1))
    assert tuple(value(D.validity(lit("s účinností ode dne 1. října 2026")))) == ("s účinností od 1. 10. 2026", DAY(2026, 10, 1))
    assert value(D.validity(lit("rozvrh práce"))) is None
    assert value(D.range_label(lit("2025-12-29").cast("date"), lit("2026-01-05").cast("date"))) == "29. 12. 2025 – 5. 1. 2026"


@pytest.mark.parametrize("raw, clean", [
    ("Mailboxde.cz s.r.o. se soudila s Úřadem", "Mailboxde.cz se soudila s Úřadem"),
    ("Uniphone, s.r.o. se soudila", "Uniphone se soudila"),
    ("Spolek Radslavská zátoka, z. s., a Spolek chatařů, z. s., podali žalobu", "Spolek Radslavská zátoka a Spolek chatařů podali žalobu"),
    ("Žalobkyní byla Alfa s.r.o. Soud rozhodl.", "Žalobkyní byla Alfa. Soud rozhodl."),
    ("Gamma GmbH & Co. KG a Delta sp. z o.o. se přely", "Gamma a Delta se přely"),
    ("BASF AG a Bayer AG proti Komisi.", "BASF a Bayer proti Komisi."),
    ("Stanovisko GA se týká toho, zda se SE musí", "Stanovisko GA se týká toho, zda se SE musí"),
])
def test_legal_forms(value, raw, clean):
    assert value(L.without_legal_forms(lit(raw))) == clean


def test_headings(value):
    assert value(L.strip_outcome(lit("Předkupní právo k pozemku – dovolání odmítnuto"))) == "Předkupní právo k pozemku"
    apart = unicodedata.normalize("NFD", "Předkupní právo k pozemku")
    assert value(L.strip_outcome(lit(apart + unicodedata.normalize("NFD", " – dovolání odmítnuto")))) == apart
    assert value(L.strip_outcome(lit("Nabídka: smlouva – nepřípustné: zamítnuto."))) == "Nabídka: smlouva"
    assert value(L.strip_outcome(lit("Dovolání odmítnuto"))) == "Dovolání odmítnuto"
    assert value(L.generic_heading(lit("Místní příslušnost soudu")))
    assert not value(L.generic_heading(lit("Obecné ujištění nevylučuje zjevné vady")))
    assert value(L.generic_heading(lit("Kauza Călinescu a její následky")))
    assert value(L.fix_ki_ending(lit("pohledávki wiki záruki Nokiaki"))) == "pohledávky wiki záruky Nokiaki"


def test_names(value):
    assert value(N.short_party(lit("Ing. Tomáš Seidl"))) == "Tomáš Seidl"
    assert value(N.short_party(lit("OSA z.s."))) == "OSA"
    assert value(N.short_party(lit("House"))) == "House"
    assert value(N.short_party(lit("INTERGRAM nezávislá společnost umělců a výrobců"))) == "INTERGRAM"
    assert value(N.short_party(lit("Úřad průmyslového vlastnictví ČR"))) == "ÚPV"
    assert value(N.initials(lit("Ing. Tomáš Seidl Ph.D. MBA"))) == "T. S."
    sides = F.array(lit("Bayer AG"), lit("Bayer Intellectual Property GmbH"), lit("Teva s.r.o."), lit("Další"))
    assert value(N.party_label(sides)) == "Bayer v. Teva a další"
    people = F.array(lit("Karel Jedna"), lit("Karla Šestá"))
    assert value(N.party_label(people, F.transform(people, N.initials))) == "K. J. v. K. Š."
    assert value(N.party_label(F.array().cast("array<string>"))) == ""
    assert value(N.given_name_first(lit("VYMYŠLENÝ Adam"))) == "Adam Vymyšlený"
    assert value(N.given_name_first(lit("Bartoň Michal"))) == "Michal Bartoň"
    assert value(N.judge_key(lit("JUDr. Mgr. Petr Dubovák, Ph.D."))) == "petr dubovák"
    lines = F.array(*[lit(x) for x in ("Alfa", "s r.o.", "Jan Novák", "Ph.D. MBA", "MBA Consulting")])
    assert value(N.merge_continuations(lines)) == ["Alfa s r.o.", "Jan Novák Ph.D. MBA", "MBA Consulting"]
    assert value(N.clean_authors(lit("Jan Novák (Author), Eva Malá and jan novák"))) == "Jan Novák, Eva Malá"


def test_titles(value):
    raw = "THE ROLE OF AI IN EU LAW: A STUDY OF SMES AND CJEU'S 3RD CASE"
    assert value(I.sentence_case(lit(raw))) == "The Role of AI in EU Law: A Study of SMEs and CJEU's 3rd Case"
    assert value(I.sentence_case(lit("AI ACT"))) == "AI ACT"
    assert value(I.clean_title(lit("A <i>short</i> &amp; plain title"))) == "A short & plain title"


def test_links(value):
    assert value(K.link_shape(lit("/a/12/b3?z=1&a=2#x"))) == "/a/N/bN?a&z"
    assert value(K.article_key(lit("10.54648/cola2026087"), lit(""))) == "COLA2026087"
    assert value(K.article_key(lit(""), lit("https://k.example/J/63.5/COLA2026072"))) == "COLA2026072"
    assert value(K.doi_of(lit(""), lit("https://doi.org/10.1093/jiplp/JPAA001."))) == "10.1093/jiplp/jpaa001"
    hosts = F.array(lit("x.cz"))
    assert value(K.allowed_link(lit("https://m.x.cz/a"), hosts))
    assert not value(K.allowed_link(lit("https://ex.cz/a"), hosts))
    assert not value(K.allowed_link(lit("ftp://x.cz/a"), hosts))


def test_events(value):
    assert value(E.attendance_form(lit("Webinář i prezenčně"))) == "hybridne"
    assert value(E.attendance_form(lit(""), lit(""))) == ""
    assert value(E.is_cancelled(lit("POZOR: seminář se NEBUDE KONAT")))
    assert not value(E.is_cancelled(lit("Zrušení společnosti")))
    assert value(E.event_key(lit("Konference: Daňové právo 2026"))) == "danove pravo 2026"
    assert value(E.event_key(lit("Konference"))) == "konference"
    title, form = E.split_form_prefix(lit("HYBRIDNÍ FORMA: Daně"), lit(""))
    assert (value(title), value(form)) == ("Daně", "hybridne")


def test_loose_json(value):
    assert value(O.as_text(F.parse_json(lit('["online","prezencne"]')))) == "online prezencne"
    assert value(O.as_text(F.parse_json(lit('["", "b"]')), True)) == "b"
    assert value(O.as_text(F.parse_json(lit('{"a":1}')))) == ""
    assert value(O.as_text(F.parse_json(lit("12")))) == "12"
    assert value(O.as_names(F.parse_json(lit('[{"name":"A  B"},"C"]')))) == ["A B", "C"]
    assert value(O.yes_no(lit("Ano."))) is True
    assert value(O.yes_no(lit("možná"))) is None


def test_text(value):
    assert value(T.strip_accents(lit("Řízení øłß"))) == "Rizeni øłß"
    assert value(T.unescape(lit("a&nbsp;b &amp;lt; &#269;&#x10D; &sect;1"))) == "a\xa0b &lt; čč §1"
    assert value(T.mixed_script(lit("Vrchnιho soudu")))
    assert not value(T.mixed_script(lit("Fővárosi Călinescu")))
    assert value(T.plural(F.lit(3), "den", "dny", "dní")) == "3 dny"
    assert value(T.distinct_ignoring_case(F.array(lit("A"), lit("b"), lit("a"), lit("B")))) == ["A", "b"]


def test_backoff(value):
    hours = [value(S.backoff_hours(F.lit(n))) for n in range(1, 8)]
    assert hours == [1, 2, 4, 8, 16, 20, 20]


def test_late_data_policy(value):
    now = lit("2026-09-24 05:00:00").cast("timestamp")

    def seen(day, bootstrap=False):
        return value(S.assigned_first_seen(lit(day).cast("date"), now, F.lit(bootstrap)).cast("string"))

    assert seen("2026-09-20") == "2026-09-24 05:00:00"
    assert seen("2026-09-01") == "2026-09-01 12:00:00"
    assert seen("2026-09-20", True) == "2026-09-20 12:00:00"
    assert seen("2026-09-30", True) == "2026-09-24 05:00:00"
    assert seen(None, True) == "2026-09-24 05:00:00"


def test_periods_of_headings_and_links(value):
    def days(c):
        return value(F.concat_ws("/", c["start"].cast("string"), c["end"].cast("string")))
    assert days(D.header_period(lit("Přehled za období od 16.08.2026 do 31. 8. 2026"))) == "2026-08-16/2026-08-31"
    assert days(D.header_period(lit("od 1.1.2026 – 2.1.2026 a od 3.1.2026 do 4.1.2026"))) == "2026-01-01/2026-01-02"
    assert days(D.header_period(lit("od 31.8.2026 do 16.8.2026"))) == "" and days(D.header_period(lit("16.8.2026 do 31.8.2026"))) == ""
    assert days(D.link_period(lit("https://x.cz/prehled-jednani-16-30-9-2026/"))) == "2026-09-16/2026-09-30"
    for url in ("16-30-9-2026", "https://x.cz/a-30-16-9-2026", "https://x.cz/a-16-31-9-2026", "https://x.cz/a-16-30-9-26", "", None):
        assert days(D.link_period(lit(url).cast("string"))) == ""


def test_titles_and_parties_at_the_edges(value):
    title = I.sentence_case(lit("THE SMES' RIGHTS UNDER L'EU AND THE 2ND USA-UK TREATY: AN IOT STUDY"))
    assert value(title) == "The SMEs' Rights under L'EU and the 2nd USA-UK Treaty: An IoT Study"
    assert value(I.sentence_case(lit("EU LAW"))) == "EU LAW"
    long = "Společnost " + "x" * 40
    assert value(N.short_party(lit(long))) == "Společnost…"
    assert value(N.short_party(lit("y" * 40))) == "y" * 32 + "…"
    assert value(N.short_party(lit("a.s."))) == "a.s." and value(N.short_party(lit("  "))) == ""
    assert value(N.initials(lit("Ing."))) == "I." and value(N.initials(lit("jan 3m"))) == "J. 3m"
