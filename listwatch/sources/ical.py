"""iCalendar files read and written."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listwatch.functions.dates import BUSINESS_ZONE, minutes_of_day
from listwatch.functions.events import attendance_form
from listwatch.functions.text import missing

LINE_OCTETS = 75
# Zone block of the published calendars.
ZONE_BLOCK = ("BEGIN:VTIMEZONE", "TZID:Europe/Prague", "BEGIN:STANDARD", "DTSTART:19701025T030000",
              "RRULE:FREQ=YEARLY;BYMONTH=10;BYDAY=-1SU", "TZOFFSETFROM:+0200", "TZOFFSETTO:+0100", "TZNAME:CET",
              "END:STANDARD", "BEGIN:DAYLIGHT", "DTSTART:19700329T020000", "RRULE:FREQ=YEARLY;BYMONTH=3;BYDAY=-1SU",
              "TZOFFSETFROM:+0100", "TZOFFSETTO:+0200", "TZNAME:CEST", "END:DAYLIGHT", "END:VTIMEZONE")


def _property(block: Column, name: str) -> tuple[Column, Column]:
    """(parameters, value) of a property line."""
    shape = rf"(?im)^{name}((?:;[^:\n]*)?):(.*)$"
    return F.regexp_extract(block, shape, 1), F.regexp_extract(block, shape, 2)


def plain_text(c: Column) -> Column:
    for escaped, char in (("\\n", "\n"), ("\\N", "\n"), ("\\,", ","), ("\\;", ";"), ("\\\\", "\\")):
        c = F.replace(c, F.lit(escaped), F.lit(char))
    return c


def _moment(name: str, params: Column, value: Column) -> list[Column]:
    """Raw pieces of a date property: is_date, wall-clock time, UTC mark, instant in its zone, date text.

    The instant is null without a zone and where the zone is unknown.
    """
    v, kind = F.trim(value), F.upper(params)
    is_date = (kind.contains("VALUE=DATE") & ~kind.contains("VALUE=DATE-TIME")) | v.rlike(r"^\d{8}$")
    zone = F.trim(F.regexp_extract(params, r"(?i);TZID=\"?([^;:\"]+)", 1))
    stamp = r"^(\d{8}T\d{4})\d{0,2}Z?$"
    wall = F.when(v.rlike(stamp), F.try_to_timestamp(F.regexp_extract(v, stamp, 1), F.lit("yyyyMMdd'T'HHmm")))
    zoned = F.when(v.rlike(stamp) & (zone != ""), F.try_to_timestamp(
        F.concat_ws(" ", F.regexp_extract(v, stamp, 1), zone), F.lit("yyyyMMdd'T'HHmm VV")))
    return [is_date.alias(f"{name}_is_date"), wall.alias(f"{name}_wall"), v.endswith("Z").alias(f"{name}_utc"),
            zoned.alias(f"{name}_zoned"), F.substring(v, 1, 8).alias(f"{name}_text")]


def _local(name: str) -> list[Column]:
    """Day and clock in the business zone."""
    is_date, wall, utc, zoned, text = (F.col(f"{name}_{x}") for x in ("is_date", "wall", "utc", "zoned", "text"))
    local = (F.when(utc, F.from_utc_timestamp(wall, BUSINESS_ZONE))
             .when(zoned.isNotNull(), F.from_utc_timestamp(zoned, BUSINESS_ZONE)).otherwise(wall))
    return [is_date, F.when(is_date, F.try_to_date(text, "yyyyMMdd")).otherwise(local.cast("date")).alias(f"{name}_day"),
            F.when(is_date | wall.isNull(), "").otherwise(F.date_format(local, "HH:mm")).alias(f"{name}_clock")]


def calendar_events(files: DataFrame, key: list[str], text: str) -> DataFrame:
    """Events of calendar files: folded lines joined, all-day ends moved back to the last day.

    A time in an unknown zone keeps its wall clock.
    """
    whole = F.regexp_replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), r"\n[ \t]", "")
    blocks = F.regexp_extract_all(whole, F.lit(r"(?is)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))
    rows = files.select(*key, F.posexplode(blocks).alias("pos", "_b"))
    b = F.col("_b")
    raw = {}
    for name in ("DTSTART", "DTEND", "SUMMARY", "LOCATION", "URL", "DESCRIPTION"):
        raw[f"_{name}_p"], raw[f"_{name}"] = _property(b, name)
    rows = rows.select(*key, "pos", *[c.alias(n) for n, c in raw.items()])
    rows = rows.select(
        *key, "pos", *_moment("start", F.col("_DTSTART_p"), F.col("_DTSTART")), *_moment("end", F.col("_DTEND_p"), F.col("_DTEND")),
        plain_text(F.col("_SUMMARY")).alias("title"), plain_text(F.col("_LOCATION")).alias("place"), F.trim("_URL").alias("url"),
        plain_text(F.col("_DESCRIPTION")).alias("note"))
    rows = rows.select(*key, "pos", "title", "place", "url", "note", *_local("start"), *_local("end"))
    until = F.when(F.col("end_is_date"), F.date_sub("end_day", 1)).otherwise(F.col("end_day"))
    return rows.select(
        *key, "pos", "title", F.col("start_day").alias("day"), F.col("start_clock").alias("starts"),
        F.when(until != F.col("start_day"), until).alias("last_day"), F.col("end_clock").alias("ends"), "place", "url", "note",
        attendance_form(F.lit(""), F.col("place")).alias("form"))


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for char, escaped in ((";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        c = F.replace(c, F.lit(char), F.lit(escaped))
    return c


def fold_line(line: Column) -> Column:
    """Break a line so that no piece exceeds 75 octets; continuations start with a blank."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(LINE_OCTETS).alias("room"))

    def step(acc, char):
        size = F.octet_length(char)
        full = acc["used"] + size > acc["room"]
        return F.struct(
            F.concat(acc["text"], F.when(full, F.lit("\r\n ")).otherwise(""), char).alias("text"),
            F.when(full, size).otherwise(acc["used"] + size).alias("used"),
            F.when(full, F.lit(LINE_OCTETS - 1)).otherwise(acc["room"]).alias("room"))

    folded = F.aggregate(F.filter(F.split(line, ""), lambda ch: ch != ""), start, step, lambda acc: acc["text"])
    return F.when(F.octet_length(line) <= LINE_OCTETS, line).otherwise(folded)


def with_event_block(events: DataFrame, out: str, uid: Column, stamp: str, day: Column, last_day: Column, starts: Column,
                     ends: Column, title: Column, place: Column, note: Column, url: Column, transparent: bool = True) -> DataFrame:
    """Events with their VEVENT text in ``out``.

    Timed or all-day; a course longer than a week shows on its first day.
    """
    given = events.withColumns({
        "_ymd": F.date_format(day, "yyyyMMdd"), "_span": F.coalesce(F.datediff(last_day, day), F.lit(0)), "_begin": minutes_of_day(starts),
        "_end": minutes_of_day(ends), "_has_start": ~missing(starts), "_has_end": ~missing(ends), "_single": last_day.isNull()})
    long, begin = F.col("_span") > 7, F.col("_begin")
    finish = F.when(F.col("_has_end") & (F.col("_end") > begin), F.col("_end")).otherwise(F.least(begin + 60, F.lit(23 * 60 + 59)))
    stop = F.date_add(F.when(long, day).otherwise(F.coalesce(last_day, day)), 1)
    given = given.withColumns({"_timed": F.col("_has_start") & (F.col("_single") | long), "_finish": finish,
                               "_stop": F.date_format(stop, "yyyyMMdd")})

    def moment(name: str, minutes: str, date: str) -> Column:
        m = F.col(minutes)
        clock = F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"), F.lit("00"))
        return F.when(F.col("_timed"), F.concat(F.lit(f"{name};TZID={BUSINESS_ZONE}:"), "_ymd", F.lit("T"), clock)).otherwise(
            F.concat(F.lit(f"{name};VALUE=DATE:"), date))

    lines = F.array_compact(F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.lit(f"DTSTAMP:{stamp}"), moment("DTSTART", "_begin", "_ymd"),
        moment("DTEND", "_finish", "_stop"), F.concat(F.lit("SUMMARY:"), escape(title)),
        F.when(~missing(place), F.concat(F.lit("LOCATION:"), escape(place))), F.when(~missing(note), F.concat(F.lit("DESCRIPTION:"), escape(note))),
        F.when(~missing(url), F.concat(F.lit("URL:"), url)), F.lit("STATUS:CONFIRMED"),
        F.lit("TRANSP:TRANSPARENT" if transparent else "TRANSP:OPAQUE"), F.lit("END:VEVENT")))
    given = given.withColumn("_lines", lines)
    return given.select(*events.columns, F.array_join(F.transform("_lines", fold_line), "\r\n").alias(out))


def calendar_lines(blocks: DataFrame, block: str, order: list[str], name: str, product: str) -> DataFrame:
    """(section, text) rows of a calendar: header, blocks, footer."""
    head = ["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:-//{product}//CS", "CALSCALE:GREGORIAN", "METHOD:PUBLISH",
            f"X-WR-CALNAME:{name}", f"X-WR-TIMEZONE:{BUSINESS_ZONE}", "REFRESH-INTERVAL;VALUE=DURATION:PT12H", *ZONE_BLOCK]
    spark = blocks.sparkSession
    ends = spark.createDataFrame([(0, "\r\n".join(head)), (2, "END:VCALENDAR")], "section int, text string")
    body = blocks.select(F.lit(1).alias("section"), *order, F.col(block).alias("text"))
    return body.unionByName(ends, allowMissingColumns=True)


def write_calendar(lines: DataFrame, order: list[str], path: str) -> None:
    """Write the calendar as text parts in order: concatenated by name they are the file.

    The order comes from a range partitioning, so no task holds the whole calendar.
    """
    (lines.orderBy("section", *order).select("text").write.mode("overwrite").option("lineSep", "\r\n").text(path))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, at, text): a written calendar, a row per event without its end line.

    A row holds one event, the first one of the file also the header, the last one the footer.  ``part``, ``block`` (where a
    split of the part begins) and ``at`` give their order; no row and no task holds more than a split.
    """
    where = [F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", "\r\nEND:VEVENT\r\n").text(path).select(
        *where, F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
