"""Event rows from whatever an organiser publishes."""

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.dates import any_date, clock
from listwatch.functions.events import FORMS, attendance_form, event_id, is_cancelled, split_form_prefix
from listwatch.functions.links import absolute, allowed_link
from listwatch.functions.text import let, missing, squeeze
from listwatch.operators.reconcile import clean_lecturers

NOTE_LENGTH = 600
RAW_FIELDS = ("title", "day", "last_day", "starts", "ends", "place", "form", "lecturers", "price", "note", "url")


def split_lecturers(names: Column) -> Column:
    """Names of a text that separates them by semicolons or lines."""
    return F.split(F.coalesce(names, F.lit("")), r"\s*[;\n]\s*")


def normalise_events(raw: DataFrame, organiser: str, hosts: Column, base: str) -> DataFrame:
    """One event row per usable raw row, in which every field is text.

    A row without a title or a readable day, and one whose title says that the event is cancelled, gives none.
    A form of attendance announced in front of the title moves to its own field.  Links are resolved against ``base`` and kept
    only on the ``hosts`` of the organiser (an array column, which may differ per row); at most eight lecturers and 600
    characters of the note stay; ``last_day`` is null unless it is after the first.  Absent fields count as empty.
    """
    field = {n: F.col(n) if n in raw.columns else F.lit(None).cast("string") for n in RAW_FIELDS}
    names = field["lecturers"] if dict(raw.dtypes).get("lecturers", "").startswith("array") else split_lecturers(field["lecturers"])
    tidy = raw.select(
        organiser, any_date(field["day"]).alias("day"), squeeze(field["title"]).alias("_title"), squeeze(field["place"]).alias("place"),
        any_date(field["last_day"]).alias("_last"), clock(field["starts"]).alias("starts"), clock(field["ends"]).alias("ends"),
        F.coalesce(field["form"], F.lit("")).alias("_form"), clean_lecturers(names).alias("lecturers"),
        squeeze(F.coalesce(field["price"], F.lit(""))).alias("price"),
        F.left(squeeze(F.coalesce(field["note"], F.lit(""))), F.lit(NOTE_LENGTH)).alias("note"),
        F.when(missing(field["url"]), "").otherwise(absolute(F.trim(field["url"]), base)).alias("_url"), hosts.alias("_hosts"))
    usable = tidy.where(F.col("day").isNotNull() & ~missing(F.col("_title")) & ~is_cancelled(F.col("_title")))
    title, form = split_form_prefix(F.col("_title"), F.col("_form"))
    moved = usable.withColumns({"title": title, "_form": form, "place": F.coalesce("place", F.lit(""))})
    return moved.select(
        event_id(F.col(organiser), F.col("day"), F.col("title")).alias("id"), organiser, "day",
        F.when(F.col("_last") > F.col("day"), F.col("_last")).alias("last_day"), "starts", "ends", "title", "place",
        let(F.col("_form"), lambda f: F.when(f.isin(*FORMS), f).otherwise(attendance_form(f, F.col("place")))).alias("form"),
        "lecturers", "price", "note", F.when(allowed_link(F.col("_url"), F.col("_hosts")), F.col("_url")).otherwise("").alias("url"))
