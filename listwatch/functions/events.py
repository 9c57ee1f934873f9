"""Attributes and identities of calendar events."""

import re

from pyspark.sql import Column, functions as F

from listwatch.functions.text import fold, missing, squeeze

# Phrases announcing a cancelled event, generic title prefixes, form prefixes.
CANCELLED = (r"(?U)\bnebude\s+konat\b|\bse\s+nekona\b|^zruseno\b|zpravou\s+o\s+zruseni"
             r"|\b(?:akce|seminar|webinar|konference|prednaska|kurz)\s+(?:je\s+|byla?\s+|bylo\s+)?zrusen[aoy]?\b")
CANCELLED_CAPITALS = r"(?U)\bZRUŠEN[OAÁY]?\b"
GENERIC_PREFIX = (r"^(?:(?:odborna|mezinarodni|vedecka|online)\s+)?"
                  r"(?:konference|seminar|webinar|kulaty stul|prednaska|kurz)\s+(?=\S)")
FORM_PREFIX = (r"(?iu)^\s*(?:HYBRIDN[ÍI]\s+FORMA|ONLINE(?:\s+(?:FORMA|SEMIN[ÁA][ŘR]))?|WEBIN[ÁA][ŘR]"
               r"|PREZEN[ČC]N[ĚE](?:\s+FORMA)?)\s*[:–-]\s*")
FORMS = ("prezencne", "online", "hybridne")


def attendance_form(text: Column, place: Column | None = None) -> Column:
    """prezencne / online / hybridne from free text; blank when there is none."""
    t = fold(F.concat_ws(" ", F.coalesce(text, F.lit("")),
                         F.coalesce(place, F.lit("")) if place is not None else F.lit("")))
    online = t.rlike(r"online|webinar|on-line|virtual|zoom|stream|e-learning")
    return (F.when(t.rlike("hybrid|mixed"), "hybridne")
            .when(online & t.rlike("prezen|offline|osobne"), "hybridne")
            .when(online, "online").when(F.trim(t) != "", "prezencne").otherwise(""))


def is_cancelled(title: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    return t.rlike(CANCELLED_CAPITALS) | fold(t).rlike(CANCELLED)


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(fold(F.coalesce(title, F.lit(""))), r"[^a-z0-9]+", " "))


def event_key(title: Column) -> Column:
    """Title key without a generic prefix, unless nothing would be left."""
    key = title_key(title)
    bare = F.regexp_replace(key, GENERIC_PREFIX, "")
    return F.when(bare == "", key).otherwise(bare)


def event_id(organiser: Column, day: Column, title: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", organiser, day.cast("string"), title_key(title))), 1, 20)


def content_key(title: Column, note: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", title, note)), 1, 12)


def hearing_uid(court: Column, mark: Column, day: Column, clock: Column) -> Column:
    return F.sha1(F.concat_ws("|", court, mark, day.cast("string"), clock))


def person_hash(name: Column, salt: str = "person") -> Column:
    """Salted hash under which a person's name is remembered; the name itself is not stored.

    An existing cache is read with the salt it was written with.
    """
    return F.sha2(F.concat(F.lit(salt + "|"), squeeze(name)), 256)


def completeness(*fields: Column) -> Column:
    """Number of fields that carry a value."""
    total = F.lit(0)
    for f in fields:
        total = total + F.when(missing(f), 0).otherwise(1)
    return total


def split_form_prefix(title: Column, form: Column) -> tuple[Column, Column]:
    """Move a form announced in the title into the form field: (title, form)."""
    prefix = F.regexp_extract(title, "(" + FORM_PREFIX + ")", 1)
    moved = (prefix != "") & (F.length(title) > F.length(prefix) + 3)
    bare = F.regexp_replace(title, FORM_PREFIX, "")
    return (F.when(moved, bare).otherwise(title),
            F.when(moved & missing(form), attendance_form(prefix)).otherwise(F.coalesce(form, F.lit(""))))


def whole_word_pattern(phrases: list[str]) -> str:
    """Pattern over folded text that matches any of the (folded) phrases as whole words."""

    return r"(?U)(?<!\w)(?:" + "|".join(re.escape(p) for p in phrases) + r")(?!\w)"


