"""Case marks: display form, comparison key, and their typed parts."""

from pyspark.sql import Column, functions as F

from listwatch.functions.text import squeeze, strip_accents

# Shape of a case mark ("23 Cdo 418/2026") in decisions and in hearing rosters.
DECISION_MARK = r"^\s*(\d+)\s*([^\d\s/]+)\s+(\d+)\s*/\s*(\d{2,4})\s*(.*)$"
ROSTER_MARK = r"(\d+)\s*([A-Za-z]+)\s+(\d+)\s*/\s*(\d{4})"
EU_WORK = r"^6(\d{4})([CT])[A-Z]{1,2}(\d{4})"
EU_CASE = r"^C-(\d+)/(\d{2})$"

_PART = r" - ([ivx]+)\.?$"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def display_mark(c: Column) -> Column:
    """One blank between words, none around the slash, `` - `` before a part number."""
    s = F.regexp_replace(squeeze(c), r"\s*/\s*", "/")
    s = F.regexp_replace(s, r"[/ ]+$", "")
    return F.regexp_replace(s, r"\s*-\s*([IVX]+\.?)$", " - $1")


def mark_key(c: Column) -> Column:
    """struct(key, part): comparison key without accents, case and blanks, and the part number."""
    s = F.lower(strip_accents(display_mark(c)))
    return F.struct(
        F.regexp_replace(F.regexp_replace(s, _PART, ""), r"\s+", "").alias("key"),
        F.upper(F.regexp_extract(s, _PART, 1)).alias("part"))


def mark_parts(c: Column) -> Column:
    """struct(senate INT, register): NULL senate and blank register when the mark does not parse."""
    s = display_mark(c)
    return F.struct(
        F.regexp_extract(s, DECISION_MARK, 1).try_cast("int").alias("senate"),
        F.regexp_extract(s, DECISION_MARK, 2).alias("register"))


def docket_number(c: Column) -> Column:
    """Docket form of the administrative court: ``21 Afs 31/2026-32``."""
    return F.regexp_replace(F.regexp_replace(squeeze(c), r"\s*/\s*", "/"), r"\s*-\s*(\d+)$", "-$1")


def constitutional_mark(link_text: Column, citation: Column) -> Column:
    """Mark from the citation when it has one, else from the link text without its ``#n``."""
    cited = F.regexp_extract(_text(citation), r"sp\.\s*zn\.\s*(.+?)\s+ze dne", 1)
    s = F.when(cited != "", cited).otherwise(F.regexp_replace(_text(link_text), r"\s*#\d+\s*$", ""))
    return F.trim(F.regexp_replace(squeeze(s), r"(?U)\.\s*ÚS\b", ". ÚS"))


def register_name(c: Column) -> Column:
    """Upper-case first letter, the rest untouched (``ECm`` must not become ``Ecm``)."""
    s = F.trim(_text(c))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20))


def senate_key(number: Column, register: Column) -> Column:
    return F.concat_ws(" ", number.cast("int").cast("string"), register_name(register))


def roster_mark(c: Column) -> Column:
    """Typed parts of the first roster mark found in the text, NULL when there is none."""
    part = [F.regexp_extract(c, ROSTER_MARK, i) for i in range(1, 5)]
    senate, number, year = part[0].try_cast("int"), part[2].try_cast("int"), part[3].try_cast("int")
    register = register_name(part[1])
    return F.when(c.rlike(ROSTER_MARK), F.struct(
        F.concat(senate, F.lit(" "), register, F.lit(" "), number, F.lit("/"), part[3]).alias("mark"),
        senate.alias("senate_no"), register.alias("register"), number.alias("number"), year.alias("year"),
        senate_key(senate, register).alias("senate")))


def typed_mark(c: Column) -> Column:
    """Mark typed by a reader (``9  c 10 / 2024`` -> ``9 C 10/2024``); NULL when it is not one."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s*/\s*", "/"), r"\s+", " ")
    shape = r"^(\d+)\s*([A-Za-z]+)\s+(\d+)/(\d{4})$"
    part = [F.regexp_extract(s, shape, i) for i in range(1, 5)]
    return F.when(s.rlike(shape), F.concat(
        part[0].try_cast("int"), F.lit(" "), F.upper(F.substring(part[1], 1, 1)),
        F.lower(F.substring(part[1], 2, 1 << 20)), F.lit(" "), part[2].try_cast("int"), F.lit("/"), part[3]))


def eu_case(work_id: Column) -> Column:
    """Work id ``62025CJ0151`` -> case ``C-151/25``; blank when it is not a case."""
    part = [F.regexp_extract(_text(work_id), EU_WORK, i) for i in range(1, 4)]
    return F.when(part[0] == "", F.lit("")).otherwise(F.concat(
        part[1], F.lit("-"), part[2].try_cast("int"), F.lit("/"), F.substring(part[0], 3, 2)))


def eu_notice(case: Column) -> Column:
    """Case ``C-1009/26`` -> notice ``62026CN1009``; blank otherwise."""
    s = F.trim(_text(case))
    number, year = (F.regexp_extract(s, EU_CASE, i) for i in (1, 2))
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0"))
    return F.when(number == "", F.lit("")).otherwise(F.concat(F.lit("620"), year, F.lit("CN"), padded))


def case_link(org: Column, senate_no: Column, register: Column, number: Column, year: Column) -> Column:
    """Deep link to the public case register."""
    return F.concat(
        F.lit("https://infosoud.gov.cz/InfoSoud/detail-rizeni?typOrganizace=VSECHNY_KRAJE&druhOrganizace="),
        _text(org), F.lit("&cisloSenatu="), senate_no, F.lit("&druhVeci="), F.lower(register),
        F.lit("&bcVec="), number, F.lit("&rocnik="), year)
