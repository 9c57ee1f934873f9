"""Enrichment requests and answers as tables."""

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.legal import clean_heading, fix_ki_ending, generic_heading, strip_outcome, trim_marks, without_legal_forms
from listwatch.functions.loose import as_text, embedded_array, embedded_object, yes_no
from listwatch.functions.text import empty_array, first_text, missing, mixed_script, squeeze, strip_space
from listwatch.operators.staging import where_computed

MIN_SUMMARY = 40
# Names of courts, labels of the request header, default areas.
COURT_NAMES = {"ns": "Nejvyšší soud", "nss": "Nejvyšší správní soud", "us": "Ústavní soud", "sdeu": "Soudní dvůr EU"}
DEFAULT_AREA = {"nss": "spravni", "us": "ustavni", "sdeu": "spravni"}
OPINION_REGISTERS = ("cpjn", "tpjn", "plsn")


def _lookup(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def instruction_kind(court: Column, kind: Column, register: Column) -> Column:
    """Which instruction a record gets."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    opinion = k.contains("stanovisko")
    return (F.when((court == "sdeu") & opinion, "stanovisko")
            .when((court == "sdeu") & k.rlike("otázk|otazk"), "otazka").when(court == "sdeu", "sdeu")
            .when(court == "us", "us")
            .when((court == "ns") & (opinion | F.lower(F.coalesce(register, F.lit(""))).isin(*OPINION_REGISTERS)), "stanovisko_ns")
            .otherwise("obecny"))


def request_header(court: Column, kind: Column, mark: Column, name: Column, day: Column, hints: Column,
                   instruction: Column) -> Column:
    """Header lines of a request; ``hints`` is an ordered array of ``key: value`` texts."""
    def line(label, value):
        return F.when(~missing(value), F.concat(F.lit(label + ": "), value))
    hint_text = F.array_join(F.filter(hints, lambda h: ~missing(h)), " | ")
    return F.concat_ws(
        "\n", F.concat(F.lit("Soud: "), F.coalesce(_lookup(COURT_NAMES, court), court)), line("Druh", kind),
        line("Spisová značka", mark), line("Název věci", name), line("Datum rozhodnutí", day),
        line("Úřední údaje (vodítko, nemusí být úplné)", hint_text), line("Pokyn ke shrnutí", instruction))


def request(header: Column, text: Column) -> Column:
    return F.when(strip_space(text) != "", F.concat(header, F.lit("\n\n--- TEXT ---\n"), strip_space(text)))


_TAGS = r"HESLO|SHRNUT[IÍ]|OBLASTI|PROCESN[IÍ]"


def _tagged(raw: Column, tag: str) -> Column:
    return F.regexp_extract(raw, rf"(?iusU){tag}\s*:\s*(.*?)\s*(?=(?:{_TAGS})\s*:|$)", 1)


def parse_answers(answers: DataFrame, raw: str) -> DataFrame:
    """Answers with heading, summary, area_tokens and procedural; unusable ones are dropped.

    An answer is JSON or tagged text.  It is unusable without a summary of 40 characters or with
    words of mixed script.  Every step is a column of its own, so no text is parsed twice.
    """
    kept = [F.col(c) for c in answers.columns]
    text = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"\*\*|__", "")
    d = answers.withColumn("_text", text).withColumn("_data", embedded_object(F.col("_text")))
    names = {"_h": "heslo", "_s": "shrnuti", "_s2": "shrnutí", "_o": "oblasti", "_p": "procesni", "_p2": "procesní"}
    d = d.withColumns({k: F.try_variant_get("_data", f"$.{n}", "variant") for k, n in names.items()})
    t, is_json = F.col("_text"), F.col("_data").isNotNull()
    listed = F.schema_of_variant("_o").startswith("ARRAY")
    d = d.select(
        *kept,
        F.when(is_json, as_text(F.col("_h"))).otherwise(_tagged(t, "HESLO")).alias("_heading"),
        F.when(~is_json, _tagged(t, "SHRNUT[IÍ]")).otherwise(first_text(as_text(F.col("_s")), as_text(F.col("_s2")))).alias("_summary"),
        F.when(~is_json, F.split(_tagged(t, "OBLASTI"), r"[,;\n]+")).when(listed, F.try_variant_get("_o", "$", "array<string>"))
        .otherwise(F.split(as_text(F.col("_o")), r"[,;\n]+")).alias("_tokens"),
        F.when(~is_json, _tagged(t, "PROCESN[IÍ]")).otherwise(F.coalesce(
            F.try_variant_get("_p", "$", "boolean").cast("string"), first_text(as_text(F.col("_p")), as_text(F.col("_p2"))))).alias("_flag"))
    d = d.select(
        *kept, fix_ki_ending(without_legal_forms(trim_marks(F.col("_heading")))).alias("_heading"),
        fix_ki_ending(without_legal_forms(trim_marks(F.col("_summary")))).alias("summary"), "_tokens", "_flag")
    d = where_computed(d, (F.length("summary") >= MIN_SUMMARY) & ~mixed_script(F.col("summary")))
    return d.select(
        *kept, strip_outcome(F.col("_heading")).alias("heading"), "summary",
        F.filter(F.transform("_tokens", trim_marks), lambda x: x != "").alias("area_tokens"), yes_no(F.col("_flag")).alias("procedural"))


def parse_tagged_summary(raw: Column) -> Column:
    """struct(heading, summary) of a ``HESLO`` / ``SHRNUTÍ`` answer; without tags all is summary."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\*\*|__", "")
    heading_mark = r"(?ius)HESLO:\s*(.*?)\s*(?=SHRNUT[IÍ]:|$)"
    summary_mark = r"(?ius)SHRNUT[IÍ]:\s*(.*)"
    has_heading, has_summary = text.rlike(heading_mark), text.rlike(summary_mark)
    heading = F.regexp_replace(squeeze(F.regexp_extract(text, heading_mark, 1)), r"\.+$", "")
    summary = F.when(has_summary, F.regexp_extract(text, summary_mark, 1)).when(has_heading, "").otherwise(text)
    return F.struct(fix_ki_ending(heading).alias("heading"), fix_ki_ending(squeeze(summary)).alias("summary"))


def fallback_areas(answered: Column, meta: Column, court: Column, register: Column) -> Column:
    """Areas of the answer, else of the metadata, else the usual area of the court."""
    usual = F.when(court == "ns", F.when(register.startswith("T"), "trestni").otherwise("civilni_proces")).otherwise(
        F.coalesce(_lookup(DEFAULT_AREA, court), F.lit("spravni")))
    return F.when(~empty_array(answered), answered).when(~empty_array(meta), meta).otherwise(F.array(usual))


def batch_answers(answers: DataFrame, batch: str, raw: str) -> DataFrame:
    """(batch, id, value) from answers that map ids to values; an unreadable answer yields nothing."""
    entries = F.from_json(F.regexp_extract(F.col(raw), r"(?s)(\{.*\})", 1), "map<string,string>")
    return answers.select(batch, F.explode(entries).alias("id", "value"))


def accept_headings(asked: DataFrame, answered: DataFrame, batch: str) -> DataFrame:
    """Asked ids with their new heading; unknown ids are dropped, unacceptable headings stay open."""
    offered = answered.select(batch, "id", clean_heading(F.col("value")).alias("_h"))
    good = offered.where(~generic_heading(F.col("_h")))
    return asked.join(good, [batch, "id"], "left").withColumnRenamed("_h", "new_heading")


def accept_areas(asked: DataFrame, answered: DataFrame, batch: str, known: Column) -> DataFrame:
    """Asked ids with the known areas of their answer, in its order; null, to be asked again, without an answer.

    An answer that is no list counts as one without areas.  Ids that were not asked are dropped.
    """
    listed = F.filter(F.array_distinct(F.from_json("value", "array<string>")), lambda area: F.array_contains(known, area))
    offered = answered.select(batch, "id", F.coalesce(listed, F.array().cast("array<string>")).alias("areas")).dropDuplicates([batch, "id"])
    return asked.join(offered, [batch, "id"], "left")


def judged_people(asked: DataFrame, answers: DataFrame, batch: str, raw: str) -> DataFrame:
    """Asked names as ``person`` when the answer of their batch lists them, else ``other``; ``open`` without a readable answer.

    answers has one row per batch; a batch is one request, which bounds the list.
    """
    listed = answers.select(batch, F.try_variant_get(embedded_array(F.col(raw)), "$", "array<string>").alias("_listed"))
    verdict = (F.when(F.col("_listed").isNull(), "open").when(F.array_contains("_listed", F.col("name")), "person").otherwise("other"))
    return asked.join(listed, batch, "left").withColumn("verdict", verdict).drop("_listed")


def extracted_rows(answers: DataFrame, key: str, raw: str, schema: str) -> DataFrame:
    """Rows from answers that hold an array of objects; malformed answers and objects give NULL fields."""
    rows = F.from_json(F.regexp_extract(F.col(raw), r"(?s)(\[.*\])", 1), f"array<struct<{schema}>>")
    return answers.select(key, F.inline(rows))


def apply_answer(heading: Column, manual: Column, old_heading: Column, version: int) -> Column:
    """struct(heading, manual, version, failures, text_waits): a hand-written heading survives."""
    kept = F.coalesce(manual, F.lit(False))
    final = F.when(kept, old_heading).otherwise(heading)
    current = kept | ~generic_heading(heading)
    return F.struct(final.alias("heading"), kept.alias("manual"), F.when(current, version).otherwise(0).alias("version"),
                    F.lit(0).alias("failures"), F.lit(0).alias("text_waits"))
