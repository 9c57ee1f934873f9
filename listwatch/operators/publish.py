"""Projections from stored records to what readers get."""

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.dates import czech_day
from listwatch.functions.legal import without_legal_forms
from listwatch.functions.text import empty_array, first_text, missing
from listwatch.operators.state import MAX_ATTEMPTS, NO_TEXT, attempts_spent

# Codes and sentences shown while there is no summary.
STATUS_TEXT = {
    "pripravuje": "Shrnutí se připravuje.",
    "ceka_na_text": "Čeká na zveřejnění textu rozhodnutí.",
    "nepodarilo": "Shrnutí se nepodařilo připravit.",
}
WAITING_FOR_QUESTIONS = "Položené otázky zatím nejsou zveřejněné."
QUESTION = "předběžná otázka"


def conform(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Every column of the schema, absent or NULL ones taking their default, extra ones dropped."""
    return df.select(*[(F.coalesce(F.col(c), d) if c in df.columns else d).alias(c) for c, d in defaults.items()])


def summary_status(reason: Column, failures: Column, text_waits: Column) -> Column:
    return (F.when(F.coalesce(reason == NO_TEXT, F.lit(False)), "ceka_na_text")
            .when(attempts_spent(failures, text_waits, reason) >= MAX_ATTEMPTS, "nepodarilo").otherwise("pripravuje"))


def status_note(status: Column, kind: Column, filed: Column) -> Column:
    """Sentence for a record without a summary; questions mention their filing date."""
    texts = F.create_map(*[F.lit(x) for kv in STATUS_TEXT.items() for x in kv])
    question = F.coalesce(kind == QUESTION, F.lit(False))
    note = F.when(question & (status == "ceka_na_text"), WAITING_FOR_QUESTIONS).otherwise(F.try_element_at(texts, status))
    return F.when(question & filed.isNotNull(), F.concat(F.lit("Podáno "), czech_day(filed), F.lit(". "), note)).otherwise(note)


def slim(heading: Column, summary: Column, ai_areas: Column, meta_areas: Column, ai_procedural: Column,
         meta_procedural: Column) -> list[Column]:
    """Published heading, summary, areas and procedural flag: enriched values, else metadata."""
    nothing = F.array().cast("array<string>")
    return [
        F.regexp_replace(without_legal_forms(heading), r"\.+$", "").alias("heading"),
        without_legal_forms(summary).alias("summary"),
        F.when(~empty_array(ai_areas), ai_areas).otherwise(F.coalesce(meta_areas, nothing)).alias("areas"),
        F.coalesce(ai_procedural, meta_procedural, F.lit(False)).alias("procedural")]


def journal_row(title: Column, summary: Column, note: Column, description: Column) -> dict[str, Column]:
    """Journal code split off the title; note and description only where there is no summary."""
    prefix = r"^\[([^\]]+)\]\s*"
    bare = missing(summary)
    return {"abbreviation": F.regexp_extract(title, prefix, 1), "title": F.regexp_replace(title, prefix, ""),
            "note": F.when(bare, first_text(note)).otherwise(""),
            "description": F.when(bare, first_text(description)).otherwise("")}


def in_registry(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Journal rows with the id of their journal, blank for an abbreviation that no journal has or had.

    registry(journal, abbreviation, former) has one row per journal; ``former`` lists abbreviations it had earlier, and an
    abbreviation in use has precedence over a former one.
    """
    names = registry.select("journal", F.col("abbreviation"), F.lit(0).alias("rank")).unionByName(
        registry.select("journal", F.explode("former").alias("abbreviation"), F.lit(1).alias("rank")))
    names = names.groupBy("abbreviation").agg(F.min(F.struct("rank", "journal"))["journal"].alias("journal"))
    return rows.join(names, "abbreviation", "left").fillna("", ["journal"])


def shown_judge(judge: Column, meta: Column) -> Column:
    """Judge of the record, else the one its metadata names."""
    return first_text(judge, F.try_element_at(meta, F.lit("judge")))


def recent_referrals(rows: DataFrame, lodged: str, today: Column) -> DataFrame:
    """Referrals lodged since the first day of the month before ``today``; undated ones are left out."""
    return rows.where(F.col(lodged).cast("date") >= F.add_months(F.trunc(today, "MM"), -1))


def reader_rows(decisions: DataFrame, articles: DataFrame) -> DataFrame:
    """Both products in one shape; the shown date falls back to the first-seen one."""
    d = decisions.select(
        "id", first_text(F.col("mark"), F.col("name")).alias("title"),
        F.when(~missing(F.col("mark")), first_text(F.col("name"))).otherwise("").alias("subject"),
        F.coalesce("published", "decided", F.col("first_seen").cast("date")).alias("shown"), "first_seen",
        F.lit("decision").alias("product"))
    a = articles.select(
        "id", first_text(F.col("name")).alias("title"),
        F.coalesce("published", F.col("first_seen").cast("date")).alias("shown"), "first_seen",
        F.lit("article").alias("product"))
    return d.unionByName(a, allowMissingColumns=True).fillna("", ["subject"])


def late_release(published: Column, decided: Column, days: int = 90) -> Column:
    """struct(published, original): a document released long after its date counts from its date."""
    late = F.datediff(published, decided) > days
    return F.struct(F.when(late, decided).otherwise(published).alias("published"),
                    F.when(late, published).alias("original"))


def drop_blank(row: Column) -> Column:
    """Published JSON of a row; NULL fields are left out."""
    return F.to_json(row)
