"""Shortening the names of natural persons; unknown names are never published."""

from pyspark.sql import DataFrame, functions as F

from listwatch.functions.events import person_hash
from listwatch.functions.names import initials, party_label


def verdict_of(names: DataFrame, name: str, persons: DataFrame, companies: DataFrame, salt: str = "person") -> DataFrame:
    """Verdict per distinct name: person (by hash), company (by name), or NULL.

    ``persons(hash)`` and ``companies(name)`` hold valid cache entries only.
    """
    known = names.select(name).distinct().withColumn("_h", person_hash(F.col(name), salt))
    known = known.join(persons.select(F.col("hash").alias("_h")).distinct().withColumn("_p", F.lit(True)), "_h", "left")
    known = known.join(companies.select(F.col("name").alias(name)).distinct().withColumn("_c", F.lit(True)), name, "left")
    return known.select(name, F.when(F.col("_p"), "person").when(F.col("_c"), "company").alias("verdict"))


def redact(rows: DataFrame, key: str, persons: DataFrame, companies: DataFrame, is_new: str = "is_new",
           salt: str = "person") -> DataFrame:
    """Parties with persons reduced to initials and the case label built from the shown names.

    A new row with any undecided name loses all parties and its title.  The parties of a row are
    regrouped in their order; a row has as many as one published entry lists.
    """
    listed = rows.select(key, F.posexplode("parties").alias("pos", "name"))
    shortable = listed.where(initials(F.col("name")) != F.col("name"))
    verdicts = verdict_of(shortable, "name", persons, companies, salt)
    judged = (listed.join(verdicts.withColumn("_asked", F.lit(True)), "name", "left")
              .withColumn("_unknown", F.col("_asked").isNotNull() & F.col("verdict").isNull())
              .withColumn("_shown", F.when(F.col("verdict") == "person", initials(F.col("name"))).otherwise(F.col("name"))))
    by_row = judged.groupBy(key).agg(
        F.bool_or("_unknown").alias("_unknown"), F.bool_or(F.col("_shown") != F.col("name")).alias("_touched"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "_shown"))), lambda s: s["_shown"]).alias("_shown"))
    # The label reads the original parties, so it is computed before that name is reused.
    joined = rows.join(by_row, key, "left").withColumn("_label", party_label(F.col("parties"), F.col("_shown")))
    hide = F.col(is_new) & F.coalesce("_unknown", F.lit(False))
    touched = F.coalesce("_touched", F.lit(False))
    nobody = F.array().cast("array<string>")
    return joined.select(
        *[c for c in rows.columns if c not in ("parties", "title")],
        F.when(hide, nobody).when(touched, F.col("_shown")).otherwise(F.col("parties")).alias("parties"),
        F.when(hide, "").when(touched, F.col("_label")).otherwise(F.col("title")).alias("title"),
        hide.alias("suppressed"))


def new_verdicts(asked: DataFrame, answered_persons: DataFrame, decided: DataFrame, salt: str = "person") -> DataFrame:
    """Cache entries from a round of answers: persons as hashes only, companies by name.

    Names returned that were not asked about are dropped; undecided names are not stored.
    """
    known = asked.select("name").distinct().join(decided.select("name").distinct(), "name", "left_semi")
    flagged = known.join(answered_persons.select("name").distinct().withColumn("_p", F.lit(True)), "name", "left")
    is_person = F.coalesce("_p", F.lit(False))
    return flagged.select(F.when(is_person, person_hash(F.col("name"), salt)).otherwise(F.col("name")).alias("key"),
                          F.when(is_person, "person").otherwise("company").alias("verdict"))
