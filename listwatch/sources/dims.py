"""Dimension files: taxonomy, rule maps, court and registry tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

AREA = "struct<id:string,nazev:string,skupina:string,popis:string,vychozi:boolean>"
TAXONOMY = f"verze int, oblasti array<{AREA}>, alias map<string,string>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON document with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(areas, aliases) of a taxonomy file."""
    doc = read_json(spark, path, TAXONOMY)
    areas = doc.select(F.posexplode("oblasti").alias("ord", "a")).select(
        "ord", F.col("a.id").alias("id"), F.col("a.nazev").alias("name"), F.col("a.skupina").alias("group"),
        F.col("a.popis").alias("description"), F.coalesce("a.vychozi", F.lit(False)).alias("is_default"))
    return areas, doc.select(F.explode("alias").alias("old", "new"))


def read_rules(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(key, ord, areas) of one ordered rule map of a file."""
    raw = spark.read.text(path, wholetext=True)
    table = F.from_json(F.get_json_object("value", f"$.{name}"), "map<string,array<string>>")
    # Map entries keep the order of the document.
    return raw.select(F.posexplode(F.map_entries(table)).alias("ord", "e")).select(
        F.col("e.key").alias("key"), "ord", F.col("e.value").alias("areas"))


def tracked(courts: DataFrame) -> DataFrame:
    """Tracked senates, judges and line-ups per court, display-only line-ups appended."""
    none = F.array().cast("array<string>")
    return courts.select(
        "court", F.coalesce("senates", none).alias("senates"), F.coalesce("judges", none).alias("judges"),
        F.concat(F.coalesce("line_ups", none), F.coalesce("shown_only", none)).alias("line_ups"), "validity", "schedule_url")
