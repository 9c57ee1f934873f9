"""Integrity rules over archive, index and published window.

Rules about a row are looked at in one pass over its table, which yields an array of findings per
row.  Rules about an id are looked at in one aggregate over all three tables, keyed by folder and id.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.dates import iso_time, month_key
from listwatch.functions.text import missing
from listwatch.operators.islands import unsorted_rows

ERROR, WARNING = "error", "warning"
FINDING = ("severity", "rule", "key", "detail")
CORRUPT = "_corrupt_record"


def found(when: Column, severity: str, rule: str, key: Column, detail: Column) -> Column:
    """A finding where the condition holds, else null."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), text(key).alias("key"), text(detail).alias("detail")))


def findings(rows: DataFrame, *each: Column, more: Column | None = None) -> DataFrame:
    """All findings of every row; ``more`` is an array of further ones."""
    all_ = F.array(*each) if more is None else F.concat(F.array(*each), more)
    return rows.select(F.explode(F.array_compact(all_)).alias("f")).select(*[F.col(f"f.{c}") for c in FINDING])


def unknown_areas(when: Column, rule: str, key: Column, areas: list[str]) -> Column:
    """A finding per area that is not known."""
    odd = F.filter(F.coalesce("areas", F.array().cast("array<string>")), lambda a: ~a.isin(*areas))
    return F.transform(F.when(when, odd).otherwise(F.array().cast("array<string>")), lambda a: found(F.lit(True), WARNING, rule, key, a))


def read_lines(lines: DataFrame, text: str, schema: str) -> DataFrame:
    """Lines as records beside their own columns; a line that is no record keeps its text in ``_corrupt_record``."""
    record = F.from_json(text, f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.withColumn("_r", record).select(*lines.columns, "_r.*")


def line_findings(lines: DataFrame, place: Column) -> DataFrame:
    """Unreadable lines of the archive's files or the index, by ``read_lines``."""
    return findings(lines, found(F.col(CORRUPT).isNotNull(), ERROR, "unreadable line", place, F.col(CORRUPT)))


def row_findings(archive: DataFrame, window: DataFrame, areas: list[str]) -> list[DataFrame]:
    """archive(id, court, month, line, first_seen text, areas, folder_court), window(folder_court, id, areas, procedural)."""
    key, named, seen = F.col("id"), ~missing(F.col("id")), iso_time(F.col("first_seen"))
    broken = F.col("areas").isNull() | F.col("procedural").isNull()
    return [
        findings(
            archive,
            found(~named, ERROR, "record without id", F.concat_ws(":", "folder_court", "month", "line"), F.lit("")),
            found(named & (F.col("court") != F.col("folder_court")), ERROR, "wrong court", key, F.col("court")),
            found(named & seen.isNull(), ERROR, "unreadable first_seen", key, F.col("first_seen")),
            found(named & (month_key(seen) != F.col("month")), WARNING, "wrong partition", key, F.col("month")),
            more=unknown_areas(named, "unknown area", key, areas)),
        findings(unsorted_rows(archive.where(named), ["folder_court", "month"], "line", "id"),
                 found(F.lit(True), WARNING, "not sorted", key, F.col("month"))),
        findings(
            window,
            found(~named, ERROR, "shown without id", F.col("folder_court"), F.lit("")),
            found(named & broken, ERROR, "shown without areas or flag", key, F.lit("")),
            more=unknown_areas(named & ~broken, "shown with unknown area", key, areas)),
    ]


def id_findings(archive: DataFrame, index: DataFrame, window: DataFrame) -> DataFrame:
    """index(folder_court, id, month); archive also needs ``replaced_by``."""
    none = F.lit(None).cast("string")

    def rows(table: DataFrame, kind: str, month: Column, replaced: Column) -> DataFrame:
        return table.where(~missing(F.col("id"))).select("folder_court", "id", F.lit(kind).alias("kind"), month.alias("month"), replaced.alias("replaced"))

    # Entries of the index count whatever their id.
    tagged = (rows(archive, "archive", F.col("month"), F.col("replaced_by")).unionByName(rows(window, "window", none, none))
              .unionByName(index.select("folder_court", "id", F.lit("index").alias("kind"), "month", none.alias("replaced"))))
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    month = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("month"))).alias(f"{kind}_month")
    ids = tagged.groupBy("folder_court", "id").agg(
        count("archive"), count("index"), count("window"), month("archive"), month("index"), F.max("replaced").alias("replaced"))
    held, listed, shown, key = F.col("archive") > 0, F.col("index") > 0, F.col("window") > 0, F.col("id")
    return findings(
        ids,
        found(F.col("archive") > 1, ERROR, "duplicate id", key, F.col("archive")),
        found(F.col("index") > 1, WARNING, "twice in index", key, F.col("index")),
        found(listed & ~held, WARNING, "in index only", key, F.col("index_month")),
        found(held & ~F.col("archive_month").eqNullSafe(F.col("index_month")), WARNING, "index missing or other month", key, F.col("archive_month")),
        found(F.col("window") > 1, ERROR, "shown twice", key, F.col("window")),
        found(shown & ~held, ERROR, "shown, not archived", key, F.lit("")),
        found(shown & held & ~missing(F.col("replaced")), ERROR, "shown, replaced", key, F.col("replaced")))


def check(archive: DataFrame, index: DataFrame, window: DataFrame, areas: list[str], lines: DataFrame | None = None,
          place: Column | None = None) -> DataFrame:
    """severity, rule, key and detail of everything that does not hold; ``lines`` are those of ``read_lines``."""
    parts = [*row_findings(archive, window, areas), id_findings(archive, index, window)]
    if lines is not None:
        parts.append(line_findings(lines, place))
    return reduce(DataFrame.unionByName, parts)
