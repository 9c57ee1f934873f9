"""Hearing rosters: text lines and word-processor tables to hearing rows."""

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.dates import CZECH_DATE, czech_date
from listwatch.functions.marks import ROSTER_MARK, roster_mark
from listwatch.functions.names import merge_continuations, party_label
from listwatch.functions.text import squeeze, strip_space
from listwatch.operators.islands import join_lines, number_records
from listwatch.operators.staging import where_computed

# Header and footer lines of the roster.
SKIP_LINE = (r"(?U)^(Datum\b|síň\b|Údaje jsou platné|Stav není|Aktuální stav|Přehled$|"
             r"zasedání senátů|Jednací\b|Předseda senátu\b|\d+\s*$)")
RECORD = (r"(?s)^(\d{2}\.\d{2}\.\d{4})\s+(\S+)\s+(.*?)\s*"
          r"(\d+\s*[A-Za-z]+\s+\d+\s*/\s*\d{4})\s+(\d{1,2}:\d{2})\s*(.*)$")
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def hearings(rows: DataFrame, keep: list[str], day: Column, room: Column, chair: Column, mark: Column, clock: Column,
             parties: Column) -> DataFrame:
    """Typed hearings from raw fields; rows without a readable mark or date are dropped."""
    none = F.array().cast("array<string>")
    typed = rows.select(
        *keep, roster_mark(mark).alias("_mark"), czech_date(day).alias("day"), F.coalesce(clock, F.lit("")).alias("clock"),
        F.coalesce(room, F.lit("")).alias("room"), squeeze(chair).alias("chair"), F.coalesce(parties, none).alias("_parties"))
    typed = where_computed(typed, F.col("_mark").isNotNull() & F.col("day").isNotNull()).withColumn(
        "parties", merge_continuations(F.col("_parties")))
    return typed.select(
        *keep, "day", "clock", "room", "chair", "_mark.mark", party_label(F.col("parties")).alias("title"), "_mark.senate",
        "_mark.register", "_mark.senate_no", "_mark.number", "_mark.year", "parties")


def roster_hearings(lines: DataFrame, document: str, position: str, text: str) -> DataFrame:
    """Hearings of line-based rosters: a record starts at a date line and takes the lines after it."""
    kept = lines.select(document, position, strip_space(F.col(text)).alias("line"))
    kept = kept.where((F.col("line") != "") & ~F.col("line").rlike(SKIP_LINE))
    numbered = number_records(kept, [document], [F.col(position)], F.col("line").rlike("^" + CZECH_DATE), "record")
    records = join_lines(numbered.where(F.col("record") > 0), [document, "record"], position, "line")
    part = [F.regexp_extract("line", RECORD, i).alias(f"_p{i}") for i in range(1, 7)]
    split = records.where(F.col("line").rlike(RECORD)).select(document, *part)
    return hearings(split, [document], *[F.col(f"_p{i}") for i in (1, 2, 3, 4, 5)], F.split("_p6", "\n"))


def expected_rows(lines: DataFrame, document: str, text: str, period: Column) -> DataFrame:
    """Hearings a document should hold: its dates less the two of a stated period."""
    dates = F.sum(F.regexp_count(F.col(text), F.lit(CZECH_DATE)))
    stated = F.max(F.when(period.isNotNull(), 2).otherwise(0))
    return lines.groupBy(document).agg(F.greatest(dates - stated, F.lit(0)).alias("expected"))


FILES_AT_ONCE = 256
ROWS = "document string, table_no int, row_no int, cells array<array<string>>"
ROW_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.string())))
TABLE, ROW, CELL, PARAGRAPH, TEXT = (WORD_NS + n for n in ("tbl", "tr", "tc", "p", "t"))


def _rows_of(content: bytes) -> Iterator[tuple[int, int, list[list[str]]]]:
    """(table_no, row_no, paragraphs of each cell) of the rows that have cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ET.fromstring(archive.read("word/document.xml"))
    for t, table in enumerate(root.iter(TABLE)):
        for r, row in enumerate(table.findall(ROW)):
            cells = []
            for cell in row.findall(CELL):
                texts = ["".join([x.text or "" for x in p.iter(TEXT)]).strip() for p in cell.iter(PARAGRAPH)]
                cells.append([x for x in texts if x])
            if cells:
                yield t, r, cells


def document_cells(files: DataFrame, document: str = "path", content: str = "content") -> DataFrame:
    """(document, table_no, row_no, cells): the paragraphs of each cell, a row per table row of word-processor files.

    One file at a time inside the task that read it.
    """
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FILES_AT_ONCE):
                part = batch.slice(start, FILES_AT_ONCE)
                found = [(name, *row) for name, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for row in _rows_of(data)]
                columns = zip(*found) if found else [()] * len(ROW_TYPES)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, ROW_TYPES)],
                                                 ["document", "table_no", "row_no", "cells"])

    return files.select(F.col(document).alias("document"), F.col(content).alias("content")).mapInArrow(unpack, ROWS)


def _cells(value) -> Column:
    """Aggregate of a table row: its cells as entries (cell_no, ``value`` of the paragraphs)."""
    entries = F.transform("cells", lambda c, i: F.struct(i.alias("cell_no"), value(c).alias("v")))
    return F.flatten(F.collect_list(entries))


def table_hearings(cells: DataFrame) -> DataFrame:
    """Hearings from table rows: date, room, chair, mark, clock, parties."""
    row = cells.groupBy("document", "table_no", "row_no").agg(F.map_from_entries(_cells(lambda c: c)).alias("c"))

    def cell(i: int) -> Column:
        return F.trim(F.array_join(F.coalesce(F.try_element_at("c", F.lit(i)), F.array().cast("array<string>")), "\n"))

    listed = row.where(F.size("c") >= 5).select(
        "document", *[cell(i).alias(f"_c{i}") for i in range(5)], F.try_element_at("c", F.lit(5)).alias("_parties_raw"))
    listed = where_computed(listed, F.col("_c0").rlike("^" + CZECH_DATE) & F.col("_c3").rlike(ROSTER_MARK))
    return hearings(listed, ["document"], F.col("_c0"), F.col("_c1"), F.col("_c2"), F.col("_c3"),
                    F.regexp_extract("_c4", r"(\d{1,2}:\d{2})", 1), F.col("_parties_raw"))


def cells_as_text(cells: DataFrame) -> DataFrame:
    """Table text with cells split by `` | `` and paragraphs by ``; ``, one row per table row."""
    texts = _cells(lambda c: F.array_join(c, "; "))
    return cells.groupBy("document", "table_no", "row_no").agg(
        F.array_join(F.transform(F.array_sort(texts), lambda s: s["v"]), " | ").alias("line"))
