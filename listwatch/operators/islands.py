"""Records made of consecutive lines: start markers, continuations, gaps."""

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.names import CONTINUATION
from listwatch.operators.scan import previous_within, running_sum_within

WRAP_GAP = 16


def number_records(lines: DataFrame, document: list[str], order: list[Column], starts: Column, out: str = "record") -> DataFrame:
    """Record number of every line: a start marker opens a record; 0 precedes the first one."""
    one = F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0).cast("bigint")
    return running_sum_within(lines, document, order, one, out)


def join_lines(lines: DataFrame, record: list[str], position: str, text: str, separator: str = "\n") -> DataFrame:
    """Text of each record, its lines in order.  A record is one published entry, a handful of lines."""
    return lines.groupBy(*record).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda s: s[text]),
                     separator).alias(text), F.count(F.lit(1)).alias("lines"))


def continues_previous(line: Column) -> Column:
    """A line that goes on with the previous name: lower case, connective, or only titles and forms."""
    return line.rlike(r"^[\p{Ll}&\-]") | line.rlike(CONTINUATION)


def merge_continued(lines: DataFrame, document: list[str], position: str, text: str) -> DataFrame:
    """Continuation lines joined to the line they continue."""
    numbered = number_records(lines, document, [F.col(position)], ~continues_previous(F.col(text)), "record")
    return join_lines(numbered, [*document, "record"], position, text, " ")


def wrapped_lines(pieces: DataFrame, page: list[str], y: str, gap: float = WRAP_GAP) -> DataFrame:
    """Name number of positioned text: a line less than ``gap`` below the previous one continues it.

    ``y`` grows upwards; equal heights belong to the same printed line.
    """
    above = previous_within(pieces, page, [F.col(y).desc()], F.col(y), "_above")
    fresh = F.col("_above").isNull() | (F.col("_above") - F.col(y) >= gap)
    return running_sum_within(above, page, [F.col(y).desc()], F.when(fresh, 1).otherwise(0).cast("bigint"),
                              "name_no").drop("_above")


def unsorted_rows(rows: DataFrame, file: list[str], position: str, key: str) -> DataFrame:
    """Rows whose key does not follow that of the row before them, found by an equi-join on position."""
    before = rows.select(*file, (F.col(position) + 1).alias(position), F.col(key).alias("_before"))
    return rows.join(before, [*file, position]).where(F.col(key) <= F.col("_before")).drop("_before")
