"""Monthly digest: selecting and numbering its input, reading the answer, resolving citations."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from listwatch.functions.dates import in_period
from listwatch.functions.legal import without_legal_forms
from listwatch.functions.text import missing, squeeze
from listwatch.operators.classify import OBVIOUS_PARTY
from listwatch.operators.staging import where_computed

MAX_ITEMS, MAX_SOURCES = 300, 6
FORMAT_VERSION = "5"
PENDING = ("pripravuje", "ceka_na_text")


def pick_decisions(items: DataFrame, areas: list[str], start: Column, end: Column) -> DataFrame:
    """Decisions of the month with a flag ``picked`` and ``pending`` for those still without areas.

    A record waiting for enrichment is picked when its name makes the subject obvious.
    """
    wanted = F.coalesce(F.arrays_overlap("areas", F.array(*[F.lit(a) for a in areas])), F.lit(False))
    waiting = ~wanted & (F.size("areas") == 0) & F.coalesce(F.col("status").isin(*PENDING), F.lit(False))
    obvious = F.coalesce(F.col("name"), F.lit("")).rlike(OBVIOUS_PARTY)
    return items.where(in_period(F.col("first_seen"), start, end)).withColumns(
        {"picked": wanted | (waiting & obvious), "pending": waiting & ~obvious})


def digest_items(decisions: DataFrame, articles: DataFrame, order: list[Column], cap: int = MAX_ITEMS) -> DataFrame:
    """Candidates of both products numbered newest first; at most ``cap`` rows."""
    both = decisions.unionByName(articles, allowMissingColumns=True).orderBy(*order).limit(cap)
    return both.withColumn("number", F.row_number().over(W.orderBy(*order)).cast("bigint"))


def prompt_line(label: Column, tag: Column, day: Column, title: Column, heading: Column, summary: Column,
                number: Column) -> Column:
    head = F.concat(
        number.cast("string"), F.lit(". ["), label,
        F.when(~missing(tag) & (tag != label), F.concat(F.lit(" / "), tag)).otherwise(""),
        F.when(day.isNotNull(), F.concat(F.lit(", "), F.date_format(day, "dd.MM.yyyy"))).otherwise(""),
        F.lit("] "), title,
        F.when(~missing(heading), F.concat(F.lit(" — heslo: "), heading)).otherwise(""))
    return F.concat(head, F.when(~missing(summary), F.concat(F.lit("\n   "), summary)).otherwise(""))


def prompt_input(numbered: DataFrame, line: Column, cap: int = MAX_ITEMS) -> DataFrame:
    """One row with the whole numbered list; its length is bounded by the digest cap."""
    pairs = numbered.where(F.col("number") <= cap).agg(F.array_sort(F.collect_list(F.struct("number", line.alias("l")))).alias("p"))
    return pairs.select(F.array_join(F.transform("p", lambda x: x["l"]), "\n").alias("input"))


def input_fingerprint(numbered: DataFrame, guid: str, summary: str, cap: int = MAX_ITEMS) -> DataFrame:
    """Ordered, versioned hash of the digest input; bounded by the digest cap."""
    line = F.concat(F.col(guid), F.lit("|"), F.col(summary), F.lit("\n"))
    pairs = numbered.where(F.col("number") <= cap).agg(F.array_sort(F.collect_list(F.struct("number", line.alias("l")))).alias("p"))
    text = F.concat(F.lit(f"v{FORMAT_VERSION}\n"), F.array_join(F.transform("p", lambda x: x["l"]), ""))
    return pairs.select(F.sha2(text, 256).alias("fingerprint"))


def _plain(c: Column) -> Column:
    s = F.regexp_replace(c, r"\*\*|__|`", "")
    return F.regexp_replace(s, r"(?m)^[ \t]*[-*#>]+[ \t]*", "")


def _clean(c: Column) -> Column:
    return without_legal_forms(squeeze(c))


_SOURCES = r"(?:^|(?<=\s))Z(?i:DROJ)\w*\s*:"


def parse_answers(answers: DataFrame, key: str, raw: str) -> DataFrame:
    """One row per block of each answer: position, title, text, cited numbers; block 0 is the intro."""
    chunks = F.split(F.concat(F.lit("\n"), _plain(F.col(raw))), r"\n\s*T[ÉE]MA\s*:\s*")
    rows = answers.select(key, F.posexplode(chunks).alias("block", "chunk"))
    intro_mark = r"(?is)P[ŘR]EHLED\s*:\s*(.*)"
    chunk = F.col("chunk")
    intro = F.when(chunk.rlike(intro_mark), F.regexp_extract(chunk, intro_mark, 1)).otherwise(chunk)
    rest = F.when(chunk.contains("\n"), F.regexp_replace(chunk, r"(?s)^[^\n]*\n", "")).otherwise("")
    text_mark = r"(?s)(?i:TEXT)\s*:\s*(.*?)(?=\s*(?U:" + _SOURCES + r")|$)"
    body = F.when(rest.rlike(text_mark), F.regexp_extract(rest, text_mark, 1)).otherwise(rest)
    cited = F.regexp_extract(rest, r"(?mU)" + _SOURCES + r"\s*(.*)", 1)
    numbers = F.transform(F.regexp_extract_all(cited, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.try_cast("int"))
    first = F.col("block") == 0
    parsed = rows.select(
        key, "block", F.when(first, "").otherwise(_clean(F.substring_index(chunk, "\n", 1))).alias("title"),
        F.when(first, _clean(intro)).otherwise(_clean(body)).alias("text"),
        F.when(~first, F.array_distinct(F.array_compact(numbers))).alias("numbers"))
    return where_computed(parsed, (F.col("block") == 0) | ((F.col("title") != "") & (F.col("text") != "")))


def resolve_citations(blocks: DataFrame, items: DataFrame, key: list[str], total: Column, carried: list[str],
                      cap: int = MAX_SOURCES) -> DataFrame:
    """Cited numbers as items: in range, distinct, in order, at most ``cap`` per block."""
    valid = F.slice(F.filter("numbers", lambda n: (n >= 1) & (n <= total)), 1, cap)
    cited = blocks.select(*key, F.posexplode(valid).alias("position", "number"))
    return cited.join(items.select(F.col("number").cast("int").alias("number"), *carried), "number")


def covered(cited: DataFrame, key: list[str], title: str) -> DataFrame:
    """How many different titles the sections cite, per digest."""
    return cited.groupBy(*key).agg(F.countDistinct(title).alias("covered"))
