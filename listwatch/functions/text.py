"""Text normalisation used by keys, filters and matching."""

import unicodedata

from pyspark.sql import Column, functions as F

SPACE = r"(?U)\s+"


def _accent_table() -> tuple[str, str]:
    """Letters that canonical decomposition turns into one base letter plus marks."""
    source, target = [], []
    for code in range(0xA0, 0x2000):
        letter = chr(code)
        bare = "".join(c for c in unicodedata.normalize("NFD", letter)
                       if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != letter and bare != "\\":
            source.append(letter)
            target.append(bare)
    return "".join(source), "".join(target)


_ACCENTED, _BARE = _accent_table()


def strip_accents(c: Column) -> Column:
    """Drop diacritics; letters without a decomposition (ø, ł, ß) stay as they are."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), _ACCENTED, _BARE)


def fold(c: Column) -> Column:
    """Accent- and case-insensitive comparison form."""
    return F.replace(F.lower(strip_accents(c)), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column) -> Column:
    """Collapse every run of white space to one blank; NULL becomes blank."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; lambdas would otherwise compute it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    """NULL and the empty string are the same kind of missing."""
    return F.when(c != "", c)


def strip_space(c: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\A\s+|\s+\z", "")


def missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def first_text(*cols: Column) -> Column:
    """First value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def empty_array(c: Column) -> Column:
    return c.isNull() | (F.size(c) <= 0)


def words(c: Column) -> Column:
    """Non-empty words of the folded text."""
    return F.filter(F.split(F.lower(strip_accents(c)), r"(?U)[^\w]+"), lambda w: w != "")


def shorten(c: Column, limit: int = 300) -> Column:
    """Cut to ``limit`` characters, the last three being dots."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 3), F.lit("...")))


def describe(title: Column, authors: Column, *lines: Column) -> Column:
    """Title, author line and further lines, blank ones left out."""
    return F.concat_ws(
        "\n", title,
        F.when(~missing(authors), F.concat(F.lit("Autor: "), authors)),
        *[blank_to_null(line) for line in lines])


def distinct_ignoring_case(names: Column) -> Column:
    """First spelling of each name, in order."""
    lowered = F.transform(names, lambda n: F.lower(n))
    return let(lowered, lambda low: F.filter(names, lambda n, i: F.array_position(low, F.lower(n)) == i + 1))


def ordered_union(*arrays: Column, limit: int = 3) -> Column:
    """Union of arrays keeping first occurrences in order, at most ``limit`` of them."""
    empty = F.array().cast("array<string>")
    parts = F.array(*[F.coalesce(a, empty) for a in arrays])
    return F.slice(F.array_distinct(F.flatten(parts)), 1, limit)


# Named character references that occur in listings.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—",
    "hellip": "…", "sect": "§", "laquo": "«", "raquo": "»", "bdquo": "„", "ldquo": "“", "rdquo": "”",
    "lsquo": "‘", "rsquo": "’", "copy": "©", "reg": "®", "deg": "°", "euro": "€", "shy": "­",
}
_NUMERIC = r"&#(x[0-9a-fA-F]{1,6}|[0-9]{1,7});"


def unescape(c: Column) -> Column:
    """Decode named and numeric character references; ``&amp;`` last, once."""
    def decoded(t):
        for name, char in ENTITIES.items():
            t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
        return let(t, lambda d: F.replace(F.when(d.contains("&#"), _numeric(d)).otherwise(d), F.lit("&amp;"), F.lit("&")))

    # Most texts have no reference: one look instead of a pass per name.
    return let(c, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def _numeric(c: Column) -> Column:
    """Numeric references decoded: the text is cut at each one and put together again."""
    codes = F.regexp_extract_all(c, F.lit(_NUMERIC), F.lit(1))

    def decode(code):
        number = F.when(code.startswith("x"), F.conv(F.substring(code, 2, 8), 16, 10)).otherwise(code).try_cast("int")
        return F.when(code.isNull(), "").when(number.between(1, 0x10FFFF),
                      F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")

    return let(codes, lambda found: F.array_join(F.transform(
        F.split(c, _NUMERIC), lambda piece, i: F.concat(piece, F.coalesce(decode(F.get(found, i)), F.lit("")))), ""))


def foreign_letters(c: Column) -> Column:
    """A letter that is neither ASCII nor Czech."""
    return F.coalesce(c, F.lit("")).rlike(r"(?iu)[\p{L}&&[^a-zA-ZáčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ]]")


def mixed_script(c: Column) -> Column:
    """A word mixing Latin with Greek or Cyrillic letters."""
    return F.coalesce(c, F.lit("")).rlike(
        r"(?U)\p{IsLatin}\w*[\p{IsGreek}\p{IsCyrillic}]|[\p{IsGreek}\p{IsCyrillic}]\w*\p{IsLatin}")


# Notices that publishers serve instead of content.
BLOCK_NOTICE = (r"(?i)javascript is disabled|enable javascript|just a moment|"
                r"checking your (browser|connection)|access denied|are you a robot|unusual traffic")


def good_text(c: Column, min_length: int, marker: str | None = None, check_block: bool = True) -> Column:
    """Long enough, carries the marker, and is not a bot-block notice."""
    ok = F.length(F.coalesce(c, F.lit(""))) >= min_length
    if marker:
        ok = ok & F.lower(c).contains(marker)
    if check_block:
        ok = ok & ~F.substring(c, 1, 2000).rlike(BLOCK_NOTICE)
    return F.coalesce(ok, F.lit(False))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Number with the Czech plural form of the noun."""
    form = F.when(n == 1, one).when(n.between(2, 4), few).otherwise(many)
    return F.concat(n.cast("string"), F.lit(" "), form)


