"""Loosely typed JSON: coercion to text, embedded objects, yes/no answers."""

from pyspark.sql import Column, functions as F

from listwatch.functions.text import squeeze


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _scalar_text(v: Column) -> Column:
    kind = _kind(v)
    simple = (kind == "STRING") | (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE")
    return F.when(simple, F.try_variant_get(v, "$", "string"))


def as_text(v: Column, first_only: bool = False) -> Column:
    """VARIANT to text: strings and numbers as they are, lists joined by blanks (or the first
    non-blank element), anything else blank."""
    items = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), _scalar_text),
                     lambda t: F.trim(t) != "")
    listed = F.coalesce(F.get(items, F.lit(0)), F.lit("")) if first_only else F.array_join(items, " ")
    return F.coalesce(F.when(_kind(v).startswith("ARRAY"), listed).otherwise(_scalar_text(v)), F.lit(""))


def as_names(v: Column) -> Column:
    """Names from a string, an object with ``name``, or a list of either."""
    def one(x):
        return squeeze(F.when(_kind(x).startswith("OBJECT"), F.try_variant_get(x, "$.name", "string"))
                       .otherwise(_scalar_text(x)))
    many = F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    return F.filter(F.transform(many, one), lambda n: n != "")


def embedded_object(text: Column) -> Column:
    """VARIANT of the object embedded in a text (code fences and chatter around it ignored)."""
    return F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def embedded_array(text: Column) -> Column:
    return F.try_parse_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1))


def yes_no(text: Column) -> Column:
    """True / False / NULL from a Czech or English answer."""
    s = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(s.rlike("^(ano|yes|true)"), True).when(s.rlike("^(ne|no|false)"), False)
