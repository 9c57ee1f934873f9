"""Parsers by source: one raw table, many formats.

A parser turns the raw rows of its source into rows of its own; hooks name what every source has to
say about a row, as column expressions over what the parser returns.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.functions.text import missing


@dataclass(frozen=True)
class Parser:
    """``parse`` gets the raw rows of one source; the hooks are expressions over its result."""

    parse: Callable[[DataFrame], DataFrame]
    guid_of: Column
    first_seen_of: Column


class ParserRegistry:
    """Named parsers.  Sources are compared as they are; a name is registered once."""

    def __init__(self):
        self._parsers: dict[str, Parser] = {}

    def register(self, name: str, guid_of: Column, first_seen_of: Column):
        """Decorator for ``DataFrame -> DataFrame``."""
        def add(parse):
            if name in self._parsers:
                raise ValueError(f"parser {name} registered twice")
            self._parsers[name] = Parser(parse, guid_of, first_seen_of)
            return parse

        return add

    def parse(self, raw: DataFrame, source: str) -> DataFrame:
        """Rows of all sources with source, guid and first_seen; columns that a parser lacks are null.

        A filter on the source goes with each parser, so a table partitioned by source is read once per
        source and not once per parser.  Rows without a guid are left out.
        """
        parts = []
        for name, p in self._parsers.items():
            rows = p.parse(raw.where(F.col(source) == name))
            own = [c for c in rows.columns if c not in (source, "guid", "first_seen")]
            parts.append(rows.select(F.lit(name).alias(source), p.guid_of.alias("guid"), p.first_seen_of.alias("first_seen"), *own)
                         .where(~missing(F.col("guid"))))
        if not parts:
            raise ValueError("no parser registered")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def rejected(self, raw: DataFrame, source: str) -> DataFrame:
        """Raw rows of sources, null included, that no parser reads."""
        return raw.where(F.col(source).isNull() | ~F.col(source).isin(list(self._parsers)))
