"""Helpers of this subpackage: staged tables, bounded word caches and connected components."""

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from listwatch.session import materialise, scratch_dir

#: Entries after which a worker forgets its words and starts anew: bounds its memory, changes no result.
CACHE_WORDS = 1 << 17


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared scratch folder; a lost executor costs a reread."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_key(text: str | Column) -> Column:
    """64-bit digest of a text, null as empty; with the row's id it finds a row again in another scan."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def id_key(column: str) -> Column:
    """An id that joins with itself even when it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered per worker process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


WORDS = WordHashes()


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Invertible scramble of 64-bit values, so that sums and remainders of them behave like random ones."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node that it reaches.

    Alternates two star contractions, each an aggregate and a join of edges, until the edges are
    stars around the roots.  No node's neighbours are ever gathered; every round is a checkpoint.
    An empty input gives an empty result; loops, repeated and reversed edges change nothing.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        seen = state
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.union(low.select("u", "m")).distinct())
