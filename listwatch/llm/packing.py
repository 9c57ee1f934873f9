"""Best-fit decreasing packing of tokenised documents into windows.

Documents are cut into full windows and a rest, in the tasks that tokenise them.  Best-fit decreasing
looks at nothing but lengths, and a length is at most the window: the packing of the whole corpus is
therefore planned on the histogram of lengths, at most ``window`` numbers however large the corpus.
The plan handles equal windows together as a block; a segment tree over remaining capacities finds the
tightest open one.  It gives ranges of pieces (by rank within their length) their places, and every
piece looks its own place up.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from listwatch.llm.common import staged
from listwatch.llm.tokens import Encoder


class Capacities:
    """Segment tree over 0..window: finds the smallest capacity from a given one on that has open windows."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.filled = [False] * (2 * self.leaves)

    def set(self, capacity: int, filled: bool) -> None:
        node = self.leaves + capacity
        self.filled[node] = filled
        while node := node // 2:
            self.filled[node] = self.filled[2 * node] or self.filled[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = self.leaves + least
        while not self.filled[node]:
            while node & 1:
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.filled[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``histogram`` (length -> pieces), as best-fit decreasing gives them to single pieces.

    A place (length, rank, pieces, each, sequence, offset) puts the pieces of that length from that
    rank on into sequences from ``sequence`` on, ``each`` of them per sequence, from ``offset`` on.
    """
    tree, blocks, places, opened = Capacities(window), {}, [], 0

    def leave(capacity: int, sequence: int, count: int) -> None:
        if count:
            blocks.setdefault(capacity, []).append((sequence, count))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                sequence, count = opened, -(-left // (window // length))
                opened += count
            else:
                sequence, count = blocks[capacity].pop()
                if not blocks[capacity]:
                    tree.set(capacity, False)
            # A window that took a piece is the tightest one for the next piece while that fits.
            each = capacity // length
            whole = min(count, left // each)
            if whole:
                places.append((length, rank, whole * each, each, sequence, window - capacity))
                rank, left = rank + whole * each, left - whole * each
                leave(capacity - each * length, sequence, whole)
            if whole < count and left:
                places.append((length, rank, left, left, sequence + whole, window - capacity))
                leave(capacity - left * length, sequence + whole, 1)
                whole, left = whole + 1, 0
            leave(capacity, sequence + whole, count - whole)
    return places


@dataclass(frozen=True)
class Packing:
    """Packs documents (token ids and an end id each) into sequences of at most ``window`` tokens.

    Null and empty texts are documents of the end id alone.  Ids may be null or repeated: every row is
    a document of its own.  An empty table gives no pieces.  Other columns are ignored.
    """

    tokenizer: str
    window: int = 1024
    end: int = 0
    id: str = "doc_id"
    text: str = "text"

    def pieces(self, docs: DataFrame, ids: bool = False) -> DataFrame:
        """One row per piece with sequence_id and offset; with ``ids`` also its token ids."""
        cut = staged(self._cut(docs, ids), "pieces")
        counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
        counts = staged(counts, "lengths")
        # At most `window` rows.
        histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
        places = docs.sparkSession.createDataFrame(
            best_fit_decreasing(histogram, self.window),
            "length long, first long, pieces long, each long, sequence long, from long")
        before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("pos"))
        # The places are a function of the histogram, so their number has a bound that no corpus exceeds.
        places = F.broadcast(places)
        fits = ((ranked["length"] == places["length"]) & (ranked["rank"] >= places["first"])
                & (ranked["rank"] < places["first"] + places["pieces"]))
        nth = F.col("rank") - F.col("first")
        return ranked.join(places, fits).select(
            F.col("id").alias(self.id), "start", ranked["length"], "ids_crc32", "doc_tokens",
            (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
            (F.col("from") + F.pmod(nth, F.col("each")) * ranked["length"]).alias("offset"), *(["ids"] if ids else []))

    def sequences(self, pieces: DataFrame) -> DataFrame:
        """sequence_id, tokens, ids: the windows, padded with the end id unless their length is a power of two."""
        whole = pieces.groupBy("sequence_id").agg(
            F.sum("length").alias("tokens"),
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
        short = (F.col("tokens").bitwiseAND(F.col("tokens") - 1) != 0)
        pad = F.array_repeat(F.lit(self.end), F.when(short, F.lit(self.window) - F.col("tokens")).otherwise(0).cast("int"))
        return whole.withColumn("ids", F.concat("ids", pad))

    def _cut(self, docs: DataFrame, with_ids: bool) -> DataFrame:
        path, window, end = self.tokenizer, self.window, np.array([self.end], "<u4").tobytes()
        docs = docs.select(F.col(self.id).alias("id"), F.col(self.text).alias("text"))

        def cut(batches):
            encoder, part, seen = Encoder.of(path), TaskContext.get().partitionId(), {}
            for pdf in batches:
                rows = []
                for doc, text in zip(pdf["id"], pdf["text"]):
                    data = encoder.encode(text or "") + end
                    n = len(data) // 4
                    for start in range(0, n, window):
                        piece = data[4 * start: 4 * (start + window)]
                        length = len(piece) // 4
                        pos = seen[length] = seen.get(length, -1) + 1
                        rows.append((doc, start, length, zlib.crc32(piece), n, part, pos)
                                    + ((np.frombuffer(piece, "<u4").astype(np.int32),) if with_ids else ()))
                out = pd.DataFrame(rows, columns=columns)
                out["id"] = out["id"].astype(pdf["id"].dtype)
                yield out

        columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "pos"] + ["ids"] * with_ids
        kind = docs.schema["id"].dataType.simpleString()
        return docs.mapInPandas(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, pos long"
                                + ", ids array<int>" * with_ids)
