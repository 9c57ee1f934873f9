"""Chat formatting by quotation linking.

Messages quote earlier ones with leading ``>`` marks, nested by their number.  A message is parsed
into passages of one level.  Quoted passages and their lines are normalised and hashed, and so are
the lines, paragraphs and the body that messages write themselves.  Joined by hash, a quotation leads
to the first message of the conversation that wrote it.  A message replies to the one from which most
of its first-level quotation comes.  Messages of a thread in turn order are in reply order, since a
reply comes after what it quotes.
"""

import re
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from listwatch.llm.common import connected, staged

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: "On Monday A wrote:" right before a quotation belongs to it.
INTRODUCTION = re.compile(r"(?i).*\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$")


def passages(text: str | None) -> list[tuple[int, list[str]]]:
    """(level, lines) of each run of lines with the same number of marks; level 0 is the message's own."""
    runs: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        found = MARKS.match(line)
        level, rest = (found[1].count(">"), line[found.end():]) if found else (0, line)
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(rest)
    return runs


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def own_text(runs: list[tuple[int, list[str]]]) -> str:
    """The message without quotations and the lines that introduce them."""
    kept = []
    for i, (level, lines) in enumerate(runs):
        if level == 0:
            lines = list(lines)
            if i + 1 < len(runs):
                while lines and not lines[-1].strip():
                    lines.pop()
                if lines and INTRODUCTION.match(lines[-1]):
                    lines.pop()
            kept += lines
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")


def _units(lines: list[str]) -> set[str]:
    """The passage, its paragraphs and its lines, normalised."""
    paragraphs = re.split(r"\n[ \t]*\n", "\n".join(lines))
    return {n for part in ["\n".join(lines), *paragraphs, *lines] if (n := normalised(part))}


def _hash(unit: str) -> int:
    return xxhash.xxh3_64_intdigest(unit.encode()) - (1 << 63)


@dataclass(frozen=True)
class QuotationLinks:
    """Reply links and quote-free texts of conversations (conv_id, turn, role, text).

    A message whose quotations lead nowhere, or that has none, starts a thread.  Null and empty texts
    are empty messages.  Messages with a null conversation or turn are never linked.  Messages that
    repeat conversation and turn share their link.  Other columns are kept by ``format``.
    """

    conversation: str = "conv_id"
    turn: str = "turn"
    text: str = "text"

    def parsed(self, messages: DataFrame) -> DataFrame:
        """(conv, turn, level, unit, weight): hashes of what each message writes and quotes."""
        rows = messages.select(F.col(self.conversation).alias("conv"), F.col(self.turn).alias("turn"), F.col(self.text).alias("text"))

        def parse(batches):
            for pdf in batches:
                out = []
                for conv, turn, text in zip(pdf["conv"], pdf["turn"], pdf["text"]):
                    units = {(level, u) for level, lines in passages(text) for u in _units(lines)}
                    out += [(conv, turn, level, _hash(u), len(u)) for level, u in units]
                found = pd.DataFrame(out, columns=["conv", "turn", "level", "unit", "weight"])
                yield found.astype({"conv": pdf["conv"].dtype, "turn": pdf["turn"].dtype})

        kind = {f.name: f.dataType.simpleString() for f in rows.schema}
        rows = rows.where("conv is not null and turn is not null")
        return rows.mapInPandas(parse, f"conv {kind['conv']}, turn {kind['turn']}, level int, unit long, weight long")

    def links(self, messages: DataFrame) -> DataFrame:
        """(conv, turn, reply_to) for every message with a quotation that leads to an earlier message."""
        units = staged(self.parsed(messages), "units")
        # The first writer of a unit: one row per conversation and unit, whatever its copies.
        first = units.where("level = 0").groupBy("conv", "unit").agg(F.min("turn").alias("reply_to"))
        quoted = units.where("level > 0").join(first, ["conv", "unit"]).where("reply_to < turn")
        votes = quoted.groupBy("conv", "turn", "reply_to").agg(F.min("level").alias("level"), F.sum("weight").alias("weight"))
        best = F.max(F.struct(-F.col("level"), F.col("weight"), F.col("reply_to").alias("to")))["to"]
        return votes.groupBy("conv", "turn").agg(best.alias("reply_to"))

    def format(self, messages: DataFrame) -> DataFrame:
        """All rows and columns with ``reply_to``, ``thread`` (its first turn) and the text without quotations.

        Order by conversation, thread and turn to read a conversation in reply order.
        """
        links = staged(self.links(messages), "replies")
        node = lambda turn: F.struct("conv", F.col(turn).alias("turn"))
        threads = connected(links.select(node("turn").alias("u"), node("reply_to").alias("v")))
        placed = links.join(threads.select("node.*", F.col("root.turn").alias("thread")), ["conv", "turn"], "right")

        @F.pandas_udf("string")
        def without_quotes(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: own_text(passages(t)))

        placed = staged(placed.select(F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), "reply_to", "thread"), "threads")
        rows = messages.join(placed, (messages[self.conversation] == placed["_conv"]) & (messages[self.turn] == placed["_turn"]), "left")
        columns = [without_quotes(messages[c]).alias(c) if c == self.text else messages[c] for c in messages.columns]
        return rows.select(*columns, placed["reply_to"], F.coalesce(placed["thread"], messages[self.turn]).alias("thread"))
