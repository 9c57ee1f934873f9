"""Mixing sources to target weights by hierarchical budgets.

The leaves are the (domain, lang, source) triples of the corpus.  A token budget is split over the
domains by weight, each domain's over its languages, each language's over its sources.  A node cannot
take more than its tokens times ``epochs``; what it cannot take goes to its siblings in proportion to
their weights, and only what a whole family cannot take goes to the parent's siblings.  Splitting top
down with the capacity of the whole subtree as the limit gives just that.

An epoch of a leaf is an order of its documents by a seeded digest.  A leaf takes whole epochs and a
prefix of the next, the longest one whose tokens fit.  To find the prefix, documents are summed by the
first digits of the digest; only those of the one bucket where the budget ends are put in order, so no
leaf is ever sorted as a whole, however many of the rows it holds.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from listwatch.llm.common import free_names, staged

#: Hex digits of the digest that name a bucket: 4,096 buckets per leaf and epoch.
DIGITS = 3


def word_tokens(text: str) -> Column:
    """Number of words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weight_of(weights: dict[str, int], column: str) -> Column:
    """The weight named for a value, else that of ``*``, else 0."""
    named = [x for k, v in weights.items() if k != "*" for x in (F.lit(k), F.lit(v))]
    other = F.lit(weights.get("*", 0))
    return (F.coalesce(F.create_map(*named)[F.col(column)], other) if named else other).cast("long")


def allocate(nodes: DataFrame, family: list[str], weight: str, limit: str, budget: Column) -> DataFrame:
    """``nodes`` with ``given``: the family's budget split by weight, no node above its limit.

    Nodes are filled in the order of limit per weight.  Once the share of one is below its limit, so
    are those of all that follow.  Shares are rounded down; a node of weight 0 gets nothing.
    """
    nodes = nodes.where(F.col(weight) > 0).withColumn("_ratio", F.col(limit) / F.col(weight))
    order = [F.col("_ratio"), *[F.col(c) for c in ("domain", "lang", "source") if c in nodes.columns]]
    before = W.partitionBy(*family).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rest = W.partitionBy(*family).orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    nodes = (nodes.withColumn("_budget", budget.cast("long"))
             .withColumn("_taken", F.coalesce(F.sum(limit).over(before), F.lit(0)))
             .withColumn("_weights", F.sum(weight).over(rest)))
    level = (F.col("_budget") - F.col("_taken")) / F.col("_weights")
    # The level at the first node that its share leaves unfilled holds for all after it; theirs are lower.
    nodes = nodes.withColumn("_level", F.when(F.col("_ratio") >= level, level))
    nodes = nodes.withColumn("_level", F.max("_level").over(W.partitionBy(*family)))
    share = F.floor(F.col("_level") * F.col(weight))
    return (nodes.withColumn("given", F.when(F.col("_level").isNull() | (F.col("_ratio") < F.col("_level")), F.col(limit))
                             .otherwise(F.least(share, F.col(limit))))
            .drop("_ratio", "_budget", "_taken", "_weights", "_level"))


@dataclass(frozen=True)
class Mixture:
    """Target weights per level (whole numbers; ``*`` for values not named) and the budget.

    The budget is ``tokens``, or ``share`` of all tokens.  ``domain`` is an expression over the columns
    of the documents.  A null domain, language or source counts as the empty string.  Rows with the
    same id share a place in the order and are taken or left together; a null id is placed by its text.
    Empty texts cost nothing and are taken while their place is within the prefix.
    """

    domains: dict
    langs: dict
    sources: dict
    domain: str
    share: float = 1.0
    tokens: int | None = None
    epochs: int = 1
    seed: int = 1
    id: str = "doc_id"
    text: str = "text"

    def budgets(self, docs: DataFrame) -> DataFrame:
        """domain, lang, source, tokens and given (budget) per leaf with a weight; one row per leaf."""
        return self._budgets(self._placed(docs).select("_domain", "_lang", "_source", "_tokens"))

    def mix(self, docs: DataFrame) -> DataFrame:
        """The chosen rows with all their columns, and _domain, _lang, _source, _tokens and _epoch (from 0); one row per epoch taken.

        Columns of the documents keep their values: an added name that they have gets more underscores.
        """
        leaf = ["_domain", "_lang", "_source"]
        placed = self._placed(docs)
        small = staged(placed.select("_domain", "_lang", "_source", "_tokens", "_key"), "places")
        plan = self._budgets(small).select(
            *[F.col(c[1:]).alias(c) for c in leaf], F.floor(F.col("given") / F.greatest("tokens", F.lit(1))).alias("_whole"),
            (F.col("given") % F.greatest("tokens", F.lit(1))).alias("_rest"))
        plan = staged(plan, "plan")
        # Where the prefix ends: the bucket in which the running sum passes the budget.
        part = small.join(plan, leaf).withColumn("_digest", self._digest(F.col("_whole")))
        sums = part.withColumn("_bucket", F.substring("_digest", 1, DIGITS)).groupBy(*leaf, "_bucket").agg(
            F.sum("_tokens").alias("n"), F.first("_rest").alias("_rest"))
        running = W.partitionBy(*leaf).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("n").over(running))
        ends = sums.where("upto > _rest").groupBy(*leaf).agg(
            F.min(F.struct(F.col("_bucket").alias("end"), (F.col("_rest") - F.col("upto") + F.col("n")).alias("room"))).alias("e"))
        ends = staged(plan.join(ends, leaf, "left").select(*leaf, "_whole", "_rest", "e.end", "e.room"), "ends")

        rows = placed.join(ends, leaf).withColumn("_digest", self._digest(F.col("_whole")))
        bucket = F.substring("_digest", 1, DIGITS)
        # Whole epochs, and the partial one where the bucket lies before the end.
        times = (F.col("_whole") + F.when((F.col("_rest") > 0) & (F.col("end").isNull() | (bucket < F.col("end"))), 1).otherwise(0))
        taken = rows.withColumn("_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1))))
        last = rows.where((F.col("_rest") > 0) & (bucket == F.col("end")))
        # Equal digests have equal sums: repeated rows are taken together.
        upto = F.sum("_tokens").over(W.partitionBy(*leaf).orderBy("_digest"))
        last = last.withColumn("_upto", upto).where(F.col("_upto") <= F.col("room")).withColumn("_epoch", F.col("_whole"))
        names = [*leaf, "_tokens", "_epoch"]
        extra = [F.col(c).alias(name) for c, name in zip(names, free_names(docs, *names))]
        return taken.select("_row.*", *extra).union(last.select("_row.*", *extra))

    def _placed(self, docs: DataFrame) -> DataFrame:
        text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        return docs.select(
            row.alias("_row"), text(F.expr(self.domain)).alias("_domain"), text(F.col("lang")).alias("_lang"),
            text(F.col("source")).alias("_source"), word_tokens(self.text).alias("_tokens"),
            F.coalesce(F.col(self.id).cast("string"), F.md5(F.coalesce(F.col(self.text), F.lit("")))).alias("_key"))

    def _digest(self, epoch: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(self.seed)), epoch.cast("string"), F.col("_key")))

    def _budgets(self, rows: DataFrame) -> DataFrame:
        leaves = rows.groupBy(F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source")).agg(
            F.sum("_tokens").alias("tokens"))
        # One row per leaf: small, and written so that every level reads the same numbers.
        leaves = staged(leaves, "leaves")
        total = F.lit(self.tokens) if self.tokens is not None else None
        if total is None:
            total = F.lit(int((leaves.agg(F.sum("tokens")).first()[0] or 0) * self.share))
        leaves = leaves.withColumns({
            "w3": weight_of(self.sources, "source"), "w2": weight_of(self.langs, "lang"), "w1": weight_of(self.domains, "domain"),
            "limit": F.col("tokens") * self.epochs}).where("w1 > 0 and w2 > 0 and w3 > 0")
        langs = leaves.groupBy("domain", "lang").agg(F.first("w2").alias("w2"), F.first("w1").alias("w1"), F.sum("limit").alias("limit"))
        tops = langs.groupBy("domain").agg(F.first("w1").alias("w1"), F.sum("limit").alias("limit"))
        tops = allocate(tops.withColumn("all", F.lit(1)), ["all"], "w1", "limit", total).select("domain", F.col("given").alias("b1"))
        langs = allocate(langs.join(tops, "domain"), ["domain"], "w2", "limit", F.col("b1"))
        langs = langs.select("domain", "lang", F.col("given").alias("b2"))
        leaves = allocate(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "w3", "limit", F.col("b2"))
        return leaves.select("domain", "lang", "source", "tokens", "given")
