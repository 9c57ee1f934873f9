"""N-gram Jaccard join with a token-group matrix.

A document is the set of its word shingles.  Rows with equal sets form a class, which is compared
once however many copies it has.  Classes that can have a partner are partitioned into blocks of
similar classes, and blocks into groups; per block a matrix (token x group) holds the token union of
every group.  The overlap of a query with a group's union bounds its Jaccard similarity with every
member, so only groups that reach the threshold are opened and compared exactly.

Which blocks a class must visit is decided without loss, in two steps.  Two sets with similarity of p
percent differ in at most d = (100 - p) / (100 + p) * (their sizes) tokens.  The token space is cut into
more than d segments by hash, so at least one segment holds the same tokens in both; classes that share
too few segments with any other have no partner, and most classes end there.  The tokens of the others
are ordered by how many of them hold a token, rarest first.  Partners have one of the first
n - ceil(p n / 100) + 1 tokens in common, so a class visits the blocks that hold one of its first tokens:
frequent shingles, and passages that many texts share, come last in that order and open nothing.

Links are found in two rounds.  In the first, classes are compared within their block, and each visits
the lowest block of every first token, so a group of near copies becomes one component however many blocks
it fills.  In the second, only tokens whose holders are not one component yet lead to visits, and only
between different components.

Answers are spanning links, never pairs: each task joins what it found in a local union-find and
returns one row per class, and the classes are contracted to components in Spark.

Tokens and class ids are 64-bit hashes.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from listwatch.llm.common import ascii_words, connected, id_key, mix, staged, text_key, word_hashes


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words make one shingle, none an empty set."""
    h = word_hashes(ascii_words(text))
    if not len(h):
        return h
    k = min(size, len(h))
    s = h[: len(h) - k + 1] + np.uint64(k)
    for j in range(1, k):
        s = mix(s) + h[j: len(h) - k + 1 + j]
    return np.unique(mix(s))


def class_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


class Segments:
    """Segment digests of a token set: sets with at least ``percent`` similarity share one or more.

    Sizes fall into steps of ratio 100 / percent, so partners are at most one step apart and both
    use the layout of the larger one's step.  A step has d + 1 + spare segments, so partners agree
    on more than ``spare``.  Empty segments are left out, so a set shares at least spare + 1 less its empty
    ones: a single segment in common, as a frequent shingle gives, is not enough.  A set with more empty
    segments than that may share only empty ones; it needs none and is a candidate in any case.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]

    def _step(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, int]:
        """The digests, and how many of them a partner holds at least."""
        n, found, need = len(tokens), [], []
        scrambled = mix(tokens)
        own = self._step(n)
        for step in range(own, self._step(n * 100 // self.percent) + 1):
            last = self.starts[step] * 100 // self.percent
            differ = (100 - self.percent) * 2 * last // (100 + self.percent)
            if not differ:
                continue
            spare = 2 + differ * 8 // 100
            count = differ + 1 + spare
            at = (scrambled >> np.uint64(20)) % np.uint64(count)
            at = at.astype(np.int64)
            sums = np.zeros(count, np.uint64)
            np.add.at(sums, at, scrambled)
            filled = np.bincount(at, minlength=count) > 0
            digests = mix(sums + mix(np.arange(count, dtype=np.uint64) + np.uint64(step << 32)))
            empty = int(count - filled.sum())
            found.append(digests[filled])
            need.append(max(0, spare + 1 - empty))
        return (np.concatenate(found), min(need)) if found else (np.empty(0, np.uint64), 1)


class _Merged:
    """Union-find over class ids."""

    def __init__(self):
        self.up = {}

    def find(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


class TokenGroupMatrix:
    """Token unions of groups of similar sets, and the sets themselves behind them."""

    def __init__(self, sets: list[np.ndarray], percent: int, group_size: int):
        self.percent = percent
        # Similar sizes and equal smallest tokens next to each other make narrow groups.
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0]))
        size = max(group_size, int(len(sets) ** 0.5))
        self.sizes = np.array([len(sets[i]) for i in self.order])
        flat = np.concatenate([sets[i] for i in self.order])
        self.vocabulary, self.at = np.unique(flat, return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.bounds = [(a, min(a + size, len(sets))) for a in range(0, len(sets), size)]
        self.matrix = np.zeros((len(self.vocabulary), len(self.bounds)), bool)
        for g, (a, b) in enumerate(self.bounds):
            self.matrix[self.at[self.ends[a] - self.sizes[a]: self.ends[b - 1]], g] = True
        self.smallest = np.array([self.sizes[a] for a, _ in self.bounds])
        self.largest = np.array([self.sizes[b - 1] for _, b in self.bounds])
        self.mark = np.zeros(len(self.vocabulary), bool)

    def partners(self, query: np.ndarray) -> list[int]:
        """Indices of the sets whose similarity with ``query`` reaches the threshold."""
        p, q = self.percent, len(query)
        at = np.minimum(np.searchsorted(self.vocabulary, query), len(self.vocabulary) - 1)
        rows = at[self.vocabulary[at] == query]
        overlap = self.matrix[rows].sum(axis=0)
        opened = (overlap * (100 + p) >= p * (q + self.smallest)) & (100 * self.largest >= p * q)
        found = []
        self.mark[rows] = True
        for g in np.flatnonzero(opened):
            a, b = self.bounds[g]
            start = self.ends[a] - self.sizes[a]
            shared = np.add.reduceat(self.mark[self.at[start: self.ends[b - 1]]].astype(np.int64),
                                     self.ends[a:b] - self.sizes[a:b] - start)
            near = np.flatnonzero(shared * (100 + p) >= p * (q + self.sizes[a:b]))
            found += [self.order[a + i] for i in near]
        self.mark[rows] = False
        return found


@dataclass(frozen=True)
class JaccardJoin:
    """Links documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    ``block_tokens`` bounds what one task holds: members and visiting queries of a block are dealt
    out in chunks of about that many tokens (a longer document is a chunk of its own).

    Null and empty texts have no shingles and are linked with nothing.  Null ids are allowed: they
    never name a component that has another id.  Repeated rows count as copies.  Other columns are ignored by
    ``components`` and carried along by ``keep_one``, whatever their names.
    """

    words: int = 5
    percent: int = 80
    block_tokens: int = 1 << 17
    group_size: int = 32
    id: str = "doc_id"
    text: str = "text"

    def components(self, docs: DataFrame) -> DataFrame:
        """id, text_key, n_shingles, class_id (null without shingles), class_size, component_id per row."""
        return self._rooted(docs).drop("root")

    def _rooted(self, docs: DataFrame) -> DataFrame:
        """The columns of ``components`` and root, the component's own class: an id can be in several components."""
        docs = docs.select(F.col(self.id).alias("id"), F.col(self.text).alias("text"))
        rows = staged(self._sets(docs), "sets")
        classes = staged(
            rows.where("n > 0").groupBy("class_id").agg(
                F.first("n").alias("n"), F.count(F.lit(1)).alias("class_size"), F.min("id").alias("first_id"),
                F.min(F.struct(id_key("id").alias("k"), F.col("text_key").alias("t"))).alias("sample")), "classes")
        links = connected(self._links(docs, classes).withColumnsRenamed({"class_id": "u", "root": "v"}))
        named = (links.join(classes, links["node"] == classes["class_id"])
                 .groupBy("root").agg(F.min("first_id").alias("lowest")))
        named = links.join(named, "root").select(F.col("node").alias("class_id"), "root", "lowest")
        classes = staged(classes.join(named, "class_id", "left").select(
            "class_id", "class_size", F.coalesce("root", "class_id").alias("root"),
            F.coalesce("lowest", "first_id").alias("lowest")), "components")
        # Both sides are plain scans, so a class of many copies is split at run time.
        return rows.join(classes, "class_id", "left").select(
            F.col("id").alias(self.id), "text_key", F.col("n").alias("n_shingles"), "class_id",
            F.coalesce("class_size", F.lit(1)).alias("class_size"),
            F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("id")).alias("component_id"), "root")

    def keep_one(self, docs: DataFrame) -> DataFrame:
        """Rows of ``docs`` without the near copies: of each component the row with the smallest id stays.

        Rows with the same id and text are one document.  Documents without shingles all stay.
        """
        found = self._rooted(docs)
        chosen = (found.where("n_shingles > 0 and component_id is not null")
                  .groupBy("root").agg(F.min(F.struct(F.col(self.id).isNull(), F.col(self.id).alias("i"),
                                                              id_key(self.id).alias("k"), F.col("text_key").alias("t"))).alias("s")))
        # A component of nameless rows has no id; each class of it stays then.
        nameless = found.where(F.col("n_shingles") > 0).where(F.col("component_id").isNull())
        kept = (chosen.select("s.k", "s.t")
                .union(nameless.select(id_key(self.id), "text_key"))
                .union(found.where("n_shingles = 0").select(id_key(self.id), "text_key")).distinct())
        kept = staged(kept, "kept")
        # The columns travel in a struct, so helper columns clash with none of them.
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_key(self.id).alias("k"), text_key(self.text).alias("t"))
        return rows.join(kept, ["k", "t"], "left_semi").dropDuplicates(["k", "t"]).select("row.*")

    def _sets(self, docs: DataFrame) -> DataFrame:
        words = self.words

        def measure(batches):
            for pdf in batches:
                sets = [shingle_set(t, words) for t in pdf["text"]]
                yield pd.DataFrame({"id": pdf["id"], "text_key": pdf["text_key"], "n": [len(s) for s in sets],
                                    "class_id": pd.array([class_id(s) if len(s) else None for s in sets], "Int64")})

        kind = docs.schema["id"].dataType.simpleString()
        return docs.withColumn("text_key", text_key("text")).mapInPandas(
            measure, f"id {kind}, text_key long, n long, class_id long")

    def _shared_segments(self, docs: DataFrame) -> DataFrame:
        """(segment, class_id, need, shared) for the segments that two or more classes hold, and those of classes that need none.

        Classes of one batch that hold the same segment have shown it to be shared, so only the first of them has to meet
        the holders of other batches; the others are dealt by class.  A segment that a third of all classes hold puts
        about one row per batch into a task.  A class that never meets another in a batch meets the first ones, of which
        one is another class: were all of them itself, it had shared a batch with their companions.
        """
        words, percent = self.words, self.percent

        def cut(batches):
            segments, done = Segments(percent), set()
            for pdf in batches:
                out, ids, needs = [], [], []
                for text in pdf["text"]:
                    tokens = shingle_set(text, words)
                    # Copies within a task are sent once: a hot class costs one set of rows per task.
                    if len(tokens) and (c := class_id(tokens)) not in done:
                        done.add(c)
                        digests, need = segments(tokens)
                        out.append(digests)
                        ids.append(np.full(len(digests), c, np.int64))
                        needs.append(np.full(len(digests), need, np.int64))
                if out:
                    held = np.concatenate(out)
                    _, first, which, count = np.unique(held, return_index=True, return_inverse=True, return_counts=True)
                    # 0: alone in its batch, 1: first of several, 2: another of several.
                    kind = np.where(count[which] > 1, 2, 0).astype(np.int32)
                    kind[first] = np.minimum(kind[first], 1)
                    yield pd.DataFrame({"segment": held.view(np.int64), "class_id": np.concatenate(ids),
                                        "need": np.concatenate(needs), "kind": kind})

        rows = docs.select("text").mapInPandas(cut, "segment long, class_id long, need long, kind int")
        met = W.partitionBy("segment", F.when(F.col("kind") == 2, F.col("class_id")).otherwise(F.lit(0)))
        several = (F.col("kind") > 0) | (F.min("class_id").over(met) < F.max("class_id").over(met))
        return (rows.withColumn("shared", several).where("shared or need = 0").groupBy("segment", "class_id")
                .agg(F.min("need").alias("need"), F.max("shared").alias("shared")))

    def _tokens(self, docs: DataFrame, members: DataFrame) -> DataFrame:
        """(class_id, tokens) of the member classes, from one text of each."""
        words = self.words

        def tokenise(batches):
            for pdf in batches:
                sets = [shingle_set(t, words) for t in pdf["text"]]
                yield pd.DataFrame({"class_id": [class_id(s) for s in sets], "tokens": [s.view(np.int64) for s in sets]})

        wanted = members.select(F.col("sample.k").alias("k"), F.col("sample.t").alias("t"))
        # A merge join at every size: candidates grow with the corpus, so they are never broadcast.
        rows = docs.withColumns({"k": id_key("id"), "t": text_key("text")}).join(wanted.hint("shuffle_merge"), ["k", "t"], "left_semi")
        return rows.select("text").mapInPandas(tokenise, "class_id long, tokens array<long>").dropDuplicates(["class_id"])

    def _chunk(self, chunks: Column) -> Column:
        return F.pmod(F.xxhash64("class_id"), chunks)

    def _members(self, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """(class_id, n, sample, block) of the classes that can have a partner."""
        segments = staged(self._shared_segments(docs), "segments")
        holders = segments.groupBy("segment").agg(F.count(F.lit(1)).alias("holders"))
        home = segments.join(holders, "segment").groupBy("class_id").agg(F.max(F.struct("holders", "segment"))["segment"].alias("home"),
                                                F.count_if("shared").alias("held"), F.min("need").alias("need")).where("held >= need")
        members = classes.join(home, "class_id").select("class_id", "n", "sample", "home")
        chunks = members.groupBy("home").agg(F.ceil(F.sum("n") / self.block_tokens).alias("chunks"))
        return members.join(chunks, "home").select(
            "class_id", "n", "sample", F.xxhash64("home", self._chunk(F.col("chunks"))).alias("block"))

    def _first_tokens(self, tokens: DataFrame, members: DataFrame) -> DataFrame:
        """(token, class_id, n, block) of every member's rarest tokens, less those that nobody else holds.

        Partners share one of them: of n tokens at least n * percent / 100 are common, so the common ones
        cannot all come after the first n - ceil(n * percent / 100) + 1 in an order that both follow.
        """
        each = tokens.select("class_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
        holders = each.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
        held, own = each.join(holders, "token"), W.partitionBy("class_id")
        length = F.col("n") - F.ceil(F.col("n") * self.percent / F.lit(100)) + 1
        first = (held.withColumns({"place": F.row_number().over(own.orderBy("holders", "token")), "held": F.count(F.lit(1)).over(own)})
                 .where(F.col("place") <= length - (F.col("n") - F.col("held"))))
        return first.select("token", "class_id").join(members.select("class_id", "n", "block"), "class_id")

    def _links(self, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """(class_id, root) rows that span all links between different classes."""
        members = staged(self._members(docs, classes), "members")
        tokens = staged(self._tokens(docs, members), "tokens")
        first = staged(self._first_tokens(tokens, members), "first_tokens")
        visits = staged(self._lowest_visits(first), "visits")
        links = staged(self._compared(members, tokens, visits, inside=True), "links")
        visits = staged(self._other_visits(first, links), "visits")
        return links.union(self._compared(members, tokens, visits, inside=False))

    def _lowest_visits(self, first: DataFrame) -> DataFrame:
        """(class_id, n, block): every class and the lowest block of each of its first tokens."""
        lowest = first.groupBy("token").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi")
        return first.join(lowest, "token").where("block > lo").select("class_id", "n", F.col("lo").alias("block")).distinct()

    def _other_visits(self, first: DataFrame, links: DataFrame) -> DataFrame:
        """(class_id, n, block) that remain: other blocks, where a holder of the token is of another component."""
        roots = connected(links.withColumnsRenamed({"class_id": "u", "root": "v"}))
        held = first.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select(
            "token", "class_id", "n", "block", F.coalesce("root", "class_id").alias("part"))
        held = staged(held, "held")
        tokens = held.groupBy("token").agg(F.min("block").alias("lo"), F.min("part").alias("one"), F.max("part").alias("other"))
        # The component with most holders of a token: its classes need not visit blocks where it alone holds the token.
        main = held.groupBy("token", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "part"))["part"].alias("main"))
        tokens = tokens.where("one < other").select("token", "lo").join(main, "token")
        # Everybody has met the lowest block, so each two of the other blocks are left, the lower one as visitor.
        held = staged(held.join(tokens, "token").where("block > lo").select(
            "token", "class_id", "n", "block", (F.col("part") == F.col("main")).alias("main")), "apart")
        hosts = held.groupBy("token", F.col("block").alias("to")).agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.every("main").alias("pure"))
        hosts = staged(hosts, "hosts")
        near = (F.col("n") * self.percent <= F.col("most") * 100) & (F.col("least") * self.percent <= F.col("n") * 100)
        met = lambda guests, hosts: guests.join(hosts, "token").where((F.col("block") < F.col("to")) & near).select(
            "class_id", "n", F.col("to").alias("block"))
        return met(held.where("not main"), hosts).union(met(held.where("main"), hosts.where("not pure"))).distinct()

    def _compared(self, members: DataFrame, tokens: DataFrame, visits: DataFrame, inside: bool) -> DataFrame:
        """(class_id, root) links that the visits, and with ``inside`` the blocks themselves, contain."""
        load = visits.groupBy("block").agg(F.ceil(F.sum("n") / self.block_tokens).alias("parts"))
        guests = visits.join(load, "block").select(
            "block", (F.lit(1) + self._chunk(F.col("parts"))).alias("part"), "class_id", F.lit(False).alias("member"))
        # Part 0 compares the members of a block with each other.
        hosts = members.join(load, "block", "left" if inside else "inner").select(
            "block", F.explode(F.sequence(F.lit(0 if inside else 1).cast("long"), F.coalesce("parts", F.lit(0)))).alias("part"), "class_id",
            F.lit(True).alias("member"))
        work = hosts.union(guests).join(tokens, "class_id")
        percent, group_size = self.percent, self.group_size

        def link(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = pdf["class_id"].to_numpy()
            sets = [np.asarray(t, np.int64).view(np.uint64) for t in pdf["tokens"]]
            host = pdf["member"].to_numpy(bool)
            queries = np.flatnonzero(host) if pdf["part"].iat[0] == 0 else np.flatnonzero(~host)
            host = np.flatnonzero(host)
            merged = _Merged()
            if len(host) and len(queries) and (len(host) > 1 or len(queries) > len(host) or queries[0] != host[0]):
                matrix = TokenGroupMatrix([sets[i] for i in host], percent, group_size)
                for i in queries:
                    for j in matrix.partners(sets[i]):
                        merged.join(int(ids[i]), int(ids[host[j]]))
            found = [(x, merged.find(x)) for x in list(merged.up)]
            return pd.DataFrame([f for f in found if f[0] != f[1]], columns=["class_id", "root"], dtype="int64")

        return work.groupBy("block", "part").applyInPandas(link, "class_id long, root long")
