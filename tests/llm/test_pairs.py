"""Near and exact copies against brute force."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwatch.llm import token_groups
from listwatch.llm.common import connected, staged
from listwatch.llm.digest_index import DigestIndex, ExactDedup, temporary_index
from listwatch.llm.token_groups import JaccardJoin, Segments, TokenGroupMatrix, class_id, shingle_set
from listwatch.session import scratch_dir


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if len(w) < k:
        return frozenset([b" ".join(w)]) if w else frozenset()
    return frozenset(b" ".join(w[i:i + k]) for i in range(len(w) - k + 1))


def brute_components(rows, k, p):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= p * len(a | b):
                up[find(i)] = find(j)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            lowest[find(i)] = min(lowest.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), lowest.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(seed, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(1, words * 4))]
        for _ in range(rng.randint(1, 14)):
            t = list(text)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                t = t[rng.randint(0, 4):] or t
            rows.append((len(rows) * 7 % 997, rng.choice([" ", "\n", "  "]).join(t)))
    return rows


def run(spark, rows, **parameters):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = JaccardJoin(**parameters).components(docs)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str)


@pytest.mark.parametrize("words, percent, block", [(3, 90, 1 << 17), (5, 80, 1 << 17), (3, 90, 300), (2, 60, 500)])
def test_components_equal_brute_force(spark, words, percent, block):
    rows = corpus(words * percent)
    assert run(spark, rows, words=words, percent=percent, block_tokens=block) == brute_components(rows, words, percent)


def test_components_of_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "two words"), (None, "two  Words"), (7, "É"), (8, "é"),
            (9, long), (10, long + " tail"), (9, long), (None, None), (11, "a b c"), (12, "a b c")]
    assert run(spark, rows, words=3, percent=90) == brute_components(rows, 3, 90)
    assert run(spark, [], words=3, percent=90) == []
    assert run(spark, [(1, None)], words=3, percent=90) == [(1, 0, 1)]


def test_other_columns_do_not_matter_and_keep_one_returns_them(spark):
    text = " ".join(f"y{i}" for i in range(60))
    rows = [(1, text, "a", 0), (2, text + " z", "b", 1), (3, "other text of its own here", None, 2), (4, None, "d", 3), (3, "other text of its own here", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, n long")
    kept = JaccardJoin().keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_an_id_of_two_unrelated_texts_keeps_both(spark):
    a, b = ("".join(f"{w}{i} " for i in range(60)) for w in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + "end"), (3, b + "end"), (1, a)], "doc_id long, text string")
    kept = JaccardJoin().keep_one(docs)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, a), (1, b)]


def test_similar_sets_share_a_segment():
    rng = np.random.default_rng(3)
    for percent in (60, 80, 90):
        segments = Segments(percent)
        for n in (10, 11, 25, 90, 400):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for _ in range(12):
                lost = rng.integers(0, int(len(a) * (100 - percent) / 100) + 1)
                b = np.sort(rng.permutation(a)[lost:])
                more = int((len(b) * 100 - percent * len(a)) / percent)
                b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, rng.integers(0, more + 1), dtype=np.uint64)]))
                inter = len(np.intersect1d(a, b))
                if 100 * inter >= percent * (len(a) + len(b) - inter) and len(a) != inter:
                    (x, need), (y, other) = segments(a), segments(b)
                    assert np.isin(x, y).sum() >= max(need, other)


def test_need_of_a_very_long_text_passes_16_bits(spark):
    rng = np.random.default_rng(5)
    text = " ".join(f"w{i}" for i in rng.integers(0, 1_000, 4_200_000))
    tokens = shingle_set(text, 3)
    digests, need = Segments(90)(tokens)
    assert len(tokens) > 4_000_000 and need > np.iinfo(np.int16).max and len(digests) > need
    docs = spark.createDataFrame([(2, text), (1, text + " other end"), (3, "short one")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in JaccardJoin(words=3, percent=90).components(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_matrix_opens_every_group_that_has_a_partner():
    texts = [t for _, t in corpus(5)]
    sets = [shingle_set(t, 3) for t in texts]
    matrix = TokenGroupMatrix(sets, 70, 4)
    for i, s in enumerate(sets):
        exact = {j for j, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 70 * len(np.union1d(s, o))}
        assert set(matrix.partners(s)) == exact
    assert class_id(sets[0]) == class_id(shingle_set(texts[0].upper(), 3))


def test_connected_finds_the_smallest_node(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (205, 203), (203, 201), (204, 205)]
    found = {(r["node"], r["root"]) for r in connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)} | {(i, 201) for i in (201, 203, 204, 205)}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_copies(spark):
    rows = [(5, "Same", "a"), (9, "sAME", "b"), (9, "same", "c"), (None, "SAME", "d"), (1, None, "e"), (2, "", "f"), (3, "É", "g"),
            (4, "é", "h"), (None, "alone", "i"), (7, "x" * 100_000, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    found = ExactDedup().decisions(docs).collect()
    assert len(found) == len(rows)
    kept = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"]) for r in found if r["kept"])
    assert kept == [("2", 2, 2), ("3", 3, 1), ("4", 4, 1), ("7", 7, 1), ("9", 9, 4), ("None", None, 1)]
    rest = ExactDedup().keep_one(docs)
    assert rest.columns == docs.columns and sorted(str(r["doc_id"]) for r in rest.collect()) == ["2", "3", "4", "7", "9", "None"]
    empty = docs.limit(0)
    assert ExactDedup().decisions(empty).count() == 0 and ExactDedup().keep_one(empty).count() == 0


def test_digests_are_computed_once_per_pass(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (None, None), (3, "")], "doc_id long, text string")
    rest = ExactDedup().keep_one(docs)
    assert rest._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r["doc_id"] for r in rest.collect()) == [2, 3]


def test_index_persists_and_a_batch_can_run_again(spark):
    path = scratch_dir(spark, f"index-{uuid.uuid4().hex}")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    index = DigestIndex(spark, path, buckets=4)
    for _ in range(2):
        assert sorted(r["doc_id"] for r in ExactDedup().keep_one(first, index).collect()) == [2, 3]
        assert index.rows().count() == 2
    spark.sql(f"DROP TABLE {index.name}")
    again = DigestIndex(spark, path, buckets=4)
    new = spark.createDataFrame([(8, "a"), (9, "c")], "doc_id long, text string")
    assert [r["doc_id"] for r in ExactDedup().keep_one(new, again).collect()] == [9]
    assert again.rows().count() == 3


@pytest.mark.parametrize("asked", [1, 64])
def test_index_keeps_its_bucket_count(spark, asked):
    path = scratch_dir(spark, f"index-{uuid.uuid4().hex}")
    docs = spark.createDataFrame([(i, f"text {i % 150}") for i in range(200)], "doc_id long, text string")
    ExactDedup().keep_one(docs, DigestIndex(spark, path, buckets=16))
    again = DigestIndex(spark, path, buckets=asked)
    found = ExactDedup().decisions(docs, again).collect()
    assert again.buckets == 16 and again.rows().count() == 150
    assert len(found) == 200 and sum(r["kept"] for r in found) == 150


def test_columns_named_like_helpers_keep_their_values(spark):
    rows = [(1, "same text", "mine", "k", "d"), (2, "same text", "yours", "l", "e"), (3, "other words", "theirs", "m", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k string, _t string, _id string")
    for kept in (JaccardJoin().keep_one(docs), ExactDedup().keep_one(docs.withColumn("_digest", F.lit("x")))):
        for r in kept.collect():
            assert (r["_k"], r["_t"], r["_id"]) == rows[r["doc_id"] - 1][2:]


def test_unrelated_texts_with_common_passages_visit_nobody(spark, monkeypatch):
    rng, seen = random.Random(8), {}

    def counting(df, name):
        out = staged(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(token_groups, "staged", counting)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"w{rng.randrange(3_000)}" for _ in range(rng.randint(20, 90))) + " " + passage * (i % 3 == 0)) for i in range(10_000)]
    near = " ".join(f"n{i}" for i in range(80))
    rows += [(20_000 + i, near.replace(f"n{i % 70} ", "other ")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = JaccardJoin(words=5, percent=80, block_tokens=1_000).components(docs)
    assert found.where("doc_id >= 20000").select("component_id").distinct().count() == 1
    assert found.where("doc_id < 20000 and component_id <> doc_id").count() == 0
    assert sum(seen["visits"]) < len(rows) and seen["first_tokens"][0] < 3 * len(rows)


def test_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = temporary_index(spark, 4)
    batch = spark.createDataFrame([(b"x", 1)], "digest binary, doc_id long")
    index.add(batch)
    plan = batch.groupBy("digest").agg(F.max("doc_id")).join(index.rows().hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().explainString(plan._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "SortMergeJoin" in text and text.count("Exchange") == 1
