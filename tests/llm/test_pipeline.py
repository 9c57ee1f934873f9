"""The pipeline's stages against brute force on a small table."""

import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_pairs import brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    body = lambda i: " ".join(f"tok{i}x{j}" for j in range(40))
    rows = []
    for i in range(160):
        text = body(i) + (" utterly vile rubbish" if i % 5 == 0 else "")
        rows.append((i, text))
        if i % 7 == 0:
            rows.append((1000 + i, text.upper()))
        if i % 11 == 0:
            rows.append((2000 + i, text + " end"))
    rows += [(3000, None), (3001, "")]
    docs = spark.createDataFrame([(d, t, "en" if d % 3 else "de", f"src{d % 4}", len(t or "")) for d, t in rows], COLUMNS)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(d, 1, int(d % 1000 % 5 == 0)) for d, _ in rows if d < 3000 and d % 2]
    labels += [(d, 1, 1) for d, _ in rows if d < 160 and d % 5 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_do_their_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    clean = stage["toxicity"](spark, docs, folder)
    left = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and left == {d for d, t in texts.items() if "vile" not in (t or "").lower()}

    single = stage["exact_dedup"](spark, docs, folder)
    groups = {}
    for d, t in texts.items():
        groups.setdefault((t or "").lower(), []).append(d)
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == {max(g) for g in groups.values()}

    near = stage["ngram_jaccard_join"](spark, docs, folder)
    expected = {c if n else d for d, n, c in brute_components(sorted(texts.items()), 5, 80)}
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == sorted(expected)

    mixed = stage["mixing"](spark, docs, folder)
    words = lambda df: df.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert mixed.columns == docs.columns and mixed.count() == mixed.select("doc_id").distinct().count()
    assert 0.8 * words(docs) < words(mixed) <= 0.9 * words(docs)

    pieces = stage["packing"](spark, docs, folder).collect()
    assert {r["doc_id"] for r in pieces} == set(texts) and all(0 <= r["ids_crc32"] <= 0xFFFFFFFF for r in pieces)
    assert zlib.crc32(b"\0\0\0\0") in {r["ids_crc32"] for r in pieces if r["doc_id"] == 3000}


def test_run_chains_the_stages(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"] for r in found}
    assert not any(d % 1000 % 5 == 0 and d < 3000 for d in kept) and not any(1000 + d in kept for d in kept if d < 160)
    assert not any(2000 + d in kept for d in kept if d < 160) and len(kept) > 90


def test_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
