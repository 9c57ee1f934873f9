"""Fill-in-the-middle against brute force over code points."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwatch.llm import middle
from listwatch.llm.middle import Boundaries, FillInMiddle, WaveletMatrix


def brute(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i: 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("length", [0, 1, 63, 64, 65, 1000])
def test_ranks_count_symbols(length):
    rng = np.random.default_rng(length)
    for bits in (1, 2, 5):
        symbols = rng.integers(0, 1 << bits, length, dtype=np.uint8)
        matrix = WaveletMatrix(symbols, bits)
        at = np.arange(length + 1)
        for s in range(1 << bits):
            assert (matrix.rank(s, at) == np.concatenate([[0], np.cumsum(symbols == s)])).all()


def test_places_lie_behind_their_units():
    texts = ["", "ab", "ab cd", "é", "aé b", "", "日本 语x", "a\n\nb1c", "z"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    bounds = Boundaries(np.frombuffer(data, np.uint8), offsets)
    units = [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert bounds.units.tolist() == [len(u) for u in units]
    for k in range(8):
        at = bounds.after(np.minimum(k, bounds.units))
        assert [data[s:e].decode() for s, e in zip(offsets, at)] == ["".join(u[:k]) for u in units]
        assert bounds.points(bounds.starts, at).tolist() == [len("".join(u[:k])) for u in units]


@pytest.mark.parametrize("chunk", [1, 50, 1 << 22])
def test_outputs_equal_brute_force_and_restore(spark, monkeypatch, chunk):
    monkeypatch.setattr(middle, "MATRIX_BYTES", chunk)
    rng = random.Random(chunk)
    pieces = ["word", "X", " ", "\n", "é", "日本", "1", "<", "<S", "<P", ">", "\x00", "😀", "á"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(None, "null id"), (500, None), (501, ""), (502, "has <M> inside"), (503, "tie"), (503, "tie"), (-4, "x"), (504, " "),
             (505, "é long text " * 40_000), (506, "letters" * 50_000)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, form string, n int")
    fill = FillInMiddle()
    found = fill.transform(docs).withColumn("back", fill.restored(F.col("output"), F.col("form"))).collect()
    expected = [brute(d, t) for d, t in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:-1] for r in found), key=key) == sorted(expected, key=key)
    assert {e[2] for e in expected} == {"plain", "psm", "spm"}
    assert sorted(r["back"] for r in found) == sorted(t or "" for _, t in rows)


def test_empty_table_and_text_ids(spark):
    fill = FillInMiddle()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill.transform(empty).count() == 0
    named = spark.createDataFrame([("a/b", "some text here")], "name string, body string")
    row = FillInMiddle(id="name", text="body").transform(named).first()
    assert row["name"] == "a/b" and row["n"] == 5


def test_sentinels_that_overlap_are_refused():
    for marks in (("<P>", "<S>", ""), ("aa", "b", "c"), ("<P", "P>", "x"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            FillInMiddle(prefix=marks[0], suffix=marks[1], middle=marks[2])
