"""Streaming jobs: several runs over one checkpoint."""

import datetime as dt

from pyspark.sql import functions as F

from listwatch.sources.keyed import KeyedTable
from listwatch.streaming import jobs as J


def t(day, hour=0):
    return dt.datetime(2026, 9, day, hour)


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_first_seen(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "guid string, at timestamp"
    state = KeyedTable(str(tmp_path / "state"), ["guid"], "guid string, first_seen timestamp", buckets=8)
    out = J.EpochTable(str(tmp_path / "out"), "guid string, at timestamp, first_seen timestamp")
    job = J.first_seen_job(state, out, "guid", lambda df: F.col("at"))
    for batch in ([("a", t(3)), ("a", t(2)), ("", t(1))], [("a", t(9)), ("b", t(9))]):
        J.run(feed(spark, src, batch, schema), job, str(tmp_path / "cp"))
    assert {(r["guid"], r["first_seen"]) for r in state.read(spark).collect()} == {("a", t(2)), ("b", t(9))}
    assert {(r["at"], r["first_seen"]) for r in out.read(spark).where("guid = 'a'").collect()} == {(t(3), t(2)), (t(2), t(2)), (t(9), t(2))}
    # A batch that runs again replaces its own files.
    job(spark.createDataFrame([("a", t(9)), ("b", t(9))], schema), 1)
    assert state.read(spark).count() == 2 and out.read(spark).count() == 4


def test_retry(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "id string, reason string, at timestamp"
    state = KeyedTable(str(tmp_path / "state"), ["id"], J.RETRY_STATE, buckets=8)
    batches = ([("x", "bez-textu", t(1)), ("y", "ai-selhani", t(1)), ("y", "ai-selhani", t(2))],
               [("x", "ai-selhani", t(3)), ("y", "", t(3)), ("z", "", t(3)), ("z", "ai-selhani", t(4))])
    for b in batches:
        J.run(feed(spark, src, b, schema), J.retry_job(state), str(tmp_path / "cp"))
    now = {r["id"]: (r["failures"], r["text_waits"], r["next_attempt"], r["done"]) for r in state.read(spark).collect()}
    assert now == {"x": (1, 1, t(3, 1), False), "y": (0, 0, None, True), "z": (1, 0, t(4, 1), False)}


def test_retry_ignores_outcomes_before_the_last_success(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "id string, reason string, at timestamp"
    state = KeyedTable(str(tmp_path / "state"), ["id"], J.RETRY_STATE, buckets=8)
    for b in ([("x", "", t(5))], [("x", "ai-selhani", t(3))], [("x", "ai-selhani", t(5)), ("x", "ai-selhani", t(6))]):
        J.run(feed(spark, src, b, schema), J.retry_job(state), str(tmp_path / "cp"))
    r = state.read(spark).first()
    assert (r["failures"], r["done"], r["ok_at"]) == (1, False, t(5))


def test_outage_with_late_checks(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "source string, at timestamp, ok boolean"
    state = KeyedTable(str(tmp_path / "state"), ["source"], J.OUTAGE_STATE, buckets=8)
    got = []
    for b in ([("s", t(3), True)], [("s", t(2), False)], [("s", t(6), False)], [("s", t(5), False)]):
        J.run(feed(spark, src, b, schema), J.outage_job(state), str(tmp_path / "cp"))
        r = state.read(spark).first()
        got.append((r["status"], r["down_since"], r["last_check"]))
    assert got == [("ok", None, t(3)), ("ok", None, t(3)), ("warning", t(6), t(6)), ("warning", t(5), t(6))]


def test_outage(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "source string, at timestamp, ok boolean"
    state = KeyedTable(str(tmp_path / "state"), ["source"], J.OUTAGE_STATE, buckets=8)
    got = []
    for b in ([("s", t(1), True)], [("s", t(2), False)], [("s", t(3, 13), False)], [("s", t(4), True)]):
        J.run(feed(spark, src, b, schema), J.outage_job(state), str(tmp_path / "cp"))
        r = state.read(spark).first()
        got.append((r["status"], r["down_since"]))
    assert got == [("ok", None), ("warning", t(2)), ("error", t(2)), ("ok", None)]


def test_change_log(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "mark string, change string, found timestamp"
    state = KeyedTable(str(tmp_path / "state"), ["mark", "change"], schema, buckets=8)
    for b in ([("1", "cas", t(2)), ("1", "cas", t(1))], [("1", "cas", t(5)), ("2", "sin", t(5))]):
        J.run(feed(spark, src, b, schema), J.change_log_job(state, "found"), str(tmp_path / "cp"))
    assert {(r["mark"], r["found"]) for r in state.read(spark).collect()} == {("1", t(1)), ("2", t(5))}


def test_state_stays_as_large_as_its_retention(spark, tmp_path):
    schema = "guid string, at timestamp"
    state = KeyedTable(str(tmp_path / "state"), ["guid"], "guid string, first_seen timestamp", buckets=4)
    out = J.EpochTable(str(tmp_path / "out"), "guid string, at timestamp, first_seen timestamp")
    start, sizes = dt.datetime(2026, 1, 1), []
    for epoch in range(20):
        now = start + dt.timedelta(days=40 * epoch)
        keep = F.lit(now - dt.timedelta(days=120)).cast("timestamp")
        items = [(f"e{epoch}-{i}", now) for i in range(30)] + [("always", now)]
        J.first_seen_job(state, out, "guid", lambda df: F.col("at"), keep)(spark.createDataFrame(items, schema), epoch)
        sizes.append(state.read(spark).count())
    assert max(sizes[8:]) <= 5 * 31 and max(map(len, state.versions(spark).values())) == 2
    # A key that is older than the retention counts as new again.
    seen = {r["first_seen"] for r in out.read(spark).where("guid = 'always'").collect()}
    assert len(seen) == 5 and start in seen


def test_keyed_table_reads_and_writes_the_buckets_of_its_batch(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["k"], "k string, v int", buckets=16)
    rows = lambda pairs: spark.createDataFrame(pairs, "k string, v int")
    table.replace(rows([(f"k{i}", i) for i in range(500)] + [(None, -1)]), 0)
    one = rows([("k7", 70)])
    assert table.replace(one, 1) == table.touched(one) and len(table.touched(one)) == 1
    for version in range(2, 6):
        table.replace(rows([("k7", 70 + version)]), version)
    # The files that a lookup opens do not become more.
    assert len(table.before(spark, buckets=table.touched(one)).inputFiles()) == 1
    assert {r["k"]: r["v"] for r in table.read(spark).collect()} == {f"k{i}": i for i in range(500)} | {"k7": 75, None: -1}
    assert {r["v"] for r in table.before(spark, 5).where("k = 'k7'").collect()} == {74}
    again = KeyedTable(str(tmp_path / "t"), ["k"], "k string, v int", buckets=3)
    assert again.buckets(spark) == 16 and again.read(spark).count() == 501
    assert KeyedTable(str(tmp_path / "none"), ["k"], "k string, v int").read(spark).count() == 0
