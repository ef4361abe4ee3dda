"""Streams against their batch twins, late rows, and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusweave.sources.bindings import bound
from corpusweave.streaming import changes as ch, progress as pr, requests as rq

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, 12)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def replay(spark, tmp_path):
    """Write frames as files that arrive one per batch and read them as a stream."""
    count = iter(range(1000))

    def make(*frames):
        folder = str(tmp_path / f"in{next(count)}")
        for i, frame in enumerate(frames):
            frame.coalesce(1).write.parquet(f"{folder}/{i:03d}")
        stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        return stream.parquet(folder)

    return make


def drain(spark, df, tmp_path, mode="append"):
    name = f"out{abs(hash(str(tmp_path)))}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name), query


REQ = "request_id bigint, plugin string, ok boolean, ms double, ts timestamp"


def test_windowed_metrics_match_batch(spark, replay, tmp_path):
    requests = bound(spark, SF, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = requests.select(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    early = requests.filter(F.unix_micros("ts") <= cut)
    late = requests.filter(F.unix_micros("ts") > cut)
    end = spark.createDataFrame([(0, "end", True, 0.0, dt.datetime(2030, 1, 1))], REQ)
    out, _ = drain(spark, rq.windowed_metrics(replay(early, late, end), "1 hour"), tmp_path)
    want = rq.windowed_metrics(requests, "1 hour")
    got = out.filter("plugin <> 'end'")
    assert sorted(got.collect()) == sorted(want.collect())


def test_rows_behind_the_watermark_are_dropped(spark, replay, tmp_path):
    rows = lambda *r: spark.createDataFrame([(i, "p", True, 1.0, at(s)) for i, s in r], REQ)
    # Late rows are judged by the watermark of the batch before, so one more batch lies between.
    hours = 4 * 3600
    stream = replay(rows((1, 0), (2, 60)), rows((3, hours)), rows((7, hours + 1)), rows((4, 30), (5, hours + 5)), rows((6, 9 * 3600)))
    out, query = drain(spark, rq.windowed_metrics(stream, "1 hour", delay="10 minutes"), tmp_path)
    got = {r.window_start: r.requests for r in out.collect()}
    assert got == {at(0): 2, at(hours): 3}
    dropped = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    assert dropped == 1


def test_pairing(spark, replay, tmp_path):
    sent = "request_id bigint, req_ts timestamp"
    back = "request_id bigint, resp_ts timestamp"
    a = replay(spark.createDataFrame([(1, at(0)), (2, at(1)), (3, at(2))], sent), spark.createDataFrame([(9, at(9000))], sent))
    b = replay(spark.createDataFrame([(1, at(5)), (2, at(100))], back), spark.createDataFrame([(9, at(9001))], back))
    out, _ = drain(spark, rq.pair_requests(a, b), tmp_path)
    got = {r.request_id: (r.status, r.ms) for r in out.collect()}
    assert got == {1: ("answered", 5000.0), 2: ("timeout", None), 3: ("timeout", None), 9: ("answered", 1000.0)}


PROGRESS = "token string, kind string, title string, message string, ts timestamp, event_id bigint"


def events(spark, *rows):
    return spark.createDataFrame([(t, k, title, m, at(s), i) for i, (t, k, title, m, s) in enumerate(rows)], PROGRESS)


STEPS = [
    ("a", "begin", "Index", "start", 0), ("a", "report", None, "half", 1), ("b", "report", None, "lost", 1),
    ("a", "end", None, "done", 2), ("a", "report", None, "ghost", 3), ("c", "begin", "Lint", "go", 3), ("d", "end", None, "x", 4),
    ("d", "begin", "Again", "y", 5)]


def test_progress_states(spark, replay, tmp_path):
    frame = events(spark, *STEPS)
    want = {("a", "completed", None, "done"), ("b", "in_progress", "Unknown", "lost"), ("c", "in_progress", "Lint", "go"),
            ("d", "in_progress", "Again", "y")}
    pick = lambda df: {(r.token, r.state, r.title, r.message) for r in df.collect()}
    assert pick(pr.progress_state(frame)) == want
    stream = replay(frame.filter("event_id < 3"), frame.filter("event_id between 3 and 5"), frame.filter("event_id > 5"))
    out, _ = drain(spark, pr.progress_state(stream), tmp_path, "complete")
    assert pick(out) == want


def test_stalled(spark, replay, tmp_path):
    rows = [("a", "begin", "A", "", 0), ("a", "end", None, "", 10), ("b", "begin", "B", "", 0), ("b", "end", None, "", 100), ("c", "begin", "C", "", 1)]
    frame = events(spark, *rows)
    close = spark.createDataFrame([("z", "begin", "Z", "", at(9000), 90), ("z", "end", None, "", at(9001), 91)], PROGRESS)
    assert {r.token for r in pr.stalled_tasks(frame).collect()} == {"b", "c"}
    out, _ = drain(spark, pr.stalled_tasks(replay(frame, close)), tmp_path)
    assert {(r.token, r.state, r.reason) for r in out.collect()} == {("b", "failed", "timeout"), ("c", "failed", "timeout")}


def test_throttling_and_write_units(spark, replay, tmp_path):
    schema = "project string, path string, ts timestamp"
    frame = spark.createDataFrame([("p", "a", at(0)), ("p", "a", at(1)), ("p", "b", at(1)), ("p", "a", at(2))], schema)
    end = spark.createDataFrame([("z", "z", at(9000))], schema)
    out, _ = drain(spark, ch.throttled_changes(replay(frame, end)), tmp_path)
    got = sorted((r.refresh_start, r.path, r.changes) for r in out.filter("project = 'p'").collect())
    assert got == [(at(0), "a", 2), (at(0), "b", 1), (at(2), "a", 1)]
    ops = "op_id bigint, path string, created_at timestamp"
    frame = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(30)), (3, "a", at(500)), (4, "b", at(0))], ops)
    end = spark.createDataFrame([(9, "z", at(90000))], ops)
    out, _ = drain(spark, ch.batched_write_units(replay(frame, end), 60), tmp_path / "second")
    units = sorted((r.path, r.operations, r.first_op, r.last_op) for r in out.filter("path <> 'z'").collect())
    assert units == [("a", 1, 3, 3), ("a", 2, 1, 2), ("b", 1, 4, 4)]
    twin = ch.batched_write_units(frame, 60)
    assert sorted((r.path, r.operations, r.first_op, r.last_op) for r in twin.collect()) == units
    rows = ch.batched_writes(frame, 60)
    assert sorted((r.op_id, r.unit, r.position) for r in rows.collect()) == [(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 1, 1)]


def test_stream_rewrite(spark, replay, tmp_path):
    docs = bound(spark, SF, "files").select("path", "content")
    out, _ = drain(spark, ch.stream_find_replace(replay(docs), "and", "und"), tmp_path)
    assert out.filter(F.col("new_content") != F.replace("content", F.lit("and"), F.lit("und"))).isEmpty() and out.count() == docs.count()


def test_index_follows_new_versions(spark, replay, tmp_path):
    schema = "path string, content string, sha256 string, modified_at timestamp"
    version = lambda *v: spark.createDataFrame([(p, c, str(hash(c)), at(s)) for p, c, s in v], schema)
    first = version(("a.ts", "import { b } from './b';", 0), ("b.ts", "", 0), ("c.ts", "import { b } from './b';", 0))
    second = version(("a.ts", "import { c } from './c';", 5), ("c.ts", "import { b } from './b';", 0))
    stored = {-1: (spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "path string"))}

    def store(edges, files, batch_id):
        place = str(tmp_path / f"v{batch_id}")
        edges.write.mode("overwrite").parquet(place + "e")
        files.write.mode("overwrite").parquet(place + "f")
        stored[batch_id] = (spark.read.parquet(place + "e"), spark.read.parquet(place + "f"))

    writer = ch.stream_index(replay(first, second), lambda: stored[max(stored)], store)
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    edges = stored[max(stored)][0]
    assert sorted(tuple(r) for r in edges.collect()) == [("a.ts", "c.ts"), ("c.ts", "b.ts")]


VERSION = "path string, content string, sha256 string, modified_at timestamp, deleted boolean"


def versions(spark, *rows):
    return spark.createDataFrame([(p, c, str(hash(c)), at(s), c is None) for p, c, s in rows], VERSION)


def imports(name):
    return f"import {{\n  x\n}} from './{name}';"


def test_edge_store_follows_versions(spark, tmp_path):
    from corpusweave.streaming.edge_store import EdgeStore

    store = EdgeStore(spark, str(tmp_path / "store"), 4)
    edges = lambda: sorted(tuple(r) for r in store.edges().collect())
    first = versions(spark, ("a.ts", imports("b"), 0), ("b.ts", "", 0), ("c.ts", imports("b"), 0), ("e.ts", imports("later"), 0))
    store.apply(first, 0)
    assert edges() == [("a.ts", "b.ts"), ("c.ts", "b.ts")]
    store.apply(versions(spark, ("a.ts", imports("c"), 10), ("c.ts", "", -5)), 1)
    assert edges() == [("a.ts", "c.ts"), ("c.ts", "b.ts")]  # c.ts came late and is not taken
    changed = spark.read.parquet(f"{store.path}/delta").filter("batch = 1")
    assert [r.src for r in changed.collect()] == ["a.ts"]
    store.apply(versions(spark, ("a.ts", imports("b"), 20), ("a.ts", imports("c"), 15)), 2)
    assert edges() == [("a.ts", "b.ts"), ("c.ts", "b.ts")]  # back to the first text
    store.apply(versions(spark, ("b.ts", None, 30)), 3)
    assert edges() == []
    store.compact()
    store.apply(versions(spark, ("b.ts", "", 25)), 4)
    assert edges() == [] and sorted(r.path for r in store.files().collect()) == ["a.ts", "c.ts", "e.ts"]  # from before the removal
    store.apply(versions(spark, ("b.ts", "", 40), ("later.ts", "", 40)), 5)
    want = [("a.ts", "b.ts"), ("c.ts", "b.ts"), ("e.ts", "later.ts")]
    assert edges() == want
    store.apply(versions(spark, ("b.ts", "", 40), ("later.ts", "", 40)), 5)  # a batch that comes twice
    store.apply(first, 0)
    assert edges() == want
    store.compact()
    assert edges() == want and sorted(tuple(r) for r in store.importers(spark.createDataFrame([("later.ts",)], "path string")).collect()) == want[2:]


def test_edge_store_on_a_stream(spark, replay, tmp_path):
    from corpusweave.streaming.edge_store import EdgeStore, stream_edges

    store = EdgeStore(spark, str(tmp_path / "store"), 2)
    steps = [versions(spark, ("a.ts", imports("b"), 0), ("b.ts", "", 0)), versions(spark, ("b.ts", None, 5)), versions(spark, ("b.ts", "", 9), ("c.ts", imports("a"), 9))]
    query = stream_edges(replay(*steps), store, compact_every=2).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    assert sorted(tuple(r) for r in store.edges().collect()) == [("a.ts", "b.ts"), ("c.ts", "a.ts")]


SHARES = PROGRESS + ", percentage int"


def test_percentages_and_alerts(spark):
    rows = [("a", "begin", "A", "x", at(0), 0, 0), ("a", "report", None, "y", at(5), 1, 40), ("b", "begin", "B", "x", at(0), 2, None), ("b", "report", None, "y", at(20), 3, 70),
            ("b", "end", None, "z", at(40), 4, None), ("b", "report", None, "ghost", at(41), 5, 99), ("c", "begin", "C", "x", at(0), 6, 10), ("c", "end", None, "", at(30), 7, None)]
    frame = spark.createDataFrame(rows, SHARES)
    assert {(r.token, r.state, r.percentage) for r in pr.progress_state(frame).collect()} == {("a", "in_progress", 40), ("b", "completed", None), ("c", "completed", None)}
    got = {(r.token, r.level, r["at"]) for r in pr.task_alerts(frame).collect()}
    assert got == {("a", "warning", at(30)), ("a", "failed", at(300)), ("b", "warning", at(30))}


def test_tracked_tasks(spark, replay, tmp_path):
    from corpusweave.streaming import task_tracker as tt

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, tt.ROCKSDB)
    try:
        row = lambda i, t, k, s, share=None: (t, k, t.upper() if k == "begin" else None, f"{k}{i}", at(s), i, share)
        steps = [
            [row(0, "a", "begin", 0, 0), row(1, "a", "report", 5, 40), row(2, "b", "begin", 0), row(3, "u", "report", 2, 7), row(4, "c", "begin", 1)],
            [row(5, "a", "end", 20), row(6, "z", "begin", 60)],
            [row(7, "a", "report", 61, 99), row(8, "z", "end", 62)],  # a ghost; b and c are slow by now
            [row(9, "c", "end", 70), row(10, "y", "begin", 400)],  # b times out
            [row(11, "b", "end", 401), row(12, "y", "end", 401)],  # too late for b
            [row(13, "x", "begin", 5000)], [row(14, "x", "end", 5001)]]
        frames = [spark.createDataFrame(s, SHARES) for s in steps]
        out, query = drain(spark, tt.tracked_tasks(replay(*frames)), tmp_path, "update")
        rows = out.collect()
        states = lambda t: [(r.state, r.level, r.percentage) for r in rows if r.token == t]
        assert states("a") == [("in_progress", "progress", 40), ("completed", "progress", None)]
        assert states("b") == [("in_progress", "progress", None), ("in_progress", "warning", None), ("failed", "failed", None)]
        assert states("c") == [("in_progress", "progress", None), ("in_progress", "warning", None), ("completed", "progress", None)]
        assert [(r.title, r.percentage) for r in rows if r.token == "u"] == [("Unknown", 7)]
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.unionByName(f)
        alerts = {(r.token, r.level, r["at"]) for r in pr.task_alerts(whole).collect() if r.token in "abc"}
        assert {(r.token, r.level, r["at"]) for r in rows if r.level != "progress"} == alerts
        kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        assert kept[-1] <= 2 < max(kept)  # tokens that are over have left the state
    finally:
        spark.conf.set(key, before)
