"""Streams over several micro-batches: late, repeated and invalid rows, restarts and expiry."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspan.operators import conversation as C
from quillspan.sources import lines, telemetry
from quillspan.streaming import claims, keyed, trips

from test_conversation import brute, made

START = datetime(2026, 1, 1)
TURN = "conv_id long, place string, reply string, at timestamp"


@pytest.fixture
def feed(spark, tmp_path):
    """Files of a stream, one for each micro-batch."""

    class Feed:
        def __init__(self):
            self.path, self.n = tmp_path / "in", 0
            self.path.mkdir()

        def put(self, rows, schema):
            self.n += 1
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"made{self.n}"))
            part = next((tmp_path / f"made{self.n}").glob("part-*.parquet"))
            part.rename(self.path / f"{self.n:04d}.parquet")
            return self

        def stream(self, schema):
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(self.path))

    return Feed()


def run(df, path, mode="update"):
    """A stream over what has come, each micro-batch appended with its number; the table so far."""
    def write(batch, number):
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/{number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/out/*")


def turn(conv, i, reply, minutes=None):
    return (conv, f"{i:04d}", reply, START + timedelta(minutes=i if minutes is None else minutes))


def test_a_stream_ends_with_the_state_of_the_batch_fold(spark, feed, tmp_path):
    said = {c: made(c, 12) for c in range(8)}
    rows = [turn(c, i, reply) for c, replies in said.items() for i, reply in enumerate(replies)]
    random.Random(3).shuffle(rows)
    for i in range(4):
        feed.put(rows[i::4] + rows[i:8:4], TURN)  # some turns come twice
    with trips.state_store(spark):
        out = run(trips.trip_states(feed.stream(TURN), "30 days", 10**10), tmp_path)
    got = {r.conv_id: r for r in trips.latest_states(out).collect()}
    names = [p.split(" ")[0] for p in C.SHOWN.split(", ")]
    for c, replies in said.items():
        want = dict(zip(names, brute(replies)[-1]))
        want = {k: sorted(v) if isinstance(v, list) else v for k, v in want.items()}
        assert {k: got[c][k] for k in names} == want and got[c].status == "open"


def test_a_restart_goes_on_from_the_checkpoint(spark, feed, tmp_path):
    replies = made(5, 9)
    with trips.state_store(spark):
        for i in range(0, 9, 3):
            feed.put([turn(1, j, replies[j]) for j in range(i, i + 3)], TURN)
            out = run(trips.trip_states(feed.stream(TURN), "30 days", 10**10), tmp_path)
    last = trips.latest_states(out).first()
    assert last.turns == 9 and last.destination == brute(replies)[-1][0] and out.select("__batch").distinct().count() >= 3


def test_an_invalid_update_leaves_the_state_and_an_idle_one_expires(spark, feed, tmp_path):
    feed.put([turn(1, 0, json.dumps({"destination": "Hue"})), turn(2, 0, json.dumps({"destination": "Hoi An"}))], TURN)
    feed.put([turn(1, 1, '{"destination": 3}'), turn(1, 2, '{"destination": "Da'), turn(2, 1, None)], TURN)
    feed.put([turn(2, 300, json.dumps({"selected_places": ["bridge"]}))], TURN)
    feed.put([turn(2, 301, "{}")], TURN)
    feed.put([turn(1, 302, json.dumps({"temporary_budget": "low"}))], TURN)
    with trips.state_store(spark):
        out = run(trips.trip_states(feed.stream(TURN), "1 minute", 60 * 60 * 1000), tmp_path)
    first = [(r.destination, r.turns, r.kept_out, r.status) for r in out.filter("conv_id = 1").orderBy("__batch", "status").collect()]
    assert first[:2] == [("Hue", 1, 0, "open"), ("Hue", 3, 2, "open")] and ("Hue", 3, 2, "expired") in first
    assert first[-1] == (None, 1, 0, "open")  # a new life
    second = trips.latest_states(out.filter("conv_id = 2")).first()
    assert second.selected_places == ["bridge"] and second.destination == "Hoi An"


EVENT = "id long, k string, at timestamp, v long"


def event(i, k, minutes, v=0):
    return (i, k, START + timedelta(minutes=minutes), v)


def test_a_cache_answers_until_an_entry_runs_out(spark, feed, tmp_path):
    """Entries (v = 0) and requests (v = 1) in four micro-batches, some rows twice, some out of order, one too late."""
    feed.put([event(1, "a", 0), event(2, "b", 5), event(10, "a", 3, 1)], EVENT)
    feed.put([event(1, "a", 0), event(11, "a", 61, 1), event(12, "b", 64, 1), event(10, "a", 3, 1), event(3, "c", 58)], EVENT)
    feed.put([event(13, "c", 57, 1), event(14, "c", 60, 1), event(4, "a", 62), event(15, "a", 90, 1)], EVENT)
    feed.put([event(16, "a", 400, 1), event(5, "a", 399)], EVENT)
    feed.put([event(17, "a", 2, 1), event(6, "a", 1)], EVENT)  # long after the watermark: they meet nothing
    rows = lambda v: feed.stream(EVENT).filter(f"v = {v}").select("id", "k", "at")
    out = run(keyed.cache_hits(rows(1), rows(0), ["k"], "60 MINUTES"), tmp_path, "append")
    got = sorted((r.request.id, r.entry.id) for r in out.collect())
    assert got == [(10, 1), (12, 2), (14, 3), (15, 4), (16, 5)]


def test_rows_come_through_once_within_the_delay(spark, feed, tmp_path):
    feed.put([event(1, "a", 0), event(2, "b", 1), event(1, "a", 0)], EVENT).put([event(1, "a", 0), event(3, "c", 2)], EVENT).put([event(2, "b", 1), event(4, "d", 500)], EVENT)
    feed.put([event(5, "e", 501)], EVENT).put([event(9, "late", 3), event(6, "f", 502)], EVENT)
    out = run(keyed.once(feed.stream(EVENT), ["id"], "at", "10 minutes"), tmp_path, "append")
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5, 6]


def test_the_latest_stage_of_each_key_is_upserted_batch_by_batch(spark, feed, tmp_path):
    r = random.Random(2)
    rows = [event(i, r.choice("abcde"), r.randrange(1000), r.randrange(100)) for i in range(80)]
    for i in range(5):
        feed.put(rows[i * 16 : i * 16 + 16] + rows[:3], EVENT)
    table = keyed.StageTable(spark, str(tmp_path / "stages"), ["k"], "at", EVENT)
    q = feed.stream(EVENT).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(table.write).start()
    q.awaitTermination()
    want = {k: max((x[2], x[0]) for x in rows if x[1] == k) for k in "abcde"}
    held = lambda: {x.k: (x.at, x.id) for x in table.read().collect()}
    assert held() == want and table.numbers() == [0, 1, 2, 3, 4]
    table.write(spark.createDataFrame(rows[16:32] + rows[:3], EVENT), 1)  # the same batch again
    assert held() == want
    table.compact(3)
    assert held() == want and table.numbers() == [3, 4]


def test_a_failed_epoch_leaves_no_line_and_none_comes_twice(spark, feed, tmp_path):
    spark.dataSource.register(lines.Lines)
    out = str(tmp_path / "lines")

    def write(**options):
        q = feed.stream(EVENT).writeStream.format("lines").option("path", out).options(**options).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    feed.put([event(1, "a", 0), event(2, "ü\"", 1)], EVENT).put([event(3, "c", 2)], EVENT)
    with pytest.raises(Exception, match="epoch 1 fails"):
        write(fail_epoch="1")
    read = lambda: sorted(json.loads(r.value)["id"] for r in lines.committed(spark, out).collect())
    assert read() == [1, 2]
    write()
    feed.put([event(4, "d", 3)], EVENT)
    write()
    assert read() == [1, 2, 3, 4] and "ü\"" in {json.loads(r.value)["k"] for r in lines.committed(spark, out).collect()}
    again = lines.LineWriter(out, None)
    again.commit([lines.Written(None, 0)], 1)  # a commit that comes again
    assert read() == [1, 2, 3, 4]
    assert lines.committed(spark, str(tmp_path / "nothing")).count() == 0


def test_a_run_tells_what_its_stages_did(spark, feed, tmp_path):
    t = telemetry.Telemetry(spark, "r1")
    a = t.stage(spark.range(1000), "read", total=F.col("id"))
    b = t.stage(a.filter("id % 3 = 0"), "filtered")
    c = t.stage(b.groupBy((F.col("id") % 7).alias("k")).count(), "grouped")
    assert c.count() == 7
    got = {(r.stage, r.metric): r.value for r in t.events().collect()}
    assert got == {("read", "rows"): 1000, ("read", "total"): 499500, ("filtered", "rows"): 334, ("grouped", "rows"): 7}
    listener = telemetry.StreamTelemetry()
    spark.streams.addListener(listener)
    try:
        feed.put([event(i, "a", i, i) for i in range(5)], EVENT).put([event(i, "a", i, i) for i in range(5, 12)], EVENT)
        seen = feed.stream(EVENT).observe("taken", F.count(F.lit(1)).alias("rows"), F.sum("v").alias("v"))
        q = seen.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = listener.events(spark, str(q.id)).filter("stage = 'taken'").collect()
    finally:
        spark.streams.removeListener(listener)
    assert {(r.batch, r.metric): r.value for r in rows} == {(0, "rows"): 5, (0, "v"): 10, (1, "rows"): 7, (1, "v"): 56}


URL = "url string, added timestamp"
RESULT = "url string, worker string"


def test_two_workers_do_each_url_of_a_queue_once(spark, feed, tmp_path):
    now = [1000.0]
    put = lambda a, b: feed.put([(f"u{i}", START) for i in range(a, b)] + [(f"u{a}", START)], URL)

    def worker(name, most=64):
        return claims.Worker(spark, str(tmp_path / "work"), name, "url", lambda rows: rows.select("url", F.lit(name).alias("worker")), lambda: spark.read.schema(URL).parquet(str(feed.path)), RESULT, buckets=8, most=most, seconds=60, clock=lambda: now[0])

    def turn_of(w):
        q = feed.stream(URL).writeStream.option("checkpointLocation", str(tmp_path / w.name)).trigger(availableNow=True).foreachBatch(w).start()
        q.awaitTermination()

    done = lambda w: sorted(r.url for r in w.done().collect())
    urls = lambda n: sorted(f"u{i}" for i in range(n))
    a, b = worker("a", 4), worker("b", 8)
    put(0, 40)
    turn_of(a)
    assert 0 < len(done(a)) < 40
    turn_of(b)
    assert done(b) == urls(40) and {r.worker for r in b.done().collect()} == {"a", "b"}
    put(40, 80)
    turn_of(b)  # holds four buckets; the others are a's
    assert 40 < len(done(b)) < 80
    now[0] += 61  # a never comes back: its leases run out
    put(80, 100)
    turn_of(b)
    assert done(b) == urls(100)
    c = worker("c")
    turn_of(c)  # everything is done, and b's leases hold
    assert done(c) == urls(100)
    b(spark.createDataFrame([("u3", START), ("u300", START)], URL), 1)  # a batch that comes again
    assert done(b) == urls(100)
    b.stop()
    assert c.hold() == set(range(8))


def test_work_that_outlasts_its_lease_is_not_done_twice(spark, tmp_path):
    now = [0.0]
    queue = spark.createDataFrame([(f"u{i}", START) for i in range(30)], URL)
    make = lambda name, process: claims.Worker(spark, str(tmp_path), name, "url", process, lambda: queue, RESULT, buckets=4, seconds=10, clock=lambda: now[0])
    fast = make("fast", lambda rows: rows.select("url", F.lit("fast").alias("worker")))

    def slowly(rows):
        now[0] += 11  # meanwhile another takes over
        fast(queue, 0)
        return rows.select("url", F.lit("slow").alias("worker"))

    slow = make("slow", slowly)
    slow(queue, 0)
    got = [(r.url, r.worker) for r in slow.done().collect()]
    assert len(got) == 30 and {w for _, w in got} == {"fast"}
