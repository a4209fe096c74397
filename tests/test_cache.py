import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators import cache as op, expiry
from tidemark.operators.ordered import neighbour, numbered
from tidemark.streaming import runs, ttl

REQ = "cache_key string, us bigint, id bigint, client string, private boolean"


def brute(rows, ttl_us):
    out, live = {}, {}
    for key, us, rid, client, private in sorted(rows, key=lambda r: (r[1], r[2])):
        if private:
            out[rid] = ("MISS", client)
            continue
        expiry, owner = live.get(key, (None, None))
        if expiry is None or us >= expiry:
            live[key] = (us + ttl_us, client)
            out[rid] = ("MISS", client)
        else:
            out[rid] = ("HIT", owner)
    return out


def labelled(df):
    return {r.id: (r.status, r.owner) for r in df.collect()}


@pytest.mark.parametrize("ttl_us,span", [(50, 4), (997, 2), (1000, 16), (7, 64), (40_000, 8)])
def test_replay_equals_brute_force(spark, ttl_us, span):
    rnd = random.Random(ttl_us)
    # One key holds a third of the rows, times collide, some rows are private.
    rows = [
        (
            "hot" if i % 3 == 0 else f"k{rnd.randrange(5)}", rnd.randrange(20_000) - 5_000, i,
            f"c{rnd.randrange(9)}", rnd.random() < 0.1,
        )
        for i in range(3_000)
    ]
    df = spark.createDataFrame(rows, REQ).repartition(5)
    assert labelled(op.ttl_replay(df, ttl_us, span)) == brute(rows, ttl_us)


def test_a_hot_key_over_a_year_is_cut_into_slices(spark):
    """A TTL of 5 s over a year, nine tenths of the rows in one key: all of them are cut, none is walked whole."""
    year, ttl_us, n = 365 * 86_400 * 1_000_000, 5_000_000, 60_000
    rnd = random.Random(5)
    rows = []
    for i in range(n):  # bursts, so that chains of fills meet and part
        at = rnd.randrange(400) * (year // 400) + rnd.randrange(900_000_000)
        rows.append(("hot" if i % 10 else f"k{rnd.randrange(40)}", at, i, f"c{i % 7}", False))
    df = spark.createDataFrame(rows, REQ).repartition(6)
    assert labelled(op.ttl_replay(df, ttl_us)) == brute(rows, ttl_us)
    sizes = df.groupBy("cache_key", op.floor_div(F.col("us"), 16 * ttl_us)).count()
    assert sizes.agg(F.max("count")).first()[0] < n / 1000


@pytest.mark.parametrize("ttl", [1, 5, 40, 333])
def test_maps_of_slices_compose_to_the_walk(ttl):
    rnd = random.Random(ttl)
    times = np.unique([rnd.randrange(2000) for _ in range(300)])

    def walk(expiry, chosen):
        for t in chosen.tolist():
            if t >= expiry:
                expiry = t + ttl
        return expiry

    for cuts in ([0, 2000], [0, 700, 2000], [0, 100, 200, 900, 1500, 2000]):
        whole = None
        for a, b in zip(cuts, cuts[1:]):
            part = times[(times >= a) & (times < b)]
            if len(part):
                own = expiry.slice_map(part, a, ttl)
                assert all(expiry.applied(*own, np.array([e]))[0] == walk(e, part) for e in range(a - 3, a + ttl + 1))
                whole = own if whole is None else expiry.composed(whole, own, ttl)
        assert all(expiry.applied(*whole, np.array([e]))[0] == walk(e, times) for e in [expiry.NEVER, *range(-3, ttl + 1)])
        assert len(whole[0]) <= (times <= ttl).sum() + 1


def test_fills_of_odd_tables(spark):
    none = spark.createDataFrame([], REQ)
    assert expiry.fills(none, 10).collect() == [] and op.ttl_replay(none, 10).collect() == []
    rows = [("k", 5, 2, "b", False), ("k", 5, 1, "a", False), ("k", 15, 3, "c", False), ("", 5, 4, "d", False), ("k", -900, 5, "e", False)]
    assert sorted(r.id for r in expiry.fills(spark.createDataFrame(rows, REQ), 10, 2).collect()) == [1, 3, 4, 5]


def test_published_stages(spark):
    """Four requests in a row: shared key, key with user, private responses."""
    asks = [("alice", 1), ("bob", 2), ("carol", 3), ("alice", 4)]

    def replay(key, private=False):
        rows = [(key(c), t * 1_000_000, t, c, private) for c, t in asks]
        log = op.ttl_replay(spark.createDataFrame(rows, REQ), 300 * 1_000_000)
        log = log.withColumn("verdict", op.verdict(F.col("client"), F.col("owner")))
        answers = {r.owner: r.n for r in op.origin_answers(log).collect()}
        return [(r.status, r.verdict) for r in log.orderBy("id").collect()], answers

    leak, own = "LEAK: alice's doors", "own doors"
    seen, answers = replay(lambda c: "/v1/devices")
    assert seen == [("MISS", own), ("HIT", leak), ("HIT", leak), ("HIT", own)] and answers == {"alice": 1}
    seen, answers = replay(lambda c: f"/v1/devices {c}")
    assert [s for s, _ in seen] == ["MISS", "MISS", "MISS", "HIT"] and sum(answers.values()) == 3
    seen, answers = replay(lambda c: "/v1/devices", private=True)
    assert [s for s, _ in seen] == ["MISS"] * 4 and sum(answers.values()) == 4
    assert all(v == own for _, v in seen)


def test_runs_of_a_hand_made_log(spark):
    log = spark.createDataFrame(
        [("k", t * 1_000_000, t, "x", s, o) for t, (s, o) in enumerate(
            [("HIT", "A"), ("HIT", "A"), ("HIT", "B"), ("MISS", "C"), ("HIT", "B"), ("HIT", "A")])],
        "cache_key string, us bigint, id bigint, client string, status string, owner string",
    )
    for bucket in (1, 2_000_000, 10**9):
        runs_ = op.owner_runs(log, bucket)
        assert [r.owner for r in runs_.orderBy("us").collect()] == ["A", "B", "A"]
        assert op.run_repeats(runs_).first()["repeats"] == 1
        assert [r.seconds for r in op.run_stretches(runs_, bucket).orderBy("us").collect()] == [2.0, 3.0]
        got = [(r.account, r.n) for r in op.client_runs(log, bucket).orderBy("run_no").collect()]
        assert got == [("A", 2), ("B", 1), ("C", 1), ("B", 1), ("A", 1)]
    assert op.client_run_summary(log).first()["saw"] == "A x2, B x1, C x1, B x1, A x1"


def test_stitched_windows_equal_plain_windows(spark):
    rnd = random.Random(3)
    rows = [(None if rnd.random() < 0.1 else f"k{rnd.randrange(3)}", rnd.randrange(1000), i, rnd.randrange(4)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, us bigint, id bigint, v int")
    bucket = op.floor_div(F.col("us"), 50)
    w = Window.partitionBy("k").orderBy("us", "id")
    want = df.select(
        "id", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.row_number().over(w).alias("r")
    ).orderBy("id").collect()
    got = neighbour(df, ["k"], ["us", "id"], bucket, ["v"], "p")
    got = neighbour(got, ["k"], ["us", "id"], bucket, ["v"], "n", ahead=True)
    got = numbered(got, ["k"], ["us", "id"], bucket, "r")
    got = got.select("id", F.col("p.v").alias("p"), F.col("n.v").alias("n"), "r").orderBy("id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    rnd = random.Random(5)
    rows = sorted((rnd.randrange(10_000), i) for i in range(600))
    rows = [("hot" if i % 3 else f"k{i % 5}", us, i, f"c{i % 7}", False) for us, i in rows]
    for part in range(6):
        chunk = rows[part * 100:(part + 1) * 100]
        spark.createDataFrame(chunk, REQ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = runs.file_stream(spark, runs.in_time_order(spark.read.parquet(str(tmp_path / "in")), "us", "order-test"), spark.read.parquet(str(tmp_path / "in")).schema, 2)
    got = runs.run_append(ttl.ttl_replay_stream(stream, 500), "stream-test")
    assert labelled(got) == brute(rows, 500)


def test_late_rows_are_told_apart(spark, tmp_path):
    for part, times in enumerate(([10, 20], [5, 30])):
        spark.createDataFrame([("k", us, us, "c", False) for us in times], REQ).coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
        source = spark.read.parquet(str(tmp_path / f"in{part}"))
        source.coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
    stream = runs.file_stream(spark, str(tmp_path / "all"), source.schema, 1)
    got = labelled(runs.run_append(ttl.ttl_replay_stream(stream, 15), "late-test"))
    assert got == {10: ("MISS", "c"), 20: ("HIT", "c"), 5: ("LATE", None), 30: ("MISS", "c")}


def test_stream_queries_read_a_folder_of_unordered_files(spark, data, tmp_path):
    """Eight part files in no order of time give what the table as one file gives."""
    from tidemark.plans import REGISTRY

    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("ttl_replay_stream", "leak_monitor"):
        rows = [sorted(map(str, REGISTRY[name].run(spark, str(d)).collect())) for d in (data, tmp_path)]
        assert rows[0] == rows[1] and rows[0]
    batch = REGISTRY["ttl_replay"].run(spark, data)
    assert sorted(map(str, batch.collect())) == sorted(map(str, REGISTRY["ttl_replay_stream"].run(spark, str(tmp_path)).select(*batch.columns).collect()))


def test_leak_monitor_counts_every_window(spark, tmp_path):
    rows = [(t * 3600, "k", t % 3, t % 2) for t in range(100)]
    df = spark.createDataFrame(rows, "s bigint, cache_key string, client bigint, owner bigint")
    df = df.select(F.timestamp_seconds("s").alias("at"), "cache_key", "client", "owner")
    for i in range(4):
        df.filter(F.floor(F.hour("at") / 6) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = runs.file_stream(spark, str(tmp_path / "in"), df.schema, 1)
    got = runs.run_update(runs.leak_monitor(stream), ["start_us", "cache_key"], "monitor-test")
    want = df.groupBy(F.unix_micros(F.date_trunc("day", "at")).alias("d")).agg(
        F.count("*").alias("n"), F.count_if(F.col("client") != F.col("owner")).alias("f")
    )
    assert {(r.start_us, r.polls, r.foreign_polls) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_rows_behind_the_watermark_fail_the_drain(spark, tmp_path):
    for s in (10**6, 2 * 10**6, 0):
        df = spark.createDataFrame([(s, "k", 1, 2)], "s bigint, cache_key string, client bigint, owner bigint").select(F.timestamp_seconds("s").alias("at"), "cache_key", "client", "owner")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = runs.file_stream(spark, str(tmp_path / "in"), df.schema, 1)
    with pytest.raises(ValueError, match="1 rows came later"):
        runs.run_update(runs.leak_monitor(stream, lateness="1 hour"), ["start_us", "cache_key"], "late-monitor")


def test_files_in_time_order_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(runs, "FILE_ROWS", 500, raising=False)
    rows = [("hot" if i % 3 else f"k{i % 5}", i * 7, i, f"c{i % 7}", False) for i in range(12_000)]
    folder = runs.in_time_order(spark.createDataFrame(rows, REQ), "us", "slices-test")
    files = spark.read.parquet(folder).groupBy("_metadata.file_name", "_metadata.file_modification_time").agg(F.count("*").alias("n"), F.min("us").alias("low"), F.max("us").alias("high"))
    files = files.orderBy("file_modification_time").collect()
    assert sum(f.n for f in files) == 12_000 and max(f.n for f in files) <= 1000
    assert all(a.high < b.low for a, b in zip(files, files[1:]))


def test_micro_batches_are_few_and_frames_small(spark):
    rows = spark.range(1_200_000).selectExpr("id AS us", "id")
    folder = runs.in_time_order(rows, "us", "few-test")
    assert spark.read.parquet(folder).select(F.input_file_name()).distinct().count() == 8

    class Entry:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)

    from pyspark.sql import types as T

    entry = ttl.TtlEntry(10, T.LongType())
    entry.entry = Entry()
    n = 2 * ttl.FRAME_ROWS + 1
    frame = pd.DataFrame({"us": range(n), "id": range(n), "client": range(n)})
    out = list(entry.handleInputRows(("k",), iter([frame]), None))
    assert [len(f) for f in out] == [ttl.FRAME_ROWS, ttl.FRAME_ROWS, 1]
    whole = pd.concat(out)
    assert list(whole["owner"]) == [i // 10 * 10 for i in range(n)] and (whole["status"] == "MISS").sum() == -(-n // 10)
