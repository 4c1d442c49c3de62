"""Streams in batches and with restarts: limiter, case states with expiry, late revisions; snapshots that survive failures."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from zonewright.operators import snapshots
from zonewright.streaming import streams

T0 = datetime.datetime(2024, 1, 1)


def add_file(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def recurrence(rows, limit, seconds):
    held, out = defaultdict(list), {}
    for i, t, k in sorted(rows, key=lambda r: (r[1], r[0])):
        recent = [x for x in held[k] if (t - x).total_seconds() < seconds]
        out[i] = len(recent) < limit
        held[k] = recent + [t] * out[i]
    return out


def requests(n, seed=3, keys="abc"):
    draw = random.Random(seed)
    times = sorted(draw.randrange(6000) for _ in range(n))
    return [(k, T0 + datetime.timedelta(seconds=t), draw.choice(keys)) for k, t in enumerate(times)]


REQUESTS = "request_id long, ts timestamp, who string"


def test_limiter_over_batches_and_a_restart(spark, tmp_path):
    rows, source, there = requests(400), str(tmp_path / "in"), f"file://{tmp_path}/out"
    def run():
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(source)
        return streams.run_to_end(streams.limited_requests(stream, "who", 3, 60), there, "append")
    for part in (rows[:90], rows[90:200]):
        add_file(spark, part, REQUESTS, source)
    assert run().count() == 200
    for part in (rows[200:201], rows[201:]):  # another query goes on from the checkpoint
        add_file(spark, part, REQUESTS, source)
    got = run().collect()
    assert {r.request_id: r.allowed for r in got} == recurrence(rows, 3, 60) and len(got) == 400
    assert {r.request_id: r.key for r in got} == {r[0]: r[2] for r in rows} and len({r.batch for r in got}) >= 4
    assert run().count() == 400  # nothing new, nothing twice


def test_limiter_of_a_table_is_split_at_quiet_spans(spark):
    rows = [(k, T0 + datetime.timedelta(seconds=s), "hot") for k, s in enumerate(x + d for x in range(0, 60_000, 600) for d in (0, 1, 59, 60, 61, 119, 120))]
    rows += [(10_000 + k, T0, None) for k in range(5)] + [(20_000, T0, "one")]
    got = {r.request_id: r.allowed for r in streams.rate_limited(spark.createDataFrame(rows, REQUESTS), "who", 2, 60).collect()}
    assert got == recurrence(rows, 2, 60)
    assert streams.rate_limited(spark.createDataFrame([], REQUESTS), "who").count() == 0


CASES = "case_id string, sighting long, ts timestamp, outlet string, decision string"


def test_cases_are_forgotten_unless_decided(spark, tmp_path):
    source, there = str(tmp_path / "in"), f"file://{tmp_path}/out"
    day = lambda n: T0 + datetime.timedelta(days=n)
    def run():
        stream = spark.readStream.schema(CASES).option("maxFilesPerTrigger", 1).parquet(source)
        got = streams.latest_rows(streams.run_to_end(streams.case_state(stream, 60), there), "case_id")
        return {r.case_id: (r.status, r.outlets, r.updates) for r in got.collect()}
    add_file(spark, [("p", 1, day(0), "x", None), ("q", 2, day(0), "x", None), ("q", 3, day(1), "y", None), ("done", 4, day(0), "x", "promoted"), ("no", 5, day(0), "x", "rejected"), ("kept", 6, day(0), "x", None)], CASES, source)
    assert run() == {"p": ("pending", 1, 1), "q": ("ready", 2, 2), "done": ("promoted", 1, 1), "no": ("rejected", 1, 1), "kept": ("pending", 1, 1)}
    add_file(spark, [("kept", 7, day(40), "x", None), ("done", 8, day(40), "y", None)], CASES, source)
    assert run()["kept"] == ("pending", 1, 2)
    add_file(spark, [("new", 9, day(70), "x", None)], CASES, source)
    add_file(spark, [("new", 10, day(71), "z", None)], CASES, source)  # the watermark of the batch before has passed day 61
    got = run()
    assert got["p"][0] == got["q"][0] == "dropped" and got["kept"] == ("pending", 1, 2) and got["new"] == ("ready", 2, 2)
    assert got["done"] == ("promoted", 1, 1) and got["no"] == ("rejected", 1, 1)
    add_file(spark, [("p", 11, day(72), "y", None), ("done", 12, day(72), "z", "rejected")], CASES, source)
    got = run()
    assert got["p"] == ("pending", 1, 1) and got["done"] == ("promoted", 1, 1)


TABLE = "month string, revised long, n long"


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_revisions_once_and_frozen_months(spark, tmp_path):
    there = f"file://{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, TABLE)
    snapshots.publish(frame([("2020-01", 0, 1), ("2020-05", 0, 5), ("2020-06", 9, 6)]), there, 0)
    merge = snapshots.revisions_sink(there, "month", "revised", F.lit("2020-03"))
    first = frame([("2020-01", 5, 100), ("2020-02", 5, 200), ("2020-05", 5, 500), ("2020-05", 7, 501), ("2020-06", 8, 600)])
    merge(first, 0)
    want = {("2020-01", 0, 1), ("2020-02", 5, 200), ("2020-05", 7, 501), ("2020-06", 9, 6)}
    assert rows_of(snapshots.read(spark, there)) == want and snapshots.current(spark, there) == 1
    merge(first.withColumn("n", F.lit(-1).cast("long")), 0)  # run again
    assert rows_of(snapshots.read(spark, there)) == want
    merge(frame([("2020-07", 1, 7)]), 1)
    assert rows_of(snapshots.read(spark, there)) == want | {("2020-07", 1, 7)}


def test_revisions_without_a_snapshot(spark, tmp_path):
    there = f"file://{tmp_path}/t"
    snapshots.revisions_sink(there, "month", "revised")(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], TABLE), 0)
    assert rows_of(snapshots.read(spark, there)) == {("a", 2, 2), ("b", 1, 3)}


def test_a_failure_at_any_step_keeps_the_last_good_version(spark, tmp_path, monkeypatch):
    there = f"file://{tmp_path}/t"
    one, two = spark.range(3), spark.range(5)
    assert snapshots.read(spark, there) is None and snapshots.refresh(spark, there, lambda: None) == "none"
    assert snapshots.refresh(spark, there, lambda: one) == "fresh"

    def fails():
        raise OSError("no route")

    broken = two.select((F.col("id") / (F.col("id") - 4)).alias("id"))
    for fetch in (fails, lambda: None, lambda: one.where("id < 0")):
        assert snapshots.refresh(spark, there, fetch) == "kept" and snapshots.read(spark, there).count() == 3
    with pytest.raises(Exception, match="zero|ZERO"):  # while the version is written
        snapshots.publish(broken, there)
    assert snapshots.read(spark, there).count() == 3
    swap = snapshots._swap
    monkeypatch.setattr(snapshots, "_swap", lambda *a: fails())  # between the version and the pointer
    with pytest.raises(OSError, match="no route"):
        snapshots.publish(two, there)
    assert snapshots.read(spark, there).count() == 3
    monkeypatch.setattr(snapshots, "_swap", swap)
    assert snapshots.publish(two, there) == 1 and snapshots.read(spark, there).count() == 5
    # a table may be written from itself, and old versions go
    for n in range(2, 7):
        snapshots.publish(snapshots.read(spark, there).unionAll(one), there)
        assert snapshots.current(spark, there) == n
    assert snapshots.read(spark, there).count() == 5 + 5 * 3
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["version=4", "version=5", "version=6"]
