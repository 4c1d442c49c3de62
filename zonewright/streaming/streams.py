"""Incremental variants: windowed counts, high-water marks, keyed case state, rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet file or files at path, event time as a timestamp. The path is given as a pattern, so that it may be a single file."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n, total per window; rows later than `late` behind the watermark are dropped and closed windows leave the state; in update mode a window comes again in each batch that changes it."""
    got = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_end(df: DataFrame, folder: str, mode: str = "update", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Process what is there and stop. The result is handed to sink batch by batch, or written by the executors and read back, with the number of its batch in column `batch`.

    folder must be shared by all executors; it has the checkpoint, from which another call goes on, and the rows. A batch that is
    run again replaces its own rows, so each counts once. Nothing of the result passes the driver.
    """
    spark, rows = df.sparkSession, f"{folder}/rows"
    # timers and lists of states need this store; it keeps states on the executors' disks
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    write = sink or (lambda batch, number: batch.write.mode("overwrite").parquet(f"{rows}/batch={number}"))
    query: StreamingQuery = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if sink:
        return None
    schema = df.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(rows) if query.lastProgress or query.recentProgress else spark.createDataFrame([], schema)


def latest_rows(updates: DataFrame, *key: str) -> DataFrame:
    """Of rows written in update mode the last one of each key."""
    rest = [c for c in updates.columns if c not in (*key, "batch")]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")


def high_water(events: DataFrame, key: str, value: str) -> DataFrame:
    """key, previous, latest, new: per key and batch the highest value seen before, now, and by how much it rose. State is two numbers per key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        now = max([int(b[value].max()) for b in batches if len(b)], default=before)
        if before is not None and now is not None:
            now = max(before, now)
        state.update((now,))
        yield pd.DataFrame({key: [k[0]], "previous": pd.array([before], dtype="Int64"), "latest": [now], "new": [0 if before is None else now - before]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, previous long, latest long, new long", "mark long", "update", GroupStateTimeout.NoTimeout)


class _Cases(StatefulProcessor):
    """State of one case: status, outlets, how often it changed. A timer forgets it unless a person has decided it."""

    def __init__(self, memory_ms: int):
        self.memory_ms = memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.case = handle.getValueState("case", "status string, outlets string, updates long, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, outlets, updates, last = self.case.get() if self.case.exists() else ("pending", "", 0, 0)
        seen = set(filter(None, outlets.split("\n")))
        got = pd.concat(list(rows)).sort_values(["ts", "sighting"])
        for outlet, decision in zip(got["outlet"], got["decision"], strict=True):
            if status in TERMINAL:
                break
            seen.add(outlet)
            updates += 1
            status = decision if decision in TERMINAL else "ready" if len(seen) >= 2 else "pending"
        last = max(last, int(got["ts"].max().value // 1_000_000))
        self.case.update((status, "\n".join(sorted(seen)), updates, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status not in TERMINAL:
            self.handle.registerTimer(last + self.memory_ms)
        yield self._row(key, status, len(seen), updates)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, outlets, updates, _ = self.case.get()
        self.case.clear()
        yield self._row(key, "dropped", len(outlets.split("\n")), updates)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: tuple, status: str, outlets: int, updates: int) -> pd.DataFrame:
        return pd.DataFrame({"case_id": [key[0]], "status": [status], "outlets": [outlets], "updates": [updates]})


TERMINAL = ("promoted", "rejected")


def case_state(sightings: DataFrame, memory_days: int = 60, late: str = "2 days") -> DataFrame:
    """case_id, status, outlets, updates: cases by id as their articles arrive, each batch's in order of time.

    Promoted and rejected ones never change again and stay; others are ready from two outlets on, and a case that has not been seen
    for memory_days (by the watermark, `late` behind the newest article) is dropped: a row says so, its state goes, and if it comes back it begins anew.
    sightings: case_id, sighting (breaks ties of time), ts, outlet, decision (promoted, rejected or null). State holds a case's outlets, of which feeds have few.
    """
    given = sightings.select("case_id", "sighting", "ts", "outlet", "decision").withWatermark("ts", late).groupBy("case_id")
    return given.transformWithStateInPandas(_Cases(memory_days * 86_400_000), "case_id string, status string, outlets int, updates long", "Update", "EventTime")


class _Limiter(StatefulProcessor):
    """State of one key: the times (microseconds) of at most `limit` allowed requests; a timer clears it once none counts any more."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.allowed = handle.getListState("allowed", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [int(x[0]) for x in self.allowed.get()]
        got = pd.concat(list(rows)).sort_values(["us", "request_id"])
        held, out = decide(held, got["us"], self.limit, self.span)
        self.allowed.put([(t,) for t in held])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((held[-1] + self.span) // 1000 + 1)
        yield pd.DataFrame({"request_id": pd.Series(got["request_id"].tolist(), dtype=object), "key": pd.Series([key[0]] * len(out), dtype=object), "allowed": out})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.allowed.clear()
        yield from ()

    def close(self) -> None:
        pass


def decide(held: list[int], times: Iterable[int], limit: int, span: int) -> tuple[list[int], list[bool]]:
    """Requests in order of time against those allowed before: which are allowed, and the allowed times that count on."""
    out = []
    for t in times:
        held = [x for x in held if t - x < span]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(int(t))
    return held, out


def limited_requests(requests: DataFrame, key: str, limit: int = 10, seconds: int = 60, late: str = "2 minutes") -> DataFrame:
    """request_id, key, allowed for a stream of requests (request_id, ts, key): fewer than `limit` allowed ones of its key in the seconds before it.

    Requests are decided batch by batch, in order of time within one; state is a list of `limit` times per key and goes when the watermark passes the last one's window.
    """
    kinds = {c: requests.schema[c].dataType.simpleString() for c in ("request_id", key)}
    given = requests.withWatermark("ts", late).select("request_id", "ts", F.unix_micros("ts").alias("us"), F.col(key).alias("key")).groupBy("key")
    return given.transformWithStateInPandas(_Limiter(limit, seconds), f"request_id {kinds['request_id']}, key {kinds[key]}, allowed boolean", "Append", "EventTime")


def sliding_requests(requests: DataFrame, width: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes", limit: int = 10) -> DataFrame:
    """start, n, limited: requests per sliding window, and whether they pass the limit. Works on streams and tables."""
    source = requests.withWatermark("ts", late) if requests.isStreaming else requests
    got = source.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("limited"))


def rate_limited(requests: DataFrame, key: str, limit: int = 10, seconds: int = 60) -> DataFrame:
    """Each request of a table with `allowed`: fewer than `limit` allowed requests of its key in the seconds before it.

    A refused request does not count, so the rule is a recurrence over a key's own requests in order of time. Spans of `seconds` in which a key
    has requests are counted first, and a span that none stands before begins a run: beyond it nothing is remembered, so a key is dealt to as
    many tasks as it has runs. A run is decided in one pass over its sorted rows that keeps `limit` times, however long it is.
    """
    span = seconds * 1_000_000
    spans = F.floor(F.unix_micros("ts") / F.lit(span))
    given = requests.select("request_id", F.col(key).alias("key"), F.unix_micros("ts").alias("us"), spans.alias("span"))
    busy = given.groupBy("key", "span").agg(F.lit(1).alias("_"))
    begins = F.when(F.coalesce(F.col("span") - F.lag("span").over(Window.partitionBy("key").orderBy("span")) > 1, F.lit(True)), F.col("span"))
    runs = busy.select("key", "span", begins.alias("b")).select(F.col("key").alias("_key"), F.col("span").alias("_span"), F.max("b").over(Window.partitionBy("key").orderBy("span")).alias("run"))
    met = given.join(runs, F.col("key").eqNullSafe(F.col("_key")) & (F.col("span") == F.col("_span"))).select("request_id", "key", "us", "run")
    dealt = met.repartition("key", "run").sortWithinPartitions("key", "run", "us", "request_id")

    def pass_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[int] = []
        last: tuple | None = None
        for b in batches:
            out: list[bool] = []
            for (k, run), g in b.groupby(["key", "run"], sort=False, dropna=False):
                here = (None if pd.isna(k) else k, run)
                held, some = decide(held if here == last else [], g["us"], limit, span)
                last, out = here, out + some
            yield pd.DataFrame({"request_id": b["request_id"], key: b["key"], "allowed": out})

    kinds = {c: requests.schema[c].dataType.simpleString() for c in ("request_id", key)}
    return dealt.mapInPandas(pass_over, f"request_id {kinds['request_id']}, {key} {kinds[key]}, allowed boolean")
