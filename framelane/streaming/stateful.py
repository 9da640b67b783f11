"""Keyed streaming operators with explicit state, in event-time order.

Rows are held in state until the watermark has passed them and are then handled in order of time, so the result is the same
however the rows are cut into micro-batches and files. Keys share state in hashed buckets. ``late`` says how far behind the newest row a row may arrive; Spark
drops rows later than that and counts them (``numRowsDroppedByWatermark``, see ``dropped_rows``). What is held, and sorted at once, is
bounded by the rows of ``late`` and of one micro-batch. A key's state goes ``ttl_seconds`` of event time after its last row.

A stream that ends leaves the rows after its last watermark in state. ``end_of_stream`` gives a row that moves the watermark
past everything; no operator passes it on.
"""

from __future__ import annotations

import datetime
import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
TERMINAL = ("succeeded", "failed", "cancelled", "interrupted")
# Allowed moves between job states.
MOVES = {
    "queued": ("running", "paused", *TERMINAL),
    "running": ("paused", *TERMINAL),
    "paused": ("running", *TERMINAL),
}
END_TIME = datetime.datetime(2200, 1, 1)  # within nanosecond timestamps
EVENT_TIME = "event_time"


def use_rocksdb(spark) -> None:
    """Stateful processors need the RocksDB state store. A commit writes what has changed, not a snapshot of every store."""
    spark.conf.set(*STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def end_of_stream(source: DataFrame, ts: str, key: str) -> DataFrame:
    """A batch of one row in the columns of ``source`` (the stream before the operator): the end of time under a null key."""
    ends = {ts: F.lit(END_TIME)}
    fields = [ends.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema.fields]
    return source.sparkSession.range(1).select(*fields)


def dropped_rows(query) -> int:
    """Rows that a query's stateful operators have dropped as too late so far."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def _seconds(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _plain(value, kind: str):
    """A cell as a Python value of the column's type, missing ones as None."""
    if value is None or value != value:
        return None
    return {"bigint": int, "double": float}.get(kind, str)(value)


def _after(seconds: float) -> int:
    """The first whole millisecond after a time, so that a watermark there has passed its microseconds."""
    return max(0, int(seconds * 1000)) + 1


#: Groups of keys. A group is one call and two state values per micro-batch, however many keys it has; a key's rows stay together.
BUCKETS = 256
ROWS_AT_ONCE = 50_000


class _Ordered(StatefulProcessor):
    """Holds the rows of a bucket of keys until the watermark passes them, then hands them to ``step`` in order, key by key.

    State is packed: every Arrow batch of held rows is one value, and what is kept between rows is one value for all keys of the bucket. A value
    for each row and each key would cost a round trip to the state server each.
    """

    row_schema = ""  # of a held row; its first columns give the order, the very first the event time in seconds
    columns: tuple[str, ...] = ()  # of a result row
    key = ""  # the key's column, see _run

    def __init__(self, ttl_seconds: int | None):
        self.ttl_ms = None if ttl_seconds is None else ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.state = handle.getValueState("state", "keys binary")
        self.names, self.kinds = zip(*[c.split(" ") for c in self.row_schema.split(", ")])

    def close(self) -> None:
        pass

    def step(self, key, held: list | None, row: tuple, out: list) -> list | None:
        raise NotImplementedError

    def _wake(self, at_ms: int) -> None:
        timers = [t for t in self.handle.listTimers()]
        if not timers or at_ms < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator, timerValues):
        first = None
        for batch in rows:  # one Arrow batch after another
            kept = batch.loc[batch[self.names[0]] < END_TIME.replace(tzinfo=datetime.timezone.utc).timestamp(), [self.key, *self.names]]
            if len(kept):
                self.held.appendValue((pickle.dumps(kept, protocol=5),))
                low = float(kept[self.names[0]].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(_after(first))
        return iter(())

    def _steps(self, ready, states: dict) -> Iterator[list[tuple]]:
        """Result rows of sorted rows, some at a time; ``states`` is brought up to date."""
        out: list[tuple] = []
        now, held, last = None, None, None
        for low in range(0, len(ready), ROWS_AT_ONCE):
            part = ready.iloc[low : low + ROWS_AT_ONCE]
            values = [[_plain(v, c) for v in part[n].tolist()] for n, c in zip(self.names, self.kinds)]
            for key, row in zip(part[self.key].tolist(), zip(*values)):
                if key != now or last is None:
                    if last is not None:
                        states[now] = (held, last)
                    now, held = key, states.get(key, (None, None))[0]
                held, last = self.step((key,), held, row, out), row[0]
            yield out
            out = []
        if last is not None:
            states[now] = (held, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        watermark = timerValues.getCurrentWatermarkInMs()
        parts = [pickle.loads(bytes(row[0])) for row in self.held.get()]
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[self.key, *self.names])
        del parts
        passed = rows[self.names[0]] <= watermark / 1000
        ready, wait = rows[passed].sort_values([self.key, *self.names[: self.order]], kind="stable"), rows[~passed]
        del rows
        states: dict = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else {}
        for out in self._steps(ready, states):
            if out:
                yield pd.DataFrame(out, columns=list(self.columns))
        wakes = []
        if len(wait):
            self.held.put([(pickle.dumps(wait, protocol=5),)])
            wakes.append(_after(float(wait[self.names[0]].min())))
        else:
            self.held.clear()
        if self.ttl_ms is not None:
            waiting = set(wait[self.key])
            states = {k: v for k, v in states.items() if k in waiting or int(v[1] * 1000) + self.ttl_ms > watermark}
            wakes += [int(v[1] * 1000) + self.ttl_ms for v in states.values()]
        if states:
            self.state.update((pickle.dumps(states, protocol=5),))
        else:
            self.state.clear()
        if wakes:
            # not the timer that has just expired: Spark deletes that one after this call
            self.handle.registerTimer(max(watermark + 1, min(wakes)))

    order = 1


def _run(rows: DataFrame, key: str, ts: str, late: str, processor: _Ordered, schema: str) -> DataFrame:
    when = F.timestamp_micros((F.col("seconds") * 1e6).cast("bigint"))
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    timed = rows.withColumns({EVENT_TIME: when, "_bucket": bucket}).withWatermark(EVENT_TIME, late)
    processor.key = key
    return timed.groupBy("_bucket").transformWithStateInPandas(processor, schema, "append", "EventTime")


def _names(schema: str) -> tuple[str, ...]:
    return tuple(c.split(" ")[0] for c in schema.split(", "))


THROUGHPUT = (
    "job_id string, seconds double, processed_frames bigint, elapsed_seconds double, average_fps double, "
    "rolling_fps double, remaining_seconds double, peak_rss_bytes bigint, peak_gpu_bytes bigint"
)


class _Throughput(_Ordered):
    row_schema = "seconds double, processed_frames bigint, total_frames bigint, process_rss_bytes bigint, gpu_memory_used_bytes bigint"
    columns = _names(THROUGHPUT)
    order = 2

    def __init__(self, ttl_seconds: int | None, min_gap: float):
        super().__init__(ttl_seconds)
        self.min_gap = min_gap

    def step(self, key, held, row, out):
        now, done, total, rss, gpu = float(row[0]), int(row[1] or 0), int(row[2] or 0), row[3], row[4]
        if held is None:
            held = [now, now, done, None, rss, gpu]
        else:
            if now - held[1] >= self.min_gap:
                held[3] = max(0, done - held[2]) / (now - held[1])
                held[1], held[2] = now, done
            held[4] = max((v for v in (held[4], rss) if v is not None), default=None)
            held[5] = max((v for v in (held[5], gpu) if v is not None), default=None)
        elapsed = now - held[0]
        average = done / elapsed if elapsed > 0 and done > 0 else None
        left = (total - done) / average if average and total > done else None
        out.append((key[0], now, done, elapsed, average, held[3], left, held[4], held[5]))
        return held


def stream_throughput(
    progress: DataFrame, ts: str = "ts", min_gap: float = 1.0, ttl_seconds: int | None = 86_400, late: str = "10 minutes"
) -> DataFrame:
    """Average and rolling rate, remaining time and peaks of each job's snapshots, in order of time.

    The rolling rate is renewed only when ``min_gap`` seconds have passed since the last renewal.
    """
    rows = progress.select(
        F.col("job_id").cast("string").alias("job_id"),
        _seconds(ts).alias("seconds"),
        *[F.col(c).cast("bigint").alias(c) for c in ("processed_frames", "total_frames", "process_rss_bytes", "gpu_memory_used_bytes")],
    )
    return _run(rows, "job_id", ts, late, _Throughput(ttl_seconds, min_gap), THROUGHPUT)


class _Dedupe(_Ordered):
    row_schema = "seconds double, tie string, signature string, whole string"
    columns = ("job_id", "whole")
    order = 2

    def __init__(self, ttl_seconds: int | None, heartbeat: float):
        super().__init__(ttl_seconds)
        self.heartbeat = heartbeat

    def step(self, key, held, row, out):
        now, _, signature, whole = row
        if held is None or signature != held[0] or now - held[1] >= self.heartbeat:
            held = [signature, float(now)]
            out.append((key[0], whole))
        return held


def stream_dedupe_progress(
    progress: DataFrame,
    signature: tuple[str, ...] = ("phase", "percent", "processed_frames", "message"),
    ts: str = "ts",
    heartbeat: float = 5.0,
    ttl_seconds: int | None = 86_400,
    late: str = "10 minutes",
    tie: str | None = None,
) -> DataFrame:
    """Snapshots that change the signature, and one every ``heartbeat`` seconds while nothing changes.

    Snapshots of one instant come in order of ``tie``, or of their content.
    """
    whole = F.to_json(F.struct(*progress.columns), {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"})
    place = whole if tie is None else F.lpad(F.col(tie).cast("string"), 20, "0")
    rows = progress.select(
        F.col("job_id").cast("string").alias("job_id"), _seconds(ts).alias("seconds"), place.alias("tie"),
        F.to_json(F.struct(*signature)).alias("signature"), whole.alias("whole"),
    )
    kept = _run(rows, "job_id", ts, late, _Dedupe(ttl_seconds, heartbeat), "job_id string, whole string")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in progress.schema)
    return kept.select(F.from_json("whole", schema, {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias("r")).select("r.*")


JOB_STATE = "job_id string, seconds double, state string, previous string, valid boolean, error string"


class _JobState(_Ordered):
    row_schema = "seconds double, state string"
    columns = _names(JOB_STATE)
    order = 2

    def step(self, key, held, row, out):
        now, state = float(row[0]), row[1]
        before = held[0] if held else None
        if before == state:
            return [state, now]
        valid = before is None or state in MOVES.get(before, ())
        out.append((key[0], now, state, before, valid, None if valid else f"{before} cannot become {state}"))
        return [state, now] if valid else held


def stream_job_state(changes: DataFrame, ts: str = "ts", ttl_seconds: int | None = 7 * 86_400, late: str = "10 minutes") -> DataFrame:
    """State changes of each job. ``valid`` rows moved the job; the others say why they were refused. A terminal state
    is never left."""
    rows = changes.select(F.col("job_id").cast("string").alias("job_id"), _seconds(ts).alias("seconds"), "state")
    return _run(rows, "job_id", ts, late, _JobState(ttl_seconds), JOB_STATE)


EDGES = "media_id string, position bigint, value double"


class _Edges(_Ordered):
    row_schema = "seconds double, position bigint, value double"
    columns = _names(EDGES)
    order = 2

    def __init__(self, ttl_seconds: int | None, threshold: float):
        super().__init__(ttl_seconds)
        self.threshold = threshold

    def step(self, key, held, row, out):
        _, position, value = row
        was, last = held or [False, -1]
        if position <= last:
            return [was, last]
        active = value is not None and value >= self.threshold
        if active and not was:
            out.append((key[0], int(position), float(value)))
        return [bool(active), int(position)]


def stream_edges(
    signal: DataFrame,
    threshold: float,
    position: str = "frame_index",
    value: str = "mean_luma",
    ttl_seconds: int | None = 86_400,
    late: str = "10 minutes",
    ts: str | None = None,
    fps: float = 24.0,
) -> DataFrame:
    """Rising edges of an unbounded signal, per media in order of time and ``position``; a repeated position is ignored.

    A frame's time is ``ts``, or its position at ``fps``. The two orders must agree.
    """
    when = _seconds(ts) if ts else F.col(position).cast("bigint") / F.lit(float(fps)) + 86_400.0  # the watermark starts at 1970
    rows = signal.select(
        F.col("media_id").cast("string").alias("media_id"),
        when.alias("seconds"),
        F.col(position).cast("bigint").alias("position"),
        F.col(value).cast("double").alias("value"),
    )
    return _run(rows, "media_id", ts or position, late, _Edges(ttl_seconds, threshold), EDGES)
