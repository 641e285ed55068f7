"""Keyed state machines over time: admission by sliding window, circuit breaker, last value with a lifetime.

Each is one pure step function, used on streams with applyInPandasWithState and on tables with applyInPandas."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(recent: list[int], now: int, window_ms: int, most: int) -> tuple[list[int], bool, int]:
    """A hit at `now`: the hits still counted, whether it is let in, and seconds to wait if not. Refused hits aren't counted."""
    recent = [t for t in recent if now - t < window_ms]
    if len(recent) >= most:
        return recent, False, math.ceil((window_ms - (now - recent[0])) / 1000)
    return [*recent, now], True, 0


def trip(failures: int, opened: int | None, now: int, outcome: str, threshold: int = 3, ttl_ms: int = 300_000) -> tuple[int, int | None, bool]:
    """A call at `now`: consecutive quota failures, when the circuit opened, and whether the call was refused by it.

    A circuit that has been open for ttl_ms lets calls through again. outcome: ok, 429, or another error, which changes nothing.
    """
    if opened is not None and now - opened > ttl_ms:
        failures, opened = 0, None
    if opened is not None:
        return failures, opened, True
    if outcome == "429":
        failures += 1
        opened = now if failures >= threshold else None
    elif outcome == "ok":
        failures = 0
    return failures, opened, False


def chill(cold_until: int | None, now: int, outcome: str, ttl_ms: int = 45_000) -> tuple[int | None, bool]:
    """A call at `now`: until when the quota counts as cold, and whether it did before the call. A cascade that failed cools it for ttl_ms."""
    cold = cold_until is not None and now < cold_until
    return (now + ttl_ms if outcome == "429" else cold_until if cold else None), cold


def keyed(rows: DataFrame, step: Callable, start: tuple, state: str, out: str, until: Callable) -> DataFrame:
    """Rows (key, event_id, ts_ms and more) through a step function, key by key and in order of time.

    step(state, row) gives the next state and what is known of the row; out: schema of the result, key, event_id and ts_ms first.
    Tables are handled key by key. Streams keep a key's state between batches; until(state, last ts_ms) is the event time at which it
    can be forgotten (None: it stays; not later than the rows seen: at once), so idle keys don't pile up. Streams need a watermark.
    """
    names = [c.split()[0] for c in out.split(", ")]

    def fold(now: tuple, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        found = []
        for r in pdf.sort_values(["ts_ms", "event_id"]).itertuples(index=False):
            now, known = step(now, r)
            found.append((r.key, r.event_id, r.ts_ms, *known))
        return now, pd.DataFrame(found, columns=names)

    if not rows.isStreaming:
        return rows.groupBy("key").applyInPandas(lambda pdf: fold(start, pdf)[1], out)

    def on_state(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches))
        now, found = fold(tuple(held.get) if held.exists else start, rows)
        last = int(rows["ts_ms"].max())
        end = until(now, last)
        if end is not None and end <= last:
            if held.exists:
                held.remove()
        else:
            held.update(now)
            if end is not None:
                held.setTimeoutTimestamp(max(end, held.getCurrentWatermarkMs() + 1))
        yield found

    return rows.groupBy("key").applyInPandasWithState(on_state, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def timed(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Rows with their event time as a watermarked column, where they are a stream."""
    return rows.withColumn("at", F.timestamp_millis(F.col("ts_ms"))).withWatermark("at", late) if rows.isStreaming else rows


ADMISSIONS = "key long, event_id long, ts_ms long, admitted boolean, retry_after int"


def admissions(rows: DataFrame, window_ms: int, most: int, late: str = "0 seconds") -> DataFrame:
    """Rows of key, event_id, ts_ms with the limiter's decision. A key's state are its counted hits, `most` at most, until the last is out of the window."""

    def step(state, r):
        recent, ok, wait = admit(list(state[0]), int(r.ts_ms), window_ms, most)
        return (recent,), (ok, wait)

    return keyed(timed(rows.select("key", "event_id", "ts_ms"), late), step, ([],), "recent array<long>", ADMISSIONS, lambda state, last: max(state[0], default=last) + window_ms)


CIRCUIT = "key long, event_id long, ts_ms long, refused boolean, failures int"


def circuit(rows: DataFrame, threshold: int = 3, ttl_ms: int = 300_000, late: str = "0 seconds") -> DataFrame:
    """Rows of key, event_id, ts_ms, outcome with what the circuit breaker does to each call. An open circuit is forgotten when its time is up,
    one without failures at once."""

    def step(state, r):
        failures, opened, refused = trip(state[0], state[1], int(r.ts_ms), r.outcome, threshold, ttl_ms)
        return (failures, opened), (refused, failures)

    def until(state, last):
        failures, opened = state
        return opened + ttl_ms + 1 if opened is not None else last if not failures else None

    return keyed(timed(rows.select("key", "event_id", "ts_ms", "outcome"), late), step, (0, None), "failures int, opened long", CIRCUIT, until)


COLD = "key long, event_id long, ts_ms long, cold boolean"


def cold_calls(rows: DataFrame, ttl_ms: int = 45_000, late: str = "0 seconds") -> DataFrame:
    """Rows of key, event_id, ts_ms, outcome with whether the quota was cold at each call; a key is a quota that calls share."""

    def step(state, r):
        until, cold = chill(state[0], int(r.ts_ms), r.outcome, ttl_ms)
        return (until,), (cold,)

    return keyed(timed(rows.select("key", "event_id", "ts_ms", "outcome"), late), step, (None,), "until long", COLD, lambda state, last: last if state[0] is None else state[0])


def cold_flags(rows: DataFrame, ttl_ms: int = 45_000) -> DataFrame:
    """cold_calls() for a table of one quota, without a state: a failure is copied to its stretch of ttl_ms and the next, so stretches are worked on
    apart. rows: event_id, ts_ms, outcome."""
    failed = F.col("outcome") == "429"
    both = F.when(failed, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    near = rows.withColumn("_copy", F.explode(both)).withColumn("_part", F.floor(F.col("ts_ms") / ttl_ms) + F.col("_copy"))
    before = Window.partitionBy("_part").orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(failed, F.col("ts_ms"))).over(before)
    return near.withColumn("cold", F.coalesce(F.col("ts_ms") - last < ttl_ms, F.lit(False))).filter("_copy = 0").select("event_id", "ts_ms", "cold")


def windowed(stream: DataFrame, ts: str, keys: list[str], size: str, late: str, aggregates: list) -> DataFrame:
    """Aggregates by tumbling window and keys; rows later than `late` are dropped on streams, and windows are given out once closed."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", size).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])


def last_values(table: DataFrame, keys: list[str], ts: str, values: list[str], now_ms: int, ttl_ms: int = 3_600_000) -> DataFrame:
    """Latest row of each key, without those older than the lifetime."""
    latest = table.groupBy(*keys).agg(F.max_by(F.struct(ts, *values), ts).alias("s"))
    return latest.select(*keys, "s.*").filter(F.lit(now_ms) - F.col(ts) <= ttl_ms)


LAST = "key long, event_id long, ts_ms long, value string"


def last_of_stream(rows: DataFrame, ttl_ms: int = 3_600_000, late: str = "0 seconds") -> DataFrame:
    """Rows of key, event_id, ts_ms, value with the value that is the key's last one at that time, late rows included: one older than what is held
    changes nothing. A key is forgotten a lifetime after its last value."""

    def step(state, r):
        value, at = (r.value, int(r.ts_ms)) if state[1] is None or r.ts_ms >= state[1] else state
        return (value, at), (value,)

    return keyed(timed(rows.select("key", "event_id", "ts_ms", "value"), late), step, (None, None), "value string, at long", LAST, lambda state, last: state[1] + ttl_ms)


def first_answers(stream: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """The first answer for each key; more of them are dropped while the first may still be served, and it is forgotten after `ttl`."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)


def purged(cache: DataFrame, written_ms: str, now_ms: int, ttl_ms: int = 30 * 86_400_000) -> DataFrame:
    """Cache entries that are not too old to be loaded; those without a time aren't loaded either."""
    return cache.filter(F.coalesce(F.lit(now_ms) - F.col(written_ms) <= ttl_ms, F.lit(False)))
