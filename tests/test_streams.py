"""Keyed state on streams of several batches, against the same rules by hand."""

import random


from pagewright.streaming import stateful as S
from pagewright.streaming.scratch import run_to_end


def stream_of(spark, tmp_path, batches, schema):
    """A stream of which each batch is a file, read one at a time."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        new = [f for f in os.listdir(tmp_path / "in") if f.startswith("part") and not f.startswith("part-b")]
        for f in new:
            os.rename(tmp_path / "in" / f, tmp_path / "in" / f"part-b{i:03}.parquet")
            os.utime(tmp_path / "in" / f"part-b{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


CALLS = "key long, event_id long, ts_ms long, outcome string"


def calls(n=240, keys=5, seed=1):
    r = random.Random(seed)
    rows, now = [], 1_000_000
    for i in range(n):
        now += r.choice([50, 400, 900, 6000])
        rows.append((r.randrange(keys), i, now, r.choice(["ok", "429", "429", "500"])))
    return rows


def circuit_by_hand(rows, threshold, ttl):
    state, out = {}, {}
    for key, i, now, outcome in sorted(rows, key=lambda r: (r[2], r[1])):
        failures, opened = state.get(key, (0, None))
        if opened is not None and now - opened > ttl:
            failures, opened = 0, None
        refused = opened is not None
        if not refused:
            if outcome == "429":
                failures += 1
                opened = now if failures >= threshold else None
            elif outcome == "ok":
                failures = 0
        state[key] = failures, opened
        out[i] = refused, failures
    return out


def test_breaker_on_a_stream_of_batches(spark, tmp_path):
    rows = calls()
    want = circuit_by_hand(rows, 3, 5000)
    for df in (spark.createDataFrame(rows, CALLS), None):
        if df is None:
            out = run_to_end(S.circuit(stream_of(spark, tmp_path, [rows[i : i + 60] for i in range(0, 240, 60)], CALLS), 3, 5000), "circuit")
        else:
            out = S.circuit(df, 3, 5000)
        assert {r["event_id"]: (r["refused"], r["failures"]) for r in out.collect()} == want


def test_cold_quota_on_tables_and_streams(spark, tmp_path):
    rows = [(0, *r[1:]) for r in calls(160, seed=2)]
    want, until = {}, 0
    for _, i, now, outcome in rows:
        want[i] = now < until
        until = now + 2000 if outcome == "429" else until
    table = spark.createDataFrame(rows, CALLS)
    assert {r["event_id"]: r["cold"] for r in S.cold_flags(table, 2000).collect()} == want
    assert {r["event_id"]: r["cold"] for r in S.cold_calls(table, 2000).collect()} == want
    out = run_to_end(S.cold_calls(stream_of(spark, tmp_path, [rows[:50], rows[50:110], rows[110:]], CALLS), 2000), "cold")
    assert {r["event_id"]: r["cold"] for r in out.collect()} == want


def test_admissions_on_a_stream_of_batches(spark, tmp_path):
    rows = [r[:3] for r in calls(150, 3, 4)]
    want, held = {}, {}
    for key, i, now in rows:
        held[key] = [t for t in held.get(key, []) if now - t < 2000]
        want[i] = len(held[key]) < 2
        held[key] += [now] * want[i]
    schema = "key long, event_id long, ts_ms long"
    out = run_to_end(S.admissions(stream_of(spark, tmp_path, [rows[:70], rows[70:90], rows[90:]], schema), 2000, 2), "admissions")
    assert {r["event_id"]: r["admitted"] for r in out.collect()} == want


def test_last_values_with_late_rows(spark, tmp_path):
    schema = "key long, event_id long, ts_ms long, value string"
    first = [(1, 0, 10_000, "a"), (2, 1, 11_000, "b"), (1, 2, 20_000, "c")]
    late = [(1, 3, 15_000, "late"), (2, 4, 30_000, "d")]  # 15,000 is behind 20,000, but within the watermark's minute
    gone = [(3, 5, 500_000, "e")]
    after = [(2, 6, 499_000, "f")]
    last = [(9, 7, 100, "too late")]  # the watermark of a batch is known from the next one on
    out = run_to_end(S.last_of_stream(stream_of(spark, tmp_path, [first, late, gone, after, last], schema), 60_000, "60 seconds"), "last").collect()
    assert {r["event_id"]: r["value"] for r in out} == {0: "a", 1: "b", 2: "c", 3: "c", 4: "d", 5: "e", 6: "f"}


def test_first_answers_and_purge(spark, tmp_path):
    schema = "k string, n int, ts timestamp"
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    batches = [[("a", 1, at(0)), ("b", 2, at(1)), ("a", 3, at(2))], [("a", 4, at(5)), ("c", 5, at(6))], [("z", 6, at(120))], [("y", 9, at(121))], [("a", 7, at(122)), ("z", 8, at(123))]]
    out = run_to_end(S.first_answers(stream_of(spark, tmp_path, batches, schema), ["k"], "ts", "10 minutes"), "answers").collect()
    assert sorted(r["n"] for r in out if r["n"] not in (1, 3)) == [2, 5, 6, 7, 9] and len([r for r in out if r["n"] in (1, 3)]) == 1
    cache = spark.createDataFrame([("new", 900), ("edge", 500), ("old", 499), ("none", None)], "k string, t long")
    assert sorted(r["k"] for r in S.purged(cache, "t", 1000, 500).collect()) == ["edge", "new"]
