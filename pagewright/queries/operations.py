"""Operational analytics: call statistics, sliding windows, circuits, admission, estimates, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.operators.ordered import sliding, streaks
from pagewright.operators.ranking import best
from pagewright.queries import sql
from pagewright.queries.carriers import calls, table
from pagewright.streaming.scratch import event_stream, run_to_end
from pagewright.streaming.stateful import admissions, circuit, cold_flags, last_of_stream, last_values, purged, windowed


def micros(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def q_call_stats(spark, d):
    """All roll-ups of the call log in one pass: in total, by model, by kind, by status."""
    rows = calls(spark, d)
    rows.createOrReplaceTempView("pagewright_calls")
    return rows.sparkSession.sql("""
        SELECT grouping_id(model, event_type, status) AS level, model, event_type, status, count(*) AS n, count_if(status = 'ok') AS n_ok, sum(tokens) AS tokens,
               cast(floor(100.0D * count_if(status = 'ok') / count(*) + 0.5D) AS bigint) AS ok_percent
        FROM pagewright_calls GROUP BY GROUPING SETS ((), (model), (event_type), (status))""")


STATS_SQL = f"""
SELECT grouping_id(model, event_type, status)::BIGINT AS level, model, event_type, status, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS n_ok, sum(tokens)::BIGINT AS tokens,
  floor(100.0 * count(*) FILTER (WHERE status = 'ok') / count(*) + 0.5)::BIGINT AS ok_percent
FROM {sql.CALLS} GROUP BY GROUPING SETS ((), (model), (event_type), (status))"""


def q_rolling_window(spark, d):
    rows = calls(spark, d).withColumn("us", micros())
    return sliding(rows, ["model"], "us", 3600, {"n_hour": F.count(F.lit(1)), "tokens_hour": F.sum("tokens")}).select("event_id", "model", "n_hour", "tokens_hour")


def q_circuit(spark, d):
    """Consecutive failures of each model, and where the third one opens its circuit."""
    rows = streaks(calls(spark, d), ["model"], ["ts", "event_id"], F.col("status") == "error", F.col("event_type") == "view", "failures")
    return rows.select("event_id", "model", "failures", (F.col("failures") >= 3).alias("opens"))


CIRCUIT_SQL = f"""
WITH r AS (SELECT *, sum((event_type = 'view')::INT) OVER (PARTITION BY model ORDER BY ts, event_id) AS run FROM {sql.CALLS})
SELECT event_id, model, sum((status = 'error')::INT) OVER (PARTITION BY model, run ORDER BY ts, event_id)::BIGINT AS failures,
  sum((status = 'error')::INT) OVER (PARTITION BY model, run ORDER BY ts, event_id) >= 3 AS opens FROM r"""


def outcomes(rows):
    """Events as calls: key, event_id, ts_ms, outcome."""
    return rows.select(F.col("user_id").alias("key"), "event_id", F.floor(micros() / 1000).alias("ts_ms"), F.when(F.col("event_type") == "error", "429").when(F.col("event_type") == "view", "ok").otherwise("500").alias("outcome"))


def q_circuit_states(spark, d):
    """The breaker with its lifetime, as a state machine for each user."""
    return circuit(outcomes(table(spark, d, "events")), threshold=2, ttl_ms=86_400_000)


def q_stream_circuit(spark, d):
    """The same on a stream, with timers."""
    return run_to_end(circuit(outcomes(event_stream(spark, d)), threshold=2, ttl_ms=86_400_000), "circuit")


def q_quota_cold(spark, d):
    """Calls while the quota of all is cold: within half an hour after a failed one."""
    return cold_flags(outcomes(table(spark, d, "events")), 1_800_000).select("event_id", "cold")


COLD_SQL = """
WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS t, event_type = 'error' AS f FROM events)
SELECT event_id, coalesce(t - max(CASE WHEN f THEN t END) OVER (ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1800000, false) AS cold FROM e"""


def q_stream_last(spark, d):
    """Progress of each user from a stream: the last state of those that are still alive at the end."""
    rows = event_stream(spark, d).select(F.col("user_id").alias("key"), "event_id", F.floor(micros() / 1000).alias("ts_ms"), F.col("event_type").alias("value"))
    states = run_to_end(last_of_stream(rows, 86_400_000), "last")
    end = states.agg(F.max("ts_ms").alias("now")).first()["now"] or 0
    latest = states.groupBy("key").agg(F.max_by(F.struct("ts_ms", "value"), F.struct("ts_ms", "event_id")).alias("s"))
    return latest.select("key", "s.ts_ms", "s.value").filter(F.lit(end) - F.col("ts_ms") <= 86_400_000)


def q_cache_purge(spark, d):
    rows = table(spark, d, "events").select("event_id", F.floor(micros() / 1000).alias("t"))
    end = rows.agg(F.max("t").alias("now")).first()["now"] or 0
    return purged(rows, "t", end, 7 * 86_400_000).select("event_id")


def q_recent_n(spark, d):
    return best(calls(spark, d), ["model"], [F.desc("ts"), F.desc("event_id")], 50).select("model", "event_id")


def q_eta(spark, d):
    """Time estimate from past runs: months of orders stand for runs. The run of median duration gives the time per product."""
    runs = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("products"), F.sum("o_totalprice").alias("duration"))
    recent = runs.orderBy(F.desc("month")).limit(30).filter("products > 0 AND duration > 0")  # 30 runs, as the rule says
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    ranked = recent.withColumn("n", n).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("duration", "month"))).withColumn("c", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("products", "month")))
    middle = F.floor(F.col("n") / 2) + 1
    picked = ranked.agg(F.max("n").alias("runs"), F.max(F.when(F.col("r") == middle, F.greatest(F.lit(10.0), (F.col("duration") - 4000) / F.col("products")))).alias("per_product"), F.max(F.when(F.col("c") == middle, F.col("products"))).alias("median_products"))
    eta = 4000 + 17000 + 100 * F.when(F.col("runs") >= 3, F.col("per_product")).otherwise(200.0)
    return picked.select("runs", "median_products", F.round(eta, 4).alias("eta_ms"), F.floor(eta * 0.65 + 0.5).cast("long").alias("eta_lower"), F.floor(eta * 1.35 + 0.5).cast("long").alias("eta_upper"))


ETA_SQL = """
WITH r AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS p, sum(o_totalprice) AS d FROM orders GROUP BY 1 ORDER BY m DESC LIMIT 30),
k AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY d, m) AS a, row_number() OVER (ORDER BY p, m) AS c FROM r WHERE p > 0 AND d > 0),
e AS (SELECT max(n) AS runs, max(CASE WHEN a = n // 2 + 1 THEN greatest(10.0, (d - 4000) / p) END) AS per_product, max(CASE WHEN c = n // 2 + 1 THEN p END) AS median_products FROM k),
t AS (SELECT *, 21000 + 100 * CASE WHEN runs >= 3 THEN per_product ELSE 200.0 END AS eta FROM e)
SELECT runs, median_products, round(eta, 4) AS eta_ms, floor(eta * 0.65 + 0.5)::BIGINT AS eta_lower, floor(eta * 1.35 + 0.5)::BIGINT AS eta_upper FROM t"""


def q_incr_stats(spark, d):
    """Calls by day and kind from a stream with late rows; the last windows, which stay open, are added from the table."""
    closed = run_to_end(windowed(event_stream(spark, d), "ts", ["event_type"], "1 day", "2 hours", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]), "incr")
    batch = windowed(table(spark, d, "events"), "ts", ["event_type"], "1 day", "2 hours", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")])
    rest = batch.join(closed.select("window_start", "event_type"), ["window_start", "event_type"], "left_anti")
    return closed.unionByName(rest).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


def q_stream_admission(spark, d):
    """The limiter on a stream: one hit an hour for each user."""
    rows = event_stream(spark, d).select(F.col("user_id").alias("key"), "event_id", F.floor(micros() / 1000).alias("ts_ms"))
    return run_to_end(admissions(rows, 3_600_000, 1), "admissions")


def q_last_state(spark, d):
    rows = table(spark, d, "events").select("user_id", F.floor(micros() / 1000).alias("ts_ms"), "event_type", "event_id")
    end = rows.agg(F.max("ts_ms").alias("now")).first()["now"] or 0
    return last_values(rows, ["user_id"], "ts_ms", ["event_type", "event_id"], end, 86_400_000)


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_quota_cold": COLD_SQL,
    "q_stream_last": "WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ts_ms, event_type AS value, event_id FROM events) SELECT key, ts_ms, value FROM e WHERE (SELECT max(ts_ms) FROM e) - ts_ms <= 86400000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, event_id DESC) = 1",
    "q_cache_purge": "SELECT event_id FROM events WHERE (SELECT max(epoch_us(ts) // 1000) FROM events) - epoch_us(ts) // 1000 <= 7 * 86400000",
    "q_call_stats": STATS_SQL,
    "q_rolling_window": f"SELECT event_id, model, count(*) OVER w AS n_hour, (sum(tokens) OVER w)::BIGINT AS tokens_hour FROM {sql.CALLS} WINDOW w AS (PARTITION BY model ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)",
    "q_circuit": CIRCUIT_SQL,
    "q_recent_n": f"SELECT model, event_id FROM {sql.CALLS} QUALIFY row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) <= 50",
    "q_eta": ETA_SQL,
    "q_incr_stats": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "q_last_state": "WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ts_ms, event_type, event_id FROM events), k AS (SELECT user_id, arg_max(ts_ms, ts_ms) AS ts_ms, arg_max(event_type, ts_ms) AS event_type, arg_max(event_id, ts_ms) AS event_id FROM e GROUP BY 1) SELECT * FROM k WHERE (SELECT max(ts_ms) FROM e) - ts_ms <= 86400000",
}
