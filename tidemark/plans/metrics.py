"""Metrics over event streams: statistics, percentiles, windows, trends, runs and alerts.

`events` stands for the executions of tools: event_type is the tool, value the latency, an even event_id a success.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.replay import replayed
from tidemark.operators.ordered import at_ranks, running
from tidemark.registry import Registry
from tidemark.session import table

query = Registry()

AS_OF = "2024-01-31 00:00:00"
E_SQL = "(SELECT *, event_id % 2 = 0 AS ok, epoch_us(ts) AS us, 0.5 + (event_id % 5) / 10 AS confidence, (event_id % 7) / 1000 AS cost FROM events)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumns({"ok": F.col("event_id") % 2 == 0, "us": F.unix_micros("ts"), "confidence": 0.5 + (F.col("event_id") % 5) / 10, "cost": (F.col("event_id") % 7) / 1000})


def _share(condition: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(F.sum(condition.cast("int")).cast("double"), F.count("*")), F.lit(0.0)), 6)


@query(f"""SELECT event_type, count(*) AS n, sum(ok::INT)::BIGINT AS success, sum((NOT ok)::INT)::BIGINT AS failure, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most,
round(avg(confidence), 6) AS confidence, max(us) AS last_us FROM {E_SQL} GROUP BY event_type""")
def tool_stats(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failure"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("confidence"), 6).alias("confidence"), F.max("us").alias("last_us"),
    )


@query("""SELECT count(*) AS total, count(DISTINCT user_id) AS agents, count(DISTINCT event_type) AS kinds, sum((event_type = 'error')::INT)::BIGINT AS errors,
round(100 * sum((event_type <> 'error')::INT) / greatest(count(*), 1), 6) AS success_percent, sum((ts >= TIMESTAMP '2024-01-29 23:00:00')::INT)::BIGINT AS last_hour, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events""")
def agent_stats(spark, sf):
    """One row of totals, distinct counts, shares and bounds."""
    e = _events(spark, sf)
    error = F.col("event_type") == "error"
    return e.agg(
        F.count("*").alias("total"), F.count_distinct("user_id").alias("agents"), F.count_distinct("event_type").alias("kinds"), F.count_if(error).alias("errors"),
        F.round(100 * F.count_if(~error) / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_percent"), F.count_if(F.col("ts") >= F.lit("2024-01-29 23:00:00").cast("timestamp")).alias("last_hour"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"),
    )


@query(f"""SELECT event_type, n, round(100 * n / sum(n) OVER (), 6) AS share, round(weighted, 6) AS confidence, round(fallbacks / n, 6) AS fallback_rate
FROM (SELECT event_type, count(*) AS n, sum(confidence) / count(*) AS weighted, sum((NOT ok)::INT) AS fallbacks FROM {E_SQL} GROUP BY event_type)""")
def tool_share(spark, sf):
    """Of a table of tools, after the aggregation: the window sees one row per tool."""
    g = _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.count_if(~F.col("ok")).alias("f"))
    return g.select("event_type", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), F.round("c", 6).alias("confidence"), F.round(F.col("f") / F.col("n"), 6).alias("fallback_rate"))


def at_index(df: DataFrame, key: str, value: str, rules: dict[str, str]) -> DataFrame:
    """Values at 0-based places of each key's sorted values; a place is an SQL expression of n.

    Places come from a row number, not from arrays of all values, so a key may hold any number of rows.
    """
    w = Window.partitionBy(key)
    numbered = df.select(key, value, F.row_number().over(w.orderBy(value)).alias("rn"), F.count("*").over(w).alias("n"))
    picks = [F.max(F.when(F.col("rn") - 1 == F.expr(rule), F.col(value))).alias(name) for name, rule in rules.items()]
    return numbered.groupBy(key).agg(*picks)


RULES = {
    "p50_share": "least(n * 50 div 100, n - 1)", "p95_share": "least(n * 95 div 100, n - 1)", "p99_share": "least(n * 99 div 100, n - 1)",
    "p50_rank": "greatest(0, least(cast(ceil(n * 0.50D) as bigint) - 1, n - 1))", "p95_rank": "greatest(0, least(cast(ceil(n * 0.95D) as bigint) - 1, n - 1))",
    "p50_floor": "cast(floor(50 / 100D * (n - 1)) as bigint)", "p95_floor": "cast(floor(95 / 100D * (n - 1)) as bigint)",
    "p50_round": "cast(round((n - 1) * 0.5D) as bigint)", "p95_round": "cast(round((n - 1) * 0.95D) as bigint)",
}
_PLACES = {
    "p50_share": "least(n * 50 // 100, n - 1)", "p95_share": "least(n * 95 // 100, n - 1)", "p99_share": "least(n * 99 // 100, n - 1)",
    "p50_rank": "greatest(0, least(ceil(n * 0.50::DOUBLE)::BIGINT - 1, n - 1))", "p95_rank": "greatest(0, least(ceil(n * 0.95::DOUBLE)::BIGINT - 1, n - 1))",
    "p50_floor": "floor(0.5::DOUBLE * (n - 1))::BIGINT", "p95_floor": "floor(0.95::DOUBLE * (n - 1))::BIGINT",
    "p50_round": "round((n - 1) * 0.5::DOUBLE)::BIGINT", "p95_round": "round((n - 1) * 0.95::DOUBLE)::BIGINT",
}


@query(f"""SELECT event_type, {', '.join(f'max(CASE WHEN rn - 1 = {r} THEN value END) AS {k}' for k, r in _PLACES.items())}
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""")
def percentile_rules(spark, sf):
    """The four rules by which percentiles are read off sorted values."""
    return at_index(table(spark, sf, "events"), "event_type", "value", RULES)


@query("""SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, max(CASE WHEN k - 1 = greatest(0, least(ceil(n * 0.95::DOUBLE)::BIGINT - 1, n - 1)) THEN value END) AS p95,
max(CASE WHEN rn = 1 THEN value END) AS last FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events QUALIFY rn <= 20)) GROUP BY event_type""")
def recent_latency(spark, sf):
    """The last twenty calls of each tool."""
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    few = table(spark, sf, "events").withColumn("rn", F.row_number().over(newest)).filter("rn <= 20")
    own = Window.partitionBy("event_type")
    few = few.withColumns({"k": F.row_number().over(own.orderBy("value")), "n": F.count("*").over(own)})
    p95 = F.max(F.when(F.expr("k - 1 = greatest(0, least(cast(ceil(n * 0.95D) as bigint) - 1, n - 1))"), F.col("value")))
    return few.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), p95.alias("p95"), F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("last"))


@query("""SELECT event_type, count(*) AS n, (sum(value)::BIGINT // count(*)) AS int_mean, min(value) AS least, max(value) AS most, round(sum((value > 15)::INT) / count(*), 6) AS error_rate FROM events GROUP BY event_type""")
def operation_summary(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.expr("cast(round(sum(value)) as bigint) div count(*)").alias("int_mean"), F.min("value").alias("least"), F.max("value").alias("most"), _share(F.col("value") > 15).alias("error_rate"))


@query(f"""SELECT user_id, count(*) AS n, round(count(*) / 86400, 9) AS rps, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(100 * avg((event_type = 'error')::INT), 6) AS error_percent, round(100 * avg((event_type = 'view')::INT), 6) AS ok_percent
FROM {E_SQL} WHERE us > epoch_us(TIMESTAMP '2024-01-15 12:00:00') - 86400000000 AND us <= epoch_us(TIMESTAMP '2024-01-15 12:00:00') GROUP BY user_id""")
def request_snapshot(spark, sf):
    """Requests of the day that ends at a given moment: a second's, latencies (between the two nearest) and shares."""
    at = F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp"))
    e = _events(spark, sf).filter((F.col("us") > at - 86_400_000_000) & (F.col("us") <= at))
    percent = lambda kind: F.round(100 * F.avg((F.col("event_type") == kind).cast("int")), 6)
    counts = e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.count("*") / 86400, 9).alias("rps"), percent("error").alias("error_percent"), percent("view").alias("ok_percent"))
    between = {f"{side}{p}": rule((F.col("n") - 1) * p / 100) for p in (50, 95, 99) for side, rule in (("lo", F.floor), ("hi", F.ceil))}
    part = lambda p: (F.col("values") - 1) * p / 100 - F.floor((F.col("values") - 1) * p / 100)
    shares = at_ranks(e, ["user_id"], "value", between).withColumnRenamed("n", "values").select(F.col("user_id").alias("user"), *[F.round(F.col(f"lo{p}") + (F.col(f"hi{p}") - F.col(f"lo{p}")) * part(p), 6).alias(f"p{p}") for p in (50, 95, 99)])
    return counts.join(shares, F.col("user_id").eqNullSafe(F.col("user")), "left").drop("user")


BOUNDS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0)


@query(f"""SELECT event_type, le, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND e.value <= le) AS n FROM (SELECT DISTINCT event_type FROM events) t, (SELECT unnest([{', '.join(map(str, BOUNDS))}]::DOUBLE[]) AS le)""")
def histogram(spark, sf):
    """Cumulative counts by bucket bound: one aggregation, then unpivoted."""
    g = table(spark, sf, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BOUNDS)])
    return g.select("event_type", F.explode(pairs).alias("x")).select("event_type", "x.*")


@query(f"""WITH h AS (SELECT event_type, {', '.join(f'sum((value <= {b})::INT) AS c{i}' for i, b in enumerate(BOUNDS))}, 0.95 * count(*) AS target FROM events GROUP BY event_type)
SELECT event_type, round(CASE {' '.join(f'WHEN c{i} >= target THEN {BOUNDS[i - 1] if i else 0} + {BOUNDS[i] - (BOUNDS[i - 1] if i else 0)} * (target - {f"c{i-1}" if i else 0}) / (c{i} - {f"c{i-1}" if i else 0})' for i in range(len(BOUNDS)))} ELSE {BOUNDS[-1]} END, 6) AS p95 FROM h""")
def histogram_quantile(spark, sf):
    """Within the first bucket that reaches the rank, by linear interpolation."""
    g = table(spark, sf, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"c{i}") for i, b in enumerate(BOUNDS)], (0.95 * F.count("*")).alias("target"))
    out = None
    for i, b in enumerate(BOUNDS):
        low, before = (BOUNDS[i - 1], F.col(f"c{i - 1}")) if i else (0.0, F.lit(0))
        value = low + (b - low) * (F.col("target") - before) / (F.col(f"c{i}") - before)
        out = F.when(F.col(f"c{i}") >= F.col("target"), value) if out is None else out.when(F.col(f"c{i}") >= F.col("target"), value)
    return g.select("event_type", F.round(out.otherwise(BOUNDS[-1]), 6).alias("p95"))


def buckets(e: DataFrame, tool: str, width_s: int, count: int) -> DataFrame:
    """Tumbling buckets that end at AS_OF, aligned to it, with empty ones."""
    start = F.unix_micros(F.lit(AS_OF).cast("timestamp")) - width_s * count * 1_000_000
    number = F.floor((F.col("us") - start) / (width_s * 1_000_000))
    own = e.withColumn("bucket", number.cast("int")).filter((F.col("us") >= start) & (F.col("bucket") < count))
    g = own.groupBy(tool, "bucket").agg(F.count("*").alias("n"), F.count_if("ok").alias("success"), F.avg("value").alias("latency"), F.avg("confidence").alias("confidence"), F.sum("cost").alias("cost"))
    spine = e.select(tool).distinct().crossJoin(e.sparkSession.range(count).select(F.col("id").cast("int").alias("bucket")))
    return spine.join(g, [tool, "bucket"], "left").fillna(0, ["n", "success", "latency", "confidence", "cost"])


TREND_SQL = f"""(SELECT t.event_type, b.bucket, coalesce(n, 0) AS n, coalesce(success, 0) AS success, coalesce(latency, 0) AS latency, coalesce(confidence, 0) AS confidence, coalesce(cost, 0) AS cost
FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT range AS bucket FROM range(28)) b LEFT JOIN
(SELECT event_type, (us - (epoch_us(TIMESTAMP '{AS_OF}') - 604800000000)) // 21600000000 AS bucket, count(*) AS n, sum(ok::INT) AS success, avg(value) AS latency, avg(confidence) AS confidence, sum(cost) AS cost
FROM {E_SQL} WHERE us >= epoch_us(TIMESTAMP '{AS_OF}') - 604800000000 GROUP BY 1, 2) g ON g.event_type = t.event_type AND g.bucket = b.bucket)"""


@query(f"SELECT event_type, bucket::INT AS bucket, n, success::BIGINT AS success, round(latency, 6) AS latency, round(confidence, 6) AS confidence, round(cost, 6) AS cost FROM {TREND_SQL}")
def tumbling_buckets(spark, sf):
    out = buckets(_events(spark, sf), "event_type", 21_600, 28)
    return out.withColumns({c: F.round(c, 6) for c in ("latency", "confidence", "cost")}).select("event_type", "bucket", "n", "success", "latency", "confidence", "cost")


@query(f"""WITH h AS (SELECT event_type, avg(CASE WHEN bucket < 14 THEN CASE WHEN n > 0 THEN success / n ELSE 0 END END) AS s1, avg(CASE WHEN bucket >= 14 THEN CASE WHEN n > 0 THEN success / n ELSE 0 END END) AS s2,
avg(CASE WHEN bucket < 14 THEN latency END) AS l1, avg(CASE WHEN bucket >= 14 THEN latency END) AS l2 FROM {TREND_SQL} GROUP BY event_type)
SELECT event_type, CASE WHEN s2 - s1 > 0.05 THEN 'improving' WHEN s2 - s1 < -0.05 THEN 'degrading' ELSE 'stable' END AS success_trend,
CASE WHEN l2 < l1 * 0.9 THEN 'improving' WHEN l2 > l1 * 1.1 THEN 'degrading' ELSE 'stable' END AS latency_trend FROM h""")
def trend(spark, sf):
    """Means of the later half of the buckets against the earlier half, empty buckets counting as 0."""
    b = buckets(_events(spark, sf), "event_type", 21_600, 28)
    first, rate = F.col("bucket") < 14, F.when(F.col("n") > 0, F.col("success") / F.col("n")).otherwise(0.0)
    g = b.groupBy("event_type").agg(F.avg(F.when(first, rate)).alias("s1"), F.avg(F.when(~first, rate)).alias("s2"), F.avg(F.when(first, F.col("latency"))).alias("l1"), F.avg(F.when(~first, F.col("latency"))).alias("l2"))
    change = F.col("s2") - F.col("s1")
    success = F.when(change > 0.05, "improving").when(change < -0.05, "degrading").otherwise("stable")
    latency = F.when(F.col("l2") < F.col("l1") * 0.9, "improving").when(F.col("l2") > F.col("l1") * 1.1, "degrading").otherwise("stable")
    return g.select("event_type", success.alias("success_trend"), latency.alias("latency_trend"))


@query(f"""SELECT event_type, (n2 - n1)::BIGINT AS change, round(CASE WHEN l1 > 0 THEN (l2 - l1) / l1 * 100 ELSE 0 END, 6) AS latency_percent, round(s2 - s1, 6) AS success_change, s2 >= s1 AND l2 <= l1 AS improving FROM
(SELECT event_type, sum((us < m)::INT) AS n1, sum((us >= m)::INT) AS n2, avg(CASE WHEN us < m THEN value END) AS l1, avg(CASE WHEN us >= m THEN value END) AS l2, avg(CASE WHEN us < m THEN ok::INT END) AS s1, avg(CASE WHEN us >= m THEN ok::INT END) AS s2
FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-15 00:00:00') AS m FROM {E_SQL}) GROUP BY event_type)""")
def compare_windows(spark, sf):
    e = _events(spark, sf)
    late, ok = F.col("ts") >= F.lit("2024-01-15").cast("timestamp"), F.col("ok").cast("int")
    half = lambda c, x: F.avg(F.when(c, x))
    g = e.groupBy("event_type").agg((F.count_if(late) - F.count_if(~late)).alias("change"), half(~late, F.col("value")).alias("l1"), half(late, F.col("value")).alias("l2"), half(~late, ok).alias("s1"), half(late, ok).alias("s2"))
    return g.select("event_type", "change", F.round(F.when(F.col("l1") > 0, (F.col("l2") - F.col("l1")) / F.col("l1") * 100).otherwise(0.0), 6).alias("latency_percent"), F.round(F.col("s2") - F.col("s1"), 6).alias("success_change"), ((F.col("s2") >= F.col("s1")) & (F.col("l2") <= F.col("l1"))).alias("improving"))


RUNS_SQL = "(SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)"


@query(f"SELECT user_id, max(n)::BIGINT AS longest FROM (SELECT user_id, island, sum((event_type = 'error')::INT) AS n FROM {RUNS_SQL} GROUP BY user_id, island) GROUP BY user_id")
def failure_runs(spark, sf):
    """The longest run of failures of each user: a success begins another island."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf, "events").withColumn("island", F.sum((F.col("event_type") != "error").cast("int")).over(order))
    return e.groupBy("user_id", "island").agg(F.count_if(F.col("event_type") == "error").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("""SELECT event_id, round(avg((event_type = 'error')::INT) OVER w, 6) AS failure_rate, round(avg(value) OVER w, 6) AS latency FROM (SELECT *, epoch_us(ts) AS us FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)""")
def sliding_rates(spark, sf):
    """The last 300 seconds of each user, the older end exclusive."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-299_999_999, 0)
    return _events(spark, sf).select("event_id", F.round(F.avg((F.col("event_type") == "error").cast("int")).over(w), 6).alias("failure_rate"), F.round(F.avg("value").over(w), 6).alias("latency"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS running FROM events")
def running_mean(spark, sf):
    """By hours: an hour begins with what the hours before it add up to."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    summed = running(table(spark, sf, "events").select("event_id", "event_type", "ts", "value"), "event_type", hour, ["ts", "event_id"], "value")
    return summed.select("event_id", F.round(F.col("run_sum") / F.col("run_count") + 1e-9, 6).alias("running"))


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50")
def newest_per_key(spark, sf):
    """A ring of fifty per key."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w)).filter("n <= 50").select("event_type", "event_id")


@query("""SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS start_us, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def tumbling_window(spark, sf):
    g = _events(spark, sf).groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "mean")


@query("""SELECT s AS start_us, count(*) AS n FROM (SELECT unnest(range((epoch_us(ts) // 3600000000 - 3) * 3600000000, (epoch_us(ts) // 3600000000 + 1) * 3600000000, 3600000000)) AS s FROM events) GROUP BY s""")
def hopping_window(spark, sf):
    g = _events(spark, sf).groupBy(F.window("ts", "4 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "n")


@query("""SELECT user_id, min(us) AS start_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, (us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) >= 1800000000)::INT AS new FROM (SELECT *, epoch_us(ts) AS us FROM events))) GROUP BY user_id, coalesce(s, 0)""")
def session_windows(spark, sf):
    """Events of a user that follow one another within half an hour."""
    g = _events(spark, sf).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("""SELECT frm, dst, count(*) AS n FROM (SELECT event_type AS dst, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frm FROM events) WHERE frm <> dst GROUP BY frm, dst""")
def tool_dependencies(spark, sf):
    """How often one tool follows another in a user's stream, itself apart."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").select(before.alias("frm"), F.col("event_type").alias("dst"))
    return e.filter("frm <> dst").groupBy("frm", "dst").agg(F.count("*").alias("n"))


@query(f"SELECT event_type, round(sum(cost), 6) AS total, count(*) AS paid, max(us) AS last_us FROM {E_SQL} WHERE cost > 0 GROUP BY event_type")
def tool_costs(spark, sf):
    return _events(spark, sf).filter("cost > 0").groupBy("event_type").agg(F.round(F.sum("cost"), 6).alias("total"), F.count("*").alias("paid"), F.max("us").alias("last_us"))


@query(f"SELECT user_id, round(exp(avg(ln(confidence))), 6) AS confidence FROM {E_SQL} GROUP BY user_id")
def aggregate_confidence(spark, sf):
    """The geometric mean."""
    return _events(spark, sf).groupBy("user_id").agg(F.round(F.exp(F.avg(F.log("confidence"))), 6).alias("confidence"))


@query("""SELECT event_type, calls, round(mean, 6) AS p50, round(2 * mean, 6) AS p99 FROM (SELECT event_type, count(*) AS calls, avg(value) AS mean FROM events GROUP BY event_type)""")
def layer_estimate(spark, sf):
    """A rough guess where only means are kept."""
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.avg("value").alias("mean"))
    return g.select("event_type", "calls", F.round("mean", 6).alias("p50"), F.round(2 * F.col("mean"), 6).alias("p99"))


@query("""SELECT user_id, round(coalesce(sum((event_type = 'view')::INT) / nullif(count(*), 0), 0), 6) AS hit_rate, round(coalesce(sum((event_type = 'purchase')::INT) / nullif(sum((event_type = 'view')::INT), 0), 0), 6) AS semantic_share FROM events GROUP BY user_id""")
def cache_stats(spark, sf):
    hits = F.count_if(F.col("event_type") == "view")
    part = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    return table(spark, sf, "events").groupBy("user_id").agg(part(hits, F.count("*")).alias("hit_rate"), part(F.count_if(F.col("event_type") == "purchase"), hits).alias("semantic_share"))


@query("""SELECT user_id, CASE min(severity) WHEN 0 THEN 'unhealthy' WHEN 1 THEN 'busy' WHEN 2 THEN 'degraded' ELSE 'healthy' END AS status FROM
(SELECT user_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS severity FROM events WHERE value > 20) GROUP BY user_id""")
def overall_health(spark, sf):
    """The worst component decides."""
    t = F.col("event_type")
    severity = F.when(t == "error", 0).when(t == "purchase", 1).when(t == "signup", 2).otherwise(3)
    names = F.array(*[F.lit(x) for x in ("unhealthy", "busy", "degraded", "healthy")])
    return table(spark, sf, "events").filter("value > 20").groupBy("user_id").agg(F.get(names, F.min(severity)).alias("status"))


@query("""SELECT start_us, ratio, ratio > 0.2 AS alert FROM (SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, round(sum((event_type = 'error')::INT) / greatest(count(*), 1e-9), 6) AS ratio FROM events GROUP BY 1)""")
def error_ratio_alert(spark, sf):
    g = _events(spark, sf).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.round(F.count_if(F.col("event_type") == "error") / F.greatest(F.count("*"), F.lit(1e-9)), 6).alias("ratio"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "ratio", (F.col("ratio") > 0.2).alias("alert"))


@query("""WITH w AS (SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 3600000000 AS h, avg((event_type = 'error')::INT) > 0.2 AS bad FROM events GROUP BY 1),
g AS (SELECT *, h - row_number() OVER (PARTITION BY bad ORDER BY h) AS island FROM w)
SELECT min(h) AS first_hour, count(*) AS hours FROM g WHERE bad GROUP BY island HAVING count(*) >= 2""")
def sustained_alert(spark, sf):
    """Hours in a row whose error ratio is above a threshold, two at least: one row per hour reaches the window."""
    hours = _events(spark, sf).groupBy(F.floor(F.col("us") / 3_600_000_000).alias("h")).agg((F.avg((F.col("event_type") == "error").cast("int")) > 0.2).alias("bad"))
    g = hours.filter("bad").withColumn("island", F.col("h") - F.row_number().over(Window.orderBy("h")))
    return g.groupBy("island").agg(F.min("h").alias("first_hour"), F.count("*").alias("hours")).filter("hours >= 2").drop("island")


@query("""SELECT user_id, round(sum(CASE WHEN d < 0 THEN value ELSE d END) / 300, 6) AS rate FROM (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) WHERE d IS NOT NULL GROUP BY user_id""")
def counter_rate(spark, sf):
    """The increase of a counter, a fall being a restart from zero."""
    d = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").select("user_id", "value", d.alias("d")).filter("d is not null")
    return e.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("d") < 0, F.col("value")).otherwise(F.col("d"))) / 300, 6).alias("rate"))


@query("SELECT series FROM (SELECT unnest(['view', 'click', 'crash', 'login']) AS series) WHERE series NOT IN (SELECT event_type FROM events)")
def absent_series(spark, sf):
    expected = spark.createDataFrame([("view",), ("click",), ("crash",), ("login",)], "series string")
    return expected.join(table(spark, sf, "events").select(F.col("event_type").alias("series")), "series", "left_anti")


@query("""SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events QUALIFY delta IS NOT NULL""")
def resource_deltas(spark, sf):
    d = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("event_id", d.alias("delta")).filter("delta is not null")


@query("""SELECT 'tool_calls_total{tool="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def prometheus_text(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select(F.format_string('tool_calls_total{tool="%s"} %d', "event_type", "n").alias("line"))


@query("""SELECT event_type, grouping_id(event_type, user_id) AS level, user_id, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id)""")
def rollup_counts(spark, sf):
    g = table(spark, sf, "events").rollup("event_type", "user_id").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return g.select("event_type", "level", "user_id", "n")


@query()
def alert_cooldown(spark, sf):
    """Alerts of each user: runs of five failures or a failure rate of one half over ten calls in 300 s; then silence for 600 s."""
    e = _events(spark, sf).select("user_id", "us", "event_id", (F.col("event_type") == "error").alias("failed"))
    return replayed(e, "user_id", ["us", "event_id"], Alerts, "user_id long, us long, kind string, severity string")


class Alerts:
    """A user's events in order; whether an alert is given depends on the last one given. The calls of 300 s are kept."""

    def __init__(self, user):
        self.user, self.window, self.run, self.last = user, [], 0, None

    def take(self, row) -> list[tuple]:
        us, failed = row.us, bool(row.failed)
        self.run = self.run + 1 if failed else 0
        self.window = [(t, f) for t, f in self.window if t > us - 300_000_000] + [(us, failed)]
        rate = sum(f for _, f in self.window) / len(self.window)
        kind = "failure_rate" if len(self.window) >= 10 and rate >= 0.5 else "consecutive" if self.run >= 5 else None
        if self.run >= 10:
            kind = "consecutive"
        if not kind or (self.last is not None and us - self.last < 600_000_000):
            return []
        self.last = us
        return [(self.user, us, kind, "critical" if rate >= 0.8 or self.run >= 10 else "error")]

    def end(self) -> list[tuple]:
        return []


def replay_alerts(group: pd.DataFrame) -> pd.DataFrame:
    """The alerts of one user's events."""
    alerts = Alerts(group["user_id"].iloc[0])
    rows = [r for row in group.sort_values(["us", "event_id"]).itertuples(index=False) for r in alerts.take(row)]
    return pd.DataFrame(rows, columns=["user_id", "us", "kind", "severity"])


def _at(rule: str) -> str:
    return f"list_sort(list(value))[({rule})::BIGINT + 1]"


@query(f"""SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, sum(value)::BIGINT // count(*) AS int_mean, {', '.join(f"{_at(f'floor((count(*) - 1) * {p} / 100)')} AS p{p}" for p in (50, 95, 99))} FROM events GROUP BY event_type""")
def operation_percentiles(spark, sf):
    """Latencies of each operation: those at the places floor(p (n - 1))."""
    e = table(spark, sf, "events")
    counts = e.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.expr("cast(round(sum(value)) as bigint) div count(*)").alias("int_mean"))
    return at_ranks(e, ["event_type"], "value", {f"p{p}": F.floor((F.col("n") - 1) * p / 100) for p in (50, 95, 99)}).join(counts, "event_type")


@query(f"""SELECT user_id, event_type, count(*) AS n, round(avg(ok::INT), 6) AS success_rate, round(avg(value), 6) AS mean, {', '.join(f"{_at(f'least(count(*) * {p} // 100, count(*) - 1)')} AS p{p}" for p in (50, 95, 99))}
FROM {E_SQL} WHERE us > epoch_us(TIMESTAMP '2024-01-15 12:00:00') - 604800000000 AND us <= epoch_us(TIMESTAMP '2024-01-15 12:00:00') GROUP BY user_id, event_type""")
def tool_trend(spark, sf):
    """Each user's calls of each tool in the week that ends at a given moment: successes and latencies."""
    at = F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp"))
    e = _events(spark, sf).filter((F.col("us") > at - 604_800_000_000) & (F.col("us") <= at))
    means = e.groupBy("user_id", "event_type").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("success_rate"), F.round(F.avg("value"), 6).alias("mean"))
    return at_ranks(e, ["user_id", "event_type"], "value", {f"p{p}": F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1) for p in (50, 95, 99)}).join(means, ["user_id", "event_type"])


@query(f"""WITH w AS (SELECT event_type, epoch_us(ts) // 21600000000 AS w, {_at('floor((count(*) - 1) * 99 / 100)')} > 30 AS bad FROM events GROUP BY 1, 2),
g AS (SELECT *, w - row_number() OVER (PARTITION BY event_type ORDER BY w) AS island FROM w WHERE bad)
SELECT event_type, min(w) AS first_window, count(*) AS windows FROM g GROUP BY event_type, island HAVING count(*) >= 2""")
def sustained_p99(spark, sf):
    """Windows of six hours in a row, two at least, in which a tool's 99th percentile is above a threshold."""
    e = _events(spark, sf).withColumn("w", F.floor(F.col("us") / 21_600_000_000))
    windows = at_ranks(e, ["event_type", "w"], "value", {"p99": F.floor((F.col("n") - 1) * 99 / 100)}).filter("p99 > 30")
    g = windows.withColumn("island", F.col("w") - F.row_number().over(Window.partitionBy("event_type").orderBy("w")))
    return g.groupBy("event_type", "island").agg(F.min("w").alias("first_window"), F.count("*").alias("windows")).filter("windows >= 2").drop("island")
