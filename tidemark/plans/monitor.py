"""Snapshots of a running service, from its events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.registry import Registry
from tidemark.session import table

query = Registry()


@query("SELECT user_id, n, round(errors / n, 6) AS error_rate, slow FROM (SELECT user_id, count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS errors, sum((value > 50)::INT)::BIGINT AS slow FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-27' GROUP BY user_id) WHERE errors / n > 0.2 OR slow > 3")
def trace_anomalies(spark, sf):
    """Users of a week with too many errors or slow calls."""
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    e = table(spark, sf, "events").filter((F.col("ts") >= day("2024-01-20")) & (F.col("ts") < day("2024-01-27")))
    g = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("slow"))
    return g.filter((F.col("errors") / F.col("n") > 0.2) | (F.col("slow") > 3)).select("user_id", "n", F.round(F.col("errors") / F.col("n"), 6).alias("error_rate"), "slow")


@query("SELECT count(*) AS total, sum((event_type <> 'error')::INT)::BIGINT AS successful FROM events WHERE ts >= TIMESTAMP '2024-01-25'")
def reflection_summary(spark, sf):
    e = table(spark, sf, "events").filter(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz"))
    return e.agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("successful"))


@query("SELECT event_type, [1.0, 2.0, 5.0, 10.0, 20.0, 50.0]::DOUBLE[][round(5 * 0.5)::INT + 1] AS p50, [1.0, 2.0, 5.0, 10.0, 20.0, 50.0]::DOUBLE[][round(5 * 0.95)::INT + 1] AS p95, count(*) AS n FROM events GROUP BY event_type".replace("[1.0, 2.0, 5.0, 10.0, 20.0, 50.0]::DOUBLE[]", "([1.0, 2.0, 5.0, 10.0, 20.0, 50.0]::DOUBLE[])"))
def bucket_percentiles(spark, sf):
    """Read off the bounds alone, whatever the counts: a known approximation beside `histogram_quantile`."""
    bounds = F.array(*[F.lit(x) for x in (1.0, 2.0, 5.0, 10.0, 20.0, 50.0)])
    at = lambda p: F.get(bounds, F.round(F.lit(5 * p)).cast("int"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", at(0.5).alias("p50"), at(0.95).alias("p95"), "n")


@query("SELECT map_from_entries([('tool', event_type)])['tool'] AS tool, user_id % 4 AS server, sum(value > 10)::BIGINT AS drops FROM events GROUP BY 1, 2".replace("sum(value > 10)", "sum((value > 10)::INT)").replace("map_from_entries([('tool', event_type)])['tool']", "event_type"))
def drops_by_label(spark, sf):
    """Counters by their labels, a map."""
    labels = F.create_map(F.lit("tool"), F.col("event_type"), F.lit("server"), (F.col("user_id") % 4).cast("string"))
    e = table(spark, sf, "events").select(labels.alias("l"), "value")
    return e.groupBy(F.col("l")["tool"].alias("tool"), F.col("l")["server"].cast("long").alias("server")).agg(F.count_if(F.col("value") > 10).alias("drops"))


@query("SELECT source, configured, observed, configured <> observed AS drifted FROM (SELECT source, CASE WHEN source IN ('src0', 'src1') THEN 'en' ELSE 'de' END AS configured, arg_max(lang, struct_pack(n := n, l := lang)) AS observed FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source)")
def config_drift(spark, sf):
    """What a corpus is said to be against what it mostly is."""
    g = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("observed"))
    said = F.when(F.col("source").isin("src0", "src1"), "en").otherwise("de")
    return g.select("source", said.alias("configured"), "observed", (said != F.col("observed")).alias("drifted"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND length(text) > 100 ORDER BY conv_id DESC, turn DESC LIMIT 15 OFFSET 3")
def list_observations(spark, sf):
    c = table(spark, sf, "conversations").filter((F.col("role") == "user") & (F.length("text") > 100))
    return c.select("conv_id", "turn", "text").orderBy(F.desc("conv_id"), F.desc("turn")).offset(3).limit(15)


@query("SELECT source, lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1")
def chunking_snapshots(spark, sf):
    """The newest snapshot of each file and corpus."""
    w = Window.partitionBy("source", "lang").orderBy(F.desc("doc_id"))
    return table(spark, sf, "documents").withColumn("n", F.row_number().over(w)).filter("n = 1").select("source", "lang", "doc_id", "n_chars")


@query("SELECT event_type, round(100 * sum((value < 10)::INT) / count(*), 6) AS hit_percent, round(sum(value) / count(*), 6) AS mean_ms, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type")
def runtime_snapshot(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(100 * F.count_if(v < 10) / F.count("*"), 6).alias("hit_percent"), F.round(F.sum(v) / F.count("*"), 6).alias("mean_ms"), F.round(F.max(v) - F.min(v), 6).alias("spread"))


@query("SELECT c.c_mktsegment, q.least, q.middle, q.most FROM (SELECT DISTINCT c_mktsegment FROM customer) c JOIN (SELECT c_mktsegment, min(c_acctbal) AS least, quantile_disc(c_acctbal, 0.5) AS middle, max(c_acctbal) AS most FROM customer GROUP BY 1) q USING (c_mktsegment)")
def five_numbers(spark, sf):
    """Nearest-rank medians by segment, exact."""
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("least"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY c_acctbal)").alias("middle"), F.max("c_acctbal").alias("most"))
