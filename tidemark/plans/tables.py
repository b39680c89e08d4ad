"""Keyed tables and their files: staging, partitions, logs, caches and listings."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import filters
from tidemark.operators.replay import replayed
from tidemark.plans.curate import PAIRS_SQL, examples
from tidemark.registry import Registry
from tidemark.session import table
from tidemark.sources import sinks as S

query = Registry()


@query("SELECT vec_id, len(embedding) AS dim FROM embeddings")
def staged_reindex(spark, sf):
    """Rebuilt beside the old version, checked, then published."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dim"))
    return S.staged(rows, S.scratch(spark, "index"), F.col("dim") == 64)


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 3 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def partition_replace(spark, sf):
    """One nation's customers written again; the other partitions stay."""
    rows, target = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), S.scratch(spark, "customers")
    S.replace_partitions(rows, target, "c_nationkey")
    S.replace_partitions(rows.filter("c_nationkey = 3").withColumn("c_acctbal", F.lit(0.0)), target, "c_nationkey")
    return spark.read.parquet(target).select("c_custkey", F.col("c_nationkey").cast("int"), "c_acctbal")


@query("SELECT doc_id, chunk_index FROM (SELECT doc_id, unnest(range(doc_id % 4 + 1)) AS chunk_index FROM documents) WHERE doc_id NOT IN (1, 2, 3)")
def delete_documents(spark, sf):
    chunks = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 4)).alias("chunk_index"))
    return S.delete_keys(chunks, spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"), "doc_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def compact_log(spark, sf):
    """A log appended in two parts, then reduced to the last write of each key."""
    e, target = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), S.scratch(spark, "log")
    for part in (0, 1):
        e.filter(F.col("event_id") % 2 == part).write.mode("append").option("compression", "lz4").parquet(target)
    return S.compacted(spark.read.parquet(target), "user_id", "event_id")


@query(f"SELECT conv_id, turn, instruction, response, score FROM {PAIRS_SQL}")
def json_round_trip(spark, sf):
    """Examples as JSON lines among malformed ones, which the reader drops."""
    target = S.scratch(spark, "examples")
    examples(spark, sf).write.mode("append").json(target)
    spark.createDataFrame([("{broken",), ("not json",)], "value string").write.mode("append").text(target)
    schema = "conv_id long, turn long, instruction string, response string, score long"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(target)


@query("""SELECT 'event: change' || chr(10) || 'data: {"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' || chr(10) || chr(10) AS line FROM nation""")
def event_lines(spark, sf):
    return S.server_sent(table(spark, sf, "nation").select("n_nationkey", "n_name"), "change")


@query("SELECT 1000 + c_custkey AS src, 100 + c_nationkey AS dst, 0.8 AS confidence FROM customer WHERE c_nationkey < 10 AND c_custkey % 3 = 0".replace("0.8", "0.8::DOUBLE"))
def graph_load(spark, sf):
    """A graph file's relations: the default confidence where none is given, dangling ones dropped by a semi-join on both ends."""
    c = table(spark, sf, "customer")
    target = S.scratch(spark, "graph")
    edges = c.select((1000 + F.col("c_custkey")).alias("from_id"), (100 + F.col("c_nationkey").cast("long")).alias("to_id"), F.lit(None).cast("double").alias("confidence"))
    edges.write.json(target)
    nodes = c.filter("c_custkey % 3 = 0").select((1000 + F.col("c_custkey")).alias("id")).union(spark.range(100, 110))
    read = spark.read.schema("from_id long, to_id long, confidence double").json(target)
    both = read.join(nodes.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(nodes.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return both.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"))


@query("SELECT md5(text) AS digest, doc_id FROM documents WHERE doc_id >= 100 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 100)")
def new_content(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("digest"), "doc_id")
    return d.filter("doc_id >= 100").join(d.filter("doc_id < 100"), "digest", "left_anti")


BITS, HASHES = 1 << 14, 7


@query()
def bloom_membership(spark, sf):
    """Ids of customers probed in a filter of orders' customers: the filter is the table of its set bits, at most 2^14 rows."""
    places = lambda c: F.array(*[F.pmod(F.xxhash64(c, F.lit(i)), F.lit(BITS)) for i in range(HASHES)])
    known = table(spark, sf, "orders").select("o_custkey").distinct()
    bits = known.select(F.explode(places(F.col("o_custkey"))).alias("bit")).distinct()
    probe = table(spark, sf, "customer").select("c_custkey", F.explode(places(F.col("c_custkey"))).alias("bit"))
    hits = probe.join(F.broadcast(bits), "bit", "left_semi").groupBy("c_custkey").agg(F.count("*").alias("n"))
    return hits.filter(F.col("n") == HASHES).select("c_custkey")


CELLS, CELL_HASHES = filters.sizes(2_000, 0.01)


def _cells_sql(key: str) -> str:
    part = lambda start: f"('0x' || substr(md5({key}::VARCHAR), {start}, 12))::BIGINT"
    return f"list_distinct(list_transform(range({CELL_HASHES}), lambda i: ({part(1)} + i * ({part(13)} + 1)) % {CELLS}))"


def parts_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A filter of the parts of all lines but those of suppliers divisible by five, made of two halves that are united and then taken from."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    parts = lambda where: filters.counted(lines.filter(where).select("l_partkey").distinct(), "l_partkey", CELLS, CELL_HASHES, filters.EXACT)
    both = filters.united(parts("l_partkey % 2 = 0"), parts("l_partkey % 2 = 1"), most=filters.EXACT)
    gone = lines.filter("l_suppkey % 5 = 0").select("l_partkey").distinct().join(lines.filter("l_suppkey % 5 <> 0").select("l_partkey").distinct(), "l_partkey", "left_anti")
    return filters.taken(both, filters.counted(gone, "l_partkey", CELLS, CELL_HASHES, filters.EXACT), filters.EXACT)


@query(f"SELECT cell, count(*)::INT AS n FROM (SELECT unnest({_cells_sql('l_partkey')}) AS cell FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey % 5 <> 0)) GROUP BY cell")
def counting_filter(spark, sf):
    """Cells after union and removal are those of the keys that remain."""
    return parts_filter(spark, sf)


@query(f"""WITH f AS (SELECT DISTINCT unnest({_cells_sql('l_partkey')}) AS cell FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey % 5 <> 0))
SELECT p_partkey, len(c) = (SELECT count(*) FROM f WHERE list_contains(c, cell)) AS maybe FROM (SELECT p_partkey, {_cells_sql('p_partkey')} AS c FROM part)""")
def filter_membership(spark, sf):
    """Which parts may be in the filter."""
    return filters.probed(table(spark, sf, "part"), "p_partkey", parts_filter(spark, sf), CELLS, CELL_HASHES)


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1")
def counting_membership(spark, sf):
    """Exact counts, where the sketch only bounds them."""
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query()
def count_sketch(spark, sf):
    """A count-min sketch of the parts of all lines."""
    return table(spark, sf, "lineitem").agg(F.count_min_sketch("l_partkey", F.lit(0.01), F.lit(0.95), F.lit(7)).alias("sketch"))


@query("SELECT approx AS exact FROM (SELECT count(DISTINCT l_partkey) AS approx FROM lineitem)")
def distinct_parts(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count_distinct("l_partkey").alias("exact"))


@query("""SELECT event_id, sha256(event_type || '|' || user_id) AS cache_key, ts < TIMESTAMP '2024-01-30' - INTERVAL '5 minutes' AND event_type <> 'view' AS expired FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""")
def result_cache(spark, sf):
    """The newest result of each tool and query; views never expire, others after five minutes."""
    w = Window.partitionBy("event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf, "events").withColumn("n", F.row_number().over(w)).filter("n = 1")
    old = F.col("ts") < F.lit("2024-01-29 23:55:00").cast("timestamp_ntz")
    return e.select("event_id", F.sha2(F.concat("event_type", F.lit("|"), F.col("user_id").cast("string")), 256).alias("cache_key"), (old & (F.col("event_type") != "view")).alias("expired"))


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 120)")
def cache_invalidation(spark, sf):
    """Entries whose user had no trigger."""
    e = table(spark, sf, "events")
    return e.join(e.filter("event_type = 'signup' and value > 120").select("user_id"), "user_id", "left_anti").select("event_id")


@query()
def lru_replay(spark, sf):
    """Hits of a cache of eight queries per user, replayed in order."""

    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.get_json_object("props", "$.k").cast("long").alias("key"))
    return replayed(e, "user_id", ["us", "event_id"], RecentKeys, "user_id long, requests long, hits long")


class RecentKeys:
    """The eight keys asked for last; counts the requests for one of them."""

    def __init__(self, user, size: int = 8):
        self.user, self.size, self.held, self.requests, self.hits = user, size, {}, 0, 0

    def take(self, row) -> list[tuple]:
        self.requests += 1
        self.hits += row.key in self.held
        self.held.pop(row.key, None)
        self.held[row.key] = None
        if len(self.held) > self.size:
            self.held.pop(next(iter(self.held)))
        return []

    def end(self) -> list[tuple]:
        return [(self.user, self.requests, self.hits)]


@query("SELECT (props->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_field_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 20 OFFSET 5")
def browse_examples(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role").orderBy(F.desc("conv_id"), F.desc("turn")).offset(5).limit(20)


LIST_SQL = "p_size || ',' || p_partkey % 7 || ', ' || p_retailprice || CASE WHEN p_partkey % 5 = 0 THEN ',x' ELSE '' END"


@query(f"""SELECT p_partkey, CASE WHEN len(list_filter(b, lambda x: x IS NULL OR x <= 0)) = 0 THEN list_sort(b) ELSE [0.1, 1.0] END AS buckets FROM (SELECT p_partkey, list_transform(string_split({LIST_SQL}, ','), lambda x: try_cast(trim(x) AS DOUBLE)) AS b FROM part)""")
def parse_buckets(spark, sf):
    """Comma lists, one of each part: positive numbers, sorted; the default if any is bad."""
    text = lambda c: F.col(c).cast("string")
    listed = F.concat(text("p_size"), F.lit(","), (F.col("p_partkey") % 7).cast("string"), F.lit(", "), text("p_retailprice"), F.when(F.col("p_partkey") % 5 == 0, ",x").otherwise(""))
    parts = F.transform(F.split(listed, ","), lambda x: F.trim(x).try_cast("double"))
    rows = table(spark, sf, "part").select("p_partkey", parts.alias("b"))
    good = F.forall("b", lambda x: x.isNotNull() & (x > 0))
    return rows.select("p_partkey", F.when(good, F.array_sort("b")).otherwise(F.array(F.lit(0.1), F.lit(1.0))).alias("buckets"))


@query("""SELECT lang AS mode, count(*) AS files, sum(length(text))::BIGINT AS chars_in, sum(length(replace(text, ' ', '')))::BIGINT AS chars_out FROM documents GROUP BY lang""")
def preprocess_stats(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("mode")).agg(F.count("*").alias("files"), F.sum(F.length(t)).alias("chars_in"), F.sum(F.length(F.replace(t, F.lit(" "), F.lit("")))).alias("chars_out"))


@query("""SELECT source, round(avg(n), 6) AS mean_tokens, max(n)::BIGINT AS most_tokens, round(avg(CASE WHEN n > 100 THEN n / 2000 END), 6) AS context_use, CASE WHEN sum((n > 500)::INT) = 0 THEN 'exact' WHEN sum((n <= 500)::INT) = 0 THEN 'heuristic' ELSE 'mixed' END AS label
FROM (SELECT source, doc_id, strlen(text) // 4 AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 100) GROUP BY source""")
def token_ring(spark, sf):
    """Figures of the last hundred of each source."""
    w = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    d = table(spark, sf, "documents").select("source", F.floor(F.octet_length("text") / 4).alias("n"), F.row_number().over(w).alias("rn")).filter("rn <= 100")
    n = F.col("n")
    label = F.when(F.count_if(n > 500) == 0, "exact").when(F.count_if(n <= 500) == 0, "heuristic").otherwise("mixed")
    return d.groupBy("source").agg(F.round(F.avg("n"), 6).alias("mean_tokens"), F.max("n").alias("most_tokens"), F.round(F.avg(F.when(n > 100, n / 2000)), 6).alias("context_use"), label.alias("label"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS percent FROM orders GROUP BY 1, 2""")
def route_mix(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return g.select("o_orderpriority", "o_orderstatus", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("o_orderpriority")), 6).alias("percent"))


@query("""SELECT lang, sum((n_chars > 0)::INT)::BIGINT AS ok, sum((n_chars = 0)::INT)::BIGINT AS empty, k.n AS expected FROM (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS key, 4 AS n) k LEFT JOIN documents ON lang = key WHERE lang IS NOT NULL GROUP BY lang, k.n""")
def extraction_stats(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("lang").isin("en", "de", "fr", "es", "it"))
    return d.groupBy("lang").agg(F.count_if(F.col("n_chars") > 0).alias("ok"), F.count_if(F.col("n_chars") == 0).alias("empty")).withColumn("expected", F.lit(4))


@query("""SELECT k AS page_type, count(doc_id) AS pages FROM (SELECT unnest(['long', 'short', 'empty', 'huge']) AS k) LEFT JOIN (SELECT doc_id, CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 100000 THEN 'long' ELSE 'huge' END AS c FROM documents) ON c = k GROUP BY k""")
def forced_histogram(spark, sf):
    """All canonical keys are present, also those without rows."""
    n = F.col("n_chars")
    kind = F.when(n == 0, "empty").when(n < 1000, "short").when(n < 100000, "long").otherwise("huge")
    g = table(spark, sf, "documents").groupBy(kind.alias("page_type")).agg(F.count("*").alias("pages"))
    keys = spark.createDataFrame([("long",), ("short",), ("empty",), ("huge",)], "page_type string")
    return keys.join(F.broadcast(g), "page_type", "left").fillna(0, ["pages"])


GOAL = ("nations", "with", "stories", "that", "eauaux")


@query(f"""SELECT conv_id, bool_or(len(list_intersect(list_distinct(string_split_regex(lower(text), '[ \t\n\r]+')), [{', '.join(f"'{w}'" for w in GOAL)}])) >= 2) AS related FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def goal_match(spark, sf):
    """Conversations with a turn that shares two words of more than three letters with an active goal."""
    hits = F.size(F.array_intersect(T.words(F.lower("text")), F.array(*[F.lit(w) for w in GOAL]))) >= 2
    return table(spark, sf, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.bool_or(hits).alias("related"))


@query("SELECT doc_id, quality, CASE toxic WHEN 1 THEN 'high' ELSE CASE quality WHEN 1 THEN 'low' ELSE 'medium' END END AS priority FROM labels")
def memory_priority(spark, sf):
    return table(spark, sf, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 1, "low").otherwise("medium").alias("priority"))


@query("SELECT '| ' || substr(n_name, 1, 100) || ' | ' || substr(r_name, 1, 100) || ' |' AS line FROM (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name LIMIT 50)")
def adhoc_select(spark, sf):
    """The first fifty rows of a checked SELECT as lines of a grid, strings cut at 100."""
    for name in ("nation", "region"):
        table(spark, sf, name).createOrReplaceTempView(name)
    rows = spark.sql("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name").limit(50)
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.substring(c, 1, 100) for c in rows.columns]), F.lit(" |")).alias("line"))


LISTED = ("nation", "region", "supplier", "labels")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, 'TEMPORARY' AS kind, count(*) AS n FROM {t}" for t in LISTED))
def list_tables(spark, sf):
    """Tables that a session knows, here those that it has just been given, with their rows."""
    for name in LISTED:
        table(spark, sf, name).createOrReplaceTempView(name)
    known = [t for t in spark.catalog.listTables() if t.name in LISTED]
    parts = [spark.table(t.name).agg(F.count("*").alias("n")).select(F.lit(t.name).alias("name"), F.lit(t.tableType).alias("kind"), "n") for t in known]
    return reduce(DataFrame.union, parts)


@query(r"""SELECT mode, count(*) AS files, sum(length(t))::BIGINT AS chars_in, sum(length(out))::BIGINT AS chars_out, sum(tags)::BIGINT AS tags FROM (SELECT 'html' AS mode, html AS t, regexp_replace(html, '<[^>]*>', '', 'g') AS out, len(regexp_extract_all(html, '<[^>]*>')) AS tags FROM pages
UNION ALL SELECT CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'unicode' ELSE 'passthrough' END, text, regexp_replace(text, '[ \t]+', ' ', 'g'), 0 FROM documents) GROUP BY mode""")
def preprocess_modes(spark, sf):
    """Files, characters in and out and tags taken out by how a text is prepared."""
    tag = "<[^>]*>"
    html = table(spark, sf, "pages").select(F.lit("html").alias("mode"), F.col("html").alias("t"), F.regexp_replace("html", tag, "").alias("out"), F.size(F.regexp_extract_all("html", F.lit(tag), F.lit(0))).alias("tags"))
    plain = table(spark, sf, "documents").select(F.when(F.col("text").rlike(r"[^\x00-\x7F]"), "unicode").otherwise("passthrough").alias("mode"), F.col("text").alias("t"), F.regexp_replace("text", "[ \t]+", " ").alias("out"), F.lit(0).alias("tags"))
    return html.union(plain).groupBy("mode").agg(F.count("*").alias("files"), F.sum(F.length("t")).alias("chars_in"), F.sum(F.length("out")).alias("chars_out"), F.sum("tags").cast("long").alias("tags"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'user' ELSE role END AS role, CASE WHEN turn % 2 = 0 THEN '' ELSE text END AS output FROM conversations ORDER BY conv_id, turn LIMIT 50 OFFSET 20""")
def browse_defaults(spark, sf):
    """A page of JSON lines, with defaults for the keys that a line lacks."""
    c = table(spark, sf, "conversations")
    line = F.to_json(F.struct("conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("role")).alias("role"), F.when(F.col("turn") % 2 != 0, F.col("text")).alias("output")))
    read = c.select(F.from_json(line, "conv_id long, turn long, role string, output string").alias("x")).select("x.*")
    return read.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("output", F.lit("")).alias("output")).orderBy("conv_id", "turn").offset(20).limit(50)


def register(spark: SparkSession) -> None:
    """The text functions under SQL names."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION token_estimate(s STRING) RETURNS BIGINT RETURN (octet_length(s) div 4 + size(filter(split(s, '[ \\\\t\\\\n\\\\r]+'), x -> length(x) > 0)) * 4 div 3) div 2")


@query(r"SELECT doc_id, ((strlen(text) // 4) + (len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: length(x) > 0)) * 4 // 3)) // 2 AS tokens FROM documents")
def sql_functions(spark, sf):
    """The estimate by its registered SQL name."""
    register(spark)
    return table(spark, sf, "documents").select("doc_id", F.call_function("token_estimate", F.col("text")).alias("tokens"))
