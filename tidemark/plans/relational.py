"""Filters, joins, sorts, set operations and keyed writes over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import ring
from tidemark.operators.replay import replayed
from tidemark.registry import Registry
from tidemark.session import table

query = Registry()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 2")
def equality_filters(spark, sf):
    df = table(spark, sf, "lineitem")
    for column, value in {"l_returnflag": "R", "l_linestatus": "F", "l_linenumber": 2}.items():
        df = df.filter(F.col(column) == value)
    return df.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-03-31' AND o_orderstatus = 'O'")
def range_filters(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-03-31").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1%' AND NOT c_name LIKE '%2%'")
def like_filters(spark, sf):
    return table(spark, sf, "customer").filter(F.col("c_name").like("%1%") & ~F.col("c_name").like("%2%")).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9, 77, 100)")
def in_list(spark, sf):
    return table(spark, sf, "customer").filter(F.col("c_custkey").isin(1, 5, 9, 77, 100)).select("c_custkey", "c_name")


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://m.')")
def prefix_filter(spark, sf):
    return table(spark, sf, "pages").filter(F.startswith("url", F.lit("https://m."))).select("page_id", "url")


@query("SELECT s.source, coalesce(s.chunk, 256) AS chunk, coalesce(s.overlap, 32) AS overlap FROM (SELECT source, CASE WHEN count(*) % 2 = 0 THEN 512 END AS chunk, CASE WHEN count(*) % 3 = 0 THEN 64 END AS overlap FROM documents GROUP BY source) s")
def layered_settings(spark, sf):
    """A corpus's own settings over the global ones."""
    own = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return own.select("source", F.coalesce(F.when(F.col("n") % 2 == 0, 512), F.lit(256)).alias("chunk"), F.coalesce(F.when(F.col("n") % 3 == 0, 64), F.lit(32)).alias("overlap"))


@query("SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000")
def inner_join(spark, sf):
    o, c = table(spark, sf, "orders").filter("o_totalprice > 300000"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 49)")
def semi_join(spark, sf):
    big = table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    o = table(spark, sf, "orders").join(big, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_yet_indexed(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, d.doc_id::VARCHAR) AS content FROM documents d LEFT JOIN labels l USING (doc_id)")
def content_or_id(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.col("doc_id").cast("string")).alias("content"))


@query("SELECT md5(text) AS digest, max(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def last_writer_wins(spark, sf):
    """One row per content, named by the last id."""
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("digest")).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS left_n, b.n AS right_n FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey < 60 GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey > 40 GROUP BY 1) b ON a.k = b.k")
def full_outer(spark, sf):
    """As a union and one aggregation: a full outer join can't be broadcast."""
    li = table(spark, sf, "lineitem")
    left, right = (F.col("l_returnflag") == "R") & (F.col("l_suppkey") < 60), (F.col("l_returnflag") == "A") & (F.col("l_suppkey") > 40)
    g = li.filter(left | right).groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(left).alias("a"), F.count_if(right).alias("b"))
    return g.select("k", F.nullif("a", F.lit(0)).alias("left_n"), F.nullif("b", F.lit(0)).alias("right_n"))


@query("""SELECT n_name, customers, suppliers FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON c.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s ON s.k = n_nationkey""")
def optional_matches(spark, sf):
    """Each side is aggregated before it is joined, so nothing fans out."""
    c = table(spark, sf, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, sf, "supplier").filter("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return table(spark, sf, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", "customers", "suppliers")


@query("""WITH a AS (SELECT ts AS anchor FROM events WHERE event_id = 500), b AS (SELECT event_id, 'before' AS side FROM events, a WHERE ts < anchor ORDER BY ts DESC, event_id DESC LIMIT 5), c AS (SELECT event_id, 'after' AS side FROM events, a WHERE ts > anchor ORDER BY ts, event_id LIMIT 5)
SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT 500, 'anchor'""")
def timeline(spark, sf):
    """Five before an anchor and five after it."""
    e = table(spark, sf, "events").select("event_id", "ts")
    anchor = F.broadcast(e.filter("event_id = 500").limit(1).select(F.col("ts").alias("at")))
    near = e.crossJoin(anchor)
    before = near.filter("ts < at").orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("event_id", F.lit("before").alias("side"))
    after = near.filter("ts > at").orderBy("ts", "event_id").limit(5).select("event_id", F.lit("after").alias("side"))
    return before.union(after).union(e.filter("event_id = 500").select("event_id", F.lit("anchor").alias("side")))


@query("""SELECT o_orderkey, l_linenumber AS left_line, r_line AS right_line FROM (SELECT a.l_orderkey AS o_orderkey, a.l_linenumber, b.l_linenumber AS r_line, a.l_quantity AS q1, b.l_quantity AS q2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
WHERE least(q1, q2) > 0.5 * greatest(q1, q2)""")
def overlap_join(spark, sf):
    """Pairs within a key whose sizes overlap by more than half."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    b = li.select("o_orderkey", F.col("l_linenumber").alias("right_line"), F.col("l_quantity").alias("q2"))
    pairs = li.join(b, "o_orderkey").filter("l_linenumber < right_line")
    return pairs.filter(F.least("l_quantity", "q2") > 0.5 * F.greatest("l_quantity", "q2")).select("o_orderkey", F.col("l_linenumber").alias("left_line"), "right_line")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def paged_sort(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(10)


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY nullif(turn % 3, 0) ASC NULLS LAST, conv_id, turn) AS place FROM conversations QUALIFY place <= 30")
def nulls_last_sort(spark, sf):
    few = table(spark, sf, "conversations").orderBy(F.asc_nulls_last(F.nullif(F.col("turn") % 3, F.lit(0))), "conv_id", "turn").limit(30)
    order = Window.orderBy(F.asc_nulls_last(F.nullif(F.col("turn") % 3, F.lit(0))), "conv_id", "turn")
    return few.select("conv_id", "turn", F.row_number().over(order).alias("place"))


@query("(SELECT doc_id, 'en' AS part FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20) UNION ALL (SELECT doc_id, 'de' FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, doc_id LIMIT 30) UNION ALL (SELECT doc_id, 'fr' FROM documents WHERE lang = 'fr' ORDER BY n_chars DESC, doc_id LIMIT 50)")
def proportional_sample(spark, sf):
    d = table(spark, sf, "documents")
    part = lambda lang, k: d.filter(F.col("lang") == lang).orderBy(F.desc("n_chars"), "doc_id").limit(k).select("doc_id", F.lit(lang).alias("part"))
    return part("en", 20).union(part("de", 30)).union(part("fr", 50))


@query("SELECT l_suppkey, l_partkey, revenue FROM (SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY revenue DESC, l_partkey) <= 3")
def top_per_group(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    order = Window.partitionBy("l_suppkey").orderBy(F.desc("revenue"), "l_partkey")
    return g.withColumn("n", F.row_number().over(order)).filter("n <= 3").drop("n")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def assemble_prompt(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("p")))).alias("t"))
    return g.select("conv_id", F.array_join(F.transform("t", lambda x: x["p"]), "\n").alias("prompt"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersection(spark, sf):
    return table(spark, sf, "documents").filter("lang = 'en'").select("doc_id").intersect(table(spark, sf, "labels").filter("quality = 1").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def set_difference(spark, sf):
    return table(spark, sf, "documents").filter("lang = 'en'").select("doc_id").subtract(table(spark, sf, "labels").filter("quality = 1").select("doc_id"))


@query("SELECT o_custkey FROM orders WHERE o_totalprice > 400000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9900")
def set_union(spark, sf):
    a = table(spark, sf, "orders").filter("o_totalprice > 400000").select("o_custkey")
    return a.union(table(spark, sf, "customer").filter("c_acctbal > 9900").select("c_custkey")).distinct()


@query("SELECT conv_id, turn, text FROM (SELECT *, lag(lower(role)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS DISTINCT FROM lower(role)")
def adjacent_dedup(spark, sf):
    """Only a row that follows one like itself is dropped."""
    before = F.lag(F.lower("role")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").withColumn("b", before).filter(~F.lower("role").eqNullSafe(F.col("b"))).select("conv_id", "turn", "text")


@query("SELECT list_sort(list(DISTINCT lang)) AS langs, source FROM documents GROUP BY source")
def set_per_group(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `old` whose key isn't in `new`, and all of `new`."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 100 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT -1, 0.0")
def keyed_upsert(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = old.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100).unionByName(spark.createDataFrame([(-1, 0.0)], "c_custkey long, c_acctbal double"))
    return upsert(old, new, "c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def cascade_delete(spark, sf):
    """What is left of the lines once a nation's customers and their orders are gone."""
    gone = table(spark, sf, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders").join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(orders, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT user_id, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def retention(spark, sf):
    """The newest twenty of each user, none older than a moment."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf, "events").filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return e.withColumn("n", F.row_number().over(w)).filter("n <= 20").select("user_id", "event_id")


@query("SELECT user_id, arg_max(value, struct_pack(t := ts, i := event_id)) AS value, max(event_id) AS last_id FROM events GROUP BY user_id")
def replay_log(spark, sf):
    """An append log replayed: the last write of each key."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("event_id").alias("last_id"))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus IN ('F', 'P') THEN epoch_us(o_orderdate) END AS completed_us FROM orders")
def status_transition(spark, sf):
    done = F.when(F.col("o_orderstatus").isin("F", "P"), F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", done.alias("completed_us"))


@query("SELECT lang, source, n_docs FROM (SELECT lang, source, count(*) AS n_docs FROM documents GROUP BY CUBE (lang, source))")
def cube_counts(spark, sf):
    return table(spark, sf, "documents").cube("lang", "source").agg(F.count("*").alias("n_docs"))


@query("SELECT source, count(*) AS documents, min(doc_id) AS first_id FROM documents GROUP BY source ORDER BY source")
def list_documents(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id")).orderBy("source")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    )


@query("SELECT path, method, coalesce((SELECT arg_min(rule, o) FROM (SELECT unnest(['login', 'search', 'upload']) AS rule, unnest(['/login', '/search', '/upload']) AS pre, unnest([1, 2, 3]) AS o) r WHERE starts_with(path, pre)), 'default') AS rule FROM (SELECT DISTINCT CASE event_type WHEN 'view' THEN '/search/x' WHEN 'click' THEN '/upload' ELSE '/' || event_type END AS path, 'GET' AS method FROM events)")
def route_rules(spark, sf):
    """The first rule in order whose prefix matches, else the default."""
    t = F.col("event_type")
    paths = table(spark, sf, "events").select(F.when(t == "view", "/search/x").when(t == "click", "/upload").otherwise(F.concat(F.lit("/"), t)).alias("path")).distinct()
    rule = F.when(F.startswith("path", F.lit("/login")), "login").when(F.startswith("path", F.lit("/search")), "search").when(F.startswith("path", F.lit("/upload")), "upload").otherwise("default")
    return paths.select("path", F.lit("GET").alias("method"), rule.alias("rule"))


@query("SELECT event_id, CASE WHEN idle >= 86400 * 14 THEN 'cold' WHEN idle >= 86400 * 7 THEN 'warm' ELSE 'hot' END AS tier FROM (SELECT event_id, epoch(TIMESTAMP '2024-01-31') - epoch(ts) AS idle FROM events)")
def storage_tiers(spark, sf):
    idle = F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    day = 86_400 * 1_000_000
    return table(spark, sf, "events").select("event_id", F.when(idle >= 14 * day, "cold").when(idle >= 7 * day, "warm").otherwise("hot").alias("tier"))


@query()
def consistent_ring(spark, sf):
    """Each document's shard: the next of 150 places a shard on a ring of hashes."""
    own = ring.ring(spark, {str(i): 1.0 for i in range(4)}, replicas=0)
    return ring.placed(table(spark, sf, "documents").select("doc_id"), "doc_id", own).select("doc_id", F.col("shard").cast("int").alias("shard"))


SHARDS = {"a": 1.0, "b": 1.0, "c": 2.0, "d": 1.0}
RING_SQL = f"""(SELECT h, min(shard) AS shard FROM (SELECT shard, ('0x' || substr(md5(shard || '#' || i), 1, 8))::BIGINT AS h FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS shard, unnest([150, 150, 300, 150]) AS n), range(300) t(i) WHERE i < n) GROUP BY h)"""


@query(f"""WITH r AS MATERIALIZED {RING_SQL}, o AS (SELECT x.h, x.shard, y.shard AS other, min((y.h - x.h + 4294967296) % 4294967296) AS away FROM r x JOIN r y ON y.shard <> x.shard GROUP BY 1, 2, 3),
p AS (SELECT h, shard, list(other ORDER BY away)[1:2] AS replicas FROM o GROUP BY h, shard),
d AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS k FROM documents), m AS (SELECT doc_id, coalesce((SELECT min(h) FROM r WHERE h >= k), (SELECT min(h) FROM r)) AS h FROM d)
SELECT doc_id, shard, replicas FROM m JOIN p USING (h)""")
def ring_replicas(spark, sf):
    """Each document's shard on a weighted ring, and the two others that hold its copies."""
    return ring.placed(table(spark, sf, "documents").select("doc_id"), "doc_id", ring.ring(spark, SHARDS)).select("doc_id", "shard", "replicas")


class Bucket:
    """Tokens that refill with time; a request takes one or is told how long to wait."""

    def __init__(self, burst: float = 5.0, refill_us: int = 600_000_000):
        self.tokens, self.burst, self.refill_us, self.last = burst, burst, refill_us, None

    def take(self, row) -> list[tuple]:
        if self.last is not None:
            self.tokens = min(self.burst, self.tokens + (row.us - self.last) / self.refill_us)
        self.last, allowed = row.us, self.tokens >= 1
        wait = 0 if allowed else max(1, int(-(-(1 - self.tokens) * self.refill_us // 1_000_000)))
        self.tokens -= allowed
        return [(row.event_id, allowed, wait)]

    def end(self) -> list[tuple]:
        return []


@query()
def token_bucket(spark, sf):
    """Requests of each user against a bucket of five that refills by one a 10 minutes: allowed or not, and how long to wait."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return replayed(e, "user_id", ["us", "event_id"], lambda user: Bucket(), "event_id long, allowed boolean, retry_after int")


@query("SELECT doc_id, count(*) - 1 AS false_hits FROM documents GROUP BY doc_id")
def exact_membership(spark, sf):
    return table(spark, sf, "documents").groupBy("doc_id").agg((F.count("*") - 1).alias("false_hits"))
