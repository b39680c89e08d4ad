"""Entities, their graph, and walks over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import graph as G
from tidemark.operators.blocks import top_per_query
from tidemark.operators.ordered import following
from tidemark.plans.chunks import adaptive_chunks
from tidemark.plans.text import GAZETTEER, SCANNERS, entity_spans
from tidemark.plans.text import NAMES as NAMES_PATTERN
from tidemark.registry import Registry
from tidemark.session import settled, spread, table

query = Registry()

#: The gazetteer: a fixed list, so a document has at most as many entities as it has entries.
NAMES = tuple(sum(GAZETTEER.values(), ())) + ("the", "der", "que", "con", "est")
KINDS = {w: k for k, words in GAZETTEER.items() for w in words}
_LIST = ", ".join(f"'{n}'" for n in NAMES)
_KIND = "CASE entity " + " ".join(f"WHEN '{w}' THEN '{k}'" for w, k in KINDS.items()) + " ELSE 'word' END"
MENTIONS_SQL = f"(SELECT id, entity, {_KIND} AS kind, 0.7 + length(entity) / 100 AS confidence FROM (SELECT doc_id AS id, unnest(list_filter([{_LIST}], lambda w: contains(lower(text), w))) AS entity FROM documents))"
#: Foreign keys as a graph: customers to nations to regions, all above the threshold but those of odd nations.
EDGES_SQL = """(SELECT c_custkey + 1000 AS src, c_nationkey::BIGINT + 100 AS dst, 'LIVES_IN' AS type, 0.9 AS confidence FROM customer
UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, 'PART_OF', CASE WHEN n_nationkey % 2 = 1 THEN 0.6 ELSE 0.8 END FROM nation
UNION ALL SELECT c_nationkey + 100, c_custkey + 1000, 'HOME_OF', 0.7 FROM customer)"""


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    found = F.filter(F.array(*[F.lit(n) for n in NAMES]), lambda w: F.contains(F.lower("text"), w))
    rows = spread(table(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.explode(found).alias("entity"))
    kind = F.coalesce(F.create_map(*[x for w, k in KINDS.items() for x in (F.lit(w), F.lit(k))])[F.col("entity")], F.lit("word"))
    return rows.select("id", "entity", kind.alias("kind"), (0.7 + F.length("entity") / 100).alias("confidence"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    key = lambda c, by: (F.col(c) + by).cast("long")
    lives = c.select(key("c_custkey", 1000).alias("src"), key("c_nationkey", 100).alias("dst"), F.lit("LIVES_IN").alias("type"), F.lit(0.9).alias("confidence"))
    part = n.select(key("n_nationkey", 100).alias("src"), key("n_regionkey", 1).alias("dst"), F.lit("PART_OF").alias("type"), F.when(F.col("n_nationkey") % 2 == 1, 0.6).otherwise(0.8).alias("confidence"))
    home = c.select(key("c_nationkey", 100).alias("src"), key("c_custkey", 1000).alias("dst"), F.lit("HOME_OF").alias("type"), F.lit(0.7).alias("confidence"))
    return lives.union(part).union(home)


@query(f"SELECT id, entity, kind, round(confidence, 6) AS confidence FROM {MENTIONS_SQL} WHERE confidence >= 0.75")
def entity_mentions(spark, sf):
    return mentions(spark, sf).filter("confidence >= 0.75").withColumn("confidence", F.round("confidence", 6))


@query(f"SELECT lower(trim(entity)) AS name, kind, count(*) AS mention_count, min(id) AS first_seen FROM {MENTIONS_SQL} GROUP BY 1, 2")
def entity_nodes(spark, sf):
    """Mentions upserted by their normalised name, with a count."""
    return mentions(spark, sf).groupBy(F.lower(F.trim("entity")).alias("name"), "kind").agg(F.count("*").alias("mention_count"), F.min("id").alias("first_seen"))


@query(f"""SELECT x.entity AS a, y.entity AS b, count(*) AS chunks, round(avg((x.confidence + y.confidence) / 2), 6) AS strength FROM {MENTIONS_SQL} x JOIN {MENTIONS_SQL} y ON x.id = y.id AND x.entity < y.entity GROUP BY 1, 2""")
def entity_co_occurrence(spark, sf):
    return G.co_occurrence(mentions(spark, sf))


@query(f"""WITH m AS {MENTIONS_SQL}, s AS (SELECT DISTINCT entity FROM m WHERE id < 5)
SELECT id, count(DISTINCT entity) AS shared FROM m WHERE id >= 5 AND entity IN (SELECT entity FROM s) GROUP BY id""")
def shared_entities(spark, sf):
    m = mentions(spark, sf)
    return G.shared_neighbours(m, m.filter("id < 5").select("id").distinct())


@query(f"""WITH m AS {MENTIONS_SQL}, s AS (SELECT DISTINCT entity FROM m WHERE id < 5),
a AS (SELECT id, 0.7 * count(DISTINCT entity) AS score, 0 AS pri FROM m WHERE id >= 5 AND entity IN (SELECT entity FROM s) GROUP BY id),
b AS (SELECT id, count(DISTINCT entity)::DOUBLE AS score, 1 AS pri FROM m WHERE id >= 5 AND (contains(entity, 'idiot') OR contains('idiot', entity) OR entity = 'moron') GROUP BY id)
SELECT id, round(score, 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pri) = 1 ORDER BY score DESC, id LIMIT 10""")
def expand_context(spark, sf):
    """Chunks that share entities with the seeds, then chunks with the query's entities; the first of each chunk, the ten best."""
    m = mentions(spark, sf)
    seeds = m.filter("id < 5").select("id").distinct()
    a = G.shared_neighbours(m, seeds).select("id", (0.7 * F.col("shared")).alias("score"), F.lit(0).alias("pri"))
    e = F.col("entity")
    near = F.contains(e, F.lit("idiot")) | F.contains(F.lit("idiot"), e) | (e == "moron")
    b = m.filter("id >= 5").filter(near).groupBy("id").agg(F.count_distinct("entity").cast("double").alias("score")).withColumn("pri", F.lit(1))
    one = F.row_number().over(Window.partitionBy("id").orderBy("pri"))
    return a.unionByName(b).withColumn("n", one).filter("n = 1").select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"""WITH RECURSIVE u AS (SELECT DISTINCT src, dst FROM {EDGES_SQL} WHERE confidence > 0.6), w AS (SELECT 1001 AS id, 0 AS depth UNION SELECT u.dst, depth + 1 FROM w JOIN u ON u.src = w.id WHERE depth < 3)
SELECT id::BIGINT AS id, min(depth)::INT AS depth FROM w WHERE id <> 1001 GROUP BY id""")
def constrained_bfs(spark, sf):
    return G.breadth_first(edges(spark, sf), 1001, 3)


@query(f"SELECT dst AS id, type, confidence::DOUBLE AS confidence FROM {EDGES_SQL} WHERE src = 1001")
def neighbours(spark, sf):
    return edges(spark, sf).filter("src = 1001").select(F.col("dst").alias("id"), "type", "confidence")


@query(f"SELECT type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM {EDGES_SQL} GROUP BY type")
def graph_stats(spark, sf):
    return edges(spark, sf).groupBy("type").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query(f"SELECT id, list_sort(list(DISTINCT entity)) AS names, sum(length(entity))::BIGINT AS relevance FROM {MENTIONS_SQL} GROUP BY id")
def names_per_chunk(spark, sf):
    return mentions(spark, sf).groupBy("id").agg(F.sort_array(F.collect_set("entity")).alias("names"), F.sum(F.length("entity")).alias("relevance"))


@query(f"""WITH m AS {MENTIONS_SQL}, s AS (SELECT DISTINCT id FROM m WHERE contains(entity, 'apache') OR contains('apache', entity)),
n AS (SELECT doc_id AS id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next FROM documents), h AS (SELECT next AS id FROM n JOIN s USING (id) WHERE next IS NOT NULL)
SELECT id, min(pri)::INT AS pri FROM (SELECT id, 0 AS pri FROM s UNION ALL SELECT id, 1 FROM h) JOIN documents ON doc_id = id WHERE length(text) > 0 GROUP BY id ORDER BY min(pri), id LIMIT 50""")
def graph_search(spark, sf):
    """Chunks whose entities contain the query's or are contained in it, then the chunks that follow these in their source; none without text."""
    e = F.col("entity")
    seeds = mentions(spark, sf).filter(F.contains(e, F.lit("apache")) | F.contains(F.lit("apache"), e)).select("id").distinct()
    d = table(spark, sf, "documents").select("doc_id", "source", (F.length("text") > 0).alias("real"))
    edges_ = following(d.select("source", F.col("doc_id").alias("id")), "source", "id")
    hop = edges_.join(seeds, "id", "left_semi").filter("next is not null").select(F.col("next").alias("id"), F.lit(1).alias("pri"))
    both = seeds.withColumn("pri", F.lit(0)).union(hop).groupBy("id").agg(F.min("pri").alias("pri"))
    return both.join(d.filter("real").select(F.col("doc_id").alias("id")), "id", "left_semi").orderBy("pri", "id").limit(50)


@query(f"SELECT entity, count(*) AS n FROM {MENTIONS_SQL} GROUP BY entity ORDER BY n DESC, entity LIMIT 20")
def top_entities(spark, sf):
    return mentions(spark, sf).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(20)


@query(f"""WITH r AS (SELECT x.entity AS a, y.entity AS b, round(avg((x.confidence + y.confidence) / 2), 6) AS strength FROM {MENTIONS_SQL} x JOIN {MENTIONS_SQL} y ON x.id = y.id AND x.entity < y.entity GROUP BY 1, 2)
SELECT name, related, strength FROM (SELECT a AS name, b AS related, strength FROM r UNION ALL SELECT b, a, strength FROM r) WHERE contains(name, 'licen') ORDER BY strength DESC, name, related LIMIT 20""")
def related_entities(spark, sf):
    """Entities that occur with one whose name holds a string, the link being read both ways."""
    r = G.co_occurrence(mentions(spark, sf))
    both = r.select(F.col("a").alias("name"), F.col("b").alias("related"), "strength").union(r.select("b", "a", "strength"))
    return both.filter(F.contains("name", F.lit("licen"))).orderBy(F.desc("strength"), "name", "related").limit(20)


@query(f"""SELECT entity, n AS episodes, round(rate, 6) AS rate, CASE WHEN rate > 0.8 THEN 'high' WHEN rate < 0.3 THEN 'low' ELSE 'normal' END AS class FROM
(SELECT entity, count(*) AS n, avg(quality) AS rate FROM {MENTIONS_SQL} m JOIN labels ON doc_id = id GROUP BY entity HAVING count(*) >= 3) ORDER BY n DESC, entity LIMIT 20""")
def success_patterns(spark, sf):
    """How often documents that mention an entity are good, for entities with three or more."""
    j = mentions(spark, sf).join(table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id")
    g = j.groupBy("entity").agg(F.count("*").alias("episodes"), F.avg("quality").alias("r")).filter("episodes >= 3")
    kind = F.when(F.col("r") > 0.8, "high").when(F.col("r") < 0.3, "low").otherwise("normal")
    return g.select("entity", "episodes", F.round("r", 6).alias("rate"), kind.alias("class")).orderBy(F.desc("episodes"), "entity").limit(20)


@query(f"""WITH m AS {MENTIONS_SQL} SELECT y.id, count(*) AS shared FROM m x JOIN m y ON x.entity = y.entity AND y.id <> x.id WHERE x.id = 3 GROUP BY y.id ORDER BY shared DESC, y.id LIMIT 10""")
def similar_episodes(spark, sf):
    m = mentions(spark, sf)
    own = m.filter("id = 3").select("entity")
    return m.filter("id <> 3").join(own, "entity", "left_semi").groupBy("id").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "id").limit(10)


@query("""WITH c AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT c.vec_id, e.vec_id AS other,
list_inner_product(c.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS score
FROM c JOIN embeddings e ON e.label = c.label AND e.vec_id % 20 <> 0)
SELECT vec_id, arg_max(other, struct_pack(s := score, i := -other)) AS other, round(max(score), 6) AS score, CASE WHEN max(score) >= 0.5 THEN 'merge' WHEN max(score) >= 0.3 THEN 'review' ELSE 'new' END AS decision FROM s GROUP BY vec_id""")
def reconcile_entities(spark, sf):
    """The nearest known entity of each candidate's own type: merged, reviewed or new by its similarity."""
    e = table(spark, sf, "embeddings")
    g = top_per_query(e.filter("vec_id % 20 <> 0"), e.filter("vec_id % 20 = 0"), 1, within="label").select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("other"), F.col("score").alias("s"))
    return g.select("vec_id", "other", F.round("s", 6).alias("score"), F.when(F.col("s") >= 0.5, "merge").when(F.col("s") >= 0.3, "review").otherwise("new").alias("decision"))


@query("""WITH c AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT c.vec_id,
list_inner_product(c.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS score
FROM c JOIN embeddings e ON e.label = c.label AND e.vec_id % 20 <> 0), d AS (SELECT vec_id, CASE WHEN max(score) >= 0.5 THEN 'merge' WHEN max(score) >= 0.3 THEN 'review' ELSE 'new' END AS decision FROM s GROUP BY vec_id)
SELECT decision, count(*) AS n FROM d GROUP BY decision""")
def reconcile_stats(spark, sf):
    return reconcile_entities(spark, sf).groupBy("decision").agg(F.count("*").alias("n"))


@query(f"SELECT src, dst, type FROM {EDGES_SQL} WHERE src IN (SELECT 1000 + range FROM range(50)) AND dst IN (SELECT 100 + range FROM range(25))")
def graph_sample(spark, sf):
    """Edges both of whose ends are in a sample of nodes."""
    left = spark.range(1000, 1050).select(F.col("id").alias("src"))
    right = spark.range(100, 125).select(F.col("id").alias("dst"))
    return edges(spark, sf).select("src", "dst", "type").join(left, "src", "left_semi").join(right, "dst", "left_semi")


MERGE, NEIGHBOURS = 0.5, 5
#: Of every vector in resolved_entities; resolved_edges asks for those of every id divisible by 20.
SOME = " WHERE q.vec_id % 20 = 0"


def _names_sql(asked: str) -> str:
    links = f"""(SELECT query_id AS a, vec_id AS b FROM (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS score
FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id{asked} QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) <= {NEIGHBOURS}) WHERE score >= {MERGE})"""
    return f"""(SELECT v.vec_id AS node, v.label, coalesce(min(w.root), v.vec_id) AS canonical FROM embeddings v LEFT JOIN (WITH RECURSIVE l AS MATERIALIZED {links}, u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
w AS (SELECT a AS root, a AS node FROM u UNION SELECT w.root, u.b FROM w JOIN u ON u.a = w.node) SELECT node, min(root) AS root FROM w GROUP BY node) w ON w.node = v.vec_id GROUP BY v.vec_id, v.label)"""


def resolution(spark: SparkSession, sf: str) -> DataFrame:
    """(node, canonical): entities of one type whose vectors are alike enough, among the nearest of each, are one."""
    return settled(G.merged_alike(table(spark, sf, "embeddings"), NEIGHBOURS, MERGE))


def some_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """(node, canonical) as by resolution, but only the ids divisible by 20 ask for their nearest."""
    e = table(spark, sf, "embeddings")
    near = top_per_query(e, e.filter("vec_id % 20 = 0"), NEIGHBOURS, within="label").filter(F.col("score") >= MERGE)
    return settled(G.canonical(e.select(F.col("vec_id").alias("node")), near.select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"))))


@query(f"SELECT canonical, label, count(*) AS members, list_sort(list(node)) AS aliases FROM {_names_sql('')} GROUP BY canonical, label")
def resolved_entities(spark, sf):
    """Nodes after merging: the least id of each component with all that it stands for."""
    nodes = resolution(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), "label"), "node")
    return nodes.groupBy("canonical", "label").agg(F.count("*").alias("members"), F.sort_array(F.collect_list("node")).alias("aliases"))


@query(f"""WITH n AS MATERIALIZED {_names_sql(SOME)}, e AS (SELECT vec_id AS src, vec_id + 1 AS dst, 0.5 + (vec_id % 5) / 10 AS confidence FROM embeddings WHERE vec_id % 10 < 9)
SELECT s.canonical AS src, d.canonical AS dst, 'NEXT' AS type, count(*) AS n, round(max(confidence), 6) AS confidence FROM e JOIN n s ON s.node = src JOIN n d ON d.node = dst WHERE s.canonical <> d.canonical GROUP BY 1, 2""")
def resolved_edges(spark, sf):
    """Edges between entities of a run of ten, carried to the merged nodes."""
    e = table(spark, sf, "embeddings").filter("vec_id % 10 < 9")
    edges_ = e.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"), F.lit("NEXT").alias("type"), (0.5 + (F.col("vec_id") % 5) / 10).alias("confidence"))
    return G.merged_edges(edges_, some_resolution(spark, sf)).withColumn("confidence", F.round("confidence", 6))


LEAST_CONFIDENCE = 0.5


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    """(id, doc_id, entity, kind, confidence): documents as a graph takes them: cut into chunks, each chunk's entities by all scanners and names, their texts trimmed and lower-cased.

    A chunk holds some hundred words, so its entities are few and their pairs can be made within its row.
    """
    chunks_ = adaptive_chunks(spark, sf).select("doc_id", F.concat_ws("#", "doc_id", "chunk_index").alias("id"), "text")
    found = chunks_.select("doc_id", "id", F.explode(entity_spans(F.col("text"), (*SCANNERS, (NAMES_PATTERN, "person", 0.6)))).alias("e"))
    named = found.filter(F.col("e.confidence") >= LEAST_CONFIDENCE).select("doc_id", "id", F.lower(F.trim("e.text")).alias("entity"), F.col("e.kind").alias("kind"), F.col("e.confidence").alias("confidence"))
    return named.groupBy("doc_id", "id", "entity").agg(F.min_by("kind", F.struct((-F.col("confidence")).alias("c"), "kind")).alias("kind"), F.max("confidence").alias("confidence"))


@query()
def indexed_nodes(spark, sf):
    """Entities of the indexed documents with the chunks and documents that mention them."""
    return indexed(spark, sf).groupBy("entity", "kind").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.max("confidence").alias("confidence"))


@query()
def indexed_edges(spark, sf):
    """Entities that stand in one chunk, with the number of these and how strong the link is."""
    return G.co_occurrence(indexed(spark, sf))
