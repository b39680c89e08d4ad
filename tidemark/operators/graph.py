"""Graphs as tables of edges (src, dst, type, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import alike_per_vector, distinct_vectors
from tidemark.session import settled

MOST_HOPS = 5


def breadth_first(edges: DataFrame, seed: int, hops: int, relation: str = "", least: float = 0.6) -> DataFrame:
    """(id, depth) of what the seed reaches by edges of a relation (a substring of the type) above a confidence, the seed apart.

    One join a hop; what was met before is left out by an anti-join, and each frontier is written before the next.
    """
    usable = edges.filter((F.col("confidence") > least) & F.contains("type", F.lit(relation))).select("src", "dst").distinct()
    spark = edges.sparkSession
    met = spark.createDataFrame([(seed, 0)], "id long, depth int")
    frontier = met
    for depth in range(1, min(hops, MOST_HOPS) + 1):
        following = usable.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = settled(following.join(met, "id", "left_anti").withColumn("depth", F.lit(depth)))
        met = met.unionByName(frontier)
    return met.filter(F.col("id") != seed)


def shared_neighbours(mentions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, shared): other chunks that mention the seeds' entities, with how many of these they share."""
    entities = mentions.join(seeds, "id", "left_semi").select("entity").distinct()
    others = mentions.join(entities, "entity", "left_semi").join(seeds, "id", "left_anti")
    return others.groupBy("id").agg(F.count_distinct("entity").alias("shared"))


def co_occurrence(mentions: DataFrame) -> DataFrame:
    """(a, b, chunks, strength) of entities a < b in a chunk; a chunk's distinct entities are a short array, paired within the row."""
    sets = mentions.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("entity", "confidence"))).alias("e"))
    pairs = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice(F.col("e"), i + 2, F.size("e")), lambda y: F.struct(x["entity"].alias("a"), y["entity"].alias("b"), ((x["confidence"] + y["confidence"]) / 2).alias("s")))))
    rows = sets.select(F.explode(pairs).alias("p")).select("p.*").filter("a <> b")
    return rows.groupBy("a", "b").agg(F.count("*").alias("chunks"), F.round(F.avg("s"), 6).alias("strength"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); a component has the name of its least node.

    Each round a node takes the least label among its own and its neighbours', and then that label's own label, so
    labels travel twice as far each time. Sums are combined before the shuffle, so a node of very many links is no
    task's alone; each round is written. Links to oneself, repeated and one-sided ones do no harm; null ends are left out.
    """
    real = links.filter("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = settled(real.union(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "least").alias("now"))
        own = labels.select(F.col("node").alias("now"), F.col("label").alias("further"))
        moved = settled(lower.join(own, "now").select("node", F.least("now", "further").alias("label"), (F.least("now", "further") < F.col("label")).alias("moved")))
        labels = moved.select("node", "label")
        if not moved.filter("moved").head(1):
            return labels.select("node", F.col("label").alias("component"))


def canonical(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, canonical) of nodes (node): the least of those that links (a, b) merge it with, or itself."""
    return nodes.select("node").distinct().join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("canonical"))


def merged_alike(vectors: DataFrame, k: int, least: float, key: str = "vec_id", vector: str = "embedding", within: str = "label") -> DataFrame:
    """(node, canonical) of all vectors, where each is merged with its k most alike of its group, if these are at least so alike by cosine.

    Equal vectors have the same neighbours but for themselves, so they are one class, and classes are linked: with those of
    their k best ids, and of one more where a copy is among these, as it doesn't count itself. A vector without a length merges with none.
    """
    entries = settled(distinct_vectors(vectors, k, key, vector, within))
    ids = F.transform("ids", lambda x: F.struct((-F.col("score")).alias("s"), x.alias("id"), F.col("vec_id").alias("b")))
    best = alike_per_vector(entries, k, least).groupBy(F.col("query_id").alias("a")).agg(F.slice(F.sort_array(F.flatten(F.collect_list(ids))), 1, k + 1).alias("best"))
    asked = F.lit(k) + F.exists("best", lambda x: x["b"] == F.col("a")).cast("int")
    links = best.select("a", F.explode(F.slice("best", F.lit(1), asked)).alias("e")).select("a", F.col("e.b").alias("b")).filter("a <> b")
    copies = entries.filter(F.size("ids") > 1).select("grp", "v", F.col("id").alias("first"))
    rows = vectors.select(F.col(key).alias("node"), F.col(within).alias("grp"), F.col(vector).alias("v"))
    firsts = rows.join(copies, ["grp", "v"], "left").select("node", F.coalesce("first", "node").alias("first"))
    named = firsts.join(components(links).withColumnRenamed("node", "first"), "first", "left")
    return named.groupBy("node").agg(F.min(F.coalesce("component", "first")).alias("canonical"))


def merged_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, type, n, confidence) of edges between canonical nodes: what merging makes equal is one edge with its number and best confidence; none to oneself."""
    left, right = names.select(F.col("node").alias("src"), F.col("canonical").alias("s")), names.select(F.col("node").alias("dst"), F.col("canonical").alias("d"))
    moved = edges.join(left, "src").join(right, "dst").filter("s <> d")
    return moved.groupBy(F.col("s").alias("src"), F.col("d").alias("dst"), "type").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
