"""Tools of an assistant: spelling, arithmetic, word maps, plans, label decoding, context assembly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import ranking as R
from tidemark.operators import spelling
from tidemark.plans.search import TERMS, _keyword, bm25_sql, ranked_sql
from tidemark.plans.text import LOWER_WORDS_SQL
from tidemark.registry import Registry
from tidemark.session import spread, table

query = Registry()

#: A small dictionary: most frequent first.
DICTIONARY = ("the", "and", "that", "with", "this", "from", "have", "they", "will", "would", "there", "their", "what", "about", "which")
MISSPELLINGS = {"teh": "the", "adn": "and", "recieve": "receive", "wiht": "with", "taht": "that"}


@query(f"""SELECT DISTINCT word, CASE WHEN word IN ({', '.join(f"'{k}'" for k in MISSPELLINGS)}) THEN CASE word {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MISSPELLINGS.items())} END
ELSE list_filter([{', '.join(f"'{w}'" for w in DICTIONARY)}], lambda d: levenshtein(d, word) <= 1)[1] END AS suggestion
FROM (SELECT unnest({LOWER_WORDS_SQL}) AS word FROM conversations) WHERE regexp_matches(word, '^[a-z]{{3,6}}$') AND word NOT IN ({', '.join(f"'{w}'" for w in DICTIONARY)})""")
def spell_check(spark, sf):
    """Known misspellings, else the first dictionary word within one edit."""
    words = table(spark, sf, "conversations").select(F.explode(T.words(F.lower("text"))).alias("word")).distinct()
    words = words.filter(F.col("word").rlike("^[a-z]{3,6}$") & ~F.col("word").isin(*DICTIONARY))
    known = None
    for k, v in MISSPELLINGS.items():
        known = F.when(F.col("word") == k, v) if known is None else known.when(F.col("word") == k, v)
    near = F.filter(F.array(*[F.lit(d) for d in DICTIONARY]), lambda d: F.levenshtein(d, F.col("word")) <= 1)
    return words.select("word", F.coalesce(known, F.get(near, F.lit(0))).alias("suggestion"))


@query()
def correct_spelling(spark, sf):
    """Every word of the documents that few others use, with the commonest of the words the fewest edits away."""
    index = spelling.index_of(spark, f"{sf}/documents.parquet")
    return spelling.corrections(spread(table(spark, sf, "documents").select("doc_id", "text")), index, "doc_id", MISSPELLINGS)


ENGLISH_SPANISH = {"the": "el", "and": "y", "of": "de", "to": "a", "with": "con", "is": "es", "was": "fue", "for": "para"}


@query(f"""SELECT conv_id, turn, array_to_string(list_transform({LOWER_WORDS_SQL}, lambda w: coalesce(CASE regexp_replace(w, '[.,!?]+$', '') {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ENGLISH_SPANISH.items())} END || regexp_extract(w, '[.,!?]+$', 0), w)), ' ') AS translated FROM conversations WHERE role = 'user'""")
def translate_words(spark, sf):
    """Word by word, marks kept."""

    def word(w: Column) -> Column:
        stem, out = F.regexp_replace(w, "[.,!?]+$", ""), None
        for k, v in ENGLISH_SPANISH.items():
            out = F.when(stem == k, v) if out is None else out.when(stem == k, v)
        return F.coalesce(F.concat(out, F.regexp_extract(w, "[.,!?]+$", 0)), w)

    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(F.transform(T.words(F.lower("text")), word), " ").alias("translated"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber * 2 - l_orderkey / 4 AS result FROM lineitem")
def calculate(spark, sf):
    """Expressions as text, evaluated with precedence and unary minus; a division by zero gives null."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("string"), F.lit(" + "), F.col("l_linenumber").cast("string"), F.lit(" * 2 - "), F.col("l_orderkey").cast("string"), F.lit(" / 4")).alias("e"))
    return rows.mapInPandas(_calculated, "l_orderkey long, l_linenumber int, result double")


NUMBER = r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _calculated(batches):
    """Expressions that differ in their numbers alone are parsed once and evaluated together."""
    for b in batches:
        out = pd.Series(np.nan, index=b.index)
        for shape, own in b["e"].groupby(b["e"].str.replace(NUMBER, "0", regex=True)):
            numbers = np.array(own.str.findall(NUMBER).tolist(), dtype=np.float64).reshape(len(own), -1)
            out[own.index] = evaluate(shape, list(numbers.T))
        yield b.assign(result=out)[["l_orderkey", "l_linenumber", "result"]]


def evaluate(expression: str, numbers: list | None = None):
    """Numbers, + - * / and parentheses; anything else, or a division by zero, is null (NaN in arrays).

    The numbers are read from the expression, or given in its order as arrays.
    """
    import ast
    import operator

    kinds = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
    given = iter(numbers) if numbers is not None else None

    def value(node: ast.AST):
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return np.float64(node.value) if given is None else next(given)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in kinds:
            left = value(node.left)
            return kinds[type(node.op)](left, value(node.right))
        raise ValueError(ast.dump(node))

    try:
        with np.errstate(all="ignore"):
            result = value(ast.parse(expression.strip(), mode="eval").body)
    except (ValueError, SyntaxError, RecursionError):
        return None if numbers is None else np.nan
    if numbers is None:
        return float(result) if np.isfinite(result) else None
    return np.where(np.isfinite(result), result, np.nan)


@query(f"""SELECT doc_id, round(len(list_intersect(w, ['the', 'of', 'erheer', 'que'])) / 4, 6) AS overlap FROM (SELECT doc_id, list_distinct({LOWER_WORDS_SQL}) AS w FROM documents)""")
def term_overlap(spark, sf):
    """The share of the query's distinct terms that a document has."""
    asked = F.array(*[F.lit(t) for t in ("the", "of", "erheer", "que")])
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.round(F.size(F.array_intersect(asked, T.words(F.lower("text")))) / 4, 6).alias("overlap"))


@query("""SELECT conv_id, turn, len(list_filter(range(least(len(a), len(b))), lambda i: list_slice(a, 1, i + 1) = list_slice(b, 1, i + 1))) AS prefix,
len(list_filter(range(least(len(a), len(b))), lambda i: list_slice(list_reverse(a), 1, i + 1) = list_slice(list_reverse(b), 1, i + 1))) AS suffix FROM
(SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ') AS b FROM conversations) WHERE b IS NOT NULL""")
def common_prefix(spark, sf):
    """How many leading and how many trailing tokens two arrays share: a fold that stops counting at the first difference."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"), F.split(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), " ").alias("b"))

    def shared(a: Column, b: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("on"))

        def step(s: Column, x: Column) -> Column:
            on = s["on"] & F.coalesce(x["a"] == x["b"], F.lit(False))
            return F.struct((s["n"] + on.cast("long")).alias("n"), on.alias("on"))

        return F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), start, step, lambda s: s["n"])

    return c.filter("b is not null").select("conv_id", "turn", shared(F.col("a"), F.col("b")).alias("prefix"), shared(F.reverse("a"), F.reverse("b")).alias("suffix"))


@query(r"""WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: length(x) > 0) AS ws FROM documents)),
t AS (SELECT *, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'B-PER' WHEN length(w) > 9 THEN 'I-PER' ELSE 'O' END AS tag, 0.6 + length(w) / 25 AS p FROM w),
r AS (SELECT *, sum((starts_with(tag, 'B') OR (starts_with(tag, 'I') AND before = 'O'))::INT) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS run FROM (SELECT *, coalesce(lag(tag) OVER (PARTITION BY doc_id ORDER BY i), 'O') AS before FROM t))
SELECT * FROM (SELECT doc_id, run, string_agg(w, ' ' ORDER BY i) AS entity, round(least(avg(p), 1.0), 6) AS score FROM r WHERE tag <> 'O' GROUP BY doc_id, run) WHERE score >= 0.7 AND length(entity) >= 2""")
def decode_labels(spark, sf):
    """Entities of BIO labels with scores: a B or an I of another kind begins one, pieces join, scores are averaged; from 0.7 and two characters on."""
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(T.words(F.col("text"))).alias("i", "w"))
    capital = F.col("w").rlike("^[A-Z]")
    w = Window.partitionBy("doc_id").orderBy("i")
    tagged = words.withColumns({"tag": F.when(capital, "B-PER").when(F.length("w") > 9, "I-PER").otherwise("O"), "p": F.lit(0.6) + F.length("w") / 25})
    begins = F.startswith("tag", F.lit("B")) | (F.startswith("tag", F.lit("I")) & (F.coalesce(F.lag("tag").over(w), F.lit("O")) == "O"))
    runs = tagged.withColumn("run", F.sum(begins.cast("int")).over(w)).filter("tag <> 'O'")
    g = runs.groupBy("doc_id", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ").alias("entity"), F.round(F.least(F.avg("p"), F.lit(1.0)), 6).alias("score"))
    return g.filter("score >= 0.7 and length(entity) >= 2")


@query("""SELECT conv_id, turn, step, grp FROM (SELECT *, sum(CASE WHEN regexp_matches(part, 'that|this|it') OR step = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY step ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM
(SELECT conv_id, turn, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS step FROM (SELECT conv_id, turn, string_split(lower(text), '. ') AS parts FROM conversations WHERE role = 'user')))""")
def chain_groups(spark, sf):
    """Steps of a plan in groups: one that refers back begins a group."""
    steps = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), r"\. ")).alias("step", "part"))
    new = (F.col("part").rlike("that|this|it") | (F.col("step") == 0)).cast("long")
    w = Window.partitionBy("conv_id", "turn").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("conv_id", "turn", "step", F.sum(new).over(w).alias("grp"))


@query("SELECT string_split(h, ',')[1] AS client, count(*) AS n FROM (SELECT '10.0.0.' || (user_id % 8) || ',172.16.0.1' AS h FROM events) GROUP BY 1")
def forwarded_clients(spark, sf):
    h = F.concat(F.lit("10.0.0."), (F.col("user_id") % 8).cast("string"), F.lit(",172.16.0.1"))
    return table(spark, sf, "events").groupBy(F.split(h, ",")[0].alias("client")).agg(F.count("*").alias("n"))


@query("SELECT user_id, list_slice(list_distinct(list(event_type ORDER BY event_id)), 1, 1)[1] IS NOT NULL AS seen, count(*) AS mention_count, list_sort(list(DISTINCT event_type)) AS aliases FROM events GROUP BY user_id")
def touch_entities(spark, sf):
    """Mentions counted, aliases appended once each."""
    return table(spark, sf, "events").groupBy("user_id").agg((F.count("event_type") > 0).alias("seen"), F.count("*").alias("mention_count"), F.sort_array(F.collect_set("event_type")).alias("aliases"))


def best_index(n: int) -> str:
    """Which search a table of n vectors gets."""
    return "cells" if n > 10_000 else "codes" if n > 1_000 else "half" if n > 100 else "scan"


@query("SELECT label, count(*) AS n, CASE WHEN count(*) > 10000 THEN 'cells' WHEN count(*) > 1000 THEN 'codes' WHEN count(*) > 100 THEN 'half' ELSE 'scan' END AS index FROM embeddings GROUP BY label")
def index_choice(spark, sf):
    n = F.col("n")
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n")).select("label", "n", F.when(n > 10_000, "cells").when(n > 1_000, "codes").when(n > 100, "half").otherwise("scan").alias("index"))


@query(f"""WITH h AS {ranked_sql(bm25_sql(TERMS), 5)} SELECT h.rank, d.doc_id, d.source, substr(d.text, 1, 60) AS preview, (SELECT count(*) FROM documents x WHERE x.source = d.source AND x.doc_id BETWEEN d.doc_id - 20 AND d.doc_id + 20 AND x.doc_id <> d.doc_id) AS around FROM h JOIN documents d USING (doc_id)""")
def progressive_search(spark, sf):
    """Ids first, then how many neighbours they have in time, then the full rows of the few that were chosen."""
    d = spread(table(spark, sf, "documents"))
    hits = R.ranked(_keyword(spark, sf), 5).select("doc_id", "rank")
    full = d.join(hits, "doc_id").select("rank", "doc_id", "source", F.substring("text", 1, 60).alias("preview"))
    near = d.select(F.col("doc_id").alias("other"), F.col("source").alias("s"))
    around = full.select("doc_id", "source").join(near, F.col("source") == F.col("s")).filter((F.abs(F.col("other") - F.col("doc_id")) <= 20) & (F.col("other") != F.col("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("around"))
    return full.join(around, "doc_id", "left").fillna(0, ["around"])


@query(f"""WITH h AS {ranked_sql(bm25_sql(TERMS), 5)}, m AS (SELECT string_agg('- ' || substr(text, 1, 30), chr(10) ORDER BY conv_id, turn) AS memories FROM (SELECT * FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 5))
SELECT memories || chr(10) || (SELECT string_agg('[' || h.rank || '] ' || substr(text, 1, 80), chr(10) ORDER BY h.rank) FROM h JOIN documents USING (doc_id)) AS context FROM m""")
def answer_context(spark, sf):
    """Five memories and the five best documents: what a model would be given."""
    few = table(spark, sf, "conversations").filter("role = 'user'").orderBy("conv_id", "turn").limit(5)
    lines = lambda key, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, text.alias("t")))), lambda x: x["t"]), "\n")
    memories = few.agg(lines(["conv_id", "turn"], F.concat(F.lit("- "), F.substring("text", 1, 30))).alias("m"))
    d = spread(table(spark, sf, "documents"))
    hits = d.join(R.ranked(_keyword(spark, sf), 5).select("doc_id", "rank"), "doc_id")
    found = hits.agg(lines(["rank"], F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("text", 1, 80))).alias("f"))
    return memories.crossJoin(F.broadcast(found)).select(F.concat("m", F.lit("\n"), "f").alias("context"))


@query("""SELECT user_id, round(100 * avg((event_type = 'view')::INT), 6) AS pointer_percent, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 100) GROUP BY user_id""")
def pointer_snapshot(spark, sf):
    """Route mix and means of the last hundred."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf, "events").withColumn("rn", F.row_number().over(w)).filter("rn <= 100")
    return e.groupBy("user_id").agg(F.round(100 * F.avg((F.col("event_type") == "view").cast("int")), 6).alias("pointer_percent"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query()
def fuse_extractors(spark, sf):
    """Blocks of two extractors of a page: a later one stays only if it overlaps no better one by more than half of the smaller height."""
    from tidemark.plans.chunks import html_blocks

    blocks = html_blocks(spark, sf).select("page_id", "block_idx", F.lit("html").alias("extractor"), (F.col("block_idx") * 20).alias("y0"), (F.col("block_idx") * 20 + 15).alias("y1"), F.lit(0.9).alias("confidence"))
    other = blocks.filter("block_idx % 3 = 0").select("page_id", "block_idx", F.lit("flat").alias("extractor"), (F.col("y0") + F.when(F.col("block_idx") % 2 == 0, 2).otherwise(200)).alias("y0"), (F.col("y1") + F.when(F.col("block_idx") % 2 == 0, 2).otherwise(200)).alias("y1"), F.lit(0.5).alias("confidence"))
    first = blocks.select("page_id", F.col("y0").alias("a0"), F.col("y1").alias("a1"))
    overlap = F.least("y1", "a1") - F.greatest("y0", "a0") > 0.5 * F.least(F.col("y1") - F.col("y0"), F.col("a1") - F.col("a0"))
    clash = other.join(first, "page_id").filter(overlap).select("page_id", "block_idx").distinct()
    return blocks.unionByName(other.join(clash, ["page_id", "block_idx"], "left_anti"))


@query(r"""SELECT level, count(*) AS n FROM (SELECT (json_extract_string(line, '$.level')) AS level FROM (SELECT '{"level":"' || event_type || '","id":' || event_id || '}' AS line FROM events ORDER BY event_id DESC LIMIT 200)) GROUP BY level""")
def log_tail(spark, sf):
    """The last two hundred lines of a log, parsed."""
    e = table(spark, sf, "events").orderBy(F.desc("event_id")).limit(200)
    line = F.to_json(F.struct(F.col("event_type").alias("level"), F.col("event_id").alias("id")))
    return e.select(F.from_json(line, "level string, id long").alias("j")).groupBy("j.level").agg(F.count("*").alias("n"))
