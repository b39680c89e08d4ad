"""Text: estimates, clean-up, scanners for entities, classifiers and rewriting."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.registry import Registry
from tidemark.session import spread, table, told

query = Registry()

WORDS_SQL = r"list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: length(x) > 0)"
LOWER_WORDS_SQL = r"list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda x: length(x) > 0)"

# Phrases, words and keywords that the operators look for.
FORBIDDEN = (
    "ignore previous", "ignore all", "disregard", "forget everything", "new instructions", "override", "system prompt", "jailbreak",
    "bypass", "pretend you", "act as if", "roleplay as", "you are now", "from now on", "ignore safety", "ignore rules",
    "ignore guidelines", "do not follow", "don't follow",
)
WRITING = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "REPLACE", "ATTACH", "DETACH", "PRAGMA", "VACUUM", "REINDEX", "ANALYZE")
COMMON_WORDS = {
    "English": ("the", "is", "are", "and", "or", "but", "in", "on", "at", "to", "for"),
    "Spanish": ("el", "la", "los", "las", "es", "son", "y", "o", "pero", "en", "de"),
    "French": ("le", "la", "les", "est", "sont", "et", "ou", "mais", "dans", "de"),
    "German": ("der", "die", "das", "ist", "sind", "und", "oder", "aber", "in", "von"),
}
QUESTIONS = ("what", "how", "why", "when", "where", "who", "can", "could", "would")
PLEASANT = ("good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "like", "best", "perfect", "awesome", "helpful", "thanks", "thank", "appreciate", "success", "successful")
UNPLEASANT = ("bad", "terrible", "awful", "horrible", "hate", "worst", "poor", "fail", "failed", "error", "bug", "broken", "issue", "problem", "wrong", "incorrect", "disappointed", "frustrating")
POSITIVE_WORDS = (
    "good", "great", "excellent", "amazing", "wonderful", "fantastic", "awesome", "love", "happy", "joy", "beautiful", "perfect", "best", "brilliant", "outstanding", "superb", "delightful", "pleasant", "positive", "success",
    "successful", "win", "winning", "winner", "like", "enjoy", "enjoyed", "enjoying", "glad", "pleased", "exciting", "excited", "thrilled", "satisfied", "impressive", "remarkable", "incredible", "fabulous", "terrific", "marvelous",
    "splendid", "nice", "fine", "cool", "fun", "helpful", "useful", "valuable", "recommend", "recommended", "praise", "praised", "thank", "thanks", "grateful", "appreciate", "appreciated", "blessed", "fortunate",
)
NEGATIVE_WORDS = (
    "bad", "terrible", "awful", "horrible", "poor", "worst", "hate", "sad", "angry", "upset", "disappointed", "disappointing", "fail", "failed", "failure", "wrong", "mistake", "error", "problem", "issue", "bug", "broken", "crash",
    "crashed", "slow", "annoying", "annoyed", "frustrating", "frustrated", "confusing", "confused", "difficult", "hard", "impossible", "useless", "worthless", "waste", "boring", "dull", "ugly", "nasty", "disgusting", "gross", "sick",
    "pain", "painful", "hurt", "hurts", "damage", "damaged", "destroy", "destroyed", "ruin", "ruined", "regret", "sorry", "unfortunately", "never", "nothing", "nobody", "nowhere", "neither", "nor", "dislike", "unhappy", "miserable",
    "depressed", "anxious", "worried",
)
INTENSIFIERS = (
    "very", "really", "extremely", "incredibly", "absolutely", "totally", "completely", "utterly", "highly", "deeply", "strongly", "particularly", "especially", "exceptionally", "remarkably", "so", "such", "too", "most", "more",
    "much", "quite", "rather", "fairly", "pretty",
)
NEGATORS = (
    "not", "no", "never", "neither", "nobody", "nothing", "nowhere", "none", "nor", "cannot", "can't", "won't", "wouldn't", "shouldn't", "couldn't", "didn't", "doesn't", "don't", "isn't", "aren't", "wasn't", "weren't", "hasn't",
    "haven't", "hadn't", "without", "barely", "hardly",
)
INTENTS = (
    ("url_fetch", "url_fetch", 0.80, ("fetch", "get", "retrieve", "download", "read", "http://", "https://", "url", "website", "page", "content from", "visit", "extract")),
    ("math", "calculator", 0.95, ("calculate", "compute", "math", "add", "subtract", "multiply", "divide", "plus", "minus", "times", "equals", "=", "+", "-", "*", "/", "sum", "product", "quotient", "percentage", "%", "count")),
    ("web_search", "web_search", 0.85, ("search", "find", "look for", "what is", "who is", "where is", "when is", "how", "latest", "recent", "current", "news", "trending", "popular", "top", "best", "papers", "articles", "information", "research", "studies", "data")),
    ("database", "database_query", 0.75, ("query", "select", "from", "where", "database", "sql", "table", "record", "data", "store", "retrieve from db")),
    ("code_execution", "code_execution", 0.70, ("execute", "run", "code", "script", "function", "compile", "debug", "test code", "write code")),
    ("image_generation", "image_generation", 0.65, ("generate", "create image", "draw", "paint", "visualize", "image of", "picture of", "design", "artwork")),
    ("scheduler", "scheduler", 0.78, ("schedule", "remind", "reminder", "follow up", "in 30 minutes", "tomorrow", "next week", "list tasks", "show reminders", "calendar")),
    ("memory", "memory", 0.70, ("memory", "remember", "store", "save note", "note that", "remember that", "recall", "forget", "what did we store")),
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Keywords of categories and patterns of intents.
CATEGORIES = {
    "technical": ("code", "programming", "api", "function", "class", "method", "algorithm", "database", "server", "client", "framework", "library", "module", "package", "debug", "error", "exception", "compile", "runtime", "syntax"),
    "business": ("revenue", "profit", "sales", "marketing", "customer", "client", "contract", "budget", "forecast", "strategy", "growth", "market", "competition", "stakeholder", "roi", "kpi", "metrics", "performance"),
    "scientific": ("research", "study", "experiment", "hypothesis", "data", "analysis", "methodology", "results", "conclusion", "peer-review", "journal", "citation", "abstract", "findings", "statistical"),
    "legal": ("contract", "agreement", "clause", "liability", "compliance", "regulation", "law", "statute", "court", "plaintiff", "defendant", "jurisdiction", "intellectual property", "patent", "trademark", "copyright"),
    "educational": ("learn", "teach", "course", "lesson", "tutorial", "guide", "example", "exercise", "practice", "student", "instructor", "curriculum", "assessment", "quiz", "exam", "certification"),
    "support": ("help", "issue", "problem", "error", "fix", "solution", "troubleshoot", "ticket", "request", "urgent", "priority", "escalate", "resolve"),
}
TEXT_INTENTS = {
    "question": ("what", "how", "why", "when", "where", "who", "which", "can", "could", "would", "should", "is", "are", "does", "do", "?"),
    "command": ("create", "delete", "update", "add", "remove", "change", "modify", "set", "get", "list", "show", "display", "run", "execute", "start", "stop"),
    "search": ("find", "search", "look", "locate", "discover", "retrieve", "fetch", "query", "filter", "browse"),
    "comparison": ("compare", "versus", "vs", "difference", "between", "better", "worse", "pros", "cons", "advantages", "disadvantages"),
    "explanation": ("explain", "describe", "elaborate", "clarify", "define", "meaning", "understand", "tell me about"),
}
#: Terms that entities are found by, with their kinds: a parameter, here of terms that the texts hold.
GAZETTEER = {
    "licensing": ("license", "licensed", "apache", "version", "copyright"),
    "abuse": ("stupid", "idiot", "moron", "scum", "loser", "clown", "disgusting"),
    "contact": ("http", "www", "@", "+1"),
}


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def _values(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _hits(column: str, words: tuple[str, ...]) -> str:
    return f"len(list_filter([{_values(words)}], lambda w: contains({column}, w)))"


@query(f"SELECT doc_id, ((strlen(text) // 4) + (len({WORDS_SQL}) * 4 // 3)) // 2 AS tokens FROM documents")
def token_estimate(spark, sf):
    return _docs(spark, sf).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, len(string_split(text, chr(10))) AS lines, len({WORDS_SQL}) AS words, length(text) AS chars, strlen(text) AS bytes FROM documents")
def text_counts(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", F.size(F.split(t, "\n")).alias("lines"), F.size(T.words(t)).alias("words"), F.length(t).alias("chars"), F.octet_length(t).alias("bytes"))


@query(r"""SELECT doc_id, (len(regexp_extract_all(text, '[.!?][ \t\n\r]+[^ \t\n\r]')) + 1)::BIGINT AS sentences, regexp_extract(text, '^[^.!?]*[.!?]*', 0) AS first FROM documents""")
def sentence_split(spark, sf):
    t = F.col("text")
    count = F.regexp_count(t, F.lit(r"[.!?][ \t\n\r]+[^ \t\n\r]")) + 1
    return _docs(spark, sf).select("doc_id", count.cast("long").alias("sentences"), F.regexp_extract(t, r"^[^.!?]*[.!?]*", 0).alias("first"))


@query(r"""SELECT page_id, line_no, line FROM (SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '<h[1-6]>', chr(10) || '# ', 'g'), '<li>', chr(10) || 'item:' || chr(10), 'g'), chr(10)) AS l FROM pages))
WHERE starts_with(line, '#') OR ends_with(rtrim(line), ':')""")
def heading_lines(spark, sf):
    """A heading starts with # or ends with a colon; pages' headings and list items are written as such."""
    marked = F.regexp_replace(F.regexp_replace("html", "<h[1-6]>", "\n# "), "<li>", "\nitem:\n")
    lines = table(spark, sf, "pages").select("page_id", F.posexplode(F.split(marked, "\n")).alias("line_no", "line"))
    return lines.filter(F.startswith("line", F.lit("#")) | F.endswith(F.rtrim("line"), F.lit(":")))


def _replaces(expr: str, pairs: dict[str, str]) -> str:
    for old, new in pairs.items():
        expr = f"replace({expr}, '{old.replace(chr(39), chr(39) * 2)}', '{new.replace(chr(39), chr(39) * 2)}')"
    return expr


@query(f"SELECT doc_id, md5({_replaces('text', T.PUNCTUATION | T.LIGATURES)}) AS digest FROM documents")
def typography_cleanup(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.replace_all(F.col("text"), T.PUNCTUATION | T.LIGATURES)).alias("digest"))


@query(r"""SELECT doc_id, md5(regexp_replace(translate(regexp_replace(text, '\r\n?|\f|\x0b', chr(10), 'g'), chr(9) || chr(160), '  '), ' +', ' ', 'g')) AS digest FROM documents""")
def whitespace_normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.normalize_space(F.col("text"))).alias("digest"))


@query()
def normalize_for_index(spark, sf):
    """NFKC (as Spark has no such function, in Arrow batches), white space rules, then punctuation."""
    made = _docs(spark, sf).select("doc_id", "text").mapInArrow(_nfkc, "doc_id long, text string")
    return made.select("doc_id", T.normalize_space(T.canonical_punctuation(F.col("text"))).alias("text"))


def _nfkc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [None if t is None else unicodedata.normalize("NFKC", t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])


STRIP_SQL = "html"
for _tag in ("script", "style", "head"):
    STRIP_SQL = rf"regexp_replace({STRIP_SQL}, '<{_tag}\b.*?</{_tag}>', ' ', 'gis')"
STRIP_SQL = rf"trim(regexp_replace({_replaces(f"regexp_replace({STRIP_SQL}, '<[^>]*>', ' ', 'g')", T.ENTITIES)}, '[ \t\n\r]+', ' ', 'g'))"


@query(f"SELECT page_id, {STRIP_SQL} AS text FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("SELECT page_id, len(regexp_extract_all(html, '<')) AS tags FROM pages")
def tag_count(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_count("html", F.lit("<")).alias("tags"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<html') THEN 'html' WHEN strlen(html) > length(html) THEN 'unicode' ELSE 'passthrough' END AS mode, length({STRIP_SQL}) AS chars FROM pages")
def preprocess(spark, sf):
    """Pages lose their tags, other texts have their typography cleaned, or stay as they are: one of the three."""
    h = F.col("html")
    mode = F.when(h.rlike("(?i)<html"), "html").when(F.octet_length(h) > F.length(h), "unicode").otherwise("passthrough")
    return table(spark, sf, "pages").select("page_id", mode.alias("mode"), F.length(T.strip_tags(h)).alias("chars"))


def _scan(pattern: str, name: str, keep: str = "true"):
    sql = f"SELECT doc_id, list_filter(regexp_extract_all(text, '{pattern}'), lambda x: {keep}) AS {name} FROM documents WHERE len(list_filter(regexp_extract_all(text, '{pattern}'), lambda x: {keep})) > 0"
    return sql


EMAIL = r"[^ \t\n\r<>()@]+@[^ \t\n\r<>()]*"


@query(_scan(EMAIL, "emails", "contains(x, '.') AND length(x) > 5"))
def scan_emails(spark, sf):
    found = F.filter(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)), lambda x: F.contains(x, F.lit(".")) & (F.length(x) > 5))
    return _docs(spark, sf).select("doc_id", found.alias("emails")).filter(F.size("emails") > 0)


URL = r"(?:https?://|www\.)[^ \t\n\r)\]>]+"


@query(f"SELECT page_id, regexp_extract_all('see (' || url || ') ' || html, '{URL}') AS urls FROM pages")
def scan_urls(spark, sf):
    whole = F.concat(F.lit("see ("), "url", F.lit(") "), "html")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract_all(whole, F.lit(URL), F.lit(0)).alias("urls")).filter(F.size("urls") > 0)


PHONE = r"[0-9()+][0-9() +-]*[0-9]"


@query(_scan(PHONE, "phones", "length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15"))
def scan_phones(spark, sf):
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")).between(10, 15)
    return _docs(spark, sf).select("doc_id", F.filter(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0)), digits).alias("phones")).filter(F.size("phones") > 0)


@query(f"""SELECT o_orderkey, list_filter([{_values(MONTHS)}], lambda m: contains(lower(t), m)) AS months FROM (SELECT o_orderkey, 'ordered ' || strftime(o_orderdate, '%B %d, %Y') AS t FROM orders) WHERE {_any('lower(t)', MONTHS)}""")
def scan_dates(spark, sf):
    """The month names in a text, here one of each order's date."""
    d = table(spark, sf, "orders").select("o_orderkey", F.lower(F.concat(F.lit("ordered "), F.date_format("o_orderdate", "MMMM dd, yyyy"))).alias("t"))
    found = F.filter(F.array(*[F.lit(m) for m in MONTHS]), lambda m: F.contains("t", m))
    return d.filter(T.contains_any(F.col("t"), MONTHS)).select("o_orderkey", found.alias("months"))


MONEY = r"[$€£¥] ?[0-9][0-9,.]*(?: ?(?:million|billion|trillion|thousand|k))?"
PERCENT = r"[0-9][0-9.,]*%"


@query(f"SELECT doc_id, regexp_extract_all(text, '{MONEY}') AS money, regexp_extract_all(text, '{PERCENT}') AS percents FROM documents WHERE len(regexp_extract_all(text, '{MONEY}')) + len(regexp_extract_all(text, '{PERCENT}')) > 0")
def scan_money_and_percent(spark, sf):
    out = _docs(spark, sf).select("doc_id", F.regexp_extract_all("text", F.lit(MONEY), F.lit(0)).alias("money"), F.regexp_extract_all("text", F.lit(PERCENT), F.lit(0)).alias("percents"))
    return out.filter(F.size("money") + F.size("percents") > 0)


NAMES = r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}"


@query(rf"SELECT doc_id, regexp_extract_all(text, '{NAMES}') AS names FROM documents WHERE regexp_matches(text, '{NAMES}')")
def scan_persons(spark, sf):
    """Two to four capitalised words in a row."""
    return _docs(spark, sf).filter(F.col("text").rlike(NAMES)).select("doc_id", F.regexp_extract_all("text", F.lit(NAMES), F.lit(0)).alias("names"))


@query(f"""SELECT doc_id, term, strpos(lower(text), term) - 1 AS start, 0.85::DOUBLE AS confidence FROM documents, (SELECT unnest([{_values(sum(GAZETTEER.values(), ()))}]) AS term)
WHERE contains(lower(text), term)""")
def scan_gazetteer(spark, sf):
    """The first hit of each listed term."""
    terms = F.array(*[F.lit(w) for w in sum(GAZETTEER.values(), ())])
    hits = _docs(spark, sf).select("doc_id", F.lower("text").alias("low")).select("doc_id", "low", F.explode(F.filter(terms, lambda w: F.contains(F.col("low"), w))).alias("term"))
    return hits.select("doc_id", "term", (F.instr("low", F.col("term")) - 1).alias("start"), F.lit(0.85).alias("confidence"))


SCANNERS = ((EMAIL, "email", 0.95), (URL, "url", 0.95), (PHONE, "phone", 0.8), (MONEY, "money", 0.9), (PERCENT, "percent", 0.95))


SPANS = "array<struct<start:int,end:int,confidence:double,kind:string,text:string>>"


def entity_spans(text: Column, scanners=SCANNERS) -> Column:
    """Entities of all scanners by start; of two that overlap the more confident stays, of equals the earlier."""
    spans = [_placed(text, p, k, c) for p, k, c in scanners]

    def step(state: Column, x: Column) -> Column:
        last = F.try_element_at(state, F.lit(-1))
        clash = last.isNotNull() & (x["start"] < last["end"])
        better = F.concat(F.slice(state, 1, F.size(state) - 1), F.array(x))
        return F.when(~clash, F.concat(state, F.array(x))).when(x["confidence"] > last["confidence"], better).otherwise(state)

    return F.aggregate(F.sort_array(F.concat(*spans)), F.array().cast(SPANS), step)


@query()
def resolve_overlaps(spark, sf):
    """Entities of all scanners by start; of two that overlap the more confident stays, of equals the earlier."""
    return told(_docs(spark, sf).select("doc_id", entity_spans(F.col("text")).alias("spans")), ["doc_id"], "spans", "n", "e").select("doc_id", "e.*")


def _placed(text: Column, pattern: str, kind: str, confidence: float) -> Column:
    """Spans of all matches, from the lengths of matches and of the text between them."""
    one = lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind"), x["m"].alias("text"))

    def spans(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        return T.once(pairs, lambda p: F.zip_with(p, T.once(F.transform(p, lambda x: F.length(x["g"]) + F.length(x["m"])), T.running_sums), one))

    return T.once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(F.array().cast(SPANS)))


@query(f"""SELECT conv_id, turn, strlen(text) <= 1000 AND NOT {_any('lower(text)', FORBIDDEN)} AND NOT (contains(text, '```') AND contains(text, 'system')) AS safe FROM conversations""")
def memory_safety(spark, sf):
    t = F.col("text")
    safe = (F.octet_length(t) <= 1000) & ~T.contains_any(F.lower(t), FORBIDDEN) & ~(F.contains(t, F.lit("```")) & F.contains(t, F.lit("system")))
    return table(spark, sf, "conversations").select("conv_id", "turn", safe.alias("safe"))


STATEMENTS = ("select o_comment from orders where o_orderkey = ", "DELETE FROM orders WHERE o_orderkey = ", " SELECT * FROM orders -- drop it? ", "with x as (select 1) select * from x -- ", "update orders set o_orderkey = ", "Select count(*) from created where id = ")


@query(f"""SELECT o_orderkey, q, starts_with(upper(trim(q)), 'SELECT') AND NOT {_any('upper(q)', WRITING)} AS safe FROM (SELECT o_orderkey, [{", ".join(f"'{s}'" for s in STATEMENTS)}][o_orderkey % {len(STATEMENTS)} + 1] || o_orderkey AS q FROM orders)""")
def read_only_guard(spark, sf):
    """Statements about each order: those that begin with SELECT and hold no word that writes."""
    q = F.concat(F.element_at(F.array(*[F.lit(s) for s in STATEMENTS]), (F.col("o_orderkey") % len(STATEMENTS) + 1).cast("int")), F.col("o_orderkey").cast("string"))
    rows, up = table(spark, sf, "orders").select("o_orderkey", q.alias("q")), F.upper("q")
    return rows.select("o_orderkey", "q", (F.startswith(F.trim(up), F.lit("SELECT")) & ~T.contains_any(up, WRITING)).alias("safe"))


def _score_sql(name: str, words: tuple[str, ...]) -> str:
    return f"least({_hits('low', words)} / n, 1) * 0.5 + {_hits('low', words)} / {len(words)} * 0.5 AS {name}"


@query(f"""WITH s AS (SELECT doc_id, {', '.join(_score_sql(k, v) for k, v in CATEGORIES.items())} FROM (SELECT doc_id, lower(text) AS low, greatest(len({WORDS_SQL}), 1) AS n FROM documents)),
u AS (UNPIVOT s ON {', '.join(CATEGORIES)} INTO NAME category VALUE score)
SELECT doc_id, category, round(score, 6) AS score FROM u WHERE score > 0.05 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, category) <= 3""")
def classify_category(spark, sf):
    """Half the hits a word, half the hits a keyword; the three best categories above 0.05, of equals by name."""
    d = _docs(spark, sf).select("doc_id", F.lower("text").alias("low"), F.greatest(F.size(T.words(F.col("text"))), F.lit(1)).alias("n"))
    hits = d.select("doc_id", "n", F.array(*[F.struct(F.lit(name).alias("category"), F.lit(len(words)).alias("of"), T.count_of(F.col("low"), words).alias("hits")) for name, words in CATEGORIES.items()]).alias("hits"))
    score = lambda x: F.least(x["hits"] / F.col("n"), F.lit(1.0)) * 0.5 + x["hits"] / x["of"] * 0.5
    scored = hits.select("doc_id", F.transform("hits", lambda x: F.struct(x["category"].alias("category"), score(x).alias("score"))).alias("scores"))
    ordered = F.transform(F.filter("scores", lambda x: x["score"] > 0.05), lambda x: F.struct((-F.round(x["score"], 6)).alias("less"), x["category"].alias("category"), x["score"].alias("score")))
    best = scored.select("doc_id", F.slice(F.array_sort(ordered), 1, 3).alias("best"))
    return told(best, ["doc_id"], "best", "n", "s").select("doc_id", "s.category", F.round("s.score", 6).alias("score"))


@query(f"""WITH s AS (SELECT conv_id, turn, {', '.join(f"{_hits('low', v)} / {len(v)} AS {k}" for k, v in TEXT_INTENTS.items())} FROM (SELECT conv_id, turn, lower(text) AS low FROM conversations)),
u AS (SELECT conv_id, turn, greatest({', '.join(TEXT_INTENTS)}) AS m, CASE {' '.join(f"WHEN {k} = greatest({', '.join(TEXT_INTENTS)}) THEN '{k}'" for k in TEXT_INTENTS)} END AS intent FROM s)
SELECT conv_id, turn, intent, round(m, 6) AS score FROM u WHERE m > 0.1""")
def classify_intent(spark, sf):
    """The intent with the largest share of its patterns, of equals the first as listed, above a tenth."""
    low = F.lower("text")
    c = table(spark, sf, "conversations").select("conv_id", "turn", *[(T.count_of(low, v) / F.lit(len(v))).alias(k) for k, v in TEXT_INTENTS.items()])
    most = F.greatest(*TEXT_INTENTS)
    name = F.coalesce(*[F.when(F.col(k) == most, k) for k in TEXT_INTENTS])
    return c.filter(most > 0.1).select("conv_id", "turn", name.alias("intent"), F.round(most, 6).alias("score"))


@query(f"""SELECT conv_id, turn, CASE WHEN contains(text, '?') OR {' OR '.join(f"starts_with(lower(text), '{w}')" for w in QUESTIONS)} THEN 'question'
WHEN {_hits('lower(text)', PLEASANT)} > {_hits('lower(text)', UNPLEASANT)} THEN 'positive' WHEN {_hits('lower(text)', UNPLEASANT)} > {_hits('lower(text)', PLEASANT)} THEN 'negative' ELSE 'neutral' END AS sentiment FROM conversations""")
def coarse_sentiment(spark, sf):
    low = F.lower("text")
    asks = F.contains("text", F.lit("?"))
    for w in QUESTIONS:
        asks = asks | F.startswith(low, F.lit(w))
    good, bad = T.count_of(low, PLEASANT), T.count_of(low, UNPLEASANT)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(asks, "question").when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral").alias("sentiment"))


def lexicon(text: Column) -> Column:
    """(score, hits, n) of a text's words: a word's sign, turned and weakened by a negator up to five words before it, raised by an intensifier."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 0)

    def step(s: Column, w: Column) -> Column:
        negates = w.isin(*NEGATORS)
        raises = ~negates & w.isin(*INTENSIFIERS)
        sign = F.when(w.isin(*POSITIVE_WORDS), 1.0).when(w.isin(*NEGATIVE_WORDS), -1.0).otherwise(0.0)
        turned = F.when(s["no"] & (sign != 0), -sign * 0.8).otherwise(sign) * s["by"]
        return F.struct(
            F.when(negates | raises, s["score"]).otherwise(s["score"] + turned).alias("score"),
            F.when(negates | raises, s["hits"]).otherwise(s["hits"] + (sign != 0).cast("int")).alias("hits"),
            F.when(negates, F.lit(True)).when(raises, s["no"]).otherwise(s["no"] & (sign == 0) & (s["since"] <= 3)).alias("no"),
            F.when(negates, F.lit(0)).otherwise(s["since"] + 1).alias("since"),
            F.when(raises, 1.5).when(negates, s["by"]).otherwise(1.0).alias("by"),
            (s["n"] + 1).alias("n"),
        )

    start = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("hits"), F.lit(False).alias("no"), F.lit(0).alias("since"), F.lit(1.0).alias("by"), F.lit(0).alias("n"))
    return F.aggregate(words, start, step)


@query()
def lexicon_sentiment(spark, sf):
    """Sentiment of each turn over its hits, within -1 and 1, and confidence by their density."""
    out = table(spark, sf, "conversations").select("conv_id", "turn", lexicon(F.col("text")).alias("s"))
    score = F.least(F.greatest(F.col("s.score") / F.greatest("s.hits", F.lit(1)), F.lit(-1.0)), F.lit(1.0))
    confidence = F.least(F.greatest(F.greatest("s.hits", F.lit(1)) / F.greatest("s.n", F.lit(1)) * 2.0, F.lit(0.3)), F.lit(0.95))
    label = F.when(score >= 0.6, "very_positive").when(score >= 0.2, "positive").when(score >= -0.2, "neutral").when(score >= -0.6, "negative").otherwise("very_negative")
    return out.select("conv_id", "turn", F.round(score, 6).alias("score"), F.round(confidence, 6).alias("confidence"), label.alias("sentiment"))


def _counts_sql() -> str:
    return ", ".join(f"len(list_filter(w, lambda x: x IN ({_values(v)}))) AS {k}" for k, v in COMMON_WORDS.items())


@query(f"""SELECT doc_id, CASE WHEN m < 3 THEN NULL WHEN English = m THEN 'English' WHEN Spanish = m THEN 'Spanish' WHEN French = m THEN 'French' ELSE 'German' END AS language
FROM (SELECT *, greatest(English, Spanish, French, German) AS m FROM (SELECT doc_id, {_counts_sql()} FROM (SELECT doc_id, {LOWER_WORDS_SQL} AS w FROM documents)))""")
def language_guess(spark, sf):
    """The language with the most common words, from three on; of equals the first as listed."""
    df = _docs(spark, sf).select("doc_id", T.words(F.lower("text")).alias("w"))
    df = df.select("doc_id", *[F.size(F.filter("w", _in(v))).alias(k) for k, v in COMMON_WORDS.items()])
    most = F.greatest(*COMMON_WORDS)
    name = F.when(most < 3, F.lit(None).cast("string"))
    for k in COMMON_WORDS:
        name = name.when(F.col(k) == most, k)
    return df.select("doc_id", name.alias("language"))


def _in(words: tuple[str, ...]):
    return lambda x: x.isin(*words)


@query(f"""SELECT doc_id, has_headers, has_lists, sections, round(greatest(0, least(1, 0.5::DOUBLE + 0.1 * (n > 100)::INT + 0.1 * (n > 500)::INT + 0.1 * has_headers::INT + 0.05 * has_lists::INT + 0.1 * (sections > 2)::INT - 0.2 * (n < 20)::INT)), 6) AS score
FROM (SELECT doc_id, len({WORDS_SQL}) AS n, {_any('text', ('# ', '<h1', '<h2'))} AS has_headers, {_any('text', ('- ', '* ', '1. ', '<li'))} AS has_lists,
len(regexp_extract_all(text, '# ')) + len(regexp_extract_all(text, '## ')) AS sections FROM documents)""")
def structure_quality(spark, sf):
    t = F.col("text")
    flag = lambda c: c.cast("int")
    df = _docs(spark, sf).select("doc_id", F.size(T.words(t)).alias("n"), T.contains_any(t, ("# ", "<h1", "<h2")).alias("has_headers"), T.contains_any(t, ("- ", "* ", "1. ", "<li")).alias("has_lists"), (F.regexp_count(t, F.lit("# ")) + F.regexp_count(t, F.lit("## "))).alias("sections"))
    score = 0.5 + 0.1 * flag(F.col("n") > 100) + 0.1 * flag(F.col("n") > 500) + 0.1 * flag(F.col("has_headers")) + 0.05 * flag(F.col("has_lists")) + 0.1 * flag(F.col("sections") > 2) - 0.2 * flag(F.col("n") < 20)
    return df.select("doc_id", "has_headers", "has_lists", "sections", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"))


@query(f"""SELECT conv_id, turn, CASE {' '.join(f"WHEN {_any('q', words)}" + (r" OR regexp_matches(trim(q), '^[0-9.-]*$')" if name == 'math' else '') + f" THEN '{name}'" for name, _, _, words in INTENTS)} ELSE 'semantic_search' END AS intent
FROM (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user')""")
def detect_intent(spark, sf):
    """The first intent, in order, one of whose strings occurs."""
    q = F.lower("text")
    intent = None
    for name, _, _, words in INTENTS:
        test = T.contains_any(q, words)
        if name == "math":
            test = test | F.trim(q).rlike("^[0-9.-]*$")
        intent = F.when(test, name) if intent is None else intent.when(test, name)
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", intent.otherwise("semantic_search").alias("intent"))


@query(r"""SELECT conv_id, turn, step, part FROM (SELECT conv_id, turn, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS step FROM (SELECT conv_id, turn, string_split_regex(lower(text), ' and | then | or ') AS parts FROM conversations WHERE role = 'user'))""")
def split_steps(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), " and | then | or ")).alias("step", "part"))


@query(r"""SELECT doc_id, array_to_string(list_slice(s, 1, 4), ' ') AS summary, round(1 - length(array_to_string(list_slice(s, 1, 4), ' ')) / greatest(length(text), 1), 6) AS compression
FROM (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda x: trim(x, chr(10) || ' ')), lambda x: length(x) > 10) AS s FROM documents)""")
def extractive_summary(spark, sf):
    """The first four sentences of more than ten characters."""
    parts = F.filter(F.transform(F.split("text", "[.!?]"), lambda x: F.regexp_replace(x, "^[\n ]+|[\n ]+$", "")), lambda x: F.length(x) > 10)
    short = F.array_join(F.slice(parts, 1, 4), " ")
    return _docs(spark, sf).select("doc_id", short.alias("summary"), F.round(1 - F.length(short) / F.greatest(F.length("text"), F.lit(1)), 6).alias("compression"))


REWRITES = {"teh": "the", "adn": "and", "db": "database", "api": "interface", "ml": "machine learning"}
STOP_WORDS = ("the", "a", "an", "of", "to", "and", "is", "in")


def _case_sql() -> str:
    return "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REWRITES.items()) + " ELSE x END"


@query(f"""SELECT conv_id, turn, CASE WHEN length(r) = 0 THEN text ELSE r END AS rewritten FROM (SELECT conv_id, turn, text,
array_to_string(list_filter(list_transform({LOWER_WORDS_SQL}, lambda x: {_case_sql()}), lambda x: x NOT IN ({_values(STOP_WORDS)})), ' ') AS r FROM conversations WHERE role = 'user')""")
def rewrite_query(spark, sf):
    """Typos and abbreviations replaced, stop words removed; the text itself where nothing is left."""
    def replaced(x: Column) -> Column:
        out = x
        for k, v in REWRITES.items():
            out = F.when(x == k, v).otherwise(out)
        return out

    kept = F.array_join(F.filter(F.transform(T.words(F.lower("text")), replaced), lambda x: ~x.isin(*STOP_WORDS)), " ")
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.when(F.length(kept) == 0, F.col("text")).otherwise(kept).alias("rewritten"))


@query(f"""SELECT a.conv_id, a.turn, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0), 6) AS similarity
FROM (SELECT conv_id, turn, list_distinct({LOWER_WORDS_SQL}) AS w FROM conversations) a JOIN (SELECT conv_id, turn, list_distinct({LOWER_WORDS_SQL}) AS w FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def query_similarity(spark, sf):
    """Word Jaccard of each turn and the next."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(T.words(F.lower("text"))).alias("w"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


@query(r"""SELECT doc_id, regexp_extract(text, '[0-9]+', 0) AS first_number, regexp_extract(text, '(?s)=\s*([0-9.]+)[^=]*$', 1) AS result, list_last(string_split(text, '=')) = text AS plain FROM documents""")
def key_data(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", F.regexp_extract(t, "[0-9]+", 0).alias("first_number"), F.regexp_extract(t, r"(?s)=\s*([0-9.]+)[^=]*$", 1).alias("result"), (F.substring_index(t, "=", -1) == t).alias("plain"))


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.2f KB', round(b / 1024, 2)) ELSE printf('%.2f MB', round(b / 1048576, 2)) END AS size FROM (SELECT doc_id, strlen(text) AS b FROM documents)""")
def human_bytes(spark, sf):
    b = F.octet_length("text")
    size = F.when(b < 1024, F.format_string("%d B", b)).when(b < 1048576, F.format_string("%.2f KB", F.round(b / 1024, 2))).otherwise(F.format_string("%.2f MB", F.round(b / 1048576, 2)))
    return _docs(spark, sf).select("doc_id", size.alias("size"))


@query(r"""SELECT event_id, h, regexp_matches(h, '^00-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$') AS valid, string_split(h, '-')[2] AS trace_id FROM (SELECT event_id, '00-' || md5(event_id::VARCHAR) || '-' || substr(md5(user_id::VARCHAR), 1, 16) || '-01' AS h FROM events)""")
def trace_parent(spark, sf):
    h = F.concat(F.lit("00-"), F.md5(F.col("event_id").cast("string")), F.lit("-"), F.substring(F.md5(F.col("user_id").cast("string")), 1, 16), F.lit("-01"))
    return table(spark, sf, "events").select("event_id", h.alias("h")).select("event_id", "h", F.col("h").rlike("^00-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$").alias("valid"), F.split("h", "-")[1].alias("trace_id"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_matches(regexp_extract(url, '^https?://([^/.]+)', 1), '^[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?$') AS slug FROM pages")
def slug_check(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://([^/.]+)", 1).rlike("^[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?$").alias("slug"))


@query("SELECT doc_id, '[Source: ' || source || '] ' || text AS chunk FROM documents")
def context_prefix(spark, sf):
    return _docs(spark, sf).select("doc_id", F.concat(F.lit("[Source: "), "source", F.lit("] "), "text").alias("chunk"))


@query("""SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS lines FROM documents)
WHERE lines >= 12 AND strlen(line) <= 80 GROUP BY doc_id, line HAVING count(*) >= 4""")
def repeated_lines(spark, sf):
    """Lines of at most 80 bytes that stand four times or more in a document of twelve lines or more."""
    lines = _docs(spark, sf).select("doc_id", F.split("text", "\n").alias("l")).filter(F.size("l") >= 12).select("doc_id", F.explode("l").alias("line"))
    return lines.filter(F.octet_length("line") <= 80).groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter("n >= 4")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS k FROM l)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM c WHERE NOT (n >= 12 AND strlen(line) <= 80 AND k >= 4) GROUP BY doc_id""")
def remove_repeated_lines(spark, sf):
    """Within the row, in two passes over its lines, and nothing is shuffled."""
    return _docs(spark, sf).select("doc_id", "text").mapInPandas(_without_repeats, "doc_id long, digest string")


def _without_repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, text in zip(b["doc_id"], b["text"], strict=True):
            lines = text.split("\n") if text is not None else []
            often = Counter(lines) if len(lines) >= 12 else {}
            kept = [x for x in lines if not (often.get(x, 0) >= 4 and len(x.encode()) <= 80)]
            if kept:
                rows.append((key, hashlib.md5("\n".join(kept).encode()).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "digest"])


@query("""SELECT r.doc_id, CASE WHEN r.quality <= 0 THEN 1 WHEN r.quality >= 5 THEN 5 ELSE r.quality END AS rating FROM labels r""")
def clamp_rating(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.least(F.greatest("quality", F.lit(1)), F.lit(5)).alias("rating"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '\.(png|jpg|gif)$') THEN 'image' WHEN starts_with(ltrim(html), '<') THEN 'html' WHEN starts_with(ltrim(html), '{') THEN 'json' ELSE 'text' END AS kind FROM pages""")
def file_type(spark, sf):
    h = F.ltrim("html")
    kind = F.when(F.col("url").rlike(r"\.(png|jpg|gif)$"), "image").when(F.startswith(h, F.lit("<")), "html").when(F.startswith(h, F.lit("{")), "json").otherwise("text")
    return table(spark, sf, "pages").select("page_id", kind.alias("kind"))


@query("""SELECT conv_id, turn, CASE WHEN n IS NULL THEN NULL WHEN unit = 'minute' THEN n * 60 WHEN unit = 'hour' THEN n * 3600 ELSE n * 86400 END AS seconds FROM
(SELECT conv_id, turn, try_cast(nullif(regexp_extract(s, 'in ([0-9]+) (minute|hour|day)', 1), '') AS BIGINT) AS n, regexp_extract(s, 'in ([0-9]+) (minute|hour|day)', 2) AS unit FROM
(SELECT conv_id, turn, 'remind me in ' || (turn + 1) || CASE turn % 3 WHEN 0 THEN ' minutes' WHEN 1 THEN ' hours' ELSE ' days' END AS s FROM conversations))""")
def relative_time(spark, sf):
    s = F.concat(F.lit("remind me in "), (F.col("turn") + 1).cast("string"), F.when(F.col("turn") % 3 == 0, " minutes").when(F.col("turn") % 3 == 1, " hours").otherwise(" days"))
    n = F.nullif(F.regexp_extract(s, "in ([0-9]+) (minute|hour|day)", 1), F.lit("")).cast("long")
    unit = F.regexp_extract(s, "in ([0-9]+) (minute|hour|day)", 2)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(unit == "minute", n * 60).when(unit == "hour", n * 3600).otherwise(n * 86400).alias("seconds"))
