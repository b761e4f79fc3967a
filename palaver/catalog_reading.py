"""Queries of matches with their spans, of what previews hide, and of reads within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.functions.spans import query_ranges
from palaver.operators import evidence, fold, hits, matches, reading, retrieval, semantic, within
from palaver.plans.model import BASE, messages, prepared, table
from palaver.plans.registry import CORPUS_SQL, MESSAGES_SQL, NORM, query

# -- matches ----------------------------------------------------------------------------------------------------------
_PARTS = """seg AS (SELECT key, ordinal, 0 AS part, 'dialogue' AS source, text FROM m UNION ALL SELECT key, ordinal, 1, 'thinking', left(text, 60) FROM m WHERE ordinal % 2 = 0
  UNION ALL SELECT key, ordinal, 2, 'tool', 'the ' || right(text, 90) FROM m WHERE ordinal % 3 = 0)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages with thoughts and tool results drawn from their texts, as segments with their normalised form."""
    rows = fold.ordinals(messages(spark, sf_dir))
    out = F.array(F.struct(F.lit("t").alias("id"), F.concat(F.lit("the "), F.right("text", F.lit(90))).alias("output")))
    none = "array<struct<id:string,output:string>>"
    rows = rows.withColumns({"thinking": F.when(F.col("ordinal") % 2 == 0, F.left("text", F.lit(60))), "tools": F.array().cast("array<struct<id:string,name:string,input:string>>"), "results": F.when(F.col("ordinal") % 3 == 0, out).otherwise(F.array().cast(none))})
    return hits.segments(rows).withColumn("norm", tx.normalized("text"))


_PLACES = r"[i FOR i IN range(1, length({0})) IF substr({0}, i, {1}) = '{2}' AND (i = 1 OR NOT regexp_matches(substr({0}, i - 1, 1), '\p{{L}}'))]"


@query(rf"""WITH {MESSAGES_SQL}, {_PARTS},
o AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY key, ordinal ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, {NORM.format("text")} AS n FROM seg),
w AS (SELECT *, regexp_matches(n, '(?:^|[^\p{{L}}])the') AS a, regexp_matches(n, '(?:^|[^\p{{L}}])and') AS b, {_PLACES.format("lower(text)", 2, "de")} AS p, {_PLACES.format("text", 2, "Th")} AS q FROM o),
r AS (SELECT *, CASE WHEN a OR b THEN off ELSE off + least(CASE WHEN len(p) > 0 THEN strlen(left(text, (p[1] - 1)::INT)) END, CASE WHEN len(q) > 0 THEN strlen(left(text, (q[1] - 1)::INT)) END) END AS low,
  CASE WHEN a OR b THEN off + strlen(text) ELSE off + greatest(CASE WHEN len(p) > 0 THEN strlen(left(text, (p[-1] + 1)::INT)) END, CASE WHEN len(q) > 0 THEN strlen(left(text, (q[-1] + 1)::INT)) END) END AS high FROM w),
g AS (SELECT key, ordinal, max(a::INT) AS a, max(b::INT) AS b, max((len(p) > 0)::INT) AS p, max((len(q) > 0)::INT) AS q, min(low)::BIGINT AS "first", max(high)::BIGINT AS "last", string_agg(n, ' ' ORDER BY part) AS n,
  min(CASE source WHEN 'dialogue' THEN 0 WHEN 'tool' THEN 1 ELSE 2 END) FILTER (low IS NOT NULL) AS rank, bool_or(source = 'tool' AND low IS NOT NULL) AS tools, bool_or(source = 'thinking' AND low IS NOT NULL) AS thinking FROM r GROUP BY 1, 2),
s AS (SELECT *, a + b + p + q = 4 AS strict, max((a + b + p + q = 4)::INT) OVER (PARTITION BY key) AS best FROM g WHERE "first" IS NOT NULL)
SELECT key, ordinal, ['dialogue', 'tool', 'thinking'][rank + 1] AS source, "first", "last", tools, thinking, a + b + p + q AS terms,
  round(4.0 * (a + b + p + q) + 6.0 + 2.0 * contains(n, 'the and')::INT + 1.0 / greatest("last" - "first", 1), 6) AS score FROM s WHERE strict OR best = 0""")
def ret_message_matches(spark, sf_dir):
    """Two words and two quoted texts: scores by what stands where, of conversations without a full match by what there is."""
    found = matches.match_messages(parts(spark, sf_dir), 'the and "de" "Th"', partial=True)
    return found.select("key", F.col("ordinal").cast("long").alias("ordinal"), "source", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "tools", "thinking", "terms", F.round("score", 6).alias("score"))


@query(rf"""WITH {MESSAGES_SQL}, {_PARTS},
o AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY key, ordinal ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, {NORM.format("text")} AS n FROM seg),
g AS (SELECT key, ordinal, min(off) AS "first", max(off + strlen(text)) AS "last", min(CASE source WHEN 'dialogue' THEN 0 WHEN 'tool' THEN 1 ELSE 2 END) AS rank FROM o WHERE regexp_matches(n, '(?:^|[^\p{{L}}])the') GROUP BY 1, 2),
s AS (SELECT *, 4.0 + 1.0 / greatest("last" - "first", 1) AS score FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, ordinal, rank, "first") AS place FROM s)
SELECT key, ordinal, round(score, 6) AS score, place FROM p WHERE place <= 2 ORDER BY score DESC, key % 3 DESC, sha256(key::VARCHAR), ordinal LIMIT 30""")
def ret_ordered_matches(spark, sf_dir):
    """Two matches of a conversation, thirty in all (the feature's bounds), in their full order: score, time, reference, place."""
    rows = messages(spark, sf_dir).select("key").distinct()
    known = rows.select("key", F.timestamp_seconds(F.lit(int(BASE.timestamp())) + F.col("key") % 3).alias("ts"), F.sha2(F.col("key").cast("string"), 256).alias("ref"))
    placed = matches.ordered(matches.match_messages(parts(spark, sf_dir), "the"), known, 2)
    return matches.overall(placed, 30).select("key", F.col("ordinal").cast("long").alias("ordinal"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(rf"""WITH d AS (SELECT doc_id, text, {NORM.format("text").removeprefix("replace(").removesuffix(", 'ß', 'ss')")} AS n FROM documents),
p AS (SELECT doc_id, text, unnest([i FOR i IN range(1, length(n)) IF substr(n, i, 3) = 'and' AND (i = 1 OR NOT regexp_matches(substr(n, i - 1, 1), '\p{{L}}'))]) AS i FROM d)
SELECT doc_id, strlen(left(text, (i - 1)::INT))::INT AS "start", strlen(left(text, (i + 2)::INT))::INT AS "end" FROM p""")
def txt_word_ranges(spark, sf_dir):
    """Where a word stands, in bytes of the text as written."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(query_ranges(["and"])("text")).alias("r")).select("doc_id", "r.start", "r.end")


# -- what a preview hides ---------------------------------------------------------------------------------------------
_N = r"len(regexp_extract_all({0}, '(?:^|[^\p{{L}}]){1}'))"


@query(rf"""WITH {CORPUS_SQL}, v AS (SELECT key, {_N.format("body_norm", "the")} AS a, {_N.format("body_norm", "that")} AS b, {_N.format(NORM.format("left(body, 200)"), "the")} AS x, {_N.format(NORM.format("left(body, 200)"), "that")} AS y FROM c)
SELECT key, CASE WHEN x = 0 OR y = 0 THEN (x = 0 AND a > 0) OR (y = 0 AND b > 0) ELSE a + b > x + y END AS hides FROM v""")
def evd_hidden(spark, sf_dir):
    """Whether a text shows more of the words than its first 200 characters do."""
    rows = prepared(spark, sf_dir).withColumn("shown", F.left("body", F.lit(200))).withColumn("shown_norm", tx.normalized("shown"))
    return rows.select("key", evidence.hides(F.col("body"), F.col("body_norm"), F.col("shown"), F.col("shown_norm"), "the that").alias("hides"))


@query()
def evd_against_preview(spark, sf_dir):
    """Excerpts of all texts that show more than their preview: held against a plain version in the tests."""
    rows = prepared(spark, sf_dir).withColumn("shown", F.left("body", F.lit(200))).withColumn("shown_norm", tx.normalized("shown"))
    rows = rows.where(evidence.hides(F.col("body"), F.col("body_norm"), F.col("shown"), F.col("shown_norm"), 'worthless "clown"'))
    return rows.select("key", evidence.against('worthless "clown"')("body", "shown").alias("e")).where("e.text is not null").select("key", F.col("e.text").alias("excerpt"), F.to_json("e.ranges").alias("ranges"))


# -- reads within a budget --------------------------------------------------------------------------------------------
READ_BUDGET = 1800


def _conversation_line() -> Column:
    return F.concat(F.lit("conversation project=alpha uuid="), F.col("key").cast("string"), F.lit(" ref=ch_"), F.left(F.sha2(F.col("key").cast("string"), 256), F.lit(12)), F.lit("\n"))


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, conversations and a read of each conversation around its fourth message (of some, without a focus)."""
    rows = fold.ordinals(messages(spark, sf_dir))
    spoken = rows.select("key", F.col("ordinal").cast("long").alias("ordinal"), "role", (F.col("turn") + 1).alias("line"), retrieval.anchor(F.col("role"), F.col("text")).alias("anchor"), F.col("text").alias("body"))
    keys = rows.select("key").distinct()
    known = keys.select("key", F.concat(F.lit("ch_"), F.left(F.sha2(F.col("key").cast("string"), 256), F.lit(12))).alias("ref"), _conversation_line().alias("conversation"))
    focus = F.when(F.col("key") % 5 != 0, F.lit(4)).cast("long")
    return spoken, known, keys.select("key", F.col("key").alias("req"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), focus.alias("focus_first"), focus.alias("focus_last"))


@query(rf"""WITH RECURSIVE {MESSAGES_SQL}, z AS (SELECT key, ordinal, length('message m' || ordinal || ' role=' || role || ' line=' || (turn + 1) || ' anchor=') + 20 + list_sum([CASE WHEN x = '' THEN 2 ELSE length(x) + 3 END FOR x IN string_split(text, chr(10))]) AS chars FROM m),
t AS (SELECT key, sum(chars) AS total, max(ordinal) AS n, length('conversation project=alpha uuid=' || key || ' ref=ch_') + 13 AS line, CASE WHEN key % 5 <> 0 AND max(ordinal) >= 4 THEN 4 ELSE 1 END AS focus FROM z GROUP BY key),
r(key, low, high, used, step) AS (SELECT t.key, focus, focus, line + length('protocol agent-read cut=head+focus+tail budget-chars={READ_BUDGET}') + 1 + z.chars, 0 FROM t JOIN z ON z.key = t.key AND z.ordinal = focus
  UNION ALL SELECT key, low - l, high + h, used + CASE WHEN l = 1 THEN lc ELSE 0 END + CASE WHEN h = 1 THEN hc ELSE 0 END, step + 1 FROM (
    SELECT *, CASE WHEN hc IS NOT NULL AND used + CASE WHEN l = 1 THEN lc ELSE 0 END + hc <= {READ_BUDGET} THEN 1 ELSE 0 END AS h FROM (
      SELECT r.*, a.chars AS lc, b.chars AS hc, CASE WHEN a.chars IS NOT NULL AND used + a.chars <= {READ_BUDGET} THEN 1 ELSE 0 END AS l FROM r LEFT JOIN z a ON a.key = r.key AND a.ordinal = low - 1 LEFT JOIN z b ON b.key = r.key AND b.ordinal = high + 1)) WHERE l + h > 0),
e AS (SELECT r.*, row_number() OVER (PARTITION BY key ORDER BY step DESC) AS place FROM r)
SELECT z.key, z.ordinal FROM z JOIN t ON t.key = z.key JOIN e ON e.key = z.key AND place = 1
WHERE total + line + length('protocol agent-read cut=none budget-chars={READ_BUDGET}') + 1 <= {READ_BUDGET} OR z.ordinal BETWEEN low AND high""")
def ret_read_selection(spark, sf_dir):
    """The messages that a budget shows around a focus, taken from either side in turn."""
    spoken, known, requests = _asked(spark, sf_dir)
    rows = reading.asked_messages(spoken, requests).join(known, "key")
    return reading.selected(rows, F.length("conversation"), READ_BUDGET).where("taken").select(F.col("req").alias("key"), "ordinal")


@query()
def ret_read_pages(spark, sf_dir):
    """The same reads as text, with what is left out told: held against a plain version in the tests."""
    return reading.pages(*_asked(spark, sf_dir), READ_BUDGET)


# -- inside conversations ---------------------------------------------------------------------------------------------
_NEAR = """q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
e AS (SELECT vec_id % 100 AS key, vec_id // 100 % 6 + 1 AS ordinal, max(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)::DOUBLE[])) AS score FROM embeddings GROUP BY 1, 2)"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of a hundred conversations by their nearness to the vector of row 0 (a single row)."""
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.where("vec_id = 0").select("embedding").first()[0]
    score = semantic.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in one]))
    return vectors.select((F.col("vec_id") % 100).alias("key"), (F.floor(F.col("vec_id") / 100) % 6 + 1).alias("ordinal"), score.alias("score"))


@query(rf"""WITH {MESSAGES_SQL}, {_PARTS}, {_NEAR},
o AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY key, ordinal ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, {NORM.format("text")} AS n FROM seg),
l AS (SELECT key, ordinal, 4.0 + 1.0 / greatest(max(off + strlen(text)) - min(off), 1) AS score FROM o WHERE regexp_matches(n, '(?:^|[^\p{{L}}])the') GROUP BY 1, 2),
b AS (SELECT coalesce(l.key, e.key) AS key, coalesce(l.ordinal, e.ordinal) AS ordinal, l.score AS ls, e.score AS es FROM l FULL OUTER JOIN e ON e.key = l.key AND e.ordinal = l.ordinal),
f AS (SELECT b.key, b.ordinal, CASE WHEN ls IS NULL THEN 'semantic' WHEN es IS NULL THEN 'lexical' ELSE 'hybrid' END AS kind, coalesce(ls, es) AS evidence,
  (CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.key = b.key) THEN 1.0 / 61 ELSE 0 END) + (CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.key = b.key) THEN 1.0 / 61 ELSE 0 END) AS score FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE kind WHEN 'semantic' THEN 2 ELSE 1 END, evidence DESC, ordinal) AS place FROM f)
SELECT key, ordinal, kind, round(score, 9)::DOUBLE AS score, place FROM p WHERE place <= 4""")
def ret_within_hybrid(spark, sf_dir):
    """Four hits inside each conversation, by words and by meaning."""
    found = within.within(parts(spark, sf_dir), "the", 4, _near(spark, sf_dir), asked="hybrid")
    return found.select("key", F.col("ordinal").cast("long").alias("ordinal"), "kind", F.round("score", 9).alias("score"), F.col("place").cast("long").alias("place"))


@query(rf"""WITH {_NEAR}, p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, ordinal) AS place FROM e)
SELECT key, ordinal, 'semantic' AS kind, round(score, 4) AS score, place FROM p WHERE place <= 3""")
def ret_within_semantic(spark, sf_dir):
    """Three hits inside each conversation by meaning."""
    found = within.within(parts(spark, sf_dir), "the", 3, _near(spark, sf_dir), configured="semantic")
    return found.select("key", F.col("ordinal").cast("long").alias("ordinal"), "kind", F.round("score", 4).alias("score"), F.col("place").cast("long").alias("place"))


@query(rf"""WITH {MESSAGES_SQL}, {_PARTS},
o AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY key, ordinal ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, {_PLACES.format("text", 3, "The")} AS q FROM seg),
g AS (SELECT key, ordinal, min(CASE source WHEN 'dialogue' THEN 0 WHEN 'tool' THEN 1 ELSE 2 END) AS rank, min(off + strlen(left(text, (q[1] - 1)::INT))) AS low, max(off + strlen(left(text, (q[-1] + 2)::INT))) AS high FROM o WHERE len(q) > 0 GROUP BY 1, 2),
p AS (SELECT *, 7.0 + 1.0 / greatest(high - low, 1) AS score, row_number() OVER (PARTITION BY key ORDER BY rank, 7.0 + 1.0 / greatest(high - low, 1) DESC, ordinal, low) AS place FROM g)
SELECT key, ordinal, 'lexical' AS kind, round(score, 6) AS score, place FROM p WHERE place <= 3""")
def ret_within_exact(spark, sf_dir):
    """A quoted text inside each conversation: dialogue before tools before thoughts."""
    found = within.within(parts(spark, sf_dir), '"The"', 3)
    return found.select("key", F.col("ordinal").cast("long").alias("ordinal"), "kind", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))
