"""Queries of the session formats: the messages of ``conversations`` written as log lines and decoded again.

The lines of a conversation are those of one file (its id is the path), in each of the three formats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.plans.model import messages, table
from palaver.plans.registry import query
from palaver.plans.stored import shared_folder
from palaver.sources import rollouts, sessions

_STAMP = "2024-01-01T00:00:00Z"


def _lines(rows: DataFrame, line, value) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("path"), line.cast("int").alias("line"), F.to_json(value).alias("value"))


def flat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.struct(F.concat_ws("-", "key", "turn").alias("id"), F.col("role").alias("role"), F.col("text").alias("content"), F.struct(F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens")).alias("usage"))
    return _lines(messages(spark, sf_dir), F.col("turn") + 1, F.struct(F.col("role").alias("type"), F.lit(_STAMP).alias("timestamp"), content.alias("message")))


def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header, then entries; every third one is a leaf that the next entry does not follow."""
    rows = messages(spark, sf_dir)
    heads = _lines(rows.where("turn = 0"), F.lit(1), F.struct(F.lit("session").alias("type"), F.lit(3).alias("version"), F.col("key").cast("string").alias("id")))
    before = F.when(F.col("turn") % 3 == 0, F.col("turn") - 2).otherwise(F.col("turn") - 1)
    parent = F.when(F.col("turn") > 0, F.concat(F.lit("e"), before))
    entry = F.struct(F.lit("message").alias("type"), F.concat(F.lit("e"), "turn").alias("id"), parent.alias("parentId"), F.struct("role", F.col("text").alias("content")).alias("message"))
    return heads.unionByName(_lines(rows, F.col("turn") + 2, entry))


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head, then a message and a running total for each turn; the total starts anew at turn 4."""
    rows = messages(spark, sf_dir)
    heads = _lines(rows.where("turn = 0"), F.lit(1), F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("key").cast("string").alias("id")).alias("payload")))
    kind = F.when(F.col("role") == "user", "user_message").otherwise("agent_message")
    talk = _lines(rows, F.col("turn") * 2 + 2, F.struct(F.lit("event_msg").alias("type"), F.struct(kind.alias("type"), F.col("text").alias("message")).alias("payload")))
    spent = (F.col("turn") % 4 + 1) * 100
    total = F.struct(F.struct(spent.alias("input_tokens"), (spent / 10).cast("long").alias("output_tokens"), (spent / 2).cast("long").alias("cached_input_tokens")).alias("total_token_usage"))
    count = _lines(rows, F.col("turn") * 2 + 3, F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), total.alias("info")).alias("payload")))
    return heads.unionByName(talk).unionByName(count)


@query("""SELECT conv_id::VARCHAR AS path, (turn + 1)::INT AS line, CASE WHEN role IN ('user', 'assistant') THEN 'message' ELSE 'other' END AS kind,
CASE WHEN role IN ('user', 'assistant') THEN role END AS role, CASE WHEN role IN ('user', 'assistant') THEN text END AS text,
conv_id || '-' || turn AS message_id, length(text) AS input, turn AS output FROM conversations""")
def dec_flat_events(spark, sf_dir):
    """The flat format: roles, text, ids, usage."""
    return sessions.flat_events(flat_lines(spark, sf_dir)).select("path", "line", "kind", "role", "text", "message_id", F.col("usage.input").alias("input"), F.col("usage.output").alias("output"))


@query("""SELECT conv_id::VARCHAR AS path, (turn + 2)::INT AS line, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, text FROM conversations c
WHERE turn % 3 <> 2 OR turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id)""")
def dec_tree_branch(spark, sf_dir):
    """The tree format: the branch that ends in the last entry."""
    return sessions.tree_events(tree_lines(spark, sf_dir)).where("kind = 'message'").select("path", "line", "role", "text")


@query("""SELECT conv_id::VARCHAR AS path, (turn * 2 + 2)::INT AS line, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM conversations""")
def dec_rollout_messages(spark, sf_dir):
    return sessions.rollout_events(rollout_lines(spark, sf_dir)).where("kind = 'message'").select("path", "line", "role", "text")


@query("""WITH t AS (SELECT conv_id::VARCHAR AS path, (turn * 2 + 3)::INT AS line, turn, (turn % 4 + 1) * 100 AS i, (turn % 4 + 1) * 10 AS o, (turn % 4 + 1) * 50 AS c FROM conversations)
SELECT path, line, CASE WHEN turn % 4 = 0 THEN i - c ELSE 50 END AS input, CASE WHEN turn % 4 = 0 THEN o ELSE 10 END AS output, CASE WHEN turn % 4 = 0 THEN c ELSE 50 END AS cache_read FROM t""")
def dec_rollout_usage(spark, sf_dir):
    """Running totals as what was spent since the last one; a smaller total starts anew."""
    rows = sessions.rollout_events(rollout_lines(spark, sf_dir)).where("kind = 'usage'")
    return rows.select("path", "line", *[F.col(f"usage.{c}").alias(c) for c in ("input", "output", "cache_read")])


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [rows(spark, sf_dir).where(F.col("path").cast("bigint") % 3 == k) for k, rows in enumerate((flat_lines, tree_lines, rollout_lines))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT DISTINCT conv_id::VARCHAR AS path, CASE conv_id % 3 WHEN 0 THEN 'flat' WHEN 1 THEN 'tree' ELSE 'rollout' END AS format FROM conversations")
def src_detect_formats(spark, sf_dir):
    """The format of each file, by its first lines."""
    return sessions.detect(_mixed(spark, sf_dir))


@query("""SELECT conv_id::VARCHAR AS path, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY turn)) AS texts FROM conversations c
WHERE CASE conv_id % 3 WHEN 0 THEN role IN ('user', 'assistant') WHEN 1 THEN turn % 3 <> 2 OR turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id) ELSE TRUE END GROUP BY 1""")
def src_all_formats(spark, sf_dir):
    """Files of all formats in one event model."""
    rows = sessions.events(_mixed(spark, sf_dir)).where("kind = 'message'")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda m: m["text"]), "\n")
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.md5(texts).alias("texts"))


@query("""WITH l AS (SELECT conv_id::VARCHAR AS path, (turn + 1)::INT AS line, conv_id % 5 = turn AS bad FROM conversations)
SELECT path, line, (SELECT count(*) FROM l b WHERE b.path = l.path AND b.line BETWEEN l.line - 2 AND l.line - 1) AS n_before,
(SELECT count(*) FROM l a WHERE a.path = l.path AND a.line BETWEEN l.line + 1 AND l.line + 2) AS n_after FROM l WHERE bad""")
def src_malformed_lines(spark, sf_dir):
    """Torn lines with the lines around them; they stop nothing."""
    rows = flat_lines(spark, sf_dir)
    torn = F.when(F.col("path").cast("bigint") % 5 == F.col("line") - 1, F.left("value", F.length("value") - 1)).otherwise(F.col("value"))
    return sessions.malformed(rows.withColumn("value", torn)).select("path", "line", F.size("before").cast("long").alias("n_before"), F.size("after").cast("long").alias("n_after"))


@query("""SELECT conv_id AS thread_id, arg_max(CASE WHEN turn % 4 = 3 THEN '' ELSE left(text, 12) END, turn) AS name FROM conversations GROUP BY 1
HAVING arg_max(CASE WHEN turn % 4 = 3 THEN '' ELSE left(text, 12) END, turn) <> ''""")
def src_last_names(spark, sf_dir):
    """The last name of each thread; an empty one takes the name away."""
    name = F.when(F.col("turn") % 4 == 3, "").otherwise(F.left("text", F.lit(12)))
    return sessions.last_names(messages(spark, sf_dir).select(F.col("key").alias("thread_id"), F.col("turn").alias("line"), name.alias("name")))


@query("""SELECT conv_id AS key, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN FALSE WHEN 1 THEN TRUE WHEN 2 THEN TRUE END AS generated FROM conversations""")
def dec_generated_user(spark, sf_dir):
    """Whether records say that a person or a tool wrote them."""
    form = (F.col("key") + F.col("turn")) % 4
    raw = F.when(form == 0, '{"origin":{"kind":"human"}}').when(form == 1, '{"isCompactSummary":true}').when(form == 2, '{"origin":{"kind":"peer"}}').otherwise("{}")
    return messages(spark, sf_dir).select("key", "turn", sessions.generated_user(raw).alias("generated"))


@query("""SELECT conv_id AS key, left(md5(conv_id::VARCHAR), 8) || '-1111-2222-3333-' || left(md5('x' || conv_id), 12) AS thread FROM (SELECT DISTINCT conv_id FROM conversations)""")
def src_thread_ids(spark, sf_dir):
    """Thread ids in the names of rollout files."""
    keys = messages(spark, sf_dir).select("key").distinct()
    own = F.concat(F.left(F.md5(F.col("key").cast("string")), F.lit(8)), F.lit("-1111-2222-3333-"), F.left(F.md5(F.concat(F.lit("x"), F.col("key").cast("string"))), F.lit(12)))
    return keys.select("key", sessions.thread_of(F.concat(F.lit("/logs/2024/rollout-2024-01-01T00-00-00-"), own, F.lit(".jsonl"))).alias("thread"))


# -- heads of rollout files -------------------------------------------------------------------------------------------
@query("""SELECT conv_id AS key, CASE WHEN conv_id % 6 < 2 THEN 'interactive' WHEN conv_id % 6 = 2 THEN 'automated' ELSE 'unknown' END AS mode,
CASE conv_id % 6 WHEN 3 THEN '' WHEN 4 THEN 't' || conv_id WHEN 5 THEN 'p' || conv_id END AS parent FROM (SELECT DISTINCT conv_id FROM conversations)""")
def dec_rollout_heads(spark, sf_dir):
    """Mode and parent by heads of six kinds: no source, a person's, a script's, two kinds of subagent, a named parent."""
    key = F.col("key")
    spawn = F.to_json(F.struct(F.struct(F.struct(F.struct(F.concat(F.lit("t"), key).alias("parent_thread_id")).alias("thread_spawn")).alias("subagent")).alias("source")))
    kinds = [F.lit("{}"), F.lit('{"source":"cli"}'), F.lit('{"source":"exec"}'), F.lit('{"source":{"subagent":"review"}}'), spawn, F.to_json(F.struct(F.lit("other").alias("source"), F.concat(F.lit("p"), key).alias("parent_thread_id")))]
    heads = messages(spark, sf_dir).select("key").distinct().withColumn("meta", F.element_at(F.array(*kinds), (key % 6 + 1).cast("int")))
    return heads.select("key", rollouts.mode(F.col("meta")).alias("mode"), rollouts.parent(F.col("meta")).alias("parent"))


@query("""SELECT conv_id AS key, coalesce(max(turn) FILTER (conv_id % 3 <> 0 AND turn >= 2), max(turn) FILTER (conv_id % 3 = 0 OR turn < 2)) AS last FROM conversations GROUP BY 1""")
def dec_last_activity(spark, sf_dir):
    """The first two turns are taken over from a base, in every third conversation all are; a turn stands for its time."""
    rows = messages(spark, sf_dir).select("key", F.col("turn").alias("ts"), ((F.col("turn") < 2) | (F.col("key") % 3 == 0)).alias("inherited"))
    return rollouts.last_activity(rows)


# -- threads of rollout files -----------------------------------------------------------------------------------------
def _rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rollout files: a user's are a thread. What one goes on from makes forks, cycles, missing bases and, in every
    other run of forty, chains longer than are followed; every ninth file cannot be read."""
    e = F.col("event_id")
    on = F.when((F.floor(e / 40) % 2 == 1) & (e % 40 != 0), e - 1).when((e % 7).isin(1, 2, 3, 5), e - 1).when(e % 7 == 4, e + 1)
    named = F.when(on.isNotNull(), F.lpad(on.cast("string"), 8, "0")).when(e % 7 == 6, F.concat(F.lit("X"), e))
    first = F.when(named.isNotNull(), F.to_json(F.struct(F.struct(F.struct(named.alias("thread_id"), (e % 50 * 10).alias("end_byte_offset")).alias("history_base")).alias("payload")))).otherwise(F.lit('{"payload":{}}'))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("thread_id"), F.lpad(e.cast("string"), 8, "0").alias("rollout_id"), (e % 4 == 0).alias("archived"), F.when(e % 9 != 8, e % 1000).alias("size"), first.alias("first"))
    return rows.select("*", F.concat(F.lit("/h/"), "rollout_id", F.lit(".jsonl")).alias("path"), rollouts.base(F.col("first")).alias("base")).drop("first")


def _thread_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a thread table says: a file that is there, one that is gone, paginated or not; nothing of two threads in five."""
    ids = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u")).agg(F.min("event_id").alias("e")).where("u % 5 < 3")
    path = F.when(F.col("u") % 5 == 0, F.concat(F.lit("/moved/"), F.lpad(F.col("e").cast("string"), 8, "0"), F.lit(".jsonl.zst"))).otherwise("/h/gone.jsonl")
    return ids.select(F.col("u").cast("string").alias("thread_id"), path.alias("rollout_path"), (F.col("u") % 5 == 1).alias("paginated"))


_ROLLOUTS_SQL = """e AS (SELECT event_id AS id, user_id AS t, CASE WHEN (event_id // 40) % 2 = 1 AND event_id % 40 <> 0 THEN event_id - 1 WHEN event_id % 7 IN (1, 2, 3, 5) THEN event_id - 1 WHEN event_id % 7 = 4 THEN event_id + 1 WHEN event_id % 7 = 6 THEN -1 END AS base,
  event_id % 9 <> 8 AS there FROM events),
s AS (SELECT t, min(id) AS first FROM e GROUP BY 1), k AS (SELECT * FROM e WHERE there),
x AS (SELECT k.*, k.id = s.first AND k.t % 5 = 0 AS named, EXISTS (SELECT 1 FROM k o WHERE o.t = k.t AND o.base = k.id) AS continued FROM k JOIN s ON s.t = k.t),
h AS (SELECT t, CASE WHEN bool_or(named) THEN min(id) FILTER (named) WHEN t % 5 = 1 OR count(*) = 1 THEN max(id) ELSE coalesce(max(id) FILTER (NOT continued), max(id)) END AS id,
  CASE WHEN bool_or(named) THEN 'current' WHEN t % 5 = 1 THEN 'orphaned' ELSE 'inferred' END AS status FROM x GROUP BY t)"""


@query(f"WITH {_ROLLOUTS_SQL} SELECT t::VARCHAR AS thread_id, lpad(id::VARCHAR, 8, '0') AS rollout_id, id % 4 = 0 AS archived, status FROM h")
def dec_thread_heads(spark, sf_dir):
    """The head of each thread and how it was chosen."""
    return rollouts.heads(_rollouts(spark, sf_dir), _thread_rows(spark, sf_dir)).select("thread_id", "rollout_id", "archived", "status")


_CHAINS_SQL = f"""{_ROLLOUTS_SQL.replace("WITH ", "")}, c(t, id, n, seen, fin) AS (SELECT t, id, 0, [id], NULL::BIGINT FROM h
  UNION ALL SELECT c.t, b.id, c.n + 1, list_append(c.seen, b.id), (a.id % 50 * 10) FROM c JOIN e a ON a.id = c.id JOIN e b ON b.id = a.base AND b.there WHERE c.n < 15 AND NOT list_contains(c.seen, b.id)),
m AS (SELECT t, max(n) AS most FROM c GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_CHAINS_SQL} SELECT c.t::VARCHAR AS thread_id, (most - n)::INT AS place, lpad(c.id::VARCHAR, 8, '0') AS rollout_id, fin AS "end", r.t <> c.t AS inherited,
CASE WHEN n = 0 THEN (SELECT CASE WHEN z.base IS NULL OR list_contains(q.seen, z.base) OR most = 15 THEN NULL WHEN z.base = -1 THEN 'x' || z.id ELSE lpad(z.base::VARCHAR, 8, '0') END FROM c q JOIN e z ON z.id = q.id WHERE q.t = c.t AND q.n = most) END AS missing
FROM c JOIN m ON m.t = c.t JOIN e r ON r.id = c.id""")
def dec_thread_chains(spark, sf_dir):
    """The files behind each thread, oldest first, with what they hold up to which byte."""
    shared_folder(spark)
    files = _rollouts(spark, sf_dir)
    found = rollouts.chains(rollouts.heads(files, _thread_rows(spark, sf_dir)), files)
    return found.select("thread_id", "place", "rollout_id", "end", "inherited", "missing")


@query(f"""WITH RECURSIVE {_CHAINS_SQL}, v AS (SELECT c.t, most - n AS place, r.t <> c.t AS inherited, d.turn, d.role, d.text FROM c JOIN m ON m.t = c.t JOIN e r ON r.id = c.id JOIN conversations d ON d.conv_id = c.id WHERE fin IS NULL OR (turn * 40) < fin),
w AS (SELECT * FROM v WHERE role IN ('user', 'system') OR inherited), f AS (SELECT *, coalesce(lag(inherited) OVER (PARTITION BY t ORDER BY place, turn), FALSE) AND NOT inherited AS forks FROM w)
SELECT t::VARCHAR AS thread_id, place::INT AS place, (turn + 1)::INT AS line, 1 AS part, role AS kind, text FROM f WHERE role <> 'system'
UNION ALL SELECT t::VARCHAR, place::INT, (turn + 1)::INT, 0, 'note', 'Fork: The conversation continues from here' FROM f WHERE forks""")
def dec_fork_entries(spark, sf_dir):
    """What a reader of each thread sees, with a note where it leaves its base: the lines of a rollout are the turns of the
    conversation of its number, 40 bytes each; people's lines are dialogue, the others are taken over from a base only."""
    shared_folder(spark)
    files = _rollouts(spark, sf_dir)
    chain = rollouts.chains(rollouts.heads(files, _thread_rows(spark, sf_dir)), files)
    rows = messages(spark, sf_dir)
    turns = rows.select(F.concat(F.lit("/h/"), F.lpad(F.col("key").cast("string"), 8, "0"), F.lit(".jsonl")).alias("path"), (F.col("turn") + 1).cast("int").alias("line"), (F.col("turn") * 40).alias("offset"), F.struct("role", "text").alias("value"))
    seen = rollouts.thread_lines(turns, chain).select("thread_id", "place", "line", "inherited", F.when(F.col("value.role") == "system", "other").otherwise(F.col("value.role")).alias("kind"), F.when(F.col("value.role").isin("user", "system"), "dialogue").otherwise("inherited").alias("visibility"), "value.text")
    return rollouts.entries(seen).select("thread_id", "at.place", "at.line", "at.part", "kind", "text")
