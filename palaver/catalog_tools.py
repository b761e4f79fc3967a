"""Queries of tool calls and results as text, of the passages that agents' tools give, and of ranges in local time."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.catalog_reading import _PARTS, parts
from palaver.functions.query import time_range
from palaver.operators import fold, retrieval, semantic, tools
from palaver.plans.model import NOW, messages, table
from palaver.plans.registry import MESSAGES_SQL, query
from palaver.sources import sidecars

NAMES = ["Task", "Bash", "Read", "grep", "Glob", "find", "Edit", "write", "WebFetch", "web_search", "codemode", "ls", "suba", "suba_send", "suba_resume", "suba_finish", "suba_list", "process", "Skill", "mcp__x"]


@query(rf"""WITH e AS (SELECT event_id AS i, event_type AS t, {NAMES!r}[event_id % {len(NAMES)} + 1] AS name FROM events)
SELECT i AS event_id, CASE name WHEN 'Task' THEN 'Task (' || t || '): d' || i WHEN 'Bash' THEN 'Bash: run ' || i WHEN 'Read' THEN 'Read: /p/' || t || CASE WHEN i % 3 = 0 THEN '' ELSE ':' || (i % 100) || CASE WHEN i % 3 = 1 THEN '-' || (i % 100 + 7) ELSE '' END END
  WHEN 'grep' THEN 'Grep: "a.' || i || '" in /p/' || t || '/*.py' WHEN 'Glob' THEN 'Glob: a.' || i || ' in /p/' || t WHEN 'find' THEN 'Find: a.' || i || ' in /p/' || t WHEN 'Edit' THEN 'Edit: /p/' || t WHEN 'write' THEN 'Write: /p/' || t
  WHEN 'WebFetch' THEN 'Fetch: http://u/' || i WHEN 'web_search' THEN 'Search: "q' || i || '", "' || t || '"' WHEN 'codemode' THEN 'Codemode: c' || i WHEN 'ls' THEN 'List: /p/' || t
  WHEN 'suba' THEN 'Suba: n' || i WHEN 'suba_send' THEN 'Suba send: 9' WHEN 'suba_resume' THEN 'Suba resume: 9' WHEN 'suba_finish' THEN 'Suba finish: 9' WHEN 'suba_list' THEN 'Suba list' WHEN 'process' THEN 'Process go: n' || i
  WHEN 'Skill' THEN 'Skill: /tidy ' || t ELSE name || ': {{ "a": {{}}, "b": [' || i || ', "x, {{ y"], "c": {{ "d": null }} }}' END AS header,
CASE name WHEN 'Task' THEN 'p' || i WHEN 'Bash' THEN 'then ' || t WHEN 'Edit' THEN '- old ' || i || chr(10) || '- line' || chr(10) || '+ new' WHEN 'WebFetch' THEN 'p' || i WHEN 'suba' THEN 'k' || i WHEN 'suba_send' THEN 'm' || i WHEN 'suba_resume' THEN 'k' || i WHEN 'process' THEN 'run ' || i || chr(10) || 'then ' || t END AS body FROM e""")
def rnd_tool_calls(spark, sf_dir):
    """One layout for each tool that is known, JSON on one line for the rest."""
    i, t = F.col("event_id").cast("string"), F.col("event_type")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES) + 1).cast("int"))

    def said(prefix: str):
        return F.concat(F.lit(prefix), i)

    known = F.to_json(F.struct(
        t.alias("subagent_type"), said("d").alias("description"), said("p").alias("prompt"), F.concat(said("run "), F.lit("\nthen "), t).alias("command"), F.concat(F.lit("/p/"), t).alias("path"), said("a.").alias("pattern"), F.lit("*.py").alias("glob"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 100).alias("offset"), F.when(F.col("event_id") % 3 == 1, F.lit(7)).alias("limit"), F.concat(said("old "), F.lit("\nline")).alias("old_string"), F.lit("new").alias("new_string"),
        F.array(said("http://u/")).alias("urls"), F.array(said("q"), t).alias("queries"), said("c").alias("code"), said("n").alias("name"), F.lit("9").alias("id"), said("k").alias("task"), said("m").alias("message"), F.lit(5).alias("result"), F.lit("go").alias("action"), F.lit("tidy").alias("skill"), F.concat(t, F.lit(" ")).alias("args"),
    ))
    other = F.concat(F.lit('{"b":['), i, F.lit(',"x, { y"],"c":{"d":null},"a":{}}'))
    shown = tools.tool_call(F.col("tool"), F.col("arguments"))
    return table(spark, sf_dir, "events").select("event_id", name.alias("tool"), F.when(name == "mcp__x", other).otherwise(known).alias("arguments")).select("event_id", shown.alias("l")).select("event_id", "l.header", "l.body")


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN '<no content>' WHEN 1 THEN 'seen ' || event_type WHEN 2 THEN 'Error: bad ' || event_id WHEN 3 THEN 'first' || chr(10) || chr(10) || '[image: image/png]' || chr(10) || chr(10) || 'Loaded tool: ' || event_type
WHEN 4 THEN '{' || chr(10) || '  "k": ' || event_id || ',' || chr(10) || '  "l": [' || chr(10) || '    1,' || chr(10) || '    {}' || chr(10) || '  ]' || chr(10) || '}' WHEN 5 THEN '' WHEN 6 THEN 'kept ' || event_id ELSE '[document: text/css]' || chr(10) || chr(10) || '{ "n": ' || event_id || ', "type": "odd" }' END AS body FROM events""")
def rnd_tool_results(spark, sf_dir):
    """Results as text: blocks, errors, notices, JSON over lines."""
    i, form = F.col("event_id").cast("string"), F.col("event_id") % 8

    def text(*parts):
        return F.to_json(F.struct(F.concat(*parts).alias("v")))

    plain = F.regexp_extract(F.when(form == 1, text(F.lit("seen "), F.col("event_type"))).when(form == 2, text(F.lit(" <tool_use_error> bad "), i, F.lit("</tool_use_error>"))).when(form == 4, text(F.lit('{"l":[1,{}],"k":'), i, F.lit("}"))).otherwise(text(F.lit("<persisted-output>\nkept "), i, F.lit("\n</persisted-output>"))), r'(?s)^\{"v":(.*)\}$', 1)
    blocks = F.concat(F.lit('[{"type":"text","text":"first"},{"type":"image","source":{"media_type":"image/png"}},{"type":"tool_reference","tool_name":"'), F.col("event_type"), F.lit('"}]'))
    odd = F.concat(F.lit('[{"type":"document","image_url":"data:text/css;base64,AA"},{"type":"odd","n":'), i, F.lit("}]"))
    content = F.when(form == 3, blocks).when(form == 5, "[1]").when(form == 7, odd).when(form != 0, plain)
    content = F.when(form == 5, "[]").otherwise(content)
    return table(spark, sf_dir, "events").select("event_id", tools.tool_result(content).alias("body"))


@query(rf"""WITH RECURSIVE {MESSAGES_SQL}, {_PARTS}, z AS (SELECT key, ordinal, part, source, text FROM seg WHERE trim(text) <> ''),
r(key, ordinal, part, source, segment, now, rest) AS (SELECT key, ordinal, part, source, -1, '', text FROM z WHERE source = 'tool'
  UNION ALL SELECT key, ordinal, part, source, segment + 1, left(rest, n), substr(rest, n + 1) FROM (SELECT *, list_max([i FOR i IN range(1, 41) IF strlen(left(rest, i)) <= 40])::INT AS n FROM r WHERE rest <> '')),
t AS (SELECT key, ordinal, part, source, segment, now AS text FROM r WHERE segment >= 0 UNION ALL SELECT key, ordinal, part, source, 0, text FROM z WHERE source <> 'tool')
SELECT key, ordinal, part, CASE WHEN ordinal % 4 = 0 THEN 'subagent-' ELSE '' END || source AS source, segment, trim(text, ' ' || chr(10)) AS text FROM t WHERE trim(text, ' ' || chr(10)) <> ''""")
def sem_agent_passages(spark, sf_dir):
    """Passages of six kinds; tool texts in parts of forty bytes that cut no character."""
    rows = parts(spark, sf_dir).withColumn("subagent", F.col("ordinal") % 4 == 0)
    return semantic.agent_passages(rows, most=40).select("key", F.col("ordinal").cast("long").alias("ordinal"), F.col("part").cast("int").alias("part"), "source", F.col("segment").cast("int").alias("segment"), "text")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 05:00:00' AND ts < TIMESTAMP '2024-01-11 05:00:00'")
def flt_local_range(spark, sf_dir):
    """Days of a place: from its midnight to the end of its last day."""
    low, high = time_range("2024-01-05", "2024-01-10", NOW, "America/New_York")
    return table(spark, sf_dir, "events").where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))).select("event_id")


# -- subagents' files and references ----------------------------------------------------------------------------------
@query(r"""WITH p AS (SELECT page_id AS i, '/h/p' || (page_id % 7) || '/s' || (page_id // 5) AS session, trim(split_part(html, '<', 2)) AS d FROM pages)
SELECT session || '/subagents/agent-a' || i || '.jsonl' AS path, session || '.jsonl' AS parent, 'a' || i AS agent_id, CASE WHEN i % 8 = 1 THEN 'branch' ELSE 'child' END AS kind,
CASE i % 8 WHEN 0 THEN 'x' || i || ': ' || d WHEN 1 THEN d WHEN 4 THEN 'y: ' || d WHEN 5 THEN 'only' WHEN 6 THEN d END AS summary FROM p""")
def src_sidecars(spark, sf_dir):
    """Subagents' files with their parents; metadata in all its forms, broken and missing too."""
    i, form = F.col("page_id").cast("string"), F.col("page_id") % 8
    session = F.concat(F.lit("/h/p"), (F.col("page_id") % 7).cast("string"), F.lit("/s"), F.floor(F.col("page_id") / 5).cast("string"))
    said = F.trim(F.element_at(F.split("html", "<"), 2))
    rows = table(spark, sf_dir, "pages").select(F.concat(session, F.lit("/subagents/agent-a"), i, F.lit(".jsonl")).alias("path"), form.alias("form"), i.alias("i"), said.alias("d"))
    told = F.when(F.col("form") == 0, F.to_json(F.struct(F.concat(F.lit("x"), "i").alias("agentType"), F.concat(F.lit(" "), "d", F.lit(" ")).alias("description"))))
    told = told.when(F.col("form") == 1, F.to_json(F.struct(F.lit("z").alias("agentType"), F.col("d").alias("description"), F.lit(True).alias("isFork"))))
    told = told.when(F.col("form") == 2, "{broken").when(F.col("form") == 3, '{"agentType":5,"description":"lost"}').when(F.col("form") == 4, F.to_json(F.struct(F.lit("y").alias("agentType"), F.col("d").alias("description"), F.lit("t").alias("toolUseId"), F.lit(True).alias("isFork"))))
    told = told.when(F.col("form") == 5, '{"agentType":"only","description":"  "}').when(F.col("form") == 6, F.to_json(F.struct(F.col("d").alias("description"))))
    metas = rows.where("form < 7").select(sidecars.meta_of(F.col("path")).alias("path"), told.alias("value"))
    return sidecars.described(rows.select("path"), metas)


@query(rf"""WITH {MESSAGES_SQL}, a AS (SELECT key // 4 * 4 AS parent, key, string_agg(text || CASE WHEN ordinal % 3 = 0 THEN ' seen ' || ordinal ELSE '' END, ' ' ORDER BY ordinal) AS t FROM m WHERE key % 4 IN (1, 2) GROUP BY 1, 2),
s AS (SELECT DISTINCT key FROM m WHERE key % 4 = 0)
SELECT s.key::VARCHAR || '.jsonl' AS path, (SELECT string_agg(t, ' ' ORDER BY lpad(a.key::VARCHAR, 8, '0')) FROM a WHERE a.parent = s.key) AS agent_text FROM s""")
def fld_agent_text(spark, sf_dir):
    """What the children of a session say, in its search text: of four conversations the first is a session, the next two are
    its children and the last is a branch."""
    rows = fold.ordinals(messages(spark, sf_dir))
    file = F.concat(F.floor(F.col("key") / 4).cast("long") * 4, F.lit("/subagents/agent-"), F.lpad(F.col("key").cast("string"), 8, "0"), F.lit(".jsonl"))
    extra = F.when(F.col("ordinal") % 3 == 0, F.array(F.struct(F.lit("result").alias("source"), F.concat(F.lit("seen "), F.col("ordinal").cast("string")).alias("text"))))
    said = rows.where("key % 4 > 0").select(file.alias("path"), "ordinal", F.concat(F.array(F.struct(F.lit("dialogue").alias("source"), F.col("text").alias("text"))), F.coalesce(extra, F.array().cast("array<struct<source:string,text:string>>"))).alias("parts"), (F.col("key") % 4).alias("k"))
    metas = said.where("k = 3").select(sidecars.meta_of(F.col("path")).alias("path"), F.lit('{"isFork":true}').alias("value")).distinct()
    agents = sidecars.described(said.select("path").distinct(), metas)
    sessions = rows.where("key % 4 = 0").select(F.concat(F.col("key").cast("string"), F.lit(".jsonl")).alias("path")).distinct()
    return sidecars.with_agents(sessions, agents, said)


@query(r"""WITH c AS (SELECT conv_id AS key, turn, (conv_id + turn) % 6 AS form, trim(text, ' ' || chr(10)) AS t FROM conversations WHERE text IS NOT NULL)
SELECT key, turn, form = 0 AS notice, CASE form WHEN 1 THEN t WHEN 2 THEN t WHEN 3 THEN t END AS typed, CASE WHEN form = 4 THEN t END AS asked FROM c""")
def dec_frames(spark, sf_dir):
    """Notices of tasks, questions in the frame of a fork, messages sent while an agent worked, side questions."""
    rows, form, text = messages(spark, sf_dir).where("text is not null"), (F.col("key") + F.col("turn")) % 6, F.col("text")
    framed = F.when(form == 0, F.concat(F.lit(" <task-notification>\n<task-id>7</task-id>"), F.left(text, F.lit(30)), F.lit("</task-notification>")))
    framed = framed.when(form == 1, F.concat(F.lit(f"{sidecars.FORK_OPEN}rules{sidecars.FORK_CLOSE}\n\n{sidecars.DIRECTIVE} "), text)).when(form == 2, F.concat(F.lit(f"{sidecars.FORK_OPEN}rules{sidecars.FORK_CLOSE}"), text))
    framed = framed.when(form == 3, F.concat(F.lit(f"\n{sidecars.MID_OPEN}\n"), text, F.lit(f"{sidecars.MID_CLOSE}. More."))).when(form == 4, F.concat(F.lit("/btw "), text)).otherwise(F.concat(F.lit("a <task-notification><task-id>1</task-id></task-notification> "), text))
    rows = rows.withColumn("framed", framed)
    return rows.select("key", "turn", sidecars.is_task_notification(F.col("framed")).alias("notice"), sidecars.unframed(F.col("framed")).alias("typed"), sidecars.side_question(F.col("framed")).alias("asked"))


@query(rf"""WITH {MESSAGES_SQL} SELECT key, ordinal, CASE WHEN ordinal % 2 = 0 THEN text || '|seen' ELSE text END AS shown FROM m WHERE ordinal % 5 <> 0""")
def flt_visible(spark, sf_dir):
    """Messages of the conversation itself with their text and results, without thoughts and calls."""
    part = "array<struct<source:string,text:string>>"
    rows = fold.ordinals(messages(spark, sf_dir)).select("key", F.col("ordinal").cast("long").alias("ordinal"), F.when(F.col("ordinal") % 5 == 0, "t").alias("parent_tool_use_id"), F.concat(F.array(F.struct(F.lit("dialogue").alias("source"), F.col("text").alias("text"))), F.when(F.col("ordinal") % 2 == 0, F.from_json(F.lit('[{"source":"result","text":"seen"},{"source":"thinking","text":"hm"},{"source":"tool","text":"look"}]'), part)).otherwise(F.array().cast(part))).alias("parts"))
    return sidecars.visible(rows, results=True).select("key", "ordinal", F.array_join(F.transform("parts", lambda p: p["text"]), "|").alias("shown"))


_KEYS_SQL = """k AS (SELECT doc_id AS key, left(md5((doc_id // 2)::VARCHAR), 8) || left(md5(doc_id::VARCHAR), 24) AS ref, md5('old' || doc_id) AS legacy_ref,
  left(md5('u' || doc_id % 700), 8) || '-' || substr(md5('u' || doc_id % 700), 9, 4) || '-' || substr(md5('u' || doc_id % 700), 13, 4) || '-' || substr(md5('u' || doc_id % 700), 17, 4) || '-' || substr(md5('u' || doc_id % 700), 21, 12) AS uuid FROM documents)"""


@query(f"""WITH {_KEYS_SQL}, i AS (SELECT key AS of, CASE key % 9 WHEN 0 THEN 'ch_' || left(ref, 14) WHEN 1 THEN 'ch_' || upper(left(ref, 8)) WHEN 2 THEN 'ch_' || left(legacy_ref, 20) WHEN 3 THEN upper(uuid) WHEN 4 THEN 'n' || key || '_' || uuid || '.jsonl' WHEN 5 THEN 'ch_' || left(ref, 7)
  WHEN 6 THEN 'ch_' || ref || '0' WHEN 7 THEN 'ch_zz' || left(ref, 8) ELSE 'a/' || uuid END AS input, key % 9 AS form FROM k),
m AS (SELECT DISTINCT i.input, k.key, k.ref FROM i JOIN k ON (form IN (0, 1) AND starts_with(k.ref, lower(substr(input, 4)))) OR (form = 2 AND starts_with(legacy_ref, substr(input, 4))) OR (form = 3 AND k.uuid = lower(input)) OR (form = 4 AND k.key = i.of)),
g AS (SELECT input, count(*) AS n, min(key) AS key, string_agg(ref, ',' ORDER BY ref) AS c FROM m GROUP BY 1), d AS (SELECT DISTINCT input, form FROM i)
SELECT d.input, CASE WHEN form >= 5 THEN 'invalid' WHEN n = 1 THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'not found' END AS state, CASE form WHEN 5 THEN '{retrieval.TOO_SHORT}' WHEN 6 THEN '{retrieval.TOO_LONG}' WHEN 7 THEN '{retrieval.NOT_HEX}' WHEN 8 THEN '{retrieval.OTHER_FORM}' END AS error,
  coalesce(n, 0) AS n, CASE WHEN n = 1 THEN key END AS key, CASE WHEN n > 1 THEN c END AS candidates FROM d LEFT JOIN g ON g.input = d.input""")
def ref_forms(spark, sf_dir):
    """References of all forms: digests new and old, UUIDs, file names, those that several share and those that are none."""
    i = F.col("doc_id")
    h = F.md5(F.concat(F.lit("u"), (i % 700).cast("string")))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    keys = table(spark, sf_dir, "documents").select(i.alias("key"), F.concat(F.left(F.md5(F.floor(i / 2).cast("string")), F.lit(8)), F.left(F.md5(i.cast("string")), F.lit(24))).alias("ref"), F.md5(F.concat(F.lit("old"), i.cast("string"))).alias("legacy_ref"), uuid.alias("uuid"))
    keys = keys.withColumn("file", F.concat(F.lit("n"), F.col("key").cast("string"), F.lit("_"), "uuid", F.lit(".jsonl")))
    forms = [F.concat(F.lit("ch_"), F.left("ref", F.lit(14))), F.concat(F.lit("ch_"), F.upper(F.left("ref", F.lit(8)))), F.concat(F.lit("ch_"), F.left("legacy_ref", F.lit(20))), F.upper("uuid"), F.col("file"), F.concat(F.lit("ch_"), F.left("ref", F.lit(7))), F.concat(F.lit("ch_"), "ref", F.lit("0")), F.concat(F.lit("ch_zz"), F.left("ref", F.lit(8)))]
    text = F.concat(F.lit("a/"), "uuid")
    for k, form in enumerate(forms):
        text = F.when(F.col("key") % 9 == k, form).otherwise(text)
    return retrieval.resolved_refs(keys.select(text.alias("input")), keys).withColumn("candidates", F.array_join("candidates", ","))
