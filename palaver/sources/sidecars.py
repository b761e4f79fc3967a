"""Files of subagents beside a session: which session they belong to, what they are listed as, and their text for search.

A session ``<project>/<id>.jsonl`` has its agents in ``<project>/<id>/subagents/agent-<name>.jsonl``, each with a small
``.meta.json`` of its own, which may be missing or broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import head_tail, stripped, without_escapes

# Fixed values of the paths, and characters of a part that search looks at.
FOLDER, PREFIX, PART_CHARS = "subagents", "agent-", 16 * 1024
_PATH = rf"^(?:(.*)/)?([^/]+)/{FOLDER}/{PREFIX}([^/]*)\.jsonl$"


def place(path: Column) -> Column:
    """(project, session_id, agent_id) of a subagent's file; null for any other path."""
    parts = [F.regexp_extract(path, _PATH, k).alias(n) for k, n in ((1, "project"), (2, "session_id"), (3, "agent_id"))]
    return F.when(path.rlike(_PATH), F.struct(*parts))


def parent(path: Column) -> Column:
    """The session's own file."""
    at = place(path)
    return F.when(at.isNotNull(), F.concat(F.when(at["project"] == "", F.lit("")).otherwise(F.concat(at["project"], F.lit("/"))), at["session_id"], F.lit(".jsonl")))


def meta_of(path: Column) -> Column:
    return F.regexp_replace(path, r"\.jsonl$", ".meta.json")


def described(files: DataFrame, metas: DataFrame) -> DataFrame:
    """(path, parent, agent_id, kind, summary) of the subagents' files in ``files`` (path), with their ``metas`` (path, value: the
    JSON text). A person's fork is a branch of the conversation and is listed as described; any other agent is a child,
    listed by its type and description. Metadata that is missing or broken says nothing."""
    found = files.where(place(F.col("path")).isNotNull()).select("path", parent(F.col("path")).alias("parent"), place(F.col("path"))["agent_id"].alias("agent_id"), meta_of(F.col("path")).alias("meta"))
    rows = found.join(metas.select(F.col("path").alias("meta"), "value"), "meta", "left").withColumn("v", F.try_parse_json("value"))

    def text(key: str) -> Column:
        return F.try_variant_get("v", f"$.{key}", "string")

    def kind_of(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant"))

    # one field of another type makes the whole of it unreadable
    sound = F.schema_of_variant("v").startswith("OBJECT")
    for key in ("agentType", "description", "toolUseId"):
        sound = sound & F.coalesce(kind_of(key).isin("STRING", "VOID"), F.lit(True))
    sound = F.coalesce(sound & F.coalesce(kind_of("isFork") == "BOOLEAN", F.lit(True)), F.lit(False))
    rows = rows.withColumn("sound", sound)
    told = rows.withColumns({k: F.when(F.col("sound"), text(k)) for k in ("agentType", "description", "toolUseId")})
    told = told.withColumns({"fork": F.coalesce(F.col("sound") & F.try_variant_get("v", "$.isFork", "boolean"), F.lit(False)), "description": F.nullif(stripped(F.col("description")), F.lit(""))})
    described_ = F.col("description")
    branch = F.col("fork") & F.col("toolUseId").isNull()
    listed = F.when(branch, described_).otherwise(F.nullif(F.concat_ws(": ", "agentType", described_), F.lit("")))
    return told.select("path", "parent", "agent_id", F.when(branch, "branch").otherwise("child").alias("kind"), listed.alias("summary"))


def search_text(parts: Column) -> Column:
    """What search sees of a message's parts (source, text), joined by spaces; blank parts give none, long ones are cut, and the
    whole is kept at its ends."""
    kept = F.filter(F.transform(parts, lambda p: F.left(p["text"], F.lit(PART_CHARS))), lambda t: t.isNotNull() & (stripped(t) != ""))
    whole = F.array_join(F.transform(kept, without_escapes), " ")
    most = F.lit(PART_CHARS) * F.greatest(F.size(parts), F.lit(1))
    head = F.floor(most * 3 / 4).cast("int")
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.left(whole, head), F.lit(" "), F.right(whole, most - head)))


def with_agents(sessions: DataFrame, agents: DataFrame, messages: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``sessions`` (path) with ``agent_text``: what their children say (``messages``: path, ordinal, parts), by file and place.
    Only children count: a branch is a conversation of its own. Each message is cut before it travels, and a session's text
    to ``most`` characters."""
    said = messages.select("path", "ordinal", F.left(search_text(F.col("parts")), F.lit(most)).alias("text")).where("text <> ''")
    rows = said.join(agents.where("kind = 'child'").select("path", "parent"), "path")
    first = rows.groupBy("parent", "path").agg(_joined("ordinal", most).alias("text"))
    whole = first.groupBy("parent").agg(_joined("path", most).alias("agent_text"))
    return sessions.join(whole.withColumnRenamed("parent", "path"), "path", "left")


def _joined(order: str, most: int) -> Column:
    return head_tail(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " "), most)


def visible(messages: DataFrame, tools: bool = False, results: bool = False, thinking: bool = False, subagents: bool = False) -> DataFrame:
    """Messages (parent_tool_use_id, parts of source and text) as a reader asked for them: subagents' messages and parts other
    than text only on request."""
    shown = ["dialogue", *(["tool"] if tools else []), *(["result"] if results else []), *(["thinking"] if thinking else [])]
    rows = messages if subagents else messages.where("parent_tool_use_id is null")
    return rows.withColumn("parts", F.filter("parts", lambda p: p["source"].isin(*shown)))


# -- small rules of what a tool writes into a session -----------------------------------------------------------------
# Texts of the format (fixed values).
FORK_OPEN, FORK_CLOSE, DIRECTIVE = "<fork-boilerplate>", "</fork-boilerplate>", "Your directive:"
MID_OPEN, MID_CLOSE = "The user sent a new message while you were working:", "\n\nThis is how Claude Code surfaces messages the user sends mid-turn"


def is_task_notification(text: Column) -> Column:
    """A text that is one notification of a task and nothing else."""
    bare = stripped(text)
    body = F.substring(bare, len("<task-notification>") + 1, F.length(bare) - 2 * len("<task-notification>") - 1)
    whole = bare.startswith("<task-notification>") & bare.endswith("</task-notification>") & (F.length(bare) >= 2 * len("<task-notification>") + 1)
    return whole & F.ltrim(F.regexp_replace(body, r"(?U)^\s+", "")).startswith("<task-id>") & body.contains("</task-id>") & ~body.contains("</task-notification>")


def unframed(text: Column) -> Column:
    """What a person wrote inside the frame of a fork or of a message sent while an agent worked; null for other texts."""
    bare = F.regexp_replace(text, r"(?U)^\s+", "")
    rest = F.substring(bare, F.instr(bare, FORK_CLOSE) + len(FORK_CLOSE), F.length(bare))
    rest = F.regexp_replace(rest, r"(?U)^\s+", "")
    asked = F.when(rest.startswith(DIRECTIVE), F.substring(rest, len(DIRECTIVE) + 1, F.length(rest))).otherwise(rest)
    sent = F.substring(bare, len(MID_OPEN) + 1, F.length(bare))
    # up to the last closing sentence
    behind = F.element_at(F.split(sent, MID_CLOSE, -1), -1)
    sent = F.when(sent.contains(MID_CLOSE), F.left(sent, F.length(sent) - F.length(behind) - len(MID_CLOSE))).otherwise(sent)
    fork = F.when(F.instr(bare, FORK_CLOSE) > 0, stripped(asked))
    return F.when(bare.startswith(FORK_OPEN), fork).when(bare.startswith(MID_OPEN), stripped(sent))


def side_question(command: Column) -> Column:
    """The question of a /btw command line; null for other commands."""
    return F.when(command.startswith("/btw "), stripped(F.substring(command, 6, F.length(command))))


def own_files(found: DataFrame) -> DataFrame:
    """Of (path, source, also, written_by), the files that the source of their root wrote; a file of another source counts where
    that source's root holds it too, and any file does under a flat root."""
    return found.where((F.col("source") == "flat") | (F.col("written_by") == F.col("source")) | F.array_contains("also", F.col("written_by")))
