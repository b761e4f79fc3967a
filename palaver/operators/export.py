"""Renderings of transcripts: tool lines, short project names, ages, plain, Markdown and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value of the folder names.
WORKTREE_MARK = "--worktrees-"


def tool_summary(name: Column, payload: Column) -> Column:
    """``tool NAME input_keys=a,b`` of a call with a JSON object."""
    return F.concat(F.lit("tool "), name, F.lit(" input_keys="), F.coalesce(F.array_join(F.json_object_keys(payload), ","), F.lit("")))


def short_name(path: Column) -> Column:
    """Last part of a project path; a worktree reads main/branch."""
    tree = F.regexp_extract(path, r"([^/]+)__worktrees/([^/]+)/?$", 0)
    named = F.concat(F.regexp_extract(path, r"([^/]+)__worktrees/([^/]+)/?$", 1), F.lit("/"), F.regexp_extract(path, r"([^/]+)__worktrees/([^/]+)/?$", 2))
    return F.when(tree != "", named).otherwise(F.regexp_extract(path, r"([^/]+)/?$", 1))


def within(path: Column, folder: str) -> Column:
    """The folder itself or anything below it."""
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def age(seconds: Column) -> Column:
    """Hours below two days, days from then on."""
    return F.when(seconds < 48 * 3600, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))


def export(messages: DataFrame, form: str = "plain") -> DataFrame:
    """(key, body): a conversation's messages in order, as plain text, Markdown or JSON lines."""
    line = {
        "plain": F.concat(F.col("role"), F.lit(": "), F.col("text")),
        "markdown": F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.col("text")),
        "jsonl": F.to_json(F.struct("ordinal", "role", "text")),
    }[form]
    rows = messages.select("key", F.struct("ordinal", line.alias("line")).alias("m"))
    return rows.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"]), "\n" if form == "jsonl" else "\n\n").alias("body"))


def same_project(a: Column, b: Column) -> Column:
    """Whether two encoded project folders are one project: what follows the worktree mark names a branch."""
    return F.substring_index(a, WORKTREE_MARK, 1) == F.substring_index(b, WORKTREE_MARK, 1)


def warning_lines(warnings: DataFrame) -> DataFrame:
    """(kind, count, reference, line) of (kind, reference) warnings: each pair once; a kind with one warning names it, a kind
    with more gives their number."""
    once = warnings.select("kind", "reference").distinct().groupBy("kind").agg(F.count("*").alias("count"), F.min("reference").alias("first"))
    of = F.when(F.col("count") == 1, F.col("first"))
    line = F.when(F.col("count") == 1, F.concat_ws(" ", F.concat(F.lit("protocol agent-warning kind="), "kind"), F.concat(F.lit("ref="), of))).otherwise(F.concat(F.lit("protocol agent-warning kind="), "kind", F.lit(" count="), F.col("count")))
    return once.select("kind", "count", of.alias("reference"), line.alias("line"))
