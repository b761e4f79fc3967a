"""What a person typed in a user message, and what a tool wrote there: column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import stripped

# Fixed values of the log formats.
CAVEAT = "Caveat: The messages below were generated by the user while running local commands."
SKILL_BASE = "Base directory for this skill:"
GENERATED_PREFIXES = [
    "[Request interrupted by user",
    "This session is being continued from a previous conversation",
    "Compaction completed. Continue.",
    "Stop hook feedback:",
    "[SUGGESTION MODE:",
]
INSERTED_TAGS = ["system-reminder", "task-notification", "local-command-stdout", "local-command-stderr", "bash-stdout", "bash-stderr"]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_boilerplate(text: Column) -> Column:
    """Blank text, output and caveats of local commands, the clear command, commands without a slash, skill headers."""
    t = stripped(text)
    held = ["<local-command-caveat>", "<command-name>/clear</command-name>", "<command-message>clear</command-message>", "<local-command-stdout>"]
    unnamed = t.contains("<command-name>") & ~t.contains("<command-name>/")
    return _any([t == "", t.startswith(CAVEAT), t.startswith(SKILL_BASE), unnamed, *[t.contains(h) for h in held]])


def command_line(text: Column) -> Column:
    """``/name args`` of a slash command or of a skill written out in the message; null for other text."""
    name, args = F.regexp_extract(text, "(?s)<command-name>(.*?)</command-name>", 1), stripped(F.regexp_extract(text, "(?s)<command-args>(.*?)</command-args>", 1))
    written = F.regexp_like(text, F.lit('(?s)^<skill name="[^"]*".*?</skill>'))
    skill, rest = (F.regexp_extract(text, '(?s)^<skill name="([^"]*)".*?</skill>(.*)$', k) for k in (1, 2))
    slash = F.when(name.startswith("/") & (name != "/clear"), F.trim(F.concat_ws(" ", name, args)))
    return F.coalesce(slash, F.when(written, F.trim(F.concat(F.lit("/"), skill, F.lit(" "), stripped(rest)))))


def typed_text(text: Column) -> Column:
    """The words of the person; null where a tool wrote the message. Inserted spans and image marks go; an open tag without
    its end was typed and stays; a spoken request gives its input alone."""
    t = stripped(text)
    kept = t
    for tag in INSERTED_TAGS:
        kept = F.regexp_replace(kept, f"(?s)<{tag}>.*?</{tag}>", "")
    kept = stripped(F.regexp_replace(F.regexp_replace(kept, r"\[Image(?:\]| #[0-9]+\]|:[^\]\n]*\])", ""), "</?bash-input>", ""))
    spoken = stripped(F.regexp_extract(t, "(?s)<input>(.*?)</input>", 1))
    own = F.when(t.startswith("<realtime_delegation>"), spoken).otherwise(F.coalesce(command_line(t), kept))
    return F.when(~is_boilerplate(t) & ~_any([t.startswith(p) for p in GENERATED_PREFIXES]) & (own != ""), own)


def clear_only(user_messages: DataFrame) -> DataFrame:
    """(key, clear_only) of user messages (key, text): nothing but a caveat, a clear command and its output, all three seen."""
    t = stripped(F.col("text"))
    caveat, command, output = t.startswith(CAVEAT), t.contains("<command-name>/clear</command-name>"), t.contains("<local-command-stdout>")
    only = F.bool_and((t == "") | caveat | command | output) & F.bool_or(caveat) & F.bool_or(command) & F.bool_or(output)
    return user_messages.where("text is not null").groupBy("key").agg(only.alias("clear_only"))
