"""Rollout files: how a thread ran, whose child it is, which file is its head, what it goes on from, where it forks off."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ENTRY = "struct<part:int,kind:string,text:string>"


def mode(meta: Column) -> Column:
    """interactive, automated or unknown, by the source that a head (JSON) names; a head without one is a person's."""
    source = F.coalesce(F.get_json_object(meta, "$.source"), F.lit("vscode"))
    return F.when(source.isin("cli", "vscode"), "interactive").when(source.isin("exec", "mcp"), "automated").otherwise("unknown")


def parent(meta: Column) -> Column:
    """The thread that a head (JSON) is a child of: the one that spawned it, else the parent it names; empty for a subagent
    of an unnamed thread, null for a thread of its own."""
    subagent = F.array_contains(F.json_object_keys(F.get_json_object(meta, "$.source")), "subagent")
    named = [F.get_json_object(meta, p) for p in ("$.source.subagent.thread_spawn.parent_thread_id", "$.parent_thread_id")]
    return F.coalesce(*named, F.when(subagent, F.lit("")))


def last_activity(messages: DataFrame) -> DataFrame:
    """(key, last) of messages (key, ts, inherited): the newest of a thread's own messages, of those taken over from its base
    where it has none with a time."""
    newest = [F.max(F.when(F.col("inherited") == taken, F.col("ts"))) for taken in (False, True)]
    return messages.groupBy("key").agg(F.coalesce(*newest).alias("last"))


#: Links of a chain at most, and what a first record may hold in bytes to be read (fixed values).
MOST_LINKS, FIRST_RECORD = 16, 4 << 20
FORK_LABEL, FORK_TEXT = "Fork", "The conversation continues from here"


def base(first: Column) -> Column:
    """(rollout_id, end) of the rollout that a first record (JSON) goes on from; null where it names none."""
    named = F.get_json_object(first, "$.payload.history_base.thread_id")
    end = F.get_json_object(first, "$.payload.history_base.end_byte_offset").try_cast("long")
    told = (F.octet_length(first) <= FIRST_RECORD) & named.isNotNull() & end.isNotNull()
    return F.when(told, F.struct(F.lower(named).alias("rollout_id"), end.alias("end")))


def name_of(path: Column) -> Column:
    """The file name that tells a rollout wherever it lies: without the ending of a compressed copy."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.zst$", "")


def listed_once(rollouts: DataFrame) -> DataFrame:
    """Of rollouts listed under one file name (one may be on its way to the archive) the live one, then by id and path."""
    order = [F.col(c).alias(f"o{k}") for k, c in enumerate(("archived", "rollout_id", "path"))]
    rows = rollouts.withColumn("name", name_of(F.col("path")))
    first = rows.groupBy("name").agg(F.min_by(F.struct(*rollouts.columns), F.struct(*order)).alias("r"))
    return first.select("name", "r.*")


def heads(rollouts: DataFrame, rows: DataFrame) -> DataFrame:
    """(thread_id, rollout_id, path, archived, status) of each thread of ``rollouts`` (path, thread_id, rollout_id, archived,
    size, base), whose unreadable files have no size. A row of ``rows`` (thread_id, rollout_path, paginated) names the head:
    current if it is there, else the newest rollout of a paginated thread, orphaned; without either the newest that no other
    of the thread goes on from, else the newest, inferred. Everything is an aggregate by thread."""
    known = listed_once(rollouts).where("size is not null")
    told = rows.select("thread_id", name_of(F.col("rollout_path")).alias("named"), "paginated")
    on = known.where("base is not null").select("thread_id", F.col("base.rollout_id").alias("rollout_id")).distinct().withColumn("continued", F.lit(True))
    all_ = known.join(on, ["thread_id", "rollout_id"], "left").join(told, "thread_id", "left").na.fill(False, ["continued"])
    newest = F.struct("rollout_id", "archived", "path")

    def of(condition: Column) -> Column:
        return F.max_by(F.struct("rollout_id", "path", "archived"), F.when(condition, newest))

    picked = all_.groupBy("thread_id").agg(of(F.col("name") == F.col("named")).alias("current"), of(F.lit(True)).alias("any"), of(~F.col("continued")).alias("open"), F.count("*").alias("n"), F.bool_or(F.coalesce("paginated", F.lit(False))).alias("paginated"))
    orphaned = F.col("current").isNull() & F.col("paginated")
    status = F.when(F.col("current").isNotNull(), "current").when(orphaned, "orphaned").otherwise("inferred")
    chosen = F.coalesce("current", F.when(orphaned | (F.col("n") == 1), F.col("any")), "open", "any")
    return picked.select("thread_id", chosen.alias("h"), status.alias("status")).select("thread_id", "h.rollout_id", "h.path", "h.archived", "status")


def chains(heads_: DataFrame, rollouts: DataFrame) -> DataFrame:
    """(thread_id, place, rollout_id, path, end, inherited, missing) of the files that a thread is read from, oldest first: the
    head, the rollout that it goes on from up to an end in bytes, and so on. A chain ends where a rollout has no base, its
    base is not there (``missing`` names it, on the head), a rollout would come twice, or after 16 links. Each step joins
    the chains that still go on, and is cut with a checkpoint."""
    held = listed_once(rollouts)
    order = F.struct("archived", "rollout_id", "path")
    by_id = held.groupBy("rollout_id").agg(F.min_by(F.struct("path", "thread_id", "size", "base"), order).alias("r"))
    by_id = by_id.select("rollout_id", "r.*")
    own = held.select("path", F.col("base").alias("next"))
    link = F.struct("rollout_id", "path", F.lit(None).cast("long").alias("end"), F.lit(False).alias("inherited"))
    going = heads_.join(own, "path").select("thread_id", F.array(link).alias("links"), "next", F.lit(None).cast("string").alias("missing"))
    done = []
    for _ in range(MOST_LINKS - 1):
        done.append(going.where("next is null"))
        met = going.where("next is not null").join(by_id.select(F.col("rollout_id").alias("found"), F.col("path").alias("f_path"), F.col("thread_id").alias("f_thread"), "size", F.col("base").alias("f_base")), F.col("next.rollout_id") == F.col("found"), "left")
        there = F.col("size").isNotNull()
        again = F.coalesce(F.exists("links", lambda x: x["path"] == F.col("f_path")), F.lit(False))
        added = F.struct(F.col("found").alias("rollout_id"), F.col("f_path").alias("path"), F.col("next.end").alias("end"), (F.col("f_thread") != F.col("thread_id")).alias("inherited"))
        going = met.select("thread_id", F.when(there & ~again, F.concat("links", F.array(added))).otherwise(F.col("links")).alias("links"), F.when(there & ~again, F.col("f_base")).alias("next"), F.when(~there, F.col("next.rollout_id")).alias("missing")).checkpoint()
        if going.where("next is not null").isEmpty():
            break
    all_ = reduce(DataFrame.unionByName, [*done, going])
    rows = all_.select("thread_id", "missing", F.posexplode(F.reverse("links")).alias("place", "x"), F.size("links").alias("n"))
    return rows.select("thread_id", "place", "x.*", F.when(F.col("place") == F.col("n") - 1, F.col("missing")).alias("missing"))


def thread_lines(lines: DataFrame, chain: DataFrame) -> DataFrame:
    """The lines (path, line, offset, value) that each thread is read from, with thread_id, place and inherited: those of a
    base that begin before its end."""
    rows = lines.join(chain.select("thread_id", "place", "path", "end", "inherited"), "path")
    return rows.where(F.col("end").isNull() | (F.col("offset") < F.col("end"))).drop("end")


def entries(events: DataFrame) -> DataFrame:
    """What a reader of (thread_id, place, line, visibility, inherited, kind, text) sees: dialogue, and what was taken over from
    a base; where it goes over from a base to the thread's own, a note of the fork comes first. Titles and bookkeeping
    count for the boundary and are not shown. ``at`` orders a thread's entries: place, line, and the note before its line."""
    shown = events.where((F.col("visibility") == "dialogue") | ((F.col("visibility") == "inherited") & F.col("inherited")))
    order = Window.partitionBy("thread_id").orderBy("place", "line")
    rows = shown.withColumn("forks", F.coalesce(F.lag("inherited").over(order), F.lit(False)) & ~F.col("inherited"))
    own = F.struct(F.lit(1).alias("part"), F.col("kind").alias("kind"), F.col("text").alias("text"))
    note = F.struct(F.lit(0).alias("part"), F.lit("note").alias("kind"), F.lit(f"{FORK_LABEL}: {FORK_TEXT}").alias("text"))
    made = F.concat(F.when(F.col("forks"), F.array(note)).otherwise(F.array().cast(f"array<{_ENTRY}>")), F.when(F.col("kind").isin("title", "other"), F.array().cast(f"array<{_ENTRY}>")).otherwise(F.array(own)))
    return rows.select("thread_id", "place", "line", F.explode(made).alias("e")).select("thread_id", F.struct("place", "line", F.col("e.part").alias("part")).alias("at"), "e.kind", "e.text")
