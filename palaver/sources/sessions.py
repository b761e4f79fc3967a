"""Session logs as DataFrames: three JSONL formats into one event model.

* ``flat``: a record a line, typed user, assistant, system, summary, title; content is a string or typed blocks;
* ``tree``: a header, then entries with parent ids; the branch that ends in the last record counts;
* ``rollout``: records in an envelope of time, type and payload, with running token totals.

Lines keep their number, so every window below has an order. Unknown record types are kept as ``other``; a line that is
no JSON object is a row of ``malformed`` and fails nothing. Payloads stay JSON text; columns are drawn from them by path.
Events: path, line, ts, kind, role, message_id, model, text, tools (id, name, input), results (id, output), usage, raw.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,toolCallId:string,arguments:string,mimeType:string>>"
USAGE = "struct<input:bigint,output:bigint,cache_write:bigint,cache_read:bigint>"
COLUMNS = ["path", "line", "ts", "kind", "role", "message_id", "model", "text", "tools", "results", "usage", "raw"]


def files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, size, mtime of the session files below a root, without internal helpers."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def placed_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, line (from 1), offset (its first byte), value of every line. Files are read by splits: a split's lines have
    consecutive numbers, and counts and bytes of the splits before it (a row a split) give each line its place, so a file of
    any size is work of many tasks."""
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    bytes_ = F.octet_length("value") + 1
    splits = rows.groupBy("path", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"), F.sum(bytes_).alias("bytes"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "block", "first", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "bytes")])
    within = Window.partitionBy("path", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_split", F.coalesce(F.sum(bytes_).over(within), F.lit(0))).join(splits, ["path", "block"])
    return rows.select("path", (F.col("n") - F.col("first") + F.col("lines_before") + 1).cast("int").alias("line"), (F.col("bytes_before") + F.col("in_split")).alias("offset"), "value")


def lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, line (from 1), value of every non-blank line."""
    return placed_lines(spark, root, pattern).select("path", "line", F.trim("value").alias("value")).where("value <> ''")


def compressed_lines(spark: SparkSession, root: str) -> DataFrame:
    """The same of zstd-compressed files, decompressed as a stream in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import zstandard

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zstandard.ZstdDecompressor().stream_reader(data) as r:
                    rows = [(i, x.strip()) for i, x in enumerate(io.TextIOWrapper(r, "utf-8", errors="replace"), 1) if x.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.string())], ["path", "line", "value"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl.zst").option("recursiveFileLookup", "true").load(root)
    return found.select("path", "content").mapInArrow(run, "path string, line int, value string")


def _at(path: str, of: str = "value") -> Column:
    return F.get_json_object(of, path)


def malformed(rows: DataFrame, context: int = 2) -> DataFrame:
    """Lines that are no JSON object, with the lines around them."""
    by = Window.partitionBy("path").orderBy("line")
    bad = F.try_parse_json("value").isNull() | ~F.col("value").startswith("{")
    around = rows.withColumn("bad", bad).withColumn("before", F.collect_list("value").over(by.rowsBetween(-context, -1))).withColumn("after", F.collect_list("value").over(by.rowsBetween(1, context)))
    return around.where("bad").select("path", "line", "value", "before", "after")


def _valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("value").startswith("{") & F.try_parse_json("value").isNotNull())


def _blocks(content: Column) -> Column:
    return F.when(F.ltrim(content).startswith("["), F.from_json(content, BLOCKS))


def _text(content: Column) -> Column:
    """Text blocks joined; images as a mark; plain strings as they are."""
    parts = F.transform(F.filter(_blocks(content), lambda b: b["type"].isin("text", "input_text", "output_text", "image")), lambda b: F.when(b["type"] == "image", F.concat(F.lit("[Image: "), F.coalesce(b["mimeType"], F.lit("image")), F.lit("]"))).otherwise(b["text"]))
    return F.when(F.ltrim(content).startswith("["), F.array_join(parts, "\n")).otherwise(content)


def _tools(content: Column) -> Column:
    calls = F.filter(_blocks(content), lambda b: b["type"].isin("tool_use", "toolCall"))
    return F.coalesce(F.transform(calls, lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), F.coalesce(b["input"], b["arguments"]).alias("input"))), F.array().cast("array<struct<id:string,name:string,input:string>>"))


def _results(content: Column) -> Column:
    got = F.filter(_blocks(content), lambda b: b["type"] == "tool_result")
    return F.coalesce(F.transform(got, lambda b: F.struct(b["tool_use_id"].alias("id"), b["content"].alias("output"))), F.array().cast("array<struct<id:string,output:string>>"))


def _usage(root: str, names: tuple[str, str, str, str]) -> Column:
    values = [F.coalesce(_at(f"{root}.{n}").cast("bigint"), F.lit(0).cast("bigint")) for n in names]
    return F.when(_at(root).isNotNull(), F.struct(*[v.alias(k) for v, k in zip(values, ("input", "output", "cache_write", "cache_read"), strict=True)]))


def flat_events(rows: DataFrame) -> DataFrame:
    """Events of the flat format."""
    rows = _valid(rows).withColumn("type", _at("$.type")).withColumn("content", _at("$.message.content"))
    talk = F.col("type").isin("user", "assistant")
    title = F.coalesce(_at("$.customTitle"), _at("$.aiTitle"), _at("$.summary"))
    kind = F.when(talk, "message").when(F.col("type").isin("custom-title", "ai-title", "summary"), "title").when(F.col("type") == "progress", "subagent").otherwise("other")
    return rows.select(
        "path", "line", F.try_to_timestamp(_at("$.timestamp")).alias("ts"), kind.alias("kind"), F.when(talk, F.col("type")).alias("role"),
        _at("$.message.id").alias("message_id"), _at("$.message.model").alias("model"),
        F.when(talk, _text(F.col("content"))).when(kind == "title", title).when(kind == "subagent", _text(_at("$.data.message.message.content"))).alias("text"),
        _tools(F.col("content")).alias("tools"), _results(F.col("content")).alias("results"),
        _usage("$.message.usage", ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")).alias("usage"), F.col("value").alias("raw"),
    )


def generated_user(raw: Column) -> Column:
    """Whether a user record was generated: true, false, or null where nothing says so."""
    origin, turn = F.get_json_object(raw, "$.origin.kind"), F.get_json_object(raw, "$.turnOrigin")
    return F.when(F.get_json_object(raw, "$.isCompactSummary") == "true", True).when(origin == "human", False).when(origin.isNotNull() | turn.isNotNull(), origin.isin("task-notification", "peer", "channel", "coordinator")).otherwise(F.lit(None).cast("boolean"))


def active_branch(entries: DataFrame) -> DataFrame:
    """Of (path, line, id, parent): the rows from the root to the last record of each file; a cycle ends the walk. A fold
    of ids by file, without payloads."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        at = {i: k for k, i in enumerate(pdf["id"])}
        ids, parents, numbers = list(pdf["id"]), list(pdf["parent"]), list(pdf["line"])
        seen, chain, k = set(), [], len(ids) - 1
        while k is not None and k >= 0 and ids[k] not in seen:
            seen.add(ids[k])
            chain.append(numbers[k])
            k = at.get(parents[k]) if isinstance(parents[k], str) else None
        return pd.DataFrame({"path": pdf["path"].iloc[0], "line": chain})

    return entries.select("path", "line", "id", "parent").groupBy("path").applyInPandas(walk, "path string, line int")


def tree_events(rows: DataFrame) -> DataFrame:
    """Events of the tree format on the active branch. Version 1 is a list; later versions name their parent."""
    rows = _valid(rows).withColumn("type", _at("$.type"))
    head = rows.where(F.col("type") == "session").groupBy("path").agg(F.min("line").alias("head"), F.min_by(F.coalesce(_at("$.version").cast("int"), F.lit(1)), "line").alias("version"))
    rows = rows.join(head, "path")
    titles = rows.where((F.col("line") == 1) & (F.col("type") == "title") & (F.coalesce(_at("$.title"), F.lit("")) != ""))
    body = rows.where("line > head")
    by = Window.partitionBy("path").orderBy("line")
    own = F.when(F.col("version") == 1, F.concat(F.lit("v1-"), F.col("line"))).otherwise(_at("$.id"))
    body = body.withColumn("id", own).where("id <> ''").withColumn("parent", F.when(F.col("version") == 1, F.lag("id").over(by)).otherwise(_at("$.parentId")))
    kept = body.join(active_branch(body), ["path", "line"])
    role, content = _at("$.message.role"), _at("$.message.content")
    shell = F.concat(F.lit("$ "), _at("$.message.command"), F.lit("\n"), F.coalesce(_at("$.message.output"), F.lit("")), F.when(_at("$.message.exitCode").cast("int") != 0, F.concat(F.lit("\n[exit code "), _at("$.message.exitCode"), F.lit("]"))).otherwise(F.lit("")))
    hidden = (F.col("type") == "custom_message") & (F.coalesce(_at("$.display"), F.lit("true")) == "false")
    kind = F.when(hidden, "other").when(F.col("type").isin("message", "custom_message"), "message").when(F.col("type").isin("compaction", "branch_summary", "model_change"), "note").when(F.col("type").isin("session_info", "title_change"), "title").otherwise("other")
    text = F.when(kind == "other", F.lit(None)).when(role == "bashExecution", shell).when(role == "toolResult", F.concat(F.when(_at("$.message.isError") == "true", "Error: ").otherwise(""), F.coalesce(_text(content), F.lit("")))).when(F.col("type") == "message", _text(content))
    text = text.otherwise(F.coalesce(_text(_at("$.content")), _at("$.summary"), _at("$.name"), _at("$.title"), _at("$.modelId"), _at("$.model")))
    ts = F.coalesce(F.try_to_timestamp(_at("$.timestamp")), F.timestamp_millis(_at("$.message.timestamp").cast("bigint")))
    events = kept.select(
        "path", "line", ts.alias("ts"), kind.alias("kind"), F.when(role == "assistant", "assistant").when(kind == "message", "user").alias("role"), F.lit(None).cast("string").alias("message_id"), _at("$.message.model").alias("model"),
        text.alias("text"), _tools(content).alias("tools"), F.when(role == "toolResult", F.array(F.struct(_at("$.message.toolCallId").alias("id"), _text(content).alias("output")))).otherwise(F.array().cast("array<struct<id:string,output:string>>")).alias("results"),
        _usage("$.message.usage", ("input", "output", "cacheWrite", "cacheRead")).alias("usage"), F.col("value").alias("raw"),
    )
    none = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("ts",)]
    slot = titles.select("path", "line", *none, F.lit("title").alias("kind"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("role", "message_id", "model")], _at("$.title").alias("text"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("tools", "results", "usage")], F.col("value").alias("raw"))
    return events.unionByName(slot)


def rollout_events(rows: DataFrame) -> DataFrame:
    """Events of the rollout format; running token totals become the tokens since the last total (a smaller total starts
    anew), input without what the cache gave."""
    rows = _valid(rows).withColumn("type", _at("$.type")).withColumn("sub", _at("$.payload.type"))
    talk = (F.col("type") == "event_msg") & F.col("sub").isin("user_message", "agent_message")
    call = (F.col("type") == "response_item") & F.col("sub").isin("function_call", "custom_tool_call", "local_shell_call")
    output = (F.col("type") == "response_item") & F.col("sub").endswith("_output")
    by = Window.partitionBy("path").orderBy("line")
    counted = (F.col("type") == "event_msg") & (F.col("sub") == "token_count")
    rows = rows.withColumn("model", F.last(F.when(F.col("type") == "turn_context", _at("$.payload.model")), ignorenulls=True).over(by))
    total = "$.payload.info.total_token_usage"
    names = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cached_input_tokens"}
    for k, n in names.items():
        rows = rows.withColumn(f"t_{k}", F.when(counted, F.coalesce(_at(f"{total}.{n}").cast("bigint"), F.lit(0).cast("bigint"))))
    rows = rows.withColumn("t_all", F.col("t_input") + F.col("t_output"))
    past = {k: F.last(f"t_{k}", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)) for k in (*names, "all")}
    rows = rows.withColumns({f"p_{k}": c for k, c in past.items()})
    fresh = F.col("p_all").isNull() | (F.col("t_all") < F.col("p_all"))
    since = {k: F.when(fresh, F.col(f"t_{k}")).otherwise(F.greatest(F.col(f"t_{k}") - F.col(f"p_{k}"), F.lit(0).cast("bigint"))) for k in names}
    usage = F.when(counted, F.struct(F.greatest(since["input"] - since["cache_read"], F.lit(0).cast("bigint")).alias("input"), since["output"].alias("output"), F.lit(0).cast("bigint").alias("cache_write"), since["cache_read"].alias("cache_read")))
    name = F.coalesce(F.concat(_at("$.payload.namespace"), F.lit("__"), _at("$.payload.name")), _at("$.payload.name"), F.col("sub"))
    kind = F.when(talk | call | output, "message").when(F.col("type") == "compacted", "note").when(counted, "usage").when(F.col("type") == "session_meta", "meta").otherwise("other")
    role = F.when(talk & (F.col("sub") == "user_message"), "user").when(output, "user").when(talk | call, "assistant")
    return rows.select(
        "path", "line", F.try_to_timestamp(_at("$.timestamp")).alias("ts"), kind.alias("kind"), role.alias("role"), F.lit(None).cast("string").alias("message_id"), "model",
        F.when(talk, _at("$.payload.message")).when(F.col("type") == "compacted", _at("$.payload.message")).alias("text"),
        F.when(call, F.array(F.struct(_at("$.payload.call_id").alias("id"), name.alias("name"), F.coalesce(_at("$.payload.arguments"), _at("$.payload.input"), _at("$.payload.action")).alias("input")))).otherwise(F.array().cast("array<struct<id:string,name:string,input:string>>")).alias("tools"),
        F.when(output, F.array(F.struct(_at("$.payload.call_id").alias("id"), _at("$.payload.output").alias("output")))).otherwise(F.array().cast("array<struct<id:string,output:string>>")).alias("results"),
        usage.alias("usage"), F.col("value").alias("raw"),
    )


def detect(rows: DataFrame) -> DataFrame:
    """(path, format) by the leading records of each file."""
    first = rows.groupBy("path").agg(F.min_by("value", "line").alias("value"), F.collect_set(F.when(F.col("line") <= 2, F.get_json_object("value", "$.type"))).alias("types"))
    return first.select("path", F.when(_at("$.payload").isNotNull() & _at("$.type").isin("session_meta", "turn_context", "event_msg", "response_item"), "rollout").when(F.array_contains("types", "session"), "tree").otherwise("flat").alias("format"))


def events(rows: DataFrame) -> DataFrame:
    """Events of files of any format, each decoded by what its head says."""
    named = rows.join(detect(rows), "path")
    parts = [decode(named.where(F.col("format") == f).drop("format")).select(*COLUMNS) for f, decode in (("flat", flat_events), ("tree", tree_events), ("rollout", rollout_events))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def last_names(index: DataFrame) -> DataFrame:
    """Of (thread_id, line, name): the last name of each thread; an empty last name removes it."""
    return index.groupBy("thread_id").agg(F.max_by("name", "line").alias("name")).where("name <> ''")


def thread_of(path: Column) -> Column:
    """Thread id in the name of a rollout file."""
    return F.regexp_extract(path, r"rollout-[0-9T:-]+?-([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1)


# Fixed values of the file names and of the scan.
AGENT_PREFIX, INTERNAL_AGENTS, UNSETTLED_SECONDS, HOT_HOURS = "agent-", ["aprompt_suggestion-", "acompact-"], 2, 24


def file_kind(path: Column) -> Column:
    """session, agent (a subagent's file), internal (an agent of the tool itself) or other, by the file's name."""
    name = F.element_at(F.split(path, "/"), -1)
    internal = F.regexp_like(name, F.lit(f"^{AGENT_PREFIX}(?:{'|'.join(INTERNAL_AGENTS)})"))
    return F.when(~name.endswith(".jsonl"), "other").when(internal, "internal").when(name.startswith(AGENT_PREFIX), "agent").otherwise("session")


def settled(mtime: Column, scan_start: Column) -> Column:
    """A modification time that can be trusted: null within two seconds of the scan, as more may be written in that tick."""
    return F.when(mtime <= scan_start - F.expr(f"INTERVAL {UNSETTLED_SECONDS} SECONDS"), mtime)


def hot(found: DataFrame, now: Column) -> DataFrame:
    """Files written in the last day: those that a quick pass looks at."""
    return found.where(F.col("mtime") >= now - F.expr(f"INTERVAL {HOT_HOURS} HOURS"))


def one_per_file(found: DataFrame) -> DataFrame:
    """Of (path, file_id, root, source), files that several roots list: the first root's row and the other sources in ``also``.
    Files without an id are told apart by path."""
    own = F.coalesce(F.concat(F.lit("id "), "file_id"), F.concat(F.lit("path "), "path"))
    rows = found.groupBy(own.alias("own")).agg(F.min(F.struct("root", "path", "source")).alias("at"), F.collect_set("source").alias("all"))
    return rows.select("at.path", "at.root", "at.source", F.array_sort(F.array_remove("all", F.col("at.source"))).alias("also"))
