"""Tool calls and results as text: one layout for each known tool, JSON on one line for the others. All expressions: inputs are
variants, from which each layout draws what it shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYOUT = "struct<header:string,body:string>"
_TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^"{}\[\]:,]+'


def text_at(value: Column, *path: str) -> Column:
    """The string at the first path that holds one; null for other types."""
    found = []
    for p in path:
        at = F.try_variant_get(value, p, "variant")
        found.append(F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(value, p, "string")))
    return F.coalesce(*found)


def number_at(value: Column, path: str) -> Column:
    at = F.try_variant_get(value, path, "variant")
    return F.when((F.schema_of_variant(at) == "BIGINT") & (F.try_variant_get(value, path, "bigint") >= 0), F.try_variant_get(value, path, "bigint"))


def texts_at(value: Column, path: str) -> Column:
    """The strings of a list; null where there is none."""
    items = F.try_variant_get(value, path, "array<variant>")
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def _tokens(json: Column) -> Column:
    return F.regexp_extract_all(json, F.lit(_TOKEN), 0)


def compact(value: Column) -> Column:
    """JSON on one line, a space behind separators and inside braces."""
    tokens = _tokens(F.to_json(value))

    def shown(t: Column, i: Column) -> Column:
        after, before = F.get(tokens, i + 1), F.get(tokens, i - 1)
        return F.when(t == "{", F.when(after == "}", t).otherwise(F.lit("{ "))).when(t == "}", F.when((i > 0) & (before == "{"), t).otherwise(F.lit(" }"))).when(t.isin(":", ","), F.concat(t, F.lit(" "))).otherwise(t)

    return F.array_join(F.transform(tokens, shown), "")


def pretty(value: Column) -> Column:
    """JSON over lines, two spaces a level; empty objects and lists stay together."""
    tokens = _tokens(F.to_json(value))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit("").alias("last"))

    def line(depth: Column) -> Column:
        return F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))

    def step(a: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        fresh = a["last"].isin("{", "[")
        depth = a["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        before = F.when(closes, F.when(fresh, F.lit("")).otherwise(line(depth))).when(fresh | (a["last"] == ","), line(a["depth"])).otherwise(F.lit(""))
        return F.struct(F.concat(a["out"], before, F.when(t == ":", F.lit(": ")).otherwise(t)).alias("out"), depth.alias("depth"), t.alias("last"))

    return F.aggregate(tokens, start, step)["out"]


def _lines(text: Column) -> Column:
    """Lines without their ends; a last line end begins no line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(F.regexp_replace(text, r"\r?\n$", ""), r"\r\n", "\n"), "\n", -1))


def _layout(header: Column, body: Column | None = None) -> Column:
    return F.struct(header.alias("header"), (F.lit(None).cast("string") if body is None else body).alias("body"))


def _spilled(prefix: Column, text: Column) -> Column:
    """The first line behind a prefix, the others as the body."""
    lines = _lines(text)
    several = text.contains("\n") & (F.size(lines) > 1)
    return _layout(F.when(several, F.concat(prefix, F.element_at(lines, 1))).otherwise(F.concat(prefix, text)), F.when(several, F.array_join(F.slice(lines, 2, F.size(lines)), "\n")))


def _labeled(label: Column, subject: Column, body: Column) -> Column:
    return _layout(F.when(subject == "", label).otherwise(F.concat(label, F.lit(": "), subject)), F.nullif(body, F.lit("")))


def tool_call(name: Column, arguments: Column) -> Column:
    """(header, body) of a call with its arguments (JSON text); broken JSON counts as no argument at all."""
    v = F.coalesce(F.try_parse_json(arguments), F.parse_json(F.lit("{}")))
    none, blank = F.lit(None).cast("string"), F.lit("")

    def at(*keys: str) -> Column:
        return text_at(v, *[f"$.{k}" for k in keys])

    def or_blank(*keys: str) -> Column:
        return F.coalesce(at(*keys), blank)

    file = or_blank("file_path", "path")
    offset, limit = number_at(v, "$.offset"), number_at(v, "$.limit")
    read = F.concat(F.lit("Read: "), file, F.when(offset.isNotNull(), F.concat(F.lit(":"), offset.cast("string"), F.coalesce(F.concat(F.lit("-"), (offset + limit).cast("string")), blank))).otherwise(blank))
    place = F.coalesce(F.concat_ws("/", at("path"), at("glob")), blank)
    grep = F.concat(F.lit('Grep: "'), or_blank("pattern"), F.lit('" in '), F.when(at("path").isNull() & at("glob").isNull(), F.lit(".")).otherwise(place))

    def glob(label: str) -> Column:
        return _layout(F.concat(F.lit(f"{label}: "), or_blank("pattern"), F.coalesce(F.concat(F.lit(" in "), at("path")), blank)))

    edits = F.transform(F.try_variant_get(v, "$.edits", "array<variant>"), lambda e: F.struct(text_at(e, "$.oldText").alias("old"), text_at(e, "$.newText").alias("new")))
    one = F.array(F.struct(at("old_string").alias("old"), at("new_string").alias("new")))
    edits = F.filter(F.coalesce(edits, one), lambda e: e["old"].isNotNull() & e["new"].isNotNull())
    diff = F.flatten(F.transform(edits, lambda e: F.concat(F.transform(_lines(e["old"]), lambda x: F.concat(F.lit("- "), x)), F.transform(_lines(e["new"]), lambda x: F.concat(F.lit("+ "), x)))))
    urls, queries = texts_at(v, "$.urls"), texts_at(v, "$.queries")
    asked = F.coalesce(queries, F.array(or_blank("query")))
    action = F.rtrim(F.concat(F.lit("Process "), or_blank("action")))
    subject = F.coalesce(F.nullif(or_blank("name"), blank), or_blank("id"))
    layouts = [
        (["Task"], _layout(F.concat(F.lit("Task ("), F.coalesce(at("subagent_type"), F.lit("agent")), F.lit("): "), or_blank("description")), at("prompt"))),
        (["Bash", "bash"], _spilled(F.lit("Bash: "), or_blank("command"))),
        (["Read", "read"], _layout(read)),
        (["Grep", "grep"], _layout(grep)),
        (["Glob"], glob("Glob")),
        (["find"], glob("Find")),
        (["Edit", "edit"], _layout(F.concat(F.lit("Edit: "), file), F.when(F.size(edits) > 0, F.array_join(diff, "\n")))),
        (["Write", "write"], _layout(F.concat(F.lit("Write: "), file))),
        (["WebFetch", "fetch_content"], _layout(F.concat(F.lit("Fetch: "), F.coalesce(F.array_join(urls, ", "), or_blank("url"))), at("prompt"))),
        (["WebSearch", "web_search"], _layout(F.concat(F.lit("Search: "), F.array_join(F.transform(asked, lambda q: F.concat(F.lit('"'), q, F.lit('"'))), ", ")))),
        (["codemode"], _spilled(F.lit("Codemode: "), or_blank("code"))),
        (["ls"], _layout(F.concat(F.lit("List: "), F.coalesce(at("path"), F.lit("."))))),
        (["suba"], _labeled(F.lit("Suba"), or_blank("name"), or_blank("task"))),
        (["suba_send"], _labeled(F.lit("Suba send"), or_blank("id"), or_blank("message"))),
        (["suba_resume"], _labeled(F.lit("Suba resume"), or_blank("id"), or_blank("task"))),
        (["suba_finish"], _labeled(F.lit("Suba finish"), or_blank("id"), or_blank("result"))),
        (["suba_list"], _labeled(F.lit("Suba list"), or_blank("status"), none)),
        (["process"], _labeled(action, subject, or_blank("command"))),
    ]
    skill = _spilled(F.lit("Skill: "), F.regexp_replace(F.concat(F.lit("/"), or_blank("skill"), F.lit(" "), or_blank("args")), r"\s+$", ""))
    rest = F.when((name == "Skill") & at("skill").isNotNull(), skill).otherwise(_spilled(F.concat(name, F.lit(": ")), compact(v)))
    return reduce(lambda other, x: F.when(name.isin(x[0]), x[1]).otherwise(other), reversed(layouts), rest)


def _unwrapped(text: Column, tag: str) -> Column:
    """What a tag wholly encloses, trimmed; null where it does not."""
    whole = text.startswith(f"<{tag}>") & text.endswith(f"</{tag}>") & (F.length(text) >= 2 * len(tag) + 5)
    return F.when(whole, F.regexp_replace(F.substring(text, len(tag) + 3, F.length(text) - 2 * len(tag) - 5), r"(?U)^\s+|\s+$", ""))


def _result_text(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    value = F.when(~bare.contains("\n") & bare.rlike(r"^[{\[]"), F.try_parse_json(bare))
    error = _unwrapped(bare, "tool_use_error")
    return F.when(error.isNotNull(), F.concat(F.lit("Error: "), error)).otherwise(F.coalesce(_unwrapped(bare, "persisted-output"), F.when(value.isNotNull(), pretty(value)), text))


def _placeholder(block: Column, kind: str) -> Column:
    address = text_at(block, "$.image_url")
    media = F.coalesce(text_at(block, "$.source.media_type", "$.media_type", "$.mimeType"), F.when(address.startswith("data:"), F.regexp_extract(address, "^data:([^;,]*)", 1)))
    return F.concat(F.lit(f"[{kind}"), F.coalesce(F.concat(F.lit(": "), media), F.lit("")), F.lit("]"))


def _block(block: Column) -> Column:
    kind, text = text_at(block, "$.type"), text_at(block, "$.text")
    return (
        F.when(kind.isin("text", "input_text", "output_text"), F.coalesce(_result_text(text), F.lit("")))
        .when(kind.isin("image", "input_image"), _placeholder(block, "image"))
        .when(kind == "document", _placeholder(block, "document"))
        .when(kind == "tool_reference", F.concat(F.lit("Loaded tool: "), F.coalesce(text_at(block, "$.tool_name"), F.lit("?"))))
        .otherwise(F.coalesce(_result_text(text), compact(block)))
    )


def tool_result(content: Column) -> Column:
    """A result's content (JSON text: a string, blocks, or any value) as text: blocks as their text or a mark of their kind,
    errors without their tags, other JSON over lines; null content says so."""
    v = F.try_parse_json(content)
    text = text_at(v, "$")
    blocks = F.try_variant_get(v, "$", "array<variant>")
    typed = blocks.isNotNull() & F.forall(blocks, lambda b: text_at(b, "$.type").isNotNull())
    return F.when(v.isNull() | F.is_variant_null(v), F.lit("<no content>")).when(text.isNotNull(), _result_text(text)).when(typed, F.array_join(F.transform(blocks, _block), "\n\n")).otherwise(pretty(v))
