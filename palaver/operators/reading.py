"""Reading parts of conversations within a budget of characters: which messages are shown, and how what is cut is told.

Selection starts at the focus (else at the first message) and takes the neighbour before it and the one behind it in turn; a
side ends at the first message that does not fit, and the other goes on. As every message takes a least number of
characters, a budget bounds how many neighbours of a side can matter: only those are ranked, however long a conversation is.
Rendering is a fold over what was selected, a page, in an Arrow function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the output.
_PROTOCOL = "protocol agent-read cut={} budget-chars={}\n"
_LEAST_RECORD = len("message m1 role=user line=1 anchor=\n|\n")


def escaped(text: str) -> str:
    """Bytes other than letters, digits and . _ ~ : / + - as % and two hex digits."""
    return "".join(chr(b) if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "._~:/+-") else f"%{b:02X}" for b in text.encode())


def framed(body: Column) -> Column:
    """Each line behind a bar."""
    return F.concat(F.array_join(F.transform(F.split(body, "\n", -1), lambda x: F.when(x == "", F.lit("|")).otherwise(F.concat(F.lit("| "), x))), "\n"), F.lit("\n"))


def heading(anchored: Column) -> Column:
    """The first line of a message's record."""
    return F.concat(F.lit("message m"), F.col("ordinal").cast("string"), F.lit(" role="), F.col("role"), F.lit(" line="), F.col("line").cast("string"), F.lit(" anchor="), anchored, F.lit("\n"))


def asked_messages(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """The rows (key, ordinal, role, line, anchor, body) that each of ``requests`` (req, key, first, last, focus_first, focus_last)
    asks for, with their heading and size; a null first or last is the conversation's end."""
    rows = messages.join(requests, "key").where((F.col("ordinal") >= F.coalesce("first", "ordinal")) & (F.col("ordinal") <= F.coalesce("last", "ordinal")))
    rows = rows.withColumn("heading", heading(F.col("anchor")))
    return rows.withColumn("chars", F.length("heading") + F.length(framed(F.col("body"))))


def selected(rows: DataFrame, conversation_chars: Column, budget: int) -> DataFrame:
    """(req, ordinal, protected, taken): the messages around each request's focus, up to the first on either side that does not
    fit, with whether they are taken; all of a request where all fit. ``rows`` are those of ``asked_messages``;
    ``conversation_chars`` is what a conversation's own line takes."""
    whole, cut = (len(_PROTOCOL.format(c, budget)) for c in ("none", "head+focus+tail"))
    inside = (F.col("ordinal") >= F.col("focus_first")) & (F.col("ordinal") <= F.col("focus_last"))
    told = rows.withColumn("line_chars", conversation_chars)
    size = told.groupBy("req").agg(F.sum("chars").alias("total"), F.min("ordinal").alias("least"), F.count_if(inside).alias("met"), F.max("line_chars").alias("line_chars"))
    size = size.withColumn("fits", F.col("total") + F.col("line_chars") + whole <= budget)
    slim = rows.select("req", "ordinal", "chars", F.coalesce(inside, F.lit(False)).alias("protected")).join(size, "req")
    focus = F.when(F.col("met") > 0, F.col("protected")).otherwise(F.col("ordinal") == F.col("least"))
    slim = slim.withColumn("focus", focus)
    bounds = slim.where("focus").groupBy("req").agg(F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), (F.sum("chars") + F.max("line_chars") + cut).alias("base"))
    every = slim.where("fits").select("req", "ordinal", "protected", F.lit(True).alias("taken"))
    centre = slim.where("not fits and focus").select("req", "ordinal", "protected", F.lit(True).alias("taken"))

    # as many neighbours of a side as could fit, and one more
    most = max(0, budget) // _LEAST_RECORD + 1
    sides = slim.where("not fits and not focus").select("req", "ordinal", "chars", "protected").join(bounds, "req")
    after = F.col("ordinal") > F.col("high")
    sides = sides.withColumns({"after": after, "far": F.when(after, F.col("ordinal") - F.col("high")).otherwise(F.col("low") - F.col("ordinal"))})
    sides = sides.withColumn("rank", F.row_number().over(Window.partitionBy("req", "after").orderBy("far"))).where(F.col("rank") <= most)
    sides = sides.withColumn("turn", F.col("rank") * 2 + F.col("after").cast("int"))
    by = Window.partitionBy("req").orderBy("turn")
    run = F.col("base") + F.sum("chars").over(by)
    sides = sides.withColumn("run", run)
    stop = F.min(F.when(F.col("run") > budget, F.struct("turn", "after", (F.col("run") - F.col("chars")).alias("held")))).over(Window.partitionBy("req"))
    sides = sides.withColumn("stop", stop)
    later = (F.col("turn") > F.col("stop.turn")) & (F.col("after") != F.col("stop.after"))
    more = F.sum(F.when(later, F.col("chars")).otherwise(0)).over(by)
    sides = sides.withColumn("more", more)
    taken = F.col("stop").isNull() | (F.col("turn") < F.col("stop.turn")) | (later & (F.col("stop.held") + F.col("more") <= budget))
    return every.unionByName(centre).unionByName(sides.select("req", "ordinal", "protected", F.coalesce(taken, F.lit(False)).alias("taken")))


def ranges_of(ordinals: DataFrame) -> DataFrame:
    """(req, first, last) of runs of consecutive (req, ordinal). Where a run begins and ends is told by joins on neighbours, so
    no task holds a whole conversation; only the ends are put in order."""
    near = lambda d: ordinals.select("req", (F.col("ordinal") + d).alias("ordinal"))
    begins, ends = (ordinals.join(near(d), ["req", "ordinal"], "left_anti") for d in (1, -1))
    by = Window.partitionBy("req").orderBy("ordinal")
    return begins.withColumn("n", F.row_number().over(by)).withColumnRenamed("ordinal", "first").join(ends.withColumn("n", F.row_number().over(by)).withColumnRenamed("ordinal", "last"), ["req", "n"]).select("req", "first", "last")


# -- rendering a page -------------------------------------------------------------------------------------------------
def framed_length(body: str) -> int:
    return sum(len(x) + 3 if x else 2 for x in body.split("\n"))


def trimmed(body: str, available: int) -> str:
    """The longest start of a body that fits with a note of what is left out; the note alone, or nothing, where none fits."""
    if framed_length(body) <= available:
        return body
    total = len(body)

    def cut(keep: int) -> str:
        head = body[:keep] + ("\n" if keep and body[keep - 1] != "\n" else "")
        return f"{head}[omitted chars={keep + 1}..{total}; use --lines or --match]"

    low, high, best = 0, total, ""
    while low <= high:
        keep = (low + high) // 2
        if framed_length(made := cut(keep)) <= available:
            best, low = made, keep + 1
        else:
            high = keep - 1
    brief = f"[omit c1..{total}]"
    return best or (brief if framed_length(brief) <= available else "")


def named_range(first: int, last: int) -> str:
    return f"m{first}" if first == last else f"m{first}..m{last}"


def joined_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def page(policy: str, budget: int, ref: str, conversation: str, before: tuple[int, int] | None, behind: tuple[int, int] | None, left_out: list[tuple[int, int]], shown: list[dict]) -> str:
    """The text of a read. ``shown`` are the selected messages (ordinal, heading, body, protected) in order; ``before`` and
    ``behind`` the first and last message left out on either side, ``left_out`` the runs of their numbers."""
    shown = [dict(m) for m in shown]
    gone: list[dict] = []

    def cut() -> str:
        tail = behind or gone
        if not shown:
            return "tail"
        return "+".join([*(["head"] if before else []), *(["focus"] if before and tail else []), *(["tail"] if tail else [])]) or "none"

    def text(said: str) -> str:
        last = [(gone[0]["ordinal"] if gone else behind[0], behind[1] if behind else gone[-1]["ordinal"])] if gone or behind else []
        sides = [*([before] if before else []), *last]
        if not shown and len(sides) == 2:
            sides = [(sides[0][0], sides[1][1])]
        omit = ",".join(named_range(*r) for r in sides) or "none"
        out = f"protocol agent-read cut={escaped(said)} chars={budget} policy={policy} omit={omit}\n" + (conversation if shown else "")
        for m in shown:
            out += m["heading"] + "".join(f"| {x}\n" if x else "|\n" for x in m["body"].split("\n"))
        refs = [f"{ref}:{named_range(*r)}" for r in joined_ranges([*left_out, *((m["ordinal"], m["ordinal"]) for m in gone)])]
        return out + (f"continue read refs={escaped(';'.join(refs))}\n" if refs else "")

    def trim(said: str) -> str:
        bodies = [m["body"] for m in shown]
        for m in shown:
            m["body"] = ""
        if shown:
            room = max(0, budget - len(text(said))) // len(shown)
            for m, body in zip(shown, bodies, strict=True):
                m["body"] = trimmed(body, room)
        return text(said)

    out = text(cut())
    if len(out) <= budget:
        return out
    said = cut() if before or behind else "body"
    if any(m["protected"] for m in shown):
        low, high = (f(m["ordinal"] for m in shown if m["protected"]) for f in (min, max))
        first = [m for m in shown if m["ordinal"] < low]
        if first:
            left_out = [*left_out, *((m["ordinal"], m["ordinal"]) for m in first)]
            before = (before[0] if before else first[0]["ordinal"], first[-1]["ordinal"])
        gone = [m for m in shown if m["ordinal"] > high]
        shown = [m for m in shown if m["protected"]]
        said = cut()
    out = trim(said)
    while len(out) > budget and shown and not shown[-1]["protected"]:
        gone = [shown.pop(), *gone]
        out = trim(cut())
    return out[:budget]


def pages(messages: DataFrame, conversations: DataFrame, requests: DataFrame, budget: int, policy: str = "text") -> DataFrame:
    """(req, text) of each request; ``conversations`` has key, ref and conversation (its line)."""
    rows = asked_messages(messages, requests).join(conversations.select("key", "ref", "conversation"), "key")
    picked = selected(rows, F.length("conversation"), budget)
    shown = rows.join(picked.where("taken").select("req", "ordinal", "protected"), ["req", "ordinal"])
    parts = shown.groupBy("req").agg(F.sort_array(F.collect_list(F.struct("ordinal", "heading", "body", "protected"))).alias("shown"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.first("ref").alias("ref"), F.first("conversation").alias("conversation"))
    left = rows.select("req", "ordinal").join(picked.where("taken").select("req", "ordinal"), ["req", "ordinal"], "left_anti")
    runs = ranges_of(left).join(parts.select("req", "low", "high"), "req")
    told = runs.groupBy("req").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("left_out"),
        *[F.struct(F.min(F.when(c, F.col("first"))).alias("first"), F.max(F.when(c, F.col("last"))).alias("last")).alias(n) for n, c in (("before", F.col("last") < F.col("low")), ("behind", F.col("first") > F.col("high")))],
    )

    @F.pandas_udf(StringType())
    def render(ref: pd.Series, conversation: pd.Series, before: pd.DataFrame, behind: pd.DataFrame, left_out: pd.Series, shown: pd.Series) -> pd.Series:
        def side(frame: pd.DataFrame, k: int) -> tuple[int, int] | None:
            first = frame["first"].iloc[k]
            return None if pd.isna(first) else (int(first), int(frame["last"].iloc[k]))

        return pd.Series([page(policy, budget, ref.iloc[k], conversation.iloc[k], side(before, k), side(behind, k), [(x["first"], x["last"]) for x in (left_out.iloc[k] if left_out.iloc[k] is not None else [])], list(shown.iloc[k])) for k in range(len(ref))])

    return parts.join(told, "req", "left").select("req", render("ref", "conversation", "before", "behind", "left_out", "shown").alias("text"))
