"""What the filters of a chain do to one another, in every order of the chain and every part of the corpus.

A document's failures are a bit mask. Equal texts form a group by their digest, and a group's copies are counted before
anything meets, so a text that a third of all rows share is a few rows. The counts go to cells (part, mask: documents,
good and toxic ones); after that the work depends on the number of parts only.

Long form: each cell meets each step of each order. A running bit-or over the steps before (a window) tells whether the
cell's documents are still there; conditional sums give the metrics, and a window over a part's filter the sum of what it
removes in all orders.

Defined cases: a null or empty text is the empty text, all of which are equal; a null part is the empty string; a null
doc_id is smaller than none and greater than none, so it fails no comparison by id, and has no label; rows that repeat an
id and a text are documents of their own, none of which is earlier than the other; of several labels of an id any that says
1 counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import Scratch

# White space and signs of the contract (fixed values), as Java patterns.
_WHITE, _SIGNS, _CAPITAL = r"[\x20\x09-\x0D]+", r"[#$%&*|]", r"[A-Z]"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that one text decides: A too few words, B too few different ones, C too many capitals, D signs."""
    found = F.split(text, _WHITE)
    words = F.size(found) - F.when(F.element_at(found, 1) == "", 1).otherwise(0) - F.when((F.size(found) > 1) & (F.element_at(found, -1) == ""), 1).otherwise(0)
    distinct = F.size(F.array_remove(F.array_distinct(found), ""))
    capitals = F.regexp_count(text, F.lit(_CAPITAL))
    return {"A": words < 200, "B": distinct * 100 < words * 50, "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 2, "D": text.rlike(_SIGNS)}


def bits(conditions: dict[str, Column]) -> Column:
    """The failed conditions as a mask; the first is bit 0."""
    return reduce(Column.bitwiseOR, [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())])


def mask_cells(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail; bit 4 is a copy of a text with a smaller id."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    slim = slim.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits(text_filters(F.col("text"))).alias("bits"))
    rows = scratch.write(slim.groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n")), "rows")
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = rows.where("doc_id is not null").join(told.where("doc_id is not null"), "doc_id", "left")
    marked = known.unionByName(rows.where("doc_id is null"), allowMissingColumns=True).na.fill(False, ["good", "toxic"])
    # copies of a text collapse here: what is left of a text is one row for each part and label
    groups = marked.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null")
    )
    groups = scratch.write(groups, "groups")
    least = groups.groupBy("digest").agg(F.min("first").alias("least"))
    apart = groups.join(least, "digest").withColumn("early", F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0))
    sides = F.array(F.struct(F.col("bits").alias("mask"), F.col("early").alias("n")), F.struct(F.col("bits").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("early")).alias("n")))
    cells = apart.select("part", "good", "toxic", F.explode(sides).alias("x")).select("part", "good", "toxic", "x.*")
    count = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    return scratch.write(count, "cells")


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """The metrics of each (part, filter_order, step) from (part, mask, n, good, toxic) cells."""
    steps = json.dumps([{"filter_order": "".join(p), "step": k + 1, "bit": 1 << letters.index(c)} for p in permutations(letters) for k, c in enumerate(p)])
    every = F.from_json(F.lit(steps), "array<struct<filter_order string, step int, bit int>>")
    long = cells.select("part", "mask", "n", "good", "toxic", F.explode(every).alias("at")).select("part", "mask", "n", "good", "toxic", "at.*")
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    long = long.withColumns({"fails": failed != 0, "gone": F.coalesce(F.bit_or(failed).over(before), F.lit(0)) != 0})

    def total(of: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(0))

    removed = F.col("fails") & ~F.col("gone")
    out = long.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~F.col("fails") & ~F.col("gone")).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", F.col("fails") & F.col("gone")).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
    )
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")))
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over (doc_id, text, source) and (doc_id, quality, toxic)."""
    return interactions(mask_cells(docs, labels, Scratch(docs.sparkSession, "audit")), "ABCDE")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, FALSE)) AS good, max(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(l.good, FALSE) AS good, coalesce(l.toxic, FALSE) AS toxic, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
  'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, FALSE)} AS f
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
u AS (SELECT part, good, toxic, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END, CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS fails FROM m),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM u GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a),
p AS (SELECT concat(x1.a, x2.a, x3.a, x4.a, x5.a) AS filter_order FROM x x1, x x2, x x3, x x4, x x5 WHERE len(list_distinct([x1.a, x2.a, x3.a, x4.a, x5.a])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM p),
j AS (SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, fails = filter_order[step] AS sole,
  contains(fails, filter_order[step]) AS failing, len(regexp_replace(left(filter_order, step - 1), '[^' || fails || '!]', '', 'g')) > 0 AS gone FROM c, s),
g AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant, coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
  coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS toxic_lost FROM j GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g
"""
