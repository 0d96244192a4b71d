"""Operator 13, filter interaction audit: what five filters remove in each of their 120 orders.

Method: Hart-Mas-Colell potential. The removal game of a part gives a coalition S of filters the
number v(S) of documents that fail any of them. The potential P(S) = (v(S) + sum of P(S without i)) / |S|
is computed over the 32 coalitions, subsets first; a filter's Shapley value is the grand potential minus
the potential without it. Steps of an order are differences of v between coalitions.

The filters (words: maximal runs without blanks and tabs to returns): A under 50 words; B 100 * distinct
words < 65 * words; C 100 * [A-Z] > 5 * code points; D holds one of # $ % & * |; E the text of a smaller doc_id.

A document becomes five bits in the scan, and its text a digest of 32 bytes. Equal texts are counted by
digest and label before they meet, so a text that a third of all rows hold is a few rows; what is left is
32 counts a part. Null text is empty; a null doc_id sorts first and has no labels; of several label rows of
one document one 1 is enough; rows that repeat a doc_id count each, and none fails E by its own id; null
source is the part ''. No documents, no rows.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, id_in

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: 60 times a potential of five players is a whole number.
SCALE = 60
BLANKS = " \t\n\x0b\x0c\r"


def _bit(fails: Column, name: str) -> Column:
    return F.when(fails, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask: bits of the filters A to D that a text fails; E needs other rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(id_in(), F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("w", F.filter(F.split("t", f"[{BLANKS}]+"), lambda w: w != ""))
    words, distinct = F.size("w"), F.size(F.array_distinct("w"))
    capitals, chars = F.regexp_count("t", F.lit("[A-Z]")), F.char_length("t")
    mask = _bit(words < 50, "A") + _bit(100 * distinct < 65 * words, "B") + _bit(100 * capitals.cast("long") > 5 * chars.cast("long"), "C")
    mask = mask + _bit(F.col("t").rlike("[#$%&*|]"), "D")
    return rows.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters), n, good, toxic: counts of documents and of labelled ones."""
    rows = failures(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    one = {c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))) for c in ("quality", "toxic")}
    known = labels.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "quality", "toxic")
    known = known.groupBy("doc_id").agg(one["quality"].alias("good"), one["toxic"].alias("bad"))
    rows = rows.join(known, "doc_id", "left").na.fill(0, ["good", "bad"])
    same = rows.groupBy("digest", "part", "mask", "good", "bad").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("held"))
    least = F.min("first").over(Window.partitionBy("digest"))
    same = same.withColumn("held", F.when(F.col("first") == least, F.col("held")).otherwise(F.lit(0)))
    copies = F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("held")).alias("n"))
    both = F.array(F.struct("mask", F.col("held").alias("n")), copies)
    split = same.select("part", "good", "bad", F.inline(both)).filter("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic"))


def _game(held: str, count: str) -> Column:
    """v of all coalitions in the order of their bits: rows that fail any filter of a coalition."""
    none = F.lit(0).cast("long")
    fails = lambda s: F.filter(held, lambda m: m["mask"].bitwiseAND(s) != 0)
    return F.transform(F.sequence(F.lit(0), F.lit(ALL)), lambda s: F.aggregate(fails(s), none, lambda a, m: a + m[count]))


def _potentials(game: Column) -> Column:
    """SCALE * P of all coalitions in the order of their bits, in which subsets come first."""
    bits = [F.lit(1 << k) for k in range(len(FILTERS))]

    def potential(done: Column, s: Column) -> Column:
        without = sum((F.when(s.bitwiseAND(b) != 0, F.get(done, s - b)).otherwise(F.lit(0)) for b in bits), SCALE * F.get(game, s))
        return F.concat(done, F.array((without / F.bit_count(s)).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), potential)


def _steps() -> Column:
    """All steps of all orders: the order, the step from 1, its filter, its bit and those of the filters before it."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            rows.append({"filter_order": "".join(order), "step": k + 1, "filter": name, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, filter: string, bit: int, before: int>>")


def audit(counts: DataFrame) -> DataFrame:
    """The steps of all orders for each part of masks()."""
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    games = held.select("part", F.aggregate("held", F.lit(0).cast("long"), lambda a, m: a + m["n"]).alias("total"), *(_game("held", c).alias(c) for c in ("n", "good", "toxic")))
    games = games.withColumn("potential", _potentials(F.col("n")))
    at = games.select("*", F.inline(_steps())).withColumn("after", F.col("before") + F.col("bit"))
    gain = lambda c: F.get(c, F.col("after")) - F.get(c, F.col("before"))
    fails, removed, rest = F.get("n", F.col("bit")), gain("n"), F.lit(ALL) - F.col("bit")
    # 120 orders: twice the scale of the potentials.
    shapley = 2 * (F.get("potential", F.lit(ALL)) - F.get("potential", rest))
    unique = F.get("n", F.lit(ALL)) - F.get("n", rest)
    out = {"kept": F.col("total") - F.get("n", F.col("after")), "removed": removed, "redundant": fails - removed, "unique_fails": unique}
    out |= {"good_lost": gain("good"), "toxic_lost": gain("toxic"), "shapley": shapley}
    return at.select("part", "filter_order", "step", "filter", *(v.cast("long").alias(k) for k, v in out.items()))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


#: By definition: every document goes through every order, one filter after another.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x09-\x0D ]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT doc_id, part,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
        WHEN 'A' THEN len(w) < 50
        WHEN 'B' THEN 100 * len(list_distinct(w)) < 65 * len(w)
        WHEN 'C' THEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)
        WHEN 'D' THEN regexp_matches(t, '[#$%&*|]')
        ELSE doc_id > first END) AS fails FROM w),
g AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT f.*, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN g USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
r AS (SELECT part, good, toxic, fails, filter_order, list_min(list_transform(fails, lambda c: instr(filter_order, c))) AS gone FROM x, o),
s AS (SELECT part, filter_order, k AS step, filter_order[k] AS filter,
    count(*) FILTER (WHERE gone IS NULL OR gone > k) AS kept,
    count(*) FILTER (WHERE gone = k) AS removed,
    count(*) FILTER (WHERE gone < k AND list_contains(fails, filter_order[k])) AS redundant,
    count(*) FILTER (WHERE fails = [filter_order[k]]) AS unique_fails,
    count(*) FILTER (WHERE gone = k AND good = 1) AS good_lost,
    count(*) FILTER (WHERE gone = k AND toxic = 1) AS toxic_lost
    FROM r, unnest(range(1, 6)) AS u(k) GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM s
"""
