"""Which filter removes what, for every order of the filters, by wide packed counters.

Five filters judge a text once; their failures are a mask of five bits. What an order of the filters
does with a document at each of its steps follows from the mask alone, so each mask (with the two labels)
has one big integer: a field of ``FIELD`` bits for each of 120 orders x 5 steps x 6 outcomes, holding 1 where
the document has that outcome there. The sum of the integers of a part holds all its counts at once.
A field overflows at 2**64 documents, more than a Spark count can hold, so no field runs into the next.

Spark counts the masks of a part first (a partial aggregate, at most 128 kinds a part), so each integer is
added once, times its count, and a part that holds most rows is no larger than any other.

Cases: null text is empty and fails A only (and E as a copy); null ``lang`` is part ''; a row without ``doc_id`` is nobody's
smaller document and no copy; rows that share a ``doc_id`` are counted each and are no copies of one another;
several labels of one document count once, quality and toxic where any says 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.llm.common import stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bits of a field.
FIELD = 64
BLANK = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D. The words are split once."""
    marks = text.rlike("[#$%&*|]")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def mask(words: Column) -> Column:
        n = F.size(words)
        return (F.when(n < 100, 1).otherwise(0) + F.when(F.size(F.array_distinct(words)) * 100 < n * 80, 2).otherwise(0)
                + F.when(capitals * 100 > F.length(text) * 10, 4).otherwise(0) + F.when(marks, 8).otherwise(0))
    return F.transform(F.array(F.array_remove(F.split(text, BLANK), "")), mask)[0]


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of every row: all five failures, the labels as 0 or 1."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"),
                              failures(text).alias("mask")), "failures")
    # stored: a join of two plain exchanges, of which Spark splits a digest that many rows share
    first = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
                   .select(F.col("digest").alias("_d"), "first"), "first")
    label = labels.groupBy(F.col("doc_id").cast("long").alias("_l")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copies = rows.join(first, F.col("digest") == F.col("_d"), "left").select(
        "doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("mask"))
    return copies.join(label, F.col("doc_id") == F.col("_l"), "left").select(
        "doc_id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@cache
def packed(mask: int, good: int, toxic: int) -> int:
    """The integer of a document: its outcomes in all orders and steps, one field each."""
    fields = np.zeros((len(ORDERS), STEPS, len(OUTCOMES)), f"<u{FIELD // 8}")
    for o, order in enumerate(ORDERS):
        there = True
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            removed = there and fails
            fields[o, s] = (there and not fails, removed, fails and not there, mask == bit, removed and good, removed and toxic)
            there = there and not fails
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """Counts by order, step and outcome."""
    size = len(ORDERS) * STEPS * len(OUTCOMES)
    return np.frombuffer(total.to_bytes(size * FIELD // 8, "little"), f"<u{FIELD // 8}").reshape(len(ORDERS), STEPS, len(OUTCOMES))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows a part: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    kinds = judged(docs, labels).groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))

    def report(frame: pd.DataFrame) -> pd.DataFrame:
        counts = unpacked(sum(packed(int(m), int(g), int(t)) * int(n) for m, g, t, n in zip(frame["mask"], frame["good"], frame["toxic"], frame["n"])))
        out = pd.DataFrame(counts.reshape(-1, len(OUTCOMES)).astype(np.int64), columns=list(OUTCOMES))
        out.insert(0, "part", frame["part"].iloc[0])
        out.insert(1, "filter_order", np.repeat(ORDERS, STEPS))
        out.insert(2, "step", np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))
        name = np.array([x for order in ORDERS for x in order])
        out["shapley"] = out["removed"].groupby(name).transform("sum")
        return out

    return kinds.groupBy("part").applyInPandas(report, "part string, filter_order string, step int, " + ", ".join(
        f"{c} long" for c in (*OUTCOMES, "shapley")))


ORACLE = r"""
with recursive d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') body from documents),
w as (select *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') ws, min(doc_id) over (partition by body) first from d),
f as (
  select part, doc_id, case when len(ws) < 100 then 'A' else '' end || case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 'B' else '' end
    || case when 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) then 'C' else '' end
    || case when regexp_matches(body, '[#$%&*|]') then 'D' else '' end || case when doc_id > first then 'E' else '' end fails
  from w),
l as (select doc_id, max(cast(quality = 1 as int)) good, max(cast(toxic = 1 as int)) toxic from labels group by 1),
kinds as (
  select part, fails, coalesce(good, 0) good, coalesce(toxic, 0) toxic, count(*) n from f left join l using (doc_id) group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
orders as (select '' o union all select o || x from orders, letters where not contains(o, x)),
steps as (select o, s, substr(o, s, 1) x, substr(o, 1, s - 1) before from orders, (select unnest([1, 2, 3, 4, 5]) s) where length(o) = 5),
met as (
  select part, o, s, x, n, good, toxic, fails, contains(fails, x) fail, fails <> '' and before <> '' and regexp_matches(before, '[' || fails || '.]') earlier
  from kinds, steps),
counted as (
  select part, o filter_order, cast(s as int) step, x, cast(coalesce(sum(n) filter (not fail and not earlier), 0) as bigint) kept,
    cast(coalesce(sum(n) filter (fail and not earlier), 0) as bigint) removed, cast(coalesce(sum(n) filter (fail and earlier), 0) as bigint) redundant,
    cast(coalesce(sum(n) filter (fails = x), 0) as bigint) unique_fails,
    cast(coalesce(sum(n) filter (fail and not earlier and good = 1), 0) as bigint) good_lost,
    cast(coalesce(sum(n) filter (fail and not earlier and toxic = 1), 0) as bigint) toxic_lost
  from met group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, x) as bigint) shapley from counted"""
