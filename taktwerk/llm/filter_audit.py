"""Interaction of filters: what each of n filters removes, keeps or finds already gone, for all n! orders at once.

A document is a mask of the filters that it fails. With the orders in lexicographic rank, the orders whose first s
letters are given fill one interval of ranks; so do, joined where they touch, those in which a mask is removed at
step s: any letters outside the mask, then one inside. A mask's count is added at the start of each interval and
taken off at its end (a difference array by part and step), and one prefix sum over the ranks gives the documents
removed by every order. Documents are read once and counted by part and mask, so the work on orders depends on the
number of parts alone.

Defined results: a null text is empty; a null part is the empty one; a document with a null key never counts as a
copy and makes no other one a copy; rows that repeat a key and a text are all of the same verdict; a key labelled
more than once is good (toxic) if any label says so; an empty table has no parts and so no rows; other columns are
not read. Texts are compared by SHA-256, and copies of a text are counted together before they meet its first key.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taktwerk.llm.line_rules import words_of

NAMES = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
MARKS = r"[#$%&*|]"


# ---------------------------------------------------------------- ranks of orders


def prefix_interval(prefix: tuple[int, ...], n: int) -> tuple[int, int]:
    """Ranks [start, end) of the orders of 0..n-1 that begin with ``prefix``: its Lehmer digits in the factorial base."""
    start, unused = 0, list(range(n))
    for i, letter in enumerate(prefix):
        start += unused.index(letter) * math.factorial(n - 1 - i)
        unused.remove(letter)
    return start, start + math.factorial(n - len(prefix))


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, start, end): the ranks of the orders that remove a mask at a step, touching intervals joined."""
    out = []
    for mask in range(1, 1 << n):
        inside, outside = [i for i in range(n) if mask >> i & 1], [i for i in range(n) if not mask >> i & 1]
        for step in range(1, len(outside) + 2):
            merged: list[list[int]] = []
            for start, end in sorted(prefix_interval((*p, last), n) for p in itertools.permutations(outside, step - 1) for last in inside):
                if merged and merged[-1][1] == start:
                    merged[-1][1] = end
                else:
                    merged.append([start, end])
            out += [(mask, step, start, end) for start, end in merged]
    return out


# ---------------------------------------------------------------- documents to cells


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, digest, mask) of each document, for the filters that a text fails by itself: the bits of A to D."""
    t = F.col("text_")
    df = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    df = df.select("key", "part", "text_", words_of(t).alias("w"))
    n, distinct = F.size("w"), F.size(F.array_distinct("w"))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    fails = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * capitals > MAX_CAPITAL_PERCENT * F.length(t), t.rlike(MARKS))
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return df.select("key", "part", F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def label_flags(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row (key, good, toxic) for each labelled key."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("bigint")
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and the filters that they fail, the copies' filter being bit 4.

    Keys without a value are spread by digest, as they meet no label. A text's copies are summed by key, then by part
    and label, so that few rows of a text meet to find its smallest key, however many copies there are.
    """
    df = failures(docs, key, text, part).withColumn("spread", F.when(F.col("key").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    df = df.join(label_flags(labels, key).withColumn("spread", F.lit(0).cast("bigint")), ["key", "spread"], "left").na.fill(0, ["good", "toxic"])
    group = ["digest", "part", "mask", "good", "toxic"]
    by_key = df.groupBy(*group, "key").agg(F.count("*").alias("n"))
    known = F.when(F.col("key").isNotNull(), F.struct("key", "n"))
    few = by_key.groupBy(*group).agg(F.sum("n").alias("n"), F.min(known).alias("least"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("keyless"))
    first = F.min("least.key").over(Window.partitionBy("digest"))
    few = few.withColumn("kept", F.col("keyless") + F.when(F.col("least.key") == first, F.col("least.n")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("kept").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
    one = few.select("part", "good", "toxic", F.explode(both).alias("c")).select("part", "good", "toxic", "c.mask", "c.n").where("n > 0")
    return one.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


# ---------------------------------------------------------------- cells to orders


def audit(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """A row for each part, order and step from ``counts(part, mask, n, good, toxic)``; bit i of a mask is filter ``names[i]``."""
    n, ranks = len(names), math.factorial(len(names))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(names)])  # in the order of ranks
    bit = lambda i: F.col("mask").bitwiseAND(1 << i) != 0
    failing = F.array(*[F.sum(F.when(bit(i), F.col("n")).otherwise(0)) for i in range(n)])
    alone = F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(n)])
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), failing.alias("failing"), alone.alias("alone"))
    grid = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))

    spans = counts.sparkSession.createDataFrame(removal_intervals(n), "mask int, step int, start int, end int")
    signed = lambda rank, sign: F.struct(F.col(rank).alias("rank"), *[(F.lit(sign) * F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    ends = counts.join(spans, "mask").select("part", "step", F.explode(F.array(signed("start", 1), signed("end", -1))).alias("e")).select("part", "step", "e.*")
    ends = ends.groupBy("part", "step", "rank").agg(*[F.sum(c).alias(f"d_{c}") for c in ("n", "good", "toxic")])

    along_ranks = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    df = grid.join(ends, ["part", "step", "rank"], "left")
    for c, name in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost")):
        df = df.withColumn(name, F.sum(F.coalesce(f"d_{c}", F.lit(0))).over(along_ranks))
    df = df.withColumn("filter_order", F.get(orders, F.col("rank"))).withColumn("letter", F.substr("filter_order", F.col("step"), F.lit(1)))
    at = F.instr(F.lit(names), F.col("letter")) - 1
    along_steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("kept", F.col("total") - F.sum("removed").over(along_steps))
    df = df.withColumn("redundant", F.get("failing", at) - F.col("removed")).withColumn("unique_fails", F.get("alone", at)).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    return df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole texts, audited by language in all 120 orders."""
    return audit(cells(docs, labels))
