"""Keeping a dimension in step with its source, and facts that point into it whole.

Rows are compared by key; a missing value equals a missing value. Facts whose key the dimension lacks are held back,
the dimension is repaired from what the facts themselves tell of the key, and the facts are then released.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("added", "changed", "gone", "same")


def changes(stored: DataFrame, incoming: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """A row for each key of either side: the incoming values (the stored ones of a key that is gone), and ``change``.

    Where a source repeats a key, the row with the greatest values counts, so that the result does not depend on order.
    """
    one = lambda df: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*values)).alias("v"))
    old, new = one(stored).withColumnRenamed("v", "old"), one(incoming).withColumnRenamed("v", "new")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    both = old.join(new, key, "full").withColumn("change", change).withColumn("v", F.coalesce("new", "old"))
    return both.select(key, *[F.col(f"v.{c}").alias(c) for c in values], "change")


def to_store(changed: DataFrame) -> DataFrame:
    """The rows of ``changes`` that a versioned table must get; what is gone stays in it."""
    return changed.where(F.col("change").isin("added", "changed")).drop("change")


def held_back(facts: DataFrame, dimension: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The facts whose key is known, and those whose key is not, null keys among them. Nothing is lost or doubled."""
    known = dimension.select(key).where(F.col(key).isNotNull()).distinct()
    return facts.join(known, key, "left_semi"), facts.join(known, key, "left_anti")


def repairs(held: DataFrame, key: str, values: dict[str, str], told_at: str) -> DataFrame:
    """Dimension rows for the unknown keys of held facts: of each key what its latest fact tells (``values``: column of the dimension to column of the facts)."""
    order = Window.partitionBy(key).orderBy(F.col(told_at).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in values.values()])
    last = held.where(F.col(key).isNotNull()).withColumn("rank_", F.row_number().over(order)).where("rank_ = 1")
    return last.select(key, *[F.col(c).alias(name) for name, c in values.items()])


def released(facts: DataFrame, dimension: DataFrame, repaired: DataFrame, key: str) -> DataFrame:
    """All facts with ``state``: known, released by a repair, or still held (their key is null)."""
    known = dimension.select(key).where(F.col(key).isNotNull()).distinct().withColumn("state", F.lit("known"))
    new = repaired.select(key).distinct().withColumn("state", F.lit("released"))
    states = known.unionByName(new.join(known, key, "left_anti"))
    return facts.join(states, key, "left").withColumn("state", F.coalesce("state", F.lit("held")))
