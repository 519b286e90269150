"""Nested lists in HTML: their choices in the order of the page.

Tags are taken out by one pattern; the lists that are open at a tag are a stack, which is kept without one: a tag's depth is a
running sum of opened and closed lists, and the list it belongs to is the last one opened at its depth. Both are
windows over the tags of one page, so pages are dealt by key and only tags and their labels travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A list or an entry of one, opened or closed, and the plain text right after it; comments and scripts are passed over.
TAG = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)(ul|ol|select|li|option|a)\b([^>]*)>([^<]*)"
#: An attribute's value: in double quotes, in single ones, or bare.
ATTRIBUTE = r"(?is)(?<![\w-]){}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
LISTS, CHOICES = ("ul", "ol", "select"), ("a", "option")


def tags(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, closes, tag, attributes, label) of the tags of lists and their entries, in order."""
    part = lambda n: F.regexp_extract_all(html, F.lit(TAG), F.lit(n))
    zipped = F.arrays_zip(part(2).alias("closes"), part(3).alias("tag"), part(4).alias("attributes"), part(5).alias("label"))
    rows = pages.select(key, F.posexplode(zipped).alias("pos", "x")).where("x.tag <> ''")
    return rows.select(key, "pos", (F.col("x.closes") == "/").alias("closes"), F.lower("x.tag").alias("tag"), F.col("x.attributes").alias("attributes"), F.col("x.label").alias("label"))


def choices(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, list_no, list_id, parent_no, depth, place, target, label): the links and options in the lists of a page.

    Lists are counted from 1 in the order in which they open; ``parent_no`` is the list around (null at depth 1), ``place``
    counts a list's own choices from 1. ``target`` is the ``href`` or ``value`` as written, empty ones are left out; the label
    is trimmed. A close without an open list is passed over; a list that never closes runs to the end. Choices outside lists are none.
    A key stands for one page; pages that share one are read as one.
    """
    page = Window.partitionBy(key).orderBy("pos")
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy(key, "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    attribute = lambda name: F.concat(*[F.regexp_extract("attributes", ATTRIBUTE.format(name), n) for n in (1, 2, 3)])
    opens, is_list = F.col("step") == 1, F.col("tag").isin(*LISTS)
    rows = tags(pages, key, html).where(is_list | (F.col("tag").isin(*CHOICES) & ~F.col("closes")))
    rows = rows.withColumn("step", F.when(is_list, F.when(F.col("closes"), -1).otherwise(1)).otherwise(0))
    # a close without an open list lowers the running sum to a new lowest point, from which depths count afterwards
    rows = rows.withColumns({"sum_": F.sum("step").over(upto), "no_": F.sum(F.when(opens, 1).otherwise(0)).over(upto).cast("int")})
    rows = rows.withColumn("depth", (F.col("sum_") - F.least(F.lit(0), F.min("sum_").over(upto))).cast("int"))
    rows = rows.withColumn("at_", F.last(F.when(opens, F.col("no_")), ignorenulls=True).over(level)).withColumn("around_", F.lag("at_").over(page))
    opened = F.struct(F.col("no_").alias("list_no"), F.nullif(attribute("id"), F.lit("")).alias("list_id"), F.col("around_").alias("parent_no"))
    rows = rows.withColumn("l", F.last(F.when(opens, opened), ignorenulls=True).over(level))
    found = rows.where((F.col("step") == 0) & (F.col("depth") > 0)).withColumn("target", F.when(F.col("tag") == "a", attribute("href")).otherwise(attribute("value"))).where("target <> ''")
    place = F.row_number().over(Window.partitionBy(key, "l.list_no").orderBy("pos"))
    return found.select(key, "l.*", "depth", place.alias("place"), "target", F.trim(F.regexp_replace("label", r"\s+", " ")).alias("label"))


def orders(choices: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, list_no, direction, stops): the targets of each list in order, and the other way round as direction 2."""
    placed = choices.groupBy(key, "list_no").agg(F.array_sort(F.collect_list(F.struct("place", "target"))).alias("s"))  # the choices of one list
    there = F.transform("s", lambda x: x["target"])
    both = F.explode(F.array(F.struct(F.lit(1).alias("direction"), there.alias("stops")), F.struct(F.lit(2).alias("direction"), F.reverse(there).alias("stops"))))
    return placed.select(key, "list_no", both.alias("d")).select(key, "list_no", "d.direction", "d.stops")
