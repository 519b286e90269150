"""Observations of devices on their way into the table: bounds of each field, and what is turned away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: bounds of numbers, and of the lengths of trimmed texts
NUMBERS = {"sequence": (0, 255), "rail_temperature": (0, 255), "ambient_temperature": (0, 255)}
TEXTS = {"device": (1, 128), "block_identifier": (0, 32), "raw_telegram": (0, 1024)}


def _reason() -> Column:
    """The first field that is missing or out of bounds, null where all are in order."""
    wrong = F.when(F.col("timestamp").isNull(), "timestamp")
    for name, (low, high) in TEXTS.items():
        wrong = wrong.when(~F.coalesce(F.length(F.trim(name)).between(low, high), F.lit(False)), name)
    for name, (low, high) in NUMBERS.items():
        wrong = wrong.when(~F.coalesce(F.col(name).between(low, high) & (F.col(name) == F.floor(name)), F.lit(False)), name)
    return wrong


def accepted(rows: DataFrame) -> DataFrame:
    """Rows in order, texts trimmed and numbers in one byte's range; append them with ``sources.tables.append``."""
    good = rows.where(_reason().isNull())
    return good.withColumns({**{n: F.trim(n) for n in TEXTS}, **{n: F.col(n).cast("smallint") for n in NUMBERS}})


def rejected(rows: DataFrame) -> DataFrame:
    """The other rows with the field that keeps them out, for a dead-letter table."""
    return rows.withColumn("reason", _reason()).where("reason is not null")
