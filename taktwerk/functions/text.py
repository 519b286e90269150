"""Codes, codings and labels as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from taktwerk.sources.schema import OCCUPANCY, PRODUCTS


def matches_pattern(column: Column, pattern: str) -> Column:
    """Search by % and _, anywhere in the text, in any case; other characters stand for themselves."""
    wild = {"%": ".*", "_": "."}
    return column.cast("string").rlike("(?i)" + "".join(wild.get(c, re.escape(c)) for c in pattern))


def positive_or(text: Column, fallback: float) -> Column:
    """A positive finite number, or the fallback."""
    number = text.try_cast("double")
    return F.when((number > 0) & (number < float("inf")), number).otherwise(F.lit(fallback))


def member_size(member: Column) -> Column:
    """The number before the first colon of ``size:json``."""
    return F.substring_index(member, ":", 1).try_cast("bigint")


def member_value(member: Column, schema: str) -> Column:
    """The JSON after the first colon of ``size:json``; null where it is none."""
    return F.from_json(F.substring(member, F.instr(member, ":") + 1, F.length(member)), schema)


def stop_code(code: Column) -> Column:
    return F.upper(F.trim(F.split(F.coalesce(code, F.lit("")), ":")[0]))


def platform(code: Column) -> Column:
    """The number after the colon, 0 where there is none."""
    return F.coalesce(F.get(F.split(code, ":"), F.lit(1)).try_cast("int"), F.lit(0))


def direction(text: Column) -> Column:
    """The first digits of a direction, 0 where there are none."""
    return F.coalesce(F.regexp_extract(text, r"\d+", 0).try_cast("int"), F.lit(0))


def _coded(name: Column, codes: dict[str, int]) -> Column:
    out = F.lit(0)
    for label, code in codes.items():
        out = F.when(name == label, F.lit(code)).otherwise(out)
    return out


def product_code(name: Column) -> Column:
    return _coded(name, PRODUCTS)


def occupancy_code(name: Column) -> Column:
    return _coded(name, OCCUPANCY)


def vehicle_number(text: Column) -> Column:
    """The number of a vehicle: 0 for one of another operator, -1 where it is missing."""
    return F.when(text == "PVU", F.lit(0)).otherwise(F.coalesce(text.try_cast("int"), F.lit(-1)))


def normal_product(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s-]", ""))


def product_flags(csv: Column) -> dict[str, Column]:
    """A 0/1 flag for each mode of a list."""
    names = F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: F.trim(x))
    return {f"produkt_{p.lower()}": F.array_contains(names, p).cast("smallint") for p in PRODUCTS}


def product_list(flags: dict[str, Column]) -> Column:
    return F.concat_ws(", ", *[F.when(flags[f"produkt_{p.lower()}"] > 0, F.lit(p)) for p in PRODUCTS])


def line_label(name: Column) -> Column:
    """A line's name without what kind of line it is."""
    return F.trim(F.regexp_replace(name, "(U-Bahn|Tram|Bus)-Linie ", ""))


def metric_name(prefix: Column, *parts: Column) -> Column:
    name = F.regexp_replace(F.concat_ws("_", *parts), r"[^a-zA-Z0-9_:]", "_")
    return F.concat(prefix, F.when(name.rlike("^[a-zA-Z_:]"), name).otherwise(F.concat(F.lit("_"), name)))


def minutes_seconds(seconds: Column) -> Column:
    """Signed M:SS."""
    whole = F.abs(seconds).cast("bigint")
    return F.concat(F.when(seconds < 0, F.lit("-")).otherwise(F.lit("")), F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def control_room_class(seconds: Column) -> Column:
    """0, 1, 2 or >3 minutes, with a minus for early."""
    size, sign = F.abs(seconds), F.when(seconds < 0, F.lit("-")).otherwise(F.lit(""))
    low = F.floor(size / 60).cast("string")
    return F.when(seconds.isNull(), F.lit("")).when(size < 180, F.concat(sign, low)).when(seconds < 0, F.lit(">-3")).otherwise(F.lit(">3"))


def first_filled(info: Column, *keys: str) -> Column:
    """The first value of a map that is neither missing nor blank."""
    return F.coalesce(*[F.nullif(info[k], F.lit("")) for k in keys])
