"""Times, delays and progress as Column expressions. Times are epoch milliseconds unless said; -1 means missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taktwerk.functions.geo import clamp01


def normal_time(text: Column) -> Column:
    """Milliseconds of an ISO time or a string of digits; null, blank and -1 are missing."""
    text = text.cast("string")
    parsed = F.unix_millis(F.try_to_timestamp(text))
    return F.when(text.isNull() | text.isin("", "-1"), None).when(text.rlike("^[0-9]+$"), text.try_cast("bigint")).otherwise(parsed)


def first_time(*times: Column) -> Column:
    """The first that is neither null nor the -1 that marks a missing time."""
    return F.coalesce(*[F.when(t != -1, t) for t in times])


def delay_seconds(planned: Column, actual: Column) -> Column:
    """Whole seconds of delay; 0 without an actual time, null without a planned one."""
    return F.when(actual.isNull(), F.lit(0)).otherwise(F.floor((actual - planned) / 1000)).cast("int")


def arrival_time(arr_actual: Column, arr_planned: Column, dep_actual: Column, dep_planned: Column) -> Column:
    return first_time(arr_actual, arr_planned, dep_actual, dep_planned)


def segment_start(arr_actual: Column, arr_planned: Column, dep_actual: Column, dep_planned: Column, next_arr_actual: Column, next_arr_planned: Column) -> Column:
    """When a vehicle left a stop: its departure, moved ahead by what it gains until the next stop, but not before its arrival."""
    gained = F.coalesce(F.greatest(first_time(next_arr_planned) - first_time(next_arr_actual), F.lit(0)), F.lit(0))
    left, came = first_time(dep_actual, dep_planned) - gained, first_time(arr_actual, arr_planned)
    return F.when(left.isNull(), came).when(came.isNull(), left).otherwise(F.greatest(left, came))


def progress(now: Column, start: Column, next_arrival: Column, stored: Column) -> Column:
    """Share of the way to the next stop; what is stored where the times do not tell."""
    told = start.isNotNull() & next_arrival.isNotNull() & (next_arrival > start)
    return F.when(told, clamp01((now - start) / F.nullif(next_arrival - start, F.lit(0)))).otherwise(F.coalesce(clamp01(stored), F.lit(0.0)))


def next_run(now: Column, start: Column, next_stop: Column) -> Column:
    """When to look again: halfway, else at the next stop, else in 30 seconds, or in five minutes without a time."""
    half = F.when(next_stop > start, start + (next_stop - start) / 2)
    return F.when(half > now, half).when(next_stop > now, next_stop.cast("double")).when(next_stop.isNotNull(), (now + 30_000).cast("double")).otherwise((now + 300_000).cast("double"))


def shifted_hour(ts: Column) -> Column:
    """Hour bucket: the UTC hour and one, 0 where there is no time."""
    return F.coalesce(F.pmod(F.hour(ts) + 1, F.lit(24)), F.lit(0))


def days_back(as_of: Column, days: int) -> Column:
    return F.date_sub(as_of, days)


def years_back(as_of: Column, years: int) -> Column:
    return F.add_months(as_of, -12 * years)
