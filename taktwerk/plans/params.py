"""Parameters of the routes: defaults, bounds and how spellings are brought together. Checked on the driver, before a plan is made."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields


class InvalidParameter(ValueError):
    pass


def _within(name: str, value, low=None, high=None):
    if (low is not None and value < low) or (high is not None and value > high):
        raise InvalidParameter(f"{name} must lie between {low} and {high}")
    return value


def day(text: str | dt.date | None, as_of: dt.date) -> dt.date:
    """A day of the shape yyyy-mm-dd; the day before ``as_of`` where none is given."""
    if text is None or text == "":
        return as_of - dt.timedelta(days=1)
    if isinstance(text, dt.date):
        return text
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise InvalidParameter("a day looks like 2024-01-31")
    return dt.date.fromisoformat(text)


@dataclass(frozen=True)
class Period:
    """One day, or a range of days; yesterday where neither is given."""

    start: dt.date
    end: dt.date

    @classmethod
    def of(cls, query: Mapping[str, str], as_of: dt.date) -> Period:
        if "at" in query and ("from" in query or "to" in query):
            raise InvalidParameter("either at, or from and to")
        if "from" in query or "to" in query:
            if not ("from" in query and "to" in query):
                raise InvalidParameter("from and to belong together")
            return cls(day(query["from"], as_of), day(query["to"], as_of))
        one = day(query.get("at"), as_of)
        return cls(one, one)


@dataclass(frozen=True)
class Percentage:
    outer_neg: int = -900
    outer_pos: int = 900
    lower_inner: int = -60
    upper_inner: int = 180
    years: int = 1

    def __post_init__(self):
        for f in fields(self)[:4]:
            _within(f.name, getattr(self, f.name), -3600, 3600)
        _within("years", self.years, 1, 10)


@dataclass(frozen=True)
class Histogram:
    start: dt.date
    end: dt.date
    bin_size: int = 60
    min_delay: int = -900
    max_delay: int = 3600
    line: str | None = None
    product: int | None = None
    vehicle: int | None = None

    def __post_init__(self):
        if self.end < self.start:
            raise InvalidParameter("the end lies before the start")
        _within("bin_size", self.bin_size, 1)
        _within("min_delay", self.min_delay, -86400, 86400)
        _within("max_delay", self.max_delay, -86400, 86400)


@dataclass(frozen=True)
class LineProfile:
    line: str
    days: int = 7

    def __post_init__(self):
        if not re.fullmatch("[a-zA-Z0-9]+", self.line):
            raise InvalidParameter("a line has letters and digits")
        _within("days", self.days, 1, 180)


@dataclass(frozen=True)
class Departures:
    time_span: int = 1440
    time_delay: int = 0
    limit_count: int = 30
    line: str | None = None
    product: int | None = None

    def __post_init__(self):
        _within("time_span", self.time_span, 1, 1440)
        _within("time_delay", self.time_delay, 0, 1440)
        _within("limit_count", self.limit_count, 1, 100)

    @classmethod
    def of(cls, query: Mapping[str, object]) -> Departures:
        """From the spellings of a request; parameters without a value keep their default."""
        names = {"Line": "line", "Product": "product", "TimeSpan": "time_span", "TimeDelay": "time_delay", "LimitCount": "limit_count"}
        return cls(**{names[k]: v for k, v in filled(query).items() if k in names})


@dataclass(frozen=True)
class Box:
    """Two corners (longitude, latitude) in any order; no box spans the antimeridian."""

    low: tuple[float, float]
    high: tuple[float, float]

    @classmethod
    def of(cls, pos1: tuple[float, float] | None, pos2: tuple[float, float] | None) -> Box | None:
        if (pos1 is None) != (pos2 is None):
            raise InvalidParameter("a box has two corners")
        if pos1 is None:
            return None
        for longitude, latitude in (pos1, pos2):
            _within("longitude", longitude, -180, 180)
            _within("latitude", latitude, -90, 90)
        if pos1[0] == pos2[0] or pos1[1] == pos2[1]:
            raise InvalidParameter("the corners of a box differ in both directions")
        west, east = sorted((pos1[0], pos2[0]))
        south, north = sorted((pos1[1], pos2[1]))
        return cls((south, west), (north, east))


@dataclass(frozen=True)
class TracePage:
    offset: int = 0
    limit: int = 50

    def __post_init__(self):
        _within("offset", self.offset, 0)
        _within("limit", self.limit, 1, 500)


@dataclass(frozen=True)
class Nearby:
    latitude: float
    longitude: float
    radius: float = 500

    def __post_init__(self):
        _within("latitude", self.latitude, -180, 180)
        _within("longitude", self.longitude, -180, 180)
        _within("radius", self.radius, 0, 40_000_000)


def one_spelling(query: Mapping[str, str], *names: str) -> str | None:
    """The value of a parameter that has several spellings; those given must agree."""
    given = {query[n] for n in names if query.get(n) not in (None, "")}
    if len(given) > 1:
        raise InvalidParameter(f"{', '.join(names)} disagree")
    return given.pop() if given else None


def filled(query: Mapping[str, object]) -> dict[str, object]:
    """The parameters that have a value."""
    return {k: v for k, v in query.items() if v is not None and v != ""}
