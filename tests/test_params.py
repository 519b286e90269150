import datetime as dt

import pytest

from taktwerk.plans import params as p

TODAY = dt.date(2024, 3, 1)


def test_periods():
    assert p.Period.of({}, TODAY) == p.Period(dt.date(2024, 2, 29), dt.date(2024, 2, 29))
    assert p.Period.of({"at": "2024-01-05"}, TODAY).end == dt.date(2024, 1, 5)
    assert p.Period.of({"from": "2024-01-01", "to": "2024-01-05"}, TODAY).start == dt.date(2024, 1, 1)
    for bad in ({"at": "2024-01-05", "to": "2024-01-06"}, {"from": "2024-01-01"}, {"at": "5.1.2024"}):
        with pytest.raises(p.InvalidParameter):
            p.Period.of(bad, TODAY)


@pytest.mark.parametrize("make", [lambda: p.Percentage(years=11), lambda: p.Percentage(outer_neg=-4000), lambda: p.Histogram(TODAY, TODAY - dt.timedelta(1)), lambda: p.Histogram(TODAY, TODAY, bin_size=0), lambda: p.LineProfile("U-1"), lambda: p.LineProfile("U1", 181), lambda: p.Nearby(0, 200)])
def test_bounds(make):
    with pytest.raises(p.InvalidParameter):
        make()


def test_spellings_and_blanks():
    assert p.one_spelling({"Linie": "U1", "line": "U1"}, "Linie", "Line", "line") == "U1"
    assert p.one_spelling({"line": ""}, "Linie", "line") is None
    with pytest.raises(p.InvalidParameter):
        p.one_spelling({"Linie": "U1", "line": "U2"}, "Linie", "line")
    assert p.filled({"a": 0, "b": None, "c": ""}) == {"a": 0}


def test_departures_and_boxes():
    asked = p.Departures.of({"Line": "U1", "Product": None, "TimeSpan": 60, "LimitCount": ""})
    assert asked == p.Departures(time_span=60, line="U1")
    assert p.Box.of((11.2, 49.35), (10.95, 49.5)) == p.Box((49.35, 10.95), (49.5, 11.2))
    assert p.Box.of(None, None) is None
    for bad in (lambda: p.Departures(time_span=0), lambda: p.Departures(time_delay=1441), lambda: p.Departures(limit_count=101), lambda: p.Box.of((1, 2), None), lambda: p.Box.of((1, 2), (1, 3)), lambda: p.Box.of((1, 2), (190, 3)), lambda: p.TracePage(limit=0)):
        with pytest.raises(p.InvalidParameter):
            bad()
