"""The stream form of the breaker keeps its days in few entries of the state, as each one read or written is a message."""

import pandas as pd

from tickerlake.streaming import ingest


class Entries(dict):
    """A map state and a value state."""

    writes = 0

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.writes += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        del self[key]

    def containsKey(self, key):  # noqa: N802
        return key in self

    def exists(self):
        return "value" in self

    def get(self):
        return self["value"]

    def update(self, value):
        self["value"] = value


class Handle:
    def __init__(self):
        self.map, self.value = Entries(), Entries()

    def getMapState(self, *_):  # noqa: N802
        return self.map

    def getValueState(self, *_):  # noqa: N802
        return self.value


def rows(first, n, close=10.0):
    days = pd.date_range("2020-01-01", periods=first + n)[first:].date
    return iter([pd.DataFrame({"trade_date": days, "close": close, "adj": close, "arrived": 0})])


def test_writes_and_forgotten_days():
    handle, days = Handle(), ingest._Days(300)
    days.init(handle)
    assert pd.concat(days.handleInputRows((1,), rows(0, 500), None)).breaker_ok.all()
    assert 0 < handle.map.writes <= 500 // ingest.CHUNK + 2
    handle.map.writes = 0
    assert list(pd.concat(days.handleInputRows((1,), rows(500, 1, 90.0), None)).breaker_ok) == [False]
    assert handle.map.writes <= 2  # the entry of the day, and that of the day that is forgotten
    late = pd.concat(days.handleInputRows((1,), rows(100, 1), None))
    assert list(late.late) == [True]
    again = pd.concat(days.handleInputRows((1,), rows(2000, 1), None))  # all others are forgotten, but not the reference
    assert list(again.breaker_ok) == [True] and len(handle.map) == 1
