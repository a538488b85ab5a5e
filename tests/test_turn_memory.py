"""Turns of many keys in one group of the memory: few calls of its state, and each key's own history."""

import random

import pandas as pd

from strataforge.streaming import state as S


class State:
    def __init__(self, calls):
        self.values, self.calls = [], calls

    def appendValue(self, value):
        self.calls.append("append")
        self.values.append(value)

    def put(self, values):
        self.calls.append("put")
        self.values = list(values)

    def clear(self):
        self.calls.append("clear")
        self.values = []

    def get(self):
        self.calls.append("get")
        return iter(self.values)


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getListState(self, *_):
        return State(self.calls)

    def registerTimer(self, at):
        self.timers.append(at)


class Times:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_many_keys_a_group():
    r = random.Random(3)
    turns = [(r.choice([None, *(f"u{i}" for i in range(300))]), k, int(r.uniform(0, 400) * S.HOUR)) for k in range(4000)]
    memory, handle = S.TurnMemory(), Handle()
    memory.init(handle)
    got = {}
    for a, z in ((0, 130), (130, 131), (131, 400)):  # the hours of a micro-batch
        own = [t for t in turns if a * S.HOUR <= t[2] < z * S.HOUR]
        list(memory.handleInputRows((0,), iter([pd.DataFrame(own[:50], columns=["key", "id", "at"]), pd.DataFrame(own[50:], columns=["key", "id", "at"])]), None))
        for part in memory.handleExpiredTimer((0,), Times(z * S.HOUR // 1000), None):
            got |= {i: (k if isinstance(k, str) else None, list(h)) for k, i, h in zip(part["key"], part["id"], part["history"])}
    assert set(got) == set(range(4000))
    for k, i, at in turns:
        before = sorted((t[2], t[1]) for t in turns if t[0] == k and at - 24 * S.HOUR <= t[2] <= at)
        assert got[i] == (k, [x[1] for x in before][-6:])
    assert len(handle.calls) <= 3 * 6
    assert list(memory.handleExpiredTimer((0,), Times(500 * S.HOUR // 1000), None)) == [] and handle.calls[-2:] == ["clear", "clear"]
