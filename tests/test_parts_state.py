"""The calls that the state of a video in parts gets."""

from pyspark.sql import Row

from transcript_jobs.streaming import arrivals


class Handle:
    """A state of one video, with the calls that it got."""

    def __init__(self):
        self.calls, self.kept, self.timers = [], {}, []

    def getMapState(self, *_):
        return self

    def iterator(self):
        return iter([((k,), v) for k, v in self.kept.items()])

    def updateValue(self, key, value):
        self.calls.append("update")
        self.kept[key[0]] = value

    def clear(self):
        self.calls.append("clear")
        self.kept.clear()

    def listTimers(self):
        self.calls.append("list")
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return 5


def part(i: int, parts: int = 2, at: int = 0, line: str = "x"):
    when = {"modified": 1_600_000_000_000_000, "file": "f", "n": at}
    return Row(file="f", line=line, video_id="v", part=i, parts=parts, reason=None, at=when)


def test_calls_of_the_state():
    handle = Handle()
    state = arrivals.Parts(10)
    state.init(handle)
    give = lambda *rows: [(r["part"], r["line"], r["reason"]) for r in state.handleInputRows(("v",), iter(rows), handle)]
    assert give(part(1), part(0)) == [(0, "x", None), (1, "x", None)] and handle.calls == []  # whole at once: no state
    assert give(part(1)) == [] and handle.calls == ["update", "register"] and handle.timers == [15]
    handle.calls.clear()
    assert give(part(1, at=9, line="later"), part(1, at=3, line="between")) == [] and handle.kept[1][1] == "later" and handle.timers == [15]
    assert give(part(1, at=4, line="older")) == [] and handle.kept[1][1] == "later"
    assert give(part(0)) == [(0, "x", None), (1, "later", None)] and not handle.kept and not handle.timers
    assert give(part(0)) == [] and give(part(2, parts=3)) == [] and list(handle.kept) == [2]  # another number of parts begins anew
    assert [r["reason"] for r in state.handleExpiredTimer(("v",), handle, None)] == ["parts are missing"] and not handle.kept
