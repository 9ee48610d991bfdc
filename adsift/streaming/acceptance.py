"""Greedy acceptance as keyed state with event-time timers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship

ship(__name__)

AT, LATE = "_at", "_late"


class Acceptance(StatefulProcessor):
    """At most `limit` accepted rows of a key within any `span` microseconds, decided in time order.

    Rows wait in the key's state until a timer tells that the watermark has passed them. `taken` holds the accepted rows of
    one span; a further timer removes them, so the state of a key that falls silent goes away. Rows behind the
    watermark, and rows without a time, come out at once and are marked late.
    """

    def __init__(self, schema: T.StructType, uid: str, span: int, limit: int):
        self.schema, self.uid, self.span, self.limit = schema, uid, span, limit
        self.names = [f.name for f in schema.fields if f.name != AT]
        self.kept = T.StructType([T.StructField("at", T.LongType()), T.StructField("uid", schema[uid].dataType)])

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.taken = handle.getListState("taken", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = []
        for row in rows:
            if row[AT] is None or row[AT] < mark:
                yield self._out(row, None, None, True)
            else:
                fresh.append(tuple(row[f.name] for f in self.schema.fields))
        if fresh:
            self.waiting.appendList(fresh)
            at = self.schema.names.index(AT)
            self._wake(min(row[at] for row in fresh))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [Row(**dict(zip(self.schema.names, row, strict=True))) for row in self.waiting.get()]
        due = sorted((row for row in held if row[AT] < mark), key=lambda row: (row[AT], row[self.uid]))
        taken = deque(tuple(x) for x in self.taken.get())
        last = taken[-1][1] if taken else None
        for row in due:
            while taken and row[AT] - taken[0][0] >= self.span:
                taken.popleft()
            accepted = len(taken) < self.limit
            if accepted:
                taken.append((row[AT], row[self.uid]))
                last = row[self.uid]
            yield self._out(row, accepted, last, False)
        while taken and mark - taken[0][0] >= self.span:
            taken.popleft()
        rest = [tuple(row) for row in held if row[AT] >= mark]
        for state, values in ((self.waiting, rest), (self.taken, list(taken))):
            if values:
                state.put(values)
            else:
                state.clear()
        if rest:
            self._wake(min(row[self.schema.names.index(AT)] for row in rest))
        elif taken:
            self._wake(taken[-1][0] + self.span)

    def close(self) -> None:
        pass

    def _wake(self, at: int) -> None:
        """When the watermark is beyond this time."""
        self.handle.registerTimer(at // 1000 + 1)

    def _out(self, row, accepted, origin, late) -> Row:
        return Row(**{c: row[c] for c in self.names}, accepted=accepted, origin=origin, **{LATE: late})
