"""Run states as a stream: which state may follow which, and runs that fall silent end by a timer of event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heddle.operators.health import NEXT
from heddle.streaming.admission import SETTINGS

#: Seconds after which a run that says nothing has failed, and that events may come late.
SILENCE, LATE = 1800, "10 minutes"
OUT = "run_id string, id long, state string, at long, before string, allowed boolean, late boolean"


class RunStates(StatefulProcessor):
    """The state that each run is in, when it was last heard of, and a timer for its silence."""

    def __init__(self, seconds: int, follows: dict[str, list[str]]):
        self.silence, self.follows = 1000 * seconds, follows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "state string, at long, id long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = at = number = timer = None
        if self.run.exists():
            state, at, number, timer = self.run.get()
        for r in sorted(rows, key=lambda r: (r.at, r.id)):
            late = at is not None and (r.at, r.id) < (at, number)
            allowed = not late and r.state in (["queued"] if state is None else self.follows.get(state, []))
            yield Row(run_id=key[0], id=r.id, state=r.state, at=r.at, before=state, allowed=allowed, late=late)
            if not late:
                at, number = r.at, r.id
                state = r.state if allowed else state
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = at + self.silence
        open_ = state in self.follows
        if open_:
            self.handle.registerTimer(timer)
        self.run.update((state, at, number, timer if open_ else None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, _, number, timer = self.run.get()
        self.run.update(("failed", timer, number, None))
        yield Row(run_id=key[0], id=None, state="failed", at=timer, before=state, allowed=True, late=False)

    def close(self) -> None:
        pass


def run_states(events: DataFrame, silence: int = SILENCE, late: str = LATE) -> DataFrame:
    """OUT of a stream of events (run_id string, id long, state, happened timestamp): each with the state before it and whether it may follow.

    An event that may not follow leaves the run where it is. One that happened before what
    was seen of its run is late and changes nothing; one that comes after the watermark
    has passed it is dropped. A run that is neither done nor heard of for silence seconds
    of event time fails at that time. Needs the settings of admission.SETTINGS for its state.
    """
    rows = events.withWatermark("happened", late).withColumn("at", F.unix_millis("happened"))
    return rows.groupBy("run_id").transformWithState(RunStates(silence, NEXT), OUT, "Append", "EventTime")


PROVIDER = {k: v for k, v in SETTINGS.items() if k.endswith("providerClass")}
