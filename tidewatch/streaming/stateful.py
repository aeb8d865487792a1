"""Flow state kept in a stream: absence, settling files, alerts and short-lived warnings.

State is kept per flow, or per file of a flow, in RocksDB. Results do not depend on how rows fall
into batches, as long as none comes after the watermark has passed it. A trigger's rows of one key
are put in order, held as a few numbers each; changes of tables need no order. State is read and
written once for a key and trigger, as each access asks the JVM.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000


def prepared(spark) -> None:
    """What stateful processors need of a session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # the processors travel with the query, so executors need not have this package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _as_micros(rows: DataFrame, *names: str) -> DataFrame:
    """Instants as whole microseconds, the same in rows and in state whatever the zone.

    The timestamps stay where they are: one of them may carry the watermark.
    """
    return rows.withColumns({f"{n}_us": F.unix_micros(n) for n in names})


def _as_instants(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.timestamp_micros(n) for n in names})


# stands for a missing whole number
NOTHING = -(2**63)


class Ordered:
    """The rows of one key by ``order``, names of whole numbers; missing ones come first.

    A row takes some bytes for each number and for a code of its other values, which are few
    different ones, instead of an object with objects for all of its columns.
    """

    def __init__(self, rows: Iterable[Row], order: Sequence[str], numbers: Sequence[str], others: Sequence[str]) -> None:
        self.numbers = [array("q") for _ in numbers]
        self.codes, known = array("q"), {}
        for row in rows:
            for held, name in zip(self.numbers, numbers):
                value = getattr(row, name)
                held.append(NOTHING if value is None else value)
            self.codes.append(known.setdefault(tuple(getattr(row, n) for n in others), len(known)))
        self.others = list(known)
        columns = dict(zip(numbers, self.numbers))
        self.places = np.lexsort([np.frombuffer(columns[n], np.int64) for n in reversed(order)])

    def __iter__(self) -> Iterator[tuple]:
        """Tuples of the numbers, then of the others."""
        for place in self.places:
            found = (held[place] for held in self.numbers)
            yield *(None if v == NOTHING else v for v in found), *self.others[self.codes[place]]


class Absence(StatefulProcessor):
    """Raises late and still-running flows once for each gap that time or a later report shows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState(
            "seen",
            "last_ok long, at long, id long, running boolean, expected long, max_runtime long,"
            " late_said boolean, stuck_said boolean",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.seen.get() if self.seen.exists() else (None, None, -1, False, 0, None, False, False)
        last_ok, at, number, running, expected, max_runtime, late_said, stuck_said = old
        numbers = ["at_us", "id", "expected_seconds", "max_runtime_s"]
        for at_us, row_id, expects, may_run, outcome in Ordered(rows, ["at_us", "id"], numbers, ["outcome"]):
            for due, state, since in self._deadlines(last_ok, at, running, expected, max_runtime, late_said, stuck_said):
                if due < at_us:
                    yield self._raised(key, due, state, since)
                    late_said, stuck_said = late_said or state == "late", stuck_said or state == "failed"
            expected, max_runtime = expects, may_run
            if outcome == "ok" and (last_ok is None or at_us > last_ok):
                last_ok, late_said = at_us, False
            if at is None or (at_us, row_id) > (at, number):
                at, number, running, stuck_said = at_us, row_id, outcome == "start", False
        self.seen.update((last_ok, at, number, running, expected, max_runtime, late_said, stuck_said))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for due, _, _ in self._deadlines(last_ok, at, running, expected, max_runtime, late_said, stuck_said):
            self.handle.registerTimer(due // 1000)

    @staticmethod
    def _deadlines(last_ok, at, running, expected, max_runtime, late_said, stuck_said) -> list[tuple[int, str, int]]:
        """What is still to be said if no report comes: when, which state, and since when."""
        found = []
        if last_ok is not None and not late_said:
            found.append((last_ok + expected * SECOND, "late", last_ok))
        if running and max_runtime is not None and not stuck_said:
            found.append((at + max_runtime * SECOND, "failed", at))
        return found

    @staticmethod
    def _raised(key, due: int, state: str, since: int) -> Row:
        # timers have whole milliseconds
        return Row(flow=key[0], due_at=due // 1000 * 1000, state=state, since=since)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = list(self.seen.get())
        last_ok, at, _, running, expected, max_runtime, late_said, stuck_said = held
        now = expiredTimerInfo.getExpiryTimeInMs()
        for due, state, since in self._deadlines(last_ok, at, running, expected, max_runtime, late_said, stuck_said):
            if due // 1000 == now:
                held[6 if state == "late" else 7] = True
                yield self._raised(key, due, state, since)
        self.seen.update(tuple(held))

    def close(self) -> None:
        pass


def absence(reports: DataFrame, time_mode: str = "ProcessingTime") -> DataFrame:
    """(flow, due_at, state, since) over ``(flow, id, at, outcome, expected_seconds, max_runtime_s)``.

    ``expected_seconds`` is the interval and the grace. Processing time raises a flow even when
    nothing at all arrives any more; event time needs a watermark on ``at`` and can be replayed.
    Each gap between neighbouring reports that is too long gives one row, and so does the open one
    after the last report.
    """
    prepared(reports.sparkSession)
    raised = _as_micros(reports, "at").groupBy("flow").transformWithState(
        statefulProcessor=Absence(),
        outputStructType="flow string, due_at long, state string, since long",
        outputMode="Append",
        timeMode=time_mode,
    )
    return _as_instants(raised, "due_at", "since")


class Settle(StatefulProcessor):
    """Counts a file once its size and time were the same on two polls in a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState(
            "before",
            "poll long, size long, modified long, first_seen long, counted boolean",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = []
        old = self.before.get() if self.before.exists() else None
        # one row per poll: a trigger brings few of them
        for row in sorted(rows, key=lambda r: r.poll):
            if old is not None and old[0] != row.poll - 1:
                old = None
            same = old is not None and (old[1], old[2]) == (row.size, row.modified_us)
            inherited = row.baseline and row.poll == 1
            settled = inherited or same
            first_seen = row.poll_at_us if old is None else old[3]
            counted = inherited or (same and old[4])
            arrived = settled and not counted and row.size > 0
            old = (row.poll, row.size, row.modified_us, first_seen, settled or counted)
            if arrived:
                found.append(
                    Row(
                        flow=key[0],
                        at=first_seen,
                        detail=row.name,
                        bytes=float(row.size),
                        poll_at=row.poll_at_us,
                    )
                )
        self.before.update(old)
        return iter(found)

    def close(self) -> None:
        pass


def settled_files(listings: DataFrame) -> DataFrame:
    """(flow, at, detail, bytes, poll_at) over ``(flow, key, name, poll, poll_at, size, modified, baseline)``.

    ``poll`` counts the successful polls of a flow from 1. Keyed by flow and file, so a flow
    with many files is spread over many keys.
    """
    prepared(listings.sparkSession)
    rows = _as_micros(listings, "poll_at", "modified").select(
        "flow", "key", "name", "poll", "poll_at_us", "size", "modified_us", "baseline"
    )
    arrived = rows.groupBy("flow", "key").transformWithState(
        statefulProcessor=Settle(),
        outputStructType="flow string, at long, detail string, bytes double, poll_at long",
        outputMode="Append",
        timeMode="None",
    )
    return _as_instants(arrived, "at", "poll_at")


# fixed values, also in tidewatch.functions.scalars for columns
ATTENTION = frozenset(["warning", "late", "failed"])


class Alerting(StatefulProcessor):
    """Remembers what each flow was last alerted as, and says each change once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alerted = handle.getValueState("alerted", "state string, silenced_until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, silent = self.alerted.get() if self.alerted.exists() else ("pending", None)
        numbers, order = ["at_us", "rank", "id", "until_us"], ["at_us", "rank", "id"]
        for at, _, number, until, kind, now, delivered in Ordered(rows, order, numbers, ["kind", "state", "delivered"]):
            if silent is not None and silent <= at:
                state, silent = "pending", None
            if kind == "silence":
                silent = until
            elif kind == "unsilence":
                state, silent = "pending", None
            elif now != "maintenance" and silent is None and now != state:
                attention = now in ATTENTION
                recovery = now == "ok" and state in ATTENTION
                if attention or recovery:
                    decision = "alert" if attention else "recovery"
                    yield Row(id=number, flow=key[0], at=at, state=now, decision=decision)
                if delivered or not (attention or recovery):
                    state = now
        self.alerted.update((state, silent))

    def close(self) -> None:
        pass


def alerting(stream: DataFrame) -> DataFrame:
    """(id, flow, at, state, decision) of alerts and recoveries.

    Over ``(kind, id, flow, at, state, delivered, until)``, where kind is evaluation, silence
    or unsilence. The checkpoint is what makes each alert go out once.
    """
    prepared(stream.sparkSession)
    # ends of silences come before their starts, and both before evaluations
    rank = F.when(F.col("kind") == "unsilence", 0).when(F.col("kind") == "silence", 1).otherwise(2)
    rows = _as_micros(stream, "at", "until").select(
        "flow", "at_us", rank.alias("rank"), "id", "until_us", "kind", "state", "delivered"
    )
    said = rows.groupBy("flow").transformWithState(
        statefulProcessor=Alerting(),
        outputStructType="id long, flow string, at long, state string, decision string",
        outputMode="Append",
        timeMode="None",
    )
    return _as_instants(said, "at")


class Fresh(StatefulProcessor):
    """Shows each change of a table, and takes it back when it is a day old."""

    def __init__(self, shown_seconds: int) -> None:
        self.shown = shown_seconds * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # changes by the millisecond they are taken back in, numbered within it
        self.held = handle.getMapState("held", "due long, number int", "changed_at long, change string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            due, number = (row.changed_at_us + self.shown) // 1000, 0
            while self.held.containsKey((due, number)):
                number += 1
            self.held.updateValue((due, number), (row.changed_at_us, row.change))
            self.handle.registerTimer(due)
            yield Row(flow=key[0], table_name=key[1], at=row.changed_at_us, change=row.change, shown=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, number = expiredTimerInfo.getExpiryTimeInMs(), 0
        while self.held.containsKey((due, number)):
            changed_at, change = self.held.getValue((due, number))
            self.held.removeKey((due, number))
            number += 1
            yield Row(flow=key[0], table_name=key[1], at=changed_at + self.shown, change=change, shown=False)

    def close(self) -> None:
        pass


def fresh_changes(
    changes: DataFrame, shown_seconds: int = 86_400, time_mode: str = "ProcessingTime"
) -> DataFrame:
    """(flow, table_name, at, change, shown): a change appears, and disappears a day later."""
    prepared(changes.sparkSession)
    rows = _as_micros(changes, "changed_at")
    shown = rows.groupBy("flow", "table_name").transformWithState(
        statefulProcessor=Fresh(shown_seconds),
        outputStructType="flow string, table_name string, at long, change string, shown boolean",
        outputMode="Append",
        timeMode=time_mode,
    )
    return _as_instants(shown, "at")
