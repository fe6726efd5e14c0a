"""Circuit breaker of each source over its run log, in batch and on a stream.

Three failures in a row open the breaker at the time of the third.  Once the cooldown since then is
over, the next look at it drops counter and opening time; failures meanwhile count but don't
open it anew.  A success drops both at once, an empty run records nothing.

In batch a log is cut into ranges of time by a range shuffle, so one source may fill many tasks.  Each
range is first summed up as a function from the state before it to the state behind it; these are
composed in order, a few short rows a source, and the ranges then run from the states they begin
in.  Only openings of the last cooldown before a range can end inside it, so its function has
as many pieces as it has runs in its first cooldown at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import cut

THRESHOLD, COOLDOWN = 3, 3600
#: Runs of one range in batch, about: what a task holds at once.
RANGE_RUNS = 50_000
#: Failures in a row, and microseconds of the opening (None: closed).
State = tuple[int, int | None]
CLOSED: State = (0, None)


def look(state: State, us: int, cooldown: int) -> State:
    """The state that a run at ``us`` finds: closed again if the cooldown is over."""
    return CLOSED if state[1] is not None and us - state[1] >= cooldown * 1_000_000 else state


def record(state: State, status: str, us: int, threshold: int) -> State:
    """The state after a run with that status."""
    if status == "success":
        return CLOSED
    if status != "error":
        return state
    failures = state[0] + 1
    return failures, us if failures >= threshold and state[1] is None else state[1]


def follow(state: State, us: Sequence[int], status: Sequence[str], threshold: int, cooldown: int) -> tuple[list[State], State]:
    """The state found by each run in order, and the one behind the last."""
    found = []
    for t, s in zip(us, status, strict=True):
        state = look(state, t, cooldown)
        found.append(state)
        state = record(state, s, t, threshold)
    return found, state


class Range:
    """The runs of one source in a range of time, as a function of states."""

    def __init__(self, us: np.ndarray, status: Sequence[str], threshold: int, cooldown: int):
        self.us, self.threshold, self.wait = us, threshold, cooldown * 1_000_000
        kinds = np.array(status, dtype=object)
        self.errors, self.successes = np.flatnonzero(kinds == "error"), np.flatnonzero(kinds == "success")
        #: The state behind the range if the breaker is closed and clear before run k.
        self.behind: list[State] = [CLOSED] * (len(us) + 1)
        for k in range(len(us) - 1, -1, -1):
            self.behind[k] = self._end(k, 0)

    def _end(self, k: int, failures: int) -> State:
        """Behind the range, from ``failures`` and closed before run k; later runs are known."""
        n = len(self.us)
        e, s = np.searchsorted(self.errors, k), np.searchsorted(self.successes, k)
        last = e + self.threshold - failures - 1
        opens = int(self.errors[last]) if last < len(self.errors) else n
        success = int(self.successes[s]) if s < len(self.successes) else n
        if success < opens:
            return self.behind[success + 1]
        if opens == n:
            return failures + len(self.errors) - int(e), None
        over = int(np.searchsorted(self.us, self.us[opens] + self.wait))
        over = max(over, opens + 1)
        if min(success, over) < n:
            return self.behind[success + 1] if success < over else self.behind[over]
        return failures + len(self.errors) - int(e), int(self.us[opens])

    def pieces(self) -> dict:
        """The function as short lists: ends for each count of failures, and for openings before the
        range the first run that finds the cooldown over, with the end from there."""
        first_success = int(self.successes[0]) if len(self.successes) else len(self.us)
        window = int(np.searchsorted(self.us, self.us[0] + self.wait))
        looked = range(min(first_success, window, len(self.us) - 1) + 1)
        closed_ends = [self._end(0, f) for f in range(self.threshold)]
        return {
            "closed_failures": [f for f, _ in closed_ends], "closed_opened": [o for _, o in closed_ends],
            "us": [int(self.us[k]) for k in looked], "failures": [self.behind[k][0] for k in looked], "opened": [self.behind[k][1] for k in looked],
            "success": first_success if first_success < len(self.us) else None, "errors": len(self.errors),
        }


def through(pieces: dict, state: State, cooldown: int) -> State:
    """The state behind a range that begins in ``state``."""
    failures, opened = state
    if opened is None:
        return pieces["closed_failures"][failures], pieces["closed_opened"][failures]
    over = [k for k, us in enumerate(pieces["us"]) if us - opened >= cooldown * 1_000_000][:1]
    if pieces["success"] is not None:
        over = [min([*over, int(pieces["success"])])]
    return (pieces["failures"][over[0]], pieces["opened"][over[0]]) if over else (failures + pieces["errors"], opened)


PIECES = (
    "source string, part int, closed_failures array<int>, closed_opened array<bigint>, us array<bigint>, failures array<int>, opened array<bigint>, "
    "success int, errors int"
)


def breaker_states(runs: DataFrame, threshold: int = THRESHOLD, reset_seconds: int = COOLDOWN, parts: int | None = None) -> DataFrame:
    """``runs`` (source, started_at, run_id, status, ...) with ``failures`` and ``open``: what each run finds.

    Rows in order of time and run_id; a null time comes first.  A null status records nothing.
    """
    us = F.coalesce(F.unix_micros(F.col("started_at").cast("timestamp")), F.lit(-(2**60))).alias("_us")
    order = ["source", "_us", "run_id"]
    timed = runs.select("*", us)
    # ranges grow in number with the log, not in size; a number that is given isn't coalesced
    ranged = timed.repartitionByRange(parts or max(runs.count() // RANGE_RUNS + 1, 16), *order)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()))

    def sum_up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_us", "run_id"])
        pieces = Range(rows["_us"].to_numpy(), rows["status"].tolist(), threshold, reset_seconds).pieces()
        return pd.DataFrame([{"source": rows["source"].iloc[0], "part": rows["_part"].iloc[0], **pieces}])

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = CLOSED, []
        for pieces in sorted(rows.to_dict("records"), key=lambda r: r["part"]):
            out.append((pieces["source"], pieces["part"], *state))
            pieces["success"] = None if pd.isna(pieces["success"]) else pieces["success"]
            listed = {k: [None if x is None or pd.isna(x) else int(x) for x in pieces[k]] for k in ("closed_failures", "closed_opened", "us", "failures", "opened")}
            state = through({**pieces, **listed}, state, reset_seconds)
        return pd.DataFrame(out, columns=["_s", "_p", "_failures", "_opened"]).astype({"_failures": "int32", "_opened": "Int64"})

    fields = [f for f in placed.schema.fields if not f.name.startswith("_")]
    schema = T.StructType([*fields, T.StructField("failures", T.LongType()), T.StructField("open", T.BooleanType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_us", "run_id"])
        opened = rows["_opened"].iloc[0]
        before = (int(rows["_failures"].iloc[0]), None if pd.isna(opened) else int(opened))
        found, _ = follow(before, rows["_us"].tolist(), rows["status"].tolist(), threshold, reset_seconds)
        return rows[[f.name for f in fields]].assign(failures=[f for f, _ in found], open=[o is not None for _, o in found])

    short = placed.select("source", "_part", "_us", "run_id", "status")
    begins = cut(short.groupBy("source", "_part").applyInPandas(sum_up, PIECES).groupBy("source").applyInPandas(compose, "_s string, _p int, _failures int, _opened bigint"))
    joined = placed.join(begins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))).drop("_s", "_p")
    return joined.groupBy("source", "_part").applyInPandas(run, schema)


STATE = "failures int, opened bigint"
OUTPUT = "source string, started_at timestamp, run_id long, failures long, open boolean"


def breaker_stream(runs: DataFrame, threshold: int = THRESHOLD, reset_seconds: int = COOLDOWN, late: str = "10 minutes") -> DataFrame:
    """The same on a stream (source, started_at timestamp, run_id, status): what each run finds.  A timer closes
    an open breaker when its cooldown is over and tells so by a row without run_id; the counter
    of a source that doesn't run any more is thus not kept.  Runs may be ``late`` by as much; needs
    the RocksDB state store."""
    from pyspark.sql.streaming import StatefulProcessor

    class Breaker(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.state = handle, handle.getValueState("breaker", STATE)

        def _read(self) -> State:
            return tuple(self.state.get()) if self.state.exists() else CLOSED

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            own = pd.concat(rows).sort_values(["started_at", "run_id"])
            us = (own["started_at"].astype("datetime64[us]")).astype("int64").tolist()
            before = self._read()
            found, state = follow(before, us, own["status"].tolist(), threshold, reset_seconds)
            if state[1] != before[1]:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                if state[1] is not None:
                    self.handle.registerTimer(state[1] // 1000 + reset_seconds * 1000)
            self.state.clear() if state == CLOSED else self.state.update(state)
            yield pd.DataFrame({
                "source": key[0], "started_at": own["started_at"], "run_id": own["run_id"], "failures": [f for f, _ in found], "open": [o is not None for _, o in found],
            })

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.state.clear()
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            yield pd.DataFrame({"source": [key[0]], "started_at": [at], "run_id": pd.array([None], dtype="Int64"), "failures": [0], "open": [False]})

        def close(self) -> None:
            pass

    timed = runs.withWatermark("started_at", late)
    return timed.groupBy("source").transformWithStateInPandas(Breaker(), OUTPUT, "Append", "EventTime")
