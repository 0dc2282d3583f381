"""Jobs folded as their events arrive: one state a job, kept by Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandweave.operators.jobs import TRANSITIONS


def state_changes(commands: DataFrame, job: str = "job") -> DataFrame:
    """(job, seq, state) for each command (job, seq, command) that changes its job's state, in order of seq within a micro-batch.

    A command whose seq is not beyond what the job has seen is stale and ignored.
    """
    kind = commands.schema[job].dataType.simpleString()

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, seen = state.get if state.exists else ("none", -1)
        rows = []
        for seq, command in pd.concat(list(parts))[["seq", "command"]].sort_values("seq").itertuples(index=False):
            if seq <= seen:
                continue
            seen = int(seq)
            to = TRANSITIONS.get((now, command))
            if to is not None:
                now = to
                rows.append((key[0], seen, now))
        state.update((now, seen))
        yield pd.DataFrame(rows, columns=[job, "seq", "state"])

    return commands.groupBy(job).applyInPandasWithState(fold, f"{job} {kind}, seq long, state string", "state string, seen long", "append", GroupStateTimeout.NoTimeout)


def progress_reports(events: DataFrame, job: str = "job", step: float = 0.005) -> DataFrame:
    """(job, pct): reports that advance a job's largest share by at least `step`, or complete it."""
    kind = events.schema[job].dataType.simpleString()

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (top,) = state.get if state.exists else (float("-inf"),)
        rows = []
        for pct in pd.concat(list(parts)).sort_values("seq")["pct"]:
            if pct - top >= step or pct >= 1.0 > top:
                top = float(pct)
                rows.append((key[0], top))
        state.update((top,))
        yield pd.DataFrame(rows, columns=[job, "pct"])

    return events.groupBy(job).applyInPandasWithState(fold, f"{job} {kind}, pct double", "top double", "append", GroupStateTimeout.NoTimeout)


def shared_throttle(events: DataFrame, job: str = "job", step: float = 0.005, pause: float = 0.25) -> DataFrame:
    """(job, ts, pct) of the reports (job, part, n_parts, ts, seq, pct) that pass one throttle shared by all parts of a job, in order of event time.

    A report's share of its part becomes one of the whole, (part + pct) / n_parts, and none falls back. It passes if it is `step` and `pause` seconds beyond the last that did, or completes the job. Reports wait in
    the job's state until the watermark (set by the caller) has passed them, and are then taken by ts and seq; those that come after it has passed go, and so do repeats of a seq that waits or was the last taken.
    """
    kind = events.schema[job].dataType.simpleString()

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        last_t, last_p, top, done, waiting = state.get if state.exists else (float("-inf"), float("-inf"), 0.0, [-1, -1], [])
        done, held = tuple(done), {(int(t), int(s)): float(p) for t, s, p in waiting}
        if not state.hasTimedOut:
            for p in parts:
                share = (p["part"] + p["pct"]) / p["n_parts"]
                for t, s, v in zip(p["ts"].astype("datetime64[us]").astype("int64"), p["seq"], share):
                    if t > mark and (int(t), int(s)) > done:
                        held[int(t), int(s)] = float(v)
        rows = []
        for t, s in sorted(k for k in held if k[0] <= mark):
            top, done = max(top, held.pop((t, s))), (t, s)
            if top >= 1.0 > last_p or (top - last_p >= step and t / 1e6 - last_t >= pause):
                last_t, last_p = t / 1e6, top
                rows.append((key[0], pd.Timestamp(t, unit="us"), top))
        state.update((last_t, last_p, top, list(done), [[float(t), float(s), v] for (t, s), v in sorted(held.items())]))
        if held:
            state.setTimeoutTimestamp(max(min(held)[0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[job, "ts", "pct"])

    return events.groupBy(job).applyInPandasWithState(fold, f"{job} {kind}, ts timestamp, pct double", "last_t double, last_p double, top double, done array<long>, waiting array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout)
