"""Session lifecycle over a stream of touches: sums and sliding expiry in keyed state, archived by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Sessions in these states do not expire.
TERMINAL = ("committed", "abandoned")
ARCHIVED = "session_id string, repo_id string, outcome string, turns long, tool_calls long, tokens_est long, created_at timestamp, expires_at timestamp"
_STATE = "repo_id string, state string, created long, last long, turns long, calls long, tokens long"
_COLUMNS = [x.split()[0] for x in ARCHIVED.split(", ")]


def _ms(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[ns]").astype("int64") // 1_000_000


def archived_sessions(touches: DataFrame, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """One row for each session as it expires: ``ttl_seconds`` after its last touch, once the watermark is past that.

    Touches (session_id, repo_id, at, state, turns, tool_calls, tokens) are a stream; ``state`` is the session's new state
    or null. The row says in which state the session was left, with what its touches add up to: what a batch sweep at the
    watermark archives. Sessions left committed or abandoned give none. Touches later than ``late`` are ignored; one after a
    session's expiry opens it anew. State is one small row per open session and goes with it.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def told(s: tuple) -> Iterator[pd.DataFrame]:
            repo, now, created, last, turns, calls, tokens = s
            if now not in TERMINAL:
                at = [pd.Timestamp(x, unit="ms") for x in (created, last + ttl_seconds * 1000)]
                yield pd.DataFrame([(key[0], repo, now, turns, calls, tokens, *at)], columns=_COLUMNS)

        if state.hasTimedOut:
            s = state.get
            state.remove()
            yield from told(s)
            return
        rows = pd.concat(list(frames)).assign(ms=lambda t: _ms(t["at"])).sort_values("ms", kind="stable")
        s = state.get if state.exists else None
        for r in rows.itertuples():
            if s is not None and r.ms >= s[3] + ttl_seconds * 1000:
                yield from told(s)
                s = None
            repo, now, created, last, turns, calls, tokens = s or (None, "begun", r.ms, r.ms, 0, 0, 0)
            s = (r.repo_id or repo, r.state if isinstance(r.state, str) else now, created, max(last, r.ms), turns + int(r.turns), calls + int(r.tool_calls), tokens + int(r.tokens))
        expires = s[3] + ttl_seconds * 1000
        if expires <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield from told(s)
        else:
            state.update(s)
            state.setTimeoutTimestamp(expires)

    rows = touches.select("session_id", "repo_id", "at", "state", "turns", "tool_calls", "tokens").withWatermark("at", late)
    return rows.groupBy("session_id").applyInPandasWithState(step, ARCHIVED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
