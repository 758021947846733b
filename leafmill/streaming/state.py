"""Stateful processors: one small state for each key, which event-time timers end.

Moments are microseconds.  A key has at most one timer that counts; deadlines only move on, and
where one has, the timer is set again when it fires, so a row costs no timer call of its own.  A
state goes as soon as the watermark shows that no later row can need it, so what is kept
follows the keys that are alive, not all that were ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leafmill.operators.pages import TERMINAL, TRANSITIONS
from leafmill.operators.sequence import greedy


def column(frames: list[pd.DataFrame], name: str) -> np.ndarray:
    return np.concatenate([f[name].to_numpy() for f in frames])


class Timed(StatefulProcessor):
    """A state with a deadline; subclasses say what rows do to it and what its end gives.

    ``fields`` are the state's, ``columns`` those of the output.
    """

    fields: str
    columns: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.fields}, timer long")

    def rows(self, key: tuple, frames: list[pd.DataFrame], state: tuple | None) -> tuple[tuple | None, int, dict]:
        """New state (or None), its deadline, and output columns."""
        raise NotImplementedError

    def due(self, key: tuple, state: tuple, now: int) -> tuple[tuple | None, int, dict]:
        """The same for a state whose timer has fired at watermark ``now``."""
        raise NotImplementedError

    def _keep(self, new: tuple | None, deadline: int, timer: int | None) -> None:
        if new is None:
            self.state.clear()
            return
        if timer is None:
            timer = -(-deadline // 1000)
            self.handle.registerTimer(timer)
        self.state.update((*new, timer))

    def _frame(self, out: dict) -> Iterator[pd.DataFrame]:
        if out and len(next(iter(out.values()))):
            yield pd.DataFrame(out, columns=list(self.columns))

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get() if self.state.exists() else None
        new, deadline, out = self.rows(key, list(rows), held[:-1] if held else None)
        self._keep(new, deadline, held[-1] if held else None)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.state.get() if self.state.exists() else None
        if not held or held[-1] != expiredTimerInfo.getExpiryTimeInMs():
            return  # the timer of a state that has gone
        new, deadline, out = self.due(key, held[:-1], timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(new, deadline, None)
        yield from self._frame(out)

    def close(self) -> None:
        pass


class Stale(Timed):
    """Tasks without a sign of life for ``timeout``: told at the next sign, or by the timer if none comes."""

    fields, columns = "last long", ("task_id", "stale_from")

    def __init__(self, timeout: int):
        self.timeout = timeout

    def rows(self, key, frames, state):
        at = column(frames, "at")
        at = np.unique(at if state is None else np.append(at[at >= state[0]], state[0]))
        silent = at[:-1][np.diff(at) > self.timeout]
        last = int(at[-1])
        return (last,), last + self.timeout, {"task_id": [key[0]] * len(silent), "stale_from": silent}

    def due(self, key, state, now):
        deadline = state[0] + self.timeout
        if deadline > now:
            return state, deadline, {}
        return None, 0, {"task_id": [key[0]], "stale_from": [state[0]]}


class Persisting(Timed):
    """Alerts of conditions that hold for ``hold``; a condition lasts until a tick denies it or none comes for ``absent``."""

    fields, columns = "since long, last long, fired boolean", ("series", "since")

    def __init__(self, hold: int, absent: int):
        self.hold, self.absent = hold, absent

    def _deadline(self, state: tuple) -> int:
        since, last, fired = state
        return last + self.absent if fired else min(since + self.hold, last + self.absent)

    def rows(self, key, frames, state):
        at, firing = column(frames, "at"), column(frames, "firing").astype(bool)
        if state is not None:
            new = at > state[1]
            at, firing = np.append(at[new], state[1]), np.append(firing[new], True)
        t, of = np.unique(at, return_inverse=True)
        holds = np.ones(len(t), dtype=bool)
        np.logical_and.at(holds, of, firing)  # every tick of a moment has to say so
        gap = np.append(True, np.diff(t) > self.absent)
        before = np.append(False, holds[:-1])
        first = np.flatnonzero(holds & (gap | ~before))
        if not len(first):
            return None, 0, {}
        ends = np.append(holds[:-1] & (~holds[1:] | gap[1:]), holds[-1:])
        last = np.flatnonzero(ends)
        since, until = t[first].copy(), t[last] + self.absent
        told = np.zeros(len(first), dtype=bool)
        if state is not None and first[0] == 0:
            since[0], told[0] = state[0], state[2]
        followed = last + 1 < len(t)
        until[followed] = np.minimum(until[followed], t[last[followed] + 1])
        ready = since + self.hold < until
        ready[~followed] &= (since + self.hold <= t[last])[~followed]  # the rest is the timer's
        fires = ready & ~told
        out = {"series": [key[0]] * int(fires.sum()), "since": since[fires]}
        if followed[-1]:
            return None, 0, out
        now = (int(since[-1]), int(t[last[-1]]), bool(told[-1] or fires[-1]))
        return now, self._deadline(now), out

    def due(self, key, state, now):
        since, last, fired = state
        out = {}
        if not fired and since + self.hold <= now and since + self.hold < last + self.absent:
            fired, out = True, {"series": [key[0]], "since": [since]}
        state = (since, last, fired)
        return (None, 0, out) if last + self.absent <= now else (state, self._deadline(state), out)


class Cooldown(Timed):
    """recorded, skipped_unknown, skipped_resolved or skipped_cooldown for every trigger of a type."""

    fields, columns = "last long", ("trigger_id", "outcome")

    def __init__(self, known: tuple[str, ...], apart: int):
        self.known, self.apart = known, apart

    def rows(self, key, frames, state):
        ids, at, resolved = (column(frames, c) for c in ("trigger_id", "at", "resolved"))
        last = state[0] if state else None
        if key[0] not in self.known:
            return None, 0, {"trigger_id": ids, "outcome": ["skipped_unknown"] * len(ids)}
        outcome = np.where(resolved.astype(bool), "skipped_resolved", "skipped_cooldown").astype(object)
        live = np.flatnonzero(~resolved.astype(bool))
        live = live[np.lexsort((ids[live], at[live]))]
        kept = live[greedy(at[live], self.apart, last)]
        outcome[kept] = "recorded"
        last = int(at[kept[-1]]) if len(kept) else last
        out = {"trigger_id": ids, "outcome": outcome}
        return (None, 0, out) if last is None else ((last,), last + self.apart, out)

    def due(self, key, state, now):
        deadline = state[0] + self.apart
        return (state, deadline, {}) if deadline > now else (None, 0, {})


_MOVES = frozenset(f"{a}>{b}" for a, to in TRANSITIONS.items() for b in to)


class PageState(Timed):
    """Compare and swap of a page's state; a page without events for ``idle`` is forgotten, and an event after that finds it queued."""

    fields, columns = "now string, last long", ("page_id", "seq", "applied", "state", "completed")

    def __init__(self, idle: int):
        self.idle = idle

    def rows(self, key, frames, state):
        seq, at, expected, target = (column(frames, c) for c in ("seq", "at", "expected", "target"))
        order = np.argsort(seq, kind="stable")
        now, last = state or ("queued", int(at[order[0]]))
        seen = np.maximum.accumulate(np.append(last, at[order]))
        anew = at[order] > seen[:-1] + self.idle
        applied, states, done = np.zeros(len(seq), dtype=bool), np.empty(len(seq), dtype=object), 0
        moves = [i for i, k in enumerate(order.tolist()) if anew[i] or f"{expected[k]}>{target[k]}" in _MOVES]
        for i in moves:  # only these can change anything
            k, before = order[i], "queued" if anew[i] else now
            applied[i] = expected[k] == before and f"{before}>{target[k]}" in _MOVES
            states[done:i] = now
            now, done = target[k] if applied[i] else before, i
        states[done:] = now
        last = int(seen[-1])
        out = {"page_id": [key[0]] * len(seq), "seq": seq[order], "applied": applied, "state": states, "completed": np.isin(states.astype(str), list(TERMINAL))}
        return (now, last), last + self.idle, out

    def due(self, key, state, now):
        deadline = state[1] + self.idle
        return (state, deadline, {}) if deadline > now else (None, 0, {})
