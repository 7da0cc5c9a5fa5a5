"""Keyed state of the streams: processors with value and map state, timers on event time, and an end of every state.

A processor sees the rows of one key of a micro-batch, in frames, and holds only what it has to remember of the key.
Timers fire when the watermark passes them, also for keys without new rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom.operators import health

MS, US = 1000, 1_000_000


def _frame(rows: list[tuple], **kinds: str) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype=kind) for i, (name, kind) in enumerate(kinds.items())})


class Once(StatefulProcessor):
    """The first row of a key; rows less than ``ttl`` seconds after it are the same, the next one is a first row again.

    State: the time of the last first row. A timer takes it out when it can't hold back any row any more.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl * US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "us long")

    def _end(self, us: int) -> int:
        return (us + self.ttl) // MS + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = self.kept.get()[0] if self.kept.exists() else None, []
        for us in sorted(x for frame in rows for x in frame["us"].tolist()):
            if last is None or us - last >= self.ttl:
                last = us
                out.append((key[0], us))
        if out:
            self.kept.update((last,))
            self.handle.registerTimer(self._end(last))
            yield _frame(out, key="int64", us="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists() and self._end(self.kept.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


class Newest(StatefulProcessor):
    """Messages (epoch, seq, arrival, ms) of a sender that are in bounds and newer than its last one.

    State: that number and the sender's last time. A sender that is idle for ``idle`` ms leaves the state.
    """

    def __init__(self, skew: int, idle: int):
        self.skew, self.idle = skew, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "seq long, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, ms = self.last.get() if self.last.exists() else (-1, 0)
        fit = []
        for frame in rows:
            sane = frame[((frame["seq"] - frame["epoch"]).abs() <= self.skew) & (frame["seq"] > last)]
            fit += sane[["arrival", "epoch", "seq", "ms"]].itertuples(index=False, name=None)
        out = []
        for arrival, epoch, seq, at in sorted(fit):
            if seq > last:
                last, ms = seq, max(ms, at)
                out.append((key[0], epoch, seq, arrival))
        if out:
            self.last.update((int(last), int(ms)))
            self.handle.registerTimer(int(ms) + self.idle)
            yield _frame(out, sender="int64", epoch="int64", seq="int64", arrival="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[1] + self.idle <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """worker and opened_us of an item's leases that no completion closed within ``ttl`` seconds, from its transitions (worker,
    ts_us, what).

    State: the open lease. It times out when a later transition shows that its time is over, or else by a timer; an item
    without an open lease keeps no state.
    """

    def __init__(self, ttl: int):
        self.span = ttl * US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.lease = handle, handle.getValueState("lease", "opened long, worker long")

    def _end(self, opened: int) -> int:
        return (opened + self.span) // MS + 1

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        return _frame(rows, item="int64", worker="int64", opened_us="int64")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, worker = self.lease.get() if self.lease.exists() else (-1, -1)
        out, begun = [], False
        for ts, _, w, what in sorted((ts, i, w, what) for frame in rows for i, (w, ts, what) in enumerate(frame[["worker", "ts_us", "what"]].itertuples(index=False, name=None))):
            if opened >= 0 and ts - opened > self.span:
                out.append((key[0], worker, opened))
            opened, worker, begun = (ts, w, True) if what == "open" else (-1, -1, begun)
        if opened >= 0 and begun:
            self.lease.update((int(opened), int(worker)))
            self.handle.registerTimer(self._end(opened))
        elif opened < 0:
            self.lease.clear()
        if out:
            yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.lease.exists():
            opened, worker = self.lease.get()
            if self._end(opened) <= expiredTimerInfo.getExpiryTimeInMs():  # else it was opened anew
                self.lease.clear()
                yield self._out([(key[0], worker, opened)])

    def close(self) -> None:
        pass


class Reputation(StatefulProcessor):
    """The moving average of a target's observations (epoch, article_id, sender, score, weight), a row for each closed epoch.

    State: the average so far, and a map of the observations of open epochs: of each article and sender the lowest score,
    then the larger weight. A timer closes an epoch ``settle`` ms of event time after its end; its observations are folded
    in order of article and sender and leave the state. Observations of closed epochs are dropped and counted. The
    watermark is ``behind`` ms behind, so that they get here.
    """

    def __init__(self, alpha: float, prior: float, most: float, epoch: int, settle: int, behind: int):
        self.alpha, self.prior, self.most, self.epoch, self.settle, self.behind = alpha, prior, most, epoch, settle, behind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "value double, n long, late long, closed long, waiting long")
        self.seen = handle.getMapState("seen", "epoch long, article long, sender long", "score double, weight double")

    def _closing(self, epoch: int) -> int:
        """The watermark (ms) at which an epoch closes."""
        return max((epoch + 1) * self.epoch + self.settle - self.behind, 1)

    def _closed(self, watermark: int) -> int:
        """The newest epoch that a watermark has closed."""
        return (watermark + self.behind - self.settle) // self.epoch - 1 if watermark > 0 else -1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, n, late, closed, waiting = self.now.get() if self.now.exists() else (self.prior, 0, 0, -1, 0)
        limit, best = max(closed, self._closed(timerValues.getCurrentWatermarkInMs())), {}
        for frame in rows:
            sane = frame[frame["score"].between(0, 1) & (frame["weight"] > 0) & (frame["weight"] <= self.most)]
            late += int((sane["epoch"] <= limit).sum())
            for *name, score, weight in sane.loc[sane["epoch"] > limit, ["epoch", "article_id", "sender", "score", "weight"]].itertuples(index=False, name=None):
                name = tuple(map(int, name))
                best[name] = min(best.get(name, (score, -weight)), (score, -weight))
        for name, (score, negated) in best.items():
            if self.seen.containsKey(name):
                other, weight = self.seen.getValue(name)
                if (other, -weight) <= (score, negated):
                    continue
            else:
                waiting += 1
            self.seen.updateValue(name, (float(score), float(-negated)))
        for epoch in {name[0] for name in best}:
            self.handle.registerTimer(self._closing(epoch))
        self.now.update((float(value), int(n), int(late), int(closed), int(waiting)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, n, late, closed, waiting = self.now.get()
        limit, out = self._closed(timerValues.getCurrentWatermarkInMs()), []
        done = sorted((*name, *held) for name, held in (self.seen.iterator() if waiting else ()) if name[0] <= limit)
        for i, (epoch, article, sender, score, weight) in enumerate(done):
            a = min(1.0, self.alpha * weight)
            value, n, closed = (1 - a) * value + a * score, n + 1, max(closed, epoch)
            if i + 1 == len(done) or done[i + 1][0] != epoch:
                out.append((key[0], epoch, value, n, late))
            self.seen.removeKey((epoch, article, sender))
        if done:
            self.now.update((float(value), int(n), int(late), int(closed), int(waiting - len(done))))
            yield _frame(out, target="int64", epoch="int64", reputation="float64", n="int64", late="int64")

    def close(self) -> None:
        pass


class Health(StatefulProcessor):
    """A worker's health after each batch of its events (ts_s, seq, kind, value, ms).

    State: its fields and the worker's last time. A worker that is idle for ``idle`` ms leaves the state and starts anew.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.now = handle, handle.getValueState("now", f"{health.STATE}, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *fields, ms = self.now.get() if self.now.exists() else (*health.fresh().values(), 0)
        now = dict(zip(health.FIELDS, fields, strict=True))
        events = sorted((x for frame in rows for x in frame[["ts_s", "seq", "kind", "value", "ms"]].itertuples(index=False, name=None)), key=lambda x: x[:2])
        for ts, _, kind, value, at in events:
            if ms and at - ms >= self.idle:  # its timer is about to fire
                now = health.fresh()
            health.step(now, float(ts), kind, None if pd.isna(value) else float(value))
            ms = max(ms, at)
        row = tuple(float(now[f]) for f in health.FIELDS)
        self.now.update((*row, int(ms)))
        self.handle.registerTimer(int(ms) + self.idle)
        yield _frame([(key[0], *row)], worker="int64", **dict.fromkeys(health.FIELDS, "float64"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.now.exists() and self.now.get()[-1] + self.idle <= expiredTimerInfo.getExpiryTimeInMs():
            self.now.clear()
        yield from ()

    def close(self) -> None:
        pass
