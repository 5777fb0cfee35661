"""Per-session track state with delayed emission, in batch and as a Structured Streaming query.

Rows are (session, frame, track, score) and, where known, det (the detection that the track is matched
to), unmatched and empty.  Without a det column each row stands for a detection of its own; a frame of
no track is a row with a null track.  One ``Session`` holds the rules for both modes:

- a track starts with a keep-alive of ``init``; a later match adds one up to ``most``, a frame in which
  it is unmatched takes one down to ``least``.  Unmatched are known tracks that are flagged so, even if
  matched, and those with neither a detection nor an ``empty`` flag; an empty one loses one if
  ``empty_costs``;
- a track first seen within the last ``delay`` frames is removed once it was unmatched in
  ``unmatched`` frames, or once it shared its detection with the same earlier track in ``duplicates`` frames;
- a track is hidden while its keep-alive is at most 0, if it was ever unmatched and ``only_within``
  doesn't confine the rules to the first frames;
- a track is confirmed after ``confirm`` consecutive frames with a detection and stays so;
- frames leave a buffer of ``delay`` frames, oldest first, without the tracks that are removed by
  then; what is left is flushed when the session ends: with a row of frame -1 in a stream, or when
  nothing came for the time given.

A row with a ``command`` controls its session before the other rows of its frame: ``remove`` takes a
track away for good, ``cancel`` drops what the buffer holds, ``reset`` forgets the session's tracks and
frames.  A frame of commands alone is no frame.

A frame at or below the last one of its session is late: it changes nothing and comes out as late.
State is of the size of a session's tracks and buffer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "session string, frame bigint, track string, score double, confirmed boolean, hidden boolean, late boolean"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


@dataclass(frozen=True)
class Rules:
    """Thresholds; the defaults are those of the source."""

    init: int = 0
    most: int = 8
    least: int = -4
    delay: int = 0
    unmatched: int = 3
    duplicates: int = 3
    confirm: int = 3
    only_within: bool = True
    empty_costs: bool = False


class Session:
    def __init__(self, rules: Rules, state: str | None = None):
        told = json.loads(state) if state else {}
        self.rules, self.last, self.buffer = rules, told.get("last", -1), told.get("buffer", [])
        self.alive, self.first, self.missed, self.run, self.shared = (told.get(k, {}) for k in ("alive", "first", "missed", "run", "shared"))
        self.sure, self.gone = set(told.get("sure", [])), set(told.get("gone", []))

    def state(self) -> str:
        return json.dumps({k: sorted(v) if isinstance(v, set) else v for k, v in self.__dict__.items() if k != "rules"})

    def control(self, command: str, track: str | None) -> None:
        """Take one command; unknown ones change nothing."""
        if command == "remove":
            self.gone.add(track)
        elif command == "cancel":
            self.buffer.clear()
        elif command == "reset":
            self.__init__(self.rules)

    def take(self, frame: int, rows: list[tuple]) -> Iterator[tuple]:
        """A frame's rows (track, score, det, unmatched, empty, command): commands, then what was seen."""
        for track, *_, command in rows:
            if command is not None:
                self.control(command, track)
        if any(r[-1] is None for r in rows):
            yield from self.step(frame, [r[:-1] for r in rows if r[-1] is None and r[0] is not None])

    def step(self, frame: int, seen: list[tuple]) -> Iterator[tuple]:
        """Take one frame of (track, score, det, unmatched, empty); give the rows that leave the buffer."""
        if frame <= self.last:
            for track, score, *_ in seen:
                yield frame, track, score, False, False, True
            return
        self.last, r = frame, self.rules
        seen = [s for s in seen if s[0] not in self.gone]
        known = set(self.first) - self.gone
        for track, *_ in seen:
            if track not in self.first:
                self.first[track], self.alive[track], self.missed[track], self.run[track] = frame, r.init, 0, 0
        by_det: dict = {}
        for track, _, det, _, _ in seen:
            if det is not None and track in known:
                by_det.setdefault(det, set()).add(track)
        matched = set().union(*by_det.values())
        empty = {s[0] for s in seen if s[4]} & known
        lost = (known - matched - empty) | ({s[0] for s in seen if s[3]} & known)
        for track in matched:
            self.alive[track] = min(r.most, self.alive[track] + 1)
        for track in lost:
            self.missed[track] += 1
            self.alive[track] = max(r.least, self.alive[track] - 1)
        for track in empty if r.empty_costs else ():
            self.alive[track] = max(r.least, self.alive[track] - 1)
        found = matched | (set(self.first) - known - self.gone)
        for track in set(self.first) - self.gone:
            self.run[track] = self.run[track] + 1 if track in found else 0
        self.sure |= {t for t in found if self.run[t] >= r.confirm}
        young = {t for t in self.first if self.first[t] > frame - r.delay}
        self.gone |= {t for t in young if self.missed[t] >= r.unmatched}
        for mates in by_det.values():
            head = min(mates, key=lambda t: (self.first[t], t))
            for track in mates - {head}:
                counts = self.shared.setdefault(track, {})
                counts[head] = counts.get(head, 0) + 1
        self.gone |= {t for t in young & set(self.shared) if max(self.shared[t].values()) >= r.duplicates}
        hides = lambda t: not r.only_within and self.alive[t] <= 0 and self.missed[t] > 0
        self.buffer.append([frame, sorted([s[0], s[1], hides(s[0])] for s in seen)])
        if len(self.buffer) > r.delay:
            yield from self._leave()

    def _leave(self) -> Iterator[tuple]:
        frame, tracks = self.buffer.pop(0)
        for track, score, hidden in tracks:
            if track not in self.gone:
                yield frame, track, score, track in self.sure, hidden, False

    def flush(self) -> Iterator[tuple]:
        while self.buffer:
            yield from self._leave()


def _typed(rows: DataFrame) -> DataFrame:
    det = "CAST(det AS STRING) det" if "det" in rows.columns else "CAST(track AS STRING) det"
    flags = [f"coalesce({c}, false) {c}" if c in rows.columns else f"false {c}" for c in ("unmatched", "empty")]
    command = "CAST(command AS STRING) command" if "command" in rows.columns else "CAST(NULL AS STRING) command"
    return rows.selectExpr("CAST(session AS STRING) session", "CAST(frame AS BIGINT) frame", "CAST(track AS STRING) track", "CAST(score AS DOUBLE) score", det, *flags, command)


def _frames(pdf: pd.DataFrame) -> Iterator[tuple[int, list[tuple]]]:
    """The frames of sorted rows of one session."""
    now, seen = None, []
    for frame, *told in zip(*[pdf[c] for c in ("frame", "track", "score", "det", "unmatched", "empty", "command")], strict=True):
        if now is not None and frame != now:
            yield now, seen
            seen = []
        now = int(frame)
        seen.append(tuple(told))
    if now is not None:
        yield now, seen


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


def batch(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """All sessions of a table, each in one pass over its frames, which are read as a stream; frames below 0 end nothing."""

    def run(parts):
        name, own, frame, seen, out = None, None, None, [], []
        for pdf in parts:
            for session, at, track, *told in pdf.itertuples(index=False):
                key = (session,)
                if own is not None and (key != name or at != frame):
                    out += [(name[0], *row) for row in own.take(int(frame), seen)]
                    seen = []
                if key != name:
                    out += [(name[0], *row) for row in own.flush()] if own is not None else []
                    name, own = key, Session(rules)
                frame = at
                seen.append((track, *told))
            yield _table(out)
            out = []
        if own is not None:
            yield _table([(name[0], *row) for row in [*own.take(int(frame), seen), *own.flush()]])

    typed = _typed(rows).where("frame >= 0").repartition("session")
    return typed.sortWithinPartitions("session", "frame", "track").mapInPandas(run, OUT)


def stream(rows: DataFrame, rules: Rules = Rules(), expiry_ms: int | None = None) -> DataFrame:  # noqa: B008
    """The same as a streaming DataFrame; a row with frame -1, or expiry_ms without rows, ends a session and clears its state."""

    def one(key, parts, state):
        own = Session(rules, state.get[0] if state.exists else None)
        if state.hasTimedOut:
            state.remove()
            yield _table([(key[0], *row) for row in own.flush()])
            return
        pdf, out = pd.concat(list(parts)), []
        for frame, seen in _frames(pdf[pdf["frame"] >= 0].sort_values(["frame", "track"])):
            out += own.take(frame, seen)
        if (pdf["frame"] < 0).any():
            out += own.flush()
            if state.exists:
                state.remove()
        else:
            state.update((own.state(),))
            if expiry_ms:
                state.setTimeoutDuration(expiry_ms)
        yield _table([(key[0], *row) for row in out])

    timeout = "ProcessingTimeTimeout" if expiry_ms else "NoTimeout"
    return _typed(rows).groupBy(F.col("session")).applyInPandasWithState(one, OUT, "state string", "append", timeout)
