"""The other track rules: counters updated for all tracks at once, and suppression after occlusion.

``batched_counters`` differs from ``tracks.Session`` where the two forms of the rules differ: a matched
track gains one and any other loses one, also a track without pixels (which can lose a second one);
unmatched frames add up; of two tracks that share a detection, the one seen strictly earlier can
remove the other, so tracks first seen in the same frame never remove each other.

``recently_occluded`` hides, of two tracks that overlap, the one that was out of sight more recently,
if the other was out of sight before at all; a hidden track counts as out of sight in that frame.

Both go through a session's frames in order, in one pass and with state of the size of its tracks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from objectlens.operators.suppression import iou_matrix

INIT, MOST, LEAST, DELAY, UNMATCHED = 3, 8, -4, 5, 4
NEVER, ALWAYS, SHARED = -1, 100_000, 2
COUNTERS = "session string, frame bigint, track string, alive bigint, missed bigint, removed boolean, suppressed boolean"
HIDDEN = "session string, frame bigint, track string, hidden boolean, last_occluded bigint"


def batched_counters(rows: DataFrame, empty_costs: bool = False) -> DataFrame:
    """Counters after each frame of a session, for every track known by then.

    rows: session, frame, track, det (a detection matched in this frame; null if none), unmatched (true if the
    overlap is too low to count the frame as matched, though it may keep the track alive), empty (true if the
    track has no pixels here).  A known track without a row in a frame is unmatched there; null flags are false.
    """

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        first, alive, missed, gone, shared, out = {}, {}, {}, set(), {}, []
        for frame, own in pdf.groupby("frame", sort=True):
            by_det: dict = {}
            for track, det in zip(own["track"], own["det"], strict=True):
                if track not in first:
                    first[track], alive[track], missed[track] = frame, INIT, 0
                if pd.notna(det):
                    by_det.setdefault(det, set()).add(track)
            matched = set().union(*by_det.values())
            flagged = {n: set(own.loc[own[n].eq(True), "track"]) for n in ("empty", "unmatched")}
            for mates in by_det.values():
                for a in mates:
                    for b in mates:
                        if first[a] < first[b]:
                            shared[a, b] = shared.get((a, b), 0) + 1
            doubles = {b for (_, b), n in shared.items() if n >= SHARED}
            for t in sorted(first):
                alive[t] = min(MOST, max(LEAST, alive[t] + (1 if t in matched else -1)))
                if empty_costs and t in flagged["empty"]:
                    alive[t] = max(LEAST, alive[t] - 1)
                missed[t] += t not in matched or t in flagged["unmatched"]
                if frame - first[t] < DELAY and (missed[t] >= UNMATCHED or t in doubles):
                    gone.add(t)
                out.append((key[0], frame, t, alive[t], missed[t], t in gone, alive[t] <= 0 and t not in gone))
        return pd.DataFrame(out, columns=[c.split()[0] for c in COUNTERS.split(", ")])

    typed = rows.selectExpr("CAST(session AS STRING) session", "CAST(frame AS BIGINT) frame", "CAST(track AS STRING) track", "CAST(det AS STRING) det", "unmatched", "empty").where("track IS NOT NULL AND frame IS NOT NULL")
    return typed.groupBy("session").applyInPandas(one, COUNTERS)


def occlusion_step(last: np.ndarray, overlap: np.ndarray, reverse: bool = False) -> np.ndarray:
    """Which tracks hide: overlap is a symmetric boolean matrix, last their latest frames out of sight."""
    later = last[:, None] < last[None, :] if reverse else last[:, None] > last[None, :]
    return (overlap & later & (last[None, :] > NEVER) & ~np.eye(len(last), dtype=bool)).any(1)


def recently_occluded(rows: DataFrame, least: float = 0.7, reverse: bool = False) -> DataFrame:
    """Rows with hidden and last_occluded after each frame.

    rows: session, frame, track, x1, y1, x2, y2 (null: out of sight), removed (true: removed by other rules).
    A removed track without a past counts as out of sight for ever.  Repeated rows of a track count once.
    """

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = {}, []
        for frame, own in pdf.groupby("frame", sort=True):
            own = own.drop_duplicates("track").sort_values("track")
            box = own[["x1", "y1", "x2", "y2"]].to_numpy(float)
            seen = ~np.isnan(box).any(1)
            past = np.array([last.get(t, ALWAYS if r else NEVER) for t, r in zip(own["track"], own["removed"].eq(True), strict=True)], np.int64)
            overlap = np.outer(seen, seen) & (iou_matrix(np.nan_to_num(box), np.nan_to_num(box)) >= least)
            hidden = occlusion_step(past, overlap, reverse)
            now = np.where(~seen | hidden, frame, past)
            last.update(zip(own["track"], now, strict=True))
            out += [(key[0], frame, t, bool(h), int(o)) for t, h, o in zip(own["track"], hidden, now, strict=True)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in HIDDEN.split(", ")])

    boxes = [f"CAST({c} AS DOUBLE) {c}" for c in ("x1", "y1", "x2", "y2")]
    typed = rows.selectExpr("CAST(session AS STRING) session", "CAST(frame AS BIGINT) frame", "CAST(track AS STRING) track", *boxes, "removed").where("track IS NOT NULL AND frame IS NOT NULL")
    return typed.groupBy("session").applyInPandas(one, HIDDEN)
