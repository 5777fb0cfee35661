"""Greedy suppression and optimal assignment: a small sequential step inside each group.

Groups are images or (video, frame) pairs, so a group is as large as one image's detections,
whatever the table's size.  Ties in score go to the smaller id.  Whole groups are dealt to buckets of
about ``BUCKET_ROWS`` rows, whose number grows with the table, so that one call handles many groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_ROWS = 20_000


def bucket_of(rows: DataFrame, group: list[str]) -> Column:
    return F.pmod(F.xxhash64(*group), F.lit(max(1, -(-rows.count() // BUCKET_ROWS))))


def _runs(code: np.ndarray, n: int) -> np.ndarray:
    """Where each code's rows begin among sorted codes [n + 1]."""
    return np.searchsorted(code, np.arange(n + 1))


def iou_matrix(a: np.ndarray, b: np.ndarray, over: str = "union") -> np.ndarray:
    """Overlap of xyxy boxes [..., n, 4] and [..., m, 4], over the union or over the smaller area ("least")."""
    low = np.maximum(a[..., :, None, :2], b[..., None, :, :2])
    high = np.minimum(a[..., :, None, 2:], b[..., None, :, 2:])
    inter = np.clip(high - low, 0, None).prod(-1)
    area_a, area_b = (x[..., 2:] - x[..., :2] for x in (a, b))
    area_a, area_b = area_a.prod(-1)[..., :, None], area_b.prod(-1)[..., None, :]
    whole = np.minimum(area_a, area_b) if over == "least" else area_a + area_b - inter
    return np.divide(inter, whole, out=np.zeros_like(inter, dtype=float), where=whole > 0)


def greedy(overlap: np.ndarray, threshold: float, inclusive: bool) -> np.ndarray:
    """Kept rows, given rows in order of preference; inclusive: an overlap equal to the threshold suppresses."""
    alive = np.ones(len(overlap), bool)
    for i in range(len(overlap)):
        if alive[i]:
            hit = overlap[i] >= threshold if inclusive else overlap[i] > threshold
            hit[: i + 1] = False
            alive &= ~hit
    return alive


def _xyxy(pdf: pd.DataFrame) -> np.ndarray:
    box = pdf[["x1", "y1", "w", "h"]].to_numpy(float)
    box[:, 2:] += box[:, :2]
    return box


def suppress(det: DataFrame, group: list[str], threshold: float, inclusive: bool = False, over: str = "union", id_col: str = "det_id", mark: str | None = None) -> DataFrame:
    """The detections that survive greedy suppression within each group; with mark, all of them and whether they do."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_bucket")
        code = pdf.groupby(group, sort=False, dropna=False).ngroup().to_numpy()
        pdf = pdf.assign(_code=code).sort_values(["_code", "score", id_col], ascending=[True, False, True])
        at, box, keep = _runs(pdf["_code"].to_numpy(), code.max() + 1), _xyxy(pdf), np.ones(len(pdf), bool)
        for i in np.flatnonzero(np.diff(at) > 1):
            own = slice(at[i], at[i + 1])
            keep[own] = greedy(iou_matrix(box[own], box[own], over), threshold, inclusive)
        pdf = pdf.drop(columns="_code")
        return pdf.assign(**{mark: keep}) if mark else pdf[keep]

    schema = det.withColumn(mark, F.lit(True)).schema if mark else det.schema
    return det.withColumn("_bucket", bucket_of(det, group)).groupBy("_bucket").applyInPandas(one, schema)


def nulled(det: DataFrame, group: list[str], threshold: float, id_col: str = "det_id") -> DataFrame:
    """All detections; the boxes that frame suppression drops are null."""
    marked = suppress(det, group, threshold, inclusive=True, id_col=id_col, mark="_kept")
    return marked.withColumns({c: F.when(F.col("_kept"), F.col(c)) for c in ("x1", "y1", "w", "h")}).select(*det.columns)


def overlap_lists(det: DataFrame, group: str, threshold: float, id_col: str = "det_id") -> DataFrame:
    """Each group's kept and removed places, in the order of ids; groups of one detection have no lists."""
    marked = suppress(det, [group], threshold, over="least", id_col=id_col, mark="_kept")
    told = marked.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(id_col, F.col("_kept").alias("k")))).alias("_e"))
    places = F.transform("_e", lambda e, i: F.struct(i.alias("i"), e["k"].alias("k")))
    listed = lambda on: F.when(F.size("_e") > 1, F.filter(places, lambda e: e["k"] if on else ~e["k"])["i"])
    return told.select(group, listed(True).alias("kept_indices"), listed(False).alias("removed_indices"), F.lit(threshold).alias("iom_threshold"))


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of greatest total gain; every row or every column is matched.

    Shortest augmenting paths with potentials, cubic in the smaller side.
    """
    if not gain.size:
        return []
    if gain.size == 1:
        return [(0, 0)]
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            free = ~used
            free[0] = False
            reduced = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = free[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            back[1:][better] = j0
            j1 = int(np.where(free, least, np.inf).argmin())
            step = least[j1]
            u[owner[used]] += step
            v[used] -= step
            least[free] -= step
            j0 = j1
        while j0:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def assign_all(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table, row and column of the pairs that ``assign`` gives for each of equally large tables [k, n, m], all at once."""
    if not gain.size:
        return (np.zeros(0, int),) * 3
    flip = gain.shape[1] > gain.shape[2]
    cost = -(gain.transpose(0, 2, 1) if flip else gain)
    k, n, m = cost.shape
    u, v, owner = np.zeros((k, n + 1)), np.zeros((k, m + 1)), np.zeros((k, m + 1), int)
    for i in range(1, n + 1):
        owner[:, 0], j0 = i, np.zeros(k, int)
        least, back, used = np.full((k, m), np.inf), np.zeros((k, m + 1), int), np.zeros((k, m + 1), bool)
        on = np.arange(k)
        while len(on):
            used[on, j0[on]] = True
            own = owner[on, j0[on]]
            free = ~used[on, 1:]
            reduced = cost[on, own - 1] - u[on, own][:, None] - v[on, 1:]
            better = free & (reduced < least[on])
            low = np.where(better, reduced, least[on])
            back[on, 1:] = np.where(better, j0[on, None], back[on, 1:])
            j1 = np.where(free, low, np.inf).argmin(1)
            step = low[np.arange(len(on)), j1]
            at, col = np.nonzero(used[on])
            u[on[at], owner[on[at], col]] += step[at]
            v[on[at], col] -= step[at]
            least[on] = np.where(free, low - step[:, None], low)
            j0[on] = j1 + 1
            on = on[owner[on, j0[on]] > 0]
        on = np.flatnonzero(j0)
        while len(on):
            owner[on, j0[on]] = owner[on, back[on, j0[on]]]
            j0[on] = back[on, j0[on]]
            on = on[j0[on] > 0]
    at, col = np.nonzero(owner[:, 1:])
    row = owner[at, col + 1] - 1
    row, col = (col, row) if flip else (row, col)
    order = np.lexsort((col, row, at))
    return at[order], row[order], col[order]


def matched(det: DataFrame, gt: DataFrame, group: str) -> DataFrame:
    """(group, det_id, gt_id, iou) of the assignment of greatest total IoU in each group that has both sides."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([left[group], right[group]]), use_na_sentinel=False)
        left, right = left.assign(_code=codes[: len(left)]).sort_values(["_code", "det_id"]), right.assign(_code=codes[len(left) :]).sort_values(["_code", "gt_id"])
        at, to = _runs(left["_code"].to_numpy(), len(names)), _runs(right["_code"].to_numpy(), len(names))
        box, other, rows, cols, found = _xyxy(left), _xyxy(right), [], [], []
        for k in np.flatnonzero((np.diff(at) > 0) & (np.diff(to) > 0)):
            gain = iou_matrix(box[at[k] : at[k + 1]], other[to[k] : to[k + 1]])
            for i, j in assign(gain):
                rows.append(at[k] + i)
                cols.append(to[k] + j)
                found.append(gain[i, j])
        return pd.DataFrame({group: left[group].to_numpy()[np.array(rows, int)], "det_id": left["det_id"].to_numpy()[np.array(rows, int)], "gt_id": right["gt_id"].to_numpy()[np.array(cols, int)], "iou": np.array(found, float)})

    kind, bucket = det.schema[group].dataType.simpleString(), bucket_of(det, [group])
    deal = lambda df, id_col: df.select(group, id_col, "x1", "y1", "w", "h").withColumn("_bucket", bucket).groupBy("_bucket")
    return deal(det, "det_id").cogroup(deal(gt, "gt_id")).applyInPandas(one, f"{group} {kind}, det_id string, gt_id string, iou double")
