"""Matching of predictions with targets, and of detections with tracks.

Groups are images or frames; a group is as large as one image's boxes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlens.operators.suppression import _runs, assign, assign_all, bucket_of, iou_matrix

FORBIDDEN = 1e9
#: Costs that are held at once.
SHAPE_CELLS = 1_000_000


def class_cost(prob: np.ndarray, focal: bool, alpha: float = 0.25, gamma: float = 2.0) -> np.ndarray:
    """Cost of calling a prediction positive: -p, or the focal difference of both answers."""
    if not focal:
        return -prob
    return alpha * (1 - prob) ** gamma * -np.log(prob + 1e-8) - (1 - alpha) * prob**gamma * -np.log(1 - prob + 1e-8)


def giou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    hull = np.prod(np.maximum(a[..., :, None, 2:], b[..., None, :, 2:]) - np.minimum(a[..., :, None, :2], b[..., None, :, :2]), -1)
    overlap = iou_matrix(a, b)
    areas = np.prod(a[..., 2:] - a[..., :2], -1)[..., :, None] + np.prod(b[..., 2:] - b[..., :2], -1)[..., None, :]
    union = areas / (1 + overlap)  # overlap = both / union and both + union = areas
    return overlap - np.divide(hull - union, hull, out=np.zeros_like(hull), where=hull > 0)


def set_match(pred: DataFrame, target: DataFrame, group: str, weights: tuple[float, float, float] = (1.0, 5.0, 2.0), focal: bool = False, repeats: int = 1) -> DataFrame:
    """(group, det_id, gt_id): the assignment of least cost within each group.

    pred: group, det_id, prob, x1, y1, x2, y2, optional valid; target: group, gt_id, x1..y2.  The cost is a
    weighted sum of class cost, L1 distance of (cx, cy, w, h) and -GIoU.  With repeats, each target may be
    taken as often.  A prediction that isn't valid is never matched.
    """
    box = ["x1", "y1", "x2", "y2"]

    def centred(b):
        return np.concatenate([(b[..., :2] + b[..., 2:]) / 2, b[..., 2:] - b[..., :2]], -1)

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([left[group], right[group]]), use_na_sentinel=False)
        left, right = left.assign(_code=codes[: len(left)]).sort_values(["_code", "det_id"]), right.assign(_code=codes[len(left) :]).sort_values(["_code", "gt_id"])
        at, to = _runs(left["_code"].to_numpy(), len(names)), _runs(right["_code"].to_numpy(), len(names))
        a, b, prob = left[box].to_numpy(float), right[box].to_numpy(float), left["prob"].to_numpy(float)
        valid = left["valid"].to_numpy(bool) if "valid" in left.columns else None
        rows, cols = [np.zeros(0, int)], [np.zeros(0, int)]
        sizes = pd.DataFrame({"n": np.diff(at), "m": np.diff(to)}).query("n > 0 and m > 0")
        for (n, m), own in sizes.groupby(["n", "m"]).groups.items():  # groups of one shape at once
            for part in np.array_split(own.to_numpy(), -(-len(own) * n * m * repeats // SHAPE_CELLS)):
                i, j = at[part][:, None] + np.arange(n), to[part][:, None] + np.arange(m)
                cost = weights[0] * class_cost(prob[i], focal)[:, :, None] + weights[1] * np.abs(centred(a[i])[:, :, None] - centred(b[j])[:, None]).sum(3) - weights[2] * giou_matrix(a[i], b[j])
                if valid is not None:
                    cost[~valid[i]] = FORBIDDEN
                cost = np.tile(cost, (1, 1, repeats))
                k, row, col = assign_all(-cost)
                fits = cost[k, row, col] < FORBIDDEN / 10
                rows.append(i[k, row][fits])
                cols.append(j[k, col % m][fits])
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        return pd.DataFrame({c: df[c].to_numpy()[x] for c, df, x in ((group, left, rows), ("det_id", left, rows), ("gt_id", right, cols))})

    kind, bucket = pred.schema[group].dataType.simpleString(), bucket_of(pred, [group])
    deal = lambda df: df.withColumn("_bucket", bucket).groupBy("_bucket")
    return deal(pred).cogroup(deal(target)).applyInPandas(one, f"{group} {kind}, det_id {pred.schema['det_id'].dataType.simpleString()}, gt_id {target.schema['gt_id'].dataType.simpleString()}")


def one_to_many(pairs: DataFrame, group: str, prob: Column, iou: Column, alpha: float = 0.3, threshold: float = 0.4, top: int = 6) -> DataFrame:
    """Of all (prediction, target) pairs of a group those whose mixed score is above the threshold and above the
    quantile that leaves each target ``top`` predictions; the quantile interpolates linearly.
    """
    scored = pairs.withColumn("mixed", alpha * prob + (1 - alpha) * iou)
    sizes = scored.groupBy(group, "gt_id").agg(F.sort_array(F.collect_list("mixed")).alias("_all"))
    place = (F.size("_all") - 1) * F.greatest(1 - F.lit(float(top)) / F.size("_all"), F.lit(0.0))
    low = F.get("_all", F.floor(place).cast("int"))
    bar = low + (place - F.floor(place)) * (F.get("_all", F.ceil(place).cast("int")) - low)
    return scored.join(sizes.select(group, "gt_id", bar.alias("_bar")), [group, "gt_id"]).where((F.col("mixed") > F.col("_bar")) & (F.col("mixed") > threshold)).drop("_bar")


def associate(det: DataFrame, trk: DataFrame, overlaps: DataFrame, frame: list[str], match_at: float = 0.5, keep_at: float = 0.5, new_at: float = 0.7, one_to_one: bool = False) -> dict[str, DataFrame]:
    """Matches, new detections and unmatched tracks of every frame.

    overlaps: frame, det_id, trk_id, iou.  Many tracks may match one detection; a detection is new if its
    score reaches new_at and it matches no track; a track that isn't empty is unmatched if no detection
    reaches keep_at with it, or with one_to_one if its assigned one doesn't.
    """
    matches = overlaps.where(F.col("iou") >= match_at)
    new = det.where(F.col("score") >= new_at).join(matches.select(*frame, "det_id").distinct(), [*frame, "det_id"], "left_anti")
    held = overlaps.where(F.col("iou") >= keep_at)
    if one_to_one:

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            table = pdf.pivot_table(index="det_id", columns="trk_id", values="iou", fill_value=0.0)
            gain = table.to_numpy()
            keys = [(table.index[i], table.columns[j]) for i, j in assign(gain) if gain[i, j] >= keep_at]
            return pdf.set_index(["det_id", "trk_id"]).loc[keys].reset_index()[list(pdf.columns)] if keys else pdf.iloc[:0]

        held = overlaps.groupBy(*frame).applyInPandas(one, overlaps.schema)
    unmatched = trk.where(~F.col("empty")).join(held.select(*frame, "trk_id").distinct(), [*frame, "trk_id"], "left_anti")
    return {"matches": matches, "new": new, "unmatched": unmatched}
