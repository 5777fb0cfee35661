"""Query filters, open-world filtering, frame lookups and track bookkeeping, all as DataFrame operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objectlens.operators.suppression import bucket_of


#: Pairs of rows that track suppression holds at once.
PAIRS = 1_000_000


def zero_box(box: Column) -> Column:
    """Null, shorter than 4, or without a positive entry."""
    return box.isNull() | (F.size(box) < 4) | ~F.coalesce(F.exists(box, lambda v: v > 0), F.lit(False))


def without_texts(queries: DataFrame, text: str, listed: list[str]) -> DataFrame:
    return queries.where(~F.coalesce(F.col(text).isin(listed), F.lit(False)))


def without_empty_targets(objects: DataFrame, area: Column, least: float = 1e-6) -> DataFrame:
    return objects.where(area >= least)


def without_touching(queries: DataFrame, objects: DataFrame, key: str, bad: Column) -> DataFrame:
    """Queries none of whose objects is bad, as zero boxes or crowds; queries without objects stay."""
    return queries.join(objects.where(bad).select(key).distinct(), key, "left_anti")


def exhaustive_queries(queries: DataFrame, flag: str, null_passes: bool) -> DataFrame:
    """Queries marked exhaustive; where pixels count a null passes, where instances count it doesn't."""
    return queries.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(null_passes)))


def valid_geometric(queries: DataFrame, text: str, n_out: str) -> DataFrame:
    """Drops geometric queries without any output."""
    return queries.where((F.col(text) != "geometric") | (F.col(n_out) > 0))


def renumbered(queries: DataFrame, group: str, stage: str) -> DataFrame:
    """Stages of each datapoint as 0..n-1 after a filter."""
    return queries.withColumn(stage, F.dense_rank().over(Window.partitionBy(group).orderBy(stage)) - 1)


def open_world(det: DataFrame, gt: DataFrame, matched: DataFrame, frame: list[str], cls: str, negatives: DataFrame, partial: DataFrame) -> DataFrame:
    """Removes unmatched predictions that can't be judged.

    matched: det_id of predictions assigned at the threshold.  Unmatched ones go if their class has no
    ground truth in the frame and isn't a known negative of the video (negatives: video, cls), or if the
    video's labels of the class are not exhaustive (partial: video, cls).
    """
    video = frame[0]
    mark = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    told = det.join(mark(matched, ["det_id"], "_hit"), "det_id", "left").join(mark(gt, [*frame, cls], "_gt"), [*frame, cls], "left")
    told = told.join(mark(negatives, [video, cls], "_neg"), [video, cls], "left").join(mark(partial, [video, cls], "_part"), [video, cls], "left")
    keep = F.col("_hit").isNotNull() | ((F.col("_gt").isNotNull() | F.col("_neg").isNotNull()) & F.col("_part").isNull())
    return told.where(keep).select(*det.columns)


def self_pairs(rows: DataFrame, keys: list[str], id_col: str, values: list[str]) -> DataFrame:
    """Pairs of one image's rows, the smaller id first; images are bounded groups."""
    side = lambda k: rows.select(*keys, *[F.col(c).alias(f"{k}_{c}") for c in (id_col, *values)])
    return side("a").join(side("b"), keys).where(F.col(f"a_{id_col}") < F.col(f"b_{id_col}"))


def first_appearance(rows: DataFrame, video: str, track: str, frame: str) -> DataFrame:
    return rows.groupBy(video, track).agg(F.min(frame).alias("first_frame"))


def duplicate_tracks(matches: DataFrame, video: str, det: list[str], track: str, frame: str, at_least: int, delay: int) -> DataFrame:
    """Tracks to remove: those that share a detection, in ``at_least`` frames, with the track of it that appeared first.

    A track is judged in the frame that completes the count and only if it appeared within the last
    ``delay`` frames then; later counts come too late.  Of tracks that appeared in the same frame, the
    smaller id counts as first.
    """
    born = matches.join(first_appearance(matches, video, track, frame), [video, track])
    first = F.min(F.struct("first_frame", track)).over(Window.partitionBy(video, frame, *det))
    pairs = born.withColumn("_first", first[track]).where(F.col(track) != F.col("_first")).select(video, "_first", track, frame, "first_frame").distinct()
    count = F.row_number().over(Window.partitionBy(video, "_first", track).orderBy(frame))
    full = pairs.withColumn("_n", count).where((F.col("_n") == at_least) & (F.col("first_frame") > F.col(frame) - delay))
    return full.select(video, track).distinct()


def under_cap(new: DataFrame, held: DataFrame, video: str, score: str, id_col: str, cap: int) -> DataFrame:
    """The best new detections that still fit under the cap of objects of a video."""
    room = F.lit(cap) - F.coalesce("_held", F.lit(0))
    rank = F.row_number().over(Window.partitionBy(video).orderBy(F.desc(score), id_col))
    ranked = new.join(held.groupBy(video).agg(F.count(F.lit(1)).alias("_held")), video, "left").withColumn("_rank", rank)
    return ranked.where(F.col("_rank") <= room).select(*new.columns)


def look_ahead(rows: DataFrame, keys: list[str], frame: str, status: str, n: int) -> DataFrame:
    """Status n - 1 rows later of the same key, or at its last row if there are fewer."""
    w = Window.partitionBy(*keys).orderBy(frame)
    last = F.last(status).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("later", F.coalesce(F.lead(status, n - 1).over(w), last))


def nearest_frames(current: DataFrame, cond: DataFrame, video: str, frame: str, k: int) -> DataFrame:
    """Conditioning frames of each current one: the closest before, the closest from it on, then others by distance, k in all; -1 takes all.

    Ties in distance go to the earlier frame.
    """
    if k < 0:
        pairs = current.select(video, frame).join(cond.select(video, F.col(frame).alias("cond")), video)
    else:  # the k frames before and the k from it on hold all that can be taken
        listed = cond.groupBy(video).agg(F.sort_array(F.collect_list(frame)).alias("_c"))
        placed = current.select(video, frame).join(listed, video).withColumn("_p", F.size(F.filter("_c", lambda c: c < F.col(frame))))
        near = F.slice("_c", F.greatest(F.col("_p") - k, F.lit(0)) + 1, F.least(F.col("_p"), F.lit(k)) + k)
        pairs = placed.select(video, frame, F.explode(near).alias("cond"))
    pairs = pairs.withColumn("_before", F.col("cond") < F.col(frame)).withColumn("_far", F.abs(F.col("cond") - F.col(frame)))
    side = F.row_number().over(Window.partitionBy(video, frame, "_before").orderBy("_far"))
    order = Window.partitionBy(video, frame).orderBy((F.col("_side") > 1).cast("int"), "_far", "cond")
    ranked = pairs.withColumn("_side", side).withColumn("_rank", F.row_number().over(order))
    return ranked.where((F.col("_rank") <= k) if k >= 0 else F.lit(True)).select(video, frame, "cond")


def unique_tracks(rows: DataFrame, video: str, track: str) -> DataFrame:
    """Track ids that several videos share get the video's id behind theirs; no task sees all ids."""
    shared = rows.groupBy(track).agg(F.count_distinct(video).alias("_n")).where("_n > 1").select(track, F.lit(True).alias("_shared"))
    named = F.when(F.col("_shared"), F.concat_ws("@", track, video)).otherwise(F.col(track).cast("string"))
    return rows.join(shared, track, "left").withColumn(track, named).select(*rows.columns)


def seeded_limit(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k keys in an order fixed by the seed."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)


def track_suppression(rows: DataFrame, video: str, track: str, frame: str, threshold: float) -> DataFrame:
    """Boxes of the tracks that greedy suppression drops become null; their rows stay.

    rows: video, track, frame, score, x1, y1, w, h.  Overlap of two tracks is the sum of intersections over
    the sum of unions in frames that both have; tracks are ordered by mean score, then id.
    """
    boxes = ["x1", "y1", "w", "h"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_bucket").reset_index(drop=True)
        code = pd.factorize(pdf[video], use_na_sentinel=False)[0]
        tracks = pdf.assign(_v=code).groupby(["_v", track], dropna=False)
        means = tracks["score"].mean().reset_index()
        order = means.sort_values(["_v", "score", track], ascending=[True, False, True]).index.to_numpy()
        place = np.argsort(order)[tracks.ngroup().to_numpy()]  # of a row's track in its bucket
        kept, n = np.ones(len(order), bool), len(order)
        if threshold <= 0:  # tracks that never meet suppress each other too
            kept = np.diff(means["_v"].to_numpy()[order], prepend=-1) != 0
        seen = np.flatnonzero((pdf["x1"].notna() & pdf[frame].notna()).to_numpy())
        cell = pdf.assign(_v=code).iloc[seen].groupby(["_v", frame]).ngroup().to_numpy()
        by = np.argsort(cell, kind="stable")
        seen, cell = seen[by], cell[by]
        size, begin = np.bincount(cell)[cell], np.searchsorted(cell, cell)
        at, low, wide = place[seen], pdf[boxes[:2]].to_numpy(float)[seen], pdf[boxes[2:]].to_numpy(float)[seen]
        high, area, sums = low + wide, wide.prod(1), pd.DataFrame({"inter": [], "union": []}, index=pd.Index([], dtype=np.int64))
        for rows in np.split(np.arange(len(seen)), np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1):
            i = np.repeat(rows, size[rows])
            j = np.arange(len(i)) - np.repeat(np.cumsum(size[rows]) - size[rows] - begin[rows], size[rows])
            i, j = (x[at[i] < at[j]] for x in (i, j))
            both = np.clip(np.minimum(high[i], high[j]) - np.maximum(low[i], low[j]), 0, None).prod(1)
            own = pd.DataFrame({"inter": both, "union": area[i] + area[j] - both}).groupby(at[i] * n + at[j]).sum()
            sums = own if not len(sums) else sums.add(own, fill_value=0.0)
        hits = sums.index.to_numpy()[(np.divide(sums["inter"], sums["union"], out=np.zeros(len(sums)), where=sums["union"] > 0) >= threshold).to_numpy()] if threshold > 0 else np.zeros(0, np.int64)
        first, second = np.divmod(hits, max(n, 1))
        for i, to in zip(np.unique(first), np.split(second, np.flatnonzero(np.diff(first)) + 1), strict=False):
            if kept[i]:
                kept[to] = False
        pdf.loc[~kept[place], boxes] = np.nan
        return pdf

    typed = rows.select(*[F.col(c).cast("double").alias(c) if c in boxes else F.col(c) for c in rows.columns])
    return typed.withColumn("_bucket", bucket_of(typed, [video])).groupBy("_bucket").applyInPandas(one, typed.schema)
