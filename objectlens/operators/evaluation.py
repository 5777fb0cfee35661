"""Evaluation by category, area range and image, its summaries, and combinations over classes.

Matching goes through the predictions of each (image, category) by score, those of one place in all groups
of a batch at once; whole groups are dealt to tasks by hash and read as sorted streams.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objectlens.operators.metrics import RANGES, THRESHOLDS, hota, hota_combined
from objectlens.session import written

#: Area ranges by name, both ends included.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
MASKS = "image_id {k}, category_id {c}, det_id string, score double, hits array<int>, skips array<int>"
#: Cells of one step of matching, whose tables take a few hundred MB at most.
STEP_CELLS = 2_000_000


def _pair_iou(a: np.ndarray, b: np.ndarray, crowds: np.ndarray) -> np.ndarray:
    """Overlap of boxes x1, y1, w, h row by row; a crowd counts by the share of the prediction inside it."""
    inter = np.clip(np.minimum(a[:, :2] + a[:, 2:], b[:, :2] + b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0, None).prod(1)
    area = a[:, 2:].prod(1)
    whole = np.where(crowds, np.maximum(area, 1e-12), area + b[:, 2:].prod(1) - inter)
    return np.divide(inter, whole, out=np.zeros_like(inter), where=whole > 0)


def _match_groups(d: np.ndarray, at: np.ndarray, n: np.ndarray, g: np.ndarray, to: np.ndarray, m: np.ndarray, crowds: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hits and ignored [predictions, areas, thresholds]; group k has n[k] predictions from at[k] on and m[k] ground truths from to[k] on.

    The k-th predictions of all groups are matched at once.
    """
    area_d, area_g = d[:, 2:].prod(1), g[:, 2:].prod(1)
    out = (area_d[:, None] < low) | (area_d[:, None] > high)
    skip = crowds[:, None] | (area_g[:, None] < low) | (area_g[:, None] > high)
    hit = np.zeros((len(d), len(low), len(need)), bool)
    ignored = np.repeat(out[:, :, None], len(need), 2)
    free = np.ones((len(g), len(low), len(need)), bool)
    for k in range(n.max(initial=0)):
        active = np.flatnonzero((n > k) & (m > 0))
        ends = np.cumsum(m[active]) * len(low) * len(need) // STEP_CELLS
        for own in np.split(active, np.flatnonzero(np.diff(ends)) + 1):
            if not len(own):
                continue
            size, row = m[own], at[own] + k
            begin = np.cumsum(size) - size
            item = np.arange(size.sum()) - np.repeat(begin - to[own], size)
            over = _pair_iou(np.repeat(d[row], size, 0), g[item], crowds[item])
            fits = (over[:, None] >= need)[:, None] & (free[item] | crowds[item, None, None])
            best = np.where(fits, (over[:, None] + 2 * ~skip[item])[:, :, None], -1.0)
            last = np.broadcast_to(item[:, None, None], best.shape)
            if (size > 1).any():
                gain, best = best, np.maximum.reduceat(best, begin, 0)
                last = np.maximum.reduceat(np.where(gain == np.repeat(best, size, 0), last, -1), begin, 0)  # of equal overlaps the last
            found = best >= 0
            i, a, t = np.nonzero(found)
            free[last[i, a, t], a, t] = False
            skipped = skip[last, np.arange(len(low))[None, :, None]]
            hit[row] = found & ~skipped
            ignored[row] = np.where(found, skipped, out[row][:, :, None])
    return hit, ignored


def match_masks(det: DataFrame, gt: DataFrame, areas: dict[str, tuple[float, float]] = AREAS, most: int = 100) -> DataFrame:
    """The predictions of matched_by_area, each once: for every area a number whose bits are the thresholds it hits or is ignored at."""
    cols = ("x1", "y1", "w", "h")
    crowd = F.coalesce(F.col("iscrowd").cast("boolean"), F.lit(False)) if "iscrowd" in gt.columns else F.lit(False)
    side = lambda df, k, name, score, c: df.select("image_id", "category_id", F.lit(k).alias("side"), F.col(name).cast("string").alias("det_id"), score.cast("double").alias("score"), *[F.col(x).cast("double").alias(x) for x in cols], c.alias("crowd"))
    known = gt.where("image_id IS NOT NULL AND category_id IS NOT NULL")
    rows = side(det, 1, "det_id", F.col("score"), F.lit(False)).unionByName(side(known, 0, "gt_id", F.lit(0.0), crowd))
    low, high = (np.array([float(a[k]) for a in areas.values()]) for k in (0, 1))
    need = np.minimum(np.array(THRESHOLDS) / 100, 1 - 1e-10)
    bits = 1 << np.arange(len(need))

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch["_code"].to_numpy()
            cut = int(np.flatnonzero(code != code[-1]).max(initial=-1)) + 1
            if cut or (held and held[-1]["_code"][0].as_py() != code[-1]):
                yield table(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield table(pa.Table.from_batches(held))

    def table(own: pa.Table) -> pa.RecordBatch:
        """Masks of whole groups; a group's ground truths come before its predictions."""
        code, right = own["_code"].to_numpy(), own["side"].to_numpy() == 0
        group = np.cumsum(np.diff(code, prepend=code[:1]) != 0)
        n, m = (np.bincount(group[x], minlength=group[-1] + 1) for x in (~right, right))
        first = np.cumsum(n) - n
        chosen = np.flatnonzero(~right)[np.arange(n.sum()) - first[group[~right]] < most]
        n = np.minimum(n, most)
        box = np.column_stack([own[c].to_numpy() for c in cols])
        found = _match_groups(box[chosen], np.cumsum(n) - n, n, box[right], np.cumsum(m) - m, m, own["crowd"].to_numpy()[right], low, high, need)
        left, places = own.take(chosen), np.arange(len(chosen) + 1, dtype=np.int32) * len(low)
        lists = [pa.ListArray.from_arrays(places, pa.array((x @ bits).astype(np.int32).ravel())) for x in found]
        plain = [left[c].combine_chunks() for c in ("image_id", "category_id", "det_id", "score")]
        return pa.RecordBatch.from_arrays([*plain, *lists], names=["image_id", "category_id", "det_id", "score", "hits", "skips"])

    kind = lambda c: det.schema[c].dataType.simpleString()
    # dealt by a number: a repartition by the keys that both sides of a union are already dealt by is left out, though their partitions may then be merged differently
    dealt = rows.withColumn("_code", F.xxhash64("image_id", "category_id")).repartition("_code").sortWithinPartitions("image_id", "category_id", "side", F.desc("score"), "det_id")
    return dealt.mapInArrow(run, MASKS.format(k=kind("image_id"), c=kind("category_id")))


def matched_by_area(det: DataFrame, gt: DataFrame, areas: dict[str, tuple[float, float]] = AREAS, most: int = 100) -> DataFrame:
    """Each prediction at each area range and threshold: whether it hits, and whether it counts.

    det: image_id, category_id, det_id, score, x1, y1, w, h; gt: the same with gt_id and, if there is one, iscrowd.
    Predictions of a group are taken by falling score, ``most`` at most, ties by id.  Each takes the free
    ground truth of greatest overlap from the threshold on; those that count come before ignored ones (crowds and
    areas out of range), and a crowd may be taken again.  What matched an ignored one, or matched nothing and has an
    area out of range itself, is ignored.  Ground truths without an image or a category match nothing.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("area"), F.lit(i).alias("i"), F.lit(t).alias("threshold"), F.lit(1 << k).alias("bit")) for i, n in enumerate(areas) for k, t in enumerate(THRESHOLDS)])
    on = lambda c: F.get(c, F.col("c.i")).bitwiseAND(F.col("c.bit")) != 0
    spread = match_masks(det, gt, areas, most).withColumn("c", F.explode(cells))
    return spread.select("image_id", "category_id", "c.area", "c.threshold", "det_id", "score", on("hits").alias("hit"), on("skips").alias("ignored"))


def positives(gt: DataFrame, areas: dict[str, tuple[float, float]] = AREAS) -> DataFrame:
    """(category_id, area, n_gt): ground truths that count in each range."""
    size = F.col("w") * F.col("h")
    counts = F.col("iscrowd").cast("boolean") if "iscrowd" in gt.columns else F.lit(False)
    ranges = F.array(*[F.struct(F.lit(n).alias("area"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, (lo, hi) in areas.items()])
    inside = F.filter(ranges, lambda r: (size >= r["lo"]) & (size <= r["hi"]))
    return gt.where(~F.coalesce(counts, F.lit(False))).select("category_id", F.explode(inside).alias("r")).groupBy("category_id", F.col("r.area").alias("area")).agg(F.count(F.lit(1)).alias("n_gt"))


def _range_of(by: str, bounds: list) -> Column:
    """How many of the rising bounds lie above a value; rows without one come last.  Comparisons as a tree, so few a row."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(len(bounds) - lo)
        mid = (lo + hi) // 2
        return F.when(F.col(by) < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(F.col(by).isNull(), F.lit(len(bounds) + 1)).otherwise(tree(0, len(bounds)))


def precision_by_area(evaluated: DataFrame, n_gt: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(category_id, area, threshold, ap, ar) from matched_by_area; images confines it to some images, as a rarity bucket."""
    bit = F.element_at(F.create_map(*[F.lit(v) for k, t in enumerate(THRESHOLDS) for v in (t, 1 << k)]), F.col("threshold"))
    marked = lambda c: F.sum(F.when(F.col(c), bit).otherwise(0)).cast("int").alias(c)
    keys = ["image_id", "category_id", "area", "det_id", "score"]
    return _precision(evaluated.groupBy(*keys).agg(marked("hit"), marked("ignored")), n_gt, images)


def precision_of_masks(masks: DataFrame, n_gt: DataFrame, areas: dict[str, tuple[float, float]] = AREAS, images: DataFrame | None = None) -> DataFrame:
    """precision_by_area from match_masks, without a row for each threshold."""
    cells = F.array(*[F.struct(F.lit(n).alias("area"), F.get("hits", F.lit(i)).alias("hit"), F.get("skips", F.lit(i)).alias("ignored")) for i, n in enumerate(areas)])
    return _precision(masks.withColumn("c", F.explode(cells)).select("image_id", "category_id", "c.area", "det_id", "score", "c.hit", "c.ignored"), n_gt, images)


def _precision(rows: DataFrame, n_gt: DataFrame, images: DataFrame | None) -> DataFrame:
    """Precision from rows whose hit and ignored are bits of thresholds.

    A cell's rows are dealt to ranges of score, whose bounds are scores chosen by hash.  Running sums of all
    thresholds go over one order and begin with the sums of the ranges before, so no task sees all rows of a cell but
    where they share one score.  Of each hundredth of recall the best precision is kept; the greatest of it and of
    those behind is the interpolated precision.
    """
    rows = rows.join(images.select("image_id").distinct(), "image_id", "left_semi") if images is not None else rows
    every, n = (1 << len(THRESHOLDS)) - 1, range(len(THRESHOLDS))
    rows = written(rows.where(F.col("ignored") != every).join(n_gt, ["category_id", "area"]), "evaluated")
    scores = rows.select("score").where("score IS NOT NULL AND NOT isnan(score)").distinct()
    bounds = sorted(r[0] for r in scores.orderBy(F.xxhash64("score"), "score").limit(RANGES).collect())
    cell = ["category_id", "area", "_range"]
    dealt = rows.withColumn("_range", _range_of("score", bounds))
    on = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(1)).cast("bigint")
    sums = [f(k) for k in n for f in (lambda k: F.sum(1 - on("ignored", k)), lambda k: F.sum(on("hit", k)))]
    names = [f"{c}{k}" for k in n for c in ("n", "h")]
    totals = dealt.groupBy(*cell, "n_gt").agg(*[c.alias(m) for c, m in zip(sums, names, strict=True)])
    earlier = Window.partitionBy("category_id", "area").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*cell, *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}") for m in names])
    w = Window.partitionBy(*cell).orderBy(F.desc("score"), F.asc("image_id"), F.asc("det_id")).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.select(*cell, "n_gt", "hit", *[c.over(w).alias(m) for c, m in zip(sums, names, strict=True)]).where("hit != 0")
    points = F.array(*[F.struct(F.lit(t).alias("threshold"), (on("hit", k) == 1).alias("on"), (F.col(f"h{k}") + F.col(f"_h{k}")).alias("tp"), (F.col(f"n{k}") + F.col(f"_n{k}")).alias("rank")) for k, t in enumerate(THRESHOLDS)])
    hits = run.join(before, cell).select("category_id", "area", "n_gt", F.explode(F.filter(points, lambda p: p["on"])).alias("p"))
    level = F.floor(F.col("p.tp") / F.col("n_gt") * 100 + 1e-9).cast("int")
    best = hits.groupBy("category_id", "area", F.col("p.threshold").alias("threshold"), level.alias("level")).agg(F.max(F.col("p.tp") / F.col("p.rank")).alias("p"))
    own = Window.partitionBy("category_id", "area", "threshold").orderBy(F.desc("level"))
    covered = F.col("level") - F.coalesce(F.lead("level").over(own), F.lit(-1))
    steps = best.withColumn("_part", F.max("p").over(own.rowsBetween(Window.unboundedPreceding, 0)) * covered)
    ap = steps.groupBy("category_id", "area", "threshold").agg((F.sum("_part") / 101).alias("ap"))
    found = totals.groupBy("category_id", "area", "n_gt").agg(*[F.sum(f"h{k}").alias(f"h{k}") for k in n])
    spread = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(f"h{k}") / F.col("n_gt")).alias("ar")) for k, t in enumerate(THRESHOLDS)]))
    ar = found.select("category_id", "area", spread.alias("r")).select("category_id", "area", "r.*")
    keys = ["category_id", "area", "threshold"]
    cells = n_gt.select("category_id", "area", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold"))
    return cells.join(ap, keys, "left").join(ar, keys, "left").fillna(0.0, ["ap", "ar"])


def summary(value: Column) -> Column:
    """The mean of what is above -1; -1 where nothing is."""
    return F.coalesce(F.avg(F.when(value > -1, value)), F.lit(-1.0))


def report(rows: DataFrame, threshold: str, values: list[str]) -> DataFrame:
    """(metric, scope, value): the mean over thresholds, and at 50 and 75."""
    scopes = {"50_95": F.lit(True), "50": F.col(threshold) == 50, "75": F.col(threshold) == 75}
    sums = rows.agg(*[summary(F.when(on, F.col(v))).alias(f"{v}|{s}") for v in values for s, on in scopes.items()])
    cells = F.array(*[F.struct(F.lit(v).alias("metric"), F.lit(s).alias("scope"), F.col(f"{v}|{s}").alias("value")) for v in values for s in scopes])
    return sums.select(F.explode(cells).alias("c")).select("c.*")


COUNTS, FLOATS = ["tp", "fn", "fp"], ["hota", "det_a", "ass_a", "det_re", "det_pr", "ass_re", "ass_pr", "loc_a", "owta"]


def final_fields(rows: DataFrame) -> DataFrame:
    """Detection shares, hota and owta from counts and association."""
    total = lambda *c: F.greatest(sum(map(F.col, c[1:]), F.col(c[0])), F.lit(1))
    out = rows.withColumn("det_a", F.col("tp") / total("tp", "fn", "fp")).withColumn("det_re", F.col("tp") / total("tp", "fn")).withColumn("det_pr", F.col("tp") / total("tp", "fp"))
    return out.withColumn("hota", F.sqrt(F.col("det_a") * F.col("ass_a"))).withColumn("owta", F.sqrt(F.col("det_re") * F.col("ass_a")))


def class_averaged(rows: DataFrame, cls: str, ignore_empty: bool = False) -> DataFrame:
    """Classes combined per alpha: counts summed, everything else averaged over classes.

    ignore_empty leaves out classes without any ground truth or prediction at any alpha.
    """
    if ignore_empty:
        some = rows.groupBy(cls).agg(F.max(F.col("tp") + F.col("fn") + F.col("fp")).alias("_n")).where("_n > 0").select(cls)
        rows = rows.join(some, cls, "left_semi")
    return rows.groupBy("alpha").agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.avg(c).alias(c) for c in FLOATS])


def detection_averaged(rows: DataFrame) -> DataFrame:
    """Classes combined per alpha: counts summed, association and localisation weighted by matches, shares anew."""
    weighted = lambda c: F.sum(F.col(c) * F.col("tp"))
    sums = rows.groupBy("alpha").agg(*[F.sum(c).alias(c) for c in COUNTS], *[(weighted(c) / F.greatest(F.sum("tp"), F.lit(1))).alias(c) for c in ("ass_a", "ass_re", "ass_pr")], (F.greatest(F.lit(1e-10), weighted("loc_a")) / F.greatest(F.lit(1e-10), F.sum("tp"))).alias("loc_a"))
    return final_fields(sums)


def at_first_alpha(rows: DataFrame, *keys: str) -> DataFrame:
    """hota0, loc_a0 and their product: the values at the lowest alpha."""
    low = lambda c: F.min_by(c, "alpha")
    return rows.groupBy(*keys).agg(low("hota").alias("hota0"), low("loc_a").alias("loc_a0")).withColumn("hota_loc_a0", F.col("hota0") * F.col("loc_a0"))


def tagged(rows: DataFrame, tags: DataFrame, sequence: str, tag: str) -> DataFrame:
    """Sequences that have a tag."""
    return rows.join(tags.where(F.col("tag") == tag).select(sequence).distinct(), sequence, "left_semi")


def rarity_buckets(images: DataFrame, key: str, rarity: str, chosen: DataFrame | None = None) -> DataFrame:
    """(rarity, image) of the images evaluated."""
    rows = images.join(chosen.select(key).distinct(), key, "left_semi") if chosen is not None else images
    return rows.select(F.col(rarity).alias("rarity"), key)


def tracks_of_videos(annotations: DataFrame, videos: DataFrame, video: str, track: str, frame: str, area: str) -> DataFrame:
    """Each video with its tracks: annotations by frame and mean area; videos without any have a row with a null track."""
    nested = annotations.groupBy(video, track).agg(F.sort_array(F.collect_list(F.struct(frame, area))).alias("annotations"), F.avg(area).alias("area"))
    return videos.select(video).distinct().join(nested, video, "left")


def class_slices(gt: DataFrame, det: DataFrame, keys: list[str], cls: str, gt_id: str, det_id: str) -> tuple[DataFrame, DataFrame]:
    """Ground truth and predictions of a sequence's class with ids 0..n-1 within it, for classes that the ground truth has."""
    known = gt.select(keys[0], cls).distinct()
    dense = lambda df, c: df.withColumn(c, F.dense_rank().over(Window.partitionBy(keys[0], cls).orderBy(c)) - 1)
    return dense(gt, gt_id), dense(det.join(known, [keys[0], cls], "left_semi"), det_id)


@dataclass(frozen=True)
class Metric:
    """A metric as four functions of DataFrames: of sequences, and their combinations over sequences and classes."""

    per_sequence: Callable[..., DataFrame]
    sequences: Callable[[DataFrame], DataFrame]
    classes: Callable[[DataFrame, str], DataFrame]
    detections: Callable[[DataFrame], DataFrame]


#: Metrics by name; register others here.
METRICS = {"hota": Metric(hota, hota_combined, class_averaged, detection_averaged)}


def evaluated(metric: str, data: Callable[[], tuple], combine: str = "sequences", *rest) -> DataFrame:
    """A registered metric of what a dataset function gives, combined in one of its ways."""
    plug = METRICS[metric]
    return getattr(plug, combine)(plug.per_sequence(*data()), *rest)


def run_all(evaluators: dict[str, Callable[..., DataFrame]], *frames: DataFrame) -> dict[str, DataFrame]:
    """Each evaluator's result over the same predictions, by name."""
    return {name: f(*frames) for name, f in evaluators.items()}
