"""Detection and tracking metrics from matches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objectlens.operators.suppression import assign, bucket_of
from objectlens.session import written

#: IoU thresholds of the evaluation, in hundredths, so that they compare exactly.
THRESHOLDS = list(range(50, 100, 5))
ALPHAS = [k / 100 for k in range(5, 100, 5)]
#: Bounds of score ranges, all that the driver holds of a curve.
RANGES = 200


def image_counts(images: DataFrame, gt: DataFrame, det: DataFrame, key: str) -> DataFrame:
    """Each image as TP (both sides), FP, FN or TN (neither): il_tp, il_fp, il_fn, il_tn."""
    sides = images.select(key).join(gt.groupBy(key).agg(F.count(F.lit(1)).alias("n_gt")), key, "left").join(det.groupBy(key).agg(F.count(F.lit(1)).alias("n_dt")), key, "left")
    has_gt, has_dt = F.coalesce("n_gt", F.lit(0)) > 0, F.coalesce("n_dt", F.lit(0)) > 0
    return sides.agg(F.count_if(has_gt & has_dt).alias("il_tp"), F.count_if(~has_gt & has_dt).alias("il_fp"), F.count_if(has_gt & ~has_dt).alias("il_fn"), F.count_if(~has_gt & ~has_dt).alias("il_tn"))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    return (tp * tn - fp * fn) / (F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) + 1e-6)


def f1_rows(images: DataFrame, gt: DataFrame, det: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """(image, threshold, n_gt, n_dt, tp, fp, fn) at each threshold, for images with any side.

    matches: iou of assigned pairs.  The matches are counted once and spread over the thresholds.
    """
    both = matches.withColumn("hundredths", F.floor(F.col("iou") * 100 + 1e-9).cast("int"))
    tps = both.groupBy(key).agg(*[F.count_if(F.col("hundredths") >= t).alias(f"tp{t}") for t in THRESHOLDS])
    sides = images.select(key).join(gt.groupBy(key).agg(F.count(F.lit(1)).alias("n_gt")), key, "left").join(det.groupBy(key).agg(F.count(F.lit(1)).alias("n_dt")), key, "left").join(tps, key, "left").fillna(0)
    spread = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{t}").alias("tp")) for t in THRESHOLDS])).alias("e")
    return sides.where("n_gt + n_dt > 0").select(key, "n_gt", "n_dt", spread).select(key, "e.threshold", "n_gt", "n_dt", "e.tp", (F.col("n_dt") - F.col("e.tp")).alias("fp"), (F.col("n_gt") - F.col("e.tp")).alias("fn"))


def f1_totals(rows: DataFrame) -> DataFrame:
    """Per threshold: tp, fp, fn, pm_fp (on images with both sides), positive_micro_f1, positive_macro_f1."""
    local = F.when((F.col("n_gt") > 0) & (F.col("n_dt") > 0), _f1(F.col("tp") / (F.col("tp") + F.col("fp") + 1e-4), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-4)))
    sums = rows.where("n_gt > 0 OR n_dt > 0").groupBy("threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.coalesce(F.sum(F.when(local.isNotNull(), F.col("fp"))), F.lit(0)).alias("pm_fp"), F.avg(local).alias("positive_macro_f1"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("pm_fp") + 1e-4), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-4)
    return sums.withColumn("positive_micro_f1", _f1(precision, recall))


def f1_extended(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Per threshold: macro F1 in which missed images count as 0, shares of images without any error, and cgF1 of both macro forms.

    rows: of f1_rows; counts: one row of il_tp, il_fp, il_fn, il_tn.  A positive image is perfect if all its
    ground truths are matched and nothing else is found, a negative one if nothing is found.  Without
    positive images the macro forms are null.
    """
    positive = F.col("n_gt") > 0
    local = _f1(F.col("tp") / (F.col("tp") + F.col("fp") + 1e-4), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-4))
    sums = rows.groupBy("threshold").agg(
        F.avg(F.when(positive & (F.col("n_dt") > 0), local)).alias("positive_macro_f1"),
        F.avg(F.when(positive, F.when(F.col("n_dt") > 0, local).otherwise(0.0))).alias("positive_w0dt_macro_f1"),
        F.count_if(positive & (F.col("fp") == 0) & (F.col("fn") == 0)).alias("_perfect"),
    )
    tp, fp, fn, tn = map(F.col, ("il_tp", "il_fp", "il_fn", "il_tn"))
    told = sums.crossJoin(F.broadcast(counts))  # one row
    told = told.withColumn("il_perfect_pos", F.col("_perfect") / (tp + fn + 1e-9)).withColumn("il_perfect_neg", tn / (tn + fp + 1e-9)).withColumn("_mcc", mcc(tp, fp, fn, tn))
    named = {"cgf1_macro": "positive_macro_f1", "cgf1_w0dt": "positive_w0dt_macro_f1"}
    return told.select("threshold", *named.values(), "il_perfect_pos", "il_perfect_neg", *[(F.col(c) * F.col("_mcc")).alias(n) for n, c in named.items()])


def _f1(p: Column, r: Column) -> Column:
    return 2 * p * r / (p + r + 1e-4)


def precision_recall(det: DataFrame, group: str, order: list[Column], hit: str, n_gt: Column, by: str = "score", ranges: int = RANGES) -> DataFrame:
    """Running precision and recall by score within a group, and precision made monotone from the right.

    order begins with the fall of ``by``.  A group's rows are dealt to ranges of ``by``, whose bounds are
    values chosen by hash; numbers run inside a range and are moved by the sums of the ranges before, as the
    maxima are by those behind.  So no task sees all rows of a group but where they share one score.
    """
    chosen = sorted(r[0] for r in det.select(by).where(F.col(by).isNotNull()).distinct().orderBy(F.xxhash64(by), by).limit(ranges).collect())
    above = F.filter(F.array(*map(F.lit, chosen)), lambda c: c > F.col(by)) if chosen else None
    dealt = det.withColumn("_range", F.size(above) if chosen else F.lit(0))
    cell, hits = [group, "_range"], F.col(hit).cast("bigint")
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum(hits).alias("h"))
    before = sums.select(*cell, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", "h")])
    w = Window.partitionBy(*cell).orderBy(*order)
    run = dealt.join(before, cell).withColumn("tp", F.sum(hits).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_h")).withColumn("rank", F.row_number().over(w) + F.col("_n"))
    run = written(run.withColumn("precision", F.col("tp") / F.col("rank")).withColumn("recall", F.col("tp") / n_gt), "curve")
    behind = Window.partitionBy(group).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    tops = run.groupBy(*cell).agg(F.max("precision").alias("t")).select(*cell, F.coalesce(F.max("t").over(behind), F.lit(0.0)).alias("_later"))
    # from the last rank back: a frame that only grows is linear, one that shrinks is computed anew for each row
    back = Window.partitionBy(*cell).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return run.join(tops, cell).withColumn("envelope", F.greatest(F.max("precision").over(back), F.col("_later"))).drop("_range", "_n", "_h", "_later")


def average_precision(curve: DataFrame, group: str) -> DataFrame:
    """101-point average precision: the envelope at the first recall of at least each hundredth, else 0."""
    points = curve.groupBy(group, "recall").agg(F.max("envelope").alias("p"))
    best = Window.partitionBy(group).orderBy("recall")
    steps = points.withColumn("before", F.coalesce(F.lag("recall").over(best), F.lit(-1.0)))
    covered = F.floor(F.col("recall") * 100 + 1e-9) - F.floor(F.col("before") * 100 + 1e-9)
    return steps.groupBy(group).agg((F.sum(F.col("p") * F.when(F.col("before") < 0, F.floor(F.col("recall") * 100 + 1e-9) + 1).otherwise(covered)) / 101).alias("ap"))


def hota(gt: DataFrame, det: DataFrame, similarity: DataFrame) -> DataFrame:
    """(video, alpha, tp, fn, fp, ass_a, ass_re, ass_pr, loc_a) for each video and alpha.

    gt: video, frame, gt_id; det: video, frame, det_id; similarity: video, frame, gt_id, det_id,
    sim.  Frames are matched by the greatest total of alignment times similarity.
    """
    rows = gt.select("video", "frame", F.lit(0).alias("kind"), F.col("gt_id").cast("string").alias("g"), F.lit(None).cast("string").alias("d"), F.lit(0.0).alias("sim"))
    rows = rows.unionByName(det.select("video", "frame", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("g"), F.col("det_id").cast("string").alias("d"), F.lit(0.0).alias("sim")))
    rows = rows.unionByName(similarity.select("video", "frame", F.lit(2).alias("kind"), F.col("gt_id").cast("string").alias("g"), F.col("det_id").cast("string").alias("d"), F.col("sim").cast("double")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame", kind="stable")
        codes, videos = pd.factorize(pdf["video"], use_na_sentinel=False)
        pdf = pdf.assign(video=codes)
        left, right, pair = (pdf[pdf["kind"] == k] for k in range(3))
        pair = pair.drop_duplicates(["video", "frame", "g", "d"], keep="last")

        def ids(*sides: tuple[pd.DataFrame, str]) -> list[np.ndarray]:
            """Numbers of (video, id), in that order, alike on all sides."""
            number = np.unique(np.concatenate([x[c].to_numpy(str) for x, c in sides]), return_inverse=True)[1]
            key = np.concatenate([x["video"].to_numpy() for x, _ in sides]) * (len(number) + 1) + number
            return np.split(np.unique(key, return_inverse=True)[1], np.cumsum([len(x) for x, _ in sides])[:-1])

        (own_g, g), (own_d, d) = ids((left, "g"), (pair, "g")), ids((right, "d"), (pair, "d"))
        video, sim, frame = pair["video"].to_numpy(), pair["sim"].to_numpy(), pair.groupby(["video", "frame"], sort=False).ngroup().to_numpy()
        count_g, count_d = (np.bincount(own, minlength=max(x.max(initial=-1), own.max(initial=-1)) + 1) for own, x in ((own_g, g), (own_d, d)))

        def total(key: np.ndarray) -> np.ndarray:
            at = np.unique(key, return_inverse=True)[1]
            return np.bincount(at, sim)[at] if len(at) else sim

        whole = total(frame * len(count_g) + g) + total(frame * len(count_d) + d) - sim
        mates, mate = np.unique(g * max(len(count_d), 1) + d, return_inverse=True)
        of_g, of_d = mates // max(len(count_d), 1), mates % max(len(count_d), 1)
        potential = np.bincount(mate, np.divide(sim, whole, out=np.zeros_like(sim), where=whole > 0), len(mates))
        gain = (potential / np.maximum(count_g[of_g] + count_d[of_d] - potential, 1e-12))[mate] * sim
        order = np.lexsort((d, g, frame))
        edge = np.flatnonzero(np.diff(frame[order], prepend=-1, append=-1)) if len(order) else []
        chosen = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            at = order[lo:hi]
            if hi - lo == 1:
                chosen.append(at[0])
                continue
            (ug, row), (ud, col) = np.unique(g[at], return_inverse=True), np.unique(d[at], return_inverse=True)
            dense, item = np.zeros((len(ug), len(ud))), np.full((len(ug), len(ud)), -1)
            dense[row, col], item[row, col] = gain[at], at
            chosen += [item[i, j] for i, j in assign(dense) if item[i, j] >= 0]
        chosen = np.array(chosen, int)
        n_left, n_right = (np.bincount(x["video"], minlength=len(videos)) for x in (left, right))
        # the video of each pair of ids that ever meets
        home = np.zeros(len(mates), int)
        home[mate] = video
        out = []
        for alpha in ALPHAS:
            hit = chosen[sim[chosen] >= alpha - np.finfo(float).eps]
            tp, n = np.bincount(video[hit], minlength=len(videos)), np.bincount(mate[hit], minlength=len(mates))
            ass = [np.bincount(home, n * n / np.maximum(1, w), len(videos)) / np.maximum(1, tp) for w in (count_g[of_g] + count_d[of_d] - n, count_g[of_g], count_d[of_d])]
            loc = np.where(tp > 0, np.bincount(video[hit], sim[hit], len(videos)) / np.maximum(1, tp), 1.0)
            out.append(pd.DataFrame({"video": videos, "alpha": alpha, "tp": tp, "fn": n_left - tp, "fp": n_right - tp, "ass_a": ass[0], "ass_re": ass[1], "ass_pr": ass[2], "loc_a": loc}))
        return pd.concat(out)

    kind = gt.schema["video"].dataType.simpleString()
    dealt = rows.withColumn("_bucket", bucket_of(gt, ["video"])).groupBy("_bucket")
    return dealt.applyInPandas(one, f"video {kind}, alpha double, tp bigint, fn bigint, fp bigint, ass_a double, ass_re double, ass_pr double, loc_a double")


def hota_combined(rows: DataFrame) -> DataFrame:
    """Sequences combined per alpha: counts summed, association weighted by matches, final fields."""
    weighted = lambda c: F.sum(F.col(c) * F.col("tp")) / F.greatest(F.sum("tp"), F.lit(1))
    out = rows.groupBy("alpha").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"), *[weighted(c).alias(c) for c in ("ass_a", "ass_re", "ass_pr", "loc_a")])
    total = lambda *c: F.greatest(sum(map(F.col, c[1:]), F.col(c[0])), F.lit(1))
    out = out.withColumn("det_a", F.col("tp") / total("tp", "fn", "fp")).withColumn("det_re", F.col("tp") / total("tp", "fn")).withColumn("det_pr", F.col("tp") / total("tp", "fp"))
    return out.withColumn("hota", F.sqrt(F.col("det_a") * F.col("ass_a"))).withColumn("owta", F.sqrt(F.col("det_re") * F.col("ass_a")))


TETA_ALPHAS = [k / 20 for k in range(20)]
TETA_OUT = ["cls", "alpha", "loc_tp", "loc_fn", "loc_fp", "assoc_a", "assoc_re", "assoc_pr", "cls_tp", "cls_fn", "cls_fp"]
#: Similarity from which a prediction counts as overlapping a ground truth.
OVERLAP = 0.5


def _alignment(frames: list[tuple], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Jaccard alignment of ids over all frames, and the number of frames of each id on both sides."""
    potential, count_g, count_d = np.zeros(shape), np.zeros(shape[0]), np.zeros(shape[1])
    for g, d, sim in frames:
        whole = sim.sum(0)[None] + sim.sum(1)[:, None] - sim
        potential[np.ix_(g, d)] += np.divide(sim, whole, out=np.zeros_like(sim), where=whole > np.finfo(float).eps)
        count_g[g] += 1
        count_d[d] += 1
    return potential / np.maximum(count_g[:, None] + count_d[None] - potential, 1e-12), count_g, count_d


def teta(gt: DataFrame, det: DataFrame, similarity: DataFrame, exhaustive: bool = False) -> DataFrame:
    """Localisation, association and classification by (video, cls, alpha).

    gt: video, frame, gt_id, cls; det: video, frame, det_id, cls; similarity: video, frame, gt_id,
    det_id, sim.  A class is judged on the predictions that overlap its ground truths in some frame,
    whatever class they claim; a prediction that the class-free assignment gives to another class's
    ground truth doesn't count as overlapping.  Classification counts start at alpha 0.5 and are null
    below it.  A wrong claim is a false positive of the claimed class; with ``exhaustive``, so is each
    claim that overlaps no ground truth of its class.  Videos are groups of their own.
    """
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    rows = gt.select("video", "frame", F.lit(0).alias("kind"), text("gt_id").alias("g"), none.alias("d"), text("cls").alias("cls"), F.lit(0.0).alias("sim"))
    rows = rows.unionByName(det.select("video", "frame", F.lit(1).alias("kind"), none.alias("g"), text("det_id").alias("d"), text("cls").alias("cls"), F.lit(0.0).alias("sim")))
    rows = rows.unionByName(similarity.select("video", "frame", F.lit(2).alias("kind"), text("gt_id").alias("g"), text("det_id").alias("d"), none.alias("cls"), F.col("sim").cast("double").alias("sim")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        video, eps = pdf["video"].iloc[0], np.finfo(float).eps
        gi = {g: i for i, g in enumerate(sorted(pdf.loc[pdf["kind"] == 0, "g"].unique()))}
        di = {d: i for i, d in enumerate(sorted(pdf.loc[pdf["kind"] == 1, "d"].unique()))}
        pdf = pdf[pdf["frame"].notna()].sort_values(["frame", "kind"], kind="stable")
        kinds, cls = pdf["kind"].to_numpy(), pdf["cls"].to_numpy()
        g_at, d_at = (pdf[c].map(i).fillna(-1).to_numpy(int) for c, i in (("g", gi), ("d", di)))
        values, sim, frames = pdf["sim"].to_numpy(), np.zeros((len(gi), len(di))), []
        cuts = np.flatnonzero((pdf["frame"] != pdf["frame"].shift()).to_numpy())
        for lo, hi in zip(cuts, [*cuts[1:], len(pdf)], strict=False):
            mid, end = lo + np.searchsorted(kinds[lo:hi], (1, 2))
            g, d, pairs_g, pairs_d = g_at[lo:mid], d_at[mid:end], g_at[end:hi], d_at[end:hi]
            both = (pairs_g >= 0) & (pairs_d >= 0)
            pairs_g, pairs_d = pairs_g[both], pairs_d[both]
            sim[pairs_g, pairs_d] = values[end:hi][both]
            frames.append((g, cls[lo:mid], d, cls[mid:end], sim[np.ix_(g, d)]))
            sim[pairs_g, pairs_d] = 0.0
        shape = (len(gi), len(di))
        whole = _alignment([(g, d, s) for g, _, d, _, s in frames], shape)[0]
        given = [[(i, j) for i, j in assign(whole[np.ix_(g, d)] * s) if s[i, j] >= OVERLAP - eps] for g, _, d, _, s in frames]
        names = sorted({c for _, gc, _, dc, _ in frames for c in (*gc, *dc) if c is not None})
        known = {c for _, gc, _, _, _ in frames for c in gc}
        sums = {c: {k: np.zeros(len(TETA_ALPHAS)) for k in TETA_OUT[2:]} for c in names}
        for cls in names:
            own, overlapping = sums[cls], []
            for (g, gc, d, dc, s), pairs in zip(frames, given, strict=True):
                near = (s[gc == cls] >= OVERLAP).any(0) if (gc == cls).any() else np.zeros(len(d), bool)
                near[[j for i, j in pairs if gc[i] != cls]] = False
                overlapping.append(near)
                if exhaustive:
                    own["cls_fp"] += ((dc == cls) & ~near).sum()
            ids = {int(x) for (_, _, d, _, _), near in zip(frames, overlapping, strict=True) for x in d[near]}
            if not ids:
                own["loc_fn"] += sum(int((gc == cls).sum()) for _, gc, _, _, _ in frames)
                continue
            cut, member = [], np.zeros(len(di), bool)
            member[list(ids)] = True
            for (g, gc, d, dc, s), near in zip(frames, overlapping, strict=True):
                mine = member[d]
                cut.append((g[gc == cls], d[mine], dc[mine], near[mine], s[gc == cls][:, mine]))
            align, count_g, count_d = _alignment([(g, d, s) for g, d, _, _, s in cut], shape)
            hits, levels = np.zeros((len(TETA_ALPHAS), *shape)), np.array(TETA_ALPHAS) - eps
            for g, d, dc, near, s in cut:
                if not len(g):
                    continue
                pairs = assign(align[np.ix_(g, d)] * s)
                i, j = np.array(pairs, int).reshape(-1, 2).T
                met = s[i, j][None] >= levels[:, None]  # [alphas, pairs]
                count, high = met.sum(1), levels >= 0.5 - eps
                own["loc_tp"] += count
                own["loc_fn"] += len(g) - count
                own["loc_fp"] += near.sum() - (met & near[j]).sum(1)
                np.add.at(hits, (slice(None), g[i], d[j]), met)
                right = (met & (dc[j] == cls)).sum(1)
                own["cls_tp"] += np.where(high, right, 0)
                own["cls_fn"] += np.where(high, count - right, 0)
                for k, x in enumerate(j):
                    if dc[x] != cls and dc[x] in known:
                        sums[dc[x]]["cls_fp"] += met[:, k] & high
            for a in range(len(TETA_ALPHAS)):
                n, tp = hits[a], max(1.0, own["loc_tp"][a])
                for name, base in (("assoc_a", count_g[:, None] + count_d[None] - n), ("assoc_re", count_g[:, None] + 0 * n), ("assoc_pr", count_d[None] + 0 * n)):
                    own[name][a] = (n * n / np.maximum(1, base)).sum() / tp
        out = []
        for cls in names:
            for a, alpha in enumerate(TETA_ALPHAS):
                own = [float(sums[cls][k][a]) for k in TETA_OUT[2:]]
                out.append((video, cls, alpha, *own[:6], *(own[6:] if alpha >= 0.5 else [None] * 3)))
        return pd.DataFrame(out, columns=["video", *TETA_OUT])

    kind = gt.schema["video"].dataType.simpleString()
    return rows.groupBy("video").applyInPandas(one, f"video {kind}, cls string, alpha double, " + ", ".join(f"{c} double" for c in TETA_OUT[2:]))


def teta_combined(rows: DataFrame, by: list[str]) -> DataFrame:
    """Videos, and with by = [] classes too, combined: counts summed, association weighted by matches, means over alpha."""
    weighted = lambda c: F.sum(F.col(c) * F.col("loc_tp")) / F.greatest(F.sum("loc_tp"), F.lit(1.0))
    counts = ("loc_tp", "loc_fn", "loc_fp", "cls_tp", "cls_fn", "cls_fp")
    per = rows.groupBy(*by, "alpha").agg(*[F.sum(c).alias(c) for c in counts], *[weighted(c).alias(c) for c in ("assoc_a", "assoc_re", "assoc_pr")])
    share = lambda p, *c: F.col(p) / F.greatest(sum(map(F.col, c), F.col(p)), F.lit(1.0))
    parts = per.select(*by, "alpha", share("loc_tp", "loc_fn", "loc_fp").alias("loc_a"), share("loc_tp", "loc_fn").alias("loc_re"), share("loc_tp", "loc_fp").alias("loc_pr"), "assoc_a", "assoc_re", "assoc_pr", share("cls_tp", "cls_fn", "cls_fp").alias("cls_a"), share("cls_tp", "cls_fn").alias("cls_re"), share("cls_tp", "cls_fp").alias("cls_pr"))
    out = parts.groupBy(*by).agg(*[F.avg(c).alias(c) for c in parts.columns if c not in (*by, "alpha")])
    return out.withColumn("teta", (F.col("loc_a") + F.col("assoc_a") + F.col("cls_a")) / 3)
