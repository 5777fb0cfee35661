"""Combinations of per-class and per-pair results; all are map-side combined aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_average(rows: DataFrame, bucket: str, value: str) -> DataFrame:
    """(bucket, mean): means ignoring values of -1, and as "overall" the unweighted mean over buckets."""
    means = rows.where(F.col(value) > -1).groupBy(F.col(bucket).cast("string").alias(bucket)).agg(F.avg(value).alias("mean"))
    return means.unionByName(means.agg(F.lit("overall").alias(bucket), F.avg("mean").alias("mean")))


def averages(rows: DataFrame, category: str, value: str) -> DataFrame:
    """Mean over rows (weighted by category size) and mean of the categories' means (true)."""
    sums = rows.groupBy(category).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return sums.agg((F.sum("s") / F.sum("n")).alias("weighted_mean"), F.avg(F.col("s") / F.col("n")).alias("category_mean"))


def super_categories(rows: DataFrame, mapping: DataFrame, category: str, counts: list[str]) -> DataFrame:
    """Counts of classes summed up to their super class."""
    return rows.join(mapping, category).groupBy("super").agg(*[F.sum(c).alias(c) for c in counts])


def pair_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of a (video, phrase) pair; 1 where there is nothing to find and nothing found."""
    whole = 2 * tp + fp + fn
    return F.when(whole > 0, 2 * tp / whole).otherwise(F.lit(1.0))


def track_summary(rows: DataFrame, video: str, track: str, score: str, label: str) -> DataFrame:
    """Mean score and most frequent label of each track; of labels as frequent the least."""
    by_label = rows.groupBy(video, track, label).agg(F.count(F.lit(1)).alias("_n"), F.sum(score).alias("_s"))
    return by_label.groupBy(video, track).agg((F.sum("_s") / F.sum("_n")).alias("score"), F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("label"))


def track_iou(left: DataFrame, right: DataFrame, video: str, frame: str, left_id: str, right_id: str, inter: Column, area_left: Column, area_right: Column) -> DataFrame:
    """IoU of tracklets: sums over all frames; a frame that one side alone has enlarges the union."""
    total_left = left.groupBy(video, left_id).agg(F.sum(area_left).alias("_l"))
    total_right = right.groupBy(video, right_id).agg(F.sum(area_right).alias("_r"))
    both = left.join(right, [video, frame]).groupBy(video, left_id, right_id).agg(F.sum(inter).alias("_i"))
    joined = both.join(total_left, [video, left_id]).join(total_right, [video, right_id])
    union = F.col("_l") + F.col("_r") - F.col("_i")
    return joined.select(video, left_id, right_id, F.when(union > 0, F.col("_i") / union).otherwise(F.lit(0.0)).alias("iou"))


def best_ground_truth(rows: DataFrame, image: str, ordinal: str, f1: str, negative: Column) -> DataFrame:
    """Of several ground truths of an image the one that scores best.

    They are gone through by ordinal: the later replaces the best so far if it is a true negative, or if
    both have a local F1 and its own is larger.
    """
    taken = F.array_sort(F.collect_list(F.struct(ordinal, negative.alias("negative"), F.col(f1).alias("f1"))))
    better = lambda best, x: x["negative"] | (best["f1"].isNotNull() & x["f1"].isNotNull() & (x["f1"] > best["f1"]))
    pick = F.aggregate(F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), F.get("_t", F.lit(0)), lambda best, x: F.when(better(best, x), x).otherwise(best))
    return rows.groupBy(image).agg(taken.alias("_t")).select(image, pick.alias("_b")).select(image, f"_b.{ordinal}", "_b.f1")
