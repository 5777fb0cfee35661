"""Tracks and frames, id spaces, query filters, run-length masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames_to_tracks(rows: DataFrame, video: str, track: str, frame: str, value: str, length: Column) -> DataFrame:
    """One row per track with an array over all frames 0..length-1, null where the track isn't seen."""
    entries = rows.groupBy(video, track).agg(F.map_from_entries(F.collect_list(F.struct(frame, value))).alias("_m"), F.max(length).alias("_n"))
    return entries.select(video, track, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1), lambda f: F.try_element_at("_m", f)).alias("values"))


def tracks_to_frames(tracks: DataFrame, video: str, track: str, values: str) -> DataFrame:
    """One row per seen frame: unpivots the array and skips nulls."""
    return tracks.select(video, track, F.posexplode(values).alias("frame", "value")).where("value IS NOT NULL")


def ranked(rows: DataFrame, order: list[str], name: str, ranges: int = 200) -> DataFrame:
    """Places 1, 2, ... in the order of columns that tell all rows apart, without one task that sees all rows.

    Rows are dealt to ranges of the first column, numbered inside each, and moved by the sizes of the ranges
    before.  The bounds are ``ranges`` distinct values chosen by hash: all that the driver holds.
    """
    first = F.col(order[0])
    chosen = rows.select(first).where(first.isNotNull()).distinct().orderBy(F.xxhash64(first), first).limit(ranges).collect()
    bounds = F.array(*[F.lit(r[0]) for r in chosen]) if chosen else F.array().cast(f"array<{rows.schema[order[0]].dataType.simpleString()}>")
    dealt = rows.withColumn("_range", F.size(F.filter(bounds, lambda b: first.isNotNull() & (b <= first))))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # at most ranges + 1 rows
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_place") + F.col("_before"))).drop("_range", "_place", "_before")


def class_agnostic(rows: DataFrame, video: str, category: str) -> DataFrame:
    """(video, category) pairs become videos of their own, numbered in order, with category 1."""
    pairs = rows.groupBy(video, category).agg(F.count(F.lit(1)).alias("n"))
    return ranked(pairs, [video, category], "new_video")


def keep_max_queries(rows: DataFrame, group: str, key: str, most: int, positive: Column, seed: int = 0) -> DataFrame:
    """At most ``most`` queries of each group, positives first, then by a seeded digest."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    order = Window.partitionBy(group).orderBy(positive.cast("int").desc(), digest, F.col(key))
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def text_affix(text: Column, prefix: str, suffix: str, only: list[str] | None = None) -> Column:
    """Prefix and suffix on every text but "geometric", or on the listed ones alone, whatever their case."""
    fits = text != "geometric"
    if only is not None:
        fits = fits & F.lower(F.trim(text)).isin([o.lower() for o in only])
    return F.when(fits, F.concat(F.lit(prefix), text, F.lit(suffix))).otherwise(text)


def rle_area(counts: Column) -> Column:
    """Area of uncompressed run lengths: background and foreground runs alternate."""
    return F.aggregate(F.filter(counts, lambda c, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda s, c: s + c)


def rle_spans(counts: Column) -> Column:
    """Foreground runs as (start, end) places in column-major order."""
    # one pass: the array of ends grows by the last end plus the next run
    none = F.array().cast("array<bigint>")
    ends = F.aggregate(counts, none, lambda done, c: F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0).cast("bigint")) + c)))
    spans = F.zip_with(counts, ends, lambda c, e: F.struct((e - c).alias("start"), e.alias("end")))
    return F.filter(F.filter(spans, lambda s, i: i % 2 == 1), lambda s: s["end"] > s["start"])


def rle_intersection(a: Column, b: Column) -> Column:
    """Pixels in both of two span lists."""
    over = lambda s: F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, t: acc + F.greatest(F.least(s["end"], t["end"]) - F.greatest(s["start"], t["start"]), F.lit(0).cast("bigint")))
    return F.aggregate(F.transform(a, over), F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def confirmed_runs(rows: DataFrame, video: str, track: str, frame: str, need: int) -> DataFrame:
    """First frame at which a track has been seen in ``need`` consecutive frames; tracks never confirmed are absent."""
    w = Window.partitionBy(video, track).orderBy(frame)
    runs = rows.select(video, track, frame).withColumn("_island", F.col(frame) - F.row_number().over(w))
    sized = runs.groupBy(video, track, "_island").agg(F.min(frame).alias("_start"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= need)
    return sized.groupBy(video, track).agg((F.min("_start") + (need - 1)).alias("confirmed_at"))
