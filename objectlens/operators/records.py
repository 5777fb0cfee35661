"""Records between the stages: limits, ids, frames, query filters, manifests, counters and output rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objectlens.functions.shapes import seeded

NO_BOX = "area IS NULL OR area = 0 OR box IS NULL"


def first_n(rows: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in an order; n of 0 or less takes all."""
    return rows.orderBy(*order).limit(n) if n > 0 else rows


def shape_guard(rows: DataFrame, h: str, w: str, height: str, width: str) -> DataFrame:
    """Masks of the picture's size."""
    return rows.where((F.col(h) == F.col(height)) & (F.col(w) == F.col(width)))


def empty_box(box: Column) -> Column:
    """Null, or zeros throughout."""
    return box.isNull() | ~F.exists(box, lambda v: v != 0)


def without_empty_frames(boxes: Column, masks: Column, areas: Column) -> tuple[Column, Column, Column]:
    """Parallel lists over frames: where the area is 0 or null or the box empty, all three entries are null."""
    gone = F.zip_with(boxes, areas, lambda b, a: empty_box(b) | a.isNull() | (a == 0))
    keep = lambda column: F.zip_with(column, gone, lambda v, g: F.when(~g, v))
    return keep(boxes), keep(masks), keep(areas)


def prediction_frames(tracks: DataFrame, images: DataFrame, keep: list[str], strict: bool = False) -> DataFrame:
    """A row for each frame in which a predicted track has a box: video_id, frame, image_id, box, area and the columns keep.

    tracks: video_id, boxes, areas (null or parallel to boxes); images: video_id, frame, image_id.  A null or
    all-zero box is no box; without an area above 0 it is width times height.  A frame that no image has raises
    if strict, else its image_id is null.
    """
    one = tracks.select("video_id", *keep, F.posexplode("boxes").alias("frame", "box"), "areas").where(~empty_box(F.col("box")))
    given = F.get("areas", F.col("frame"))
    area = F.when(given > 0, given.cast("double")).otherwise((F.get("box", F.lit(2)) * F.get("box", F.lit(3))).cast("double"))
    found = one.withColumn("area", area).drop("areas").join(images.select("video_id", F.col("frame").cast("int").alias("frame"), "image_id"), ["video_id", "frame"], "left")
    if not strict:
        return found
    text = F.concat(F.lit("no image for video "), F.col("video_id").cast("string"), F.lit(", frame "), F.col("frame").cast("string"))
    return found.withColumn("image_id", F.coalesce("image_id", F.raise_error(text).cast(found.schema["image_id"].dataType)))


def max_per_frame(rows: DataFrame, video: str, frame: str, place: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` queries of a video, chosen by a seed among its first frame's, at the same places in all frames."""
    first = rows.withColumn("_f", F.min(frame).over(Window.partitionBy(video))).where(F.col("_f") == F.col(frame))
    order = F.md5(F.concat_ws(":", F.col(video).cast("string"), F.col(place).cast("string"), F.lit(str(seed))))
    chosen = first.withColumn("_r", F.row_number().over(Window.partitionBy(video).orderBy(order, place))).where(F.col("_r") <= most)
    return rows.join(chosen.select(video, place), [video, place], "left_semi")


def sample_per_frame(rows: DataFrame, keys: list[str], ident: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` queries of each frame, by a seeded digest."""
    order = F.md5(F.concat_ws(":", F.col(ident).cast("string"), F.lit(str(seed))))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, ident))).where(F.col("_r") <= most).drop("_r")


def semantic_only(queries: DataFrame, box: str) -> DataFrame:
    """Queries without an input box."""
    return queries.where(F.col(box).isNull())


def without_boxes(queries: DataFrame, box: str) -> DataFrame:
    """All queries, their input boxes taken away."""
    return queries.withColumn(box, F.lit(None).cast(queries.schema[box].dataType))


def overwritten(text: Column, key: Column, by: str, percent: int, seed: int = 0) -> Column:
    """The text, or in a seeded share of the rows another."""
    return F.when(seeded(key, seed, F.lit(100)) < percent, F.lit(by)).otherwise(text)


def within_caps(datapoints: DataFrame, annotations: str, queries: str, most_annotations: int, most_queries: int) -> DataFrame:
    """Datapoints that a loader takes: up to both caps, with any query at all."""
    return datapoints.where((F.col(annotations) <= most_annotations) & F.col(queries).between(1, most_queries))


def crops_in_manifests(crops: DataFrame, manifests: DataFrame, files: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Manifest rows of the folders with crops whose file exists."""
    return manifests.join(crops.select(*keys).distinct(), keys, "left_semi").join(files.select(path).distinct(), path, "left_semi")


def image_ids(rows: DataFrame, images: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Rows with the image_id of their (video, frame); a pair that no image has raises if strict, else is left out."""
    joined = rows.join(images.select(*keys, "image_id"), keys, "left" if strict else "inner")
    if not strict:
        return joined
    missing = F.raise_error(F.concat(F.lit("no image for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    return joined.withColumn("image_id", F.coalesce("image_id", missing.cast(images.schema["image_id"].dataType)))


def frame_annotations(annotations: DataFrame, video: str, frame: str, phrase: str, at: tuple) -> DataFrame:
    """The annotations of one frame by phrase."""
    return annotations.where((F.col(video) == at[0]) & (F.col(frame) == at[1])).orderBy(phrase)


def run_statistics(rows: DataFrame, video: str, objects: str, failed: Column) -> DataFrame:
    """Videos, objects and errors of a run."""
    return rows.agg(F.countDistinct(video).alias("videos"), F.coalesce(F.sum(objects), F.lit(0)).alias("objects"), F.count_if(failed).alias("errors"))


def inpaint_counts(rows: DataFrame, needed: Column, possible: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(needed).alias("needed"), F.count_if(needed & possible).alias("inpainted"))


def cluster_counts(rows: DataFrame, label: str) -> DataFrame:
    """Clusters, and rows in none."""
    return rows.agg(F.countDistinct(F.when(F.col(label) != -1, F.col(label))).alias("clusters"), F.count_if(F.col(label) == -1).alias("noise"))


def unique_images(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each image."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def common_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def foreign_ids(results: DataFrame, gt: DataFrame, key: str) -> DataFrame:
    """Ids of results that the ground truth hasn't; empty in a sound run."""
    return results.select(key).distinct().join(gt.select(key).distinct(), key, "left_anti")


def complement(kept: Column, n: Column) -> Column:
    """The places 0..n-1 that aren't kept."""
    return F.when(n > 0, F.array_except(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), kept.cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>"))


def phrase_videos(pairs: DataFrame, number: str, files: str) -> DataFrame:
    """Every (video, phrase) as a video of its own with category 1; its files stand in a folder of its own."""
    folder = F.format_string("remapped_vid_%012d/", F.col(number).cast("bigint"))
    return pairs.withColumn(files, F.transform(files, lambda f: F.concat(folder, f))).withColumn("category_id", F.lit(1))


def object_id(label: Column, path: Column) -> Column:
    """obj_ and the cluster's number in five places; an object in no cluster is named by a stable digest of its path."""
    return F.when(label >= 0, F.format_string("obj_%05d", label.cast("bigint"))).otherwise(F.concat(F.lit("obj_x"), F.substring(F.md5(path), 1, 16)))


def served_path(path: Column, root: str, mount: str) -> Column:
    """The path under the mount where it begins with the root, else as it is."""
    return F.when(path.startswith(root), F.concat(F.lit(mount), F.substr(path, F.lit(len(root) + 1)))).otherwise(path)


def page_name(url: Column) -> Column:
    """What stands behind a URL's last slash, without query."""
    return F.substring_index(F.substring_index(url, "?", 1), "/", -1)


def detail(entries: DataFrame, key: str, value) -> DataFrame:
    """The entry of an id; a missing id raises when the row is read."""
    found = entries.where(F.col(key) == value)
    one = found.sparkSession.range(1).select(F.lit(value).cast(entries.schema[key].dataType).alias("_asked"))
    joined = one.join(found.withColumn("_found", F.lit(True)), F.col("_asked") == F.col(key), "left")
    missing = F.raise_error(F.lit(f"no entry {value}")).cast(entries.schema[key].dataType)
    return joined.withColumn(key, F.when(F.col("_found"), F.col(key)).otherwise(missing)).select(*entries.columns)


def padded_tracks(tracks: DataFrame, values: str, scores: str, n: Column, fill: float = 0.0, unseen: float = -1e8) -> DataFrame:
    """Parallel lists filled up to n frames: zeros for values, a score that never wins for scores."""
    fit = lambda c, f: F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.coalesce(F.get(c, k), F.lit(f)))
    return tracks.withColumn(values, fit(F.col(values), fill)).withColumn(scores, fit(F.col(scores), unseen))


def sequential_ids(pairs: DataFrame, extra: str, order: list[str], name: str) -> DataFrame:
    """Ids 1, 2, .. in order, rows marked extra (negatives) behind all others."""
    from objectlens.operators.reshape import ranked

    return ranked(pairs.withColumn("_extra", F.coalesce(F.col(extra), F.lit(False)).cast("int")), ["_extra", *order], name).drop("_extra")


def remapped_pointers(objects: DataFrame, kept: DataFrame, group: str, ident: str, name: str) -> DataFrame:
    """Objects that a kept query points at, with new numbers 0.. in each datapoint; others go."""
    used = objects.join(kept.select(group, ident).distinct(), [group, ident], "left_semi")
    return used.withColumn(name, F.dense_rank().over(Window.partitionBy(group).orderBy(ident)) - 1)


def new_track_ids(new: DataFrame, held: DataFrame, video: str, order: list[str | Column], ident: str) -> DataFrame:
    """New detections of each video with ids behind its greatest one so far; a video without tracks begins at 0."""
    most = held.groupBy(video).agg(F.max(ident).alias("_most"))
    place = F.row_number().over(Window.partitionBy(video).orderBy(*order))
    return new.join(most, video, "left").withColumn(ident, F.coalesce("_most", F.lit(-1)) + place).drop("_most")


def processing_order(start: Column, count: Column, last: Column, reverse: bool = False) -> Column:
    """Frames that a pass goes through: forward from the start up to count frames further, that one included; backward without the start."""
    if reverse:
        end = F.greatest(start - count, F.lit(0))
        return F.when(start > 0, F.sequence(start - 1, end, F.lit(-1))).otherwise(F.array().cast("array<bigint>"))
    return F.sequence(start, F.least(start + count, last))


def recondition(frame: Column, every: int, det_score: Column, overlap: Column, sure: float = 0.8, low: float = 0.5) -> Column:
    """Whether a track's mask is to be replaced by its detection: at every n-th frame, or where they overlap too little, by a confident detection."""
    due = (frame % every == 0) if every > 0 else F.lit(False)
    return (due | (overlap < low)) & (det_score >= sure)


def assembled(rows: DataFrame, hidden: str, area: str, width: str, height: str) -> DataFrame:
    """Output rows: without hidden and empty masks, boxes (x1, y1, w, h) as shares of the picture."""
    seen = rows.where(~F.coalesce(F.col(hidden), F.lit(False)) & (F.col(area) > 0))
    return seen.withColumns({c: F.col(c) / F.col(size) for c, size in (("x1", width), ("y1", height), ("w", width), ("h", height))})


def crop_folders(paths: DataFrame, path: str, marker: str = "seg_00_mask.png") -> DataFrame:
    """Folders that hold the marker file, in order."""
    return paths.where(F.col(path).endswith("/" + marker)).select(F.substr(F.col(path), F.lit(1), F.length(path) - len(marker) - 1).alias("folder")).distinct().orderBy("folder")


def config_files(paths: DataFrame, path: str, suffix: str = ".yaml") -> DataFrame:
    """Configuration files of runs, without those in a copy of the code."""
    return paths.where(F.col(path).endswith(suffix) & ~F.col(path).contains("/code/"))


def metric_by_suffix(stats: DataFrame, metrics: str, suffix: str) -> DataFrame:
    """(subset, value) of the metric whose name ends so, and their mean as subset null."""
    value = F.map_values(F.map_filter(metrics, lambda k, _: k.endswith(suffix)))[0]
    rows = stats.select("subset", value.alias("value")).where("value IS NOT NULL")
    return rows.unionByName(rows.agg(F.lit(None).cast("string").alias("subset"), F.avg("value").alias("value")))


def phrase_queries(images: DataFrame) -> DataFrame:
    """One query for each image row: its phrase, and whether its instances are exhaustive."""
    return images.select(F.col("id").alias("image_id"), F.col("text_input").alias("query_text"), F.coalesce(F.col("is_instance_exhaustive").cast("boolean"), F.lit(False)).alias("is_exhaustive"), F.lit(0).alias("query_processing_order"))


def masklet_record(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes over frames as shares of the picture: pixel boxes, which have an entry above 1, are divided."""
    scale = F.array(width, height, width, height)
    pixels = lambda b: F.array_max(b) > 1
    return F.transform(boxes, lambda b: F.when(pixels(b), F.zip_with(b, scale, lambda v, s: v / s)).otherwise(b))


def replaced(cache: DataFrame, anew: DataFrame, keys: list[str]) -> DataFrame:
    """Cached output in which the frames computed anew stand in place of the old ones, also where they are empty of the old rows."""
    return cache.join(anew.select(*keys).distinct(), keys, "left_anti").unionByName(anew)
