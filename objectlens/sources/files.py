"""Readers and writers of the catalogue's and the evaluators' file formats.

Manifests are read by Spark's JSON and CSV readers, so lines are split over tasks.  An annotation
file is one JSON document and is parsed by one task a file; write its parts as Parquet once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTIONS = "dataset string, camera string, video string, seg_idx int, prompt string, score double, bbox array<int>, crop_path string, mask_path string"
ATTRIBUTES = "crop_path string, attributes struct<category string, color string, material string, shape string, texture string, raw_output string, error string>"
ANNOTATIONS = (
    "images array<struct<id bigint, file_name string, text_input string, width int, height int, is_instance_exhaustive int>>, "
    "annotations array<struct<id bigint, image_id bigint, area double, bbox array<double>, segmentation struct<counts string, size array<int>>, category_id int, iscrowd int>>, "
    "categories array<struct<id int, name string>>"
)


def read_manifest(spark: SparkSession, path: str, schema: str = DETECTIONS, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped.  A malformed line raises if strict, else it is left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    marked = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return marked.where("_bad IS NULL").drop("_bad")


def write_manifests(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines for each dataset and camera; a key's folder is replaced as a whole, others stay."""
    rows.write.partitionBy("dataset", "camera").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def last_records(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the record with the greatest order, as a log's last line."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def read_annotations(spark: SparkSession, path: str, schema: str = ANNOTATIONS) -> dict[str, DataFrame]:
    """The tables of annotation files, by name."""
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return {f.name: whole.select(F.explode(f.name).alias("_e")).select("_e.*") for f in whole.schema}


def annotations_by_image(tables: dict[str, DataFrame]) -> DataFrame:
    """Each image with the array of its annotations, by id; images without any have an empty one."""
    own = tables["annotations"].groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "bbox", "area", "category_id", "iscrowd"))).alias("annotations"))
    joined = tables["images"].join(own, F.col("id") == F.col("image_id"), "left").drop("image_id")
    return joined.withColumn("annotations", F.coalesce("annotations", F.array().cast(own.schema["annotations"].dataType)))


def loaded_results(rows: DataFrame) -> DataFrame:
    """Predictions completed as a result loader does: area from the box, ids from 1 on by place, iscrowd 0.

    Ids are Spark's increasing ids: unique, but with gaps between partitions.
    """
    return rows.withColumn("area", F.get("bbox", F.lit(2)) * F.get("bbox", F.lit(3))).withColumn("id", F.monotonically_increasing_id() + 1).withColumn("iscrowd", F.lit(0))


def rounded_predictions(bbox: Column, score: Column, places: int = 5) -> tuple[Column, Column]:
    """Box and score rounded half to even, as they are dumped."""
    return F.transform(bbox, lambda v: F.bround(v, places)), F.bround(score, places)


def video_tracks(annotations: DataFrame) -> DataFrame:
    """Video annotations: a null box becomes zeros, the area is the mean over frames where it is visible."""
    boxes = F.transform("bboxes", lambda b: F.coalesce(b, F.array(*[F.lit(0)] * 4)))
    seen = F.filter("areas", lambda a: a.isNotNull())
    mean = F.aggregate(seen, F.lit(0.0), lambda s, a: s + a) / F.greatest(F.size(seen), F.lit(1))
    return annotations.withColumn("bboxes", boxes).withColumn("area", mean)


def phrase_frames(pairs: DataFrame, videos: DataFrame) -> DataFrame:
    """Every frame of a video for every phrase asked of it."""
    frames = videos.select(F.col("id").alias("video_id"), F.posexplode("file_names").alias("frame", "file_name"))
    return pairs.join(frames, "video_id")


def category_chunks(images: DataFrame, categories: DataFrame, chunk: int, id_col: str = "id") -> DataFrame:
    """Datapoints (image, chunk, categories): the categories, at most a few thousand names, in chunks by id."""
    listed = categories.agg(F.sort_array(F.collect_set(id_col)).alias("_c"))
    chunks = listed.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("_c") / chunk).cast("int") - 1, F.lit(0))), lambda k: F.slice("_c", k * chunk + 1, chunk))).alias("chunk", "categories"))
    return images.join(F.broadcast(chunks), F.size("categories") > 0)


def read_mot(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Tracking text files: frame, track, x, y, w, h, score and the source file; frames that aren't numbers are left out."""
    raw = spark.read.option("sep", delimiter).schema("frame string, track string, x double, y double, w double, h double, score double").csv(path)
    return raw.withColumn("frame", F.expr("try_cast(try_cast(frame AS double) AS bigint)")).where("frame IS NOT NULL").withColumn("sequence", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1))


def media_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Paths below a folder whose names fit a glob; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def resource_kind(path: Column) -> Column:
    """image or video by extension; a path without extension is a video."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg", "png", "bmp", "tiff", "webp"), "image").when(ext.isin("", "mp4", "mov", "avi", "mkv", "webm"), "video")


def write_library(library: DataFrame, path: str, shown: int = 50) -> None:
    """The index, with the first instances of each object, and beside it all instances."""
    library.withColumn("instances", F.slice("instances", 1, shown)).write.mode("overwrite").json(f"{path}/index")
    library.select("id", "instances").write.mode("overwrite").parquet(f"{path}/instances")


def write_summary(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """More lines in a log of JSON lines; what it holds stays."""
    rows.write.mode("append").json(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    """Metrics, a few rows, as one file of JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def read_library(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The library's index; a missing one is empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/index")
    return spark.read.schema(schema).json(f"{path}/index") if at.getFileSystem(conf).exists(at) else spark.createDataFrame([], schema)


def keep_canonical(new: DataFrame, old: DataFrame) -> DataFrame:
    """Entries of a library written again: an id that had a canonical image keeps it."""
    kept = old.select("id", F.col("canonical_path").alias("_old"))
    return new.join(kept, "id", "left").withColumn("canonical_path", F.coalesce("_old", "canonical_path")).drop("_old")


def write_annotations(tables: dict[str, DataFrame], images: DataFrame, path: str) -> None:
    """The tables confined to some images, at a path of their own; the original stays as it is."""
    ids = images.select("id").distinct()
    tables["images"].join(ids, "id", "left_semi").write.mode("overwrite").json(f"{path}/images")
    own = tables["annotations"].join(ids.withColumnRenamed("id", "image_id"), "image_id", "left_semi")
    own.write.mode("overwrite").json(f"{path}/annotations")
    for name in set(tables) - {"images", "annotations"}:
        tables[name].write.mode("overwrite").json(f"{path}/{name}")


def reindexed(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Images, annotations and categories with ids from 1 on where a table's begin at 0, and their references."""
    shift = {n: tables[n].agg(F.coalesce(F.max((F.col("id") == 0).cast("int")), F.lit(0)).alias(f"_{n}")) for n in ("images", "annotations", "categories")}
    moved = lambda df, n, c: df.crossJoin(F.broadcast(shift[n])).withColumn(c, F.col(c) + F.col(f"_{n}")).drop(f"_{n}")  # noqa: E731, one row
    out = {n: moved(tables[n], n, "id") for n in shift}
    out["annotations"] = moved(moved(out["annotations"], "images", "image_id"), "categories", "category_id")
    return {**tables, **out}


def image_frames(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(frame, path, content) of a folder of images in the order of their numbers, then names."""
    from pyspark.sql import Window

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    number = F.expr("try_cast(regexp_extract(path, '([0-9]+)[.][^./]*$', 1) AS BIGINT)")
    return found.withColumn("frame", F.row_number().over(Window.orderBy(F.asc_nulls_last(number), "path")) - 1).select("frame", "path", "content")  # one video's frames


def dummy_frames(spark: SparkSession, n: int) -> DataFrame:
    """n frames without content."""
    return spark.range(n).select(F.col("id").alias("frame"), F.lit(None).cast("binary").alias("content"))


def read_catalogue(spark: SparkSession, path: str, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a CSV catalogue whose id is asked for."""
    rows = spark.read.option("header", True).csv(path)
    return rows.join(ids.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_semi")


#: Readers by name, for callers that are told which one to use.
READERS = {"manifest": read_manifest, "annotations": read_annotations, "mot": read_mot, "images": image_frames, "dummy": dummy_frames}


def html_page(cards: DataFrame, facets: DataFrame, title: str, card: str = "card", order: str = "label") -> DataFrame:
    """One row: the page of all cards in order, with the counts of facet values beside them.

    The page is one file by nature; cards hold text and paths, no images.
    """
    body = cards.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, card))), lambda e: e[card]), "").alias("body"))
    line = F.concat(F.lit("<li>"), F.col("facet"), F.lit(": "), F.col("value"), F.lit(" ("), F.col("n").cast("string"), F.lit(")</li>"))
    side = facets.agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("side"))
    page = F.concat(F.lit(f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{title}</title></head><body><ul>"), "side", F.lit("</ul><main>"), "body", F.lit("</main></body></html>"))
    return body.crossJoin(F.broadcast(side)).select(page.alias("page"))  # one row each
