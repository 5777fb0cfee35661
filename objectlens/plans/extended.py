"""Registered queries of records, evaluation by area, combinations over classes and run-length strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlens.functions import rle
from objectlens.operators import evaluation, metrics, records, suppression
from objectlens.plans.registry import query as _query
from objectlens.plans.registry import rounded as _r
from objectlens.sources.views import VIEWS


# limits, ids and records
@_query("SELECT page_id FROM pages ORDER BY page_id LIMIT 7")
def first_rows(v, t):
    return records.first_n(t("pages").select("page_id"), 7, "page_id")


@_query("SELECT page_id FROM pages")
def first_rows_all(v, t):
    return records.first_n(t("pages").select("page_id"), 0, "page_id")


@_query("SELECT det_id FROM det JOIN img USING (image_id) WHERE w % 2 = 0 AND h % 2 = 0", "det", "img")
def shape_guarded(v, t):
    rows = v("det").join(v("img"), "image_id").withColumn("mw", F.col("width") - F.col("w") % 2).withColumn("mh", F.col("height") - F.col("h") % 2)
    return records.shape_guard(rows, "mh", "mw", "height", "width").select("det_id")


@_query("SELECT det_id, CASE WHEN NOT g THEN CAST([x1, w] AS VARCHAR) END AS box, CASE WHEN NOT g THEN a END AS area FROM (SELECT *, (w % 7) * (score % 3) AS a, x1 = 0 AND w % 2 = 0 OR (w % 7) * (score % 3) = 0 AS g FROM (SELECT det_id, CASE WHEN x1 = 0 AND w % 2 = 0 THEN 0 ELSE w END AS w, x1, score FROM det))", "det")
def empty_frame_nulling(v, t):
    w = F.when((F.col("x1") == 0) & (F.col("w") % 2 == 0), F.lit(0)).otherwise(F.col("w"))
    rows = v("det").withColumn("w", w).select("det_id", F.array(F.array("x1", "w")).alias("b"), F.array((F.col("w") % 7) * (F.col("score") % 3)).alias("a"))
    boxes, _, areas = records.without_empty_frames(F.col("b"), F.col("b"), F.col("a"))
    told = rows.select("det_id", boxes[0].alias("box"), areas[0].alias("area"))
    text = F.concat(F.lit("["), F.concat_ws(", ", F.col("box").cast("array<string>")), F.lit("]"))
    return told.select("det_id", F.when(F.col("box").isNotNull(), text).alias("box"), "area")


_FRAMES = ", p AS (SELECT image_id AS video_id, det_id AS track, CAST(category_id % 3 AS INT) AS frame, x1, y1, CASE WHEN x1 + y1 = 0 THEN 0 ELSE w END AS w, CASE WHEN x1 + y1 = 0 THEN 0 ELSE h END AS h, CASE WHEN score % 2 = 0 THEN score END AS area FROM det)"


@_query(_FRAMES + " SELECT video_id, track, frame, video_id * 10 + frame AS image_id, CAST(CASE WHEN area > 0 THEN area ELSE w * h END AS DOUBLE) AS area FROM p WHERE NOT (x1 = 0 AND y1 = 0 AND w = 0 AND h = 0)", "det")
def predictions_to_frames(v, t):
    zero = F.col("x1") + F.col("y1") == 0
    at = (F.col("category_id") % 3).cast("int")
    box = F.array("x1", "y1", F.when(zero, F.lit(0)).otherwise(F.col("w")), F.when(zero, F.lit(0)).otherwise(F.col("h")))
    sparse = lambda c: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(k == at, c))
    tracks = v("det").select(F.col("image_id").alias("video_id"), F.col("det_id").alias("track"), sparse(box).alias("boxes"), sparse(F.when(F.col("score") % 2 == 0, F.col("score"))).alias("areas"))
    images = v("det").select(F.col("image_id").alias("video_id")).distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("image_id", F.col("video_id") * 10 + F.col("frame"))
    return records.prediction_frames(tracks, images, ["track"]).select("video_id", "track", "frame", "image_id", "area")


@_query(", r AS (SELECT *, score % 5 AS place, min(category_id) OVER (PARTITION BY image_id) AS f FROM det), c AS (SELECT image_id, place, row_number() OVER (PARTITION BY image_id ORDER BY md5(concat_ws(':', image_id, place, 0)), place) AS k FROM r WHERE category_id = f) SELECT image_id, det_id FROM r WHERE (image_id, place) IN (SELECT (image_id, place) FROM c WHERE k <= 2)", "det")
def max_queries_per_frame(v, t):
    return records.max_per_frame(v("det").withColumn("place", F.col("score") % 5), "image_id", "category_id", "place", 2).select("image_id", "det_id")


@_query(", c AS (SELECT image_id, category_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY md5(concat_ws(':', det_id, 0)), det_id) AS k FROM (SELECT DISTINCT image_id, category_id, det_id FROM det)) SELECT image_id, det_id FROM c WHERE k <= 2", "det")
def sampled_queries(v, t):
    return records.sample_per_frame(v("det").select("image_id", "category_id", "det_id").distinct(), ["image_id"], "det_id", 2).select("image_id", "det_id")


@_query("SELECT image_id, phrase, CAST(NULL AS BIGINT) AS box FROM img WHERE width % 2 = 0", "img")
def semantic_queries(v, t):
    rows = v("img").select("image_id", "phrase", F.when(F.col("width") % 2 == 1, F.col("width")).alias("box"))
    return records.without_boxes(records.semantic_only(rows, "box"), "box")


@_query("SELECT image_id, CASE WHEN floor(CAST('0x' || substr(md5(image_id || ':0'), 1, 12) AS BIGINT) * 100 / 281474976710656.0e0) < 30 THEN 'visual' ELSE phrase END AS phrase FROM img", "img")
def text_overwrite(v, t):
    return v("img").select("image_id", records.overwritten(F.col("phrase"), F.col("image_id").cast("string"), "visual", 30).alias("phrase"))


@_query(", d AS (SELECT image_id, count(*) AS n, count(DISTINCT category_id) AS q FROM det GROUP BY 1) SELECT image_id FROM d WHERE n <= 4 AND q BETWEEN 1 AND 3", "det")
def loader_caps(v, t):
    rows = v("det").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("category_id").alias("q"))
    return records.within_caps(rows, "n", "q", 4, 3).select("image_id")


@_query("SELECT det_id FROM det WHERE (image_id, category_id) IN (SELECT (image_id, category_id) FROM gt) AND det_id IN (SELECT gt_id FROM gt WHERE w > 15)", "det", "gt")
def manifests_with_crops(v, t):
    return records.crops_in_manifests(v("gt"), v("det"), v("gt").where("w > 15").select(F.col("gt_id").alias("det_id")), ["image_id", "category_id"], "det_id").select("det_id")


@_query("SELECT video_id, frame, video_id * 1000 + frame AS image_id FROM trk", "trk")
def frame_image_ids(v, t):
    images = v("trk").select("video_id", "frame").distinct().withColumn("image_id", F.col("video_id") * 1000 + F.col("frame"))
    return records.image_ids(v("trk").select("video_id", "frame"), images, ["video_id", "frame"])


@_query("SELECT track, event_id FROM trk WHERE video_id = 1 AND frame = 0", "trk")
def annotations_of_frame(v, t):
    return records.frame_annotations(v("trk"), "video_id", "frame", "track", (1, 0)).select("track", "event_id")


@_query("SELECT count(DISTINCT image_id) AS videos, CAST(sum(w) AS BIGINT) AS objects, count(*) FILTER (score < 100) AS errors FROM det", "det")
def run_totals(v, t):
    return records.run_statistics(v("det"), "image_id", "w", F.col("score") < 100)


@_query("SELECT count(*) AS total, count(*) FILTER (w > 20) AS needed, count(*) FILTER (w > 20 AND h > 20) AS inpainted FROM det", "det")
def inpaint_totals(v, t):
    return records.inpaint_counts(v("det"), F.col("w") > 20, F.col("h") > 20)


@_query("SELECT count(DISTINCT l) FILTER (l <> -1) AS clusters, count(*) FILTER (l = -1) AS noise FROM (SELECT CASE WHEN label % 4 = 0 THEN -1 ELSE label END AS l FROM embeddings)")
def cluster_totals(v, t):
    return records.cluster_counts(t("embeddings").withColumn("l", F.when(F.col("label") % 4 == 0, -1).otherwise(F.col("label"))), "l")


@_query("SELECT image_id, min(det_id) AS det_id FROM det GROUP BY 1", "det")
def merged_unique_images(v, t):
    return records.unique_images(v("det").unionByName(v("det")), "image_id", "det_id").select("image_id", "det_id")


@_query("SELECT image_id FROM det INTERSECT SELECT image_id FROM gt", "det", "gt")
def id_intersection(v, t):
    return records.common_ids(v("det"), v("gt"), "image_id")


@_query("SELECT DISTINCT image_id FROM det WHERE image_id NOT IN (SELECT image_id FROM gt)", "det", "gt")
def ids_without_truth(v, t):
    return records.foreign_ids(v("det"), v("gt"), "image_id")


@_query(", k AS (SELECT image_id, list(DISTINCT category_id) AS kept FROM det GROUP BY 1) SELECT image_id, array_to_string([x FOR x IN range(8) IF NOT list_contains(kept, x)], ',') AS removed FROM k", "det")
def removed_complement(v, t):
    kept = v("det").groupBy("image_id").agg(F.collect_set("category_id").alias("kept"))
    return kept.select("image_id", F.concat_ws(",", records.complement(F.col("kept"), F.lit(8)).cast("array<string>")).alias("removed"))


@_query("SELECT image_id, printf('remapped_vid_%012d/', image_id) || phrase AS file, 1 AS category_id FROM img", "img")
def phrase_remap(v, t):
    pairs = v("img").select("image_id", F.array("phrase").alias("files"))
    return records.phrase_videos(pairs, "image_id", "files").select("image_id", F.col("files")[0].alias("file"), "category_id")


@_query("SELECT seq, CASE WHEN label % 5 = 0 THEN 'obj_x' || substr(md5(crop_path), 1, 16) ELSE printf('obj_%05d', label) END AS id FROM attr", "attr")
def object_ids(v, t):
    return v("attr").select("seq", records.object_id(F.when(F.col("label") % 5 == 0, -1).otherwise(F.col("label")), F.col("crop_path")).alias("id"))


@_query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN '/files/' || substr(url, 9) ELSE url END AS served, string_split(string_split(url, '?')[1], '/')[-1] AS page FROM media", "media")
def url_paths(v, t):
    return v("media").select("page_id", records.served_path(F.col("url"), "https://", "/files/").alias("served"), records.page_name(F.col("url")).alias("page"))


@_query("SELECT seq, category, color FROM attr WHERE seq = 5", "attr")
def object_detail(v, t):
    return records.detail(v("attr").select("seq", "category", "color"), "seq", 5)


@_query(", n AS (SELECT video_id, track, list(score ORDER BY frame) AS s FROM trk GROUP BY 1, 2) SELECT video_id, track, CAST(list_sum(s) AS BIGINT) AS total, len([x FOR x IN s]) AS seen, greatest(4 - len(s), 0) AS unseen FROM n", "trk")
def padded_track_lists(v, t):
    lists = v("trk").groupBy("video_id", "track").agg(F.sort_array(F.collect_list(F.struct("frame", "score")))["score"].cast("array<double>").alias("s"))
    rows = lists.withColumn("p", F.col("s")).withColumn("n", F.greatest(F.size("s"), F.lit(4)))
    full = records.padded_tracks(rows, "s", "p", F.col("n"))
    sums = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    lost = lambda keep: F.size(F.filter("p", lambda x: (x > -1e8) if keep else (x == -1e8))).cast("bigint")
    return full.select("video_id", "track", sums.cast("bigint").alias("total"), lost(True).alias("seen"), lost(False).alias("unseen"))


@_query("SELECT image_id, CAST(row_number() OVER (ORDER BY CAST(NOT exhaustive AS INT), image_id) AS BIGINT) AS new_id FROM img", "img")
def sequential_image_ids(v, t):
    return records.sequential_ids(v("img").withColumn("extra", ~F.col("exhaustive")), "extra", ["image_id"], "new_id").select("image_id", "new_id")


@_query(", k AS (SELECT DISTINCT image_id, category_id FROM det WHERE score >= 300) SELECT g.image_id, g.gt_id, dense_rank() OVER (PARTITION BY g.image_id ORDER BY g.category_id) - 1 AS object FROM gt g JOIN k USING (image_id, category_id)", "det", "gt")
def object_remap(v, t):
    kept = v("det").where("score >= 300")
    return records.remapped_pointers(v("gt"), kept, "image_id", "category_id", "object").select("image_id", "gt_id", "object")


@_query(", m AS (SELECT image_id, max(category_id) AS most FROM gt GROUP BY 1) SELECT image_id, det_id, coalesce(most, -1) + row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS obj FROM (SELECT DISTINCT image_id, det_id, score FROM det) LEFT JOIN m USING (image_id)", "det", "gt")
def new_object_ids(v, t):
    new = v("det").select("image_id", "det_id", "score").distinct()
    return records.new_track_ids(new, v("gt").select("image_id", F.col("category_id").alias("obj")), "image_id", [F.desc("score"), "det_id"], "obj").select("image_id", "det_id", "obj")


@_query(", f AS (SELECT DISTINCT frame FROM trk) SELECT frame, len(range(frame, least(frame + 3, 9) + 1)) AS ahead, CASE WHEN frame > 0 THEN frame - greatest(frame - 3, 0) ELSE 0 END AS back FROM f WHERE frame <= 9", "trk")
def pass_order(v, t):
    frames = v("trk").select("frame").distinct().where("frame <= 9")
    count = lambda back: F.size(records.processing_order(F.col("frame"), F.lit(3).cast("bigint"), F.lit(9).cast("bigint"), back)).cast("bigint")
    return frames.select("frame", count(False).alias("ahead"), count(True).alias("back"))


@_query("SELECT video_id, frame, (frame % 4 = 0 OR score % 10 < 5) AND score % 10 >= 8 OR (frame % 4 = 0 AND score % 10 >= 8) AS due FROM trk", "trk")
def recondition_due(v, t):
    share = F.col("score") % 10 / 10
    return v("trk").select("video_id", "frame", records.recondition(F.col("frame"), 4, share, share).alias("due"))


@_query("SELECT det_id, round(x1 * 1.0e0 / width, 6) AS x1, round(h * 1.0e0 / height, 6) AS h FROM det JOIN img USING (image_id) WHERE score % 3 <> 0 AND w % 5 > 0", "det", "img")
def output_rows(v, t):
    rows = v("det").join(v("img"), "image_id").withColumn("hidden", F.col("score") % 3 == 0).withColumn("area", F.col("w") % 5)
    return records.assembled(rows, "hidden", "area", "width", "height").select("det_id", _r(F.col("x1")).alias("x1"), _r(F.col("h")).alias("h"))


@_query("SELECT DISTINCT 'crops/' || label AS folder FROM attr WHERE seq % 3 = 0", "attr")
def crop_folder_scan(v, t):
    name = F.when(F.col("seq") % 3 == 0, "seg_00_mask.png").otherwise("seg_01_mask.png")
    return records.crop_folders(v("attr").select(F.concat_ws("/", F.lit("crops"), F.col("label").cast("string"), name).alias("path")), "path")


@_query("SELECT seq FROM attr WHERE seq % 2 = 0 AND label % 3 <> 0", "attr")
def config_scan(v, t):
    place, kind = F.when(F.col("label") % 3 == 0, "run/code/").otherwise("run/"), F.when(F.col("seq") % 2 == 0, ".yaml").otherwise(".log")
    return records.config_files(v("attr").select("seq", F.concat(place, F.col("seq").cast("string"), kind).alias("path")), "path").select("seq")


@_query("SELECT CAST(label AS VARCHAR) AS subset, CAST(max(seq) AS DOUBLE) AS value FROM attr GROUP BY 1 UNION ALL SELECT NULL, round(avg(m), 9) FROM (SELECT CAST(max(seq) AS DOUBLE) AS m FROM attr GROUP BY label)", "attr")
def subset_metrics(v, t):
    stats = v("attr").groupBy(F.col("label").cast("string").alias("subset")).agg(F.create_map(F.lit("val/AP"), F.max("seq").cast("double"), F.lit("loss"), F.lit(0.0)).alias("m"))
    return records.metric_by_suffix(stats, "m", "/AP").withColumn("value", _r(F.col("value"), 9))


@_query("SELECT image_id, phrase AS query_text, exhaustive AS is_exhaustive, 0 AS query_processing_order FROM img", "img")
def phrase_query_rows(v, t):
    return records.phrase_queries(v("img").select(F.col("image_id").alias("id"), F.col("phrase").alias("text_input"), F.col("exhaustive").cast("int").alias("is_instance_exhaustive")))


@_query("SELECT det_id, round(CASE WHEN greatest(x1, w) > 1 THEN x1 * 1.0e0 / width ELSE x1 END, 6) AS x FROM det JOIN img USING (image_id)", "det", "img")
def masklet_boxes(v, t):
    box = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "w", "h")])
    size = [F.col(c).cast("double") for c in ("width", "height")]
    return v("det").join(v("img"), "image_id").select("det_id", _r(records.masklet_record(F.array(box), *size)[0][0]).alias("x"))


@_query("SELECT image_id, det_id, rank FROM (SELECT image_id, det_id, row_number() OVER (ORDER BY score DESC, det_id) AS rank FROM (SELECT DISTINCT image_id, det_id, score FROM det))", "det")
def tracks_by_confidence(v, t):
    from objectlens.operators.reshape import ranked

    rows = v("det").select("image_id", "det_id", (-F.col("score")).alias("lost")).distinct()
    return ranked(rows, ["lost", "det_id"], "rank").select("image_id", "det_id", F.col("rank").cast("bigint").alias("rank"))


# run-length strings
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _counts() -> F.Column:
    return F.array(F.col("l_partkey"), F.col("l_linenumber").cast("bigint"), F.lit(3).cast("bigint"), F.col("l_suppkey"), F.col("l_partkey") % 100)


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber + l_suppkey AS area, l_partkey + l_linenumber + 3 + l_suppkey + l_partkey % 100 AS pixels FROM lineitem")
def rle_strings(v, t):
    back = t("lineitem").select(*_LINE, rle.rle_encode(_counts()).alias("text")).select(*_LINE, rle.rle_decode("text").alias("c"))
    total = lambda k: F.aggregate(F.filter("c", lambda x, i: i % 2 >= k), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return back.select(*_LINE, total(1).alias("area"), total(0).alias("pixels"))


@_query("SELECT det_id, CAST(w * h AS BIGINT) AS area FROM det", "det")
def polygon_masks(v, t):
    """The outline of a box with whole corners covers its pixels."""
    x1, y1, x2, y2 = F.col("x1"), F.col("y1"), F.col("x1") + F.col("w"), F.col("y1") + F.col("h")
    outline = F.array(*[c.cast("double") for c in (x1, y1, x2, y1, x2, y2, x1, y2)])
    counts = rle.rle_from_polygons(F.array(outline), F.lit(120), F.lit(100))
    inside = F.aggregate(F.filter("c", lambda x, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return v("det").select("det_id", counts.alias("c")).select("det_id", inside.alias("area"))


# combinations over classes and sequences; a frame of trk has one row, so its only pair is its match
def _sequences(v) -> DataFrame:
    from objectlens.plans.catalog import _tracks

    return metrics.hota(*_tracks(v))


_HOTA = ", g AS (SELECT video_id AS video, frame, track AS g FROM trk), d AS (SELECT video_id AS video, frame, CASE WHEN frame % 7 = 0 THEN 'other' ELSE track END AS d, (score % 100) / 100.0e0 AS sim FROM trk WHERE score % 5 <> 0), cg AS (SELECT video, g, count(*) AS n FROM g GROUP BY 1, 2), cd AS (SELECT video, d, count(*) AS n FROM d GROUP BY 1, 2), al AS (SELECT k / 100.0e0 AS alpha FROM (SELECT unnest(range(5, 100, 5)) AS k)), p AS (SELECT * FROM g JOIN d USING (video, frame)), hit AS (SELECT alpha, p.* FROM p, al WHERE sim > 0 AND sim >= alpha - 2.3e-16), m AS (SELECT alpha, video, g, d, count(*) AS n FROM hit GROUP BY ALL), q AS (SELECT alpha, video, sum(m.n * m.n * 1.0e0 / greatest(1, cg.n + cd.n - m.n)) AS a, sum(m.n * m.n * 1.0e0 / cg.n) AS re, sum(m.n * m.n * 1.0e0 / cd.n) AS pr FROM m JOIN cg USING (video, g) JOIN cd USING (video, d) GROUP BY 1, 2), c AS (SELECT alpha, video, count(*) AS tp, sum(sim) AS s FROM hit GROUP BY 1, 2), v AS (SELECT video, count(*) AS ng FROM g GROUP BY 1), w AS (SELECT video, count(*) AS nd FROM d GROUP BY 1), h AS (SELECT v.video, al.alpha, coalesce(tp, 0) AS tp, ng - coalesce(tp, 0) AS fn, coalesce(nd, 0) - coalesce(tp, 0) AS fp, coalesce(a, 0) / greatest(1, coalesce(tp, 0)) AS ass_a, coalesce(re, 0) / greatest(1, coalesce(tp, 0)) AS ass_re, coalesce(pr, 0) / greatest(1, coalesce(tp, 0)) AS ass_pr, CASE WHEN coalesce(tp, 0) > 0 THEN s / tp ELSE 1 END AS loc_a FROM v CROSS JOIN al LEFT JOIN w USING (video) LEFT JOIN c USING (video, alpha) LEFT JOIN q USING (video, alpha))"
_SHARES = ["ass_a", "ass_re", "ass_pr", "loc_a"]


@_query(_HOTA + " SELECT video, alpha, tp, fn, fp, " + ", ".join(f"round({c}, 9) AS {c}" for c in _SHARES) + " FROM h", "trk")
def hota(v, t):
    return _sequences(v).select("video", "alpha", "tp", "fn", "fp", *[_r(F.col(c), 9).alias(c) for c in _SHARES])


@_query(_HOTA + ", y AS (SELECT alpha, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(ass_a * tp) / greatest(1, sum(tp)) AS ass_a, sum(loc_a * tp) / greatest(1, sum(tp)) AS loc_a FROM h GROUP BY 1) SELECT alpha, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, round(ass_a, 9) AS ass_a, round(loc_a, 9) AS loc_a, round(tp * 1.0e0 / greatest(1, tp + fn + fp), 9) AS det_a, round(sqrt(tp * 1.0e0 / greatest(1, tp + fn + fp) * ass_a), 9) AS hota, round(sqrt(tp * 1.0e0 / greatest(1, tp + fn) * ass_a), 9) AS owta FROM y", "trk")
def hota_combine(v, t):
    out = metrics.hota_combined(_sequences(v))
    return out.select("alpha", "tp", "fn", "fp", *[_r(F.col(c), 9).alias(c) for c in ("ass_a", "loc_a", "det_a", "hota", "owta")])


_DET = "sum(tp) * 1.0e0 / greatest(1, sum(tp) + sum(fn) + sum(fp))"


@_query(_HOTA + f" SELECT alpha, CAST(sum(tp) AS BIGINT) AS tp, round({_DET}, 9) AS det_a, round(sum(ass_a * tp) / greatest(1, sum(tp)), 9) AS ass_a, round(sqrt({_DET} * sum(ass_a * tp) / greatest(1, sum(tp))), 9) AS hota, round(greatest(1e-10, sum(loc_a * tp)) / greatest(1e-10, sum(tp)), 9) AS loc_a FROM h GROUP BY 1", "trk")
def classes_by_detections(v, t):
    out = evaluation.detection_averaged(_sequences(v))
    return out.select("alpha", "tp", *[_r(F.col(c), 9).alias(c) for c in ("det_a", "ass_a", "hota", "loc_a")])


_SINGLE = ", f AS (SELECT *, tp * 1.0e0 / greatest(1, tp + fn + fp) AS det_a, sqrt(tp * 1.0e0 / greatest(1, tp + fn + fp) * ass_a) AS hota FROM h)"


@_query(_HOTA + _SINGLE + " SELECT alpha, CAST(sum(tp) AS BIGINT) AS tp, round(avg(det_a), 9) AS det_a, round(avg(hota), 9) AS hota FROM f GROUP BY 1", "trk")
def classes_averaged(v, t):
    out = evaluation.class_averaged(evaluation.final_fields(_sequences(v)), "video", ignore_empty=True)
    return out.select("alpha", "tp", _r(F.col("det_a"), 9).alias("det_a"), _r(F.col("hota"), 9).alias("hota"))


@_query(_HOTA + _SINGLE + " SELECT video, round(hota, 9) AS hota0, round(loc_a, 9) AS loc_a0, round(hota * loc_a, 9) AS hota_loc_a0 FROM f WHERE alpha = 0.05e0", "trk")
def first_alpha_fields(v, t):
    out = evaluation.at_first_alpha(evaluation.final_fields(_sequences(v)), "video")
    return out.select("video", *[_r(F.col(c), 9).alias(c) for c in ("hota0", "loc_a0", "hota_loc_a0")])


@_query(_HOTA + " SELECT alpha, CAST(sum(tp) AS BIGINT) AS tp FROM h WHERE video % 3 = 1 GROUP BY 1", "trk")
def tagged_sequences(v, t):
    rows = _sequences(v)
    tags = rows.select("video", F.when(F.col("video") % 3 == 1, "night").otherwise("day").alias("tag"))
    return evaluation.tagged(rows, tags, "video", "night").groupBy("alpha").agg(F.sum("tp").alias("tp"))


@_query("SELECT o_orderkey AS image_id, l_partkey AS track, count(l_orderkey) AS n, round(avg(CAST(floor(l_quantity) AS DOUBLE)), 6) AS area FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'N' GROUP BY 1, 2")
def video_track_mapping(v, t):
    rows = t("lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("track"), F.col("l_linenumber").alias("frame"), F.floor("l_quantity").cast("double").alias("area"))
    out = evaluation.tracks_of_videos(rows, v("img"), "image_id", "track", "frame", "area")
    return out.select("image_id", "track", F.greatest(F.coalesce(F.size("annotations"), F.lit(0)), F.lit(0)).cast("bigint").alias("n"), _r(F.col("area")).alias("area"))


@_query("SELECT phrase AS rarity, count(*) AS n FROM img WHERE image_id IN (SELECT image_id FROM det) GROUP BY 1", "img", "det")
def rarity_bucket_sizes(v, t):
    return evaluation.rarity_buckets(v("img"), "image_id", "phrase", v("det")).groupBy("rarity").agg(F.count(F.lit(1)).alias("n"))


@_query(", k AS (SELECT DISTINCT image_id, category_id FROM gt) SELECT image_id, category_id, dense_rank() OVER (PARTITION BY image_id, category_id ORDER BY det_id) - 1 AS det FROM det JOIN k USING (image_id, category_id)", "det", "gt")
def class_sequence_rows(v, t):
    _, det = evaluation.class_slices(v("gt"), v("det").select("image_id", "category_id", F.col("det_id").alias("det")), ["image_id"], "category_id", "gt_id", "det")
    return det.select("image_id", "category_id", F.col("det").cast("bigint").alias("det"))


# evaluation by category, area range and image
_AREAS = {"all": (0, 1e10), "small": (0, 300), "large": (300, 1e10)}
_ONE = ", d AS (SELECT *, count(*) OVER (PARTITION BY image_id, category_id) AS nd FROM det), t AS (SELECT *, count(*) OVER (PARTITION BY image_id, category_id) AS nt FROM gt), th AS (SELECT unnest(range(50, 100, 5)) AS threshold), ar AS (SELECT * FROM (VALUES ('all', 0, 1e10), ('small', 0, 300), ('large', 300, 1e10)) x(area, lo, hi)), p AS (SELECT d.image_id, d.category_id, d.det_id, d.w * d.h AS da, t.w * t.h AS ta, " + "greatest(least(d.x1+d.w, t.x1+t.w) - greatest(d.x1, t.x1), 0) * greatest(least(d.y1+d.h, t.y1+t.h) - greatest(d.y1, t.y1), 0)" + " AS i FROM d LEFT JOIN t ON d.image_id = t.image_id AND d.category_id = t.category_id WHERE nd = 1 AND coalesce(nt, 1) = 1), e AS (SELECT image_id, category_id, area, threshold, det_id, coalesce(i * 100.0e0 >= threshold * (da + ta - i) AND i > 0, false) AS met, coalesce(ta BETWEEN lo AND hi, false) AS counts, da BETWEEN lo AND hi AS own FROM p, th, ar) SELECT image_id, category_id, area, CAST(threshold AS INT) AS threshold, det_id, met AND counts AS hit, (met AND NOT counts) OR (NOT met AND NOT own) AS ignored FROM e"


def _evaluated(v, det: DataFrame, gt: DataFrame) -> DataFrame:
    return evaluation.matched_by_area(det, gt, _AREAS)


@_query(_ONE, "det", "gt")
def evaluation_by_area(v, t):
    """Images and categories with one prediction and one ground truth at most, which SQL can match."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id", "category_id")
    alone = lambda n: v(n).withColumn("_n", F.count(F.lit(1)).over(w))
    crowded = v("gt").groupBy("image_id", "category_id").count().where("count > 1")
    det = alone("det").where("_n = 1").join(crowded, ["image_id", "category_id"], "left_anti")
    return _evaluated(v, det, alone("gt").where("_n = 1")).drop("score")


@_query()
def precision_by_area(v, t):
    return evaluation.precision_of_masks(evaluation.match_masks(v("det"), v("gt"), _AREAS), evaluation.positives(v("gt"), _AREAS), _AREAS)


@_query()
def evaluation_report(v, t):
    rows = precision_by_area(v, t).where("area = 'all'")
    return evaluation.report(rows, "threshold", ["ap", "ar"])


@_query(", s AS (SELECT category_id, CASE WHEN category_id % 2 = 0 THEN -1 ELSE avg(score) END AS m FROM det GROUP BY 1) SELECT CASE WHEN category_id < 3 THEN 'low' ELSE 'high' END AS part, round(coalesce(avg(m) FILTER (m > -1), -1), 6) AS mean FROM s GROUP BY 1", "det")
def summaries(v, t):
    rows = v("det").groupBy("category_id").agg(F.avg("score").alias("m")).withColumn("m", F.when(F.col("category_id") % 2 == 0, -1.0).otherwise(F.col("m")))
    return rows.groupBy(F.when(F.col("category_id") < 3, "low").otherwise("high").alias("part")).agg(_r(evaluation.summary(F.col("m"))).alias("mean"))


# suppression with its lists
def _greedy(test: str, group: str = "image_id") -> str:
    """Greedy suppression as a recursion over each group's detections by score; test says when b, kept, drops a."""
    keys = group.split(", ")
    same = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys)
    inter = "greatest(least(b.x1+b.w, a.x1+a.w) - greatest(b.x1, a.x1), 0) * greatest(least(b.y1+b.h, a.y1+a.h) - greatest(b.y1, a.y1), 0)"
    return (
        f"WITH RECURSIVE det AS ({VIEWS['det']}), o AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, det_id) AS k FROM det),"
        f" pairs AS (SELECT {', '.join('a.' + k for k in keys)}, a.k AS k, b.k AS j, {inter} AS i, a.w*a.h AS aa, b.w*b.h AS ba FROM o a JOIN o b ON {same('a', 'b')} AND b.k < a.k),"
        f" hits AS (SELECT {group}, k, list(j) AS js FROM pairs WHERE {test} GROUP BY {group}, k),"
        f" l AS (SELECT {', '.join('o.' + k for k in keys)}, o.k, coalesce(js, []) AS js FROM o LEFT JOIN hits h ON {same('o', 'h')} AND h.k = o.k),"
        f" r AS (SELECT {group}, k, [k] AS kept FROM l WHERE k = 1 UNION ALL SELECT {', '.join('l.' + k for k in keys)}, l.k, CASE WHEN list_has_any(r.kept, l.js) THEN r.kept ELSE list_append(r.kept, l.k) END FROM r JOIN l ON {same('l', 'r')} AND l.k = r.k + 1),"
        f" e AS (SELECT {group}, arg_max(kept, k) AS kept FROM r GROUP BY {group})"
    )


@_query(_greedy("3 * i > aa + ba") + " SELECT det_id FROM o JOIN e USING (image_id) WHERE list_contains(kept, k)")
def greedy_nms(v, t):
    return suppression.suppress(v("det"), ["image_id"], 0.5).select("det_id")


@_query(_greedy("i * 1.0e0 / (aa + ba - i) >= 0.3e0", "image_id, category_id") + " SELECT det_id FROM o JOIN e USING (image_id, category_id) WHERE list_contains(kept, k)")
def frame_nms(v, t):
    return suppression.suppress(v("det"), ["image_id", "category_id"], 0.3, inclusive=True).select("det_id")


@_query(_greedy("i * 1.0e0 / least(aa, ba) > 0.3e0") + " SELECT det_id FROM o JOIN e USING (image_id) WHERE list_contains(kept, k)")
def overlap_removal(v, t):
    return suppression.suppress(v("det"), ["image_id"], 0.3, over="least").select("det_id")


@_query(_greedy("3 * i > aa + ba") + " SELECT det_id, list_contains(kept, k) AS kept FROM o JOIN e USING (image_id)")
def suppression_marks(v, t):
    """greedy_nms with every detection, kept or not."""
    return suppression.suppress(v("det"), ["image_id"], 0.5, mark="kept").select("det_id", "kept")


@_query(_greedy("i * 1.0e0 / (aa + ba - i) >= 0.3e0", "image_id, category_id") + " SELECT det_id, CASE WHEN list_contains(kept, k) THEN x1 END AS x1, CASE WHEN list_contains(kept, k) THEN h END AS h FROM o JOIN e USING (image_id, category_id)")
def frame_box_nulling(v, t):
    return suppression.nulled(v("det"), ["image_id", "category_id"], 0.3).select("det_id", "x1", "h")


@_query(_greedy("i * 1.0e0 / least(aa, ba) > 0.3e0") + ", z AS (SELECT o.image_id, row_number() OVER (PARTITION BY o.image_id ORDER BY det_id) - 1 AS place, list_contains(kept, k) AS kept FROM o JOIN e USING (image_id)) SELECT image_id, CASE WHEN count(*) > 1 THEN array_to_string(coalesce(list(place ORDER BY place) FILTER (kept), []), ',') END AS kept, CASE WHEN count(*) > 1 THEN array_to_string(coalesce(list(place ORDER BY place) FILTER (NOT kept), []), ',') END AS removed FROM z GROUP BY 1")
def overlap_lists(v, t):
    lists = suppression.overlap_lists(v("det"), "image_id", 0.3)
    text = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(",", F.col(c).cast("array<string>")))
    return lists.select("image_id", text("kept_indices").alias("kept"), text("removed_indices").alias("removed"))


@_query("SELECT video_id, frame, track, score FROM trk WHERE frame % 5 <> 2 OR video_id % 2 = 1 UNION ALL SELECT DISTINCT video_id, frame, 'anew', 0 FROM trk WHERE frame % 5 = 2 AND video_id % 2 = 0", "trk")
def partial_rerun(v, t):
    cache = v("trk").select("video_id", "frame", "track", "score")
    anew = cache.where("frame % 5 = 2 AND video_id % 2 = 0").select("video_id", "frame").distinct().withColumn("track", F.lit("anew")).withColumn("score", F.lit(0).cast("bigint"))
    return records.replaced(cache, anew, ["video_id", "frame"])


@_query("SELECT label, count(*) AS n, string_agg(crop_path, '|' ORDER BY seq) AS paths FROM attr GROUP BY 1", "attr")
def library_members(v, t):
    from objectlens.operators import library

    every = library.members(v("attr"), "label", "seq", "crop_path")
    return every.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(F.struct("place", "path")))["path"], "|").alias("paths"))


# F1 totals: the greatest total overlap found by trying every matching of an image's few boxes
_F1 = (
    f"WITH RECURSIVE det AS ({VIEWS['det']}), gt AS ({VIEWS['gt']}), img AS ({VIEWS['img']}),"
    " d AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_id) - 1 AS j FROM det WHERE score >= 500), t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gt_id) - 1 AS i FROM gt),"
    " q AS (SELECT d.image_id, t.i, d.j, greatest(least(d.x1+d.w, t.x1+t.w) - greatest(d.x1, t.x1), 0) * greatest(least(d.y1+d.h, t.y1+t.h) - greatest(d.y1, t.y1), 0) AS o, d.w*d.h + t.w*t.h AS a FROM d JOIN t USING (image_id)),"
    " p AS (SELECT image_id, i, j, o * 1.0e0 / (a - o) AS iou FROM q WHERE o > 0 UNION ALL SELECT image_id, i, NULL, 0 FROM t),"
    " n AS (SELECT image_id, (SELECT count(*) FROM t WHERE t.image_id = img.image_id) AS nt, (SELECT count(*) FROM d WHERE d.image_id = img.image_id) AS nd FROM img),"
    " r AS (SELECT image_id, nt, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, 0.0e0 AS total, CAST([] AS DOUBLE[]) AS hits FROM n WHERE nt > 0 UNION ALL"
    " SELECT r.image_id, nt, r.i + 1, CASE WHEN p.j IS NULL THEN used ELSE used | (CAST(1 AS BIGINT) << p.j) END, total + p.iou, CASE WHEN p.j IS NULL THEN hits ELSE list_append(hits, p.iou) END FROM r JOIN p ON p.image_id = r.image_id AND p.i = r.i AND (p.j IS NULL OR (used >> p.j) & 1 = 0)),"
    " best AS (SELECT image_id, arg_max(hits, total) AS hits FROM r WHERE i = nt GROUP BY image_id), th AS (SELECT unnest(range(50, 100, 5)) AS threshold),"
    " f AS (SELECT threshold, nt, nd, coalesce(len(list_filter(hits, lambda x: floor(x * 100 + 1e-9) >= threshold)), 0) AS tp FROM n CROSS JOIN th LEFT JOIN best USING (image_id) WHERE nt + nd > 0),"
    " l AS (SELECT *, tp / (nd + 1e-4) AS pr, tp / (nt + 1e-4) AS re FROM f),"
    " s AS (SELECT threshold, sum(tp) AS tp, sum(nd - tp) AS fp, sum(nt - tp) AS fn, coalesce(sum(nd - tp) FILTER (nt > 0 AND nd > 0), 0) AS pm_fp, avg(2 * pr * re / (pr + re + 1e-4)) FILTER (nt > 0 AND nd > 0) AS macro FROM l GROUP BY 1),"
    " m AS (SELECT *, tp / (tp + pm_fp + 1e-4) AS mp, tp / (tp + fn + 1e-4) AS mr FROM s), z AS (SELECT *, 2 * mp * mr / (mp + mr + 1e-4) AS micro FROM m)"
)


def _f1(v) -> DataFrame:
    det = v("det").where("score >= 500")
    return metrics.f1_totals(metrics.f1_rows(v("img"), v("gt"), det, suppression.matched(det, v("gt"), "image_id"), "image_id"))


@_query(_F1 + " SELECT CAST(threshold AS INT) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(pm_fp AS BIGINT) AS pm_fp, round(macro, 6) AS positive_macro_f1, round(micro, 6) AS positive_micro_f1 FROM z")
def f1_thresholds(v, t):
    return _f1(v).select("threshold", "tp", "fp", "fn", "pm_fp", *[_r(F.col(c)).alias(c) for c in ("positive_macro_f1", "positive_micro_f1")])


@_query(_F1 + ", c AS (SELECT count(*) FILTER (nt > 0 AND nd > 0)::DOUBLE AS a, count(*) FILTER (nt = 0 AND nd > 0)::DOUBLE AS b, count(*) FILTER (nt > 0 AND nd = 0)::DOUBLE AS e, count(*) FILTER (nt = 0 AND nd = 0)::DOUBLE AS g FROM n), k AS (SELECT (a * g - b * e) / (sqrt((a + b) * (a + e) * (g + b) * (g + e)) + 1e-6) AS mcc FROM c) SELECT CAST(threshold AS INT) AS threshold, round(micro, 6) AS positive_micro_f1, round(mcc, 6) AS il_mcc, round(micro * mcc, 6) AS cgf1 FROM z, k")
def cgf1(v, t):
    """Positive micro F1 times the image-level coefficient."""
    from objectlens.plans.catalog import _il

    tp, fp, fn, tn = map(F.col, ("il_tp", "il_fp", "il_fn", "il_tn"))
    il = _il(v).select(metrics.mcc(tp, fp, fn, tn).alias("mcc"))
    joined = _f1(v).crossJoin(F.broadcast(il))  # one row
    return joined.select("threshold", _r(F.col("positive_micro_f1")).alias("positive_micro_f1"), _r(F.col("mcc")).alias("il_mcc"), _r(F.col("positive_micro_f1") * F.col("mcc")).alias("cgf1"))
