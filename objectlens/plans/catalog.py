"""The registered queries over the reference tables, each beside its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlens.functions import geometry as g
from objectlens.functions import masks, rotated, scalar, shapes
from objectlens.functions import text as tx
from objectlens.operators import filters, library, matching, metrics, relational, reshape, rollups, selection, suppression
from objectlens.plans import registry
from objectlens.plans.registry import query as _query
from objectlens.plans.registry import rounded as _r
from objectlens.streaming import rules, tracks

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from objectlens.plans import extended  # noqa: F401, its queries register themselves

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: registry.SQL[k] for k in queries() if k in registry.SQL}


def _box(p: str = "") -> tuple:
    c = lambda n: F.col(p + n)
    return c("x1"), c("y1"), c("x1") + c("w"), c("y1") + c("h")


def _pairs(v) -> DataFrame:
    return v("det").alias("d").join(v("gt").alias("t"), "image_id")


_INTER = "greatest(least(d.x1+d.w, t.x1+t.w) - greatest(d.x1, t.x1), 0) * greatest(least(d.y1+d.h, t.y1+t.h) - greatest(d.y1, t.y1), 0)"
_PAIR = f"p AS (SELECT image_id, det_id, gt_id, {_INTER} AS i, d.w*d.h AS da, t.w*t.h AS ta, (greatest(d.x1+d.w,t.x1+t.w)-least(d.x1,t.x1))*(greatest(d.y1+d.h,t.y1+t.h)-least(d.y1,t.y1)) AS hull, d.score FROM det d JOIN gt t USING (image_id))"


# scans, filters, projections
@_query("SELECT page_id, url FROM pages WHERE url NOT LIKE '%ads%' AND url LIKE '%example%' AND (url LIKE '%/en/%' OR url LIKE '%/fr/%')")
def media_select(v, t):
    u = F.col("url")
    return v("media").where(~u.contains("ads") & u.contains("example") & u.rlike("/en/|/fr/"))


@_query("SELECT page_id, split_part(url, '/', 3) AS dataset, split_part(url, '/', 4) AS camera FROM pages")
def path_parts(v, t):
    parts = F.split("url", "/")
    return v("media").select("page_id", F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("dataset"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("camera"))


@_query("SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'failed' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def run_status_counts(v, t):
    return t("orders").groupBy(F.when(F.col("o_orderpriority").startswith("1"), "failed").otherwise(F.col("o_orderstatus")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# geometry
@_query("SELECT det_id, x1+w AS x2, y1+h AS y2, round(x1 + w/2.0, 6) AS cx, round(y1 + h/2.0, 6) AS cy FROM det", "det")
def box_convert(v, t):
    x, y, w, h = map(F.col, ("x1", "y1", "w", "h"))
    a, c = g.xywh_to_xyxy(x, y, w, h), g.xywh_to_cxcywh(x, y, w, h)
    return v("det").select("det_id", a[2].alias("x2"), a[3].alias("y2"), _r(c[0]).alias("cx"), _r(c[1]).alias("cy"))


@_query("SELECT det_id, w*h AS area FROM det", "det")
def box_area(v, t):
    return v("det").select("det_id", g.area(F.col("w"), F.col("h")).alias("area"))


@_query(f", {_PAIR} SELECT image_id, det_id, gt_id, round(i * 1.0 / (da + ta - i), 6) AS iou FROM p WHERE i > 0", "det", "gt")
def pair_iou(v, t):
    return _pairs(v).where(g.intersection(_box("d."), _box("t.")) > 0).select("image_id", "det_id", "gt_id", _r(g.iou(_box("d."), _box("t."))).alias("iou"))


@_query(f", {_PAIR} SELECT image_id, det_id, gt_id, round(i * 1.0 / (da + ta - i) - (hull - (da + ta - i)) * 1.0 / hull, 6) AS giou FROM p", "det", "gt")
def pair_giou(v, t):
    return _pairs(v).select("image_id", "det_id", "gt_id", _r(g.giou(_box("d."), _box("t."))).alias("giou"))


@_query(f", {_PAIR} SELECT image_id, det_id, gt_id, round(i * 1.0 / ta, 6) AS ioa, round(i * 1.0 / least(da, ta), 6) AS iom FROM p", "det", "gt")
def pair_ioa(v, t):
    return _pairs(v).select("image_id", "det_id", "gt_id", _r(g.ioa(_box("d."), _box("t."))).alias("ioa"), _r(g.iom(_box("d."), _box("t."))).alias("iom"))


@_query("SELECT det_id, least(x1, 40) AS cx1, least(y1, 30) AS cy1, least(x1 + w, 40) AS cx2, least(y1 + h, 30) AS cy2 FROM det", "det")
def box_clip(v, t):
    return v("det").select("det_id", *[c.alias(n) for c, n in zip(g.clip(_box(), F.lit(40), F.lit(30)), ("cx1", "cy1", "cx2", "cy2"), strict=True)])


@_query("SELECT det_id, greatest(x1 - w*5//100, 0) AS cx1, greatest(y1 - h*5//100, 0) AS cy1, least(x1 + w + w*5//100, width) AS cx2, least(y1 + h + h*5//100, height) AS cy2 FROM det JOIN img USING (image_id)", "det", "img")
def box_pad_crop(v, t):
    return v("det").join(v("img"), "image_id").select("det_id", *[c.alias(n) for c, n in zip(g.padded_crop(_box(), F.col("width"), F.col("height")), ("cx1", "cy1", "cx2", "cy2"), strict=True)])


@_query("SELECT det_id, round(score * 1.0 / greatest(w*h, 1), 6) AS ratio FROM det WHERE score * 1.0 / greatest(w*h, 1) < 0.6", "det")
def occlusion_ratio(v, t):
    ratio = g.occlusion_ratio(F.col("score"), F.col("w"), F.col("h"))
    return v("det").where(ratio < 0.6).select("det_id", _r(ratio).alias("ratio"))


@_query("SELECT det_id FROM det JOIN img USING (image_id) WHERE NOT ((x1 + w/2.0)/width < 0.1 OR (x1 + w/2.0)/width > 0.9 OR (y1 + h/2.0)/height < 0.1 OR (y1 + h/2.0)/height > 0.9)", "det", "img")
def boundary_filter(v, t):
    return v("det").join(v("img"), "image_id").where(~g.near_boundary(_box(), F.col("width"), F.col("height"), 0.1)).select("det_id")


@_query("SELECT det_id, round(least(x1*1.0/width, 1), 6) AS nx1, round(least((x1+w)*1.0/width, 1), 6) AS nx2, width - x1 - w AS fx1 FROM det JOIN img USING (image_id)", "det", "img")
def box_normalise_flip(v, t):
    n, f = g.normalised(_box(), F.col("width"), F.col("height")), g.horizontal_flip(_box(), F.col("width"))
    return v("det").join(v("img"), "image_id").select("det_id", _r(n[0]).alias("nx1"), _r(n[2]).alias("nx2"), f[0].alias("fx1"))


# relational core
@_query("SELECT image_id FROM img WHERE image_id NOT IN (SELECT image_id FROM det WHERE score >= 500)", "img", "det")
def resume_anti(v, t):
    return relational.resume(v("img").select("image_id"), v("det"), "image_id", retry=F.col("score") < 500)


@_query("SELECT det_id FROM det WHERE EXISTS (SELECT 1 FROM gt WHERE gt.image_id = det.image_id AND gt.category_id = det.category_id)", "det", "gt")
def positive_split_semi(v, t):
    return relational.positive_split(v("det"), v("gt"), ["image_id", "category_id"]).select("det_id")


@_query("SELECT image_id FROM img WHERE exhaustive AND image_id NOT IN (SELECT image_id FROM gt WHERE status = 'F')", "img", "gt")
def exhaustive_filter(v, t):
    other = v("gt").select("image_id", (F.col("status") != "F").alias("exhaustive"))
    return relational.exhaustive_only(v("img"), [other], "image_id", "exhaustive").select("image_id")


@_query("SELECT image_id FROM img EXCEPT SELECT image_id FROM det", "img", "det")
def missing_images(v, t):
    return v("img").select("image_id").join(v("det").select("image_id").distinct(), "image_id", "left_anti")


@_query("SELECT coalesce(r_name, CAST(n_regionkey AS VARCHAR)) AS category, count(*) AS n FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey GROUP BY 1")
def category_merge_map(v, t):
    names = t("region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("category"), F.col("r_name").alias("target"))
    rows = t("nation").select(F.col("n_regionkey").cast("string").alias("category"))
    return relational.merged_categories(rows, names, "category").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT det_id, coalesce(height, 0) AS height, coalesce(width, 0) AS width FROM det LEFT JOIN img USING (image_id)", "det", "img")
def fill_hw_left(v, t):
    return v("det").join(v("img"), "image_id", "left").select("det_id", F.coalesce("height", F.lit(0)).alias("height"), F.coalesce("width", F.lit(0)).alias("width"))


@_query("SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rank FROM det QUALIFY rank <= 2", "det")
def topk_per_image(v, t):
    return relational.top_k(v("det"), "image_id", 2, F.desc("score"), F.asc("det_id")).select("image_id", "det_id", "rank")


@_query(", b AS (SELECT image_id, category_id, min(score % 4) AS r FROM det GROUP BY ALL) SELECT det_id FROM det JOIN b USING (image_id, category_id) WHERE score % 4 = r", "det")
def dedupe_first_rank(v, t):
    return relational.dedupe_first_rank(v("det").withColumn("rank", F.col("score") % 4), ["image_id", "category_id"], "rank").select("det_id")


@_query("SELECT CASE WHEN w*h < 150 THEN 'small' WHEN w*h < 400 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM det GROUP BY 1", "det")
def area_buckets(v, t):
    return v("det").groupBy(relational.bucketed(F.col("w") * F.col("h"), [("small", 0, 150), ("medium", 150, 400), ("large", 400, 1e10)]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT n_nationkey + (SELECT max(CASE WHEN n_nationkey = 0 THEN 1 ELSE 0 END) FROM nation) AS n_nationkey, n_name FROM nation")
def reindex_one_based(v, t):
    return relational.one_based(t("nation").select("n_nationkey", "n_name"), "n_nationkey")


@_query("SELECT image_id, det_id, dense_rank() OVER (PARTITION BY image_id ORDER BY det_id) - 1 AS new_id FROM det", "det")
def contiguous_relabel(v, t):
    return relational.dense_ids(v("det"), "image_id", "det_id", "new_id").select("image_id", "det_id", "new_id")


@_query("SELECT video_id, track, count(*) AS n, dense_rank() OVER (ORDER BY video_id, track) AS new_video FROM trk GROUP BY video_id, track", "trk")
def class_agnostic_remap(v, t):
    return reshape.class_agnostic(v("trk"), "video_id", "track")


@_query("SELECT video_id, frame, event_id FROM trk", "trk")
def frame_ordinal(v, t):
    return v("trk").select("video_id", "frame", "event_id")


@_query("SELECT video_id, track, score FROM trk WHERE video_id IN (SELECT video_id FROM trk GROUP BY video_id HAVING count(DISTINCT track) <= 3)", "trk")
def masklet_cap(v, t):
    return relational.masklet_cap(v("trk"), "video_id", "track", 3).select("video_id", "track", "score")


# attributes and library
@_query("SELECT seq, concat_ws(' ', CASE WHEN category <> 'unknown' THEN category END, CASE WHEN color <> 'Brand#11' THEN color END, material) AS text FROM attr", "attr")
def attr_text(v, t):
    return v("attr").select("seq", tx.attribute_text(F.col("category"), F.when(F.col("color") != "Brand#11", F.col("color")).otherwise("unknown"), F.col("material")).alias("text"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def fenced_json_parse(v, t):
    fenced = F.concat(F.lit("text ```json\n"), F.col("props"), F.lit("\n``` tail"))
    return t("events").select("event_id", F.get_json_object(tx.fenced_json(fenced), "$.k").alias("k"))


_VOTE = ", l AS (SELECT label, seq, unnest(['category','color','material']) AS key, unnest([category,color,material]) AS value FROM attr), c AS (SELECT label, key, value, count(*) AS n, min(seq) AS f FROM l GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY label, key ORDER BY n DESC, f) = 1), m AS (SELECT label, max(CASE WHEN key='category' THEN value END) AS category, max(CASE WHEN key='color' THEN value END) AS color, max(CASE WHEN key='material' THEN value END) AS material FROM b GROUP BY label)"


@_query(_VOTE + " SELECT * FROM m", "attr")
def majority_vote(v, t):
    return library.majority(v("attr"), "label", ["category", "color", "material"], "seq")


_LIB = _VOTE + ", s AS (SELECT label, count(*) AS instance_count, arg_min(crop_path, seq) AS canonical_path, array_to_string(list(crop_path ORDER BY seq)[1:50], '|') AS instances FROM attr GROUP BY label)"


def _library(v) -> DataFrame:
    return library.library(v("attr"), "label", ["category", "color", "material"], "seq", "crop_path")


@_query(_LIB + " SELECT * FROM m JOIN s USING (label)", "attr")
def object_library(v, t):
    return _library(v)


@_query(_LIB + " SELECT label, category, color, instance_count FROM m JOIN s USING (label) WHERE material = 'm3'", "attr")
def library_browse(v, t):
    return library.browse(_library(v), {"category": "", "material": "m3"}, "count").select("label", "category", "color", "instance_count")


@_query("SELECT 'category' AS facet, category AS value, count(*) AS n FROM attr GROUP BY 2 UNION ALL SELECT 'color', color, count(*) FROM attr GROUP BY 2 UNION ALL SELECT 'material', material, count(*) FROM attr GROUP BY 2", "attr")
def facet_counts(v, t):
    return library.facets(v("attr"), ["category", "color", "material"])


@_query("SELECT DISTINCT category AS value FROM attr", "attr")
def facet_values(v, t):
    return v("attr").select(F.col("category").alias("value")).distinct().orderBy("value")


@_query("SELECT category, count(*) AS n, min(seq) AS first FROM attr GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 15", "attr")
def top_categories(v, t):
    return v("attr").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").limit(15)


@_query(_LIB + " SELECT label, '<div class=\"card\"><h3>' || category || '</h3><img src=\"' || canonical_path || '\"><p>' || CAST(instance_count AS VARCHAR) || '</p></div>' AS card FROM m JOIN s USING (label)", "attr")
def html_cards(v, t):
    return _library(v).select("label", library.html_card(F.col("category"), F.col("canonical_path"), F.col("instance_count")).alias("card"))


_Z = "e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), st AS (SELECT pos, avg(CAST(x AS DOUBLE)) AS m, stddev_pop(CAST(x AS DOUBLE)) AS s FROM e GROUP BY pos), z AS (SELECT vec_id, pos, (x - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z FROM e JOIN st USING (pos))"


@_query(f"WITH {_Z} SELECT vec_id, round(sum(z * pos), 4) AS weighted FROM z GROUP BY vec_id")
def column_zscore(v, t):
    z = library.standardised(t("embeddings"), "vec_id", "embedding")
    return z.select("vec_id", _r(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("weighted"))


@_query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS first FROM embeddings")
def l2_normalise(v, t):
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    return t("embeddings").select("vec_id", _r(library.l2_normalised(doubles)[0], 5).alias("first"))


_NEAR = f"{_Z}, v AS (SELECT vec_id, list(z ORDER BY pos) AS v FROM z GROUP BY vec_id), n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE 1 - list_cosine_similarity(a.v, b.v) <= 0.6)"


def _near(t) -> DataFrame:
    return library.cosine_neighbours(library.standardised(t("embeddings"), "vec_id", "embedding"), "vec_id", "embedding", 0.6)


@_query(f"WITH {_NEAR} SELECT a, b FROM n")
def cosine_neighbors(v, t):
    return _near(t).select("a", "b")


@_query(f"WITH RECURSIVE {_NEAR}, d AS (SELECT a AS x, b AS y FROM n UNION SELECT b, a FROM n), r(x, y) AS (SELECT x, y FROM d UNION SELECT r.x, d.y FROM r JOIN d ON r.y = d.x) SELECT vec_id, coalesce(l, -1) AS label FROM embeddings LEFT JOIN (SELECT x, least(x, min(y)) AS l FROM r GROUP BY x) ON x = vec_id")
def dbscan_min2(v, t):
    return library.clusters(t("embeddings"), _near(t), "vec_id")


# metrics
_IL = ", s AS (SELECT image_id, EXISTS (SELECT 1 FROM gt WHERE gt.image_id = img.image_id) AS g, EXISTS (SELECT 1 FROM det WHERE det.image_id = img.image_id AND score >= 500) AS d FROM img), c AS (SELECT count(*) FILTER (g AND d) AS il_tp, count(*) FILTER (NOT g AND d) AS il_fp, count(*) FILTER (g AND NOT d) AS il_fn, count(*) FILTER (NOT g AND NOT d) AS il_tn FROM s)"


def _il(v) -> DataFrame:
    return metrics.image_counts(v("img"), v("gt"), v("det").where("score >= 500"), "image_id")


@_query(_IL + " SELECT * FROM c", "img", "gt", "det")
def image_level_counts(v, t):
    return _il(v)


@_query(_IL + " SELECT il_tp, il_fp, il_fn, il_tn, round((il_tp::DOUBLE*il_tn - il_fp::DOUBLE*il_fn) / (sqrt((il_tp+il_fp)::DOUBLE*(il_tp+il_fn)*(il_tn+il_fp)*(il_tn+il_fn)) + 1e-6), 6) AS il_mcc, round(il_tp / (il_tp + il_fp + 1e-6), 6) AS il_precision, round(il_tp / (il_tp + il_fn + 1e-6), 6) AS il_recall FROM c", "img", "gt", "det")
def image_level_mcc(v, t):
    tp, fp, fn, tn = map(F.col, ("il_tp", "il_fp", "il_fn", "il_tn"))
    return _il(v).select("il_tp", "il_fp", "il_fn", "il_tn", _r(metrics.mcc(tp, fp, fn, tn)).alias("il_mcc"), _r(tp / (tp + fp + 1e-6)).alias("il_precision"), _r(tp / (tp + fn + 1e-6)).alias("il_recall"))


_CURVE = ", h AS (SELECT det_id, category_id, score, EXISTS (SELECT 1 FROM gt WHERE gt_id = det_id) AS hit FROM det), k AS (SELECT category_id, count(*) AS n_gt FROM gt GROUP BY 1), r AS (SELECT h.*, n_gt, sum(hit::INT) OVER w AS tp, row_number() OVER w AS rank FROM h JOIN k USING (category_id) WINDOW w AS (PARTITION BY category_id ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)), q AS (SELECT *, max(tp * 1.0 / rank) OVER (PARTITION BY category_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM r)"


def _curve(v) -> DataFrame:
    n = v("gt").groupBy("category_id").agg(F.count(F.lit(1)).alias("n_gt"))
    hits = v("det").join(v("gt").select(F.col("gt_id").alias("det_id"), F.lit(True).alias("hit")).distinct(), "det_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return metrics.precision_recall(hits.join(n, "category_id"), "category_id", [F.desc("score"), F.asc("det_id")], "hit", F.col("n_gt"))


@_query(_CURVE + " SELECT category_id, det_id, tp::BIGINT AS tp, round(tp * 1.0 / rank, 6) AS prec, round(envelope, 6) AS envelope FROM q", "det", "gt")
def ap_running_precision(v, t):
    return _curve(v).select("category_id", "det_id", "tp", _r(F.col("precision")).alias("prec"), _r(F.col("envelope")).alias("envelope"))


@_query(_CURVE + ", u AS (SELECT category_id, x, coalesce(max(envelope) FILTER (tp * 1.0 / n_gt >= x / 100.0 - 1e-11), 0) AS p FROM q, range(101) g(x) GROUP BY ALL) SELECT category_id, round(avg(p), 4) AS ap FROM u GROUP BY 1", "det", "gt")
def ap_101(v, t):
    return metrics.average_precision(_curve(v), "category_id").select("category_id", _r(F.col("ap"), 4).alias("ap"))


def _f1(v) -> DataFrame:
    det = v("det").where("score >= 500")
    return metrics.f1_totals(metrics.f1_rows(v("img"), v("gt"), det, suppression.matched(det, v("gt"), "image_id"), "image_id"))


@_query()
def f1_extended(v, t):
    det = v("det").where("score >= 500")
    rows = metrics.f1_rows(v("img"), v("gt"), det, suppression.matched(det, v("gt"), "image_id"), "image_id")
    return metrics.f1_extended(rows, _il(v))


def _tracks(v):
    gt = v("trk").select(F.col("video_id").alias("video"), "frame", F.col("track").alias("gt_id"))
    det = v("trk").where("score % 5 <> 0").select(F.col("video_id").alias("video"), "frame", F.when(F.col("frame") % 7 == 0, "other").otherwise(F.col("track")).alias("det_id"), (F.col("score") % 100 / 100).alias("sim"))
    return gt, det, gt.join(det, ["video", "frame"])


@_query("SELECT video_id, count(*) AS dets, count(DISTINCT track) AS ids, max(frame) + 1 AS frames FROM trk GROUP BY 1", "trk")
def count_metric(v, t):
    return v("trk").groupBy("video_id").agg(F.count(F.lit(1)).alias("dets"), F.countDistinct("track").alias("ids"), (F.max("frame") + 1).alias("frames"))


# reshape
@_query("SELECT video_id, track, frame, score AS value FROM trk", "trk")
def tracks_to_frames(v, t):
    padded = reshape.frames_to_tracks(v("trk"), "video_id", "track", "frame", "score", F.col("frame") + 1)
    return reshape.tracks_to_frames(padded, "video_id", "track", "values").select("video_id", "track", F.col("frame").cast("bigint").alias("frame"), "value")


@_query("SELECT video_id, track, max(frame) + 1 AS n, count(*) AS seen FROM trk GROUP BY ALL", "trk")
def frames_to_tracks(v, t):
    padded = reshape.frames_to_tracks(v("trk"), "video_id", "track", "frame", "score", F.col("frame") + 1)
    return padded.select("video_id", "track", F.size("values").cast("bigint").alias("n"), F.size(F.filter("values", lambda x: x.isNotNull())).cast("bigint").alias("seen"))


@_query("SELECT conv_id, turn, CASE WHEN role <> 'geometric' AND lower(trim(role)) IN ('user') THEN 'the ' || role || '.' ELSE role END AS role FROM turns", "turns")
def text_affix(v, t):
    return v("turns").select("conv_id", "turn", reshape.text_affix(F.col("role"), "the ", ".", ["User"]).alias("role"))


@_query("SELECT image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CAST(score >= 500 AS INT) DESC, md5(concat_ws(':', det_id, 0)), det_id) AS k FROM det) WHERE k <= 3", "det")
def keep_max_queries(v, t):
    return reshape.keep_max_queries(v("det"), "image_id", "det_id", 3, F.col("score") >= 500).select("image_id", "det_id")


@_query("SELECT image_id, count(*) AS n FROM det GROUP BY 1 HAVING count(*) <= 4", "det")
def too_many_outputs(v, t):
    return v("det").groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).where("n <= 4")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber + l_suppkey AS area FROM lineitem")
def rle_area(v, t):
    counts = F.array(F.col("l_partkey"), F.col("l_linenumber").cast("bigint"), F.lit(3).cast("bigint"), F.col("l_suppkey"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reshape.rle_area(counts).alias("area"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(least(l_partkey % 20 + 10, 25) - greatest(l_partkey % 20, 15), 0) AS inter FROM lineitem")
def rle_intersection(v, t):
    long = lambda c: c.cast("bigint")
    a = F.array(long(F.col("l_partkey") % 20), long(F.lit(10)), long(F.lit(30)))
    b = F.array(long(F.lit(15)), long(F.lit(10)), long(F.lit(15)))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reshape.rle_intersection(reshape.rle_spans(a), reshape.rle_spans(b)).alias("inter"))


# texts and conversations
# one text for each shape of an answer: closed, two calls, unclosed, a call behind the first end, none
_CALLS = ["x <tool> {\"a\": {\"b\": 1}}} </tool> y", "<tool>one</tool> <tool>two</tool>", "old <tool>first <tool> last", "no call </tool> <tool>late</tool>", "  plain  "]
_VERDICTS = ["<verdict>Accept</verdict>", "<verdict>Accept</verdict> then <verdict> Reject </verdict> end", "I Accept it", "<verdict>Accept", "<verdict>Accept or Reject</verdict>", "neither"]


def _one_of(texts: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (F.col("turn") % len(texts) + 1).cast("int"))


def _listed(texts: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in texts) + f"][turn % {len(texts)} + 1]"


@_query(f", m AS (SELECT conv_id, turn, string_split({_listed(_CALLS)}, '</tool>')[1] AS cut FROM turns) SELECT conv_id, turn, replace(regexp_replace(string_split(cut, '<tool>')[-1], '^\\s+|\\s+$', '', 'g'), '}}}}}}', '}}}}') AS call FROM m", "turns")
def tool_call_parse(v, t):
    return v("turns").select("conv_id", "turn", tx.tool_call(_one_of(_CALLS)).alias("call"))


@_query(f", m AS (SELECT conv_id, turn, string_split(string_split({_listed(_VERDICTS)}, '<verdict>')[-1], '</verdict>')[1] AS said FROM turns) SELECT conv_id, turn, CASE WHEN contains(said, 'Accept') AND NOT contains(said, 'Reject') THEN 'Accept' WHEN contains(said, 'Reject') AND NOT contains(said, 'Accept') THEN 'Reject' END AS verdict FROM m", "turns")
def verdict_parse(v, t):
    return v("turns").select("conv_id", "turn", tx.verdict(_one_of(_VERDICTS)).alias("verdict"))


_SAID = ["<tool> segment_phrase cat", "segment_phrase", "<tool> zoom"]


@_query(f", m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, role = 'assistant' AND contains({_listed(_SAID)}, '<tool>') AND contains({_listed(_SAID)}, 'segment_phrase') AS mark FROM turns) SELECT conv_id, turn FROM m a WHERE r <= 2 OR r >= (SELECT max(r) FROM m b WHERE b.conv_id = a.conv_id AND b.mark AND b.r > 2)", "turns")
def message_prune(v, t):
    return tx.prune_messages(v("turns"), tx.segment_call(F.col("role"), _one_of(_SAID))).select("conv_id", "turn")


_WARNED = "'The above image is the raw input image. The initial user input query is: ' || chr(39) || 'q' || chr(39) || '. Note that we have previously called the segment_phrase tool with each \"text_prompt\" in this list: [' || array_to_string([chr(39) || x || chr(39) FOR x IN used], ', ') || '], but none of the generated results were satisfactory. So make sure that you do not use any of these phrases as the \"text_prompt\" to call the segment_phrase tool again.'"


@_query(f", u AS (SELECT conv_id, list(role ORDER BY turn) AS used FROM turns GROUP BY 1), p AS (SELECT conv_id, [x FOR x IN used IF x <> used[-1]] AS used FROM u) SELECT conv_id, {_WARNED} AS warning FROM p", "turns")
def message_warning(v, t):
    listed = v("turns").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role")))["role"].alias("used"))
    return listed.select("conv_id", tx.warned(F.lit("q"), tx.used_before(F.col("used"), F.element_at("used", -1))).alias("warning"))


@_query("SELECT conv_id, count(*) FILTER (WHERE turn % 3 = 0) AS images FROM turns GROUP BY 1", "turns")
def message_images(v, t):
    kinds = F.collect_list(F.when(F.col("turn") % 3 == 0, "image").otherwise("text"))
    return v("turns").groupBy("conv_id").agg(kinds.alias("kinds")).select("conv_id", tx.count_images(F.col("kinds")).cast("bigint").alias("images"))


@_query("SELECT page_id, trim(regexp_replace(regexp_replace(lower(replace(url, '_', ' ')), '[^a-z0-9 \\n\\t]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def canonical_text(v, t):
    return t("pages").select("page_id", tx.canonical(F.col("url")).alias("text"))


# track state
@_query(", i AS (SELECT video_id, track, frame, frame - row_number() OVER (PARTITION BY video_id, track ORDER BY frame) AS g FROM trk), s AS (SELECT video_id, track, g, min(frame) AS f, count(*) AS n FROM i GROUP BY ALL HAVING count(*) >= 2) SELECT video_id, track, min(f) + 1 AS confirmed_at FROM s GROUP BY ALL", "trk")
def confirm_runs(v, t):
    return reshape.confirmed_runs(v("trk"), "video_id", "track", "frame", 2)


@_query()
def session_tracks(v, t):
    rows = v("trk").select(F.col("video_id").alias("session"), "frame", "track", "score")
    return tracks.batch(rows, tracks.Rules(init=3, delay=5, unmatched=4, confirm=2, only_within=False))


# masks as spans
def _mask(start: Column, length: Column) -> Column:
    """Two spans: ``length`` places from ``start`` on, and 5 more after a gap of 10."""
    span = lambda a, n: F.struct(a.cast("bigint").alias("start"), (a + n).cast("bigint").alias("end"))
    return F.array(span(start, length), span(start + length + 10, F.lit(5)))


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_MASK_SQL = "s AS (SELECT " + _LINE + ", l_partkey % 40 AS p, l_linenumber * 3 AS n FROM lineitem), m AS (SELECT *, greatest(least(p + n, 50) - greatest(p, 20), 0) + greatest(least(p + n + 15, 50) - greatest(p + n + 10, 20), 0) AS i FROM s)"


def _masks(t) -> DataFrame:
    fixed = F.array(F.struct(F.lit(20).cast("bigint").alias("start"), F.lit(50).cast("bigint").alias("end")))
    return t("lineitem").select(*_LINE.split(", "), _mask(F.col("l_partkey") % 40, F.col("l_linenumber") * 3).alias("a"), fixed.alias("b"))


@_query(f"WITH {_MASK_SQL} SELECT {_LINE}, round(i * 1.0 / (n + 35 - i), 6) AS iou, round(i * 1.0 / least(n + 5, 30), 6) AS iom FROM m")
def mask_iou(v, t):
    return _masks(t).select(*_LINE.split(", "), _r(masks.mask_iou(F.col("a"), F.col("b"))).alias("iou"), _r(masks.mask_iom(F.col("a"), F.col("b"))).alias("iom"))


@_query(f"WITH {_MASK_SQL}, c AS (SELECT *, list_concat(range(p, p + n), range(p + n + 10, p + n + 15)) AS px FROM m) SELECT {_LINE}, list_min([q // 12 FOR q IN px]) AS x1, list_min([q % 12 FOR q IN px]) AS y1, list_max([q // 12 FOR q IN px]) AS x2, list_max([q % 12 FOR q IN px]) AS y2 FROM c")
def mask_box(v, t):
    box = masks.mask_box(F.col("a"), F.lit(12))
    return _masks(t).select(*_LINE.split(", "), *[F.get(box, F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@_query(f"WITH {_MASK_SQL}, c AS (SELECT l_orderkey, unnest(list_concat(range(p, p + n), range(p + n + 10, p + n + 15))) AS px FROM m) SELECT l_orderkey, count(DISTINCT px) AS area FROM c GROUP BY 1")
def semantic_union(v, t):
    return masks.semantic_union(_masks(t), "l_orderkey", "a").select("l_orderkey", masks.span_area(F.col("spans")).alias("area"))


@_query()
def grid_components(v, t):
    pieces = _masks(t).select(*_LINE.split(", "), masks.grid_components("a", F.lit(12)).alias("pieces"))
    return pieces.select(*_LINE.split(", "), F.size(masks.without_sprinkles(F.col("pieces"), 5)).alias("kept_pieces"))


# rotated boxes
def _turned(p: str = "") -> tuple:
    c = lambda n: F.col(p + n).cast("double")
    return c("x1"), c("y1"), c("w"), c("h"), (F.col(p + "score") - 400).cast("double")


@_query("SELECT det_id, CAST((((score - 400) + 180) % 360 + 360) % 360 - 180 AS DOUBLE) AS angle FROM det", "det")
def rotated_angle(v, t):
    return v("det").select("det_id", rotated.normalised_angle(_turned()[4]).alias("angle"))


@_query("SELECT det_id, round(abs(cos(radians(score - 400))) * w + abs(sin(radians(score - 400))) * h, 6) AS outer_w, round(abs(cos(radians(score - 400))) * h + abs(sin(radians(score - 400))) * w, 6) AS outer_h FROM det", "det")
def rotated_outer_box(v, t):
    x1, y1, x2, y2 = rotated.outer_box(*_turned())
    return v("det").select("det_id", _r(x2 - x1).alias("outer_w"), _r(y2 - y1).alias("outer_h"))


@_query()
def rotated_iou(v, t):
    own = F.struct(*[c.alias(n) for c, n in zip(_turned("d."), "xywha", strict=True)])
    other = F.struct(*[F.col(f"t.{n}").cast("double").alias(m) for n, m in zip(("x1", "y1", "w", "h"), "xywh", strict=True)], F.lit(0.0).alias("a"))
    return _pairs(v).select("image_id", "det_id", "gt_id", _r(rotated.rotated_iou(own, other)).alias("iou"))


# matching
@_query()
def set_prediction_match(v, t):
    pred = v("det").select("image_id", "det_id", (F.col("score") / 1000).alias("prob"), *[c.cast("double").alias(n) for c, n in zip(_box(), ("x1", "y1", "x2", "y2"), strict=True)])
    target = v("gt").select("image_id", "gt_id", *[c.cast("double").alias(n) for c, n in zip(_box(), ("x1", "y1", "x2", "y2"), strict=True)])
    return matching.set_match(pred, target, "image_id")


@_query(
    f", {_PAIR}, m AS (SELECT image_id, det_id, gt_id, 0.3e0 * (score / 1000.0e0) + 0.7e0 * (i * 1.0e0 / (da + ta - i)) AS mixed FROM p), b AS (SELECT image_id, gt_id, quantile_cont(mixed, 0.0e0) AS low, CASE WHEN count(*) <= 2 THEN quantile_cont(mixed, 0) ELSE list_sort(list(mixed)) [CAST(floor((count(*) - 1) * (1 - 2.0e0 / count(*))) AS BIGINT) + 1] + ((count(*) - 1) * (1 - 2.0e0 / count(*)) - floor((count(*) - 1) * (1 - 2.0e0 / count(*)))) * (list_sort(list(mixed)) [CAST(ceil((count(*) - 1) * (1 - 2.0e0 / count(*))) AS BIGINT) + 1] - list_sort(list(mixed)) [CAST(floor((count(*) - 1) * (1 - 2.0e0 / count(*))) AS BIGINT) + 1]) END AS bar FROM m GROUP BY 1, 2) SELECT image_id, det_id, gt_id, round(mixed, 6) AS mixed FROM m JOIN b USING (image_id, gt_id) WHERE mixed > bar AND mixed > 0.4e0",
    "det",
    "gt",
)
def one_to_many_match(v, t):
    pairs = _pairs(v).select("image_id", "det_id", "gt_id", (F.col("score") / 1000).alias("prob"), g.iou(_box("d."), _box("t.")).alias("iou"))
    return matching.one_to_many(pairs, "image_id", F.col("prob"), F.col("iou"), top=2).select("image_id", "det_id", "gt_id", _r(F.col("mixed")).alias("mixed"))


def _association(v) -> dict[str, DataFrame]:
    trk = v("gt").select("image_id", F.col("gt_id").alias("trk_id"), (F.col("w") % 7 == 0).alias("empty"))
    overlaps = _pairs(v).select("image_id", "det_id", F.col("gt_id").alias("trk_id"), g.iou(_box("d."), _box("t.")).alias("iou"))
    return matching.associate(v("det").select("image_id", "det_id", (F.col("score") / 1000).alias("score")), trk, overlaps, ["image_id"], keep_at=0.9)


@_query(f", {_PAIR} SELECT det_id FROM det WHERE score >= 700 EXCEPT SELECT det_id FROM p WHERE i * 2 >= da + ta - i", "det", "gt")
def association_new(v, t):
    return _association(v)["new"].select("det_id").distinct()


@_query(f", {_PAIR} SELECT gt_id AS trk_id FROM gt WHERE w % 7 <> 0 EXCEPT SELECT gt_id FROM p WHERE i * 10 >= 9 * (da + ta - i)", "det", "gt")
def association_unmatched(v, t):
    return _association(v)["unmatched"].select("trk_id").distinct()


# class and association metric
def _classes(v) -> tuple:
    gt, det, sim = _tracks(v)
    return gt.withColumn("cls", F.col("gt_id")), det.select("video", "frame", "det_id").withColumn("cls", F.when(F.col("frame") % 5 == 0, "click").otherwise(F.col("det_id"))), sim


@_query()
def teta(v, t):
    return metrics.teta(*_classes(v))


@_query()
def teta_combine(v, t):
    return metrics.teta_combined(metrics.teta(*_classes(v)), ["cls"])


# rollups
@_query("SELECT b AS bucket, round(avg(score), 6) AS mean FROM (SELECT CAST(category_id AS VARCHAR) AS b, score FROM det) GROUP BY 1 UNION ALL SELECT 'overall', round(avg(m), 6) FROM (SELECT avg(score) AS m FROM det GROUP BY category_id)", "det")
def rarity_average(v, t):
    return rollups.bucket_average(v("det").withColumn("bucket", F.col("category_id")), "bucket", "score").select("bucket", _r(F.col("mean")).alias("mean"))


@_query("SELECT round(avg(score), 6) AS weighted_mean, (SELECT round(avg(m), 6) FROM (SELECT avg(score) AS m FROM det GROUP BY category_id)) AS category_mean FROM det", "det")
def category_averages(v, t):
    return rollups.averages(v("det"), "category_id", "score").select(_r(F.col("weighted_mean")).alias("weighted_mean"), _r(F.col("category_mean")).alias("category_mean"))


@_query("SELECT CAST(category_id % 2 AS INT) AS super, CAST(sum(w) AS BIGINT) AS w, CAST(sum(score) AS BIGINT) AS score FROM det GROUP BY 1", "det")
def super_category_rollup(v, t):
    mapping = v("det").select("category_id").distinct().withColumn("super", (F.col("category_id") % 2).cast("int"))
    return rollups.super_categories(v("det"), mapping, "category_id", ["w", "score"])


@_query("SELECT video_id, track, round(avg(score), 6) AS score, count(*) AS n FROM trk GROUP BY 1, 2", "trk")
def track_averages(v, t):
    sums = v("trk").groupBy("video_id", "track").agg(F.count(F.lit(1)).alias("n"))
    made = rollups.track_summary(v("trk").withColumn("label", F.col("event_id") % 3), "video_id", "track", "score", "label")
    return made.join(sums, ["video_id", "track"]).select("video_id", "track", _r(F.col("score")).alias("score"), "n")


@_query(
    f", p AS (SELECT d.image_id, d.category_id AS left_id, t.category_id AS right_id, {_INTER} AS i FROM det d JOIN gt t ON d.image_id = t.image_id AND d.w = t.w), a AS (SELECT image_id, category_id, sum(w*h) AS a FROM det GROUP BY 1, 2), b AS (SELECT image_id, category_id, sum(w*h) AS b FROM gt GROUP BY 1, 2), s AS (SELECT image_id, left_id, right_id, sum(i) AS i FROM p GROUP BY 1, 2, 3) SELECT s.image_id, left_id, right_id, round(i * 1.0e0 / (a + b - i), 6) AS iou FROM s JOIN a ON a.image_id = s.image_id AND a.category_id = left_id JOIN b ON b.image_id = s.image_id AND b.category_id = right_id",
    "det",
    "gt",
)
def track_iou(v, t):
    side = lambda n, k: v(n).select("image_id", F.col("w").alias("frame"), F.col("category_id").alias(f"{k}_id"), *[F.col(c).alias(f"{k}_{c}") for c in ("x1", "y1", "w", "h")])
    return rollups.track_iou(side("det", "left"), side("gt", "right"), "image_id", "frame", "left_id", "right_id", g.intersection(_box("left_"), _box("right_")), F.col("left_w") * F.col("left_h"), F.col("right_w") * F.col("right_h")).withColumn("iou", _r(F.col("iou")))


@_query("SELECT image_id, round(CASE WHEN d + t > 0 THEN 2.0 * least(d, t) / (2 * least(d, t) + abs(d - t)) ELSE 1 END, 6) AS f1 FROM (SELECT image_id, (SELECT count(*) FROM det x WHERE x.image_id = i.image_id) AS d, (SELECT count(*) FROM gt y WHERE y.image_id = i.image_id) AS t FROM img i)", "det", "gt", "img")
def pair_f1(v, t):
    sides = v("img").join(v("det").groupBy("image_id").agg(F.count(F.lit(1)).alias("d")), "image_id", "left").join(v("gt").groupBy("image_id").agg(F.count(F.lit(1)).alias("t")), "image_id", "left").fillna(0, ["d", "t"])
    tp = F.least("d", "t")
    return sides.select("image_id", _r(rollups.pair_f1(tp, F.col("d") - tp, F.col("t") - tp)).alias("f1"))


# query filters, frame lookups, track bookkeeping
@_query("SELECT image_id FROM img WHERE phrase NOT IN ('F') AND image_id NOT IN (SELECT image_id FROM gt WHERE w * h < 300)", "img", "gt")
def query_filters(v, t):
    kept = filters.without_texts(v("img"), "phrase", ["F"])
    return filters.without_touching(kept, v("gt"), "image_id", F.col("w") * F.col("h") < 300).select("image_id")


@_query("SELECT image_id, dense_rank() OVER (PARTITION BY image_id ORDER BY category_id) - 1 AS stage, det_id FROM det WHERE category_id <> 2", "det")
def stage_remap(v, t):
    kept = v("det").where("category_id <> 2").withColumn("stage", F.col("category_id"))
    return filters.renumbered(kept, "image_id", "stage").select("image_id", "stage", "det_id")


@_query(
    f", {_PAIR}, hit AS (SELECT DISTINCT det_id FROM p WHERE i * 2 >= da + ta - i) SELECT det_id FROM det d WHERE det_id IN (SELECT det_id FROM hit) OR ((EXISTS (SELECT 1 FROM gt t WHERE t.image_id = d.image_id AND t.category_id = d.category_id) OR d.category_id IN (1, 2)) AND d.category_id <> 3)",
    "det",
    "gt",
)
def open_world_filter(v, t):
    hit = _pairs(v).where(g.iou(_box("d."), _box("t.")) >= 0.5).select("det_id")
    classes = v("det").select("image_id", "category_id").distinct()
    return filters.open_world(v("det"), v("gt"), hit, ["image_id"], "category_id", classes.where("category_id IN (1, 2)"), classes.where("category_id = 3")).select("det_id")


@_query(f", p AS (SELECT d.image_id, d.det_id AS a, t.det_id AS b, {_INTER} AS i, d.w*d.h AS da, t.w*t.h AS ta FROM det d JOIN det t ON d.image_id = t.image_id AND d.det_id < t.det_id) SELECT image_id, a, b FROM p WHERE i * 2 > da + ta - i", "det")
def self_pair_overlaps(v, t):
    pairs = filters.self_pairs(v("det"), ["image_id"], "det_id", ["x1", "y1", "w", "h"])
    return pairs.where(g.iou(_box("a_"), _box("b_")) > 0.5).select("image_id", F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"))


@_query("SELECT video_id, track, min(frame) AS first_frame FROM trk GROUP BY 1, 2", "trk")
def first_appearance(v, t):
    return filters.first_appearance(v("trk"), "video_id", "track", "frame")


@_query(
    ", s AS (SELECT *, score % 3 AS det, frame // 2 AS f FROM trk), b AS (SELECT *, min(f) OVER (PARTITION BY video_id, track) AS born FROM s), c AS (SELECT *, first_value(track) OVER (PARTITION BY video_id, f, det ORDER BY born, track) AS first FROM b), n AS (SELECT DISTINCT video_id, first, track, f, born FROM c WHERE track <> first), k AS (SELECT *, row_number() OVER (PARTITION BY video_id, first, track ORDER BY f) AS k FROM n) SELECT DISTINCT video_id, track FROM k WHERE k = 2 AND born > f - 9",
    "trk",
)
def duplicate_track_removal(v, t):
    rows = v("trk").withColumn("det", F.col("score") % 3).withColumn("f", F.floor(F.col("frame") / 2))
    return filters.duplicate_tracks(rows, "video_id", ["det"], "track", "f", 2, 9)


@_query(", r AS (SELECT d.*, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS k, (SELECT count(*) FROM gt t WHERE t.image_id = d.image_id) AS held FROM det d) SELECT DISTINCT det_id FROM r WHERE k <= 5 - held", "det", "gt")
def cap_new_detections(v, t):
    return filters.under_cap(v("det"), v("gt"), "image_id", "score", "det_id", 5).select("det_id").distinct()


@_query("SELECT video_id, frame, track, coalesce(lead(score, 2) OVER w, last_value(score) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS later FROM trk WINDOW w AS (PARTITION BY video_id, track ORDER BY frame)", "trk")
def look_ahead_status(v, t):
    return filters.look_ahead(v("trk"), ["video_id", "track"], "frame", "score", 3).select("video_id", "frame", "track", "later")


@_query(
    ", p AS (SELECT a.video_id, a.frame, b.frame AS cond, b.frame < a.frame AS before, abs(b.frame - a.frame) AS far FROM trk a JOIN trk b ON a.video_id = b.video_id AND b.track = 'click'), s AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame, before ORDER BY far) AS side FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY side > 1, far, cond) AS k FROM s) SELECT video_id, frame, cond FROM r WHERE k <= 4",
    "trk",
)
def nearest_condition_frames(v, t):
    return filters.nearest_frames(v("trk"), v("trk").where("track = 'click'"), "video_id", "frame", 4)


@_query("SELECT video_id, CASE WHEN count(DISTINCT video_id) OVER (PARTITION BY track) > 1 THEN concat_ws('@', track, video_id) ELSE track END AS track, frame FROM trk", "trk")
def unique_tracks(v, t):
    return filters.unique_tracks(v("trk").select("video_id", "track", "frame"), "video_id", "track")


@_query()
def track_nms(v, t):
    rows = v("det").select(F.col("image_id").alias("video_id"), F.col("category_id").alias("track"), (F.col("w") % 4).alias("frame"), "score", "x1", "y1", "w", "h")
    return filters.track_suppression(rows, "video_id", "track", "frame", 0.5)


# scalar functions
@_query("SELECT det_id, round(1 / (1 + exp(-(score - 500) / 250.0e0)) * (1 / (1 + exp(-(w - 15) / 5.0e0))), 6) AS prob, round(greatest(0, 1 - sqrt((x1 - 20) * (x1 - 20) + (y1 - 20) * (y1 - 20)) / 30.0e0), 6) AS near FROM det", "det")
def score_functions(v, t):
    prob = scalar.presence_score((F.col("score") - 500) / 250, (F.col("w") - 15) / 5)
    return v("det").select("det_id", _r(prob).alias("prob"), _r(scalar.euclidean_similarity(F.col("x1"), F.col("y1"), F.lit(20), F.lit(20), 30.0)).alias("near"))


@_query("SELECT page_id, 'data:image/jpeg;base64,' || to_base64(encode(url)) AS uri, printf('seg_%02d_crop.jpg', CAST(page_id % 100 AS INT)) AS crop FROM media", "media")
def text_functions(v, t):
    return v("media").select("page_id", scalar.data_uri(F.col("url").cast("binary")).alias("uri"), scalar.crop_name((F.col("page_id") % 100).cast("int")).alias("crop"))


@_query("SELECT image_id, CASE WHEN width < height THEN CAST(trunc(side * height * 1.0e0 / width) AS BIGINT) ELSE side END AS new_h, CASE WHEN width < height THEN side ELSE CAST(trunc(side * width * 1.0e0 / height) AS BIGINT) END AS new_w FROM (SELECT *, CASE WHEN greatest(width, height) * 1.0e0 / least(width, height) * 80 > 110 THEN CAST(round_even(110.0e0 * least(width, height) / greatest(width, height), 0) AS BIGINT) ELSE 80 END AS side FROM img)", "img")
def aspect_size(v, t):
    h, w = scalar.aspect_size(F.col("width"), F.col("height"), 80, 110)
    return v("img").select("image_id", h.alias("new_h"), w.alias("new_w"))


# mask shapes
_GRID = f"WITH {_MASK_SQL}, c AS (SELECT DISTINCT l_partkey % 40 AS p, l_linenumber * 3 AS n FROM lineitem), px AS (SELECT p, n, u.x AS x, v.y AS y, ((x * 12 + y >= p AND x * 12 + y < p + n) OR (x * 12 + y >= p + n + 10 AND x * 12 + y < p + n + 15)) AS m FROM c, range(7) u(x), range(12) v(y))"
_EDGE = _GRID + ", e AS (SELECT a.p, a.n, a.x, a.y, bool_or(b.m <> a.m) AS edge FROM px a JOIN px b ON a.p = b.p AND a.n = b.n AND b.x IN (a.x, a.x + 1) AND b.y IN (a.y, a.y + 1) GROUP BY ALL)"


def _grid(t) -> DataFrame:
    return _masks(t).select(*_LINE.split(", "), "a")


def _span_sum(c: Column, name: str) -> Column:
    return masks.span_area(c).alias(name)


@_query(f"{_EDGE}, r AS (SELECT p, n, count_if(edge) AS boundary FROM e GROUP BY ALL) SELECT {_LINE}, boundary FROM s JOIN r USING (p, n)")
def mask_boundary(v, t):
    return _grid(t).select(*_LINE.split(", "), _span_sum(shapes.boundary(F.col("a"), F.lit(12), F.lit(7)), "boundary"))


@_query(f"{_GRID}, d AS (SELECT p, n, x, y FROM px a WHERE EXISTS (SELECT 1 FROM px b WHERE b.m AND a.p = b.p AND a.n = b.n AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)), r AS (SELECT p, n, count(*) AS area FROM d GROUP BY ALL) SELECT {_LINE}, area FROM s JOIN r USING (p, n)")
def mask_dilation(v, t):
    return _grid(t).select(*_LINE.split(", "), _span_sum(shapes.dilated(F.col("a"), F.lit(12), F.lit(7), 3), "area"))


@_query(f"{_GRID}, d AS (SELECT a.p, a.n, a.x, a.y, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS far FROM px a JOIN px b ON a.p = b.p AND a.n = b.n AND a.m AND NOT b.m GROUP BY ALL), r AS (SELECT p, n, max(far) AS depth FROM d GROUP BY ALL) SELECT {_LINE}, depth FROM s JOIN r USING (p, n)")
def mask_depth(v, t):
    return _grid(t).select(*_LINE.split(", "), shapes.depth(F.col("a"), F.lit(12), F.lit(7)).alias("depth"))


@_query(
    f"{_EDGE}, g AS (SELECT x, y, (x * 12 + y >= 20 AND x * 12 + y < 50) AS m FROM range(7) u(x), range(12) v(y)), ge AS (SELECT a.x, a.y, bool_or(a.m <> b.m) AS edge FROM g a JOIN g b ON b.x IN (a.x, a.x + 1) AND b.y IN (a.y, a.y + 1) GROUP BY ALL),"
    " eb AS (SELECT * FROM e WHERE edge), gb AS (SELECT * FROM ge WHERE edge),"
    " dh AS (SELECT p, n, count(*) AS k FROM eb WHERE EXISTS (SELECT 1 FROM gb WHERE abs(gb.x - eb.x) <= 1 AND abs(gb.y - eb.y) <= 1) GROUP BY ALL), gh AS (SELECT p, n, count(*) AS k FROM (SELECT DISTINCT eb.p, eb.n, gb.x, gb.y FROM gb JOIN eb ON abs(gb.x - eb.x) <= 1 AND abs(gb.y - eb.y) <= 1) GROUP BY ALL),"
    " q AS (SELECT p, n, coalesce(dh.k, 0) * 1.0e0 / count(*) AS pr, coalesce(gh.k, 0) * 1.0e0 / (SELECT count(*) FROM gb) AS re FROM eb LEFT JOIN dh USING (p, n) LEFT JOIN gh USING (p, n) GROUP BY p, n, dh.k, gh.k)"
    f" SELECT {_LINE}, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f FROM s JOIN q USING (p, n)"
)
def boundary_f(v, t):
    edge = lambda c: shapes.boundary(F.col(c), F.lit(12), F.lit(7))
    wide = lambda c: shapes.dilated(F.col(c), F.lit(12), F.lit(7), 3)
    edges = _masks(t).select(*_LINE.split(", "), edge("a").alias("ea"), edge("b").alias("eb"))
    told = edges.withColumn("wa", wide("ea")).withColumn("wb", wide("eb"))
    value = shapes.f_measure(masks.span_area(F.col("ea")), masks.span_area(F.col("eb")), reshape.rle_intersection(F.col("ea"), F.col("wb")), reshape.rle_intersection(F.col("eb"), F.col("wa")))
    return told.select(*_LINE.split(", "), _r(value).alias("f"))


@_query()
def mask_smoothing(v, t):
    return _grid(t).select(*_LINE.split(", "), _span_sum(shapes.without_small_parts(F.col("a"), F.lit(12), F.lit(7), 5), "area"))


@_query()
def mask_centres(v, t):
    return _grid(t).select(*_LINE.split(", "), shapes.centres(F.col("a"), F.lit(12), F.lit(7), 2).alias("points"))


@_query(f"WITH {_MASK_SQL}, k AS (SELECT *, CAST(floor(CAST('0x' || substr(md5(l_orderkey || ':0'), 1, 12) AS BIGINT) * (n + 5) / 281474976710656.0e0) AS BIGINT) AS k FROM s) SELECT {_LINE}, CASE WHEN k < n THEN p + k ELSE p + k + 10 END AS at FROM k")
def mask_point_sample(v, t):
    k = shapes.seeded(F.col("l_orderkey").cast("string"), 0, masks.span_area(F.col("a")))
    return _grid(t).select(*_LINE.split(", "), shapes.mask_point(F.col("a"), k).alias("at"))


@_query(f"WITH {_MASK_SQL}, x AS (SELECT l_orderkey, l_partkey, max(l_linenumber) AS l FROM lineitem GROUP BY 1, 2), o AS (SELECT l_orderkey, l_partkey, l_partkey % 40 AS p, l * 3 AS n FROM x), c AS (SELECT l_orderkey, l_partkey, unnest(list_concat(range(p, p + n), range(p + n + 10, p + n + 15))) AS px FROM o), w AS (SELECT l_orderkey, px, max(l_partkey) AS l_partkey FROM c GROUP BY 1, 2), a AS (SELECT l_orderkey, l_partkey, count(*) AS area FROM w GROUP BY 1, 2) SELECT l_orderkey, l_partkey, coalesce(area, 0) AS area FROM o LEFT JOIN a USING (l_orderkey, l_partkey)")
def non_overlap(v, t):
    one = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_linenumber").alias("l"))
    spans = one.select("l_orderkey", "l_partkey", F.col("l_partkey").alias("score"), _mask(F.col("l_partkey") % 40, F.col("l") * 3).alias("a"))
    return selection.owned_pixels(spans, "l_orderkey", "l_partkey", "score", "a")


# gates, samples, cascades and splits
@_query("SELECT det_id, w * h * 1.0e0 / (width * height) < 0.05e0 AS needs, w * h >= 100 AND width * height - w * h >= w * h * 0.02e0 AS can FROM det JOIN img USING (image_id)", "det", "img")
def inpaint_gate(v, t):
    size = F.col("w") * F.col("h"), F.col("width"), F.col("height")
    return v("det").join(v("img"), "image_id").select("det_id", selection.needs_inpaint(*size, 0.05).alias("needs"), selection.can_inpaint(*size).alias("can"))


@_query("SELECT det_id, round(least(1, (x1 + w / 2.0e0) / width), 6) AS cx, round(least(1, (y1 + h / 2.0e0) / height), 6) AS cy, round(greatest(0.01e0, least(1, w * 1.5e0 / width)), 6) AS hw, round(greatest(0.01e0, least(1, h * 1.5e0 / height)), 6) AS hh, greatest(least(x1 - w / 2.0e0, width), 0) AS sx1, greatest(least(y1 + h * 1.5e0, height), 0) AS sy2 FROM det JOIN img USING (image_id)", "det", "img")
def box_hint(v, t):
    hint = selection.box_hint(_box(), F.col("width"), F.col("height"))
    big = selection.scaled_box(_box(), 2.0, F.col("width").cast("double"), F.col("height").cast("double"))
    return v("det").join(v("img"), "image_id").select("det_id", *[_r(c).alias(n) for c, n in zip(hint, ("cx", "cy", "hw", "hh"), strict=True)], big[0].alias("sx1"), big[3].alias("sy2"))


@_query("SELECT d.det_id FROM det d WHERE d.image_id IN (SELECT image_id FROM img WHERE phrase = 'O') AND (d.category_id = 2 OR d.w <= 20)", "det", "img")
def availability_cascade(v, t):
    left = selection.cascade(v("img"), "image_id", v("img").where("phrase = 'O'"), v("det"))[1]
    limit = F.when(F.col("category_id") != 2, 20)
    return left.where(selection.compliant(F.col("w"), limit)).select("det_id")


@_query(
    ", n AS (SELECT DISTINCT video_id, frame FROM trk), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS k, count(*) OVER (PARTITION BY video_id) AS n FROM n), q AS (SELECT *, least(3, (n - 1) // 2) AS step FROM r WHERE n >= 3), b AS (SELECT *, k - CAST(floor(CAST('0x' || substr(md5(video_id || ':0'), 1, 12) AS BIGINT) * (n - 2 * step) / 281474976710656.0e0) AS BIGINT) AS o FROM q) SELECT video_id, frame FROM b WHERE o >= 0 AND o <= 2 * step AND o % step = 0",
    "trk",
)
def stage_sampling(v, t):
    return selection.stage_sample(v("trk").select("video_id", "frame"), "video_id", "frame", 3, 3)


@_query(", r AS (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY det_id) - 1 AS k FROM (SELECT DISTINCT image_id, det_id FROM det)) SELECT image_id, det_id, k % 3 AS chunk, k // 3 AS slot FROM r", "det")
def round_robin_chunks(v, t):
    return selection.round_robin(v("det").select("image_id", "det_id").distinct(), "image_id", "det_id", 3)


@_query(", l AS (SELECT image_id, list_sort(list(DISTINCT gt_id)) AS ids FROM gt GROUP BY 1), d AS (SELECT *, CAST('0x' || substr(md5(image_id || ':0'), 1, 12) AS BIGINT) / 281474976710656.0e0 AS u, CAST('0x' || substr(md5(image_id || ':1'), 1, 12) AS BIGINT) / 281474976710656.0e0 AS w FROM l) SELECT image_id, CASE WHEN floor(u * 100) < 40 THEN ids[CAST(floor(w * len(ids)) AS BIGINT) + 1] END AS target FROM d", "gt")
def text_to_visual(v, t):
    listed = v("gt").groupBy("image_id").agg(F.array_sort(F.collect_set("gt_id")).alias("ids"))
    return listed.select("image_id", selection.visual_target(F.col("image_id").cast("string"), F.col("ids"), 40).alias("target"))


@_query("SELECT det_id, CASE WHEN category_id IN (1, 2, 3) THEN 'known' WHEN category_id = 4 THEN 'distractor' ELSE 'unknown' END AS split FROM det", "det")
def class_split(v, t):
    classes = v("det").select("category_id").distinct()
    return selection.class_split(v("det"), "category_id", classes.where("category_id <= 3"), classes.where("category_id BETWEEN 3 AND 4")).select("det_id", "split")


@_query(", l AS (SELECT image_id, list(CAST(score AS VARCHAR) ORDER BY score DESC, det_id) FILTER (WHERE length(CAST(score AS VARCHAR)) > 2) AS masks FROM (SELECT DISTINCT image_id, det_id, score FROM det) GROUP BY 1) SELECT image_id, coalesce(len(masks), 0) AS kept, coalesce(array_to_string(masks, ','), '') AS masks FROM l", "det")
def long_mask_filter(v, t):
    order = F.array_sort(F.collect_set(F.struct("det_id", "score")))
    lists = v("det").groupBy("image_id").agg(order.alias("e"))
    kept = selection.long_masks(F.col("e.det_id"), F.transform("e.score", lambda s: s.cast("string")), F.col("e.score"), 2)
    return lists.select("image_id", F.size(kept).cast("bigint").alias("kept"), F.concat_ws(",", kept["mask"]).alias("masks"))


@_query(", l AS (SELECT image_id, list_sort(list(DISTINCT category_id)) AS ids FROM det GROUP BY 1) SELECT image_id, CAST([x FOR x IN [1, 2, 5] IF list_contains(ids, x)] AS VARCHAR) AS chosen, len(ids) + greatest(7 - len(ids), 0) AS padded_size FROM l", "det")
def selected_ids(v, t):
    listed = v("det").groupBy("image_id").agg(F.collect_set(F.col("category_id").cast("int")).alias("ids"))
    chosen = selection.chosen_ids(F.array(F.lit(5), F.lit(2), F.lit(2), F.lit(1)), F.col("ids"))
    return listed.select("image_id", F.concat(F.lit("["), F.concat_ws(", ", chosen.cast("array<string>")), F.lit("]")).alias("chosen"), F.size(selection.padded(F.col("ids"), F.lit(7), F.lit(0))).cast("bigint").alias("padded_size"))


# further track rules
@_query()
def batched_track_rules(v, t):
    rows = v("trk").select(F.col("video_id").alias("session"), F.floor(F.col("frame") / 2).alias("frame"), "track", F.when(F.col("score") % 4 > 0, F.col("score") % 3).alias("det"), (F.col("score") % 5 == 0).alias("unmatched"), (F.col("score") % 7 == 0).alias("empty"))
    return rules.batched_counters(rows, True)


@_query()
def occlusion_suppression(v, t):
    box = [F.when(F.col("score") % 6 > 0, F.col("score") % 5 + k).alias(n) for k, n in ((0, "x1"), (0, "y1"), (20, "x2"), (20, "y2"))]
    rows = v("trk").select(F.col("video_id").alias("session"), F.floor(F.col("frame") / 3).alias("frame"), "track", *box, (F.col("score") % 11 == 0).alias("removed"))
    return rules.recently_occluded(rows)
