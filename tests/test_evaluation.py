"""Matching, masks, rotated boxes, the class and association metric, and files against brute force."""

import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from objectlens.functions import masks, rotated
from objectlens.operators import filters, matching, metrics, reshape, rollups
from objectlens.sources import files


def test_components_against_flood_fill():
    rng = np.random.RandomState(5)
    for _ in range(30):
        h, w = rng.randint(1, 9, 2)
        flat = rng.rand(h * w) < 0.5
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flat.astype(int), [0]])))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        want, left = {}, {(p // h, p % h) for p in np.flatnonzero(flat).tolist()}
        while left:
            seen, wait = set(), [left.pop()]
            while wait:
                x, y = wait.pop()
                seen.add((x, y))
                near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                wait += near
            want |= {x * h + y: len(seen) for x, y in seen}
        got = {p: n for a, b, n in masks.component_sizes(spans, int(h)) for p in range(a, b)}
        assert got == want


def test_semantic_union(spark):
    rows = [(1, [(0, 4), (8, 9)]), (1, [(3, 6)]), (1, [(6, 7)]), (2, [])]
    df = spark.createDataFrame(rows, "g int, spans array<struct<start: bigint, end: bigint>>")
    assert [(r.g, [tuple(s) for s in r.spans]) for r in masks.semantic_union(df, "g", "spans").collect()] == [(1, [(0, 7), (8, 9)])]


def test_rotated_overlap():
    assert rotated.overlap((0, 0, 4, 2, 0), (1, 0, 4, 2, 0)) == pytest.approx(6)
    assert rotated.overlap((0, 0, 4, 2, 90), (0, 0, 2, 4, 0)) == pytest.approx(8)
    assert rotated.overlap((0, 0, 1, 1, 30), (5, 5, 1, 1, 0)) == 0
    rng, own, other = np.random.RandomState(2), (1.0, 2.0, 5.0, 3.0, 33.0), (2.0, 1.5, 4.0, 6.0, -71.0)

    def inside(box, p):
        c, s = np.cos(np.radians(box[4])), np.sin(np.radians(box[4]))
        dx, dy = p[:, 0] - box[0], p[:, 1] - box[1]
        return (abs(dx * c - dy * s) <= box[2] / 2) & (abs(dx * s + dy * c) <= box[3] / 2)

    p = rng.uniform(-6, 9, (400_000, 2))
    assert rotated.overlap(own, other) == pytest.approx((inside(own, p) & inside(other, p)).mean() * 225, rel=0.03)


@pytest.mark.parametrize("focal", [False, True])
def test_set_match_is_cheapest(spark, focal):
    rng = np.random.RandomState(7)
    box = lambda n: np.hstack([a := rng.rand(n, 2), a + 0.1 + rng.rand(n, 2)])
    pred, target, prob = box(4), box(3), rng.rand(4)
    left = spark.createDataFrame([(0, i, float(prob[i]), *map(float, pred[i]), i != 2) for i in range(4)] + [(1, 9, 0.5, 0.0, 0.0, 1.0, 1.0, True)], "image int, det_id int, prob double, x1 double, y1 double, x2 double, y2 double, valid boolean")
    right = spark.createDataFrame([(0, j, *map(float, target[j])) for j in range(3)], "image int, gt_id int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.gt_id, r.det_id) for r in matching.set_match(left, right, "image", focal=focal).collect())

    def cost(i, j):
        (ax, ay, bx, by), (cx, cy, dx, dy) = pred[i], target[j]
        both = max(0, min(bx, dx) - max(ax, cx)) * max(0, min(by, dy) - max(ay, cy))
        union = (bx - ax) * (by - ay) + (dx - cx) * (dy - cy) - both
        hull = (max(bx, dx) - min(ax, cx)) * (max(by, dy) - min(ay, cy))
        far = abs((ax + bx - cx - dx) / 2) + abs((ay + by - cy - dy) / 2) + abs(bx - ax - dx + cx) + abs(by - ay - dy + cy)
        p = prob[i]
        cls = 0.25 * (1 - p) ** 2 * -np.log(p + 1e-8) - 0.75 * p**2 * -np.log(1 - p + 1e-8) if focal else -p
        return cls + 5 * far - 2 * (both / union - (hull - union) / hull)

    best = min(itertools.permutations([0, 1, 3], 3), key=lambda p: sum(cost(i, j) for j, i in enumerate(p)))
    assert got == list(enumerate(best))


def test_association(spark):
    det = spark.createDataFrame([(0, "a", 0.9), (0, "b", 0.9), (0, "c", 0.1)], "frame int, det_id string, score double")
    trk = spark.createDataFrame([(0, "t", False), (0, "u", False), (0, "v", True)], "frame int, trk_id string, empty boolean")
    overlaps = spark.createDataFrame([(0, "a", "t", 0.8), (0, "a", "u", 0.7), (0, "c", "v", 0.2)], "frame int, det_id string, trk_id string, iou double")
    many = matching.associate(det, trk, overlaps, ["frame"])
    assert [r.det_id for r in many["new"].collect()] == ["b"]
    assert many["unmatched"].count() == 0 and many["matches"].count() == 2
    assert [r.trk_id for r in matching.associate(det, trk, overlaps, ["frame"], one_to_one=True)["unmatched"].collect()] == ["u"]


def test_teta(spark):
    gt = spark.createDataFrame([(0, f, g, "x" if g == "p" else "y") for f in range(4) for g in "pq"], "video int, frame int, gt_id string, cls string")
    perfect = gt.withColumnRenamed("gt_id", "det_id")
    sim = gt.select("video", "frame", "gt_id", F.col("gt_id").alias("det_id"), F.lit(1.0).alias("sim"))
    assert [r.teta for r in metrics.teta_combined(metrics.teta(gt, perfect, sim), []).collect()] == [pytest.approx(1.0)]
    # a right place with a wrong class in half of the frames, and an identity that switches once
    det = perfect.withColumn("cls", F.when((F.col("det_id") == "p") & (F.col("frame") < 2), "y").otherwise(F.col("cls"))).withColumn("det_id", F.when((F.col("det_id") == "q") & (F.col("frame") == 3), "r").otherwise(F.col("det_id")))
    sim = gt.select("video", "frame", "gt_id", F.when((F.col("gt_id") == "q") & (F.col("frame") == 3), "r").otherwise(F.col("gt_id")).alias("det_id"), F.lit(1.0).alias("sim"))
    rows = {r.cls: r for r in metrics.teta(gt, det, sim).where("alpha = 0.5").collect()}
    assert (rows["x"].loc_tp, rows["x"].cls_tp, rows["x"].cls_fn) == (4, 2, 2)
    assert (rows["y"].cls_tp, rows["y"].cls_fp) == (4, 2)
    assert rows["x"].assoc_a == pytest.approx(1.0)
    assert rows["y"].assoc_a == pytest.approx((3 * 3 / 4 + 1 * 1 / 4) / 4)
    # nothing predicted
    empty = metrics.teta(gt, det.limit(0), sim.limit(0)).where("alpha = 0.5").collect()
    assert {(r.cls, r.loc_tp, r.loc_fn) for r in empty} == {("x", 0, 4), ("y", 0, 4)}


def test_best_ground_truth(spark):
    rows = [(1, 0, 0.4, False), (1, 1, 0.6, False), (1, 2, 0.5, False), (2, 0, 0.9, False), (2, 1, None, True), (3, 0, None, False), (3, 1, 0.9, False)]
    df = spark.createDataFrame(rows, "image int, ordinal int, f1 double, tn boolean")
    got = {r.image: r.ordinal for r in rollups.best_ground_truth(df, "image", "ordinal", "f1", F.col("tn")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_track_summary_ties(spark):
    df = spark.createDataFrame([(0, "t", 1.0, "b"), (0, "t", 0.0, "a"), (0, "u", 0.5, "z")], "video int, track string, score double, label string")
    assert {(r.track, r.score, r.label) for r in rollups.track_summary(df, "video", "track", "score", "label").collect()} == {("t", 0.5, "a"), ("u", 0.5, "z")}


def test_manifests(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"crop_path": "a", "attributes": {"color": "red"}}\n\n{"crop_path": \n{"crop_path": "b", "attributes": null}\n')
    kept = files.read_manifest(spark, str(path), files.ATTRIBUTES, strict=False)
    assert sorted(r.crop_path for r in kept.collect()) == ["a", "b"]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_manifest(spark, str(path), files.ATTRIBUTES).collect()
    rows = spark.createDataFrame([("d", "c", "v", 1), ("d", "e", "v", 2)], "dataset string, camera string, video string, seg_idx int")
    files.write_manifests(rows, str(tmp_path / "out"))
    files.write_manifests(rows.where("camera = 'c'").withColumn("seg_idx", F.lit(7)), str(tmp_path / "out"))
    assert sorted((r.camera, r.seg_idx) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("c", 7), ("e", 2)]


def test_annotation_files(spark, tmp_path):
    told = {"images": [{"id": 1, "file_name": "a.jpg"}, {"id": 2, "file_name": "b.jpg"}], "annotations": [{"id": 5, "image_id": 1, "bbox": [1, 2, 3, 4], "category_id": 1}], "categories": [{"id": k, "name": str(k)} for k in range(5)]}
    path = tmp_path / "coco.json"
    path.write_text(json.dumps(told, indent=1))
    tables = files.read_annotations(spark, str(path))
    assert {r.id: len(r.annotations) for r in files.annotations_by_image(tables).collect()} == {1: 1, 2: 0}
    assert [r.area for r in files.loaded_results(tables["annotations"]).collect()] == [12.0]
    chunks = files.category_chunks(tables["images"].select(F.col("id").alias("image_id")), tables["categories"], 2)
    assert sorted((r.image_id, r.chunk, r.categories) for r in chunks.collect()) == [(i, k, c) for i in (1, 2) for k, c in enumerate([[0, 1], [2, 3], [4]])]


def test_tracking_text(spark, tmp_path):
    (tmp_path / "seq1.txt").write_text("1,7,10,20,3,4,0.5\nbad,7,1,1,1,1,1\n2.0,7,11,20,3,4,0.5\n")
    got = files.read_mot(spark, str(tmp_path / "seq1.txt")).collect()
    assert [(r.sequence, r.frame, r.track, r.w) for r in got] == [("seq1", 1, "7", 3.0), ("seq1", 2, "7", 3.0)]


def test_library_files(spark, tmp_path):
    df = spark.createDataFrame([("obj_1", [str(k) for k in range(60)])], "id string, instances array<string>")
    files.write_library(df, str(tmp_path))
    assert len(spark.read.json(f"{tmp_path}/index").head().instances) == 50
    assert len(spark.read.parquet(f"{tmp_path}/instances").head().instances) == 60


def test_resource_kind(spark):
    df = spark.createDataFrame(pd.DataFrame({"p": ["a/b.JPG", "a/x", "c.mp4", "t.txt"]}))
    assert [r[0] for r in df.select(files.resource_kind(F.col("p"))).collect()] == ["image", "video", "video", None]


def test_track_suppression(spark):
    box = lambda x: (float(x), 0.0, 10.0, 10.0)
    rows = [(0, "a", f, 0.9, *box(0)) for f in range(2)] + [(0, "b", f, 0.5, *box(1)) for f in range(2)] + [(0, "c", f, 0.4, *box(30)) for f in range(2)] + [(0, "c", 2, 0.4, None, None, None, None)]
    df = spark.createDataFrame(rows, "video int, track string, frame int, score double, x1 double, y1 double, w double, h double")
    got = filters.track_suppression(df, "video", "track", "frame", 0.5).collect()
    assert len(got) == len(rows)
    assert {(r.track, r.frame) for r in got if r.x1 is None} == {("b", 0), ("b", 1), ("c", 2)}


def test_zero_boxes(spark):
    df = spark.createDataFrame([(0, None), (1, [0.0] * 4), (2, [1.0, 2.0]), (3, [0.0, 0.0, 1.0, 0.0])], "k int, b array<double>")
    assert [r.k for r in df.where(~filters.zero_box(F.col("b"))).collect()] == [3]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_ranked(spark, n):
    rows = [(k % 37 if k % 11 else None, f"c{k}") for k in range(n)]
    df = spark.createDataFrame(rows, "a int, b string")
    got = sorted((r.place, r.a, r.b) for r in reshape.ranked(df, ["a", "b"], "place", ranges=7).collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(i, *r) for i, r in enumerate(want, 1)]


def test_track_suppression_of_many_videos(spark):
    """Videos of one bucket are suppressed apart, as track by track."""
    rng = np.random.RandomState(5)
    rows = [(v, t, int(f), float(rng.randint(4)), *map(float, rng.randint(0, 6, 2)), *map(float, rng.randint(4, 9, 2))) for v in range(30) for t in range(4) for f in rng.randint(0, 3, 2)]
    df = spark.createDataFrame(rows, "video int, track int, frame int, score double, x1 double, y1 double, w double, h double")
    gone = {(r.video, r.track) for r in filters.track_suppression(df, "video", "track", "frame", 0.4).collect() if r.x1 is None}
    want = set()
    for v in range(30):
        own = {t: [r for r in rows if r[:2] == (v, t)] for t in range(4)}
        kept = []
        for t in sorted(own, key=lambda t: (-np.mean([r[3] for r in own[t]]), t)):
            for k in kept:
                inter = whole = 0.0
                for a, b in itertools.product(own[k], own[t]):
                    if a[2] == b[2]:
                        both = max(min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]), 0) * max(min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5]), 0)
                        inter, whole = inter + both, whole + a[6] * a[7] + b[6] * b[7] - both
                if whole and inter / whole >= 0.4:
                    want.add((v, t))
                    break
            else:
                kept.append(t)
    assert gone == want and want


def test_tables_assigned_at_once():
    from objectlens.operators import suppression

    rng = np.random.RandomState(0)
    for n, m in itertools.product(range(1, 5), range(1, 5)):
        gain = rng.randint(0, 4, (20, n, m)) / 4.0
        at, row, col = suppression.assign_all(gain)
        assert [[(int(r), int(c)) for r, c in zip(row[at == k], col[at == k], strict=True)] for k in range(20)] == [suppression.assign(g) for g in gain]


def test_teta_passes_over_unknown_ids(spark):
    """A similarity of ids that neither side has in the video changes nothing."""
    gt = spark.createDataFrame([(0, f, "g", "a") for f in range(3)], "video int, frame int, gt_id string, cls string")
    det = spark.createDataFrame([(0, f, "d", "a") for f in range(3)], "video int, frame int, det_id string, cls string")
    rows = [(0, f, "g", "d", 0.75) for f in range(3)] + [(0, 0, "x", "d", 0.9), (0, 1, "g", "y", 0.9)]
    sim = spark.createDataFrame(rows, "video int, frame int, gt_id string, det_id string, sim double")
    got = {round(r.alpha, 2): (r.loc_tp, r.loc_fn, r.loc_fp, r.assoc_a, r.cls_tp) for r in metrics.teta(gt, det, sim).collect()}
    assert got[0.5] == (3.0, 0.0, 0.0, 1.0, 3.0) and got[0.8][:3] == (0.0, 3.0, 3.0)
