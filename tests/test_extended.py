"""Run-length strings, remote listings, evaluation by area and F1 totals against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from objectlens.functions import rle
from objectlens.operators import evaluation, metrics, records, suppression
from objectlens.sources import remote

DET = "image_id int, category_id int, det_id string, score double, x1 double, y1 double, w double, h double"


def test_strings_of_runs():
    # hand-worked: 5 bits a group, a sign, the third run on as a difference to the run two before
    assert rle.encode_counts([6, 1, 40, 4, 5, 4, 5, 4, 21]) == "61X13mN000`0"
    rng = np.random.RandomState(0)
    for _ in range(300):
        counts = rng.randint(0, [3, 40, 5000, 10**6][rng.randint(4)], rng.randint(1, 30)).tolist()
        assert rle.decode_counts(rle.encode_counts(counts)) == counts
    assert rle.decode_counts("") == [] and rle.encode_counts([]) == ""


def drawn(counts, h, w):
    return np.repeat(np.arange(len(counts)) % 2 == 1, counts).reshape(w, h).T


def test_polygons():
    for x1, y1, x2, y2 in ((0, 0, 4, 3), (2, 1, 9, 7), (5, 5, 6, 6), (0, 0, 12, 10)):
        mask = drawn(rle.polygon_counts([x1, y1, x2, y1, x2, y2, x1, y2], 10, 12), 10, 12)
        want = np.zeros((10, 12), bool)
        want[y1:y2, x1:x2] = True
        assert (mask == want).all()
    triangle = drawn(rle.polygon_counts([1, 1, 11, 1, 1, 9], 10, 12), 10, 12)
    inside = [(y, x) for y in range(10) for x in range(12) if x > 1.6 and y > 1.6 and (x + 0.5 - 1) / 10 + (y + 0.5 - 1) / 8 < 0.85]
    outside = [(y, x) for y in range(10) for x in range(12) if x < 1 or y < 1 or (x - 1) / 10 + (y - 1) / 8 > 1.15]
    assert all(triangle[p] for p in inside) and not any(triangle[p] for p in outside)


def test_union_of_runs():
    rng = np.random.RandomState(1)
    for _ in range(100):
        masks = [rng.rand(30) < 0.4 for _ in range(rng.randint(1, 4))]
        runs = lambda m: np.diff(np.concatenate([[0], np.flatnonzero(np.diff(np.concatenate([[False], m]))), [len(m)]])).tolist()
        got = rle.union_counts([runs(m) for m in masks])
        assert (np.repeat(np.arange(len(got)) % 2 == 1, got) == np.any(masks, axis=0)).all()


def test_listing_and_fetching(spark):
    names = [f"set{k}" for k in range(120)]
    ask = lambda page, size: (names[(page - 1) * size : page * size], page * size < len(names))
    listed = remote.listed(spark, ask)
    assert [r.id for r in listed.orderBy("place").collect()] == names

    def fetch(name):
        if name.endswith("3"):
            raise OSError(name)
        return "done" if remote.chosen_files([f"{name}/cam_head.mp4", f"{name}/x.txt"], ["*cam_head*"], ["*9/*"]) else "no_match"

    status = {r.id: r.status for r in remote.fetched(listed.where("place < 12"), fetch, listed.where("id = 'set5'").select("id")).collect()}
    assert status == {n: "skipped" if n == "set5" else "failed" if n == "set3" else "no_match" if n == "set9" else "done" for n in names[:12]}


def plain_matches(det, gt, low, high, threshold, most):
    """Hits and ignored of one image and category, one by one."""
    iou = lambda d, g: suppression.iou_matrix(np.array([[d[4], d[5], d[4] + d[6], d[5] + d[7]]]), np.array([[g[4], g[5], g[4] + g[6], g[5] + g[7]]]))[0, 0]
    skip = [not low <= g[6] * g[7] <= high for g in gt]
    order, taken, out = sorted(range(len(gt)), key=lambda k: skip[k]), set(), {}
    for d in sorted(det, key=lambda d: (-d[3], d[2]))[:most]:
        best, need = None, min(threshold, 1 - 1e-10)
        for k in order:
            if k in taken:
                continue
            if best is not None and not skip[best] and skip[k]:
                break
            if iou(d, gt[k]) < need:
                continue
            best, need = k, iou(d, gt[k])
        if best is not None:
            taken.add(best)
        out[d[2]] = (best is not None and not skip[best], skip[best] if best is not None else not low <= d[6] * d[7] <= high)
    return out


def test_matching_by_area(spark):
    rng = np.random.RandomState(4)
    areas = {"all": (0, 1e10), "small": (0, 90), "large": (90, 1e10)}
    det, gt = [], []
    for image, category in itertools.product(range(12), range(2)):
        for rows, n, name in ((gt, rng.randint(0, 5), "g"), (det, rng.randint(0, 7), "d")):
            for k in range(n):
                x, y = rng.randint(0, 8, 2)
                w, h = rng.randint(6, 14, 2)
                rows.append((image, category, f"{name}{image}-{category}-{k}", float(rng.randint(0, 50)), float(x), float(y), float(w), float(h)))
    frames = [spark.createDataFrame(r, DET.replace("det_id", i)).repartition(3) for r, i in ((det, "det_id"), (gt, "gt_id"))]
    got = evaluation.matched_by_area(*frames, areas, most=5).collect()
    cells = {(r.area, r.threshold, r.det_id): (r.hit, r.ignored) for r in got}
    want = {}
    for image, category in itertools.product(range(12), range(2)):
        own = [[r for r in rows if r[:2] == (image, category)] for rows in (det, gt)]
        for (area, (low, high)), t in itertools.product(areas.items(), metrics.THRESHOLDS):
            want |= {(area, t, d): v for d, v in plain_matches(*own, low, high, t / 100, 5).items()}
    assert cells == want
    # precision and recall of one cell by hand
    n_gt = evaluation.positives(frames[1], areas)
    rows = {(r.category_id, r.area, r.threshold): (r.ap, r.ar) for r in evaluation.precision_by_area(evaluation.matched_by_area(*frames, areas), n_gt).collect()}
    n = {(r.category_id, r.area): r.n_gt for r in n_gt.collect()}
    for (category, area, t), (ap, ar) in rows.items():
        ranked = [cells_ for cells_ in sorted((( -d[3], d[0], d[2]) for d in det if d[1] == category))]
        flat, low_high = [], areas[area]
        for _, image, name in ranked:
            own = [[r for r in side if r[:2] == (image, category)] for side in (det, gt)]
            hit, ignored = plain_matches(*own, *low_high, t / 100, 100)[name]
            if not ignored:
                flat.append(hit)
        tp = np.cumsum(flat) if flat else np.zeros(0)
        precision, recall = tp / np.arange(1, len(tp) + 1), tp / n[category, area]
        points = [max([p for p, r in zip(precision, recall, strict=True) if r >= x / 100 - 1e-9], default=0) for x in range(101)]
        assert ap == pytest.approx(np.mean(points)) and ar == pytest.approx(recall.max(initial=0))


def test_f1_totals_by_brute_force(spark):
    """Assignment by trying all permutations; cgF1 is the product of its two factors."""
    rng = np.random.RandomState(9)
    det, gt = [], []
    for image in range(25):
        for rows, name in ((gt, "g"), (det, "d")):
            for k in range(rng.randint(0, 4)):
                x, y, w, h = (rng.rand(4) * [6, 6, 4, 4] + [0, 0, 6, 6]).tolist()
                rows.append((image, 0, f"{name}{image}-{k}", float(rng.rand()), x, y, w, h))
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(gt, DET.replace("det_id", "gt_id"))
    images = spark.range(25).selectExpr("CAST(id AS INT) AS image_id")
    rows = metrics.f1_rows(images, g, d, suppression.matched(d, g, "image_id"), "image_id")
    box = lambda r: np.array([[r[4], r[5], r[4] + r[6], r[5] + r[7]]])
    want = {t: [0, 0, 0, 0, []] for t in metrics.THRESHOLDS}
    for image in range(25):
        a, b = [[r for r in s if r[0] == image] for s in (det, gt)]
        over = np.array([[suppression.iou_matrix(box(x), box(y))[0, 0] for y in b] for x in a]).reshape(len(a), len(b))
        small = over if len(a) <= len(b) else over.T
        best = max(itertools.permutations(range(small.shape[1]), small.shape[0]), key=lambda p: sum(small[i, j] for i, j in enumerate(p)), default=())
        ious = [small[i, j] for i, j in enumerate(best)]
        for t, w in want.items():
            if not a and not b:
                continue
            tp = sum(x * 100 + 1e-9 >= t for x in ious)
            w[0] += tp
            w[1] += len(a) - tp
            w[2] += len(b) - tp
            if a and b:
                w[3] += len(a) - tp
                p, r = tp / (len(a) + 1e-4), tp / (len(b) + 1e-4)
                w[4].append(2 * p * r / (p + r + 1e-4))
    for r in metrics.f1_totals(rows).collect():
        tp, fp, fn, pm_fp, local = want[r.threshold]
        assert (r.tp, r.fp, r.fn, r.pm_fp) == (tp, fp, fn, pm_fp) and r.positive_macro_f1 == pytest.approx(np.mean(local))
        p, q = tp / (tp + pm_fp + 1e-4), tp / (tp + fn + 1e-4)
        assert r.positive_micro_f1 == pytest.approx(2 * p * q / (p + q + 1e-4))


def test_golden_product():
    """The committed result's cgF1 at 0.5 is its positive micro F1 times its image-level coefficient."""
    assert 0.490517 * 0.654654 == pytest.approx(0.321119, abs=1e-6)


def test_strict_records(spark):
    entries = spark.createDataFrame([(1, "a")], "id int, name string")
    assert records.detail(entries, "id", 1).collect() == [(1, "a")]
    with pytest.raises(Exception, match="no entry 2"):
        records.detail(entries, "id", 2).collect()
    frames = spark.createDataFrame([(1, 0), (1, 1)], "video int, frame int")
    images = spark.createDataFrame([(1, 0, 70)], "video int, frame int, image_id int")
    assert [r.image_id for r in records.image_ids(frames, images, ["video", "frame"], strict=False).collect()] == [70]
    with pytest.raises(Exception, match="no image for 1, 1"):
        records.image_ids(frames, images, ["video", "frame"]).collect()
    tracks = spark.createDataFrame([(1, [[1, 1, 2, 3], [0, 0, 0, 0], None, [1, 2, 3, 4]], None), (2, [[1, 1, 2, 3]], [9.5])], "video_id int, boxes array<array<int>>, areas array<double>")
    found = spark.createDataFrame([(1, 0, 5), (1, 3, 6)], "video_id int, frame int, image_id int")
    got = records.prediction_frames(tracks, found, []).collect()
    assert sorted((r.video_id, r.frame, r.image_id, r.area) for r in got if r.image_id) == [(1, 0, 5, 6.0), (1, 3, 6, 12.0)]
    assert [(r.frame, r.area) for r in got if r.video_id == 2] == [(0, 9.5)]
    with pytest.raises(Exception, match="no image for video 2, frame 0"):
        records.prediction_frames(tracks, found, [], strict=True).collect()
    assert records.first_n(spark.range(5), 0, "id").count() == 5 and records.first_n(spark.range(5), 2, F.desc("id")).collect()[0].id == 4


def test_sinks(spark, tmp_path):
    from objectlens.sources import files

    log = f"{tmp_path}/log"
    for k in (1, 2):
        files.append_log(spark.createDataFrame([(k,)], "k int"), log)
    assert sorted(r.k for r in spark.read.json(log).collect()) == [1, 2]
    schema = "id string, canonical_path string"
    assert files.read_library(spark, f"{tmp_path}/none", schema).count() == 0
    new, old = spark.createDataFrame([("a", "n"), ("b", "n")], schema), spark.createDataFrame([("a", "o")], schema)
    assert dict(files.keep_canonical(new, old).collect()) == {"a": "o", "b": "n"}
    tables = {"images": spark.createDataFrame([(0,), (1,)], "id int"), "annotations": spark.createDataFrame([(5, 0, 3), (6, 1, 3)], "id int, image_id int, category_id int"), "categories": spark.createDataFrame([(3, "x")], "id int, name string")}
    moved = files.reindexed(tables)
    assert sorted(moved["images"].collect()) == [(1,), (2,)] and sorted((r.id, r.image_id, r.category_id) for r in moved["annotations"].collect()) == [(5, 1, 3), (6, 2, 3)]
    files.write_annotations(tables, tables["images"].where("id = 1"), f"{tmp_path}/own")
    assert [r.id for r in spark.read.json(f"{tmp_path}/own/annotations").collect()] == [6]
    for name in ("f_10", "f_2", "x"):
        (tmp_path / "frames").mkdir(exist_ok=True)
        (tmp_path / "frames" / f"{name}.jpg").write_bytes(name.encode())
    assert [bytes(r.content).decode() for r in files.image_frames(spark, str(tmp_path / "frames")).orderBy("frame").collect()] == ["f_2", "f_10", "x"]
    assert files.dummy_frames(spark, 3).count() == 3
    cards = spark.createDataFrame([(2, "<p>b</p>"), (1, "<p>a</p>")], "label int, card string")
    page = files.html_page(cards, spark.createDataFrame([("color", "red", 2)], "facet string, value string, n bigint"), "Objects").head().page
    assert "<p>a</p><p>b</p>" in page and "<li>color: red (2)</li>" in page


def test_plug_ins(spark):
    gt = spark.createDataFrame([("v", f, "a") for f in range(4)], "video string, frame int, gt_id string")
    det = spark.createDataFrame([("v", f, "x") for f in range(4)], "video string, frame int, det_id string")
    sim = gt.join(det, ["video", "frame"]).withColumn("sim", F.lit(0.8))
    out = evaluation.evaluated("hota", lambda: (gt, det, sim))
    assert {r.alpha: (r.tp, r.hota) for r in out.collect()}[0.5] == (4, 1.0)
    counted = evaluation.run_all({"rows": lambda a, b: a.agg(F.count("*")), "both": lambda a, b: a.join(b, ["video", "frame"])}, gt, det)
    assert counted["both"].count() == 4 and counted["rows"].head()[0] == 4


def test_matching_deals_both_sides(spark):
    """Sides dealt by the keys already are dealt again as one; their partitions may be merged differently."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id", "category_id")
    rows = [(k % 7, k % 3, f"d{k}", 1.0, 0.0, 0.0, 10.0, 10.0) for k in range(30)]
    det = spark.createDataFrame(rows, DET).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n > 0")
    got = evaluation.matched_by_area(det, det.withColumnRenamed("det_id", "gt_id"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan[: plan.index("Union")]
    assert got.where("area = 'all' AND threshold = 95 AND hit").count() == 30


def test_precision_without_rows_of_thresholds(spark):
    """Precision from masks is that of the rows, for ties and for predictions without a score too."""
    rng = np.random.RandomState(9)
    rows = [(int(rng.randint(9)), int(rng.randint(2)), f"d{k}", float(rng.randint(6)) if k % 9 else None, float(rng.randint(8)), 0.0, float(rng.randint(6, 14)), 10.0) for k in range(150)]
    det, areas = spark.createDataFrame(rows, DET), {"all": (0, 1e10), "small": (0, 90)}
    gt = det.where("CAST(substr(det_id, 2) AS INT) % 3 = 0").withColumn("x1", F.col("x1") + 1).withColumnRenamed("det_id", "gt_id")
    n_gt = evaluation.positives(gt, areas)
    told = lambda df: sorted((r.category_id, r.area, r.threshold, round(r.ap, 9), r.ar) for r in df.collect())
    got = told(evaluation.precision_of_masks(evaluation.match_masks(det, gt, areas), n_gt, areas))
    assert got == told(evaluation.precision_by_area(evaluation.matched_by_area(det, gt, areas), n_gt))
    assert len(got) == 40 and 0 < sum(r[3] for r in got)
