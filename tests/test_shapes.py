"""Mask shapes, samples and further track rules against brute force and hand-worked cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from objectlens.functions import masks, shapes
from objectlens.operators import metrics, selection
from objectlens.streaming import rules


def pictures(n=40):
    rng = np.random.RandomState(5)
    for _ in range(n):
        yield rng.rand(rng.randint(1, 9), rng.randint(1, 9)) < rng.rand()


def test_spans_round_trip():
    for m in pictures():
        assert (shapes.drawn(shapes.spans_of(m), *m.shape) == m).all()
    assert not shapes.drawn(None, 3, 4).any()
    assert shapes.drawn([{"start": 2, "end": 99}], 2, 2).sum() == 2


def test_dilation_and_distance():
    for m in pictures():
        h, w = m.shape
        pixels = list(itertools.product(range(h), range(w)))
        wide, far = shapes.dilated_by(m, 3), shapes.squared_distance(m)
        off = [p for p in pixels if not m[p]]
        for y, x in pixels:
            assert wide[y, x] == any(m[b, a] and abs(b - y) <= 1 and abs(a - x) <= 1 for b, a in pixels)
            want = min(((b - y) ** 2 + (a - x) ** 2 for b, a in off), default=-1)
            assert far[y, x] == want
    with pytest.raises(ValueError):
        shapes.dilated_by(np.zeros((2, 2), bool), 2)


def test_mixed_sizes_and_nulls(spark):
    own = list(pictures(12))
    rows = [(k, [(s["start"], s["end"]) for s in shapes.spans_of(m)], *m.shape) for k, m in enumerate(own)] + [(50, None, 3, 3), (51, [(0, 2)], None, 3), (52, [], 0, 0)]
    df = spark.createDataFrame(rows, "k int, spans array<struct<start:long,end:long>>, h int, w int").repartition(2)
    size = F.col("spans"), F.col("h"), F.col("w")
    got = {r.k: r for r in df.select("k", shapes.boundary(*size).alias("b"), shapes.depth(*size).alias("d"), shapes.centres(*size, 2).alias("c"), shapes.without_small_parts(*size, 3).alias("s")).collect()}
    for k, m in enumerate(own):
        plain = lambda spans: [(s["start"], s["end"]) for s in spans]
        assert plain(got[k].b) == plain(shapes.spans_of(shapes.boundary_of(m))) and plain(got[k].s) == plain(shapes.spans_of(shapes.smoothed(m[None], 3)[0]))
        assert got[k].d == max(shapes.squared_distance(m).max(), 0) and len(got[k].c) == min(2, m.sum())
    assert all((got[k].b, got[k].d, got[k].c, got[k].s) == ([], 0, [], []) for k in (50, 51, 52))


def flood(m):
    """Sizes of 8-connected pieces, by pixel."""
    size = np.zeros(m.shape, int)
    for y, x in zip(*np.nonzero(m), strict=True):
        if not size[y, x]:
            piece, todo = {(y, x)}, [(y, x)]
            while todo:
                b, a = todo.pop()
                for p in itertools.product((b - 1, b, b + 1), (a - 1, a, a + 1)):
                    if 0 <= p[0] < m.shape[0] and 0 <= p[1] < m.shape[1] and m[p] and p not in piece:
                        piece.add(p)
                        todo.append(p)
            for p in piece:
                size[p] = len(piece)
    return size


def test_smoothing():
    for m in pictures():
        filled = m | ((flood(~m) <= 3) & ~m)
        want = filled & ~(filled & (flood(filled) <= min(3, filled.sum() // 2)))
        assert (shapes.smoothed(m[None], 3)[0] == want).all()
        assert (shapes.smoothed(m[None], 0)[0] == m).all()


def test_component_sizes_by_flood(spark):
    own = list(pictures(60))
    rows = [(k, [(s["start"], s["end"]) for s in shapes.spans_of(m)], m.shape[0]) for k, m in enumerate(own)] + [(90, None, 3), (91, [(0, 2)], None), (92, [], 4)]
    df = spark.createDataFrame(rows, "k int, spans array<struct<start:long,end:long>>, h int").repartition(3)
    for r in df.select("k", masks.grid_components("spans", "h").alias("p")).collect():
        if r.k >= 90:
            assert r.p == []
            continue
        size, seen = flood(own[r.k]).T.ravel(), 0
        for p in r.p:
            assert (size[p["start"] : p["end"]] == p["size"]).all() and p["start"] // own[r.k].shape[0] == (p["end"] - 1) // own[r.k].shape[0]
            seen += p["end"] - p["start"]
        assert seen == own[r.k].sum()


def test_centres():
    m = np.zeros((7, 9), bool)
    m[1:6, 2:7] = True
    assert shapes.centre_points(m[None], 1) == [[{"x": 4, "y": 3}]]
    assert shapes.centre_points(np.ones((1, 3, 3), bool), 1) == [[{"x": 1, "y": 1}]]
    assert len(shapes.centre_points(np.eye(2, dtype=bool)[None], 5)[0]) == 2
    assert shapes.centre_points(np.zeros((1, 2, 2), bool), 3) == [[]]


def test_points_lie_in_mask(spark):
    spans = F.array(*[F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end")) for a, b in ((3, 5), (9, 12))])
    rows = spark.range(7).select("id", shapes.mask_point(spans, F.col("id")).alias("at"), shapes.seeded(F.col("id").cast("string"), 1, F.lit(4)).alias("draw"), *[c.alias(n) for c, n in zip(shapes.box_point(F.col("id").cast("string"), 0, *map(F.lit, (1.5, 2.0, 4.5, 3.0))), "xy", strict=True)]).orderBy("id").collect()
    assert [r.at for r in rows] == [3, 4, 9, 10, 11, None, None]
    assert all(0 <= r.draw < 4 and 2 <= r.x < 5 and r.y == 2 for r in rows)


def test_f_measure(spark):
    cases = [(0, 0, 0, 0, 1.0), (0, 4, 0, 0, 0.0), (4, 0, 0, 0, 0.0), (4, 4, 0, 0, 0.0), (4, 2, 2, 2, 2 / 3)]
    got = spark.createDataFrame([c[:4] for c in cases], "a long, b long, c long, d long").select("a", "b", "c", shapes.f_measure(*map(F.col, "abcd")).alias("f")).collect()
    want = {c[:3]: c[4] for c in cases}
    assert all(r.f == pytest.approx(want[r.a, r.b, r.c]) for r in got)


def test_stage_sample(spark):
    rows = spark.createDataFrame([("a", k) for k in range(10)] + [("b", k) for k in (4, 9, 11)] + [("c", 1), ("c", 2), ("d", None)], "g string, s long")
    for seed in range(4):
        kept = {}
        for r in selection.stage_sample(rows, "g", "s", 3, 3, seed).collect():
            kept.setdefault(r.g, []).append(r.s)
        assert sorted(kept) == ["a", "b"] and sorted(kept["b"]) == [4, 9, 11]
        a = sorted(kept["a"])
        assert [y - x for x, y in itertools.pairwise(a)] == [3, 3]


def test_owned_pixels(spark):
    rng, rows, want = np.random.RandomState(2), [], {}
    for g in range(6):
        owner = {}
        for i in range(4):
            cuts = sorted(rng.choice(30, 4, replace=False).tolist())
            spans, score = [(cuts[0], cuts[1]), (cuts[2], cuts[3])], int(rng.randint(3))
            rows.append((g, i, score, spans))
            want[g, i] = 0
            for a, b in spans:
                for p in range(a, b):
                    owner[p] = min(owner.get(p, (9, 9)), (-score, i))
        for _, i in owner.values():
            want[g, i] += 1
    df = spark.createDataFrame(rows, "g long, i long, score long, spans array<struct<start:long,end:long>>")
    assert {(r.g, r.i): r.area for r in selection.owned_pixels(df, "g", "i", "score", "spans").collect()} == want
    assert selection.owned_pixels(df.where("g < 0"), "g", "i", "score", "spans").count() == 0


def test_class_split_and_lists(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "c int")
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "c int")
    assert {r.c: r.split for r in selection.class_split(rows, "c", ids(1, 2), ids(2, 3, 3)).collect()} == {1: "known", 2: "known", 3: "distractor", None: None}
    lists = spark.createDataFrame([(["abcdef", "a", "abcde"], [0.1, 0.9, 0.5]), ([], [])], "m array<string>, s array<double>")
    got = lists.select(selection.long_masks(F.col("s"), F.col("m"), F.col("s"))["mask"].alias("m")).collect()
    assert [r.m for r in got] == [["abcde", "abcdef"], []]


COUNTED = "session string, frame long, track string, det string, unmatched boolean, empty boolean"


def test_batched_counters(spark):
    rows = [("s", f, t, "d0", None, None) for f in range(3) for t in "ab" if f or t == "a"]  # b comes later and shares d0
    rows += [("s", 3, "c", None, None, True), ("s", 4, "c", "d1", True, False), (None, 0, "x", None, None, None), ("s", 5, None, None, None, None)]
    got = {(r.session, r.frame, r.track): r for r in rules.batched_counters(spark.createDataFrame(rows, COUNTED), True).collect()}
    assert got["s", 0, "a"].alive == 4 and got["s", 2, "a"].alive == 6 and got["s", 2, "a"].missed == 0
    assert not got["s", 1, "b"].removed and got["s", 2, "b"].removed and not got["s", 4, "a"].removed
    assert (got["s", 3, "c"].alive, got["s", 4, "c"].alive, got["s", 4, "c"].missed) == (1, 2, 2)  # 3 - 2, then + 1; too low an overlap counts as missed
    same = [("s", f, t, "d0", None, None) for f in range(4) for t in "ab"]  # seen first in one frame: neither removes the other
    assert not any(r.removed for r in rules.batched_counters(spark.createDataFrame(same, COUNTED)).collect())
    assert rules.batched_counters(spark.createDataFrame([], COUNTED)).count() == 0


def test_recent_occlusion(spark):
    schema = "session string, frame long, track string, x1 double, y1 double, x2 double, y2 double, removed boolean"
    box, out = (0.0, 0.0, 10.0, 10.0), (None,) * 4
    seen = {0: {"a": out, "b": box}, 1: {"a": box, "b": out}, 2: {"a": box, "b": box}, 3: {"a": box, "b": (50.0, 50.0, 60.0, 60.0)}}
    rows = [("s", f, t, *b, False) for f, own in seen.items() for t, b in own.items()]
    got = {(r.frame, r.track): r for r in rules.recently_occluded(spark.createDataFrame(rows, schema)).collect()}
    assert got[2, "b"].hidden and not got[2, "a"].hidden and got[2, "b"].last_occluded == 2
    assert not got[3, "b"].hidden and got[3, "a"].last_occluded == 0
    never = [("s", 0, t, *box, None) for t in "ab"]  # without a past neither hides
    assert not any(r.hidden for r in rules.recently_occluded(spark.createDataFrame(never, schema)).collect())
    gone = [("s", 0, "a", *out, False), ("s", 1, "a", *box, False), ("s", 1, "b", *box, True)]
    assert {r.track: r.hidden for r in rules.recently_occluded(spark.createDataFrame(gone, schema)).collect() if r.frame == 1} == {"a": False, "b": True}


def test_extended_f1(spark):
    # (image, n_gt, n_dt, tp): perfect, half found, missed, false alarm
    cases = [(1, 2, 2, 2), (2, 2, 1, 1), (3, 1, 0, 0), (4, 0, 3, 0)]
    rows = spark.createDataFrame([(i, 0.5, g, d, tp, d - tp, g - tp) for i, g, d, tp in cases], "image int, threshold double, n_gt long, n_dt long, tp long, fp long, fn long")
    counts = spark.createDataFrame([(2, 1, 1, 1)], "il_tp long, il_fp long, il_fn long, il_tn long")
    got = metrics.f1_extended(rows, counts).head()
    mcc = (2 * 1 - 1 * 1) / (3 * 3 * 2 * 2) ** 0.5
    local = [1.0, 2 / 3]
    assert got.positive_macro_f1 == pytest.approx(sum(local) / 2, abs=1e-3) and got.positive_w0dt_macro_f1 == pytest.approx(sum(local) / 3, abs=1e-3)
    assert (got.il_perfect_pos, got.il_perfect_neg) == (pytest.approx(1 / 3), pytest.approx(1 / 2))
    assert got.cgf1_w0dt == pytest.approx(got.positive_w0dt_macro_f1 * mcc, abs=1e-3)
    assert metrics.f1_extended(rows.where("false"), counts).count() == 0
