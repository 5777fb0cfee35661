"""Properties of the sequential operators, and batch against stream."""

import itertools
import time

import numpy as np
import pytest

from objectlens.operators import reshape
from objectlens.operators.suppression import assign, greedy, iou_matrix
from objectlens.streaming import tracks


def test_assignment_is_optimal():
    rng = np.random.RandomState(0)
    for n, m in itertools.product(range(1, 6), repeat=2):
        gain = rng.rand(n, m)
        pairs = assign(gain)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        small = gain if n <= m else gain.T
        best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert sum(gain[i, j] for i, j in pairs) == pytest.approx(best)


def test_suppression_is_idempotent():
    box = np.random.RandomState(1).randint(0, 30, (40, 4)).astype(float)
    box[:, 2:] += box[:, :2] + 5
    kept = box[greedy(iou_matrix(box, box), 0.3, False)]
    assert greedy(iou_matrix(kept, kept), 0.3, False).all()


def test_rle(spark):
    from pyspark.sql import functions as F

    a, b = F.array(*map(F.lit, (2, 3, 4, 1))), F.array(*map(F.lit, (0, 4, 6)))
    row = spark.range(1).select(reshape.rle_area(a).alias("a"), reshape.rle_intersection(reshape.rle_spans(a), reshape.rle_spans(b)).alias("i")).head()
    assert (row.a, row.i) == (4, 2)


RULES = tracks.Rules(init=1, delay=4, unmatched=2, duplicates=2, confirm=2, only_within=False)


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.RandomState(3)
    rows = [(f"s{k % 3}", k // 3, f"t{rng.randint(3)}", float(k)) for k in range(60)]
    schema = "session string, frame bigint, track string, score double"
    want = sorted(map(tuple, tracks.batch(spark.createDataFrame(rows, schema), RULES).collect()))
    assert want
    for part in range(3):
        own = [r for r in rows if r[1] // 7 == part] + ([(f"s{k}", -1, None, None) for k in range(3)] if part == 2 else [])
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = tracks.stream(source, RULES).writeStream.format("memory").queryName("emitted").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("emitted").collect())) == want


def test_session_expires(spark, tmp_path):
    """A session that falls silent gives what its buffer holds."""
    schema = "session string, frame bigint, track string, score double"
    spark.createDataFrame([("a", 0, "t", 1.0), ("a", 1, "t", 2.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = tracks.stream(source, RULES, expiry_ms=500).writeStream.format("memory").queryName("expired").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            if spark.table("expired").count() == 2:
                break
            time.sleep(0.5)
        assert sorted(r.frame for r in spark.table("expired").collect()) == [0, 1]
    finally:
        query.stop()


def told(rules, frames):
    """(frame, track) to (confirmed, hidden), and the session after the frames."""
    own = tracks.Session(rules)
    rows = [r for f, seen in enumerate(frames) for r in own.step(f, seen)]
    return {(f, t): (sure, hidden) for f, t, _, sure, hidden, _ in [*rows, *own.flush()]}, own


def test_session_rules():
    hit = lambda t, det=None: (t, 1.0, det or t, False, False)
    # a new track has its start value, and gains only from the next match on
    assert told(tracks.Rules(init=3), [[hit("a")]])[1].alive == {"a": 3}
    assert told(tracks.Rules(init=3, most=4), [[hit("a")]] * 5)[1].alive == {"a": 4}
    # matched and yet unmatched: one up, one down, and the frame counts
    both = told(tracks.Rules(init=3), [[hit("a")], [("a", 1.0, "d", True, False)]])[1]
    assert (both.alive["a"], both.missed["a"]) == (3, 1)
    # an empty track isn't unmatched, and loses only where that is asked for
    gap = [[hit("a")], [("a", 1.0, None, False, True)]]
    assert told(tracks.Rules(init=3), gap)[1].alive == {"a": 3} and told(tracks.Rules(init=3, empty_costs=True), gap)[1].alive == {"a": 2}
    # removal only within the first frames
    early, late = [[hit("a"), hit("b")], [hit("b")], [hit("b")], [hit("a"), hit("b")]], [[hit("a"), hit("b")]] * 4 + [[hit("b")]] * 3
    rules = tracks.Rules(delay=4, unmatched=2, duplicates=2, init=1, only_within=False)
    assert {t for _, t in told(rules, early)[0]} == {"b"}
    assert {t for _, t in told(rules, late)[0]} == {"a", "b"}
    # hidden: at or below 0 after an unmatched frame; never where the rules end with the first frames
    back = [[hit("a")]] * 2 + [[], [], [], [("a", 1.0, None, True, False)]]
    assert told(tracks.Rules(only_within=False, unmatched=9), back)[0][5, "a"] == (False, True)
    assert told(tracks.Rules(unmatched=9), back)[0][5, "a"] == (False, False)
    # of two tracks of one detection the later goes, if it is young enough when the count is full
    pair = [[hit("a")], [hit("a"), hit("b")], [hit("a", "d"), hit("b", "d")], [hit("a", "d"), hit("b", "d")], [hit("a")]]
    assert {t for _, t in told(rules, pair)[0]} == {"a"}
    old = [*pair[:2], *[[hit("a"), hit("b")]] * 4, *pair[2:4]]
    assert {t for _, t in told(rules, old)[0]} == {"a", "b"}


def test_turns(spark):
    """Pruning: marks in the first two turns don't count, and without a later one only these stay."""
    from pyspark.sql import functions as F

    from objectlens.functions import text

    call = "<tool> segment_phrase"
    said = {1: ["u", "u", call, "x", call, "y"], 2: ["u", call, "x"], 3: ["u"], 4: ["u", "u", "<tool> zoom", "segment_phrase"]}
    rows = [(c, 10 * k, "assistant" if "t" in s or "x" in s else "user", s) for c, texts in said.items() for k, s in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    kept = text.prune_messages(turns, text.segment_call(F.col("role"), F.col("text"))).collect()
    assert sorted((r.conv_id, r.turn) for r in kept) == [(1, 0), (1, 10), (1, 40), (1, 50), (2, 0), (2, 10), (3, 0), (4, 0), (4, 10)]
    with pytest.raises(Exception, match="neither Accept nor Reject"):
        turns.select(text.verdict(F.col("text"), strict=True)).collect()


def test_session_commands():
    row = lambda t, c=None: (t, 1.0, t, False, False, c)
    own = tracks.Session(tracks.Rules(delay=2))
    out = [r for f, rows in enumerate([[row("a"), row("b")], [row("a", "remove"), row("b")], [row("b")], [row(None, "cancel"), row("b")], [row("b")], [row("b")]]) for r in own.take(f, rows)]
    assert [(f, t) for f, t, *_ in [*out, *own.flush()]] == [(0, "b"), (3, "b"), (4, "b"), (5, "b")]
    assert not list(own.take(6, [row(None, "reset")])) and own.first == {} and own.last == -1


def test_rounding_at_ties(spark):
    """41 / 640 is 0.0640625: DuckDB rounds the scaled double down where decimal digits would go up."""
    import duckdb
    from pyspark.sql import functions as F

    from objectlens.plans.registry import rounded

    pairs = [(41, 640), (323, 640), (333, 640), (1, 3200), (-41, 640), (2, 3)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double")
    got = [r[0] for r in df.select(rounded(F.col("a") / F.col("b"))).collect()]
    assert got == [duckdb.sql(f"SELECT round({a} * 1.0e0 / {b}, 6)").fetchall()[0][0] for a, b in pairs]
