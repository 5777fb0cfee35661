"""Operators of the llm subpackage against brute force, round trips and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from objectlens.llm import bpe, cnn, lm, minhash, planes, queries, rules, shards, suffixes, urls

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "a", " \t\n", "it's 'sting he'll !!'s 1234 x<|endoftext|>y", "İSTANBUL ΣΑΣ é a\x00b", "x" * 300, "日本語 😀😀 ①②", "word " * 40, "word " * 40, "a\nb\na\na", "The Same line\n" * 3]
SPACES = "[^\x20\x09-\x0d]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with a null id, a repeated id and columns whose names clash with results."""
    ids = [*range(len(ODD) - 2), None, 3]
    return spark.createDataFrame([(i, t, "x", 5) for i, t in zip(ids, ODD, strict=True)], "doc_id bigint, text string, score string, n_words int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_bpe_matches_library(odd, texts):
    from tokenizers import Tokenizer

    ref, own = Tokenizer.from_file(PATH), bpe.load(PATH)
    for t in [*ODD, *texts.values()]:
        want = ref.encode(t or "", add_special_tokens=False).ids
        got = own.encode([t])[0].tolist()
        assert got == want
        assert own.decode(got) == ref.decode(want, skip_special_tokens=False)
    rows = bpe.bpe_encode(odd, PATH).collect()
    assert len(rows) == len(ODD) and all(r.ids == ref.encode(r.text or "", add_special_tokens=False).ids for r in rows)


def test_token_files(spark, docs, texts, tmp_path):
    found = planes.token_files(docs, PATH, f"file://{tmp_path}", block=1000, shard_text_bytes=100_000)
    start = 0
    for r in sorted(found.collect()):
        ids = [*bpe.load(PATH).encode([texts[r.doc_id]])[0].tolist(), 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for kind in ("bit", "byte"):
        ids = np.random.RandomState(0).randint(0, 49408, 777).astype(np.uint32)
        assert (planes.from_planes(planes.to_planes(ids, kind), 777, kind) == ids).all()
    assert planes.token_files(docs.limit(0), PATH, f"file://{tmp_path}/none").count() == 0


def assert_longest(words, matches, items, pattern):
    """Each match is there, and no item has a longer one at its first word."""
    split = {str(i): re.findall(pattern, lower(t)) for i, t in items}
    for m in matches:
        own, item = words[m.word_start :], split[m.item_id]
        assert item[m.item_word : m.item_word + m.n_words] == own[: m.n_words]
        if m.n_words >= 10:
            top = max(next((k for k, (a, b) in enumerate(zip(own, w[j:], strict=False)) if a != b), min(len(own), len(w) - j)) for w in split.values() for j in range(len(w)))
            assert m.n_words == top


def test_token_files_odd_rows(spark, odd, tmp_path):
    """Null and repeated ids, among them one id with most of the rows, which several shards share."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text, "s") for r in odd.collect()] + [(7, f"text {k} " * 20, "s") for k in range(300)] + [(7, "same", "s")] * 40
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    manifest = planes.write_token_files(frame, PATH, f"file://{tmp_path}", block=500, shard_text_bytes=9_000)
    assert sum(m["docs"] for m in manifest) == len(rows) and max(m["docs"] for m in manifest) < 250
    got = planes.read_token_files(spark, manifest).collect()
    want = Counter((i, (ids := [*tok.encode(t or "", add_special_tokens=False).ids, 1]) and len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *[r.n_tokens for r in order[:-1]]]).tolist()
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_decontamination_of_repetitions():
    """One word over and over on both sides: one match a text, however many pairs of places there are."""
    side = suffixes.Suffixes([(str(k), "a " * 200) for k in range(10)] + [("s", "a a a"), ("t", "b " * 30 + "a " * 12)])
    data, off = lm.tx.buffers(lm.pa.array(["a " * 5000, "c " + "b " * 12 + "c", "b " * 3 + "a " * 11]))
    h, _, _, counts = lm.tx.words(data, off, lm.tx.ALNUM_LOWER)
    places, which, ids = side.found(h, counts)
    assert len(places) < 3 * len(h)
    first, size, item, at = side.longest(places, which, ids, counts)
    whole = sorted((f, z) for f, z in zip(first.tolist(), size.tolist(), strict=True) if z >= 10)
    assert (4990, 10) not in whole and (0, 200) in whole and (4800, 200) in whole
    assert (5001, 12) in whole and (5014, 14) in whole


def test_decontamination(spark, docs, texts, odd):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "short item"), (901, None), (902, "x")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    wins = {}
    for i, t in items:
        w = re.findall(pattern, lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for block_words in (10**6, 500):
        got = {r.doc_id: r for r in suffixes.decontaminate(docs, bench, block_words=block_words).collect()}
        for i, t in texts.items():
            w = re.findall(pattern, lower(t))
            hit, names = set(), set()
            for n in {len(x) for x in wins}:
                for k in range(len(w) - n + 1):
                    if own := wins.get(tuple(w[k : k + n])):
                        hit |= set(range(k, k + n))
                        names |= own
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert {p for m in r.matches for p in range(m.word_start, m.word_start + m.n_words)} == hit
            if block_words == 10**6:
                assert_longest(w, r.matches, items, pattern)
    nulls = suffixes.decontaminate(odd, spark.createDataFrame([(None, "it's 'sting he'll"), (None, "x")], "item_id bigint, text string")).where("contaminated").collect()
    assert {r.n_items for r in nulls} == {1} and len(nulls) == 1 and suffixes.decontaminate(odd.limit(0), bench).count() == 0
    assert suffixes.decontaminate(odd, bench.limit(0)).where("contaminated").count() == 0


def test_rule_counts(spark, odd, texts, docs):
    every = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    for r in rules.text_counts(every, ["doc_id", "text"]).collect():
        t = r.text or ""
        w = re.findall(SPACES, t)
        lines = [x for x in t.split("\n") if re.search(SPACES, x)]
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))


def test_binomial_bound():
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.02), (7, 400, 0.01)):
        assert rules.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_rules_certify_only_what_labels_prove(spark):
    """200 good documents certify a cutoff that rejects, 60 can't, and harm to good documents stops the path."""
    word = lambda *n: "".join(chr(97 + int(d)) for k in n for d in str(k))
    good = [(i, " ".join(word(i, 0, j) for j in range(50))) for i in range(200)]
    bad = [(1000 + i, " ".join(word(i, 1, j) + " #" for j in range(30))) for i in range(40)]
    docs = spark.createDataFrame([*good, *bad], "doc_id bigint, text string")
    label = lambda rows: spark.createDataFrame([(i, q) for i, q in rows], "doc_id bigint, quality int")
    told = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad]
    gone = lambda labels: {r.doc_id for r in rules.quality_rules(docs, labels, ["doc_id"]).where("NOT kept").collect()}
    assert gone(label(told)) == {i for i, _ in bad}
    assert gone(label(told[:60] + told[200:])) == set()
    assert gone(label(told[:200])) == set()
    # a tenth of the good documents look like the bad ones: no level that rejects these is certified
    assert gone(label([(i, 1) for i, _ in good[:180]] + [(i, 1 if k < 20 else 0) for k, (i, _) in enumerate(bad)])) == set()
    assert gone(spark.createDataFrame([], "doc_id bigint, quality int")) == set()


def brute_components(texts, k):
    sets = {}
    for i, t in texts.items():
        w = re.findall(SPACES, lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates(spark, texts):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    family = {1000 + i: " ".join(base[: 8 + i % 6] + [f"w{i % 9}"]) for i in range(40)}
    every = texts | family | {2000: "", 2001: " ", 2002: "a b", 2003: "A  b", 2004: None}
    frame = spark.createDataFrame(list(every.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, k=4).collect()}
    assert got == brute_components(every, 4)


def test_near_duplicates_odd_rows(odd):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and [r.kept for r in rows if r.doc_id is None] == [True]


def test_overlaps_exact():
    rng = np.random.RandomState(1)
    sets = [np.unique(rng.randint(0, 9000, n)).astype(np.uint64) for n in (1, 50, 4000, 6000)]
    got = minhash.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(4) for j in range(4) if i != j)


def test_language_model(spark, texts, docs, odd):
    held = queries.crc_bucket("doc_id", 7) == 2
    got = {r.doc_id: r for r in lm.score_texts(docs, ~held).collect()}
    words = {i: [*re.findall(SPACES, lower(t)), None] for i, t in texts.items()}
    c = Counter(w for i in words for w in words[i] if zlib.crc32(str(i).encode()) % 7 != 2)
    n, v, better = sum(c.values()), len(c), []
    for i, w in words.items():
        r = got[i]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score <= 0
        if not r.train:
            better.append(r.score - r.base_score)
    assert sum(better) > 0
    assert lm.score_texts(odd, F.lit(False)).where("base_score <> 0 OR train_tokens <> 0").count() == 0


def test_word_order(spark):
    """Pairs met in training are likelier in their order; the base score has no order."""
    texts = ["alpha beta gamma delta", "delta gamma beta alpha", *["alpha beta gamma delta"] * 20, *["beta alpha delta omega gamma"] * 2]
    rows = lm.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5), F.col("doc_id") > 1).collect()
    got = {r.doc_id: r for r in rows}
    assert got[0].base_score == pytest.approx(got[1].base_score)
    assert got[0].score > got[1].score + 1


def test_word_chances_add_up(spark):
    """Behind any word, known, unseen or the end, the chances of all words add up to 1."""
    rng = np.random.RandomState(7)
    vocab = [f"w{i}" for i in range(30)]
    train = [" ".join(vocab[i] for i in rng.zipf(1.4, 40) % 30) for _ in range(60)]
    known = sorted({w for t in train for w in t.split()})
    behind = ["", known[0], known[-1], "unseen"]
    asked = [f"{u} {w}".strip() for u in behind for w in [*known, "unseen", ""]]
    frame = spark.createDataFrame(list(enumerate(train + asked)), "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: r for r in lm.score_texts(frame, F.col("doc_id") < len(train), per_token=True).collect()}
    per = len(known) + 2
    for k, u in enumerate(behind):
        own = [rows[len(train) + k * per + j] for j in range(per)]
        assert all(r.score == pytest.approx(sum(r.token_scores)) and len(r.token_scores) == r.n_tokens for r in own)
        assert sum(10 ** r.token_scores[1 if u else 0] for r in own) == pytest.approx(1, abs=1e-6)


def test_seats_match_one_by_one_seating():
    """Tables of dishes with few and many customers against a plain Chinese-restaurant process."""
    rng = np.random.RandomState(5)
    for count, fresh, discount in ((7, 0.5, 0.6), (200, 3.0, 0.5), (3000, 40.0, 0.4), (3000, 4000.0, 0.7)):
        got = lm.seat(np.full(4000, count), np.full(4000, fresh), discount, lambda step, who: rng.rand(len(who)))
        tables = np.ones(4000)
        for k in range(1, count):
            tables += rng.rand(4000) < fresh / (fresh + k - discount * tables)
        assert got.mean() == pytest.approx(tables.mean(), rel=0.02)
        assert got.std() == pytest.approx(tables.std(), rel=0.1)
        assert got.min() >= 1 and got.max() <= count


def test_binomial_quantiles():
    rng = np.random.RandomState(2)
    for n, p in ((5, 0.3), (100, 0.05), (100, 0.97), (5000, 0.4)):
        got = lm.binomial(np.full(20000, n), np.full(20000, p), rng.rand(20000))
        assert got.mean() == pytest.approx(n * p, rel=0.02) and got.std() == pytest.approx((n * p * (1 - p)) ** 0.5, rel=0.05)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    long = "alpha beta " * 300 + "x" * 900 + " gamma" * 50
    data, off = lm.tx.buffers(lm.pa.array(["a b", long, "", "c"]))
    texts = ["", "", "", ""]
    for first, part, at in lm.runs(data, off, 500):
        for i in range(len(at) - 1):
            texts[first + i] += part[at[i] : at[i + 1]].tobytes().decode()
    assert texts == ["a b", long, "", "c"]
    whole, pieces = lm.Words(), lm.Words()
    counts = whole.add(data, off)
    sizes = np.zeros(4, np.int64)
    for first, part, at in lm.runs(data, off, 500):
        sizes[first : first + len(at) - 1] += pieces.add(part, at)
    assert (counts == sizes).all()
    (a, b, _, c), (d, e, _, f) = whole.close(), pieces.close()
    assert (a == d).all() and (b == e).all() and c == f


def test_language_model_odd_rows(spark, odd):
    """Null and repeated ids, null and empty texts, an empty table."""
    rows = lm.score_texts(odd, F.lit(True)).collect()
    assert len(rows) == len(ODD) and all(r.n_known == r.n_tokens and r.score < 0 for r in rows)
    assert lm.score_texts(odd, F.lit(None).cast("boolean")).where("score <> 0").count() == 0
    assert lm.score_texts(odd.limit(0), F.lit(True)).count() == 0


def test_only_likely_runs_need_a_binomial(monkeypatch):
    """Runs of customers that open no table for sure are settled without a quantile, and nothing else is."""
    rng, asked, plain = np.random.RandomState(4), [], lm.binomial
    count, fresh, keys = np.full(4000, 300), np.geomspace(1e-6, 20, 4000), rng.randint(0, 1 << 62, 4000).astype(np.uint64)
    monkeypatch.setattr(lm, "binomial", lambda n, p, u: asked.append(len(n)) or plain(n, p, u))
    got = lm.drawn_tables(keys, count, fresh, 0.5, 3)
    draw = lambda step: (lm.tx.mix(keys + np.array([1 + 3 * 100_003 + step], np.uint64) * lm.tx.ODDS[30]) >> np.uint64(11)) / 2.0**53
    want, k, step = np.ones(4000), 1, 0
    while k < 300:
        run = max(1, k // 6)
        many = np.full(4000, min(run, 300 - k))
        chance = fresh / (fresh + np.maximum(k + (many - 1) / 2 * (run > 1) - 0.5 * want, 1e-9))
        want += plain(many, chance, draw(step)) if run > 1 else draw(step) < chance
        k, step = k + run, step + 1
    assert (got == want).all() and 0 < sum(asked) < 4000 * (step - 11) / 3


def test_common_words_are_drawn_once_a_task():
    rng = np.random.RandomState(3)
    keys = np.unique(rng.randint(0, 1 << 62, 500).astype(np.uint64))
    served, base = rng.zipf(1.3, len(keys)).clip(1, 5000), rng.rand(len(keys)) / 100
    now, drawn = lm.Seating(9000, 700, 700, 0.6, 5), lm.Drawn(most=200)
    for _ in range(4):
        part = np.sort(rng.choice(len(keys), 300, replace=False))
        want = lm.drawn_tables(keys[part], served[part], now.fresh(base[part]), now.discount, now.sweep)
        assert (drawn.tables(keys[part], served[part], now.fresh(base[part]), now) == want).all()
    assert 0 < len(drawn.keys) <= 200 and (np.diff(drawn.keys.astype(object)) > 0).all()
    together = lm.drawn_together(keys, [(served, now.fresh(base, x), x) for x in (3, 70)], 0.6)
    assert all((t == lm.drawn_tables(keys, served, now.fresh(base, x), 0.6, x)).all() for t, x in zip(together, (3, 70), strict=True))


def test_numbers_keep_only_bytes_in_use():
    rng = np.random.RandomState(6)
    for kind, values in (("<i8", rng.randint(0, 200, (2, 50_000))), ("<i8", np.array([0, 1 << 40, 7])), ("<u4", rng.randint(0, 1 << 31, 99)), ("<f8", rng.rand(9)), ("u1", np.arange(5)), ("<i8", np.zeros((3, 0)))):
        assert (lm._unpack(lm._pack(values, kind), kind) == values.ravel()).all()
    assert len(lm._pack(rng.randint(0, 200, 50_000), "<i8")) < 50_100
    keys = np.sort(rng.randint(0, 1 << 62, 99).astype(np.uint64))
    assert (lm._words(lm.pa.scalar(lm._steps(keys))) == keys).all()


def test_sums_are_written_once(spark, monkeypatch):
    """Sums of blocks go to the blocks' own table, with no copy on the disk before it."""
    written, plain = [], lm.frozen
    monkeypatch.setattr(lm, "frozen", lambda df, name: written.append(name) or plain(df, name))
    assert lm.score_texts(spark.createDataFrame([(k, "a b a b c") for k in range(9)], "doc_id bigint, text string"), F.lit(True)).count() == 9
    assert written == ["lm-scores"]


def test_quality_and_language(spark, odd):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = queries.op4_quality_cnn(spark, sf).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in scored if r.quality == 1], [r.score for r in scored if r.quality == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op5_language_ppm(spark, sf).join(langs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    net = cnn.train(odd, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r.score for r in cnn.quality_scores(odd, net).collect()} == {0.5}
    from objectlens.llm import ppm

    assert {r.lang_pred for r in ppm.identify(odd, ppm.train(odd.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_network_by_brute_force():
    """Forward pass and gradients of two documents, one of several chunks, against plain loops and differences."""
    net = cnn.Network(3)
    raw = [bytes(np.random.RandomState(k).randint(32, 120, n).astype(np.uint8)) for k, n in ((0, 1300), (1, 40))]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.array([0, 1300, 1340])

    def plain(text):
        vectors = []
        for a in range(0, max(1, len(text) - (cnn.CHUNK - cnn.HOP)), cnn.HOP):
            chunk = text[a : a + cnn.CHUNK].ljust(cnn.CHUNK, b"\0")
            values = [np.concatenate([net.embed[c] for c in chunk[i : i + cnn.WIDTH]]) @ net.filters for i in range(0, cnn.CHUNK - cnn.WIDTH + 1, cnn.STEP)]
            vectors.append(np.tanh(np.max(values, axis=0) + net.bias))
        return 1 / (1 + math.exp(-(np.concatenate([np.mean(vectors, axis=0), np.max(vectors, axis=0)]) @ net.out + net.out_bias[0])))

    assert net.score(data, off) == pytest.approx([plain(t) for t in raw], abs=1e-5)
    starts, stops, first = cnn.cut(off)
    assert len(starts) == 4 and all(b - a <= cnn.CHUNK for a, b in zip(starts, stops, strict=True))
    chunks, target = cnn.taken(data, starts, stops), np.array([1, 0], np.float32)
    loss = lambda: -np.mean(np.log(np.where(target == 1, s := net.score(data, off), 1 - s)))
    for p, g in zip(net.parameters(), net.gradients(chunks, first, target), strict=True):
        for at in [np.unravel_index(np.abs(g).argmax(), g.shape), tuple(0 for _ in g.shape)]:
            keep, near = p[at], []
            for step in (1e-3, -1e-3):
                p[at] = keep + step
                near.append(loss())
            p[at] = keep
            assert (near[0] - near[1]) / 2e-3 == pytest.approx(g[at], rel=0.05, abs=2e-3)


def test_trees_by_brute_force():
    from objectlens.llm import ppm

    texts = {"a": ["abra cadabra", "Ábra 12 abc"], "b": ["xyz zyx xx", "bxa"], "c": []}
    trees = ppm.Trees(texts)

    def fold(t):
        return [int(trees.symbol[x]) for x in t.encode()]

    def share(lang, context):
        counts = Counter()
        for t in texts[lang]:
            s = [0] * ppm.ORDER + fold(t)
            for i in range(ppm.ORDER, len(s)):
                if s[i - len(context) : i] == context:
                    counts[s[i]] += 1
        parent = share(lang, context[1:]) if context else [1 / trees.width] * trees.width
        if not counts:
            return parent
        total, left = sum(counts.values()), sum(p for x, p in enumerate(parent) if not counts[x])
        whole = total + len(counts) if left > 0 else total
        return [counts[x] / whole if counts[x] else len(counts) / whole * p / left for x, p in enumerate(parent)]

    asked = ["abra", "zyx abc", "q", "Á1b", "cad xx"]
    data, off = lm.tx.buffers(lm.pa.array(asked))
    got = trees.code_lengths(data, off)
    for i, t in enumerate(asked):
        s = [0] * ppm.ORDER + fold(t)
        for j, lang in enumerate(trees.langs):
            # a context counts from the longest that any language has
            want = 0.0
            for k in range(ppm.ORDER, len(s)):
                n = next(n for n in range(ppm.ORDER, -1, -1) if n == 0 or any(s[k - n : k] == (w := [0] * ppm.ORDER + fold(u))[e - n : e] for v in texts.values() for u in v for e in range(ppm.ORDER, ppm.ORDER + len(fold(u)))))
                want -= math.log2(share(lang, s[k - n : k])[s[k]])
            assert got[i, j] == pytest.approx(want, rel=1e-5)


def test_language_odd_rows(spark, odd):
    """Null and repeated ids, null languages, a language whose copies are a third of all rows, an empty table."""
    from objectlens.llm import ppm

    rows = [(None, "die katze", "de"), (None, "die katze", "de"), (1, "the cat", "en"), (1, "the dog", "en"), (2, None, "en"), (3, "x", None), (None, "", "de")] + [(9, "the hat", "en")] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    told = ppm.identify(docs, ppm.train(docs, sample_bytes=400))
    assert told.count() == len(rows)
    assert {r.lang_pred for r in told.where("text IS NULL OR text = ''").collect()} == {"und"}
    assert {r.lang_pred for r in told.where("text LIKE 'the%'").collect()} == {"en"}
    trees = ppm.train(odd.withColumn("lang", F.lit("zz")))
    assert ppm.identify(odd, trees).where("lang_pred = 'und'").count() == sum(not re.search(r"[^\W\d_]", t or "") for t in ODD)
    assert ppm.identify(odd.limit(0), trees).count() == 0


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1), (0, 1), (3, 0), (None, 1), (5, None), (6, 7), (7, 1)], "doc_id bigint, quality int")
    net = cnn.train(odd, labels, sample=2)
    rows = cnn.quality_scores(odd, net).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert cnn.quality_scores(odd.limit(0), net).count() == 0


def plain_verdicts(pages, rules):
    """words, odds, rule and verdict of each URL by plain loops."""
    def cut(url):
        found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        return (lower(found[1]), found[2]) if found else ("", "")

    def rule(h, p):
        fits = [(len(a + b), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return max(fits)[1:] if fits else (None, None)

    token = re.compile("[a-z]+|[0-9]+")
    unigrams = Counter(w for u in pages for h, p in [cut(u)] if h for w in [*(w for x in h.split(".") if "-" in x for w in token.findall(x)), *token.findall(p.lower())])
    total = sum(unigrams.values()) + 1

    def split(name):
        best = [(0.0, 0)]
        for e in range(1, len(name) + 1):
            best.append(min((best[s][0] + (-math.log(unigrams[w] / total) if unigrams[w := name[s:e]] else math.log(total) + 1.5 * (e - s)), s) for s in range(e)))
        words, e = [], len(name)
        while e:
            words, e = [name[best[e][1] : e], *words], best[e][1]
        return words

    told = lambda h, p: [f"h:{w}" for x in token.findall(h) for w in split(x)] + [f"p:{w}" for w in token.findall(p.lower())]
    taught = [(rule(*cut(u))[1], told(*cut(u))) for u in pages if cut(u)[0] and rule(*cut(u))[1]]
    n = {v: Counter(t for x, ts in taught if x == v for t in ts) for v in ("block", "allow")}
    size = len(n["block"] | n["allow"]) + 1
    odds_of = lambda t: math.log((n["block"][t] + 1) / (n["block"].total() + size)) - math.log((n["allow"][t] + 1) / (n["allow"].total() + size)) if t in n["block"] or t in n["allow"] else 0.0
    prior = math.log(sum(v == "block" for v, _ in taught) + 1) - math.log(sum(v == "allow" for v, _ in taught) + 1)
    out = {}
    for u in pages:
        h, p = cut(u)
        odds = prior + sum(map(odds_of, told(h, p))) if h else -1.0
        name, verdict = rule(h, p)
        out[u] = h, p, name, verdict or ("block" if odds > 0 else "allow"), [t[2:] for t in told(h, p) if t[0] == "h"], odds
    return out


def test_urls(spark):
    """Segmentation, classes and rules against plain loops, on given pages and odd ones."""
    odd = ["http://a.NET/x", "http://a.net", "https://m.example.net/en/5?x", "http://x.example.com/de/", "http://z.org/fr/", None, "nothing", "http://cheappillsfarm.org/q", "http://a.org?u=://b.net/", "http://cheap-pills.net/buy/farm", "http://" + "long" * 20 + ".net/", "http://a.net", "http://Ä-b.com/É/x"]
    given = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    pages = spark.createDataFrame([(i, u, "w", 1.5) for i, u in enumerate(given + odd)], "page_id bigint, url string, words string, kept double")
    model = urls.train(pages, queries.URL_RULES)
    found = urls.url_verdicts(pages, queries.URL_RULES, model)
    assert found.columns == ["page_id", "url", "kept", "host", "path", "rule", "verdict", "words", "odds"]
    rows, want = found.collect(), plain_verdicts(given + odd[:10] + odd[11:], queries.URL_RULES)
    assert len(rows) == len(given + odd)
    assert rows and {r.verdict for r in rows if not r.rule} == {"allow", "block"}
    for r in rows:
        if r.url in want and r.url != "http://Ä-b.com/É/x":
            assert (r.host, r.path, r.rule, r.verdict, r.words) == want[r.url][:5]
    told = {r.url: r for r in rows}
    assert told["http://cheappillsfarm.org/q"].words == ["cheap", "pills", "farm", "org"]
    assert told[None][3:7] == ("", "", None, "allow") and told[odd[10]].words == ["long" * 20, "net"]
    assert urls.url_verdicts(pages.limit(0), queries.URL_RULES, urls.train(pages.limit(0), queries.URL_RULES)).count() == 0


def test_urls_odds(spark):
    given = ["http://www.casino-win.net/x/1", "http://casinowin.org/y", "http://casino.com/x", "http://a.org/fr/x", "http://b.org/fr/y", "http://b.com/y"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string")
    want = plain_verdicts(given, queries.URL_RULES)
    for r in urls.url_verdicts(pages, queries.URL_RULES, urls.train(pages, queries.URL_RULES), keep=["url"]).collect():
        assert (r.words, r.odds, r.verdict) == (want[r.url][4], pytest.approx(want[r.url][5]), want[r.url][3])


def test_urls_count_every_token(spark):
    """Rare words take part however many other tokens are more frequent."""
    pages = spark.range(60_000).selectExpr("id AS page_id", "concat('http://a.org/n', id, '/', id, '/n', id, '/', id) AS url")
    rare = ["https://zebrafish-casino.net/quux", "http://zebrafishzebrafish.org/"]
    pages = pages.union(spark.createDataFrame(list(enumerate(rare)), "page_id bigint, url string"))
    model = urls.train(pages, queries.URL_RULES)
    rows = {r.url: r for r in urls.url_verdicts(pages.where("url NOT LIKE 'http://a.org%'"), [], model, keep=["url"]).collect()}
    assert rows[rare[1]].words == ["zebrafish", "zebrafish", "org"]
    assert model.weights.where("t IN ('h:zebrafish', 'p:quux') AND weight > 0").count() == 2


def test_shard_store(spark, docs, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=400_000)
    for k in range(5):
        store.append(docs.where(F.pmod("doc_id", F.lit(5)) == k), rows_per_shard=7)
    before = store.manifest()
    version = store.compact()
    assert version > before[0] and len(store.manifest()[1]) < len(before[1])
    assert sorted(r.doc_id for r in store.read(version).collect()) == sorted(r.doc_id for r in store.read(before[0]).collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert not shards.plan_round(store.manifest()[1], store.target)
    with pytest.raises(shards.VersionTaken):
        store.commit(version, [], docs.schema.json())
    store.vacuum()
    assert store.read().count() == docs.count()
    empty = shards.ShardStore(spark, f"file://{tmp_path}/e")
    empty.append(docs.limit(0))
    empty.compact()
    assert empty.read().count() == 0


def test_shard_store_keeps_rows(spark, odd, tmp_path):
    """Null and repeated ids, odd texts and columns with clashing names come back whole, through two compactions."""
    store = shards.ShardStore(spark, f"file://{tmp_path}/o", target_bytes=20_000)
    for _ in range(3):
        store.append(odd.unionByName(odd), rows_per_shard=3)
        store.compact()
    got = store.read().select(*odd.columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, odd.collect() * 6))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_sql_twins(spark, name, sf):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for tab in ("documents", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {tab} AS SELECT * FROM read_parquet('{sf}/{tab}.parquet')")
    mine = queries.queries()[name](spark, sf)
    other = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in other.description]
    assert sorted(columns) == sorted(mine.columns)
    assert sorted(map(tuple, mine.select(columns).collect())) == sorted(other.fetchall())
    if name.startswith("op10") and sf != SF:  # the cutoffs certified from these labels reject documents that pass the base
        assert mine.where("NOT kept AND NOT base_failed").count() > 0
