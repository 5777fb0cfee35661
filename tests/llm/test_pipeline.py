"""Each stage of the corpus pipeline against brute force on small tables with odd rows."""

import hashlib
import re

import corpus_pipeline as cp
import public_tokenizers
import pytest
from test_llm import ODD, SPACES, brute_components, lower

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "the river runs past old mills and quiet towns where people trade grain wool and salt each spring".split()
ITEM = " ".join(f"bench{k}" for k in range(14))


def told(i, text):
    return (i, text, "en", "s", len(text or ""))


@pytest.fixture(scope="module")
def rows():
    """Odd texts, copies, near copies, a benchmark passage, repeated and missing ids."""
    long = [" ".join(PROSE[(j * (k + 3) + j * j) % len(PROSE)] + "abcdefgh"[(j * k) % 8] for j in range(60)) for k in range(12)]
    copies = [told(100 + k, long[0]) for k in range(6)] + [told(120 + k, long[0] + " end" * (k % 2)) for k in range(4)]
    odd = [told(i, t) for i, t in enumerate(ODD)]
    return [*odd, *copies, *[told(200 + k, t) for k, t in enumerate(long[1:])], told(300, "before " * 25 + ITEM + " behind"), told(301, ITEM.upper()), told(None, long[5]), told(None, None), told(205, long[6]), told(205, long[6]), told(206, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", score string").repartition(4)


def key(r):
    return repr(tuple(r))


def test_classifier_keeps_what_scores(spark, docs, rows, folder, tmp_path):
    assert sorted(map(key, cp.quality_classifier(spark, docs, folder).collect())) == sorted(map(key, rows))
    good, bad = [told(1000 + k, " ".join(PROSE[(k + j) % len(PROSE)] for j in range(40))) for k in range(40)], [told(2000 + k, "$$$ ### &&& " * (10 + k)) for k in range(40)]
    labels = [(r[0], 1, 0) for r in good[:30]] + [(r[0], 0, 0) for r in bad[:30]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = cp.quality_classifier(spark, spark.createDataFrame(good + bad, SCHEMA), str(tmp_path))
    assert kept.columns == cp.COLUMNS and sorted(map(key, kept.collect())) == sorted(map(key, good))


def test_rules_stage(spark, docs, rows, folder):
    def fails(text):
        w = re.findall(SPACES, text or "")
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        again = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 8)}
        return len(w) < 20 or 100 * len(again) > 30 * len(w)

    assert sorted(map(key, cp.quality_rules(spark, docs, folder).collect())) == sorted(key(r) for r in rows if not fails(r[1]))


def test_near_duplicates_stage(spark, docs, rows, folder):
    one = {}
    for r in rows:  # rows that share an id are one document
        one.setdefault(r[0], set()).add(r[1:])
    single = {i: t for i, s in one.items() if i is not None and len(s) == 1 for _, (t, *_) in enumerate(s)}
    got = cp.near_duplicates(spark, docs.where("doc_id IS NULL OR doc_id <> 206"), folder)
    groups = brute_components({i: t for i, t in single.items() if i != 206}, 5)
    want = [key((i, *next(iter(one[i])))) for i, (_, top) in groups.items() if i == top] + [key(r) for r in rows if r[0] is None]
    many = [i for i, s in one.items() if i not in (None, 206) and len(s) > 1]
    assert not many and sorted(map(key, got.collect())) == sorted(want)
    again = cp.near_duplicates(spark, docs, folder).where("doc_id = 206").collect()
    assert [r.text for r in again] == [""]


def test_decontamination_stage(spark, docs, rows, folder):
    got = cp.benchmark_decontamination(spark, docs, folder).collect()
    assert sorted(map(key, got)) == sorted(key(r) for r in rows if "bench0 bench1 bench2" not in lower(r[1]))


def test_tokenize_stage(spark, docs, rows, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.tokenize(spark, docs, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_empty_table(spark, docs, folder, name, stage):
    assert stage(spark, docs.limit(0).select(*cp.COLUMNS), folder).count() == 0
