"""Operator 9: near-duplicate documents by min-max hashing.

A document's set holds the hashes of its distinct k-word shingles.  Under each permutation both
the least and the greatest value are kept, so ``PERMUTATIONS`` hash passes give twice as many
signature values, each equal between two sets with their Jaccard similarity as its chance.  Bands
of ``ROWS`` values put sets into buckets; at a similarity of 0.8 a pair misses all 32 bands with a
chance of 5e-8.  Every link is confirmed on the full sets, taken from the texts anew.

No step lists all pairs of a group:

1. Equal sets form one class, found by a 128-bit fingerprint; its least doc_id stands for it.
2. Each class is compared with one other, the bucket head it shares most buckets with.
3. Buckets whose classes are then still in several components are gone through in pairs of tiles
   of about ``TILE`` classes.  Signatures are compared inside a tile pair, and of the pairs that
   may be similar enough a spanning forest is kept; it ties classes to families, such that any
   two classes of one bucket that may be linked are in one family.
4. Families of several components are compared exactly, again by tile pairs: products of incidence
   matrices give all intersections of a tile pair, and a spanning forest of its links is kept.
5. Components come from large-star and small-star rounds over tables in the shared folder.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text
of fewer than k words has its whole sequence as its one shingle; a null doc_id is a component of
its own with a null id, and kept; rows that share a doc_id are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlens.llm import textops as tx
from objectlens.llm.common import forget, frozen

PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Standard deviations below the threshold from which estimates go to the exact step: at 0.8, 128 values
#: have one of 0.035, and a pair at 0.8 has fewer than 0.59 alike with a chance of 2e-8, less than missing all bands.
DEVIATIONS = 6
TILE = 256
#: Members that one task compares with their head.
SALT_ROWS = 2000

_rng = np.random.RandomState(99)
FACTORS = (_rng.randint(0, 1 << 62, PERMUTATIONS, dtype=np.int64).astype(tx.U64) << tx.U64(1)) | tx.U64(1)
SHIFTS = _rng.randint(0, 1 << 62, PERMUTATIONS, dtype=np.int64).astype(tx.U64)


def signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation for documents with sets [documents, 2P] (uint32)."""
    full = np.flatnonzero(np.diff(off) > 0)
    out = np.zeros((len(off) - 1, 2 * PERMUTATIONS), np.uint32)
    if len(full):
        x, at = tx.mix(sets), off[:-1][full]
        for j in range(PERMUTATIONS):
            value = ((x * FACTORS[j] + SHIFTS[j]) >> tx.U64(32)).astype(np.uint32)
            out[full, j] = np.minimum.reduceat(value, at)
            out[full, PERMUTATIONS + j] = np.maximum.reduceat(value, at)
    return out


def fingerprints(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set [documents, 2]; equal sets, equal sums."""
    total = np.zeros((2, len(sets) + 1), tx.U64)
    for k in range(2):
        np.cumsum(tx.mix(sets ^ tx.ODDS[40 + k]), out=total[k, 1:])
    return (total[:, off[1:]] - total[:, off[:-1]]).T.view(np.int64)


def bands(signature: np.ndarray) -> np.ndarray:
    """Bucket of each band [documents, bands]; band numbers keep the buckets of bands apart."""
    v = signature.astype(tx.U64).reshape(len(signature), BANDS, ROWS)
    out = np.arange(BANDS, dtype=tx.U64)[None, :] * tx.ODDS[50]
    for k in range(ROWS):
        out = tx.mix(out + v[:, :, k] * tx.ODDS[51 + k])
    return np.ascontiguousarray(out).view(np.int64)


def _described(docs: DataFrame, k: int) -> DataFrame:
    """id, n_shingles, fa, fb, sig of every document."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in tx.chunks(batch.column(1)):
                sets, at = tx.shingle_sets(data, off, k)
                prints, sig = fingerprints(sets, at), signatures(sets, at)
                blobs = [s.tobytes() for s in sig]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(blobs, pa.binary())], names=["id", "n_shingles", "fa", "fb", "sig"])

    return docs.mapInArrow(run, "id bigint, n_shingles bigint, fa bigint, fb bigint, sig binary")


def _banded(classes: DataFrame) -> DataFrame:
    """(bucket, rep) of every class and band."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, 2 * PERMUTATIONS)
                for a in range(0, len(sig), 2000):
                    own = bands(sig[a : a + 2000])
                    yield pa.RecordBatch.from_arrays([pa.array(own.reshape(-1)), pa.array(np.repeat(batch.column(0).slice(a, 2000).to_numpy(), BANDS))], names=["bucket", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "bucket bigint, rep bigint")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (head, member), and whether their full sets are similar enough: (head, member, linked).

    Texts are dealt by head, and a head with many members goes to several tasks, each with a copy
    of its text.  A head's rows come sorted, its own first, and are read as a stream.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / SALT_ROWS))) if "n" in pairs.columns else pairs.withColumn("salt", F.lit(0).cast("bigint"))
    prints = classes.select(F.col("rep").alias("id"), "fa", "fb")
    members = salted.select("head", "salt", F.col("member").alias("id"), F.lit(1).alias("role"))
    heads = salted.select("head", "salt").distinct().select("head", "salt", F.col("head").alias("id"), F.lit(0).alias("role"))
    rows = docs.join(heads.unionByName(members).join(prints, "id"), "id").select("head", "salt", "role", "id", "fa", "fb", "text")

    def run(batches):
        key, head = None, None
        for batch in batches:
            heads_, salts, roles, ids = (batch.column(i).to_numpy() for i in range(4))
            want = np.stack([batch.column(4).to_numpy(), batch.column(5).to_numpy()], 1)
            out: list[list] = [[], [], []]
            for lo, hi, data, off in tx.chunks(batch.column(6)):
                sets, at = tx.shingle_sets(data, off, k)
                same = (fingerprints(sets, at) == want[lo:hi]).all(1)  # rows that share a doc_id may have other texts
                for i in np.flatnonzero(same):
                    own, row = sets[at[i] : at[i + 1]], lo + i
                    if roles[row] == 0:
                        key, head = (heads_[row], salts[row]), own.copy()
                    elif key == (heads_[row], salts[row]):
                        spot = np.minimum(np.searchsorted(head, own), len(head) - 1)
                        both = int((head[spot] == own).sum())
                        out[0].append(heads_[row])
                        out[1].append(ids[row])
                        out[2].append(100 * both >= percent * (len(head) + len(own) - both))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], names=["head", "member", "linked"])

    return rows.repartition("head", "salt").sortWithinPartitions("head", "salt", "role").mapInArrow(run, "head bigint, member bigint, linked boolean").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of an edge (u, v) can reach.

    The least neighbours get an exchange of their own, so that adaptive execution can split the
    rows of a centre with very many neighbours over several tasks.
    """
    edges = frozen(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition("u")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = frozen(large, "large-star")
        forget(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.repartition("u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = frozen(small, "small-star")
        forget(large)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == mark:
            return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
        mark = now


def _tiled(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Rows dealt to the tile pairs (ti, tj) of their group, t being a row's own tile; each tile meets each."""
    tiles = F.ceil(F.col(size) / TILE)
    placed = rows.withColumn("t", F.pmod(F.xxhash64("rep", F.lit(7)), tiles)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)))
    rest = [c for c in rows.columns if c not in (group, size)]
    return placed.select(F.col(group).alias("g"), F.least("t", "o").alias("ti"), F.greatest("t", "o").alias("tj"), "t", *rest).repartition("g", "ti", "tj").sortWithinPartitions("g", "ti", "tj", "rep")


def _groups(batches):
    """(key, rows) of each run of equal g, ti, tj in a sorted stream; rows are tuples from t on."""
    key, wait = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != row[:3]:
                if len(wait) > 1:
                    yield key, wait
                key, wait = row[:3], []
            wait.append(row[3:])
    if len(wait) > 1:
        yield key, wait


def _forest(pairs, comps: list[int]) -> list[tuple[int, int]]:
    """The pairs of rows, in the order given, that join components still apart."""
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for a, b in pairs:
        if (x := top(comps[a])) != (y := top(comps[b])):
            parent[x] = y
            kept.append((a, b))
    return kept


def _across(comps: np.ndarray, tile: np.ndarray, ti: int, tj: int) -> np.ndarray:
    """Pairs a < b of different components that this tile pair is there for."""
    meet = np.triu(comps[:, None] != comps[None, :], 1)
    return meet if ti == tj else meet & (tile[:, None] != tile[None, :])


def _edges(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(f) for f in found], pa.int64()), pa.array([min(f) for f in found], pa.int64())], names=["u", "v"])


def _likely(rows: DataFrame, least: float) -> DataFrame:
    """A forest of the pairs across components whose estimate is at least ``least``, for each bucket's tile pairs.

    rows: bucket, n (its classes), rep, comp, sig.
    """

    def run(batches):
        for (_, ti, tj), rows in _groups(batches):
            tile, reps, comps = (np.array([r[i] for r in rows]) for i in range(3))
            if (comps == comps[0]).all():
                continue
            sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(len(rows), -1)
            meet, pairs = _across(comps, tile, ti, tj), []
            for a in np.flatnonzero(meet.any(1)):
                other = np.flatnonzero(meet[a])
                good = other[(sig[other] == sig[a]).mean(1) >= least]
                pairs += _forest([(int(a), int(b)) for b in good], comps.tolist())
            if pairs:
                yield _edges([(int(reps[a]), int(reps[b])) for a, b in _forest(pairs, comps.tolist())])

    return _tiled(rows.select("bucket", "n", "rep", "comp", "sig"), "bucket", "n").mapInArrow(run, "u bigint, v bigint").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, exactly, as products of slices of the incidence matrix."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[column] > 1
    owner, column = owner[common], (np.cumsum(count > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        part = np.zeros((n, min(width, int(column[-1]) + 1 - a)), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        out += part @ part.T
    return out


def _exact(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """A forest of the links across components inside each family's tile pairs, on full sets.

    rows: family, n (its classes), rep, comp, fa, fb, text.
    """

    def run(batches):
        for (_, ti, tj), rows in _groups(batches):
            if len({r[2] for r in rows}) < 2:
                continue
            text = pa.array([r[5] for r in rows], pa.large_string())
            sets = []
            for lo, hi, data, off in tx.chunks(text):
                values, at = tx.shingle_sets(data, off, k)
                prints = fingerprints(values, at)
                # rows that share a doc_id may have other texts
                sets += [values[at[i] : at[i + 1]] if (int(prints[i, 0]), int(prints[i, 1])) == rows[lo + i][3:5] else None for i in range(hi - lo)]
            own = [i for i, x in enumerate(sets) if x is not None]
            tile, reps, comps = (np.array([rows[i][j] for i in own]) for j in range(3))
            sizes = np.array([len(sets[i]) for i in own])
            both = overlaps([sets[i] for i in own])
            good = _across(comps, tile, ti, tj) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
            pairs = _forest(np.argwhere(good).tolist(), comps.tolist())
            if pairs:
                yield _edges([(int(reps[a]), int(reps[b])) for a, b in pairs])

    return _tiled(rows.select("family", "n", "rep", "comp", "fa", "fb", "text"), "family", "n").mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    told = frozen(_described(texts, k), "signatures")
    linkable = told.where("n_shingles > 0 AND id IS NOT NULL")
    classes = frozen(linkable.groupBy("fa", "fb").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "classes")
    buckets = frozen(_banded(classes), "buckets")
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").repartition("bucket")
    votes = buckets.join(shared, "bucket").where("rep <> head").groupBy("rep", "head").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(F.col("rep").alias("member")).agg(F.max_by("head", F.struct("votes", -F.col("head"))).alias("head"))
    pairs = frozen(best.select("head", "member"), "pairs")
    sizes = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    tested = frozen(_confirmed(pairs.join(sizes, "head"), classes, texts, k, percent), "tested")
    # rows that share a doc_id but not a text join their classes
    twins = linkable.select("id", "fa", "fb").join(classes.select("fa", "fb", "rep"), ["fa", "fb"]).groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("u")).where("u <> v").select("u", "v")
    labels = frozen(components(tested.where("linked").select(F.col("member").alias("u"), F.col("head").alias("v")).unionByName(twins)), "labels")
    least = percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / (2 * PERMUTATIONS)) ** 0.5
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")
    inside = buckets.join(shared.select("bucket", "n"), "bucket").join(named.select("rep", "comp"), "rep")
    mixed = inside.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("bucket")
    likely = frozen(_likely(inside.join(mixed, "bucket").join(classes.select("rep", "sig"), "rep"), least), "likely")
    if not likely.isEmpty():
        old = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
        family = frozen(components(likely.unionByName(old)), "families")
        members = named.join(family.select(F.col("node").alias("rep"), F.col("label").alias("family")), "rep")
        apart = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("family", "n")
        links = frozen(_exact(members.join(apart, "family").join(texts, F.col("rep") == F.col("id")), k, percent), "links")
        labels = frozen(components(links.unionByName(old)), "labels")
    for done in (buckets, pairs, tested, likely):
        forget(done)
    known = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fa", "fb", F.coalesce("label", "rep").alias("component"))
    out = told.select("id", "n_shingles", "fa", "fb").join(known, ["fa", "fb"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
