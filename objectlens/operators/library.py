"""The object library: standardised embeddings, neighbours, clusters, majority votes, facets."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objectlens.session import forget, written

BLOCK_ROWS, PIVOTS = 512, 2


def l2_normalised(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def standardised(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """Each dimension to mean 0 and population deviation 1; a constant dimension is divided by 1."""
    long = rows.select(F.posexplode(column).alias("pos", "x"))
    stats = long.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    moments = stats.agg(F.sort_array(F.collect_list(F.struct("pos", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("stats"))  # as many as dimensions
    return rows.crossJoin(F.broadcast(moments)).select(id_col, F.zip_with(column, "stats", lambda x, s: (x.cast("double") - s["m"]) / s["s"]).alias(column))


def cosine_neighbours(rows: DataFrame, id_col: str, column: str, eps: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, distance) of all pairs a < b with a cosine distance of at most eps, exactly.

    Unit vectors at a cosine distance of at most eps are at most sqrt(2 eps) apart, so their
    distances to any pivot differ by no more.  Rows are dealt to rings of that width around
    ``PIVOTS`` pivots at once: a row meets only rows of its own and the neighbouring rings, and a
    ring is cut into blocks of about block_rows by hash, whose pairs meet in one task as a matrix product.
    """
    unit = rows.select(F.col(id_col).alias("id"), l2_normalised(F.transform(column, lambda x: x.cast("double"))).alias("v"))
    pivots = [r["v"] for r in unit.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]
    reach = max((2 * eps) ** 0.5 * (1 + 1e-9), 0.02)  # not below, so that rings stay few
    away = lambda v, p: F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with(v, F.array(*map(F.lit, p)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))
    ring = F.array(*[F.floor(away(F.col("v"), p) / reach) for p in pivots]) if pivots else F.array().cast("array<bigint>")
    dealt = written(unit.withColumn("ring", ring), "rings")
    sizes = dealt.groupBy("ring").agg(F.count(F.lit(1)).alias("n"))  # at most 101 rings around each pivot
    steps = F.array(*[F.array(*map(F.lit, s)) for s in itertools.product((0, 1, -1), repeat=len(pivots))]) if pivots else F.array(F.array().cast("array<bigint>"))
    shift = lambda r, s: F.zip_with(r, s, lambda a, b: a + b)
    near = sizes.select(F.col("ring").alias("own"), F.explode(F.transform(steps, lambda s: shift(F.col("ring"), s))).alias("other")).join(sizes.select(F.col("ring").alias("other"), F.col("n").alias("m")), "other").where("own <= other")
    near = near.join(sizes.select(F.col("ring").alias("own"), "n"), "own")
    cells = near.select("own", "other", F.ceil(F.col("n") / block_rows).alias("p"), F.ceil(F.col("m") / block_rows).alias("q"))
    left = dealt.join(F.broadcast(cells), F.col("ring") == F.col("own")).select("own", "other", F.pmod(F.xxhash64("id"), F.col("p")).alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("q") - 1)).alias("j"), F.lit(0).alias("side"), "id", "v")
    right = dealt.join(F.broadcast(cells), F.col("ring") == F.col("other")).select("own", "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("p") - 1)).alias("i"), F.pmod(F.xxhash64("id"), F.col("q")).alias("j"), F.lit(1).alias("side"), "id", "v")

    def meet(table: pa.Table) -> pa.Table:
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        v = np.array(table["v"].to_pylist(), float).reshape(len(ids), -1)
        same = table["own"][0].as_py() == table["other"][0].as_py()
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        distance = 1 - v[p] @ v[q].T
        i, j = np.nonzero((distance <= eps) & ((ids[p][:, None] < ids[q][None]) if same else (ids[p][:, None] != ids[q][None])))
        a, b = ids[p][i], ids[q][j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": distance[i, j]})

    return left.unionByName(right).groupBy("own", "other", "i", "j").applyInArrow(meet, "a bigint, b bigint, distance double")


def clusters(rows: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """Density clusters with two members as the least: components of the pairs, label = least member, -1 alone.

    Each round reads the last one's labels from a written table, so plans stay small and survive lost executors.
    """
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = edges.select(F.col("u").alias("id")).distinct().withColumn("label", F.col("id"))
    mark = None
    while True:
        # an exchange of its own lets adaptive execution split a centre's many edges
        least = edges.join(labels.repartition("id"), F.col("v") == F.col("id")).groupBy("u").agg(F.min("label").alias("m"))
        hop = labels.join(least, F.col("id") == F.col("u"), "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = hop.select(F.col("id").alias("j"), F.col("label").alias("jl"))
        last = labels
        labels = written(hop.join(jump, F.col("label") == F.col("j"), "left").select("id", F.least("label", F.coalesce("jl", "label")).alias("label")), "labels")
        now = tuple(labels.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("decimal(38,0)"))).head())
        if mark is not None:
            forget(last)
        if now == mark:
            forget(edges)
            return rows.select(id_col).join(labels.withColumnRenamed("id", id_col), id_col, "left").withColumn("label", F.coalesce("label", F.lit(-1)))
        mark = now


def majority(rows: DataFrame, group: str, keys: list[str], seq: str) -> DataFrame:
    """Each key's most frequent value in a group; missing counts as "unknown", ties go to the first seen."""
    long = rows.select(group, seq, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias("value")) for k in keys])).alias("e")).select(group, seq, "e.*")
    votes = long.groupBy(group, "key", "value").agg(F.count(F.lit(1)).alias("votes"), F.min(seq).alias("first"))
    best = F.row_number().over(Window.partitionBy(group, "key").orderBy(F.desc("votes"), "first"))
    return votes.withColumn("r", best).where("r = 1").groupBy(group).pivot("key", keys).agg(F.first("value"))


def library(rows: DataFrame, group: str, keys: list[str], seq: str, path: str, most: int = 50) -> DataFrame:
    """One entry for each group: voted keys, canonical path, count, and the first ``most`` instances."""
    members = rows.groupBy(group).agg(F.count(F.lit(1)).alias("instance_count"), F.min_by(path, seq).alias("canonical_path"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(seq))).where(F.col("_r") <= most)
    shown = ranked.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(seq, path))), lambda e: e[path]), "|").alias("instances"))
    return majority(rows, group, keys, seq).join(members, group).join(shown, group)


def members(rows: DataFrame, group: str, seq: str, path: str) -> DataFrame:
    """(group, place, path): every instance of every object, in order; what the index shows the first of."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(seq))
    return rows.select(group, place.alias("place"), F.col(path).alias("path"))


def browse(entries: DataFrame, filters: dict[str, str], sort: str | None) -> DataFrame:
    """Entries that meet all non-empty filters, sorted by count or by a key; an unknown sort keeps the order."""
    for column, value in filters.items():
        entries = entries.where(F.col(column) == value) if value else entries
    if sort == "count":
        return entries.orderBy(F.desc("instance_count"))
    return entries.orderBy(F.coalesce(sort, F.lit(""))) if sort in ("category", "color") else entries


def facets(entries: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by value of each column in one pass: (facet, value, n)."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c), F.lit("?")).alias("value")) for c in columns])).alias("c")
    return entries.select(cells).select("c.*").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def html_card(title: Column, path: Column, count: Column) -> Column:
    """One escaped card of the exported page."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit('<div class="card"><h3>'), escaped(title), F.lit("</h3><img src=\""), escaped(path), F.lit('"><p>'), count.cast("string"), F.lit("</p></div>"))
