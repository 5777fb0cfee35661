"""Filters, joins, limits and id spaces of the catalogue and of evaluation inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resume(todo: DataFrame, done: DataFrame, key: str, retry: Column | None = None) -> DataFrame:
    """What is to be done still: todo minus done; rows of done that ``retry`` marks don't count."""
    return todo.join((done.where(~retry) if retry is not None else done).select(key).distinct(), key, "left_anti")


def positive_split(det: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions of categories that the image's ground truth has."""
    return det.join(gt.select(*keys).distinct(), keys, "left_semi")


def exhaustive_only(first: DataFrame, others: list[DataFrame], key: str, flag: str) -> DataFrame:
    """Images exhaustive in the first ground truth and not marked otherwise in any other."""
    out = first.where(F.col(flag))
    for other in others:
        out = out.join(other.where(~F.col(flag)).select(key).distinct(), key, "left_anti")
    return out


def top_k(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def dedupe_first_rank(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Of several sources, the first that has a key wins it whole."""
    best = rows.groupBy(*keys).agg(F.min(rank).alias("_best"))
    return rows.join(best, keys).where(F.col(rank) == F.col("_best")).drop("_best")


def merged_categories(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Category through a mapping (column, target); unmapped ones stay."""
    return rows.join(mapping, column, "left").withColumn(column, F.coalesce("target", column)).drop("target")


def bucketed(value: Column, edges: list[tuple[str, float, float]]) -> Column:
    """Name of the half-open range [low, high) that holds a value."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(edges):
        out = F.when((value >= low) & (value < high), name).otherwise(out)
    return out


def dense_ids(rows: DataFrame, group: str, column: str, name: str) -> DataFrame:
    """Ids 0..n-1 of a column's values within each group."""
    return rows.withColumn(name, F.dense_rank().over(Window.partitionBy(group).orderBy(column)) - 1)


def one_based(rows: DataFrame, column: str) -> DataFrame:
    """Ids shifted by one if any of them is 0."""
    shift = rows.agg(F.coalesce(F.max((F.col(column) == 0).cast("int")), F.lit(0)).alias("_shift"))
    return rows.crossJoin(F.broadcast(shift)).withColumn(column, F.col(column) + F.col("_shift")).drop("_shift")  # one row


def masklet_cap(rows: DataFrame, group: str, track: str, cap: int) -> DataFrame:
    """Videos with at most cap tracks."""
    few = rows.groupBy(group).agg(F.countDistinct(track).alias("_n")).where(F.col("_n") <= cap).select(group)
    return rows.join(few, group, "left_semi")
