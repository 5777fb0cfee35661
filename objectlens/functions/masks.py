"""Masks as spans: arrays of (start, end) places in column-major order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objectlens.operators.reshape import rle_intersection


def span_area(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, t: s + t["end"] - t["start"])


def mask_iou(a: Column, b: Column) -> Column:
    """Intersection over union, the union being at least 1."""
    both = rle_intersection(a, b)
    return both / F.greatest(span_area(a) + span_area(b) - both, F.lit(1))


def mask_iom(a: Column, b: Column) -> Column:
    """Intersection over the smaller area, that being at least 1."""
    return rle_intersection(a, b) / F.greatest(F.least(span_area(a), span_area(b)), F.lit(1))


def mask_box(spans: Column, height: Column) -> Column:
    """(x1, y1, x2, y2) with inclusive maxima; an empty mask has zeros."""
    x1 = F.array_min(F.transform(spans, lambda s: F.floor(s["start"] / height)))
    x2 = F.array_max(F.transform(spans, lambda s: F.floor((s["end"] - 1) / height)))
    # a span that goes over a column's end touches its last and the next one's first row
    wraps = lambda s: F.floor(s["start"] / height) < F.floor((s["end"] - 1) / height)
    y1 = F.array_min(F.transform(spans, lambda s: F.when(wraps(s), 0).otherwise(s["start"] % height)))
    y2 = F.array_max(F.transform(spans, lambda s: F.when(wraps(s), height - 1).otherwise((s["end"] - 1) % height)))
    return F.array(*[F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")) for c in (x1, y1, x2, y2)])


def semantic_union(rows: DataFrame, group: str, spans: str) -> DataFrame:
    """(group, spans): pixels in any mask of a group, as sorted spans that don't touch."""
    one = rows.select(group, F.explode(spans).alias("_s")).select(group, F.col("_s.start").alias("start"), F.col("_s.end").alias("end"))
    w = Window.partitionBy(group).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = one.withColumn("_new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    islands = marked.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(group, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def span_columns(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of spans by row, starts, ends) of a list column; a null has none."""
    flat = spans.flatten()
    part = lambda n: pc.struct_field(flat, n).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), part("start"), part("end")


def places(begin: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each item of rows that hold ``number`` items from ``begin`` on."""
    row = np.repeat(np.arange(len(begin)), number)
    return row, np.repeat(begin - (np.cumsum(number) - number), number) + np.arange(number.sum())


def piece_sizes(low: np.ndarray, high: np.ndarray, stride: np.ndarray) -> np.ndarray:
    """Pixels of the 8-connected component of each column piece.

    low, high: rising ends of pieces that neither overlap nor touch, on a line where every column starts
    ``stride`` (two more than the height) after the one before; an empty column keeps pictures apart.
    """
    first = np.searchsorted(high, low - stride, "left")  # neighbours in the column before
    number = np.maximum(np.searchsorted(low, high - stride, "right") - first, 0)
    here, before = places(first, number)
    label = np.arange(len(low))
    while True:
        a, b = label[here], label[before]
        if (a == b).all():
            return np.bincount(label, high - low, len(low))[label].astype(np.int64)
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]


def cut_pieces(number: np.ndarray, start: np.ndarray, end: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pieces by row, starts, ends, component sizes) of rows of spans, cut at column ends; a row without a height has none."""
    owner = np.repeat(np.arange(len(number)), number)
    use = (end > start) & (height[owner] > 0)
    owner, start, end = owner[use], start[use], end[use]
    own = height[owner]
    first = start // own
    span, column = places(first, (end - 1) // own - first + 1)
    owner, own = owner[span], own[span]
    low, high = np.maximum(start[span] - column * own, 0), np.minimum(end[span] - column * own, own)
    wide = np.zeros(len(number), np.int64)
    np.maximum.at(wide, owner, column + 2)
    length = wide * (height + 2)
    line = (np.cumsum(length) - length)[owner] + (column + 1) * (own + 2)
    order = np.argsort(line + low, kind="stable")
    size = piece_sizes((line + low)[order], (line + high)[order], (own + 2)[order])
    return np.bincount(owner, minlength=len(number)), (column * own + low)[order], (column * own + high)[order], size


def component_sizes(spans: list[tuple[int, int]], height: int) -> list[tuple[int, int, int]]:
    """(start, end, size of its 8-connected component) of every column piece of one mask."""
    start, end = np.array(spans, np.int64).reshape(-1, 2).T
    found = cut_pieces(np.array([len(start)]), start, end, np.array([height]))[1:]
    return list(zip(*(c.tolist() for c in found), strict=True))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "size")])))
def grid_components(spans: pa.Array, height: pa.Array) -> pa.Array:
    """Column pieces of a mask with their component's size; a null mask or a null height has none."""
    number, *parts = cut_pieces(*span_columns(spans), height.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    offset = np.concatenate([[0], np.cumsum(number)])
    return pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in parts], ["start", "end", "size"]))


def without_sprinkles(pieces: Column, most: int) -> Column:
    """Pieces whose component has more than ``most`` pixels."""
    return F.filter(pieces, lambda p: p["size"] > most)
