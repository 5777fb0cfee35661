"""Operations on the pixels of masks: boundaries, dilation, distances, holes and point samples.

Masks are spans in column-major order, as in ``masks``.  Pictures of one size are drawn together,
``PIXELS`` at a time, so memory is bounded by that or by one picture.  A null mask counts as an empty
one, a null size as a picture without pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objectlens.functions.masks import piece_sizes, places, span_columns

PIXELS = 1 << 21


def _structs(*names: str) -> tuple[T.ArrayType, pa.DataType]:
    """Lists of structs of whole numbers, for Spark and for Arrow."""
    return T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in names])), pa.list_(pa.struct([(n, pa.int64()) for n in names]))


SPANS, POINTS = _structs("start", "end"), _structs("x", "y")


def _pictures(spans: pa.Array, height: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Masks of one size drawn together, ``PIXELS`` at a time: (rows, boolean [rows, height, width]).

    What lies outside a picture is cut; pictures without pixels are left out.
    """
    number, start, end = span_columns(spans)
    begin = np.cumsum(number) - number
    for h, w in {*zip(height.tolist(), width.tolist(), strict=True)}:
        rows, size = np.flatnonzero((height == h) & (width == w)), h * w
        for lo in range(0, len(rows) if size > 0 else 0, max(1, PIXELS // max(size, 1))):
            own = rows[lo : lo + max(1, PIXELS // size)]
            at, item = places(begin[own], number[own])
            step = np.zeros((len(own), size + 1), np.int32)
            np.add.at(step, (at, np.minimum(start[item], size)), 1)
            np.add.at(step, (at, np.minimum(end[item], size)), -1)
            yield own, (np.cumsum(step, 1)[:, :-1] > 0).reshape(-1, w, h).transpose(0, 2, 1)


def _edges(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of spans, starts, ends) of pictures [n, height, width]."""
    flat = np.pad(masks.transpose(0, 2, 1).reshape(len(masks), -1).astype(np.int8), ((0, 0), (1, 1)))
    turn = np.diff(flat, axis=1)
    row, start = np.nonzero(turn == 1)
    return np.bincount(row, minlength=len(masks)), start, np.nonzero(turn == -1)[1]


def drawn(spans, height: int, width: int) -> np.ndarray:
    """One mask as a boolean picture [height, width]."""
    for _, masks in _pictures(pa.array([spans], SPANS[1]), np.array([height]), np.array([width])):
        return masks[0]
    return np.zeros((height, width), bool)


def spans_of(mask: np.ndarray) -> list[dict[str, int]]:
    _, start, end = _edges(mask[None])
    return [{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True)]


def _around(mask: np.ndarray, before: int, after: int, mode: str = "constant") -> np.ndarray:
    return np.pad(mask, [(0, 0)] * (mask.ndim - 2) + [(before, after)] * 2, mode)


def boundary_of(mask: np.ndarray) -> np.ndarray:
    """Pixels that differ from the one to the right, below, or right below; the picture's rim repeats outwards."""
    p = _around(mask, 0, 1, "edge")
    return (mask != p[..., :-1, 1:]) | (mask != p[..., 1:, :-1]) | (mask != p[..., 1:, 1:])


def dilated_by(mask: np.ndarray, size: int) -> np.ndarray:
    """Pixels with a mask pixel in the square of ``size`` (odd) around them."""
    if size % 2 != 1:
        raise ValueError("a dilation's size is odd")
    p = _around(mask, size // 2 + 1, size // 2).astype(np.int32).cumsum(-2).cumsum(-1)
    return p[..., size:, size:] - p[..., :-size, size:] - p[..., size:, :-size] + p[..., :-size, :-size] > 0


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of each mask pixel to the nearest pixel off the mask; -1 where there is none."""
    h, w = mask.shape[-2:]
    far = (h + w) ** 2 + 1
    gap = np.where(mask, far, 0).astype(np.int64)
    for y in range(1, h):  # along columns, downwards and upwards
        gap[..., y, :] = np.minimum(gap[..., y, :], gap[..., y - 1, :] + 1)
    for y in range(h - 2, -1, -1):
        gap[..., y, :] = np.minimum(gap[..., y, :], gap[..., y + 1, :] + 1)
    best = np.where(gap >= far, far, gap * gap)
    reach = best.copy()
    for k in range(1, w):  # across columns, until no step that long can help
        if k * k >= best.max(initial=0):
            break
        best[..., k:] = np.minimum(best[..., k:], reach[..., :-k] + k * k)
        best[..., :-k] = np.minimum(best[..., :-k], reach[..., k:] + k * k)
    return np.where(best >= far, -1, best)


def _small_parts(masks: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Pixels of 8-connected parts of up to ``most`` pixels, a number for each picture [n, height, width]."""
    n, h, w = masks.shape
    columns = np.zeros((n, w + 1, h + 2), np.int8)
    columns[:, 1:, 1:-1] = masks.transpose(0, 2, 1)
    turn = np.diff(columns.ravel(), append=0)
    low, high = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    few = piece_sizes(low, high, np.full(len(low), h + 2)) <= most[low // ((w + 1) * (h + 2))]
    step = np.zeros(columns.size + 1, np.int32)
    step[low[few] + 1], step[high[few] + 1] = 1, -1
    return (np.cumsum(step)[:-1].reshape(columns.shape)[:, 1:, 1:-1] > 0).transpose(0, 2, 1)


def smoothed(masks: np.ndarray, most: int) -> np.ndarray:
    """Holes of up to ``most`` pixels are filled; then parts of up to ``most`` pixels, and of half the mask at most, go."""
    if most <= 0:
        return masks
    filled = masks | _small_parts(~masks, np.full(len(masks), most))
    return filled & ~_small_parts(filled, np.minimum(most, filled.sum((1, 2)) // 2))


def centre_points(masks: np.ndarray, n: int) -> list[list[dict[str, int]]]:
    """For each picture, points farthest from the mask's edge, the rim and the points before; ties go to the first by row, then column.

    A mask of fewer pixels gives them all.
    """
    left, out = _around(masks, 1, 1), [[] for _ in masks]
    for _ in range(n):
        best = squared_distance(left).reshape(len(left), -1).argmax(1)
        y, x = np.divmod(best, left.shape[-1])
        for i in np.flatnonzero(left.any((1, 2))):
            left[i, y[i], x[i]] = False
            out[i].append({"x": int(x[i]) - 1, "y": int(y[i]) - 1})
    return out


def _sizes(height: pa.Array, width: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return tuple(c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (height, width))


def _reshaped(make):
    """An Arrow function from masks to masks; make: pictures and an argument to pictures."""

    def run(spans: pa.Array, height: pa.Array, width: pa.Array, more: pa.Array) -> pa.Array:
        number, parts = np.zeros(len(spans), np.int64), []
        for rows, masks in _pictures(spans, *_sizes(height, width)):
            found = _edges(make(masks, more[0].as_py()))
            number[rows] = found[0]
            parts.append((rows, *found))
        offset = np.concatenate([[0], np.cumsum(number)])
        start, end = np.zeros((2, offset[-1]), np.int64)
        for rows, own, a, b in parts:
            to = places(offset[rows], own)[1]
            start[to], end[to] = a, b
        return pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))

    return F.arrow_udf(run, SPANS[0])


def _told(make, kind: tuple[T.DataType, pa.DataType], none):
    """An Arrow function from masks to a value; make: pictures and an argument to one value for each."""

    def run(spans: pa.Array, height: pa.Array, width: pa.Array, more: pa.Array) -> pa.Array:
        out = [none] * len(spans)
        for rows, masks in _pictures(spans, *_sizes(height, width)):
            for i, value in zip(rows, make(masks, more[0].as_py()), strict=True):
                out[i] = value
        return pa.array(out, kind[1])

    return F.arrow_udf(run, kind[0])


_boundary = _reshaped(lambda m, _: boundary_of(m))
_dilated = _reshaped(dilated_by)
_smoothed = _reshaped(smoothed)
_centres = _told(centre_points, POINTS, [])
_depth = _told(lambda m, _: np.maximum(squared_distance(m).max((1, 2)), 0).tolist(), (T.LongType(), pa.int64()), 0)


def boundary(spans: Column, height: Column, width: Column) -> Column:
    return _boundary(spans, height, width, F.lit(0))


def dilated(spans: Column, height: Column, width: Column, size: int) -> Column:
    return _dilated(spans, height, width, F.lit(size))


def without_small_parts(spans: Column, height: Column, width: Column, most: int) -> Column:
    return _smoothed(spans, height, width, F.lit(most))


def centres(spans: Column, height: Column, width: Column, n: int) -> Column:
    return _centres(spans, height, width, F.lit(n))


def depth(spans: Column, height: Column, width: Column) -> Column:
    """The largest squared distance of a mask pixel to a pixel off the mask; 0 for an empty mask and for a full picture."""
    return _depth(spans, height, width, F.lit(0))


def f_measure(n_dt: Column, n_gt: Column, dt_hit: Column, gt_hit: Column) -> Column:
    """Boundary F from boundary sizes and the parts of them within the other's dilated boundary."""
    precision = F.when(n_dt == 0, 1.0).when(n_gt == 0, 0.0).otherwise(dt_hit / F.nullif(n_dt, F.lit(0)))
    recall = F.when(n_gt == 0, 1.0).when(n_dt == 0, 0.0).otherwise(gt_hit / F.nullif(n_gt, F.lit(0)))
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))


def seeded(key: Column, draw: int, below: Column) -> Column:
    """An even integer draw from 0 to below - 1, fixed by the key and the number of the draw."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(draw))).cast("binary")), 1, 12), 16, 10).cast("bigint") * below / F.lit(2.0**48)).cast("bigint")


def mask_point(spans: Column, ordinal: Column) -> Column:
    """The place of the mask pixel with this number, from 0, in column-major order; null beyond the mask."""
    # the struct's left falls below zero in the span that holds the pixel
    walked = F.aggregate(
        spans,
        F.struct(ordinal.cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("at")),
        lambda acc, s: F.struct(
            (acc["left"] - (s["end"] - s["start"])).alias("left"),
            F.when(acc["at"].isNull() & (acc["left"] < s["end"] - s["start"]), s["start"] + acc["left"]).otherwise(acc["at"]).alias("at"),
        ),
    )
    return walked["at"]


def box_point(key: Column, draw: int, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """A seeded point of whole numbers in a box, whose upper edges don't belong to it."""
    lo = lambda c: F.ceil(c)
    return lo(x1) + seeded(key, 2 * draw, lo(x2) - lo(x1)), lo(y1) + seeded(key, 2 * draw + 1, lo(y2) - lo(y1))
