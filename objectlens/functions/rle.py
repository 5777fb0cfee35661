"""Run-length masks as compressed strings, and polygons as run lengths.

The string form holds each run in groups of five bits with a sign, from the third run on as the
difference to the run two before.  Polygons are drawn on a grid five times as fine.  Both are fixed
formats of the public annotation format; rows go through numpy in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType

FINE = 5


def decode_counts(text: str) -> list[int]:
    """Run lengths of one compressed string."""
    code = np.frombuffer(text.encode(), np.uint8).astype(np.int64) - 48
    if not len(code):
        return []
    last = np.flatnonzero((code & 32) == 0)
    first = np.concatenate([[0], last[:-1] + 1])
    group = np.repeat(np.arange(len(last)), last - first + 1)
    place = np.arange(last[-1] + 1) - first[group]
    value = np.bincount(group, (code[: last[-1] + 1] & 31) * 32.0**place).astype(np.int64)
    value -= np.where(code[last] & 16, 1 << 5 * (last - first + 1), 0)
    for start in (1, 2):
        value[start::2] = np.cumsum(value[start::2])
    return value.tolist()


def encode_counts(counts: list[int]) -> str:
    """The compressed string of run lengths."""
    out = bytearray()
    for i, n in enumerate(counts):
        left = int(n) - (int(counts[i - 2]) if i > 2 else 0)
        while True:
            part, left = left & 31, left >> 5
            more = left != (-1 if part & 16 else 0)
            out.append(part + (32 if more else 0) + 48)
            if not more:
                break
    return out.decode()


def polygon_counts(xy: list[float], height: int, width: int) -> list[int]:
    """Run lengths, in column-major order, of the pixels inside a polygon [x, y, x, y, ..]."""
    x, y = ((np.array(xy[k::2], float) * FINE + 0.5).astype(np.int64) for k in (0, 1))
    u, v = [], []
    for xs, ys, xe, ye in zip(x, y, np.roll(x, -1), np.roll(y, -1), strict=True):
        dx, dy = abs(xe - xs), abs(ye - ys)
        flip = (dx >= dy and xs > xe) or (dx < dy and ys > ye)
        if flip:
            xs, ys, xe, ye = xe, ye, xs, ys
        t = np.arange(max(dx, dy) + 1)
        t = t[::-1] if flip else t
        wide = dx >= dy
        slope = ((ye - ys) / dx if dx else 0.0) if wide else (xe - xs) / dy
        u.append(t + xs if wide else (xs + slope * t + 0.5).astype(np.int64))
        v.append((ys + slope * t + 0.5).astype(np.int64) if wide else t + ys)
    u, v = np.concatenate(u), np.concatenate(v)
    turn = np.flatnonzero(u[1:] != u[:-1]) + 1
    column = (np.where(u[turn] < u[turn - 1], u[turn], u[turn] - 1) + 0.5) / FINE - 0.5
    row = np.ceil(np.clip((np.minimum(v[turn], v[turn - 1]) + 0.5) / FINE - 0.5, 0, height))
    on = (column == np.floor(column)) & (column >= 0) & (column <= width - 1)
    ends = np.sort(np.append(column[on].astype(np.int64) * height + row[on].astype(np.int64), height * width))
    return _merged(np.diff(ends, prepend=0).tolist())


def _merged(counts: list[int]) -> list[int]:
    """Runs between which a run of 0 lies become one."""
    out = counts[:1]
    j = 1
    while j < len(counts):
        if counts[j] > 0:
            out.append(counts[j])
            j += 1
        else:
            j += 1
            if j < len(counts):
                out[-1] += counts[j]
                j += 1
    return out


def union_counts(parts: list[list[int]]) -> list[int]:
    """Run lengths of the union of masks of one size."""
    if not parts:
        return []
    edges = np.concatenate([np.cumsum(p) for p in parts]).astype(np.int64)
    step = np.concatenate([np.where(np.arange(len(p)) % 2 == 0, 1, -1) for p in parts])
    step[np.cumsum([len(p) for p in parts]) - 1] = 0  # the picture's end
    size = int(sum(parts[0]))
    places, at = np.unique(np.append(edges, size), return_inverse=True)
    inside = np.cumsum(np.bincount(at, np.append(step, 0), len(places))) > 0
    change = np.flatnonzero(np.diff(np.concatenate([[False], inside[:-1]])))
    return np.diff(np.concatenate([[0], places[change], [size]])).astype(int).tolist()


@pandas_udf(ArrayType(LongType()))
def rle_decode(text: pd.Series) -> pd.Series:
    """Run lengths of compressed strings; null stays null."""
    return text.map(lambda t: None if t is None else decode_counts(t))


@pandas_udf(StringType())
def rle_encode(counts: pd.Series) -> pd.Series:
    """Compressed strings of run lengths; null stays null."""
    return counts.map(lambda c: None if c is None else encode_counts(c))


@pandas_udf(ArrayType(LongType()))
def rle_from_polygons(polygons: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Run lengths of the union of an object's polygons; polygons of fewer than three points draw nothing."""
    rows = zip(polygons, height, width, strict=True)
    return pd.Series([None if p is None else union_counts([polygon_counts(list(x), int(h), int(w)) if len(x) >= 6 else [int(h * w)] for x in p] or [[int(h * w)]]) for p, h, w in rows])
