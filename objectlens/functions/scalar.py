"""Small scalar expressions of the catalogue and of prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def presence_score(logit: Column, presence: Column) -> Column:
    """A detection's probability times the probability that the phrase is present at all."""
    return sigmoid(logit) * sigmoid(presence)


def euclidean_similarity(ax: Column, ay: Column, bx: Column, by: Column, zero: float) -> Column:
    """1 at distance 0, falling to 0 at the distance ``zero``."""
    return F.greatest(F.lit(0.0), 1 - F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / zero)


def point_box_distances(px: Column, py: Column, box: tuple) -> Column:
    """Distances of a point to the left, top, right and bottom sides."""
    return F.array(px - box[0], py - box[1], box[2] - px, box[3] - py)


def aspect_size(w: Column, h: Column, size: int, most: int) -> tuple[Column, Column]:
    """(height, width) with the shorter side at ``size``, unless the longer would pass ``most``."""
    short, long = F.least(w, h), F.greatest(w, h)
    side = F.when(long / short * size > most, F.bround(F.lit(float(most)) * short / long).cast("bigint")).otherwise(F.lit(size).cast("bigint"))
    other = lambda a, b: (side * a / b).cast("bigint")
    return F.when(w < h, other(h, w)).otherwise(side), F.when(w < h, side).otherwise(other(w, h))


def data_uri(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def hex_colour(text: Column) -> Column:
    """[r, g, b] of a #rrggbb text."""
    return F.array(*[F.conv(F.substring(text, 2 * k + 2, 2), 16, 10).cast("int") for k in range(3)])


def crop_name(index: Column, kind: str = "crop", ext: str = "jpg") -> Column:
    return F.format_string(f"seg_%02d_{kind}.{ext}", index)
