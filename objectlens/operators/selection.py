"""Gates, seeded samples, id cascades, splits and pixel ownership, all as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objectlens.functions.shapes import seeded


def needs_inpaint(object_pixels: Column, width: Column, height: Column, least: float = 0.85) -> Column:
    return object_pixels / F.nullif(width * height, F.lit(0)) < least


def can_inpaint(object_pixels: Column, width: Column, height: Column) -> Column:
    """An object of at least 100 pixels with a hole of at least 2% of it."""
    return (object_pixels >= 100) & (width * height - object_pixels >= object_pixels * 0.02)


def box_hint(a: tuple, width: Column, height: Column, factor: float = 1.5) -> tuple[Column, ...]:
    """Enlarged box as normalised (cx, cy, w, h): centres within 0 to 1, sides within 0.01 to 1."""
    x1, y1, x2, y2 = a
    fit = lambda c, low: F.greatest(F.lit(low), F.least(F.lit(1.0), c))
    return fit((x1 + x2) / 2 / width, 0.0), fit((y1 + y2) / 2 / height, 0.0), fit((x2 - x1) * factor / width, 0.01), fit((y2 - y1) * factor / height, 0.01)


def scaled_box(a: tuple, factor: float, width: Column, height: Column) -> tuple[Column, ...]:
    """The box enlarged around its centre and clamped to the picture."""
    x1, y1, x2, y2 = a
    half_w, half_h = (x2 - x1) * factor / 2, (y2 - y1) * factor / 2
    within = lambda c, most: F.greatest(F.least(c, most), F.lit(0))
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    return within(cx - half_w, width), within(cy - half_h, height), within(cx + half_w, width), within(cy + half_h, height)


def refined(old_area: Column, new_area: Column, same_size: Column) -> Column:
    """Whether a refined mask replaces the old one: of the picture's size and larger."""
    return F.coalesce(same_size & (new_area > old_area), F.lit(False))


def compliant(value: Column, most: Column) -> Column:
    """Within a limit; a null limit passes."""
    return most.isNull() | (value <= most)


def cascade(parents: DataFrame, key: str, available: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """Parents that are available, then the rows of each child table whose parent is left."""
    kept = parents.join(available.select(key).distinct(), key, "left_semi")
    ids = kept.select(key).distinct()
    return [kept, *[c.join(ids, key, "left_semi") for c in children]]


def long_masks(boxes: Column, masks: Column, scores: Column, least: int = 4) -> Column:
    """Parallel lists as structs in falling score order, without masks whose text has up to ``least`` characters.

    Equal scores keep the lists' order.
    """
    place = F.sequence(F.lit(0), F.size(masks) - 1)
    entry = F.transform(F.arrays_zip(boxes.alias("box"), masks.alias("mask"), scores.alias("score"), place.alias("at")), lambda e: F.struct((-e["score"]).alias("_k"), e["at"].alias("at"), e["box"].alias("box"), e["mask"].alias("mask"), e["score"].alias("score")))
    kept = F.filter(entry, lambda e: F.length(e["mask"]) > least)
    none = F.filter(entry, lambda e: F.lit(False))
    return F.when(F.size(masks) > 0, F.array_sort(kept)).otherwise(none)


def chosen_ids(asked: Column, known: Column) -> Column:
    """The ids asked for that exist, once each, in order."""
    return F.array_sort(F.array_distinct(F.array_intersect(asked, known)))


def stage_sample(rows: DataFrame, group: str, stage: str, n: int, stride: int, seed: int = 0) -> DataFrame:
    """Rows of n stages of each group, a stride apart from a seeded start.

    Where the stages don't suffice for the stride, the largest stride that fits serves; groups with
    fewer than n stages go.
    """
    stages = rows.select(group, stage).where(F.col(stage).isNotNull()).distinct()
    w = Window.partitionBy(group)
    placed = stages.withColumn("_at", F.row_number().over(w.orderBy(stage)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.least(F.lit(stride), F.floor((F.col("_n") - 1) / max(n - 1, 1))) if n > 1 else F.lit(stride)
    told = placed.where(F.col("_n") >= n).withColumn("_step", step.cast("bigint"))
    start = seeded(F.col(group).cast("string"), seed, F.col("_n") - (n - 1) * F.col("_step"))
    offset = F.col("_at") - start
    kept = told.where((offset >= 0) & (offset <= (n - 1) * F.col("_step")) & (F.pmod(offset, F.col("_step")) == 0))
    return rows.join(kept.select(group, stage), [group, stage], "left_semi")


def round_robin(rows: DataFrame, group: str, order: str, chunks: int) -> DataFrame:
    """Dealt to chunks in turn: ``chunk`` and the place ``slot`` in it."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return rows.withColumn("_at", at).withColumn("chunk", F.col("_at") % chunks).withColumn("slot", F.floor(F.col("_at") / chunks)).drop("_at")


def padded(values: Column, length: Column, fill: Column) -> Column:
    """A list filled up to a length; a longer list stays."""
    return F.concat(values, F.array_repeat(fill, F.greatest(length - F.size(values), F.lit(0)).cast("int")))


def visual_target(key: Column, targets: Column, percent: int) -> Column:
    """A seeded target of a text query, in a seeded share of the queries; null where the query stays a text."""
    pick = F.get(targets, seeded(key, 1, F.size(targets)).cast("int"))
    return F.when((F.size(targets) > 0) & (seeded(key, 0, F.lit(100)) < percent), pick)


def class_split(rows: DataFrame, cls: str, known: DataFrame, distractor: DataFrame) -> DataFrame:
    """Rows with ``split``: known, distractor or unknown, by two tables of class ids.

    An id in both tables is known; a null class has no split.
    """
    ids = lambda df, name: df.select(cls).distinct().withColumn(name, F.lit(True))
    told = rows.join(ids(known, "_known"), cls, "left").join(ids(distractor, "_distractor"), cls, "left")
    split = F.when(F.col(cls).isNull(), None).when(F.col("_known"), "known").when(F.col("_distractor"), "distractor").otherwise("unknown")
    return told.withColumn("split", split).select(*rows.columns, "split")


def owned_pixels(rows: DataFrame, group: str, ident: str, score: str, spans: str) -> DataFrame:
    """(group, ident, area): pixels of each mask after every pixel went to its best-scored mask, ties to the smaller id.

    Spans of a mask don't overlap.  The ends of all spans cut a picture into stretches; a stretch goes to
    one of the masks over it.  Masks that own nothing have area 0; a group is one picture's masks.
    """
    one = rows.select(group, ident, score, F.explode(spans).alias("_s")).select(group, ident, score, F.col("_s.start").alias("_a"), F.col("_s.end").alias("_b"))
    cuts = one.select(group, F.explode(F.array("_a", "_b")).alias("_lo")).distinct()
    pieces = cuts.withColumn("_hi", F.lead("_lo").over(Window.partitionBy(group).orderBy("_lo"))).where("_hi IS NOT NULL")
    over = one.join(pieces, group).where("_a <= _lo AND _hi <= _b")
    best = over.groupBy(group, "_lo", "_hi").agg(F.min_by(ident, F.struct(-F.col(score), F.col(ident))).alias(ident))
    areas = best.groupBy(group, ident).agg(F.sum(F.col("_hi") - F.col("_lo")).alias("area"))
    return rows.select(group, ident).join(areas, [group, ident], "left").fillna(0, ["area"])
