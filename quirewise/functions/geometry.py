"""Boxes: structs (x0, y0, x1, y1) in points, y downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rounded


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))])


def hull(b: str = "bbox") -> Column:
    """Aggregate: the smallest box around all."""
    return F.struct(F.min(f"{b}.x0").alias("x0"), F.min(f"{b}.y0").alias("y0"), F.max(f"{b}.x1").alias("x1"), F.max(f"{b}.y1").alias("y1"))


def vertical_overlap(a: Column, b: Column) -> Column:
    """Shared height; negative is the gap between."""
    return F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])


def horizontal_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))


def area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a["x1"] - a["x0"]) * F.greatest(F.lit(0.0), a["y1"] - a["y0"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the smaller area; 0 where that is none."""
    shared = horizontal_overlap(a, b) * F.greatest(F.lit(0.0), vertical_overlap(a, b))
    small = F.least(area(a), area(b))
    return F.when(small > 0, shared / small).otherwise(F.lit(0.0))


def span_box(line: Column, start: Column, end: Column, length: Column) -> Column:
    """A span's box by its share of the line's characters; null for a span outside the text."""
    x = lambda n: line["x0"] + (line["x1"] - line["x0"]) * n / length
    return F.when((length > 0) & (start >= 0) & (start < end) & (end <= length), F.struct(x(start).alias("x0"), line["y0"].alias("y0"), x(end).alias("x1"), line["y1"].alias("y1")))


def resolved_box(line: Column, hits: Column, estimate: Column) -> Column:
    """The search hit inside the line that lies nearest to the estimate, else the estimate, else the line."""
    clip = F.filter(
        F.transform(hits, lambda h: F.struct(F.greatest(h["x0"], line["x0"]).alias("x0"), F.greatest(h["y0"], line["y0"]).alias("y0"), F.least(h["x1"], line["x1"]).alias("x1"), F.least(h["y1"], line["y1"]).alias("y1"))),
        lambda h: (h["x1"] > h["x0"]) & (h["y1"] > h["y0"]),
    )
    middle = (estimate["x0"] + estimate["x1"]) / 2
    near = F.array_min(F.transform(clip, lambda h: F.struct(F.abs((h["x0"] + h["x1"]) / 2 - F.coalesce(middle, (line["x0"] + line["x1"]) / 2)).alias("d"), h.alias("h"))))
    return F.coalesce(near["h"], estimate, line)


def pixel_box(b: Column, scale: float = 2.0) -> Column:
    return F.struct(*[F.bround(b[c] * scale, 0).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])


def rounded_box(b: Column) -> Column:
    return F.struct(*[rounded(b[c]).alias(c) for c in ("x0", "y0", "x1", "y1")])
