"""Box arithmetic as column expressions. A box is four columns or a struct with x1, y1, x2, y2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        """From columns ``{prefix}x1{suffix}`` and so on."""
        return cls(*[F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")])

    @classmethod
    def struct(cls, box: Column) -> Box:
        return cls(*[box[c] for c in ("x1", "y1", "x2", "y2")])

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    def pack(self) -> Column:
        return F.struct(*[getattr(self, c).alias(c) for c in ("x1", "y1", "x2", "y2")])

    def each(self, change) -> Box:
        return Box(*[change(getattr(self, c)) for c in ("x1", "y1", "x2", "y2")])

def zero() -> Column:
    return F.lit(0.0)

def horizontal_overlap(a: Box, b: Box) -> Column:
    """Shared width over the narrower box's width; 0 for a box without width."""
    narrow = F.least(a.width, b.width)
    shared = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), zero())
    return F.when(narrow > 0, shared / narrow).otherwise(zero())

def vertical_distance(item: Box, caption: Box, direction: Column | str) -> Column:
    """Gap between item and caption on the side searched; null where the caption isn't on that side.

    ``both``: the side on which the caption lies, and 0 for boxes that overlap.
    """
    d = F.lit(direction) if isinstance(direction, str) else direction
    below, above = caption.y1 - item.y2, item.y1 - caption.y2
    return F.when(d == "below", F.when(below >= 0, below)).when(d == "above", F.when(above >= 0, above)).otherwise(F.when(below >= 0, below).when(above >= 0, above).otherwise(zero()))

def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes that only touch."""
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    union = a.width * a.height + b.width * b.height - w * h
    return F.when((w > 0) & (h > 0) & (union > 0), w * h / union).otherwise(zero())

def to_points(box: Box, dpi: float = 200.0) -> Box:
    """Pixels to PDF points."""
    return box.each(lambda c: c * 72.0 / dpi)

def crop(points: Box, page_width: Column, page_height: Column, padding: float = 10.0, dpi: float = 200.0) -> Box:
    """A box in points, padded by that many pixels and clamped to the page."""
    pad = padding * 72.0 / dpi
    return Box(F.greatest(zero(), points.x1 - pad), F.greatest(zero(), points.y1 - pad), F.least(page_width, points.x2 + pad), F.least(page_height, points.y2 + pad))

def thousandths_to_pixels(box: Box, width: Column, height: Column) -> Box:
    """From 0 to 1000 of a page to whole pixels, cut off."""
    to = lambda c, size: (c * size / 1000.0).cast("int")
    return Box(to(box.x1, width), to(box.y1, height), to(box.x2, width), to(box.y2, height))

def percent(box: Box, width: Column, height: Column) -> Column:
    """x, y, width and height as percentages of an image."""
    part = lambda v, size: F.try_divide(v, size) * 100.0
    return F.struct(part(box.x1, width).alias("x"), part(box.y1, height).alias("y"), part(box.width, width).alias("width"), part(box.height, height).alias("height"))
