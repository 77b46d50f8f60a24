"""Extracted items: numbering, coordinates, crops, texts and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import Box, crop, to_points
from pagewright.functions.text import item_id, strip
from pagewright.operators.matching import BOX, PAGE, match


def numbered(items: DataFrame) -> DataFrame:
    """``item_no`` by document and kind, running over its pages, and the id with it."""
    order = Window.partitionBy("doc_id", "kind").orderBy("page_number", "item_idx")
    return items.withColumn("item_no", F.row_number().over(order)).withColumn("item_id", item_id(F.col("kind"), F.col("page_number"), F.col("item_no")))


def numbered_on_page(detections: DataFrame, caption_classes: list[str]) -> DataFrame:
    """``kind``, ``no`` from 1 within page and kind, and the id with it; captions of all classes are one kind."""
    kind = F.when(F.col("class_name") == "Figure", "figure").when(F.col("class_name") == "Table", "table").when(F.col("class_name").isin(caption_classes), "caption")
    rows = detections.withColumn("kind", kind).where("kind is not null")
    order = Window.partitionBy(*PAGE, "kind").orderBy("det_idx")
    return rows.withColumn("no", F.row_number().over(order)).withColumn("item_id", item_id(F.col("kind"), F.col("page_number"), F.col("no")))


def extract(detections: DataFrame, pages: DataFrame | None = None, **options) -> DataFrame:
    """Items with ids and captions. With ``pages (doc_id, page_number)``, items of other pages are skipped."""
    if pages is not None:
        detections = detections.join(pages.select(*PAGE), PAGE, "left_semi")
    return numbered(match(detections, **options))


def page_texts(items: DataFrame, words: DataFrame) -> DataFrame:
    """``item_text``: a page's words whose middle is in the item's box, in order, joined by spaces."""
    middle_x, middle_y = (F.col("wx1") + F.col("wx2")) / 2, (F.col("wy1") + F.col("wy2")) / 2
    inside = (middle_x >= F.col("x1")) & (middle_x <= F.col("x2")) & (middle_y >= F.col("y1")) & (middle_y <= F.col("y2"))
    placed = words.select(*PAGE, "word_ord", F.col("text").alias("word"), *[F.col(c).alias(f"w{c}") for c in BOX])
    met = items.select(*PAGE, "item_id", *BOX).join(placed, PAGE).where(inside)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_ord", "word"))), lambda x: x["word"]), " ")
    return items.join(met.groupBy(*PAGE, "item_id").agg(strip(text).alias("item_text")), [*PAGE, "item_id"], "left")


def crops(items: DataFrame, page_width: float = 612.0, page_height: float = 792.0, padding: float = 10.0, dpi: float = 200.0) -> DataFrame:
    """Each item's rectangle to cut from its page, in points."""
    box = crop(to_points(Box.of(), dpi), F.lit(page_width), F.lit(page_height), padding, dpi)
    return items.select(*[c for c in items.columns if c not in BOX], *[getattr(box, c).alias(c) for c in BOX])


def statistics(items: DataFrame) -> DataFrame:
    """By document: figures, tables, and those whose caption has a text that isn't empty."""
    told = F.length("caption_text") > 0
    count = lambda kind, *more: F.count_if(F.when(F.col("kind") == kind, more[0] if more else F.lit(True)).otherwise(False))
    return items.groupBy("doc_id").agg(count("figure").alias("total_figures"), count("figure", told).alias("figures_with_captions"), count("table").alias("total_tables"), count("table", told).alias("tables_with_captions"))
