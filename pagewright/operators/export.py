"""Annotations as tasks of a labelling tool: regions, relations, addresses of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import Box, percent
from pagewright.operators.matching import BOX, PAGE

#: Size of an image that can't be read: A4 at 200 DPI. Fixed values.
DEFAULT_SIZE = (1654, 2339)


def local_url(path: Column) -> Column:
    return F.concat(F.lit("/data/local-files/?d=images/"), path)


def bucket_url(endpoint: str, bucket: str, path: Column, secure: bool = False) -> Column:
    return F.concat(F.lit(f"http{'s' if secure else ''}://{endpoint}/{bucket}/"), path)


def box_lookup(extracted: DataFrame, detected: DataFrame) -> DataFrame:
    """A box by document and item id: the extraction's where it has one, else the detection's."""
    cols = ["doc_id", "item_id", "kind", "page_number", *BOX]
    both = extracted.select(*cols, F.lit(0).alias("source")).unionByName(detected.select(*cols, F.lit(1).alias("source")))
    order = Window.partitionBy("doc_id", "item_id").orderBy("source", "page_number")
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def png_size(content: Column) -> Column:
    """``struct<width,height>`` from a PNG's header, null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    size = F.struct(number(17).alias("width"), number(21).alias("height"))
    return F.when((F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.octet_length(content) >= 24), size)


def measured(images: DataFrame) -> DataFrame:
    """Images (content) with the ``width`` and ``height`` that they have, the usual ones where that can't be told."""
    size = images.withColumn("_s", png_size(F.col("content")))
    return sizes(size.withColumns({"width": F.col("_s.width"), "height": F.col("_s.height")}).drop("_s"))


def sizes(images: DataFrame) -> DataFrame:
    return images.withColumns({"width": F.coalesce("width", F.lit(DEFAULT_SIZE[0])), "height": F.coalesce("height", F.lit(DEFAULT_SIZE[1]))})


def page_regions(pages: DataFrame, width: int = DEFAULT_SIZE[0], height: int = DEFAULT_SIZE[1]) -> DataFrame:
    """Pages of ``annotation.annotate`` with ``regions`` in order: each match's item and caption, then unmatched figures, tables
    and captions.

    Items without a box give none, and loose items that a match has shown aren't shown again. A page's own ``width`` and
    ``height``, where it has such columns, are used instead of those given.
    """
    own = {c: F.coalesce(F.col(c), F.lit(v)) if c in pages.columns else F.lit(v) for c, v in (("width", width), ("height", height))}
    box = lambda x, prefix="": percent(Box(*[x[f"{prefix}{c}"] for c in BOX]), own["width"].cast("double"), own["height"].cast("double"))
    region = lambda there, part, o, sub, item, label, value: F.when(there, F.struct(part.alias("part"), o.cast("bigint").alias("o"), sub.alias("sub"), item.alias("item_id"), label.alias("label"), value.alias("value")))
    item = lambda m: region(m["x1"].isNotNull(), F.lit(0), m["ord"], F.lit(0), m["figure_id"], F.when(m["kind"] == "table", "Table").otherwise("Figure"), box(m))
    cap = lambda m: region(m["caption_id"].isNotNull() & m["cx1"].isNotNull(), F.lit(0), m["ord"], F.lit(1), m["caption_id"], F.lit("Caption"), box(m, "c"))
    part = lambda u: F.when(u["kind"] == "figure", 1).when(u["kind"] == "table", 2).otherwise(3)
    rest = lambda u: region(u["x1"].isNotNull(), part(u), u["no"], F.lit(0), u["item_id"], F.initcap(u["kind"]), box(u))
    some = lambda rows: F.filter(rows, lambda r: r.isNotNull())
    shown = pages.withColumn("shown", some(F.flatten(F.transform("matches", lambda m: F.array(item(m), cap(m))))))
    loose = F.filter(some(F.transform("unmatched", rest)), lambda r: ~F.exists("shown", lambda x: x["item_id"] == r["item_id"]))
    placed = shown.withColumn("regions", F.array_sort(F.concat("shown", loose), lambda a, b: _order(a, b))).drop("shown")
    return placed.withColumn("regions", F.transform("regions", lambda r, i: F.struct(F.concat(F.lit("region_"), i + 1).alias("region_id"), *[r[c].alias(c) for c in ("item_id", "label", "part", "o", "sub", "value")])))


def _order(a: Column, b: Column) -> Column:
    """By part, then place, then item before caption."""
    out = F.lit(0)
    for c in ("sub", "o", "part"):
        out = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
    return out


def regions(pages: DataFrame) -> DataFrame:
    """The regions of ``page_regions``, one a row."""
    return pages.select(*PAGE, F.explode("regions").alias("r")).select(*PAGE, "r.*")


def links(regions: Column) -> Column:
    """From each matched item to its caption, in the regions of one page."""
    to = lambda r: F.get(F.filter(regions, lambda x: (x["part"] == 0) & (x["sub"] == 1) & (x["o"] == r["o"])), F.lit(0))["region_id"]
    pairs = F.transform(F.filter(regions, lambda r: (r["part"] == 0) & (r["sub"] == 0)), lambda r: F.struct(r["region_id"].alias("from_id"), to(r).alias("to_id"), F.lit("has_caption").alias("label")))
    return F.filter(pairs, lambda p: p["to_id"].isNotNull())


def relations(pages: DataFrame) -> DataFrame:
    """The relations of ``page_regions``, one a row."""
    return pages.select(*PAGE, F.explode(links(F.col("regions"))).alias("l")).select(*PAGE, "l.*")


def tasks(pages: DataFrame, url: Column, model: str = "VLM") -> DataFrame:
    """One nested task for each page of ``page_regions`` that has regions; ``url`` is an expression over doc_id and page_number."""
    shape = F.transform("regions", lambda r: F.struct(*[r[c].alias(c) for c in ("region_id", "item_id", "label", "value")]))
    return pages.where(F.size("regions") > 0).select(F.struct(url.alias("image"), "doc_id", "page_number").alias("data"), F.struct(F.lit(model).alias("model_version"), shape.alias("regions"), links(F.col("regions")).alias("relations")).alias("prediction"))
