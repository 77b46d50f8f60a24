"""Labels, colours and legends of drawings: everything about them that is not a pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Colours as blue, green, red.
CLASS_COLORS = {
    "Caption": (0, 165, 255),
    "Footnote": (128, 128, 128),
    "Formula": (255, 0, 255),
    "List-item": (255, 255, 0),
    "Page-footer": (192, 192, 192),
    "Page-header": (192, 192, 192),
    "Picture": (0, 255, 0),
    "Section-header": (0, 0, 255),
    "Table": (255, 0, 0),
    "Text": (0, 255, 255),
    "Title": (128, 0, 128),
    "Plain-Text": (0, 180, 0),
    "Abandon": (64, 64, 64),
    "Figure": (0, 255, 0),
    "Figure-Caption": (0, 200, 255),
    "Table-Caption": (255, 100, 0),
    "Table-Footnote": (128, 128, 128),
    "Isolate-Formula": (255, 0, 255),
    "Formula-Caption": (200, 0, 200),
}
KIND_COLORS = {"figure": (0, 255, 0), "table": (255, 0, 0), "caption": (0, 165, 255)}
KIND_PREFIXES = {"figure": "F", "table": "T", "caption": "C"}
DEFAULT_COLOR = (0, 255, 0)


def palette(spark: SparkSession, colors: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """(name, ord, b, g, r); a palette has as many rows as there are names in the code."""
    rows = [(n, k, *c) for k, (n, c) in enumerate((colors or CLASS_COLORS).items())]
    return spark.createDataFrame(rows, "name string, ord int, b int, g int, r int")


def upsert(colors: DataFrame, changed: dict[str, tuple[int, int, int]]) -> DataFrame:
    """A palette with these colours: known names change in place, new ones come last."""
    new = palette(colors.sparkSession, changed).select("name", F.col("ord").alias("_o"), *[F.col(c).alias(f"_{c}") for c in "bgr"])
    many = F.coalesce(F.max("ord").over(Window.partitionBy()), F.lit(-1)) + 1
    both = colors.join(F.broadcast(new), "name", "full").withColumn("ord", F.coalesce("ord", many + F.col("_o")))
    return both.select("name", "ord", *[F.coalesce(f"_{c}", c).alias(c) for c in "bgr"])


def visualizer(style: str = "class", show_confidence: bool = True):
    """How a drawing labels its boxes: ``numbered`` by kind and number (kind, no, det_idx), any other by class (and confidence)."""
    if style == "numbered":
        return lambda: numbered_label(F.col("kind"), F.col("no"), F.col("det_idx"))
    return lambda: class_label(F.col("class_name"), F.col("confidence") if show_confidence else None)


def colored(rows: DataFrame, name: str, colors: DataFrame, default: tuple[int, int, int] = DEFAULT_COLOR) -> DataFrame:
    """Adds b, g and r by name, the default's for unknown names."""
    looked = F.broadcast(colors.select(F.col("name").alias("_n"), "b", "g", "r"))
    met = rows.join(looked, F.col(name) == F.col("_n"), "left").drop("_n")
    return met.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip("bgr", default, strict=True)})


def class_label(name: Column, confidence: Column | None = None) -> Column:
    """A class's name, with its confidence to two places if given."""
    shown = F.coalesce(name, F.lit("unknown"))
    return shown if confidence is None else F.concat(shown, F.lit(": "), F.format_string("%.2f", F.coalesce(confidence, F.lit(0.0))))


def numbered_label(kind: Column, number: Column, index: Column) -> Column:
    """F1, T2, C3; the place in the list, from 1, for what has no number; ``?`` for an unknown kind."""
    prefix = F.lit("?")
    for k, p in KIND_PREFIXES.items():
        prefix = F.when(kind == k, p).otherwise(prefix)
    return F.concat(prefix, F.coalesce(number, index + 1).cast("string"))


def label_boxes(rows: DataFrame, text_height: int = 12, padding: int = 5) -> DataFrame:
    """Where a label's box goes: over its box, or under the upper edge where it would leave the image."""
    x, y = F.col("x1").cast("int"), F.col("y1").cast("int")
    high = text_height + 2 * padding
    return rows.withColumns({"label_x": x, "label_top": F.when(y - high < 0, y).otherwise(y - high), "label_bottom": F.when(y - high < 0, y + high).otherwise(y)})


def legend(colors: DataFrame, height: int = 400, margin: int = 20, line_height: int = 35, box: int = 25) -> DataFrame:
    """A legend's rows with their offsets, down to the last that fits."""
    placed = colors.withColumn("y", F.lit(margin + 10) + (F.row_number().over(Window.orderBy("ord")) - 1) * line_height)
    return placed.where(F.col("y") + box <= height - 10)


def kind_legend(spark: SparkSession, counts: dict[str, int] | None = None) -> DataFrame:
    """The legend of an annotation's drawing: a row for each kind, with its colour and, if given, how many there are."""
    names = palette(spark, KIND_COLORS).withColumn("label", F.initcap("name"))
    if counts:
        told = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
        names = names.withColumn("label", F.concat("label", F.coalesce(F.concat(F.lit(" ("), F.try_element_at(told, F.col("name")), F.lit(")")), F.lit(""))))
    return legend(names)
