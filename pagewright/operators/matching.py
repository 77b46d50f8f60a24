"""Captions of figures and tables: candidate pairs on a page, and their greedy one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.geometry import Box, horizontal_overlap, vertical_distance

PAGE = ["doc_id", "page_number"]
#: Caption classes by kind of item, in both spellings.
CAPTION_CLASSES = {"figure": ["Figure-Caption", "Figure-caption"], "table": ["Table-Caption", "Table-caption"]}
ITEM_CLASSES = {"figure": ["Figure"], "table": ["Table"]}
DIRECTIONS = {"figure": "below", "table": "above"}
MAX_DISTANCE, MIN_OVERLAP = 100.0, 0.3
BOX = ["x1", "y1", "x2", "y2"]


def filter_classes(detections: DataFrame, classes: list[str]) -> DataFrame:
    return detections.where(F.col("class_name").isin(classes))


def kind_of(classes: dict[str, list[str]]) -> Column:
    """``figure`` or ``table`` by class, null for other classes."""
    return F.when(F.col("class_name").isin(classes["figure"]), "figure").when(F.col("class_name").isin(classes["table"]), "table")


def sides(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item_idx, x1 ...) and captions (cap_idx, cx1 ...) by page and kind."""
    item = detections.withColumn("kind", kind_of(ITEM_CLASSES)).where("kind is not null")
    cap = detections.withColumn("kind", kind_of(CAPTION_CLASSES)).where("kind is not null")
    return item.select(*PAGE, "kind", F.col("det_idx").alias("item_idx"), *BOX), cap.select(*PAGE, "kind", F.col("det_idx").alias("cap_idx"), *[F.col(c).alias(f"c{c}") for c in BOX])


def is_valid(item: Box, caption: Box, direction: Column | str, max_distance: float, min_overlap: float) -> Column:
    """On the side searched, near enough and overlapping enough, both limits included."""
    return (vertical_distance(item, caption, direction) <= max_distance) & (horizontal_overlap(item, caption) >= min_overlap)


def candidates(items: DataFrame, captions: DataFrame, directions: dict[str, str] | None = None, max_distance: float = MAX_DISTANCE, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Valid pairs on a page with ``dist``. One equi-join on page and kind, with the geometry as its condition.

    A null coordinate makes a pair invalid.
    """
    directions = directions or DIRECTIONS
    direction = F.when(F.col("kind") == "table", directions["table"]).otherwise(directions["figure"])
    item, cap = Box.of(), Box.of("c")
    pairs = items.join(captions, [*PAGE, "kind"]).where(is_valid(item, cap, direction, max_distance, min_overlap))
    return pairs.select(*PAGE, "kind", "item_idx", "cap_idx", vertical_distance(item, cap, direction).alias("dist"), horizontal_overlap(item, cap).alias("overlap"))


def greedy(pairs: DataFrame) -> DataFrame:
    """The pairs that remain when each is taken in order of distance, then item, then caption, if both are free.

    A page's pairs are folded in one row. A page is what one image can hold, so the group is bounded by nature; the
    only shuffle is on page and kind.
    """
    pair = "struct<d:double,i:bigint,c:bigint>"

    def take(done: Column, p: Column) -> Column:
        return F.when(F.exists(done, lambda x: (x["i"] == p["i"]) | (x["c"] == p["c"])), done).otherwise(F.concat(done, F.array(p)))

    rows = pairs.groupBy(*PAGE, "kind").agg(F.sort_array(F.collect_list(F.struct(F.col("dist").alias("d"), F.col("item_idx").alias("i"), F.col("cap_idx").alias("c")).cast(pair))).alias("all"))
    taken = F.aggregate("all", F.array().cast(f"array<{pair}>"), take)
    return rows.select(*PAGE, "kind", F.explode(taken).alias("p")).select(*PAGE, "kind", F.col("p.i").alias("item_idx"), F.col("p.c").alias("cap_idx"), F.col("p.d").alias("dist"))


def assigned(detections: DataFrame, directions: dict[str, str] | None = None, max_distance: float = MAX_DISTANCE, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """A row for each page: its ``items`` and ``caps`` with kind, place and box, and ``taken``, the greedy pairs of both kinds.

    ``greedy`` over ``candidates``, with everything about a page in one row: detections are read once and shuffled once, by
    page, which later joins on the page keep.
    """
    directions = directions or DIRECTIONS
    role = F.coalesce(kind_of(ITEM_CLASSES), kind_of(CAPTION_CLASSES))
    rows = detections.select(*PAGE, kind_of(ITEM_CLASSES).isNotNull().alias("is_item"), role.alias("kind"), F.struct(role.alias("kind"), F.col("det_idx").cast("bigint").alias("i"), *BOX).alias("d")).where("kind is not null")
    of = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("d"))))
    pages = rows.groupBy(*PAGE).agg(of(F.col("is_item")).alias("items"), of(~F.col("is_item")).alias("caps"))
    pair = "struct<kind:string,d:double,i:bigint,c:bigint>"

    def pairs_of(item: Column) -> Column:
        side = F.when(item["kind"] == "table", directions["table"]).otherwise(directions["figure"])
        fits = F.filter("caps", lambda c: (c["kind"] == item["kind"]) & is_valid(Box.struct(item), Box.struct(c), side, max_distance, min_overlap))
        return F.transform(fits, lambda c: F.struct(item["kind"], vertical_distance(Box.struct(item), Box.struct(c), side), item["i"], c["i"]).cast(pair))

    def take(done: Column, p: Column) -> Column:
        clash = F.exists(done, lambda x: (x["kind"] == p["kind"]) & ((x["i"] == p["i"]) | (x["c"] == p["c"])))
        return F.when(clash, done).otherwise(F.concat(done, F.array(p)))

    pages = pages.withColumn("pairs", F.array_sort(F.flatten(F.transform("items", pairs_of))))
    return pages.select(*PAGE, "items", "caps", F.aggregate("pairs", F.array().cast(f"array<{pair}>"), take).alias("taken"))


def match(detections: DataFrame, **options) -> DataFrame:
    """Every item, with its caption or nulls."""

    def met(item: Column) -> Column:
        return F.get(F.filter("taken", lambda t: (t["kind"] == item["kind"]) & (t["i"] == item["i"])), F.lit(0))

    def row(item: Column) -> Column:
        told = F.transform(F.array(met(item)), lambda t: F.struct(t.alias("t"), F.get(F.filter("caps", lambda c: (c["kind"] == item["kind"]) & (c["i"] == t["c"])), F.lit(0)).alias("c")))
        return F.struct(item.alias("item"), F.element_at(told, 1).alias("to"))

    rows = assigned(detections, **options).select(*PAGE, F.explode(F.transform("items", row)).alias("r"))
    return rows.select(*PAGE, "r.item.kind", F.col("r.to.t.c").alias("cap_idx"), F.col("r.item.i").alias("item_idx"), *[F.col(f"r.item.{c}").alias(c) for c in BOX], F.col("r.to.t.d").alias("dist"), *[F.col(f"r.to.c.{c}").alias(f"c{c}") for c in BOX])


def unmatched_captions(detections: DataFrame, **options) -> DataFrame:
    rest = F.filter("caps", lambda c: ~F.exists("taken", lambda t: (t["kind"] == c["kind"]) & (t["c"] == c["i"])))
    rows = assigned(detections, **options).select(*PAGE, F.explode(rest).alias("c"))
    return rows.select(*PAGE, "c.kind", F.col("c.i").alias("cap_idx"), *[F.col(f"c.{c}").alias(f"c{c}") for c in BOX])


def suppress(detections: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Non-maximum suppression within page and class: in order of confidence, a box stays unless it overlaps one kept."""
    from pagewright.functions.geometry import iou

    row = F.struct((-F.col("confidence")).alias("o"), "det_idx", *BOX, "confidence")
    pages = detections.groupBy(*PAGE, "class_name").agg(F.sort_array(F.collect_list(row)).alias("all"))

    def take(done: Column, d: Column) -> Column:
        return F.when(F.exists(done, lambda x: iou(Box.struct(x), Box.struct(d)) > threshold), done).otherwise(F.concat(done, F.array(d)))

    kept = F.aggregate("all", F.slice("all", F.lit(1), F.lit(0)), take)
    return pages.select(*PAGE, "class_name", F.explode(kept).alias("d")).select(*PAGE, "class_name", "d.det_idx", *[f"d.{c}" for c in BOX], "d.confidence")
