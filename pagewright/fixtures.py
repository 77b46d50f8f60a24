"""Detections and ground truth derived from the driver's ``events`` by integer arithmetic, for the queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.matching import BOX, PAGE, match
from pagewright.operators.matching import sides as sides_of


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, det_idx, class_name, confidence, x1 ..., event_id."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("k"), F.round(F.col("value") * 100).cast("bigint").alias("v"))
    d = raw.selectExpr(
        "k", "v", "k div 120 as doc_id", "(k % 120) div 12 + 1 as page_number", "k % 12 as det_idx",
        "(k*31+v) % 100 as c", "(k*17+v) % 3 as lane", "(k*13+v*7) % 8 as h1", "(k*11+v*3) % 6 as h2", "(k*7+v*5) % 10 as h3",
    )
    d = d.selectExpr("*", "case when c < 28 then 'Figure' when c < 58 then 'Figure-Caption' when c < 72 then 'Table' when c < 90 then 'Table-Caption' when c < 96 then 'Plain-Text' else 'Title' end as class_name", "80 + 180*lane + 10*h2 as bx", "100 + 55*det_idx + 5*h1 as by")
    return d.selectExpr(
        "k as event_id", "doc_id", "page_number", "det_idx", "class_name", "0.25D + (v % 7500) / 10000.0D as confidence",
        "cast(bx as double) as x1", "cast(by as double) as y1", "cast(bx + 200 + 40*h3 as double) as x2",
        "cast(case when class_name in ('Figure','Table') then by + 50 + 10*h2 else by + 20 + 5*h2 end as double) as y2",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten pages of every document that has an event."""
    docs = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id div 120 as doc_id").distinct()
    return docs.select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(10).cast("bigint"))).alias("page_number"))


def predictions(det: DataFrame) -> DataFrame:
    """Matched items with ``pred_ord``: figures before tables, each in page order."""
    order = F.when(F.col("kind") == "figure", F.lit(0)).otherwise(F.lit(1_000_000_000)).cast("bigint") + F.col("page_number") * 100 + F.col("item_idx")
    return match(det).withColumn("pred_ord", order)


def ground_truth(det: DataFrame) -> DataFrame:
    """A row for each item: kind, boxes x1 ... and gx1 ... (of the caption, nullable), confidence, ids, ``gt_ord``."""
    item = match(det).withColumn("k", F.col("doc_id") * 120 + (F.col("page_number") - 1) * 12 + F.col("item_idx"))
    t = item.selectExpr("*", "(k*29+7) % 20 as g", "((k*37) % 50 + 50) / 100.0D as confidence", "cast(6*((k*5) % 4) as double) as dx", "cast(5*((k*3) % 3) as double) as dy")
    none = "g < 2 or (cap_idx is null and g >= 6)"
    far = "when g < 4 then 300.0D else dx"
    t = t.selectExpr(
        *PAGE, "kind", "k as gt_ord", "confidence", "x1 + dx as x1", "y1 + dy as y1", "x2 + dx as x2", "y2 + dy as y2",
        f"case when {none} then null when cap_idx is null then x1 else cx1 + case {far} end end as gx1", f"case when {none} then null when cap_idx is null then y2 + 10.0D else cy1 end as gy1",
        f"case when {none} then null when cap_idx is null then x2 else cx2 + case {far} end end as gx2", f"case when {none} then null when cap_idx is null then y2 + 40.0D else cy2 end as gy2",
        "concat('gt_', k) as figure_id",
    )
    return t.withColumn("caption_id", F.when(F.col("gx1").isNotNull(), F.concat(F.lit("cap_"), "gt_ord")))


__all__ = ["BOX", "detections", "ground_truth", "pages", "predictions", "sides_of"]
