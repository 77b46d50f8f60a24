"""Counts and means of detections by page, class and document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_of_parts(value: Column, parts: int = 10_000) -> Column:
    """A mean over whole parts, added as integers and divided once, so that the order of rows doesn't matter."""
    return F.sum(F.round(value * parts).cast("bigint")).cast("double") / F.count(value) / float(parts)


def by_page_and_class(detections: DataFrame) -> DataFrame:
    return detections.groupBy("doc_id", "page_number", "class_name").agg(F.count("*").alias("n"))


def by_page(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections of every page, 0 for pages without one."""
    counts = detections.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"))
    return pages.select("doc_id", "page_number").join(counts, ["doc_id", "page_number"], "left").select("doc_id", "page_number", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def by_class(detections: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Count and mean confidence of each class."""
    return detections.groupBy(*keys, "class_name").agg(F.count("*").alias("n"), mean_of_parts(F.col("confidence")).alias("average_confidence"))


def by_document(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """Pages, detections and detections a page of each document."""
    return by_page(pages, detections).groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.sum("n").alias("total_detections")).withColumn("average_detections_per_page", F.col("total_detections").cast("double") / F.col("total_pages"))


def summary(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """One row over all documents; a mean of 0 without pages."""
    docs = by_document(pages, detections)
    return docs.agg(F.count("*").alias("total_documents"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("total_pages"), F.coalesce(F.sum("total_detections"), F.lit(0)).alias("total_detections")).withColumn("average_detections_per_page", F.when(F.col("total_pages") > 0, F.col("total_detections").cast("double") / F.col("total_pages")).otherwise(F.lit(0.0)))


def class_ranking(detections: DataFrame) -> DataFrame:
    """Classes by count, then by where they are first seen. There are few classes, so one task ranks them."""
    seen = detections.groupBy("class_name").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "page_number", "det_idx")).alias("first"))
    return seen.select("class_name", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("bigint").alias("rank"))


def rollup(detections: DataFrame) -> DataFrame:
    """Counts by document and class, by document, and in all, in one pass; an extension."""
    return detections.rollup("doc_id", "class_name").agg(F.count("*").alias("n"))


def nested(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """The statistics of each document as a result file nests them, with means and counts rounded as there."""
    classes = by_class(detections).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class_name", F.col("n").cast("int"))))).alias("by_class"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("class_name", F.round("average_confidence", 4))))).alias("average_confidence_by_class"))
    by = by_page(pages, detections).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("page_number").cast("string"), F.col("n").cast("int"))))).alias("by_page"))
    docs = by_document(pages, detections).join(classes, "doc_id", "left").join(by, "doc_id", "left")
    none = F.create_map().cast
    return docs.select("doc_id", F.col("total_pages").cast("int"), F.struct(F.col("total_detections").cast("int").alias("total_detections"), F.coalesce("by_class", none("map<string,int>")).alias("by_class"), "by_page", F.coalesce("average_confidence_by_class", none("map<string,double>")).alias("average_confidence_by_class"), F.round("average_detections_per_page", 2).alias("average_detections_per_page")).alias("statistics"))
