"""Sinks: nested JSON documents, tables by document, reports and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.matching import BOX

#: An interface for the labelling tool, made for the tasks of ``operators.export``.
LABELING_CONFIG = """<View>
  <Image name="image" value="$image" zoom="true"/>
  <RectangleLabels name="bbox" toName="image">
    <Label value="Figure" background="green"/>
    <Label value="Table" background="blue"/>
    <Label value="Caption" background="orange"/>
  </RectangleLabels>
  <Relations>
    <Relation value="has_caption"/>
  </Relations>
</View>"""


def write_json(rows: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """One JSON object a row; ``by`` gives a folder for each value. Null fields are kept, as files have them."""
    writer = rows.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(by) if by else writer).json(path)


def write_table(rows: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_text(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report's one row as a text file."""
    report.coalesce(1).write.mode(mode).text(path)


def boxed(prefix: str = "") -> Column:
    """The box of four columns as a struct, null where it is."""
    first = F.col(f"{prefix}x1")
    return F.when(first.isNotNull(), F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in BOX]))


def extraction_documents(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Items by document as extraction files nest them. ``items`` have ids, kinds, boxes and caption texts."""
    item = F.struct("item_id", F.col("kind").alias("item_type"), "page_number", boxed().alias("item_bbox"), "caption_text", boxed("c").alias("caption_bbox"))
    ordered = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("page_number", "item_idx", item.alias("item"))))), lambda x: x["item"])
    rows = items.groupBy("doc_id").agg(ordered("figure").alias("figures"), ordered("table").alias("tables"))
    stats = F.struct("total_figures", "figures_with_captions", "total_tables", "tables_with_captions").alias("statistics")
    return rows.join(counts, "doc_id").select(F.col("doc_id").alias("pdf_name"), stats, "figures", "tables")
