"""Readers of result, extraction, annotation, manifest and report files, with explicit schemas, and of file listings."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions.text import stem
from pagewright.operators.matching import BOX


def load_config(path: str, spark: SparkSession | None = None) -> dict[str, Any]:
    """Parameters of a YAML file; none without the file. With a session any file system is read, else the driver's. Needs a YAML library."""
    import os

    if spark is not None:
        if not expand(spark, [path])[0]:
            return {}
        text = spark.read.text(path, wholetext=True).first()
        content = text[0] if text else ""
    elif os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            content = f.read()
    else:
        return {}
    import yaml

    return yaml.safe_load(content) or {}


def json_files(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Whole JSON documents; absent fields are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def results(spark: SparkSession, path) -> DataFrame:
    return json_files(spark, path, schemas.RESULT)


def extractions(spark: SparkSession, path) -> DataFrame:
    return json_files(spark, path, schemas.EXTRACTION)


def annotations(spark: SparkSession, path) -> DataFrame:
    return json_files(spark, path, schemas.ANNOTATION)


def manifests(spark: SparkSession, path) -> DataFrame:
    """One row for each document of a manifest."""
    rows = json_files(spark, path, schemas.MANIFEST)
    return rows.select("path", F.col("name").alias("dataset"), "version", "annotator", F.explode("documents").alias("d")).select("path", "dataset", "version", "annotator", "d.*")


def reports(spark: SparkSession, path) -> DataFrame:
    """Summaries of reports; results of single documents are left out."""
    return json_files(spark, path, schemas.REPORT)


def unbox(df: DataFrame, box: str, prefix: str = "") -> DataFrame:
    return df.withColumns({f"{prefix}{c}": F.col(f"{box}.{c}") for c in BOX})


def detections(results: DataFrame) -> DataFrame:
    """Flat detections of results: doc_id is the file's PDF name, det_idx the place on its page."""
    pages = results.select(F.col("pdf_name").alias("doc_id"), F.explode("pages").alias("p"))
    rows = pages.select("doc_id", "p.page_number", F.posexplode("p.detections").alias("det_idx", "d"))
    return unbox(rows.select("doc_id", "page_number", F.col("det_idx").cast("bigint").alias("det_idx"), "d.class_id", "d.class_name", "d.confidence", "d.bbox"), "bbox").drop("bbox")


def pages(results: DataFrame) -> DataFrame:
    return results.select(F.col("pdf_name").alias("doc_id"), F.explode("pages").alias("p")).select("doc_id", "p.page_number", "p.image_path", "p.image_size")


def ground_truth(annotations: DataFrame) -> DataFrame:
    """Matches of annotations with their page: kind ``figure`` and confidence 1 unless told.

    A match without an id or a box of its item is an error, as evaluation needs both; it is raised when the row is read.
    """
    pages = annotations.select(F.col("pdf_name").alias("doc_id"), F.posexplode("pages").alias("page_ord", "p"))
    rows = pages.select("doc_id", "page_ord", "p.page_number", F.posexplode("p.matches").alias("match_ord", "m"))
    whole = F.col("m.figure_id").isNotNull() & F.col("m.figure_bbox").isNotNull()
    rows = rows.withColumn("m", F.when(whole, F.col("m")).otherwise(F.raise_error(F.lit("a match lacks figure_id or figure_bbox"))))
    rows = rows.select("doc_id", "page_number", (F.col("page_ord") * 100_000 + F.col("match_ord")).cast("bigint").alias("gt_ord"), "m.figure_id", F.coalesce("m.figure_type", F.lit("figure")).alias("kind"), "m.caption_id", "m.caption_text", F.coalesce("m.confidence", F.lit(1.0)).alias("confidence"), "m.figure_bbox", "m.caption_bbox")
    return unbox(unbox(rows, "figure_bbox"), "caption_bbox", "g").drop("figure_bbox", "caption_bbox")


def predicted(extractions: DataFrame) -> DataFrame:
    """Items of extractions with ``pred_ord``, figures before tables."""
    def side(name: str, base: int) -> DataFrame:
        rows = extractions.select(F.col("pdf_name").alias("doc_id"), F.posexplode(name).alias("o", "i"))
        return rows.select("doc_id", (F.col("o") + base).cast("bigint").alias("pred_ord"), "i.*")

    both = side("figures", 0).unionByName(side("tables", 1_000_000_000))
    return unbox(unbox(both, "item_bbox"), "caption_bbox", "c").drop("item_bbox", "caption_bbox")


def pdf_files(spark: SparkSession, directory: str) -> DataFrame:
    """(path, name, content) of a directory's PDFs. Names are stems; without content read, it is only a listing."""
    files = spark.read.format("binaryFile").load(f"{directory}/*.pdf")
    return files.select("path", stem(F.col("path")).alias("name"), "length", "content")


def listing(spark: SparkSession, directory: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length) of files; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(directory).select("path", "length")


def by_name(files: DataFrame) -> DataFrame:
    """Files in the order of their paths."""
    return files.orderBy("path")


def expand(spark: SparkSession, patterns: list[str]) -> tuple[list[str], list[str]]:
    """Paths that patterns stand for, in order and once, and the patterns that stand for none; ``*`` also crosses folders as ``**``.

    A pattern is resolved by the file system it names, a plain path stands for itself if it is there.
    """
    found, missing = [], []
    for pattern in patterns:
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern.replace("**/", "*/"))
        met = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
        paths = sorted(str(x.getPath()) for x in met or [])
        found += [x for x in paths if x not in found]
        missing += [] if paths else [pattern]
    return found, missing


def expand_pages(files: DataFrame, selected: list[int] | None = None) -> DataFrame:
    """A row for each 0-based page of files (n_pages); selected pages that a file doesn't have are left out."""
    every = files.where("n_pages > 0").withColumn("page_index", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)))
    return every if selected is None else every.where(F.col("page_index").isin(selected))
