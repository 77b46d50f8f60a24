"""Files of a benchmark: discovery, resolution, manifests and their validation. A listing has a column ``path``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_first(wanted: DataFrame, key: str, candidates: list, listing: DataFrame) -> DataFrame:
    """For each row of ``wanted`` the first of its candidate paths that is listed, else null."""
    tries = wanted.select(key, F.posexplode(F.array(*candidates)).alias("priority", "path")).where("path is not null")
    met = tries.join(listing.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.min_by("path", "priority").alias("resolved"))
    return wanted.join(met, key, "left")


def predictions(documents: DataFrame, listing: DataFrame, base: str, predictions_dir: str) -> DataFrame:
    """The file of each document's predictions: the manifest's, else an extraction, else a plain result."""
    own = F.when(F.length("extraction_path") > 0, F.concat(F.lit(f"{base}/"), "extraction_path"))
    at = F.concat(F.lit(f"{predictions_dir}/"), "name")
    return resolve_first(documents, "name", [own, F.concat(at, F.lit("/extractions/extraction_metadata.json")), F.concat(at, F.lit("/result.json"))], listing)


def page_images(pages: DataFrame, listing: DataFrame) -> DataFrame:
    """The image of each page (doc_id, page_number, dir): numbered with 4, 3, 2 digits or plainly, else any whose name has
    the number."""
    number = lambda form: F.concat("dir", F.format_string(f"/page_{form}.png", "page_number"))
    keyed = pages.withColumn("page_key", F.concat_ws("#", "dir", "page_number"))
    exact = resolve_first(keyed, "page_key", [number("%04d"), number("%03d"), number("%02d"), number("%d")], listing)
    named = listing.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)\.png$", 1).alias("file")).where("file <> ''")
    loose = exact.where("resolved is null").select("page_key", "dir", "page_number").join(named, "dir").where(F.contains("file", F.col("page_number").cast("string"))).groupBy("page_key").agg(F.min("path").alias("loose"))
    return exact.join(loose, "page_key", "left").select(*pages.columns, F.coalesce("resolved", "loose").alias("image_path"))


def to_annotate(results: DataFrame, annotations: DataFrame, skip_existing: bool = True) -> DataFrame:
    """Documents with a result, without those that are annotated."""
    return results.join(annotations, "doc_id", "left_anti") if skip_existing else results


def to_export(directories: DataFrame, annotations: DataFrame) -> DataFrame:
    return directories.join(annotations, "doc_id", "left_semi")


def build(annotations: DataFrame, extractions: DataFrame, name: str = "benchmark", version: str = "1.0") -> DataFrame:
    """Manifest rows, one for each annotated document; the annotator is the first known one by ``ord``."""
    known = annotations.where("annotator <> 'unknown'").agg(F.min_by("annotator", "ord").alias("annotator"))
    found = extractions.select("doc_id", F.lit(True).alias("has"))
    rows = annotations.select("doc_id", F.col("pdf_name").alias("name")).join(found, "doc_id", "left")
    return rows.select("name", F.concat(F.lit("annotations/"), "name", F.lit(".json")).alias("annotation_path"), F.when(F.col("has"), F.concat(F.lit("extractions/"), "name", F.lit(".json"))).alias("extraction_path"), F.lit(name).alias("dataset"), F.lit(version).alias("version")).join(F.broadcast(known))


def validate(documents: DataFrame, listing: DataFrame, base: str) -> DataFrame:
    """Of each document, whether its annotation is there (else invalid) and its extraction (else a warning)."""
    there = listing.select("path").distinct()
    rows = documents.withColumns({"ann": F.concat(F.lit(f"{base}/"), "annotation_path"), "ext": F.concat(F.lit(f"{base}/"), "extraction_path")})
    ann = there.select(F.col("path").alias("ann"), F.lit(True).alias("has_annotation"))
    ext = there.select(F.col("path").alias("ext"), F.lit(True).alias("has_extraction"))
    rows = rows.join(ann, "ann", "left").join(ext, "ext", "left")
    return rows.select("name", F.coalesce("has_annotation", F.lit(False)).alias("valid"), (F.col("ext").isNotNull() & F.col("has_extraction").isNull()).alias("missing_extraction"))


def validity(validated: DataFrame) -> DataFrame:
    """One row for a data set of ``validate``: whether every document is valid, how many are, and which lack a file."""
    listed = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("name"))))
    return validated.agg(F.coalesce(F.bool_and("valid"), F.lit(False)).alias("valid"), F.count("*").alias("total"), F.count_if("valid").alias("valid_documents"), listed(~F.col("valid")).alias("missing_annotations"), listed(F.col("missing_extraction")).alias("missing_extractions"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
