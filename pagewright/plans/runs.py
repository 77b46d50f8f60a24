"""Whole runs, composed of the operators: processing, annotation, evaluation, export.

What calls a backend (pages, detectors, models) is written once and read again, so that no later step repeats a call. A
folder has one file of each document; the driver sees counts only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import iso_time, stem
from pagewright.operators import annotation, evaluation, export, extraction, manifest, matching, stats
from pagewright.operators.matching import BOX, PAGE
from pagewright.sources import backends, readers, writers

CAPTIONS = [c for classes in matching.CAPTION_CLASSES.values() for c in classes]


def page_results(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """``doc_id, page_number, page``: each page with its detections in order and their number; a size that isn't told is null."""
    d = F.struct("det_idx", F.struct("class_id", "class_name", "confidence", F.struct(*BOX).alias("bbox")).alias("d"))
    held = detections.groupBy(*PAGE).agg(F.sort_array(F.collect_list(d)).alias("held"))
    rows = pages.select(*PAGE, "image_path", "width", "height").join(held, PAGE, "left")
    every = F.coalesce(F.transform("held", lambda x: x["d"]), F.array().cast(rows.select(F.transform("held", lambda x: x["d"])).schema[0].dataType))
    size = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.struct("width", "height"))
    return rows.select(*PAGE, F.struct("page_number", "image_path", size.alias("image_size"), F.size(every).alias("num_detections"), every.alias("detections")).alias("page"))


def document_results(pages: DataFrame, detections: DataFrame, model: str, processed_at: Column, seconds: Column | None = None) -> DataFrame:
    """Results by document as result files nest them: pages in order, statistics; a time of 0 counts as untold."""
    held = page_results(pages, detections).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_number", F.to_json("page").alias("p")))), lambda x: x["p"]).alias("held"))
    kind = page_results(pages, detections).schema["page"].dataType
    took = F.lit(None).cast("double") if seconds is None else F.when(seconds != 0, seconds)
    rows = held.join(stats.nested(pages, detections), "doc_id")
    return rows.select(F.col("doc_id").alias("pdf_name"), "total_pages", F.lit(model).alias("model"), processed_at.alias("processed_at"), took.alias("processing_time_seconds"), F.transform("held", lambda p: F.from_json(p, kind)).alias("pages"), "statistics")


def per_document(rows: DataFrame, path: str) -> None:
    """A JSON file for each row of ``rows (pdf_name, ...)``, in a folder of its document."""
    writers.write_json(rows.withColumn("document", F.col("pdf_name")), path, by="document", mode="overwrite")


@dataclass
class Processed:
    """What a run over files leaves: detections, extracted items, a row for each file, and one for all."""

    detections: DataFrame
    items: DataFrame
    outcome: DataFrame
    summary: DataFrame


def process(files: DataFrame, source: backends.PageSource, detector: backends.Detector, out: str, model: str = "detector", minimum: float = 0.25, words: DataFrame | None = None, selected: list[int] | None = None) -> Processed:
    """Pages, detections, statistics, matched captions and extraction metadata of files (name, content), below ``out``.

    A file that fails is a row of the outcome with its error, and the others go on. ``selected`` are 0-based pages.
    ``words`` (doc_id, page_number, word_ord, text, x1 ...) give the items' captions their texts.
    """
    spark = files.sparkSession
    pages = backends.rasterise(files, source).withColumnRenamed("name", "doc_id")
    if selected is not None:
        pages = pages.where(F.col("page_number").isNull() | (F.col("page_number") - 1).isin(selected))
    writers.write_table(pages, f"{out}/pages", mode="overwrite")
    pages = spark.read.parquet(f"{out}/pages")
    good = pages.where("status = 'success'")
    writers.write_table(backends.detect(good, detector, minimum), f"{out}/detections", mode="overwrite")
    found = spark.read.parquet(f"{out}/detections")
    per_document(document_results(good, found, model, iso_time()), f"{out}/results")
    items = with_captions(extraction.extract(found), words)
    per_document(writers.extraction_documents(items, extraction.statistics(items)), f"{out}/extractions")
    summary = stats.summary(good, found)
    classes = stats.class_ranking(found).agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("rank", "class_name", "n"))), lambda x: F.struct(x["class_name"], x["n"]))).alias("detections_by_class"))
    summary = summary.join(F.broadcast(classes))
    writers.write_json(summary, f"{out}/summary", mode="overwrite")
    outcome = pages.groupBy(F.col("doc_id").alias("name")).agg(F.min(F.col("status") == "success").alias("success"), F.max(F.when(F.col("status") != "success", F.col("status"))).alias("error"))
    return Processed(found, items, outcome, summary)


def with_captions(items: DataFrame, words: DataFrame | None) -> DataFrame:
    """Items with ``caption_text``, the words in the caption's box; null without words or a caption."""
    if words is None:
        return items.withColumn("caption_text", F.lit(None).cast("string"))
    boxes = items.where("cx1 is not null").select(*PAGE, "item_id", *[F.col(f"c{c}").alias(c) for c in BOX])
    texts = extraction.page_texts(boxes, words).select(*PAGE, "item_id", F.coalesce("item_text", F.lit("")).alias("caption_text"))
    return items.join(texts, [*PAGE, "item_id"], "left")


def process_folder(spark: SparkSession, folder: str, source: backends.PageSource, detector: backends.Detector, out: str, **options) -> Processed:
    """``process`` over a folder's PDFs, told apart by name; an error if there are none."""
    if not readers.expand(spark, [f"{folder}/*.pdf"])[0]:
        raise ValueError(f"no PDF files in {folder}")
    return process(readers.pdf_files(spark, folder), source, detector, out, **options)


def batch_outcome(rows: DataFrame) -> DataFrame:
    """How many documents (success boolean) went well and how many failed."""
    return rows.agg(F.count_if("success").alias("successes"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failures"))


def annotate_detected(pages: DataFrame, detections: DataFrame, model: backends.Model, out: str, texts: DataFrame | None = None, callers: int = 5, name: str = "VLM", done: DataFrame | None = None) -> DataFrame:
    """Pairs that a model finds among detections, by document below ``out``; a row for each document with its outcome.

    Pages without a figure or table are not asked about; a page whose call failed is left out of the document. ``texts``
    (doc_id, page_number, det_idx, text) describe captions; ``done (doc_id)`` are skipped.
    """
    spark = detections.sparkSession
    if done is not None:
        detections, pages = detections.join(done, "doc_id", "left_anti"), pages.join(done, "doc_id", "left_anti")
    elements = extraction.numbered_on_page(detections, CAPTIONS)
    elements = elements.join(texts, [*PAGE, "det_idx"], "left") if texts is not None else elements.withColumn("text", F.lit(None).cast("string"))
    wanted = pages.join(annotation.without_items(pages, elements), PAGE, "left_anti")
    asked = annotation.prompts(wanted, elements).join(pages.select(*PAGE, "content"), PAGE)
    writers.write_table(backends.ask(asked, model, callers), f"{out}/answers", mode="overwrite")
    answers = spark.read.parquet(f"{out}/answers")
    told = annotation.annotate(annotation.parse(answers), elements)
    failed = answers.where("raw_response is null").select(*PAGE)
    per_document(annotation.documents(told.join(failed, PAGE, "left_anti"), name, iso_time()), f"{out}/annotations")
    return _outcome(pages, answers)


def annotate_direct(pages: DataFrame, model: backends.Model, out: str, callers: int = 5, name: str = "VLM") -> DataFrame:
    """Elements and pairs that a model finds by itself, by document below ``out``; a failed page stays, with its error."""
    spark = pages.sparkSession
    asked = pages.select(*PAGE, F.lit(annotation.DIRECT_PROMPT).alias("prompt"), "content")
    writers.write_table(backends.ask(asked, model, callers), f"{out}/answers", mode="overwrite")
    answers = spark.read.parquet(f"{out}/answers")
    read = annotation.direct_pages(annotation.parse(answers))
    per_document(annotation.direct_documents(read, name, iso_time()), f"{out}/annotations")
    return _outcome(pages, answers)


def _outcome(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """By document: whether no call failed, and one of the errors."""
    rows = pages.select("doc_id").distinct().join(answers.groupBy("doc_id").agg(F.min("success").alias("success"), F.max("error").alias("error")), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("name"), F.coalesce("success", F.lit(True)).alias("success"), "error")


def build(spark: SparkSession, annotations: str, extractions: str | None, out: str, name: str = "benchmark", version: str = "1.0", copy_to: str | None = None) -> DataFrame:
    """The manifest of annotation files, below ``out``; an error without any. Extractions are matched by their PDF's name.

    ``copy_to`` is a folder that gets a copy of every annotation and extraction, by document.
    """
    told = readers.annotations(spark, annotations).select(F.col("pdf_name").alias("doc_id"), stem(F.col("pdf_name")).alias("pdf_name"), "annotator", F.xxhash64("path").alias("ord"))
    if not told.head(1):
        raise ValueError(f"no annotations in {annotations}")
    has = readers.extractions(spark, extractions).select(F.col("pdf_name").alias("doc_id")).distinct() if extractions else told.select("doc_id").limit(0)
    if copy_to:
        per_document(readers.annotations(spark, annotations).drop("path"), f"{copy_to}/annotations")
        if extractions:
            per_document(readers.extractions(spark, extractions).drop("path"), f"{copy_to}/extractions")
    rows = manifest.build(told, has, name, version)
    whole = rows.groupBy(F.col("dataset").alias("name"), "version", "annotator").agg(F.sort_array(F.collect_list(F.struct(F.col("name"), "annotation_path", "extraction_path"))).alias("documents"))
    writers.write_json(whole.select("name", "version", "annotator", iso_time().alias("created_at"), "documents"), out, mode="overwrite")
    return rows


@dataclass
class Benchmark:
    """A batch's metrics: by document (or its error), by kind, and in all; and every comparison."""

    documents: DataFrame
    kinds: DataFrame
    summary: DataFrame
    compared: DataFrame


def evaluate(truth: DataFrame, predictions: DataFrame, name: str = "benchmark", version: str = "1.0", minimum: float = evaluation.CONFIDENCE, corrected: bool = False) -> Benchmark:
    """Predictions against ground truth. A document that has no prediction at all is an error, and counts in no metric."""
    there = predictions.select("doc_id").distinct().withColumn("there", F.lit(True))
    sure = evaluation.high_confidence(truth, minimum)
    compared = evaluation.compare(evaluation.best_match(sure.join(there, "doc_id", "left_semi"), predictions))
    by_doc = evaluation.evaluate(compared, ["doc_id"])
    every = truth.select("doc_id").distinct().join(there, "doc_id", "left").join(by_doc, "doc_id", "left")
    zero = {c: F.when(F.col("there"), F.coalesce(c, F.lit(0))) for c in ("total", "tp", "correct_no_caption", "fp", "fn", "precision", "recall", "f1")}
    documents = every.withColumns(zero).select(F.col("doc_id").alias("name"), *zero, F.when(F.col("there").isNull(), F.concat(F.lit("Predictions not found for "), "doc_id")).alias("error"))
    counted = documents.agg(F.count("*").alias("total_documents"), F.count_if(F.col("error").isNull()).alias("successful_evaluations"))
    summary = evaluation.evaluate(compared, []).join(F.broadcast(counted)).select(F.lit(name).alias("name"), F.lit(version).alias("version"), "*")
    return Benchmark(documents, evaluation.batch_by_kind(compared, corrected), summary, compared)


def evaluate_files(spark: SparkSession, annotations: str, extractions: str, **options) -> Benchmark:
    """``evaluate`` over annotation and extraction files."""
    truth, found = readers.ground_truth(readers.annotations(spark, annotations)), readers.predicted(readers.extractions(spark, extractions))
    return evaluate(truth, found, **options)


def json_report(done: Benchmark, config: dict[str, str], created_at: Column) -> DataFrame:
    """A batch's report as one nested row: data set, metrics, counts, metrics by kind, documents, configuration.

    A report is as long as its list of documents.
    """
    metrics = F.struct("precision", "recall", "f1")
    kinds = done.kinds.agg(*[F.max(F.when(F.col("kind") == k, F.struct("precision", "recall", "f1"))).alias(k) for k in ("figure", "table")])
    docs = done.documents.agg(F.sort_array(F.collect_list(F.struct("name", "precision", "recall", "f1", "error"))).alias("document_results"))
    settings = F.create_map(*[F.lit(x) for pair in config.items() for x in pair]).cast("map<string,string>") if config else F.create_map().cast("map<string,string>")
    rows = done.summary.join(F.broadcast(kinds)).join(F.broadcast(docs))
    return rows.select(
        F.struct("name", "version", "total_documents", "successful_evaluations").alias("dataset"), metrics.alias("summary"), F.struct("figure", "table").alias("per_type_metrics"),
        F.struct(F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives")).alias("detailed_counts"), "document_results", settings.alias("evaluator_config"), created_at.alias("created_at"),
    )


def export_tasks(annotated: DataFrame, images: DataFrame, url: Column, out: str, model: str = "VLM") -> DataFrame:
    """Tasks of a labelling tool for the pages of ``annotation.annotate`` that have regions, with its interface, below ``out``.

    ``images (doc_id, page_number, width, height)`` give sizes where they are known; ``url`` is over doc_id and page_number.
    """
    sized = annotated.join(images.select(*PAGE, "width", "height"), PAGE, "left")
    tasks = export.tasks(export.page_regions(sized), url, model)
    writers.write_json(tasks, f"{out}/tasks", mode="overwrite")
    config = annotated.sparkSession.createDataFrame([(writers.LABELING_CONFIG,)], "value string")
    writers.write_text(config, f"{out}/config", mode="overwrite")
    return tasks
