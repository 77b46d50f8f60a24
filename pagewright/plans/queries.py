"""One query for each operator, over tables derived from the driver's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import fixtures
from pagewright.functions import text
from pagewright.functions.geometry import Box, horizontal_overlap, thousandths_to_pixels, to_points, vertical_distance
from pagewright.functions.geometry import percent as box_percent_of
from pagewright.operators import annotation, evaluation, export, extraction, labels, manifest, matching, report, stats
from pagewright.operators.matching import BOX, PAGE
from pagewright.plans import runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CAPTIONS = ["Figure-Caption", "Table-Caption"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def compared(s: SparkSession, d: str) -> DataFrame:
    det = fixtures.detections(s, d)
    truth = evaluation.high_confidence(fixtures.ground_truth(det), evaluation.CONFIDENCE)
    return evaluation.compare(evaluation.best_match(truth, fixtures.predictions(det)))


def elements(s: SparkSession, d: str) -> DataFrame:
    """Numbered elements of every page; a caption's text is made of its number, empty for some."""
    rows = extraction.numbered_on_page(fixtures.detections(s, d), CAPTIONS)
    made = F.when(F.col("det_idx") % 4 == 0, "").when(F.col("det_idx") % 4 == 1, F.repeat(F.lit("caption "), 9)).otherwise(F.concat(F.lit("Caption "), F.col("det_idx").cast("string")))
    return rows.withColumn("text", F.when(F.col("kind") == "caption", made))


def files(s: SparkSession, d: str) -> DataFrame:
    """doc_id and name of a file for each document."""
    return s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "concat('doc', doc_id) as name")


def answers(s: SparkSession, d: str) -> DataFrame:
    """A model's answer for every page, in several forms."""
    page = fixtures.pages(s, d)
    body = F.format_string('{"matches":[{"figure_id":1,"figure_type":"figure","caption_id":%d,"confidence":0.5},{"figure_id":%d,"figure_type":"table","caption_id":9,},{"figure_id":null}],"unmatched_captions":[2,],}', F.col("page_number") % 3, F.col("doc_id") % 3 + 1)
    form = (F.col("doc_id") + F.col("page_number")) % 4
    return page.withColumn("raw_response", F.when(form == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(form == 1, F.concat(F.lit("ok "), body, F.lit(" bye"))).when(form == 2, F.concat(F.lit("```\n"), body, F.lit("```"))).otherwise("no json"))


@query
def detections_scan(s, d):
    return fixtures.detections(s, d)


@query
def filter_by_class(s, d):
    return matching.filter_classes(fixtures.detections(s, d), ["Figure", "Table"]).select("event_id", "class_name")


@query
def confidence_filter(s, d):
    return fixtures.detections(s, d).where("confidence >= 0.5").select("event_id", "confidence")


@query
def page_expansion(s, d):
    return fixtures.pages(s, d)


@query
def page_class_stats(s, d):
    return stats.by_page_and_class(fixtures.detections(s, d))


@query
def page_counts(s, d):
    return stats.by_page(fixtures.pages(s, d), fixtures.detections(s, d).where("class_name = 'Title'"))


@query
def doc_class_stats(s, d):
    return stats.by_class(fixtures.detections(s, d))


@query
def avg_confidence_by_class(s, d):
    return stats.by_class(fixtures.detections(s, d), ()).select("class_name", "average_confidence")


@query
def document_summary(s, d):
    return stats.by_document(fixtures.pages(s, d), fixtures.detections(s, d))


@query
def summary_report(s, d):
    return stats.summary(fixtures.pages(s, d), fixtures.detections(s, d))


@query
def class_ranking(s, d):
    return stats.class_ranking(fixtures.detections(s, d))


@query
def stats_rollup(s, d):
    return stats.rollup(fixtures.detections(s, d)).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


@query
def pixel_to_pdf(s, d):
    box = to_points(Box.of())
    return fixtures.detections(s, d).select("event_id", *[getattr(box, c).alias(c) for c in BOX])


@query
def crop_rect(s, d):
    return extraction.crops(fixtures.detections(s, d).select("event_id", *BOX), 300.0, 250.0)


@query
def normalize_to_pixel(s, d):
    box = thousandths_to_pixels(Box.of(), F.lit(1654), F.lit(2339))
    return fixtures.detections(s, d).select("event_id", *[getattr(box, c).cast("bigint").alias(c) for c in BOX])


@query
def bbox_percent(s, d):
    v = box_percent_of(Box.of(), F.lit(1654.0), F.lit(2339.0))
    return fixtures.detections(s, d).select("event_id", v["x"].alias("x"), v["y"].alias("y"), v["width"].alias("width"), v["height"].alias("height"))


@query
def pair_geometry(s, d):
    items, caps = matching.sides(fixtures.detections(s, d))
    a, b = Box.of(), Box.of("c")
    met = items.join(caps, [*PAGE, "kind"])
    return met.select(*PAGE, "kind", "item_idx", "cap_idx", horizontal_overlap(a, b).alias("overlap"), *[vertical_distance(a, b, k).alias(k) for k in ("below", "above", "both")])


@query
def caption_candidates(s, d):
    return matching.candidates(*matching.sides(fixtures.detections(s, d)))


@query
def caption_match_greedy(s, d):
    return matching.greedy(matching.candidates(*matching.sides(fixtures.detections(s, d))))


@query
def match_left_outer(s, d):
    return matching.match(fixtures.detections(s, d)).select(*PAGE, "kind", "item_idx", F.coalesce("cap_idx", F.lit(-1)).alias("cap_idx"), "dist", "cx1")


@query
def match_both_directions(s, d):
    return matching.greedy(matching.candidates(*matching.sides(fixtures.detections(s, d)), directions={"figure": "both", "table": "both"}))


@query
def unmatched_items(s, d):
    return matching.match(fixtures.detections(s, d)).where("cap_idx is null").select(*PAGE, "kind", "item_idx")


@query
def unmatched_captions(s, d):
    return matching.unmatched_captions(fixtures.detections(s, d)).select(*PAGE, "kind", "cap_idx")


@query
def suppressed_boxes(s, d):
    return matching.suppress(fixtures.detections(s, d), 0.2).select(*PAGE, "class_name", "det_idx")


@query
def item_numbering_doc(s, d):
    items, _ = matching.sides(fixtures.detections(s, d))
    return extraction.numbered(items).select(*PAGE, "kind", "item_idx", "item_id")


@query
def item_numbering_page(s, d):
    return extraction.numbered_on_page(fixtures.detections(s, d), CAPTIONS).select(*PAGE, "det_idx", "item_id")


@query
def extraction_stats(s, d):
    items = extraction.extract(fixtures.detections(s, d)).withColumn("caption_text", F.when(F.col("cap_idx") % 3 == 0, "").when(F.col("cap_idx").isNotNull(), "text"))
    return extraction.statistics(items)


@query
def item_texts(s, d):
    det = fixtures.detections(s, d)
    words = det.where("class_name = 'Title'").select(*PAGE, F.col("det_idx").alias("word_ord"), F.concat(F.lit("w"), "det_idx").alias("text"), *BOX)
    items, _ = matching.sides(det)
    return extraction.page_texts(extraction.numbered(items), words).where("item_text is not null").select(*PAGE, "item_id", "item_text")


@query
def high_confidence(s, d):
    return evaluation.high_confidence(fixtures.ground_truth(fixtures.detections(s, d)), 0.8).select("figure_id", "confidence")


@query
def caption_map(s, d):
    truth = fixtures.ground_truth(fixtures.detections(s, d)).withColumn("figure_id", F.concat("kind", F.col("page_number").cast("string")))
    return evaluation.caption_map(truth.where("caption_id is not null"))


@query
def dataset_statistics(s, d):
    return evaluation.dataset_statistics(fixtures.ground_truth(fixtures.detections(s, d)))


@query
def merged_datasets(s, d):
    truth = fixtures.ground_truth(fixtures.detections(s, d)).select("kind", "figure_id", "confidence")
    return evaluation.merge([truth.where("kind = 'figure'"), truth.where("confidence >= 0.9")])


@query
def iou_best_match(s, d):
    det = fixtures.detections(s, d)
    truth = evaluation.high_confidence(fixtures.ground_truth(det), evaluation.CONFIDENCE)
    return evaluation.best_match(truth, fixtures.predictions(det)).select("figure_id", "pred_ord", "item_iou", "found")


@query
def match_comparison(s, d):
    return compared(s, d).select("figure_id", "kind", "page_number", "is_correct", "error_type", "item_iou", "caption_iou")


@query
def eval_by_doc(s, d):
    return evaluation.evaluate(compared(s, d), ["doc_id"])


@query
def eval_overall(s, d):
    return evaluation.evaluate(compared(s, d), [])


@query
def eval_by_kind(s, d):
    return evaluation.by_kind(compared(s, d), [])


@query
def batch_kind_strict(s, d):
    return evaluation.batch_by_kind(compared(s, d))


@query
def batch_kind_corrected(s, d):
    return evaluation.batch_by_kind(compared(s, d), corrected=True)


@query
def error_histogram(s, d):
    return evaluation.error_histogram(compared(s, d))


@query
def errors_by_page(s, d):
    return evaluation.errors_by_page(compared(s, d))


def listing(s: SparkSession, d: str) -> DataFrame:
    docs = files(s, d)
    forms = [("doc_id % 5 <> 0", "concat('bench/annotations/', name, '.json')"), ("doc_id % 3 = 0", "concat('bench/extractions/', name, '.json')"), ("doc_id % 4 = 0", "concat('out/', name, '/extractions/extraction_metadata.json')"), ("doc_id % 2 = 0", "concat('out/', name, '/result.json')")]
    rows = [docs.where(w).selectExpr(f"{p} as path") for w, p in forms]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def manifest_rows(s: SparkSession, d: str) -> DataFrame:
    return files(s, d).selectExpr("name", "concat('annotations/', name, '.json') as annotation_path", "case when doc_id % 7 <> 0 then concat('extractions/', name, '.json') end as extraction_path")


@query
def manifest_validate(s, d):
    return manifest.validate(manifest_rows(s, d), listing(s, d), "bench")


@query
def predictions_resolve(s, d):
    return manifest.predictions(manifest_rows(s, d), listing(s, d), "bench", "out").select("name", "resolved")


@query
def manifest_build(s, d):
    docs = files(s, d)
    ann = docs.where("doc_id % 5 <> 0").selectExpr("doc_id", "name as pdf_name", "case when doc_id < 4 then 'unknown' else concat('model', doc_id) end as annotator", "doc_id as ord")
    return manifest.build(ann, docs.where("doc_id % 3 = 0"))


@query
def annotate_discovery(s, d):
    docs = files(s, d)
    return manifest.to_annotate(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0").select("doc_id"))


@query
def export_discovery(s, d):
    docs = files(s, d)
    return manifest.to_export(docs, docs.where("doc_id % 3 = 0").select("doc_id"))


@query
def page_image_resolve(s, d):
    page = fixtures.pages(s, d).withColumn("dir", F.concat(F.lit("p"), F.col("doc_id").cast("string")))
    form = (F.col("doc_id") + F.col("page_number")) % 5
    name = F.when(form == 0, F.format_string("page_%04d.png", "page_number")).when(form == 1, F.format_string("page_%03d.png", "page_number")).when(form == 2, F.format_string("page_%d.png", "page_number")).when(form == 3, F.format_string("scan%dx.png", "page_number"))
    there = page.select(F.concat("dir", F.lit("/"), name).alias("path")).where("path is not null")
    return manifest.page_images(page, there)


@query
def vlm_json_repair(s, d):
    p = annotation.parse(answers(s, d))
    return p.select(*PAGE, "success", "error", F.size(F.coalesce("body.matches", F.array().cast("array<struct<figure_id:int,figure_type:string,caption_id:int,confidence:double,reasoning:string>>"))).cast("bigint").alias("n_matches"), F.coalesce(F.get("body.unmatched_captions", F.lit(0)), F.lit(-1)).cast("bigint").alias("first_unmatched"))


def annotated(s: SparkSession, d: str) -> DataFrame:
    return annotation.annotate(annotation.parse(answers(s, d)), elements(s, d))


@query
def vlm_matches(s, d):
    return annotation.resolved(annotated(s, d)).select(*PAGE, "kind", "figure_id", "caption_id", "confidence", "x1", "cx1", "caption_text")


@query
def vlm_unmatched(s, d):
    return annotation.unmatched(annotated(s, d)).select(*PAGE, "item_id")


@query
def annotation_counts(s, d):
    return annotation.document_counts(annotation.resolved(annotated(s, d)))


@query
def pages_without_items(s, d):
    return annotation.without_items(fixtures.pages(s, d), elements(s, d))


@query
def prompt_elements(s, d):
    told = fixtures.pages(s, d).join(annotation.describe(elements(s, d)), PAGE, "left")
    return told.select(*PAGE, F.coalesce("description", F.lit(annotation.EMPTY)).alias("description"))


@query
def bbox_lookup_priority(s, d):
    items, _ = matching.sides(fixtures.detections(s, d))
    return export.box_lookup(extraction.numbered(items), elements(s, d)).select("doc_id", "item_id", "source", "x1")


@query
def export_regions(s, d):
    return export.regions(export.page_regions(annotated(s, d))).select(*PAGE, "region_id", "item_id", "label", F.col("value.x").alias("x"), F.col("value.height").alias("height"))


@query
def export_relations(s, d):
    return export.relations(export.page_regions(annotated(s, d)))


@query
def storage_urls(s, d):
    return files(s, d).select("doc_id", export.local_url(F.concat("name", F.lit("/page_0001.png"))).alias("local_url"), export.bucket_url("localhost:9000", "pages", F.col("name")).alias("bucket_url"))


@query
def image_sizes(s, d):
    images = files(s, d).selectExpr("doc_id", "case when doc_id % 2 = 0 then cast(doc_id as int) + 100 end as width", "case when doc_id % 3 = 0 then 50 end as height")
    return export.sizes(images).select("doc_id", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"))


@query
def class_labels(s, d):
    return fixtures.detections(s, d).select("event_id", labels.class_label(F.col("class_name"), F.round("confidence", 1)).alias("label"))


@query
def class_names(s, d):
    return fixtures.detections(s, d).select("event_id", text.class_label(F.lower(F.replace("class_name", F.lit("-"), F.lit("_")))).alias("label"))


@query
def numbered_labels(s, d):
    rows = elements(s, d)
    return rows.select(*PAGE, "det_idx", labels.numbered_label(F.col("kind"), F.when(F.col("no") < 3, F.col("no")), F.col("det_idx")).alias("label"))


@query
def color_lookup(s, d):
    return labels.colored(fixtures.detections(s, d).select("event_id", "class_name"), "class_name", labels.palette(s, {"Figure": (0, 255, 0), "Table": (255, 0, 0)}), (50, 50, 50)).select("event_id", *[F.col(c).cast("bigint").alias(c) for c in "bgr"])


@query
def label_boxes(s, d):
    return labels.label_boxes(fixtures.detections(s, d).withColumn("y1", F.col("y1") - 100), 20).select("event_id", *[F.col(c).cast("bigint").alias(c) for c in ("label_x", "label_top", "label_bottom")])


@query
def legend_layout(s, d):
    rows = s.read.parquet(f"{d}/nation.parquet").selectExpr("n_name as name", "cast(n_nationkey as int) as ord")
    return labels.legend(rows).select("name", F.col("y").cast("bigint").alias("y"))


@query
def image_media_types(s, d):
    path = F.concat("name", F.when(F.col("doc_id") % 5 == 0, ".JPG").when(F.col("doc_id") % 5 == 1, ".jpeg").when(F.col("doc_id") % 5 == 2, ".gif").when(F.col("doc_id") % 5 == 3, ".webp").otherwise(".bmp"))
    return files(s, d).select("doc_id", text.media_type(path).alias("media_type"), text.stem(F.concat(F.lit("a/b/"), path)).alias("stem"))


@query
def model_names(s, d):
    rows = s.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey", "concat(case n_nationkey % 4 when 0 then 'gpt-' when 1 then 'ollama/' when 2 then '' else 'my/' end, lower(n_name)) as model", "case when n_nationkey % 3 = 0 then '' else 'http://localhost' end as base")
    return rows.select("n_nationkey", text.model_name(F.col("model"), F.col("base")).alias("name"))


@query
def api_errors(s, d):
    rows = s.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey", "case n_nationkey % 4 when 0 then 'RateLimitError' when 1 then 'BadRequestError' when 2 then 'NotFoundError' else 'OddError' end as kind", "concat('boom ', n_name, ' Give Feedback here') as message", "lower(n_name) as model")
    return rows.select("n_nationkey", text.friendly_error(F.col("kind"), F.col("message"), F.col("model")).alias("said"))


@query
def report_lines(s, d):
    docs = evaluation.evaluate(compared(s, d), ["doc_id"]).withColumn("name", F.concat(F.lit("doc"), "doc_id"))
    failed = (F.col("doc_id") % 3 == 0) | (F.col("total") < 10)
    rows = docs.select("name", *[F.when(~failed, F.lit(0.25)).alias(c) for c in ("precision", "recall", "f1")], F.when(failed, F.concat(F.lit("Predictions not found for "), "name")).alias("error"))
    return report.document_lines(rows)


@query
def report_sections(s, d):
    one = evaluation.evaluate(compared(s, d), []).select(F.lit("set").alias("name"), F.lit("1.0").alias("version"), F.lit(9).alias("total_documents"), F.lit(8).alias("successful_evaluations"), F.lit(0.5).alias("precision"), F.lit(0.25).alias("recall"), F.lit(1.0).alias("f1"), "tp", "fp", "fn")
    return report.sections(one).select(F.col("ord").cast("bigint").alias("ord"), "line")


def run_values(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/nation.parquet").selectExpr("concat('run', n_regionkey) as label", "concat('key', n_nationkey % 7) as key", "n_name as value").dropDuplicates(["label", "key"]).selectExpr("label", "key", "concat(label, '/', key) as value")


@query
def comparison_pivot(s, d):
    return report.side_by_side(run_values(s, d), ["run0", "run1", "run2"])


@query
def config_union(s, d):
    return report.config_keys(run_values(s, d))


@query
def point_ids(s, d):
    return fixtures.detections(s, d).select("event_id", text.point_id(F.concat(F.lit("doc"), "doc_id"), F.col("det_idx"), F.col("page_number")).alias("point_id"))


@query
def base64_images(s, d):
    return files(s, d).select("doc_id", text.base64_image(F.col("name").cast("binary")).alias("content"))


@query
def element_texts(s, d):
    rows = s.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey", "case n_nationkey % 3 when 0 then null when 1 then ' ' else n_name end as description", "case when n_nationkey % 2 = 0 then ' a caption' end as caption")
    return rows.select("n_nationkey", text.element_text(F.col("description"), F.col("caption"), F.lit("figure")).alias("text"))


@query
def matches_of_page(s, d):
    return evaluation.matches_of_page(fixtures.ground_truth(fixtures.detections(s, d)), 3).select("figure_id", "kind")


@query
def elements_with_box(s, d):
    rows = fixtures.detections(s, d).withColumn("x1", F.when(F.col("det_idx") % 5 != 0, F.col("x1")))
    return annotation.boxes_told(rows)


@query
def palette_upsert(s, d):
    rows = labels.upsert(labels.palette(s, {"Figure": (0, 255, 0), "Table": (255, 0, 0)}), {"Table": (1, 2, 3), "New": (4, 5, 6)})
    return rows.select("name", *[F.col(c).cast("bigint").alias(c) for c in ("ord", "b", "g", "r")])


@query
def visualizer_labels(s, d):
    rows = elements(s, d).withColumn("confidence", F.round("confidence", 1))
    return rows.select(*PAGE, "det_idx", labels.visualizer("numbered")().alias("numbered"), labels.visualizer("class", False)().alias("plain"))


@query
def manifest_validity(s, d):
    told = manifest.validity(manifest.validate(manifest_rows(s, d), listing(s, d), "bench"))
    return told.select("valid", "total", "valid_documents", F.size("missing_annotations").cast("bigint").alias("n_annotations"), F.array_join("missing_extractions", ",").alias("missing_extractions"))


@query
def page_results(s, d):
    rows = runs.page_results(fixtures.pages(s, d).selectExpr("*", "cast(null as string) as image_path", "1654 as width", "2339 as height"), fixtures.detections(s, d).withColumn("class_id", F.lit(1)))
    return rows.select(*PAGE, F.col("page.num_detections").cast("bigint").alias("num_detections"), F.coalesce(F.array_join(F.transform("page.detections", lambda x: x["class_name"]), ","), F.lit("")).alias("classes"))


@query
def document_results(s, d):
    page, det = fixtures.pages(s, d).selectExpr("*", "cast(null as string) as image_path", "1654 as width", "2339 as height"), fixtures.detections(s, d).withColumn("class_id", F.lit(1))
    rows = runs.document_results(page, det, "m", F.lit("t"), F.lit(0.0))
    return rows.select(F.col("pdf_name").alias("doc_id"), F.col("total_pages").cast("bigint").alias("total_pages"), "processing_time_seconds", F.size("pages").cast("bigint").alias("n_pages"), F.col("statistics.total_detections").cast("bigint").alias("total_detections"))


@query
def annotation_documents(s, d):
    """Annotation files, opened again."""
    docs = annotation.documents(annotated(s, d), "m", F.lit("t"))
    rows = docs.select(F.col("pdf_name").alias("doc_id"), F.explode("pages").alias("p"))
    return rows.select("doc_id", "p.page_number", F.size("p.matches").cast("bigint").alias("n_matches"), F.array_join("p.unmatched_captions", ",").alias("unmatched_captions"), F.size("p.unmatched_figures").cast("bigint").alias("n_figures"))


@query
def direct_statistics(s, d):
    """Direct mode over an answer for every page."""
    form = (F.col("doc_id") + F.col("page_number")) % 4
    body = F.format_string('{"elements":[{"id":1,"type":"figure","bbox":{"x1":1,"y1":2,"x2":3,"y2":4}},{"id":1,"type":"caption","text":"t"},{"id":%d,"type":"table"},],"matches":[{"figure_id":1,"caption_id":%s},{"caption_id":3}],"unmatched_tables":[%d]}', "page_number", F.when(F.col("page_number") % 2 == 0, "1").otherwise("null"), "page_number")
    rows = fixtures.pages(s, d).withColumn("raw_response", F.when(form == 3, "no json").when(form == 2, '{"elements": []}').otherwise(body))
    return annotation.direct_statistics(annotation.direct_pages(annotation.parse(rows)))


def benchmark(s: SparkSession, d: str) -> runs.Benchmark:
    det = fixtures.detections(s, d)
    return runs.evaluate(fixtures.ground_truth(det), fixtures.predictions(det).where("doc_id % 5 <> 1"), "set")


@query
def benchmark_documents(s, d):
    return benchmark(s, d).documents.select(F.col("name").alias("doc_id"), "total", "tp", "fp", "fn", "precision", "f1", F.col("error").isNotNull().alias("failed"))


@query
def benchmark_report(s, d):
    """The whole report of a batch, its metrics in thousandths of a percent left out where they tie."""
    done = benchmark(s, d)
    lines = report.markdown(done.summary, done.kinds, done.documents.withColumn("name", F.concat(F.lit("doc"), "name")), {"threshold": "0.5"}, F.lit("t"))
    return lines.where("line not like '| doc%' and line not like '- **doc%'").select(F.col("part").cast("bigint").alias("part"), "line").where("part in (0, 1, 3, 5, 7, 8, 9) and line not like '| Precision%' and line not like '| Recall%' and line not like '| F1%'")


@query
def batch_outcome(s, d):
    return runs.batch_outcome(files(s, d).selectExpr("case when doc_id % 7 = 0 then null else doc_id % 3 <> 0 end as success"))


@query
def topk_cosine(s, d):
    """The ten vectors most like vector 0, an extension; the query is one stated row."""
    rows = s.read.parquet(f"{d}/embeddings.parquet")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    first = F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("q")))
    scored = rows.join(first).withColumn("similarity", F.try_divide(dot("embedding", "q"), F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("q", "q"))))
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(10).select("vec_id", F.round("similarity", 6).alias("similarity"))
