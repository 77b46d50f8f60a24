import json

from pyspark.sql import functions as F

from pagewright.operators import annotation, extraction
from pagewright.sources import backends, readers, writers
from pagewright.streaming import incremental

BOXED = {"x1": 0.0, "y1": 0.0, "x2": 100.0, "y2": 50.0}


def result(name):
    cap = {"x1": 0.0, "y1": 60.0, "x2": 100.0, "y2": 80.0}
    dets = [{"class_id": 3, "class_name": "Figure", "confidence": 0.9, "bbox": BOXED}, {"class_id": 4, "class_name": "Figure-Caption", "confidence": 0.8, "bbox": cap}]
    return {"pdf_name": name, "total_pages": 1, "pages": [{"page_number": 1, "detections": dets}, {"page_number": 2, "detections": []}]}


def test_results(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps(result(f"d{k}"), indent=1))
    det = readers.detections(readers.results(spark, str(tmp_path)))
    assert det.count() == 4 and readers.pages(readers.results(spark, str(tmp_path))).count() == 4
    items = extraction.extract(det)
    assert {(r["item_id"], r["cap_idx"]) for r in items.collect()} == {("fig_01_01", 1)}
    counts = extraction.statistics(items.withColumn("caption_text", F.lit("")))
    docs = writers.extraction_documents(items.withColumn("caption_text", F.lit("")), counts)
    writers.write_json(docs, str(tmp_path / "out"))
    back = readers.predicted(readers.extractions(spark, str(tmp_path / "out")))
    assert back.select("item_id", "x2", "cy1").distinct().collect()[0][:] == ("fig_01_01", 100.0, 60.0)


def test_annotations(spark, tmp_path):
    a = {"pdf_name": "d", "pages": [{"page_number": 1, "matches": [{"figure_id": "fig_01_01", "figure_bbox": BOXED}]}]}
    (tmp_path / "a.json").write_text(json.dumps(a))
    got = readers.ground_truth(readers.annotations(spark, str(tmp_path))).first()
    assert (got["kind"], got["confidence"], got["gx1"], got["x2"]) == ("figure", 1.0, None, 100.0)


def test_backends(spark):
    files = spark.createDataFrame([("a", bytearray(1500)), ("b", bytearray(0))], "name string, content binary")
    pages = backends.rasterise(files, backends.StubPages())
    assert [(r["name"], r["page_number"]) for r in pages.orderBy("page_number").collect()] == [("a", 1), ("a", 2)]
    det = backends.detect(pages.withColumnRenamed("name", "doc_id"), backends.StubDetector(), 0.85)
    assert det.count() == 2
    asked = backends.ask(pages.selectExpr("name as doc_id", "page_number", "'p' as prompt", "content"), backends.StubModel(), callers=1)
    assert annotation.matches(annotation.parse(asked)).count() == 2


def test_errors_are_rows(spark):
    class Broken:  # local, so that it is sent to the workers by value
        def pages(self, name, content):
            raise ValueError("no pages")

        def ask(self, prompt, image):
            raise TimeoutError("late")

    files = spark.createDataFrame([("a", bytearray(1))], "name string, content binary")
    assert backends.rasterise(files, Broken()).first()["status"] == "error: no pages"
    page = spark.createDataFrame([("a", 1, "p", bytearray())], "doc_id string, page_number int, prompt string, content binary")
    assert backends.ask(page, Broken(), tries=1).first()["error"] == "TimeoutError: late"


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(result(f"d{k}")))
        incremental.extract_new(spark, source, out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == k + 1
    incremental.extract_new(spark, source, out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 2
