"""Whole runs with backends made here, and the commands."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagewright import cli
from pagewright.operators import annotation, labels, report
from pagewright.plans import runs
from pagewright.sources import backends, readers, writers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers have no copy of this file


class Pages:
    """Two pages a file; a file named ``bad`` fails."""

    def pages(self, name, content):
        if name == "bad":
            raise ValueError("broken file")
        return [(k, 1654, 2339, f"{name}{k}".encode()) for k in (1, 2)]

    def info(self, name, content):
        if name == "bad":
            raise ValueError("broken file")
        return {"title": name}, [(612.0, 792.0)] * 2


class Detector:
    """A figure and its caption, and on second pages a table without one."""

    def detect(self, image):
        out = [(3, "Figure", 0.9, 100.0, 100.0, 400.0, 300.0), (4, "Figure-Caption", 0.8, 100.0, 320.0, 400.0, 350.0), (5, "Title", 0.1, 0.0, 0.0, 1.0, 1.0)]
        return out + [(6, "Table", 0.7, 600.0, 600.0, 900.0, 700.0)] * image.endswith(b"2")


class Model:
    """An answer in a fence, with a comma too many; a call about ``b2`` fails."""

    def ask(self, prompt, image):
        if image == b"b2":
            raise TimeoutError("late")
        if "elements" in prompt.split("Answer")[1]:
            return '{"elements": [{"id": 1, "type": "figure", "bbox": {"x1": 0, "y1": 0, "x2": 500, "y2": 500}}], "matches": [{"figure_id": 1, "caption_id": null}], "unmatched_tables": [2]}'
        return '```json\n{"matches": [{"figure_id": 1, "caption_id": 1, "confidence": 0.75,}], "unmatched_captions": [],}\n```'

    def check(self):
        raise ConnectionError("no service")


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    files = spark.createDataFrame([(n, bytearray(b"x")) for n in ("a", "b", "bad")], "name string, content binary")
    return out, runs.process(files, Pages(), Detector(), out)


def test_process(spark, done):
    out, run = done
    assert {(r["name"], r["success"], r["error"]) for r in run.outcome.collect()} == {("a", True, None), ("b", True, None), ("bad", False, "error: broken file")}
    assert tuple(runs.batch_outcome(run.outcome).first()) == (2, 1)
    told = run.summary.first()
    assert (told["total_documents"], told["total_pages"], told["total_detections"], told["detections_by_class"]["Figure"]) == (2, 4, 10, 4)
    results = readers.results(spark, f"{out}/results/*/").collect()
    assert sorted(r["pdf_name"] for r in results) == ["a", "b"]
    page = results[0]["pages"][1]
    assert (page["page_number"], page["num_detections"], page["image_size"]["width"], results[0]["processing_time_seconds"]) == (2, 3, 1654, None)
    assert readers.detections(readers.results(spark, f"{out}/results/*/")).count() == 10
    items = readers.predicted(readers.extractions(spark, f"{out}/extractions/*/"))
    assert {(r["doc_id"], r["item_id"], r["cy1"]) for r in items.collect()} == {(d, i, y) for d in "ab" for i, y in (("fig_01_01", 320.0), ("fig_02_02", 320.0), ("table_02_01", None))}


def test_selected_pages(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"x"))], "name string, content binary")
    assert runs.process(files, Pages(), Detector(), str(tmp_path), selected=[1, 7]).detections.select("page_number").distinct().collect()[0][0] == 2


def test_annotate(spark, done, tmp_path):
    out, run = done
    pages = spark.read.parquet(f"{out}/pages").where("status = 'success'")
    outcome = runs.annotate_detected(pages, run.detections, Model(), str(tmp_path / "d"), callers=2)
    assert {(r["name"], r["success"]) for r in outcome.collect()} == {("a", True), ("b", False)}
    truth = readers.ground_truth(readers.annotations(spark, str(tmp_path / "d/annotations/*/")))
    assert {(r["doc_id"], r["page_number"], r["figure_id"], r["caption_id"], r["confidence"], r["gy1"]) for r in truth.collect()} == {(d, p, f"fig_0{p}_01", f"cap_0{p}_01", 0.75, 320.0) for d, p in (("a", 1), ("a", 2), ("b", 1))}
    raw = readers.annotations(spark, str(tmp_path / "d/annotations/*/")).where("pdf_name = 'a'").first()
    assert [p["unmatched_tables"] for p in raw["pages"]] == [[], ["table_02_01"]]
    skipped = runs.annotate_detected(pages, run.detections, Model(), str(tmp_path / "s"), done=spark.createDataFrame([("b",)], "doc_id string"))
    assert [r["name"] for r in skipped.collect()] == ["a"]
    runs.annotate_direct(pages, Model(), str(tmp_path / "x"), callers=1)
    text = [json.loads(x) for x in spark.read.text(str(tmp_path / "x/annotations/*/")).toPandas()["value"]]
    by = {t["pdf_name"]: t for t in text}
    assert by["a"]["statistics"]["total_figures"] == 2 and by["b"]["statistics"]["pages_with_content"] == 1 and by["a"]["mode"] == "direct"
    assert by["b"]["pages"][1]["vlm_response"]["error"] == "TimeoutError: late" and by["a"]["pages"][0]["unmatched_tables"] == [2]


def test_benchmark_and_reports(spark, done, tmp_path):
    out, run = done
    pages = spark.read.parquet(f"{out}/pages").where("status = 'success'")
    runs.annotate_detected(pages, run.detections, Model(), str(tmp_path))
    rows = runs.build(spark, f"{tmp_path}/annotations/*/", f"{out}/extractions/*/", f"{tmp_path}/manifest", copy_to=f"{tmp_path}/copy")
    assert readers.annotations(spark, f"{tmp_path}/copy/annotations/*/").count() == 2 and readers.predicted(readers.extractions(spark, f"{tmp_path}/copy/extractions/*/")).count() == 6
    assert sorted((r["name"], r["extraction_path"]) for r in rows.collect()) == [("a", "extractions/a.json"), ("b", "extractions/b.json")]
    assert readers.manifests(spark, f"{tmp_path}/manifest").count() == 2
    truth = readers.ground_truth(readers.annotations(spark, f"{tmp_path}/annotations/*/"))
    found = readers.predicted(readers.extractions(spark, f"{out}/extractions/*/"))
    got = runs.evaluate(truth, found.where("doc_id = 'a'"), "set")
    assert {(r["name"], r["tp"], r["error"]) for r in got.documents.collect()} == {("a", 2, None), ("b", None, "Predictions not found for b")}
    told = got.summary.first()
    assert (told["total_documents"], told["successful_evaluations"], told["f1"]) == (2, 1, 1.0)
    lines = [r["line"] for r in report.whole(report.markdown(got.summary, got.kinds, got.documents, {"k": "v"}, F.lit("now"))).collect()]
    assert lines[0] == "# Caption Matching Benchmark Report" and lines[-1] == "*Report generated at now*" and "- **b:** Predictions not found for b" in lines
    at = lines.index("### Figure Matching")
    assert lines[at + 1 : at + 4] == ["| Precision | 1.0000 |", "| Recall | 1.0000 |", "| F1 | 1.0000 |"] and lines[at + 4] == "### Table Matching"
    assert "| a | 1.0000 | 1.0000 | 1.0000 | OK |" in lines and "- **k:** v" in lines
    writers.write_json(runs.json_report(got, {"k": "v"}, F.lit("now")), f"{tmp_path}/report")
    back = readers.reports(spark, f"{tmp_path}/report").first()
    assert (back["dataset"]["total_documents"], back["summary"]["f1"], back["evaluator_config"]) == (2, 1.0, {"k": "v"})
    side = report.comparison([("one", got.summary, got.kinds, {"k": "v"}), ("two", got.summary, got.kinds, {"q": 1})])
    lines = [r["line"] for r in report.whole(side).collect()]
    assert "| one | set | 2 | 1.0000 | 1.0000 | 1.0000 |" in lines and "| q | - | 1 |" in lines and lines.count("| two | 1.0000 | 1.0000 | 1.0000 |") >= 1
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no annotations"):
        runs.build(spark, f"{tmp_path}/none", None, f"{tmp_path}/never")


def test_export(spark, done, tmp_path):
    out, run = done
    pages = spark.read.parquet(f"{out}/pages").where("status = 'success'")
    runs.annotate_detected(pages, run.detections, Model(), str(tmp_path))
    from pagewright.operators import extraction

    elements = extraction.numbered_on_page(run.detections, runs.CAPTIONS).withColumn("text", F.lit(""))
    told = annotation.annotate(annotation.parse(spark.read.parquet(f"{tmp_path}/answers")), elements)
    tasks = runs.export_tasks(told, pages.withColumn("width", F.lit(1000)), F.concat("doc_id", F.lit("/"), F.col("page_number")), str(tmp_path / "t")).collect()
    one = next(t for t in tasks if t["data"]["image"] == "a/2")["prediction"]
    assert [(r["region_id"], r["item_id"]) for r in one["regions"]] == [("region_1", "fig_02_01"), ("region_2", "cap_02_01"), ("region_3", "table_02_01")]
    assert [tuple(r) for r in one["relations"]] == [("region_1", "region_2", "has_caption")] and one["regions"][0]["value"]["x"] == 10.0
    assert spark.read.text(str(tmp_path / "t/config")).count() > 5


def test_edges(spark):
    files = spark.createDataFrame([("a", bytearray(b"x")), ("bad", bytearray())], "name string, content binary")
    assert {(r["name"], r["n_pages"], r["error"]) for r in backends.pdf_info(files, Pages()).collect()} == {("a", 2, None), ("bad", None, "ValueError: broken file")}
    assert backends.available(backends.StubModel()) is None and backends.available(Model()) == "ConnectionError: no service"
    assert [r["label"] for r in labels.kind_legend(spark, {"figure": 2}).orderBy("y").collect()] == ["Figure (2)", "Table", "Caption"]


def test_store_and_sizes(spark, tmp_path):
    import struct

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"rest"
    images = spark.createDataFrame([("a/1.png", bytearray(png)), ("b.png", bytearray(b"no")), ("c.png", None)], "path string, content binary")
    from pagewright.operators import export

    assert {(r["path"], r["width"], r["height"]) for r in export.measured(images).collect()} == {("a/1.png", 640, 480), ("b.png", *export.DEFAULT_SIZE), ("c.png", *export.DEFAULT_SIZE)}
    backends.upload(images.where("content is not null"), backends.FolderStore(str(tmp_path / "store")))
    assert (tmp_path / "store" / "a" / "1.png").read_bytes() == png


def test_expand(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "x.json").write_text("{}")
    found, missing = readers.expand(spark, [f"{tmp_path}/*/x.json", f"{tmp_path}/a/x.json", f"{tmp_path}/none"])
    assert [x.split("/")[-2] for x in found] == ["a", "b"] and missing == [f"{tmp_path}/none"]
    assert [r["path"][-8:-7] for r in readers.by_name(readers.listing(spark, str(tmp_path), "*.json")).collect()] == ["a", "b"]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.pdf").write_bytes(b"x" * 1500)
    run = lambda *a: cli.main([str(x) for x in a], spark)
    out = tmp_path / "out"
    assert run("process", "--input", tmp_path / "in", "--output", out) == 0
    assert run("process", "--input", tmp_path, "--output", out) == 1 and "no PDF files" in capsys.readouterr().err
    assert run("annotate", "--output", out) == 1 and run("annotate-batch", "--input", out, "--output", tmp_path / "ann") == 0
    assert run("annotate", "--pdf", tmp_path / "in" / "p.pdf", "--output", tmp_path / "direct") == 0
    assert run("build", "--input", f"{tmp_path}/ann/annotations/*/", "--extractions", f"{out}/extractions/*/", "--output", tmp_path / "man") == 0
    assert run("evaluate", "--annotations", f"{tmp_path}/ann/annotations/*/", "--extractions", f"{out}/extractions/*/", "--output", tmp_path / "eval") == 0
    assert "F1 1.0000" in capsys.readouterr().out
    assert run("evaluate-single", "--annotations", f"{tmp_path}/ann/annotations/*/", "--extractions", f"{out}/extractions/*/") == 0
    assert run("report", "--inputs", tmp_path / "eval" / "json", tmp_path / "eval" / "json", "--output", tmp_path / "side") == 0
    assert "| Run 2 | benchmark | 1 | 1.0000 | 1.0000 | 1.0000 |" in {r[0] for r in spark.read.text(str(tmp_path / "side")).collect()}
    assert run("report", "--inputs", "x", "--labels", "a", "b", "--output", "y") == 1
    assert run("validate", "--manifest", tmp_path / "man", "--base", tmp_path) == 1
    with pytest.raises(SystemExit):
        run("nothing")
