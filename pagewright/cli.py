"""Commands over files: annotate, annotate-batch, build, evaluate, evaluate-single, validate, report, process.

Backends are given as ``module:name`` of a class without arguments; the stubs of ``sources.backends`` are the default.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import iso_time
from pagewright.operators import evaluation, manifest, report
from pagewright.plans import runs
from pagewright.sources import backends, readers, writers

STUBS = "pagewright.sources.backends"


def backend(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagewright", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        sub = commands.add_parser(name)
        for flag, settings in options:
            sub.add_argument(flag, **settings)

    need, callers = {"required": True}, ("--max-workers", {"type": int, "default": 5})
    model, source = ("--model", {"default": f"{STUBS}:StubModel"}), ("--pages", {"default": f"{STUBS}:StubPages"})
    out, truth, found = ("--output", need), ("--annotations", need), ("--extractions", need)
    sure = ("--min-confidence", {"type": float, "default": evaluation.CONFIDENCE})
    command("process", ("--input", need), out, source, ("--detector", {"default": f"{STUBS}:StubDetector"}), ("--confidence", {"type": float, "default": 0.25}))
    command("annotate", ("--pdf", {}), ("--input", {}), out, model, source, callers)
    command("annotate-batch", ("--input", need), out, model, callers, ("--skip-existing", {"action": "store_true"}))
    command("build", ("--input", need), ("--extractions", {}), out, ("--name", {"default": "benchmark"}), ("--version", {"default": "1.0"}))
    command("evaluate", truth, found, out, sure, ("--name", {"default": "benchmark"}), ("--version", {"default": "1.0"}))
    command("evaluate-single", truth, found, sure)
    command("validate", ("--manifest", need), ("--base", need))
    command("report", ("--inputs", {"required": True, "nargs": "+"}), out, ("--labels", {"nargs": "+"}))
    return p


def detected(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pages and detections that ``process`` left in a folder."""
    return spark.read.parquet(f"{folder}/pages").where("status = 'success'"), spark.read.parquet(f"{folder}/detections")


def run_annotate(spark: SparkSession, a: argparse.Namespace) -> int:
    if bool(a.pdf) == bool(a.input):
        print("either --pdf or --input is needed", file=sys.stderr)
        return 1
    return asked(spark, a, a.pdf, None)


def asked(spark: SparkSession, a: argparse.Namespace, pdf: str | None, done: DataFrame | None) -> int:
    model = backend(a.model)
    if why := backends.available(model):
        print(f"the model can't be asked: {why}", file=sys.stderr)
        return 1
    if pdf:
        files = spark.read.format("binaryFile").load(pdf).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
        pages = backends.rasterise(files, backend(a.pages)).where("status = 'success'").withColumnRenamed("name", "doc_id")
        outcome = runs.annotate_direct(pages, model, a.output, a.max_workers, a.model)
    else:
        outcome = runs.annotate_detected(*detected(spark, a.input), model, a.output, callers=a.max_workers, name=a.model, done=done)
    told = runs.batch_outcome(outcome).first()
    print(f"{told['successes']} annotated, {told['failures']} with errors")
    return 0


def run_annotate_batch(spark: SparkSession, a: argparse.Namespace) -> int:
    done = None
    if a.skip_existing and readers.expand(spark, [f"{a.output}/annotations"])[0]:
        done = readers.annotations(spark, f"{a.output}/annotations/*/").select(F.col("pdf_name").alias("doc_id"))
    return asked(spark, a, None, done)


def run_process(spark: SparkSession, a: argparse.Namespace) -> int:
    done = runs.process_folder(spark, a.input, backend(a.pages), backend(a.detector), a.output, minimum=a.confidence)
    told = runs.batch_outcome(done.outcome).first()
    print(f"{told['successes']} processed, {told['failures']} with errors")
    return 0 if told["successes"] else 1


def run_build(spark: SparkSession, a: argparse.Namespace) -> int:
    print(f"{runs.build(spark, a.input, a.extractions, a.output, a.name, a.version).count()} documents")
    return 0


def settings(a: argparse.Namespace) -> dict[str, str]:
    return {"confidence_threshold": str(a.min_confidence), "figure_iou_threshold": str(evaluation.ITEM_IOU), "caption_iou_threshold": str(evaluation.CAPTION_IOU)}


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    done = runs.evaluate_files(spark, a.annotations, a.extractions, name=a.name, version=a.version, minimum=a.min_confidence)
    writers.write_json(runs.json_report(done, settings(a), iso_time()), f"{a.output}/json", mode="overwrite")
    lines = report.markdown(done.summary, done.kinds, done.documents, settings(a), iso_time())
    writers.write_text(report.whole(lines), f"{a.output}/markdown", mode="overwrite")
    return show(done)


def run_evaluate_single(spark: SparkSession, a: argparse.Namespace) -> int:
    return show(runs.evaluate_files(spark, a.annotations, a.extractions, minimum=a.min_confidence))


def show(done: runs.Benchmark) -> int:
    told = done.summary.first()
    print(f"precision {told['precision']:.4f}, recall {told['recall']:.4f}, F1 {told['f1']:.4f}")
    return 0


def run_validate(spark: SparkSession, a: argparse.Namespace) -> int:
    checked = manifest.validate(readers.manifests(spark, a.manifest), readers.listing(spark, a.base).withColumn("path", F.regexp_replace("path", "^file:", "")), a.base)
    told = manifest.validity(checked).first()
    print(f"{told['valid_documents']} of {told['total']} valid; without annotation: {told['missing_annotations']}; without extraction: {told['missing_extractions']}")
    return 0 if told["valid"] else 1


def run_report(spark: SparkSession, a: argparse.Namespace) -> int:
    labels = a.labels or [f"Run {k + 1}" for k in range(len(a.inputs))]
    if len(labels) != len(a.inputs):
        print("as many labels as inputs are needed", file=sys.stderr)
        return 1
    told = []
    for label, path in zip(labels, a.inputs, strict=True):
        rows = readers.reports(spark, path)
        kinds = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"per_type_metrics.{k}").alias("m")) for k in ("figure", "table")])).alias("x")).select("x.kind", "x.m.*")
        config = rows.select("evaluator_config").first()[0] or {}
        told.append((label, rows.select("dataset.name", "dataset.total_documents", "summary.*"), kinds, config))
    writers.write_text(report.whole(report.comparison(told)), a.output, mode="overwrite")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; the exit code is 1 where it can't be done."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pagewright").getOrCreate()
    try:
        return globals()[f"run_{a.command.replace('-', '_')}"](spark, a)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
