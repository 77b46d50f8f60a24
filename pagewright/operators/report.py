"""Reports of evaluations as ordered lines, and runs side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import short_error


def four(c: Column) -> Column:
    return F.format_string("%.4f", c)


def document_lines(documents: DataFrame) -> DataFrame:
    """A report's table row for each document: its metrics, or its error."""
    good = F.concat(F.lit("| "), "name", F.lit(" | "), four(F.col("precision")), F.lit(" | "), four(F.col("recall")), F.lit(" | "), four(F.col("f1")), F.lit(" | OK |"))
    bad = F.concat(F.lit("| "), "name", F.lit(" | - | - | - | Error: "), short_error(F.col("error")), F.lit(" |"))
    return documents.select("name", F.when(F.col("precision").isNotNull(), good).otherwise(bad).alias("line"))


def sections(summary: DataFrame) -> DataFrame:
    """(ord, line): the head of a report for a one-row summary."""
    c = lambda name: F.col(name).cast("string")
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    item = lambda name, value: F.concat(F.lit(f"- **{name}:** "), value)
    # Headings of the report.
    lines = [
        F.lit("# Caption Matching Benchmark Report"), F.lit("## Dataset Information"), item("Name", c("name")), item("Version", c("version")), item("Total Documents", c("total_documents")), item("Successful Evaluations", c("successful_evaluations")),
        F.lit("## Overall Metrics"), row("Precision", four(F.col("precision"))), row("Recall", four(F.col("recall"))), row("F1 Score", four(F.col("f1"))),
        F.lit("## Detailed Counts"), row("True Positives", c("tp")), row("False Positives", c("fp")), row("False Negatives", c("fn")),
    ]
    return summary.select(F.posexplode(F.array(*lines)).alias("ord", "line"))


def whole(lines: DataFrame) -> DataFrame:
    """Lines (part, ord, line) in order, in one partition as one file is written; they are sorted in parts and merged, never held whole."""
    return lines.orderBy("part", "ord", "line").select("line").coalesce(1)


def markdown(summary: DataFrame, kinds: DataFrame, documents: DataFrame, config: dict[str, str], created_at: Column) -> DataFrame:
    """(part, ord, line) of a batch's whole report: head, metrics by kind, documents, errors, configuration.

    ``documents``: name, precision, recall, f1, error. Lines sort by part, then ord, then line.
    """
    spark = summary.sparkSession
    text = lambda part, lines: spark.createDataFrame([(part, float(k), x) for k, x in enumerate(lines)], "part int, ord double, line string")
    head = sections(summary).select(F.lit(0).alias("part"), F.col("ord").cast("double"), "line")
    # Headings of the report.
    names = {"figure": "### Figure Matching", "table": "### Table Matching"}
    rows = F.array(*[F.concat(F.lit(f"| {c.capitalize()} | "), four(F.col(c)), F.lit(" |")) for c in ("precision", "recall", "f1")])
    place = lambda k: F.when(F.col("kind") == "figure", 0.0).otherwise(10.0) + k
    every = spark.createDataFrame([(k,) for k in names], "kind string").join(kinds, "kind", "left").na.fill(0.0, ["precision", "recall", "f1"])
    title = F.when(F.col("kind") == "figure", names["figure"]).otherwise(names["table"])
    by_kind = every.select(place(1).alias("ord"), title.alias("line")).unionByName(every.select("kind", F.posexplode(rows).alias("k", "line")).select(place(F.col("k") + 2).alias("ord"), "line"))
    by_kind = by_kind.select(F.lit(2).alias("part"), "ord", "line")
    docs = document_lines(documents).select(F.lit(4).alias("part"), F.lit(0.0).alias("ord"), "line")
    failed = documents.where("error is not null")
    errors = failed.select(F.lit(6).alias("part"), F.lit(0.0).alias("ord"), F.concat(F.lit("- **"), "name", F.lit(":** "), "error").alias("line"))
    title = failed.limit(1).select(F.lit(5).alias("part"), F.lit(0.0).alias("ord"), F.lit("## Errors").alias("line"))
    foot = summary.select(F.lit(9).alias("part"), F.lit(0.0).alias("ord"), F.concat(F.lit("*Report generated at "), created_at, F.lit("*")).alias("line"))
    out = head
    for more in (text(1, ["## Per-Type Metrics"]), by_kind, text(3, ["## Per-Document Results", "| Document | Precision | Recall | F1 | Status |", "|----------|-----------|--------|-----|--------|"]), docs, title, errors, text(7, ["## Evaluator Configuration"]), text(8, [f"- **{k}:** {v}" for k, v in config.items()]), foot):
        out = out.unionByName(more)
    return out


def comparison(runs: list[tuple[str, DataFrame, DataFrame, dict[str, str]]]) -> DataFrame:
    """(part, ord, line) of runs side by side: for each its label, summary, metrics by kind and configuration."""
    if not runs:
        raise ValueError("no runs to compare")
    spark = runs[0][1].sparkSession
    text = lambda part, lines: spark.createDataFrame([(part, float(k), x) for k, x in enumerate(lines)], "part int, ord double, line string")
    three = [x for c in ("precision", "recall", "f1") for x in (four(F.coalesce(c, F.lit(0.0))), F.lit(" | "))][:-1]
    # Headings of the report.
    out = text(0, ["# Caption Matching Benchmark Comparison", "## Overall Comparison", "| Run | Dataset | Documents | Precision | Recall | F1 |", "|-----|---------|-----------|-----------|--------|-----|"])
    for part, kind in ((2, "figure"), (4, "table")):
        out = out.unionByName(text(part, [f"## {kind.capitalize()} Matching Comparison", "| Run | Precision | Recall | F1 |", "|-----|-----------|--------|-----|"]))
    for k, (label, summary, kinds, _) in enumerate(runs):
        line = F.concat(F.lit(f"| {label} | "), "name", F.lit(" | "), F.col("total_documents").cast("string"), F.lit(" | "), *three, F.lit(" |"))
        out = out.unionByName(summary.select(F.lit(1).alias("part"), F.lit(float(k)).alias("ord"), line.alias("line")))
        every = spark.createDataFrame([("figure", 3), ("table", 5)], "kind string, part int").join(kinds, "kind", "left")
        out = out.unionByName(every.select("part", F.lit(float(k)).alias("ord"), F.concat(F.lit(f"| {label} | "), *three, F.lit(" |")).alias("line")))
    keys = sorted({key for *_, config in runs for key in config})
    if keys:
        labels = [label for label, *_ in runs]
        table = [f"| Config | {' | '.join(labels)} |", f"|--------|{'|'.join(['-------'] * len(labels))}|"]
        table += [f"| {key} | {' | '.join(str(config.get(key, '-')) for *_, config in runs)} |" for key in keys]
        out = out.unionByName(text(6, ["## Configuration Comparison", *table]))
    return out


def side_by_side(runs: DataFrame, labels: list[str]) -> DataFrame:
    """Values of (label, key, value) by key, a column for each label, ``-`` where a run has none."""
    wide = runs.groupBy("key").pivot("label", labels).agg(F.first("value"))
    return wide.select("key", *[F.coalesce(f"`{x}`", F.lit("-")).alias(x) for x in labels])


def config_keys(runs: DataFrame) -> DataFrame:
    """The keys of all runs, in order."""
    return runs.select("key").distinct().orderBy("key")
