"""Evaluation of predicted captions against ground truth, by the boxes' intersection over union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import Box, iou
from pagewright.operators.matching import BOX, PAGE

ITEM_IOU, CAPTION_IOU, CONFIDENCE = 0.5, 0.5, 0.7


def high_confidence(truth: DataFrame, threshold: float = 0.8) -> DataFrame:
    return truth.where(F.col("confidence") >= threshold)


def best_match(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each row of ``truth`` with the prediction on its page of the highest IoU, the first by ``pred_ord`` of equal ones.

    ``item_iou`` is given for a best match that is too low to count, 0 where nothing overlaps; kinds are not compared.
    Pages are small, so the join on the page stays near the size of its input.
    """
    pred = predictions.select(*PAGE, "pred_ord", *[F.col(c).alias(f"p{c}") for c in BOX], *[F.col(f"c{c}").alias(f"pc{c}") for c in BOX])
    met = truth.join(pred, PAGE, "left").withColumn("item_iou", F.coalesce(iou(Box.of(), Box.of("p")), F.lit(0.0)))
    order = Window.partitionBy(*PAGE, "gt_ord").orderBy(F.desc("item_iou"), F.asc_nulls_last("pred_ord"))
    best = met.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return best.withColumn("found", F.coalesce(F.col("item_iou") >= ITEM_IOU, F.lit(False)) & F.col("pred_ord").isNotNull())


def compare(matched: DataFrame) -> DataFrame:
    """Adds ``is_correct``, ``caption_iou`` and ``error_type``. A row without a match has no predicted caption."""
    gt, pred = F.col("gx1").isNotNull(), F.col("found") & F.col("pcx1").isNotNull()
    both = F.coalesce(iou(Box.of("g"), Box.of("pc")), F.lit(0.0))
    caption = F.when(~gt & ~pred, F.lit(1.0)).when(gt & pred, both).otherwise(F.lit(0.0))
    right = F.when(~gt & ~pred, F.lit(True)).when(gt & pred, both >= CAPTION_IOU).otherwise(F.lit(False))
    kind = F.when(right, F.lit(None)).when(~gt, "false_positive").when(~pred, "false_negative").otherwise("wrong_match")
    return matched.withColumns({"has_gt": gt, "caption_iou": caption, "is_correct": right, "error_type": kind})


def metrics(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 where there is nothing to divide by."""
    p = F.when(tp + fp > 0, tp.cast("double") / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp.cast("double") / (tp + fn)).otherwise(F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(F.lit(0.0))}


def counts(compared: DataFrame, keys: list[str]) -> DataFrame:
    """tp, correct without caption, fp and fn; a wrong match is one of each of the last two."""
    wrong = F.col("error_type") == "wrong_match"
    out = compared.groupBy(*keys) if keys else compared.groupBy()
    return out.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_correct") & F.col("has_gt")).alias("tp"),
        F.count_if(F.col("is_correct") & ~F.col("has_gt")).alias("correct_no_caption"),
        F.count_if((F.col("error_type") == "false_positive") | wrong).alias("fp"),
        F.count_if((F.col("error_type") == "false_negative") | wrong).alias("fn"),
    )


def evaluate(compared: DataFrame, keys: list[str]) -> DataFrame:
    return counts(compared, keys).withColumns(metrics(F.col("tp"), F.col("fp"), F.col("fn")))


def by_kind(compared: DataFrame, keys: list[str]) -> DataFrame:
    """By kind of item: here a wrong match counts nowhere, and tp asks for a caption's id, not its box."""
    rows = compared.groupBy(*keys, "kind").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_correct") & F.col("caption_id").isNotNull()).alias("tp"),
        F.count_if(F.col("error_type") == "false_positive").alias("fp"),
        F.count_if(F.col("error_type") == "false_negative").alias("fn"),
        F.count_if("is_correct").alias("correct"),
    )
    return rows.withColumns(metrics(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("accuracy", F.col("correct").cast("double") / F.col("total"))


def batch_by_kind(compared: DataFrame, corrected: bool = False) -> DataFrame:
    """A batch's metrics by kind, from each document's rounded accuracy and cut to whole counts, with no false positive.

    ``corrected`` adds the counts themselves instead.
    """
    docs = by_kind(compared, ["doc_id"])
    if corrected:
        pooled = docs.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    else:
        rounded = F.floor(F.col("accuracy") * 10000.0 + 0.5) / F.lit(10000.0)
        cut = docs.select("kind", F.floor(F.col("total") * rounded).cast("bigint").alias("tp"), F.floor(F.col("total") * (1.0 - rounded)).cast("bigint").alias("fn"))
        pooled = cut.groupBy("kind").agg(F.sum("tp").alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.sum("fn").alias("fn"))
    return pooled.withColumns(metrics(F.col("tp"), F.col("fp"), F.col("fn")))


def error_histogram(compared: DataFrame) -> DataFrame:
    return compared.where("not is_correct").groupBy("error_type").agg(F.count("*").alias("n"))


#: Fixed value: what an error's list says of a prediction that was found.
MATCHED = "matched (IoU-based)"


def errors_by_page(compared: DataFrame) -> DataFrame:
    return compared.where("not is_correct").select(*PAGE, "figure_id", "error_type", F.when(F.col("found") & F.col("pcx1").isNotNull(), MATCHED).alias("predicted"), F.col("caption_id").alias("expected"))


def matches_of_page(truth: DataFrame, page: int) -> DataFrame:
    return truth.where(F.col("page_number") == page)


def caption_map(truth: DataFrame) -> DataFrame:
    """Caption id by item id; of several, the last by ``gt_ord``."""
    return truth.groupBy("doc_id", "figure_id").agg(F.max_by("caption_id", "gt_ord").alias("caption_id"))


def dataset_statistics(truth: DataFrame) -> DataFrame:
    held = F.length("caption_id") > 0
    return truth.groupBy("doc_id").agg(F.count("*").alias("total_matches"), F.count_if((F.col("kind") == "figure") & held).alias("figures_with_captions"), F.count_if((F.col("kind") == "table") & held).alias("tables_with_captions"))


def merge(datasets: list[DataFrame]) -> DataFrame:
    """All rows of several datasets; which document they were of is lost."""
    if not datasets:
        raise ValueError("no datasets to merge")
    out = datasets[0]
    for d in datasets[1:]:
        out = out.unionByName(d)
    return out.withColumn("pdf_name", F.lit("merged"))
