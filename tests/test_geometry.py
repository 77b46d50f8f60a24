import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.functions.geometry import Box, horizontal_overlap, iou, thousandths_to_pixels, to_points, vertical_distance
from pagewright.operators import labels, matching
from pagewright.operators.evaluation import metrics


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(x1, y1, x2, y2):
    return Box(*[F.lit(float(v)) for v in (x1, y1, x2, y2)])


@pytest.mark.parametrize("a, b, want", [((100, 300), (100, 300), 1.0), ((100, 300), (200, 400), 0.5), ((100, 200), (300, 400), 0.0), ((100, 400), (150, 250), 1.0), ((5, 5), (0, 9), 0.0)])
def test_overlap(spark, a, b, want):
    assert one(spark, horizontal_overlap(box(a[0], 0, a[1], 1), box(b[0], 0, b[1], 1))) == want


@pytest.mark.parametrize("side, item, cap, want", [("below", (100, 200), (220, 260), 20.0), ("above", (200, 400), (140, 180), 20.0), ("above", (200, 400), (420, 460), None), ("both", (200, 400), (420, 460), 20.0), ("both", (200, 400), (140, 180), 20.0), ("below", (100, 200), (199, 260), None), ("both", (100, 200), (199, 260), 0.0)])
def test_distance(spark, side, item, cap, want):
    assert one(spark, vertical_distance(box(0, item[0], 1, item[1]), box(0, cap[0], 1, cap[1]), side)) == want


@pytest.mark.parametrize("a, b, want", [((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 20, 10), (10, 0, 30, 10), 1 / 3), ((0, 0, 20, 10), (0, 0, 10, 10), 0.5)])
def test_iou(spark, a, b, want):
    assert one(spark, iou(box(*a), box(*b))) == want


def test_limits_included(spark):
    valid = lambda i, c: one(spark, matching.is_valid(box(*i), box(*c), "below", 100.0, 0.3))
    assert valid((0, 0, 100, 10), (70, 110, 170, 120))
    assert not valid((0, 0, 100, 10), (70, 110.5, 170, 120))
    assert not valid((0, 0, 100, 10), (71, 110, 171, 120))


def test_units(spark):
    assert one(spark, to_points(box(200, 0, 0, 0)).x1) == 72.0
    assert one(spark, thousandths_to_pixels(box(333, 0, 0, 0), F.lit(1654), F.lit(1)).x1) == 550


def test_metrics(spark):
    m = metrics(F.lit(132), F.lit(24), F.lit(53))
    assert [round(one(spark, m[k]), 4) for k in ("precision", "recall", "f1")] == [0.8462, 0.7135, 0.7742]
    assert one(spark, metrics(F.lit(0), F.lit(0), F.lit(0))["f1"]) == 0.0


def test_labels(spark):
    lab = lambda k, n, i: one(spark, labels.numbered_label(F.lit(k), F.lit(n).cast("int"), F.lit(i)))
    assert [lab("figure", 1, 0), lab("table", 2, 0), lab("caption", 3, 0), lab("figure", None, 4), lab("x", 1, 0)] == ["F1", "T2", "C3", "F5", "?1"]
    assert one(spark, labels.class_label(F.lit("Figure"), F.lit(0.9))) == "Figure: 0.90"


@pytest.mark.parametrize("raw, n", [('```json\n{"matches":[{"figure_id":1,"caption_id":2,}],}\n```', 1), ('ok {"matches":[]} bye', 0), ("no json", None)])
def test_answers(spark, raw, n):
    got = one(spark, text.parse_answer(F.lit(raw)))
    assert got["success"] == (n is not None)
    assert (len(got["body"]["matches"]) if n is not None else None) == n


def test_error_cell(spark):
    assert one(spark, text.short_error(F.lit("x" * 31))) == "x" * 27 + "..."
    assert one(spark, text.short_error(F.lit("x" * 30))) == "x" * 30


def brute(items, caps, side):
    pairs = []
    for i, a in items:
        for c, b in caps:
            d = b[1] - a[3] if side == "below" else a[1] - b[3]
            w = min(a[2] - a[0], b[2] - b[0])
            over = max(0, min(a[2], b[2]) - max(a[0], b[0])) / w if w > 0 else 0
            if 0 <= d <= 100 and over >= 0.3:
                pairs.append((d, i, c))
    used_i, used_c, out = set(), set(), set()
    for d, i, c in sorted(pairs):
        if i not in used_i and c not in used_c:
            used_i.add(i)
            used_c.add(c)
            out.add((i, c))
    return out


def test_greedy_random(spark):
    r = random.Random(3)
    rows, want = [], set()
    for page in range(150):
        boxes = []
        for k in range(r.randint(0, 14)):
            x, y = r.randrange(0, 300, 20), r.randrange(0, 300, 10)
            boxes.append((k, r.choice(["Figure", "Figure-Caption", "Figure-caption", "Table", "Table-Caption"]), (x, y, x + r.choice([0, 40, 80]), y + 20)))
        rows += [(1, page, k, n, 0.5, *map(float, b)) for k, n, b in boxes]
        for kind, side in (("Figure", "below"), ("Table", "above")):
            got = brute([(k, b) for k, n, b in boxes if n == kind], [(k, b) for k, n, b in boxes if n.lower() == f"{kind.lower()}-caption"], side)
            want |= {(page, kind.lower(), i, c) for i, c in got}
    det = spark.createDataFrame(rows, "doc_id long, page_number long, det_idx long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {(x["page_number"], x["kind"], x["item_idx"], x["cap_idx"]) for x in matching.greedy(matching.candidates(*matching.sides(det))).collect()}
    assert got == want and len(want) > 20
