"""Spans of regular expressions as DataFrame expressions: no Python runs on the rows.

``regexp_extract_all`` gives the matches of a text and ``split`` what stands between them; both walk the same leftmost
matches that do not overlap, so running lengths give each match's place in code points.

Patterns here never go back over what they have taken (possessive quantifiers), and begin only where a run of their
first class does, so that long runs cost time in proportion to their length and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"
#: Elements of an array that one fold runs over; a fold that gathers an array costs the square of this, not of the array.
BLOCK = 256


def no_spans() -> Column:
    return F.array().cast(SPAN)


def running(items: Column, kind: str, width, make) -> Column:
    """An array made of ``items`` (cast to ``kind``) by ``make(item, at)``, where ``at`` sums up ``width(item)`` of those before.

    Blocks of ``BLOCK`` items are folded each for itself, then their sums, so the cost doesn't grow with the square of the items.
    """
    n = F.size(items)
    places = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / BLOCK), F.lit(0)).cast("int"))
    sums = "struct<at:int,out:array<int>>"
    start = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast(sums)

    def scan(values: Column) -> Column:  # the sums before each value, and of all
        return F.aggregate(values, start(), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast(sums))

    block = lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK))
    parts = F.transform(places, lambda b: F.struct(block(b).alias("items"), scan(F.transform(block(b), width)).alias("sums")))

    def joined(parts: Column) -> Column:
        bases = scan(F.transform(parts, lambda p: p["sums"]["at"]))["out"]
        placed = F.zip_with(parts, bases, lambda p, base: F.zip_with(p["items"], p["sums"]["out"], lambda x, at: make(x, at + base)))
        return F.flatten(placed)

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + width(x)).alias("at"), F.concat(acc["out"], F.array(make(x, acc["at"]))).alias("out"))

    few = F.aggregate(items, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
    return F.when(n <= BLOCK, few).otherwise(F.element_at(F.transform(F.array(parts), joined), 1)).cast(kind)


def find(df: DataFrame, patterns: dict[str, tuple[str, str]], text: str = "text") -> DataFrame:
    """Adds a column of spans ``array<struct<s,e,m>>`` for each name: the matches of its pattern in ``text``.

    ``patterns``: by name, a cheap test that each text with a match passes, and the pattern.
    """
    t = F.col(text)
    df = df.withColumns({f"_{n}": F.when(t.rlike(gate), F.regexp_extract_all(t, F.lit(p), F.lit(0))) for n, (gate, p) in patterns.items()})

    def places(name: str, pattern: str) -> Column:
        m = F.col(f"_{name}")
        gaps = F.split(t, pattern, -1)
        pairs = F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda a, b: F.struct(a.alias("m"), F.length(b).alias("g"), F.length(a).alias("n")))

        def make(x: Column, at: Column) -> Column:
            s = at + x["g"]
            return F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["m"].alias("m"))

        return F.when(F.size(m) > 0, running(pairs, SPAN, lambda x: x["g"] + x["n"], make)).otherwise(no_spans())

    return df.withColumns({n: places(n, p) for n, (_, p) in patterns.items()}).drop(*[f"_{n}" for n in patterns])


def merged(kinds: list[str]) -> Column:
    """The spans of these columns as one array of ``struct<s, k, e>``, by start, then kind as listed, then end."""

    def part(k: int) -> Column:  # a lambda of two parameters would get the index
        return F.transform(kinds[k], lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    return F.array_sort(F.concat(*map(part, range(len(kinds)))))


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of such an array, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def clear_of(candidates: Column, taken: Column) -> Column:
    """The candidates that overlap none of the spans taken."""
    return F.filter(candidates, lambda c: ~F.exists(taken, lambda x: (x["s"] < c["e"]) & (c["s"] < x["e"])))
