"""Answers of a vision-language model about a page: from text to matches and unmatched items.

Everything about a page meets in one row (``annotate``): its elements and the model's answer, as arrays that what one
image can hold bounds. What follows from them is array expressions over that row, so elements and answers are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import item_id, let, parse_answer
from pagewright.operators.matching import BOX, PAGE


def parse(answers: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Adds ``success, error`` and ``body``; a call that failed (columns success, error) stays failed."""
    called = "success" in answers.columns
    rest = [c for c in answers.columns if c not in ("success", "error", "body")]
    parsed = answers.withColumn("_a", parse_answer(F.col(raw)))
    good = F.coalesce(F.col("success") & F.col("_a.success"), F.lit(False)) if called else F.col("_a.success")
    said = F.coalesce(F.col("error"), F.col("_a.error")) if "error" in answers.columns else F.col("_a.error")
    return parsed.select(*rest, good.alias("success"), said.alias("error"), F.when(good, F.col("_a.body")).alias("body"))


def matches(parsed: DataFrame) -> DataFrame:
    """One row for each match of an answer that names an item; kind ``figure`` and confidence 1 unless told."""
    rows = parsed.where("success").select(*PAGE, F.posexplode("body.matches").alias("ord", "m")).where("m.figure_id is not null")
    return rows.select(*PAGE, "ord", F.col("m.figure_id").alias("figure_no"), F.coalesce("m.figure_type", F.lit("figure")).alias("kind"), F.col("m.caption_id").alias("caption_no"), F.coalesce("m.confidence", F.lit(1.0)).alias("confidence"), F.col("m.reasoning").alias("reasoning"))


def _match(els: Column, page: Column, m: Column, i: Column) -> Column:
    """A match with the boxes of its elements, null where its item isn't there."""
    kind, caption = F.coalesce(m["figure_type"], F.lit("figure")), m["caption_id"]
    of = lambda wanted, no: F.get(F.filter(els, lambda e: (e["kind"] == wanted) & (e["no"] == no)), F.lit(0))
    many = F.array_max(F.transform(F.filter(els, lambda e: e["kind"] == kind), lambda e: e["no"]))
    real = F.when(m["figure_id"] > 0, m["figure_id"]).otherwise(many + m["figure_id"])
    has = F.coalesce(caption != 0, F.lit(False))

    def made(item: Column, cap: Column) -> Column:
        return F.struct(
            i.alias("ord"), m["figure_id"].alias("figure_no"), kind.alias("kind"), caption.alias("caption_no"), F.coalesce(m["confidence"], F.lit(1.0)).alias("confidence"), m["reasoning"].alias("reasoning"),
            *[item[c].alias(c) for c in BOX], *[cap[c].alias(f"c{c}") for c in BOX], cap["text"].alias("caption_text"),
            item_id(kind, page, m["figure_id"]).alias("figure_id"), F.when(has, item_id(F.lit("caption"), page, caption)).alias("caption_id"),
        )

    found = let(of(kind, real), lambda item: let(of(F.lit("caption"), caption), lambda cap: F.when(item.isNotNull(), made(item, cap))))
    return F.when(m["figure_id"].isNotNull() & kind.isin("figure", "table"), found)


def annotate(parsed: DataFrame, elements: DataFrame) -> DataFrame:
    """A row for each page that has elements or an answer: ``success, matches, unmatched``.

    ``elements``: kind, no, box and text by page. A match of an unknown kind or of an item that isn't there goes; a caption
    that isn't there keeps its id without a box; caption 0 is none. Item 0 and below count from the end, as far as
    there are that many. ``unmatched`` are the elements that no match took, and the captions that the answer itself
    calls unmatched, with their boxes where there are any.
    """
    element = F.struct("kind", "no", *BOX, "text")
    held = elements.groupBy(*PAGE).agg(F.sort_array(F.collect_list(element)).alias("els"))
    pages = parsed.select(*PAGE, "success", F.col("body.matches").alias("told"), F.col("body.unmatched_captions").alias("loose")).join(held, PAGE, "full")
    els = F.coalesce("els", F.array().cast(held.schema["els"].dataType))
    pages = pages.select(*PAGE, F.coalesce("success", F.lit(False)).alias("success"), els.alias("els"), F.coalesce("told", F.array().cast(parsed.schema["body"].dataType["matches"].dataType)).alias("told"), "loose")
    page, e = F.col("page_number"), F.col("els")
    found = F.filter(F.transform("told", lambda m, i: _match(e, page, m, i)), lambda x: x.isNotNull())
    pages = pages.withColumn("matches", found)
    taken = lambda x: F.exists("matches", lambda m: F.when(x["kind"] == "caption", (m["caption_no"] == x["no"]) & m["cx1"].isNotNull()).otherwise((m["kind"] == x["kind"]) & (m["figure_no"] == x["no"])))
    bare = lambda kind, no, of: F.struct(kind.alias("kind"), no.cast("bigint").alias("no"), item_id(kind, page, no).alias("item_id"), *[of[c].alias(c) for c in BOX])
    rest = F.transform(F.filter(e, lambda x: ~F.coalesce(taken(x), F.lit(False))), lambda x: bare(x["kind"], x["no"], x))
    caption = lambda no: F.get(F.filter(e, lambda x: (x["kind"] == "caption") & (x["no"] == no)), F.lit(0))
    said = F.transform(F.coalesce("loose", F.array().cast("array<int>")), lambda no: let(caption(no), lambda c: bare(F.lit("caption"), no, c)))
    return pages.select(*PAGE, "success", "matches", F.array_distinct(F.concat(rest, said)).alias("unmatched"))


def resolved(pages: DataFrame) -> DataFrame:
    """The matches of ``annotate``, one a row."""
    return pages.select(*PAGE, F.explode("matches").alias("m")).select(*PAGE, "m.*")


def unmatched(pages: DataFrame) -> DataFrame:
    """The unmatched elements of ``annotate``, one a row."""
    return pages.select(*PAGE, F.explode("unmatched").alias("u")).select(*PAGE, "u.*")


def documents(pages: DataFrame, annotator: str, created_at: Column) -> DataFrame:
    """Annotations by document as annotation files nest them; a page without an answer has empty lists.

    A document is as long as its pages.
    """
    box = lambda x, prefix="": F.when(x[f"{prefix}x1"].isNotNull(), F.struct(*[x[f"{prefix}{c}"].alias(c) for c in BOX]))
    match = lambda m: F.struct(m["figure_id"].alias("figure_id"), m["kind"].alias("figure_type"), box(m).alias("figure_bbox"), m["caption_id"].alias("caption_id"), box(m, "c").alias("caption_bbox"), m["caption_text"].alias("caption_text"), m["confidence"].alias("confidence"), m["reasoning"].alias("reasoning"))
    ids = lambda kind: F.transform(F.array_sort(F.transform(F.filter("unmatched", lambda u: (u["kind"] == kind) & F.col("success")), lambda u: F.struct(u["no"], u["item_id"]))), lambda u: u["item_id"])
    page = F.struct("page_number", F.transform("matches", match).alias("matches"), *[ids(k).alias(f"unmatched_{k}s") for k in ("figure", "table", "caption")])
    rows = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", page.alias("p")))).alias("held"))
    return rows.select(F.col("doc_id").alias("pdf_name"), F.size("held").alias("total_pages"), F.lit(annotator).alias("annotator"), created_at.alias("created_at"), F.transform("held", lambda h: h["p"]).alias("pages"))


def direct_pages(parsed: DataFrame) -> DataFrame:
    """Pages that a model has read by itself: its elements, its matches that name an item, and its three unmatched lists.

    A page whose answer failed has empty lists and its error; a type or confidence that isn't told is ``figure`` and 1.
    """
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    match = lambda m: F.struct(m["figure_id"].alias("figure_id"), F.coalesce(m["figure_type"], F.lit("figure")).alias("figure_type"), m["caption_id"].alias("caption_id"), F.coalesce(m["confidence"], F.lit(1.0)).alias("confidence"), m["reasoning"].alias("reasoning"))
    kinds = {f.name: f.dataType for f in parsed.schema["body"].dataType}
    found = F.transform(F.filter(empty("body.matches", kinds["matches"]), lambda m: m["figure_id"].isNotNull()), match)
    return parsed.select(*PAGE, "success", "error", empty("body.elements", kinds["elements"]).alias("elements"), found.alias("matches"), *[empty(f"body.unmatched_{k}s", "array<int>").alias(f"unmatched_{k}s") for k in ("figure", "table", "caption")])


def direct_statistics(pages: DataFrame) -> DataFrame:
    """By document: elements by type, matches, matches with a caption, pages with elements."""
    of = lambda kind: F.sum(F.size(F.filter("elements", lambda e: e["type"] == kind))).alias(f"total_{kind}s")
    return pages.groupBy("doc_id").agg(*[of(k) for k in ("figure", "table", "caption")], F.sum(F.size("matches")).alias("total_matches"), F.sum(F.size(F.filter("matches", lambda m: m["caption_id"].isNotNull()))).alias("matches_with_captions"), F.count_if(F.size("elements") > 0).alias("pages_with_content"))


def direct_documents(pages: DataFrame, annotator: str, created_at: Column) -> DataFrame:
    """Direct annotations by document, with mode and statistics; pages in order."""
    page = F.struct("page_number", "elements", "matches", "unmatched_figures", "unmatched_tables", "unmatched_captions", F.when(~F.col("success"), F.struct(F.lit(False).alias("success"), "error")).alias("vlm_response"))
    rows = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", F.to_json(page).alias("p")))).alias("held"))
    kind = pages.select(page.alias("p")).schema["p"].dataType
    told = rows.join(direct_statistics(pages), "doc_id")
    numbers = [c for c in direct_statistics(pages).columns if c != "doc_id"]
    return told.select(F.col("doc_id").alias("pdf_name"), F.size("held").alias("total_pages"), F.lit(annotator).alias("annotator"), F.lit("direct").alias("mode"), created_at.alias("created_at"), F.transform("held", lambda h: F.from_json(h["p"], kind)).alias("pages"), F.struct(*numbers).alias("statistics"))


def without_items(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Pages with no figure and no table, for which no model is asked."""
    return pages.select(*PAGE).join(elements.where("kind in ('figure', 'table')"), PAGE, "left_anti")


def boxes_told(elements: DataFrame) -> DataFrame:
    """By page: how many elements have a box, and how many have none."""
    return elements.groupBy(*PAGE).agg(F.count_if(F.col("x1").isNotNull()).alias("with_box"), F.count_if(F.col("x1").isNull()).alias("without_box"))


def document_counts(resolved: DataFrame) -> DataFrame:
    """By document; ``total_figures`` counts the matches of tables too."""
    return resolved.groupBy("doc_id").agg(F.count("*").alias("total_figures"), F.count_if(F.col("kind") == "table").alias("total_tables"), F.count_if(F.col("caption_id").isNotNull()).alias("total_with_captions"), F.countDistinct("page_number").alias("pages_with_matches"))


def describe(elements: DataFrame) -> DataFrame:
    """The lines that tell a model of a page's elements, as one text."""
    where = F.concat(F.lit("("), F.round("x1").cast("bigint"), F.lit(", "), F.round("y1").cast("bigint"), F.lit(")"))
    short = F.when(F.length("text") > 50, F.concat(F.left("text", F.lit(50)), F.lit("..."))).when(F.length("text") > 0, F.col("text")).otherwise("[no text]")
    line = F.when(F.col("kind") == "caption", F.concat(F.lit("  - C"), "no", F.lit(': "'), short, F.lit('" at '), where)).otherwise(F.concat(F.lit("  - "), F.when(F.col("kind") == "figure", "F").otherwise("T"), "no", F.lit(": at position "), where))
    rank = F.when(F.col("kind") == "figure", 0).when(F.col("kind") == "table", 1).otherwise(2)
    # The headings of the three kinds.
    heading = F.when(F.col("kind") == "figure", "FIGURES (green boxes):").when(F.col("kind") == "table", "TABLES (blue boxes):").otherwise("CAPTIONS (orange boxes):")
    rows = elements.select(*PAGE, rank.alias("r"), "no", line.alias("line")).unionByName(elements.select(*PAGE, rank.alias("r"), F.lit(0).alias("no"), heading.alias("line")).distinct())
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "no", "line"))), lambda x: x["line"]), "\n").alias("description"))


#: What a prompt says of a page without elements. Fixed value.
EMPTY = "No figures, tables, or captions detected on this page."
PROMPT = """Pair each figure and table on this page with its caption.

{elements}

Answer with a JSON object: "matches", a list of objects with figure_id, figure_type (figure or table), caption_id (or null),
confidence (0 to 1) and reasoning; and "unmatched_captions", a list of caption numbers."""
DIRECT_PROMPT = """List the figures, tables and captions on this page, and pair them.

Answer with a JSON object: "elements", a list of objects with id, type, description or text, and bbox (x1, y1, x2, y2, from 0 to
1000); "matches" as objects with figure_id, figure_type, caption_id, confidence and reasoning; and the lists
"unmatched_figures", "unmatched_tables" and "unmatched_captions"."""


def prompts(pages: DataFrame, elements: DataFrame, template: str = PROMPT) -> DataFrame:
    """A prompt for every page."""
    told = pages.select(*PAGE).join(describe(elements), PAGE, "left")
    return told.select(*PAGE, F.replace(F.lit(template), F.lit("{elements}"), F.coalesce("description", F.lit(EMPTY))).alias("prompt"))
