"""SimHash near-duplicates: pigeonhole blocks, joins on blocks, verified Hamming distances.

A fingerprint is cut into ``distance + same`` blocks; two that differ in at most ``distance`` bits agree in at least
``same`` blocks, so each choice of ``same`` blocks is a key, and close pairs share one. Components, not pairs, are
wanted, and copies are common, so a bucket's pairs are never listed:

1. equal fingerprints are one node;
2. in each bucket every node is compared with four members of the bucket only (a link to one of these costs a row);
3. after components of those links, only buckets that still hold more than one component are compared, and there the
   nodes outside of the bucket's largest component with all nodes of other components, inside the join's condition.
   A link between two components has an end outside of the largest one, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch, hot_join, prepare, ship
from pagewright.llm.components import components

ship(__name__)

SHINGLE, DISTANCE = 4, 4
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, as an unsigned number: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_280):  # 256 groups of 255, whose sums fit a byte
        pairs = zip(starts[at : at + 65_280].tolist(), last[at : at + 65_280].tolist(), strict=False)
        hashes = np.array([digest(line[a:b], 42) for a, b in pairs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp long`` (the fingerprint as a signed number), one row for each row of ``docs``."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def block_keys(fp: Column, distance: int, same: int) -> Column:
    """An array of the keys of a fingerprint, each the chosen blocks' bits with the number of the choice above them."""
    blocks = distance + same
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), same)):
        key = F.lit(number).cast("bigint")
        for b in chosen:
            width = cuts[b + 1] - cuts[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, cuts[b]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def blocks_for(n: int) -> int:
    """How many blocks a key has: more for more fingerprints, so that few meet by chance. The result is the same.

    Up to a bound, the rows that meet by chance grow with the square of ``n``, so a step is made while a key of so many
    bits is shared by chance with less than a quarter of a node.
    """
    return 2 if n < 1 << 19 else 3 if n < 1 << 25 else 4


def link(nodes: DataFrame, scratch: Scratch, distance: int = DISTANCE, same: int | None = None) -> DataFrame:
    """(node, root) for the fingerprints of ``nodes (fp)`` (distinct) that are linked to others."""
    same = same or blocks_for(nodes.count())
    keys = nodes.select("fp", F.explode(block_keys(F.col("fp"), distance, same)).alias("key"))
    salted = F.xxhash64("fp")
    pivots = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("p1"), F.max("fp").alias("p2"), F.min_by("fp", salted).alias("p3"), F.max_by("fp", salted).alias("p4")).where("n > 1")
    met = scratch.keep(hot_join(keys, scratch.keep(pivots), ["key"], "n").drop("n"))
    to = F.explode(F.array_distinct(F.array("p1", "p2", "p3", "p4")))
    star = met.select(F.col("fp").alias("a"), to.alias("b")).where((F.col("a") != F.col("b")) & near(F.col("a"), F.col("b"), distance))
    first = components(star, scratch)
    held = scratch.keep(met.select("key", "fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("comp")))
    # Buckets with more than one component, and the largest of it.
    sizes = held.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main")).where("comps > 1").drop("comps")
    open_ = scratch.keep(held.join(mixed, "key"))
    few = open_.where("comp <> main").select("key", F.col("fp").alias("fp2"), F.col("comp").alias("comp2"))
    cross = open_.join(few, (open_["key"] == few["key"]) & (open_["comp"] != few["comp2"]) & ((open_["comp"] == open_["main"]) | (open_["fp"] < few["fp2"])) & near(open_["fp"], few["fp2"], distance))
    second = scratch.keep(components(cross.select(F.col("comp").alias("a"), F.col("comp2").alias("b")), scratch).withColumnsRenamed({"node": "comp", "root": "top"}))
    held_by = first.select(F.col("node").alias("fp"), F.col("root").alias("comp"))
    alone = second.join(first.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("top").alias("root"))
    return held_by.join(second, "comp", "left").select(F.col("fp").alias("node"), F.coalesce("top", "comp").alias("root")).unionByName(alone)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, same: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id, n_class``, one row for each row of ``docs``.

    ``component_id`` is the smallest id reached over links of at most ``distance`` bits, ``n_class`` the rows with the same
    fingerprint. Texts without words (null, empty, white space) have fingerprint zero and are linked like any other.
    Repeated rows are kept and share a component; null ids are kept and are never the smallest unless alone; an empty
    table gives an empty one; columns other than the two named are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs, shingle, id_col, text_col))
    nodes = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_class")))
    roots = scratch.keep(link(nodes.select("fp"), scratch, distance, same))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = scratch.keep(rooted.join(lowest, "root").select("fp", "component_id", "n_class"))
    scratch.drop_all_but(marked, classes)
    return hot_join(marked, classes, ["fp"], "n_class").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_class")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: the one with the smallest id, null ids last; columns as ``docs`` has them.

    Rows that share id and text are one document, of which one row stays. Documents without an id are told apart by a
    hash of their text.
    """
    names = docs.columns
    whole = docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    found = near_duplicates(whole.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), **options)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    # Rows of one key are one before they are shuffled, however many.
    kept = whole.groupBy("key").agg(F.any_value("row").alias("row")).join(first, "key", "left_semi")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
