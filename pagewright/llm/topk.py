"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for the sign of each component, in as many words of 64 bits as the widest vector needs. A code is
cut into s segments of 16 bits. Round r looks, in every segment, for the values at distance r from the query's; a code at
distance d has a segment within d // s, so after round r all codes at distance s r + s - 1 or less are known. A query
is done when its k-th verified distance is within that. A code is taken in one round and for one segment only: its
nearest segment, the first of equal ones.

The index is chunks of ``CHUNK`` codes at most, the queries are blocks of ``BLOCK``, and every block meets every chunk: a
stated query set against all rows, in blocks. Inside such a pair each segment's values are an index of buckets. A round
either tries all values at its distance or, where these are more than the distinct values of the chunk, compares value with
value. A query takes at most k rows from a chunk, and from the second round on only those within its k-th distance so far,
so what is shuffled is k rows for each query and chunk. Spark broadcasts the blocks if their table is under its own limit
(``spark.sql.autoBroadcastJoinThreshold``) and pairs partitions otherwise; nothing is collected.

Equal codes count with their k smallest ids only, as no query needs more of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch, prepare, ship

ship(__name__)

BITS, WIDTH = 64, 16
SEGMENTS = BITS // WIDTH
#: Codes of a chunk, and queries of a block.
CHUNK, BLOCK = 32_768, 1_024


def sign_code(vector: Column, words: int = 1) -> Column:
    """``array<bigint>`` of ``words`` numbers with a bit for each component that is over zero; null for a null or empty vector."""
    bit = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.expr("1L")).otherwise(F.expr("0L"))
    codes = []
    for at in range(0, BITS * words, BITS):
        code = bit(at)
        for i in range(1, BITS):
            code = code.bitwiseOR(F.shiftleft(bit(at + i), i))
        codes.append(code)
    return F.when(F.size(vector) > 0, F.array(*codes))


@cache
def masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)], np.uint16)


def packed(df: DataFrame, most: int, value: str) -> DataFrame:
    """Rows of at most ``most`` codes of ``df (code, value)``: ``codes`` as bytes, values as an array, in the order of the values.

    Null values come first. A partition's codes are packed as they come, so no group is collected.
    """
    kind = df.schema[value].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table, sort_keys=[(value, "ascending")], null_placement="at_start")).combine_chunks()
            codes, values = table.column("code").combine_chunks(), table.column(value).combine_chunks()
            raw = codes.flatten().to_numpy().astype("<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], ["codes", f"{value}s"])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, most - n), batch.slice(most - n)
                held.append(part)
                n += part.num_rows
                if n == most:
                    yield out(held)
                    held, n = [], 0
        if n:
            yield out(held)

    return df.select("code", value).mapInArrow(run, f"codes binary, {value}s array<{kind}>")


class Buckets:
    """A chunk's codes by the value of one segment: distinct values, and which codes have each."""

    def __init__(self, segment: np.ndarray) -> None:
        self.order = np.argsort(segment, kind="stable")
        self.values, self.starts, self.counts = np.unique(segment[self.order], return_index=True, return_counts=True)
        self.place = np.full(1 << WIDTH, -1, np.int32)
        self.place[self.values] = np.arange(len(self.values))

    def at(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (which of ``asked``, code) whose values differ in exactly ``radius`` bits."""
        if comb(WIDTH, radius) <= len(self.values):
            probed = self.place[asked[:, None] ^ masks(radius)[None, :]]
            which, slot = np.nonzero(probed >= 0)
            bucket = probed[which, slot]
        else:
            which, bucket = np.nonzero(np.bitwise_count(asked[:, None] ^ self.values[None, :]) == radius)
        n = self.counts[bucket]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(which, n), self.order[np.repeat(self.starts[bucket], n) + inside]


def nearest(queries: np.ndarray, bounds: np.ndarray, codes: np.ndarray, buckets: list[Buckets], radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance) of the codes that this round finds within the queries' bounds, at most k of a query.

    ``queries`` and ``codes`` are rows of 16-bit segments; of equal distances the first codes are taken.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for j, bucket in enumerate(buckets):
        asked, back = np.unique(queries[:, j], return_inverse=True)
        which, code = bucket.at(asked, radius)
        # From asked values to the queries that have them.
        order = np.argsort(back, kind="stable")
        count = np.bincount(back, minlength=len(asked))
        first = np.cumsum(count) - count
        for low in range(0, len(which), 1 << 20):
            w, c = which[low : low + (1 << 20)], code[low : low + (1 << 20)]
            n = count[w]
            q = order[np.repeat(first[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            c = np.repeat(c, n)
            apart = np.bitwise_count(queries[q] ^ codes[c])
            d = apart.sum(axis=1, dtype=np.int32)
            fresh = (d <= bounds[q]) & (apart[:, :j] > radius).all(axis=1) & (apart[:, j:] >= radius).all(axis=1)
            found.append((q[fresh], c[fresh], d[fresh]))
    q, c, d = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((c, d, q))
    q, c, d = q[order], c[order], d[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return q[rank < k], c[rank < k], d[rank < k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, distance``: the k rows of ``vectors`` nearest to each of ``queries`` by Hamming distance.

    Ties go to smaller ids, null ids first; a row that is itself a query is its own neighbour. Null and empty vectors have no
    code: they are not found and find nothing. Repeated rows are rows of their own; repeated queries give repeated results;
    with fewer than k rows all are returned; other columns are ignored. All components count; where widths differ, a missing
    component is as one that is not over zero.
    """
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "topk")
    width = [df.agg(F.max(F.size(F.col(vector_col)))).first()[0] or 1 for df in (vectors, queries)]
    words = max(1, -(-max(width) // BITS))
    segments, tasks = SEGMENTS * words, 2 * spark.sparkContext.defaultParallelism
    asked = scratch.keep(queries.select(F.col(id_col).alias("query_id"), sign_code(F.col(vector_col), words).alias("q")).where("q is not null"))
    by_code = Window.partitionBy("code").orderBy("vec_id")
    members = vectors.select(F.col(id_col).alias("vec_id"), sign_code(F.col(vector_col), words).alias("code")).where("code is not null")
    members = members.withColumn("i", F.row_number().over(by_code)).where(F.col("i") <= k).drop("i")
    chunks = scratch.keep(packed(members, CHUNK, "vec_id"))
    kind = vectors.schema[id_col].dataType.simpleString()
    all_ = min(k, chunks.agg(F.sum(F.size("vec_ids"))).first()[0] or 0)
    active = scratch.keep(asked.select("q").distinct().withColumn("bound", F.lit(BITS * words)))
    found = spark.createDataFrame([], f"q array<bigint>, vec_id {kind}, d int")

    def meet(radius: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, held = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    raw, ids, asks, bounds = (batch.column(c)[i] for c in range(4))
                    if (told := raw.as_py()) != last:
                        last, codes = told, np.frombuffer(told, "<u2").reshape(-1, segments)
                        held = codes, [Buckets(codes[:, j]) for j in range(segments)]
                    blocks = np.frombuffer(asks.as_buffer(), "<u2").reshape(-1, segments)
                    q, c, d = nearest(blocks, bounds.values.to_numpy(), *held, radius, k)
                    longs = np.ascontiguousarray(blocks[q]).view("<i8").reshape(-1)
                    ends = np.arange(len(q) + 1, dtype=np.int32) * words
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(longs, pa.int64())), ids.values.take(pa.array(c)), pa.array(d, pa.int32())], ["q", "vec_id", "d"])

        return run

    for radius in range(WIDTH + 1 if all_ else 0):
        blocks = scratch.keep(packed(active.select(F.col("q").alias("code"), "bound"), BLOCK, "bound"))
        if not blocks.head(1):
            break
        both = chunks.repartition(tasks).crossJoin(blocks.select(F.col("codes").alias("asks"), "bounds"))
        met = both.mapInArrow(meet(radius), f"q array<bigint>, vec_id {kind}, d int")
        ranked = Window.partitionBy("q").orderBy("d", "vec_id")
        found = scratch.keep(found.unionByName(met).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank"))
        # A query's bound: the distance of its k-th row so far.
        reached = found.groupBy("q").agg(F.count("*").alias("n"), F.max("d").alias("kth")).where(F.col("n") >= all_)
        left = active.drop("bound").join(reached, "q", "left").where(F.col("kth").isNull() | (F.col("kth") > segments * radius + segments - 1))
        active = scratch.keep(left.select("q", F.coalesce("kth", F.lit(BITS * words)).alias("bound")))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id")))
    return asked.join(best, "q").select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.col("d").cast("bigint").alias("distance"))


ORACLE_SQL = """
with q as (select vec_id as query_id, embedding as a from embeddings where vec_id % 50 = 0),
d as (select query_id, vec_id, list_sum(list_transform(range(1, 65), lambda i: case when (a[i] > 0) <> (embedding[i] > 0) then 1 else 0 end))::bigint as distance from q, embeddings)
select query_id, row_number() over (partition by query_id order by distance, vec_id)::bigint as rank, vec_id, distance from d
qualify rank <= 10
"""
