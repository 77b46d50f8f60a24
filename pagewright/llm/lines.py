"""Line dedup: exact repeats, and lines within ``edits`` edits of an earlier line, whatever their length.

With a bound of one edit, partners are found by a deletion-neighbourhood join.

A line that repeats is one node of the join, at its earliest place (document id, then line number). Two lines within one
edit either lose one character at the same place and are then equal (a substitution), or one of them loses a character
and then is the other (an insertion). So each line emits the hash of every variant with one character less:

* keyed by variant and place, where the lines of a key are all within one edit of each other, and
* keyed by variant alone, to meet the whole lines that are equal to it.

Only the earliest line of a key matters, so keys are aggregated and no pairs are listed. The earliest partner found is
verified by edit distance.

Cluster rule: lines that are linked by near pairs are a cluster, and of a cluster those lines stay that have no earlier
near line; its earliest line so always stays. A line goes if it has an earlier near line, whether or not that one goes.

A line of n characters has n variants, so they are emitted only for lines that can have a partner: two lines within one
edit share their first or their last half, and all but one of eight parts; grouped counts tell which halves, and then
which such remainders, more than one line has.

With a larger bound k, variants would grow with the length to the power k. Two lines within k edits share one of k + 1
parts, moved by as many characters as the edits before it add or remove. Lines that share one are candidates, verified by
edit distance: first each line against the earliest line of its groups, then only the lines left over against the earlier
ones, in groups of at most ``GROUP`` lines. Lines whose signatures, 128 parities of pairs of neighbouring characters, differ
in more than 4 k bits are no candidates. So one of the two words of 64 bits differs in at most 2 k, and one of its 2 k + 1
blocks in none; larger groups are split by these blocks. Lines of groups that are larger even so are told apart by all but
k of ``parts`` parts; where groups of such remainders are large, the touched parts, where alone the lines differ, are cut
into parts in turn, so that groups shrink with each of ``DEPTH`` levels; what is left there differs in a few characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch, hot_join, prepare, ship
from pagewright.llm.simhash import block_keys

ship(__name__)

#: Edits within which a line counts as a repeat of an earlier one.
EDITS = 1
#: Parts of a line, of which two lines within a larger bound share all but as many as there are edits.
PARTS = 8
#: Lines of a group that are compared with each other, levels of parts, and parts from the second level on. Comparing the
#: signatures of so many lines takes less than the hundreds of keys that each line has on a further level.
GROUP, DEPTH, FEW_PARTS = 2048, 4, 4
#: The two words of a line's signature (see ``pair_parities``).
SIGS = ["sig1", "sig2"]
#: Multiplier of the variant hash, odd so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, line) of the lines that are not blank."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).where(F.col("line").rlike(r"\S"))


def halves(line: Column) -> Column:
    """Keys of which two lines within one edit share one: halves by the line's own length and by that less one."""
    n = F.length(line)
    keys = []
    for size in (n, n - 1):
        cut = F.floor(size / 2).cast("int")
        keys += [F.xxhash64(F.lit("first"), size, F.substring(line, F.lit(1), cut)), F.xxhash64(F.lit("last"), size, F.substring(line, n - (size - cut) + 1, size - cut))]
    return F.array(*keys)


def all_but_a_part(line: Column, parts: int = 8) -> Column:
    """The same by everything but one of eight parts, which far fewer lines share; for lines that share a half."""
    n = F.length(line)
    keys = []
    for longer, size in enumerate((n, n - 1)):
        for k in range(parts):
            low, high = F.floor(size * k / parts).cast("int"), F.floor(size * (k + 1) / parts).cast("int")
            keys.append(F.xxhash64(F.lit(k), size, F.substring(line, F.lit(1), low), F.substring(line, high + 1 + longer, size - high)))
    return F.array(*keys)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The keys of (h1, key) that more than one line has."""
    return keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")


@cache
def shifts(edits: int) -> list[tuple[int, ...]]:
    """By how much what follows each of ``edits`` touched parts has moved in the longer line of two."""
    return [s for s in product(range(-edits, edits + 1), repeat=edits) if s[-1] >= 0 and sum(abs(b - a) for a, b in zip((0, *s), s, strict=False)) <= edits]


def a_part(line: Column, edits: int) -> Column:
    """Keys of which two lines within ``edits`` edits share one: one of ``edits + 1`` parts, wherever it may have moved."""
    n, keys = F.length(line), []
    for longer in range(edits + 1):
        size = n - longer
        for t in range(edits + 1):
            low, high = F.floor(size * t / (edits + 1)).cast("int"), F.floor(size * (t + 1) / (edits + 1)).cast("int")
            moved = {0} if t == 0 else {s[t - 1] for s in shifts(edits) if s[-1] == longer}
            keys += [F.xxhash64(F.lit(t), size, F.substring(line, low + F.lit(s + 1), high - low)) for s in sorted(moved)]
    return F.array(*keys)


def prefix_sums(line: str) -> np.ndarray:
    """Polynomial hashes of every prefix of a line."""
    with np.errstate(over="ignore"):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        codes = (codes ^ (codes << np.uint64(21))) * np.uint64(0xBF58476D1CE4E5B9)
        codes ^= codes >> np.uint64(31)
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(codes), BASE, np.uint64))), dtype=np.uint64)
        return np.concatenate(([np.uint64(0)], np.cumsum(codes * powers[:-1], dtype=np.uint64)))


def parts_keys(line: str, edits: int, parts: int, scope: int = 0) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Keys of which two lines within ``edits`` edits share one: the line without ``edits`` of its parts.

    With them, for each touched part where it starts and ends. ``scope`` is part of every key.
    """
    sums = prefix_sums(line)
    n, out, spans = len(sums) - 1, [], []
    touched = np.array(list(combinations(range(parts), edits)))
    odd = np.uint64(0x9FB21C651E98DF25)
    with np.errstate(over="ignore"):
        names = (touched @ (parts ** np.arange(edits))).astype(np.uint64) + np.uint64(scope % (1 << 64))
        for s in shifts(edits):
            size = n - s[-1]
            if size < 0:
                continue
            edges = np.arange(parts + 1) * size // parts
            moved = np.array((0, *s))
            starts = np.hstack([np.zeros((len(touched), 1), int), edges[touched + 1]]) + moved
            ends = np.hstack([edges[touched], np.full((len(touched), 1), size)]) + moved
            fits = (((starts >= 0) & (ends <= n)) | (starts == ends)).all(axis=1)
            key = (names * odd + np.uint64(size)) * odd
            for i, by in enumerate(moved.tolist()):
                piece = sums[np.clip(ends[:, i], 0, n)] - sums[np.clip(starts[:, i], 0, n)]
                key = key + piece * np.uint64(pow(BASE, -by, 1 << 64))
            out.append(key[fits])
            spans.append((ends[fits, :-1], starts[fits, 1:]))
    return np.concatenate(out).view(np.int64), spans


def touched_parts(line: str, edits: int, parts: int, scope: int) -> dict[int, list[str]]:
    """By key, what stands in the touched parts, joined by a mark that no text has."""
    keys, spans = parts_keys(line, edits, parts, scope)
    lows, highs = (np.concatenate([x[k] for x in spans]).tolist() for k in range(2))
    out: dict[int, list[str]] = {}
    for key, low, high in zip(keys.tolist(), lows, highs, strict=True):
        rest = "\udc00".join(line[max(a, 0) : max(b, 0)] for a, b in zip(low, high, strict=True))
        if rest not in out.setdefault(key, []):
            out[key].append(rest)
    return out


def variant_hashes(line: str) -> tuple[int, np.ndarray]:
    """The hash of a line, and those of the line without each of its characters, as signed 64-bit numbers."""
    sums = prefix_sums(line)
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        without = sums[:-1] + (sums[-1] - sums[1:]) * inverse
    return int(sums[-1:].view(np.int64)[0]), without.view(np.int64)


def variants(active: DataFrame) -> DataFrame:
    """(role, key, doc_id, pos): role 0 by variant and place, 1 by variant, 2 the whole line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, at, lines = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            role, key, row = [], [], []

            def out() -> pa.RecordBatch:
                rows = np.concatenate(row)
                got = pa.RecordBatch.from_arrays([pa.array(np.concatenate(role)), pa.array(np.concatenate(key)), docs.take(pa.array(rows)), pa.array(at[rows])], ["role", "key", "doc_id", "pos"])
                role.clear(), key.clear(), row.clear()
                return got

            held = 0
            for k, line in enumerate(lines):
                whole, cut = variant_hashes(line)
                with np.errstate(over="ignore"):
                    placed = cut ^ (np.arange(1, len(cut) + 1, dtype=np.int64) * np.int64(0x2545F4914F6CDD1D))
                alone = np.unique(cut)
                role.append(np.repeat(np.array([0, 1, 2], np.int8), (len(placed), len(alone), 1)))
                key.append(np.concatenate((placed, alone, [whole])))
                row.append(np.full(len(placed) + len(alone) + 1, k, np.int64))
                held += len(row[-1])
                if held > 100_000:
                    yield out()
                    held = 0
            if row:
                yield out()

    kind = active.schema["doc_id"].dataType.simpleString()
    return active.select("doc_id", "pos", "line").mapInArrow(run, f"role byte, key long, doc_id {kind}, pos int")


def remainders(rows: DataFrame, edits: int, parts: int) -> DataFrame:
    """(h1, h2, key): the keys of every row (h1, h2, scope, rest), where ``rest`` is UTF-8 with lone surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys = [np.unique(parts_keys(rest.decode("utf-8", "surrogatepass"), edits, parts, scope)[0]) for scope, rest in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            if keys:
                row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(h1[row]), pa.array(h2[row]), pa.array(np.concatenate(keys))], ["h1", "h2", "key"])

    return rows.select("h1", "h2", "scope", "rest").mapInArrow(run, "h1 long, h2 int, key long")


def narrowed(rows: DataFrame, edits: int, parts: int) -> DataFrame:
    """(h1, h2, scope, rest) of the next level for rows (h1, h2, scope, rest, wanted array of keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, h2, scope, rest, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = touched_parts(rest.decode("utf-8", "surrogatepass"), edits, parts, scope)
                out = [(key, r.encode("utf-8", "surrogatepass")) for key in wanted for r in made.get(key, ())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([h1] * len(out), pa.int64()), pa.array([h2] * len(out), pa.int32()), pa.array([k for k, _ in out], pa.int64()), pa.array([r for _, r in out], pa.binary())], ["h1", "h2", "scope", "rest"])

    return rows.select("h1", "h2", "scope", "rest", "wanted").mapInArrow(run, "h1 long, h2 int, scope long, rest binary")


def pair_parities(line: str) -> np.ndarray:
    """128 bits as two signed numbers, each the parity of the pairs of neighbours that hash to it; an edit changes four of them at most."""
    codes = np.append(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1), np.uint64(0))
    with np.errstate(over="ignore"):
        pairs = (codes[:-1] * np.uint64(BASE) + codes[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        pairs = (pairs ^ (pairs >> np.uint64(31))) * np.uint64(BASE)
    odd = np.bincount((pairs >> np.uint64(57)).astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signed(active: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, pos, sig1, sig2): ``pair_parities`` of every line of ``active``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array([pair_parities(line) for line in batch.column(4).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], ["h1", "h2", "doc_id", "pos", "sig1", "sig2"])

    return active.select("h1", "h2", "doc_id", "pos", "line").mapInArrow(run, f"h1 long, h2 int, doc_id {active.schema['doc_id'].dataType.simpleString()}, pos int, sig1 long, sig2 long")


def near_by_parts(active: DataFrame, scratch: Scratch, edits: int, parts: int, per: int) -> DataFrame:
    """(h1, h2) of the lines of ``active`` (doc_id, pos, line, h1, h2) that are within ``edits`` edits of an earlier one."""
    place = scratch.keep(signed(active).select("h1", "h2", F.struct("doc_id", "pos").alias("at"), F.struct(*SIGS).alias("sig")))
    apart = [F.bit_count(F.col(f"sig.{c}").bitwiseXOR(F.col(f"sig_to.{c}"))) for c in SIGS]
    may = apart[0] + apart[1] <= 4 * edits
    ours = active.select("h1", "h2", F.col("line").alias("mine"))
    theirs = active.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("theirs"))

    def verified(pairs: DataFrame) -> DataFrame:
        joined = pairs.distinct().join(ours, ["h1", "h2"]).join(theirs, ["g1", "g2"])
        return joined.where(within(F.col("mine"), F.col("theirs"), edits, per)).select("h1", "h2").distinct()

    near = scratch.keep(active.select("h1", "h2").limit(0))

    def settle(keys: DataFrame, most: Column) -> tuple[DataFrame, DataFrame]:
        """Compare the lines that share one of the keys (h1, h2, key), in groups of at most ``most`` lines.

        Returns the shared keys with the lines' places, and the keys of the larger groups that hold lines not yet near.
        """
        nonlocal near
        every = scratch.keep(keys)
        keyed = scratch.keep(every.join(shared_keys(every), "key", "left_semi").join(place, ["h1", "h2"]))
        scratch.discard(every)
        groups = keyed.groupBy("key").agg(F.min(F.struct("at", F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("sig").alias("sig_to"))).alias("least"), F.count("*").alias("n"))
        groups = scratch.keep(groups.select("key", F.col("least.at").alias("to"), "least.g1", "least.g2", "least.sig_to", "n"))
        with_first = scratch.keep(hot_join(keyed, groups, ["key"], "n").where("to < at"))
        near = scratch.keep(near.unionByName(verified(with_first.where(may).select("h1", "h2", "g1", "g2"))).distinct())
        # What is left: lines that are not the earliest of a group and not near it.
        left = scratch.keep(with_first.join(near, ["h1", "h2"], "left_anti").select("key", "h1", "h2", "at", "sig", "n"))
        scratch.discard(with_first, groups)
        other = keyed.join(left.where(F.col("n") <= most).select("key").distinct(), "key", "left_semi").select("key", F.col("at").alias("to"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("sig").alias("sig_to"))
        pairs = left.where(F.col("n") <= most).join(other, "key").where("to < at").where(may).select("h1", "h2", "g1", "g2")
        near = scratch.keep(near.unionByName(verified(pairs)).distinct())
        large = scratch.keep(left.where(F.col("n") > most).join(near, ["h1", "h2"], "left_anti").select("key").distinct())
        scratch.discard(left)
        return keyed, large

    most = F.lit(GROUP)
    keyed, large = settle(active.select("h1", "h2", F.explode(F.array_distinct(a_part(F.col("line"), edits))).alias("key")), most)
    if not large.head(1):
        return near
    blocks = F.concat(*[F.transform(block_keys(F.col(f"sig.{c}"), 2 * edits, 1), lambda b, k=k: F.xxhash64("key", F.lit(k), b)) for k, c in enumerate(SIGS)])
    first, (keyed, large) = keyed, settle(keyed.join(large, "key", "left_semi").select("h1", "h2", F.explode(blocks).alias("key")), most)
    scratch.discard(first)
    if not large.head(1):
        return near
    rows = active.join(keyed.join(large, "key", "left_semi").select("h1", "h2").distinct(), ["h1", "h2"])
    rows = scratch.keep(rows.select("h1", "h2", F.lit(0).cast("bigint").alias("scope"), F.col("line").cast("binary").alias("rest")))
    scratch.discard(keyed)
    for depth in range(DEPTH):
        cut = parts if depth == 0 else max(FEW_PARTS, edits + 2)
        keyed, large = settle(remainders(rows, edits, cut).distinct(), most if depth < DEPTH - 1 else F.col("n"))
        if not large.head(1):
            break
        wanted = keyed.join(large, "key", "left_semi").groupBy("h1", "h2").agg(F.collect_set("key").alias("wanted"))
        rows = scratch.keep(narrowed(rows.join(wanted, ["h1", "h2"]), edits, cut).distinct())
        scratch.discard(keyed)
    return near


def within(a: Column, b: Column, edits: int, per: int) -> Column:
    """True if two lines are within ``edits`` edits, and within one for every ``per`` characters of the longer."""
    apart = F.levenshtein(a, b, edits)
    return (apart >= 0) & (apart * per <= F.greatest(F.length(a), F.length(b)))


def near_lines(firsts: DataFrame, docs: DataFrame, scratch: Scratch, edits: int, per: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2) of the lines that are within ``edits`` edits of an earlier line.

    ``firsts``: (h1, h2, first struct<doc_id,pos>, keys) of each distinct line; keys for a bound of one edit only.
    """
    if edits == 1:
        keyed = firsts.select("h1", "h2", F.explode("keys").alias("key"))
        active = keyed.join(shared_keys(keyed), "key", "left_semi").select("h1", "h2").distinct().join(firsts.select("h1", "h2", "first"), ["h1", "h2"])
    else:  # many keys a line: they are made anew from the texts and shuffled once, never written
        long = places(docs, id_col, text_col).where(F.length("line") >= per)
        keyed = long.select(F.xxhash64("line").alias("h1"), F.explode(a_part(F.col("line"), edits)).alias("key"))
        shared = keyed.groupBy("key").agg(F.collect_set("h1").alias("of")).where(F.size("of") > 1)
        active = shared.select(F.explode("of").alias("h1")).distinct().join(firsts.select("h1", "h2", "first"), "h1")
    mine = active.select("h1", "h2", F.col("first.doc_id").alias("id"), F.col("first.pos").alias("at"))
    lines = places(docs, id_col, text_col)
    lines = lines.join(mine, (F.xxhash64("line") == mine["h1"]) & F.col("doc_id").eqNullSafe(mine["id"]) & (F.col("pos") == mine["at"]))
    active = scratch.keep(lines.select("doc_id", "pos", "line", "h1", "h2").dropDuplicates(["h1", "h2"]))
    if edits > 1:
        return near_by_parts(active, scratch, edits, max(PARTS, edits + 1), per)
    keyed = active.select("h1", "h2", F.explode(all_but_a_part(F.col("line"))).alias("key"))
    close = keyed.join(shared_keys(keyed), "key", "left_semi").select("h1", "h2").distinct()
    first, active = active, scratch.keep(active.join(close, ["h1", "h2"]))
    scratch.discard(first)
    found = scratch.keep(variants(active))
    order = F.struct("doc_id", "pos")
    by_place, by_variant, whole = (found.where(F.col("role") == k).select("key", order.alias("at")) for k in range(3))
    earliest = lambda df: df.groupBy("key").agg(F.min("at").alias("to"), F.count("*").alias("n"))
    pairs = by_place.join(earliest(by_place).where("n > 1"), "key").select("at", "to")
    pairs = pairs.unionByName(by_variant.join(whole.withColumnRenamed("at", "to"), "key").select("at", "to"))
    pairs = pairs.unionByName(whole.join(earliest(by_variant), "key").select("at", "to")).where("to < at")
    best = pairs.groupBy("at").agg(F.min("to").alias("to"))
    place = F.struct("doc_id", "pos")
    ours = active.select(place.alias("at"), F.col("line").alias("mine"), "h1", "h2")
    theirs = active.select(place.alias("to"), F.col("line").alias("theirs"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["pos"] == b["pos"])
    joined = best.join(ours, same(best["at"], ours["at"])).select("to", "mine", "h1", "h2")
    joined = joined.join(theirs, same(joined["to"], theirs["to"]))
    return joined.where(within(F.col("mine"), F.col("theirs"), 1, per)).select("h1", "h2")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, per: int = 1) -> DataFrame:
    """(doc_id, exact, near): the line numbers of each document that go, as exact repeats and within ``edits`` edits."""
    if edits < 1 or per < 1:
        raise ValueError("edits and per: at least one")
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lines")
    line = F.col("line")
    every = places(docs, id_col, text_col).select("doc_id", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), (halves(line) if edits == 1 else F.array().cast("array<bigint>")).alias("keys"))
    marks = scratch.keep(every.drop("keys"))
    firsts = scratch.keep(every.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"), F.any_value("keys").alias("keys")))
    near = near_lines(firsts, docs, scratch, edits, per, id_col, text_col)
    gone = scratch.keep(firsts.select("h1", "h2", "first", "n").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "first", "n", F.coalesce("near", F.lit(False)).alias("near")))
    scratch.drop_all_but(marks, gone)
    held = hot_join(marks, gone, ["h1", "h2"], "n")
    again = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos")))
    held = held.where(again | F.col("near")).select("doc_id", "pos", again.alias("again"))
    return held.groupBy("doc_id").agg(F.collect_set(F.when(F.col("again"), F.col("pos"))).alias("exact"), F.collect_set(F.when(~F.col("again"), F.col("pos"))).alias("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, per: int = 1) -> DataFrame:
    """``docs`` with ``line_stats struct<n_lines,n_exact,n_near>`` added and the text without the lines that repeat.

    Lines are what newlines divide; blank lines stay and are not counted. Of equal lines the earliest place stays (smallest
    document id, null first, then line number); lines within ``edits`` edits of an earlier one go too (for the cluster rule
    see the module), if these are no more than one for every ``per`` characters of the longer line. Rows that share an id
    count as one document: a line at the same place of several of them is one occurrence. Null texts stay null, with no
    lines; a document may be left with an empty text; other columns stay as they are, but for an earlier ``line_stats``,
    which is replaced; an empty table gives an empty one.
    """
    names = [c for c in docs.columns if c != "line_stats"]
    gone = find_repeats(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), edits=edits, per=per)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = whole.join(gone, F.col(f"row.`{id_col}`").eqNullSafe(F.col("doc_id")), "left")
    none = F.array().cast("array<int>")
    t = F.col(f"row.`{text_col}`")
    rows = F.transform(F.split(t, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    drop = F.concat(F.coalesce("exact", none), F.coalesce("near", none))
    # Rows that share an id may differ: places beyond a text, or of its blank lines, are none of its own.
    live = F.filter(rows, lambda r: r["x"].rlike(r"\S"))
    count = lambda c: F.size(F.filter(live, lambda r: F.array_contains(F.coalesce(c, none), r["i"])))
    stats = F.struct(F.coalesce(F.size(live), F.lit(0)).alias("n_lines"), F.coalesce(count(F.col("exact")), F.lit(0)).alias("n_exact"), F.coalesce(count(F.col("near")), F.lit(0)).alias("n_near"))
    kept = F.array_join(F.transform(F.filter(rows, lambda r: ~(F.array_contains(drop, r["i"]) & r["x"].rlike(r"\S"))), lambda r: r["x"]), "\n")
    text = F.when(F.size(drop) > 0, kept).otherwise(t)
    stats = F.when(t.isNull(), F.struct(F.lit(0).alias("n_lines"), F.lit(0).alias("n_exact"), F.lit(0).alias("n_near"))).otherwise(stats)
    # Named last: a column's name must not be taken for one of the above.
    out = [*[text if c == text_col else F.col(f"row.`{c}`") for c in names], stats]
    return joined.select(*[c.alias(f"out {k}") for k, c in enumerate(out)]).toDF(*names, "line_stats")


def digests(deduped: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_exact, n_near, kept_sha256``."""
    return deduped.select("doc_id", *[F.col(f"line_stats.{c}").cast("bigint").alias(c) for c in ("n_lines", "n_exact", "n_near")], F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: Edits are told by what two lines share at their ends: all but one character of the longer.
ORACLE_SQL = r"""
with split as (select doc_id, text, string_split(text, chr(10)) as parts from documents),
spots as (select doc_id, unnest(range(0, len(parts))) as pos, unnest(parts) as line from split),
lines as (select doc_id, pos, line from spots where regexp_matches(line, '\S')),
firsts as (select line, count(*) as n, min({'d': doc_id, 'p': pos}) as f, length(line) as len from lines group by line),
halves as (
  select line, f, len, size, 'first' as kind, line[1:size // 2] as half from firsts, (select unnest([0, 1]) as less), lateral (select len - less as size)
  union all
  select line, f, len, size, 'last', line[len - (size - size // 2) + 1:] from firsts, (select unnest([0, 1]) as less), lateral (select len - less as size)),
pairs as (
  select distinct a.line as a, b.line as b, a.len as la, b.len as lb from halves a join halves b
  on a.kind = b.kind and a.size = b.size and a.half = b.half and a.f > b.f and abs(a.len - b.len) <= 1),
ends as (
  select a, b, la, lb, len(list_filter(range(1, least(la, lb) + 1), lambda i: a[1:i] = b[1:i])) as pre,
    len(list_filter(range(1, least(la, lb) + 1), lambda i: a[la - i + 1:] = b[lb - i + 1:])) as post from pairs),
near as (select distinct a as line from ends where pre + post >= greatest(la, lb) - 1),
flags as (
  select l.doc_id, l.pos, l.line, {'d': l.doc_id, 'p': l.pos} <> f.f as again, nr.line is not null as near
  from lines l join firsts f on l.line = f.line left join near nr on l.line = nr.line),
counts as (
  select doc_id, count(*) as n_lines, count(*) filter (again) as n_exact, count(*) filter (near and not again) as n_near from flags group by doc_id),
kept as (
  select a.doc_id, string_agg(a.line, chr(10) order by a.pos) as text from spots a left join flags g on a.doc_id = g.doc_id and a.pos = g.pos
  where g.pos is null or not (g.again or g.near) group by a.doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_exact, 0)::bigint as n_exact, coalesce(n_near, 0)::bigint as n_near,
  sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join counts c on d.doc_id = c.doc_id left join kept k on d.doc_id = k.doc_id
"""
