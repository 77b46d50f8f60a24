"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, and decoding.

A text is split into words by the tokenizer's pattern. The merges of a word are a fold by Spark
higher-order functions (`merge_fold`) over its bytes; the ranks are a scalar subquery of the plan.

Words follow Zipf's law, so the work is divided by frequency:

1. count the words of all texts; the ``head`` most frequent ones, at most 64 characters each, are
   folded once, and their ids are broadcast (at most ``head`` rows, whatever the corpus);
2. replace each word of a text by its place in that head; a word outside of it is put, once for each
   text, in an array beside the text and folded there, inside the same row.

Nothing of the text is shuffled, and no broadcast grows with the corpus.

A fold costs the square of a word's length. Runs of over ``FOLD_BYTES`` bytes without a break, which hardly a text has, take
the same merges from a heap instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pagewright.llm.common import Lazy, Scratch, prepare, share, ship

ship(__name__)

#: Entries of the broadcast head, characters of a word in it.
HEAD, HEAD_CHARS = 1 << 19, 64
#: Bytes of a word up to which merges are folded by higher-order functions; longer ones take them from a heap.
FOLD_BYTES = 1024
#: Bits of an id or rank, and of a place in a word, in the numbers that the fold carries. No rank reaches ``NONE``.
ID_BITS, PLACE_BITS = 18, 27
NONE = (1 << ID_BITS) - 1
#: Sizes of the two halves of the rank map, primes, and what stands at its free places: more than any key.
HALVES, FREE = (200_003, 299_993), 1 << 62

# The letters, numbers and white space below U+0250.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str):
    """A function from a text to its words.

    For the 50k pattern, texts below U+0250 are split by an equal pattern with explicit classes, which the
    standard library runs several times faster.
    """
    general = regex.compile(pattern)
    if pattern != r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
        return general.findall
    plain = re.compile(f" ?[{LETTERS}]++| ?[{NUMBERS}]++|'(?:[stmd]|re|ve|ll)| ?[^{SPACES}{LETTERS}{NUMBERS}]++|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]++").findall
    other = re.compile("[^\x00-ɏ]").search
    return lambda text: plain(text) if text.isascii() or not other(text) else general.findall(text)


def rank_table(ranks: dict[bytes, int]) -> np.ndarray:
    """The rank map of pairs of pieces as a cuckoo hash table, so that a search looks at two places.

    A pair of pieces ``a, b`` has the key ``(a << ID_BITS | b) << ID_BITS``; its entry is the key plus the rank of the bytes of
    both. It stands at ``key % HALVES[0]`` of the first half or ``key % HALVES[1]`` of the second; free places have ``FREE``.
    """
    one, two = HALVES
    table = [FREE] * (one + two)
    if max(ranks.values(), default=0) >= NONE:
        raise ValueError(f"ranks must be under {NONE}")
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            if (a := ranks.get(piece[:cut])) is None or (b := ranks.get(piece[cut:])) is None:
                continue
            entry, at = (a << ID_BITS | b) << ID_BITS | rank, -1
            for _ in range(500):
                key = entry & ~NONE
                at = key % one if at != key % one else one + key % two
                table[at], entry = entry, table[at]
                if entry == FREE:
                    break
            else:
                raise ValueError("too many pairs for the rank map")
    return np.array(table, np.int64)


def with_ranks(df: DataFrame, told: Broadcast) -> DataFrame:
    """``df`` with ``rank_table``, broadcast as an array, as the column ``ranks``.

    It is a scalar subquery, so that no plan, nor its text, holds half a million numbers. Used once by the next projection,
    it is folded into that, and no row gets a copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = told.value
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table))], ["ranks"])

    return df.withColumn("ranks", df.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "ranks array<bigint>").scalar())


def rank_of(ranks: Column, key: Column) -> Column:
    """Rank of two pieces by their key, or ``NONE``, also if the key is null.

    An entry of another key, or none, differs from this key in a higher bit than a rank has.
    """
    first = F.get(ranks, (key % HALVES[0]).cast("int")).bitwiseXOR(key)
    second = F.get(ranks, (key % HALVES[1] + HALVES[0]).cast("int")).bitwiseXOR(key)
    return F.least(first, second, F.lit(NONE).cast("bigint"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a transform over an array of one element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merge_fold(word: Column, ranks: Column) -> Column:
    """``array<bigint>``: the pieces of a word, given as those of its bytes (see ``byte_lists``); ``id_of`` tells their ids.

    The fold carries one number for each piece: the rank of its pair with the next piece, its place and its id, from
    high bits to low. The lowest number is so the leftmost pair of the lowest rank, and that rank is the id of the
    merged piece; a step merges it and ranks anew the two pairs that the merged piece is in. ``ranks`` should be a
    lambda variable (see ``let``), so that the subquery stands in the plan once.
    """
    size = F.size(word)
    low = ID_BITS + PLACE_BITS
    rest_of = lambda v: v.bitwiseAND(F.lit((1 << low) - 1))

    def merged(v: Column, least: Column, j: Column) -> Column:
        before, after, new = F.get(v, j - 2), F.get(v, j + 1), F.shiftright(least, low)
        keys = F.array(F.shiftleft(id_of(before), 2 * ID_BITS).bitwiseOR(F.shiftleft(new, ID_BITS)), F.shiftleft(new, 2 * ID_BITS).bitwiseOR(F.shiftleft(id_of(after), ID_BITS)))
        own = least.bitwiseAND(F.lit(((1 << PLACE_BITS) - 1) << ID_BITS)).bitwiseOR(new)
        pair = F.transform(keys, lambda key, i: F.shiftleft(rank_of(ranks, key), low).bitwiseOR(F.when(i == 0, rest_of(before)).otherwise(own)))
        rest = F.slice(v, j + 2, F.lit(1 << PLACE_BITS))
        return F.when(j > 1, F.concat(F.slice(v, F.lit(1), j - 2), pair, rest)).otherwise(F.concat(F.slice(pair, 2, 1), rest))

    def step(v: Column, _: Column) -> Column:
        return let(F.array_min(v), lambda least: F.when(least >= (NONE << low), v).otherwise(let(F.array_position(v, least).cast("int"), lambda j: merged(v, least, j))))

    return F.when(size < 2, word).otherwise(F.aggregate(F.sequence(F.lit(2), size), word, step))


def id_of(piece: Column) -> Column:
    """The id of a piece as the fold carries it."""
    return piece.bitwiseAND(F.lit(NONE))


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, by a heap of pairs over a linked list."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0 and (r := ranks.get(piece[prv[i] : stop])) is not None:
            heapq.heappush(heap, (r, prv[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def word_counts(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, for words of at most ``HEAD_CHARS`` characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(pattern), Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in seen if len(w) <= HEAD_CHARS]
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array([seen[w] for w in words], pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(split(text))
            if len(seen) > 400_000:
                yield out()
                seen.clear()
        yield out()

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def byte_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all bytes, and the ranks of all pairs of two bytes, or ``NONE``."""
    pairs = np.full(1 << 16, NONE, np.int64)
    for piece, rank in ranks.items():
        if len(piece) == 2:
            pairs[piece[0] << 8 | piece[1]] = rank
    return np.array([ranks[bytes([i])] for i in range(256)], np.int64), pairs


def byte_lists(words: list[bytes], known: tuple[np.ndarray, np.ndarray]) -> pa.ListArray:
    """The bytes of each word as the pieces that ``merge_fold`` begins with: the rank of each pair, its place, the byte's id."""
    single, pairs = known
    ends = np.cumsum([0, *map(len, words)])
    flat = np.frombuffer(b"".join(words), np.uint8)
    rank = np.full(len(flat), NONE, np.int64)
    rank[:-1] = pairs[flat[:-1].astype(np.int64) << 8 | flat[1:]]
    lengths = np.diff(ends)
    rank[ends[1:][lengths > 0] - 1] = NONE
    place = np.arange(len(flat)) - np.repeat(ends[:-1], lengths)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rank << (ID_BITS + PLACE_BITS) | place << ID_BITS | single[flat]))


def build_head(docs: DataFrame, ranks: dict[bytes, int], table: Broadcast, pattern: str, head: int = HEAD, text_col: str = "text") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Frequent words (at most ``head``), where the ids of each begin (one place more than words), and all their ids.

    Words are in the head from a least count on. A histogram of counts, with a few hundred classes at most, gives the
    least count for which they are no more than ``head``, so that no task orders them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    counts = scratch.keep(word_counts(docs, pattern, text_col))
    level = F.floor(F.log2("n") * 16)
    told = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, held = None, 0
    for at, words in told:
        if held + words > head:
            break
        least, held = at, held + words
    top = counts.where(level >= least) if least is not None else counts.limit(0)
    known = share(spark, ranks)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = byte_ranks(known.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), byte_lists([w.encode() for w in batch.column(0).to_pylist()], single)], ["word", "bytes"])

    spelt = top.select("word").repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(spell, "word string, bytes array<bigint>")
    rows = with_ranks(spelt, table).select("word", let(F.col("ranks"), lambda r: F.transform(merge_fold(F.col("bytes"), r), id_of)).cast("array<int>").alias("ids")).toArrow()
    scratch.drop()
    words, ids = rows["word"].combine_chunks(), rows["ids"].combine_chunks()
    del rows
    if not len(words):
        return pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.int32)
    flat, starts = ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64)
    return words, starts - starts[0], flat


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    """The piece of each rank."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def joined(ids: list[int], pieces: list[bytes]) -> bytes:
    """What the ids decode to, for ``decode`` and for the digests of ``encode``."""
    if ids and min(ids) < 0:
        raise IndexError("an id under zero")
    return b"".join([pieces[i] for i in ids])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Token ids of each whole text, as one row for each row of ``docs``.

    Returns ``doc_id, ids array<int>``, or with ``digests`` ``doc_id, n_tokens, ids_sha256, decoded_sha256``, where
    the last is of the decoded ids. A null text counts as empty: no ids. Repeated rows give repeated rows, a null
    id stays null, other columns are ignored, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = share(spark, rank_table(ranks))
    words, starts, flat = build_head(docs, ranks, table, pattern, head)
    n_head = len(words)
    # What a worker makes of these once, for all of its tasks, is put beside them.
    told = share(spark, {"words": words})
    told_ids = share(spark, {"starts": starts, "flat": flat})
    told_ranks = share(spark, ranks)
    del words, starts, flat
    whole = docs.schema["doc_id"].dataType

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word's place in the head, or behind it in the row's own array of other words, as ids of their bytes."""
        split, held, single = splitter(pattern), told.value, byte_ranks(told_ranks.value)
        if "known" not in held:
            held["known"] = dict(zip(held.pop("words").to_pylist(), range(n_head), strict=True))
        known = held["known"].get
        for batch in batches:
            codes, ends, rest, upto = [], [0], [], [0]
            for text in batch.column(1).to_pylist():
                found = split(text or "")
                got = np.fromiter(map(known, found, repeat(-1)), np.int32, len(found))
                own: dict[str, int] = {}
                for at in np.nonzero(got < 0)[0].tolist():
                    got[at] = n_head + own.setdefault(found[at], len(own))
                rest += [w.encode() for w in own]
                codes.append(got)
                ends.append(ends[-1] + len(got))
                upto.append(len(rest))
            flat = pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.array(upto, np.int32)), byte_lists(rest, single))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), flat), lists], ["doc_id", "codes", "rest"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, by_bytes = told_ids.value, told_ranks.value
        starts, flat = held["starts"], held["flat"]
        if "pieces" not in held:
            pieces = held["pieces"] = pieces_of(by_bytes)
            names = held["names"] = [str(i) for i in range(len(pieces))]
            held["shown"] = Lazy(lambda c: " ".join(map(names.__getitem__, flat[starts[c] : starts[c + 1]].tolist())))
            held["back"] = Lazy(lambda c: joined(flat[starts[c] : starts[c + 1]].tolist(), pieces))
        pieces, names, shown, back = held["pieces"], held["names"], held["shown"], held["back"]
        first, many = starts[:-1], np.diff(starts)

        def digest(codes: np.ndarray, own: list[tuple[int, str, bytes]]) -> tuple[int, str, str]:
            """How many ids, and the hashes of the ids and of what they decode to, one word's pieces after the other's."""
            listed, n = codes.tolist(), many[codes[codes < n_head]].sum()
            if own:  # for this text, its own words stand in the tables behind the head
                size, text, raw = zip(*own, strict=True)
                shown.update(zip(range(n_head, n_head + len(own)), text, strict=True))
                back.update(zip(range(n_head, n_head + len(own)), raw, strict=True))
                n += np.array(size)[codes[codes >= n_head] - n_head].sum()
            text, raw = " ".join(map(shown.__getitem__, listed)), b"".join(map(back.__getitem__, listed))
            return int(n), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()

        def ids_of(codes: np.ndarray, own: list[list[int]]) -> np.ndarray:
            if own:
                return np.concatenate([flat[starts[c] : starts[c + 1]] if c < n_head else own[c - n_head] for c in codes.tolist()]).astype(np.int32)
            m = many[codes]
            return flat[np.repeat(first[codes] - (np.cumsum(m) - m), m) + np.arange(m.sum())]

        for batch in batches:
            codes_at, codes_all = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            docs_at, words = batch.column(3).offsets.to_numpy().tolist(), batch.column(3).values
            ids_at, ids = words.offsets.to_numpy().tolist(), (words.values.to_numpy() & NONE).tolist()
            long = {w: merge_long(joined([v & NONE for v in batch.column(2).values[w].as_py()], pieces), by_bytes) for w in np.nonzero(words.is_null().to_numpy(zero_copy_only=False))[0].tolist()} if words.null_count else {}
            if digests:
                shown_ids, back_ids = list(map(names.__getitem__, ids)), list(map(pieces.__getitem__, ids))

            def own_of(k: int) -> list:
                """The words outside of the head of one text: their ids, or how many, shown and decoded."""
                out = []
                for w in range(docs_at[k], docs_at[k + 1]):
                    a, b = ids_at[w], ids_at[w + 1]
                    if not digests:
                        out.append(long[w] if w in long else ids[a:b])
                    elif w in long:
                        out.append((len(long[w]), " ".join(map(names.__getitem__, long[w])), joined(long[w], pieces)))
                    else:
                        out.append((b - a, " ".join(shown_ids[a:b]), b"".join(back_ids[a:b])))
                return out

            each = ((codes_all[codes_at[k] : codes_at[k + 1]], own_of(k)) for k in range(batch.num_rows))
            if digests:
                n, sha, decoded = zip(*(digest(*x) for x in each), strict=True) if batch.num_rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                got = [ids_of(*x) for x in each]
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))], ["doc_id", "ids"])

    kind = whole.simpleString()
    coded = docs.mapInArrow(places, f"doc_id {kind}, codes array<int>, rest array<array<bigint>>")
    folded = F.when(F.size("rest") == 0, F.array().cast("array<array<bigint>>")).otherwise(let(F.col("ranks"), lambda r: F.transform("rest", lambda w: F.when(F.size(w) <= FOLD_BYTES, merge_fold(w, r)))))
    return with_ranks(coded, table).select("doc_id", "codes", "rest", folded.alias("folded")).mapInArrow(finish, f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"))


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded binary``: the pieces of the ids, concatenated; null ids give null, unknown ids an error."""
    prepare(df.sparkSession)
    told = share(df.sparkSession, ranks)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != "decoded"])
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(told.value)
        for batch in batches:
            back = [None if ids is None else joined(ids, pieces) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("decoded", BinaryType())]))
