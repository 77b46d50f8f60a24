"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton accepts every run of words of every item. The words of a document are streamed through it, which
keeps the longest run that ends at each word and is in some item; a run of ``window`` words or more, or one that
ends with the whole of a shorter item, is a hit. Only the automaton is broadcast. Its size is bounded: items are
dealt into shards of at most ``SHARD_WORDS`` words, long items as pieces that overlap by a window less one word. With more
than one shard the documents are streamed once for each, one shard at a time: its hits are written and its automaton let
go before the next is made, so that memory doesn't grow with the benchmark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch, forget, lower_ascii, prepare, share, ship

ship(__name__)

#: Words of a window; words of the items in one automaton; share of hit words that makes a document contaminated.
WINDOW, SHARD_WORDS, COVERAGE = 13, 2_000_000, 0.05

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower-cases A-Z and makes a space of every ASCII character that is in no word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Automaton:
    """Generalised suffix automaton over words; state 0 is the empty run.

    ``need``: the length of run from which a state is a hit. ``items``: at a state that has runs of ``window`` words,
    the items they are in. ``short``: (length, items) of the whole shorter items that are suffixes of a state's runs.
    """

    window: int = WINDOW
    nexts: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[set | None] = field(default_factory=lambda: [None])
    short: list[tuple | None] = field(default_factory=list)
    need: list[int] = field(default_factory=list)

    def _state(self, length: int, nexts: dict, link: int) -> int:
        self.nexts.append(nexts)
        self.link.append(link)
        self.length.append(length)
        self.items.append(None)
        return len(self.link) - 1

    def _clone(self, p: int, word: bytes, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.nexts[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.nexts[p].get(word) == q:
            self.nexts[p][word] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, word: bytes) -> int:
        q = self.nexts[last].get(word)
        if q is not None:  # an earlier item has this run
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.nexts[p]:
            self.nexts[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.nexts[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Automaton:
        self = cls(window)
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        ends: dict[int, set] = {}
        for item, words in items:
            at = 0
            for k, w in enumerate(words, 1):
                at = self.nexts[at][w]
                if k >= window:
                    holder = self._holder(at)
                    self.items[holder] = (self.items[holder] or set()) | ({item} - {None})
            if 0 < len(words) < window:
                ends[at] = ends.get(at, set()) | ({item} - {None})
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.short, self.need = [None] * len(order), [0] * len(order)
        for v in order:
            above = self.short[self.link[v]] if v else None
            own = ((self.length[v], frozenset(ends[v])),) if v in ends else ()
            self.short[v] = (above or ()) + own or None
            self.need[v] = min([window if self.length[v] >= window else 1 << 30, *(n for n, _ in self.short[v] or ())])
        return self

    def _holder(self, v: int) -> int:
        """The state among ``v`` and its suffix links that has the run of ``window`` words."""
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans of words, as merged [start, end), and the items hit."""
        nexts, link, length, need = self.nexts, self.link, self.length, self.need
        spans: list[tuple[int, int]] = []
        found: set = set()
        v = n = 0
        for i, w in enumerate(words):
            t = nexts[v].get(w)
            while t is None:
                v = link[v]
                if v < 0:
                    break
                n = length[v]
                t = nexts[v].get(w)
            if t is None:
                v = n = 0
                continue
            v, n = t, n + 1
            if n >= need[v]:
                size = 0
                if n >= self.window:
                    size = self.window
                    found |= self.items[self._holder(v)]
                for k, items in self.short[v] or ():
                    if k <= n:
                        size = max(size, k)
                        found |= items
                start = i + 1 - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found


def item_pieces(benchmark: DataFrame, window: int, most: int, item_col: str, text_col: str) -> DataFrame:
    """(item, words) of the items that have words, those of more than ``most`` words as overlapping pieces."""
    folded = F.regexp_replace(lower_ascii(F.col(text_col)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    words = F.filter(F.split(folded, " "), lambda w: w != "")
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)), F.lit(max(1, most - window + 1))), lambda i: F.slice("words", i, F.lit(most)))
    return benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("words")).where("size(words) > 0").select("item", F.explode(parts).alias("words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items array<string>, spans array<struct<s,e>>``, one row for each row of ``docs``.

    ``spans`` are the hit words, as merged [s, e) of word numbers. With ``with_text`` also ``clean_text``: the text without
    these spans (from the first letter of the first word to the last of the last). Null and empty texts have no words;
    items without words are never found; items that repeat are found alike; columns other than those named are
    ignored; empty tables give no hits or no rows. The words of an item without an id count as hit, but it is not in ``items``.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = item_pieces(benchmark, window, shard_words, item_col, item_text_col)
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    shards = max(1, -(-2 * total // shard_words))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if shards == 1:
        return _scan(docs, pieces, window, with_text, kind)[0]
    # Each shard's hits are united by row; rows are numbered once, in a written table.
    scratch = Scratch(spark, "decontam")
    numbered = scratch.keep(docs.withColumn("row", F.monotonically_increasing_id()))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("item", F.size("words"), F.element_at("words", 1)), F.lit(shards)))
    hits = None
    for k in range(shards):
        found, told = _scan(numbered.select(F.col("row").alias("doc_id"), "text"), pieces.where(F.col("shard") == k), window, False, "bigint")
        got = scratch.keep(found.where("n_hit > 0").select("doc_id", "items", "spans"))
        forget(told)
        hits = got if hits is None else hits.unionByName(got)
    merged = hits.groupBy(F.col("doc_id").alias("row")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    joined = numbered.join(merged, "row", "left")
    return joined.mapInArrow(_finisher(with_text), _schema(kind, with_text))


def _schema(kind: str, with_text: bool) -> str:
    return f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<s:int,e:int>>" + ", clean_text string" * with_text


SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _rows(ids, found: list[tuple], with_text: bool) -> pa.RecordBatch:
    columns = {"doc_id": ids, "n_words": pa.array([r[0] for r in found], pa.int64()), "n_hit": pa.array([sum(e - s for s, e in r[1]) for r in found], pa.int64()), "n_items": pa.array([len(r[2]) for r in found], pa.int64()), "items": pa.array([sorted(r[2]) for r in found], pa.list_(pa.string())), "spans": pa.array([[{"s": s, "e": e} for s, e in r[1]] for r in found], SPANS)}
    if with_text:
        columns["clean_text"] = pa.array([r[3] for r in found], pa.string())
    return pa.RecordBatch.from_pydict(columns)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", raw)]
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def _scan(docs: DataFrame, pieces: DataFrame, window: int, with_text: bool, kind: str) -> tuple[DataFrame, Broadcast]:
    """The hits of one shard, and the broadcast that they read."""
    items = [(r["item"], [w.encode() for w in r["words"]]) for r in pieces.toLocalIterator()]  # bounded by the shard
    told = share(docs.sparkSession, Automaton.of(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = told.value
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                words = words_of(text) if text else []
                spans, items = automaton.scan(words)
                found.append((len(words), spans, items, without_spans(text, spans) if with_text and spans else text))
            yield _rows(batch.column(0), found, with_text)

    return docs.mapInArrow(run, _schema(kind, with_text)), told


def _finisher(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            found = []
            for text, items, spans in zip(cols["text"], cols["items"], cols["spans"], strict=True):
                merged: list[tuple[int, int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                    else:
                        merged.append((s, e))
                found.append((len(words_of(text)) if text else 0, merged, items or (), without_spans(text, merged) if with_text and merged else text))
            yield _rows(batch.column(batch.schema.get_field_index("doc_id")), found, with_text)

    return run


def is_contaminated(coverage: float = COVERAGE) -> Column:
    """Some word is hit, and at least this share of all words; in whole numbers, one part in ``1 / coverage``."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / coverage) >= F.col("n_words"))


def digest(items: Column) -> Column:
    """Of item ids sorted as strings, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without contaminated ones, and the others' texts without hit spans; columns as ``docs`` has them.

    Rows are matched with their hits inside one pass, so repeated and null ids are kept apart.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc_id"), F.col("text"))
    kept = decontaminate(packed, benchmark, with_text=True, **options).where(~is_contaminated())
    return kept.select(*[F.col("clean_text").alias("text") if c == "text" else F.col(f"doc_id.`{c}`").alias(c) for c in names])


ORACLE_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bi as (select item_id, w, least(len(w), 13) as n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s from bi),
sizes as (select distinct n from win),
di as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from w, sizes where len(w) >= n),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s from di),
hit as (select doc_id, d.n, i, item_id from dw d join win using (n, s)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hit where item_id is not null) group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from w left join words using (doc_id) left join items using (doc_id)
"""
