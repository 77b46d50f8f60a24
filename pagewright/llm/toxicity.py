"""Toxicity by compression distance: zstandard dictionaries trained apart on toxic and on ordinary text.

A window is a word of a text, or a piece of at most ``WIDTH`` characters of a longer run, between blanks. Each of ``PAIRS``
is two dictionaries of one size, which zstandard trains on the windows of toxic and of ordinary documents (a window
counts once a document, so that one document's repetitions don't fill a dictionary). A window is compressed with
both, behind a carrier (a stretch of the ordinary dictionary, so that short frames are not stored raw), and falls in a
cell by the bytes that the toxic dictionary saves, the bytes it takes, and the window's length. Documents that no
dictionary has seen calibrate the cells: a cell's weight is the log odds of toxic documents that have it, and a
logistic regression on the weights of all windows of a text gives the score, whose threshold is 0.5.

Windows of 64 or 256 bytes were measured first: their lengths differ more by which common phrases a dictionary happens
to hold than by a few toxic words (README has the figures).

Only the labelled rows that training reads are bounded: about ``SAMPLE`` documents of each label, those whose id's hash
is under the label's threshold. Every document is scored over its whole text.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Lazy, held_out, prepare, sampled, share, ship

ship(__name__)

#: Training documents of each label: ordinary, toxic.
SAMPLE = (4000, 2500)
#: Pairs of dictionaries: bytes of each, and whether the windows it is trained on are shuffled.
PAIRS = ((8192, False), (8192, True), (16384, True))
#: COVER's segment and d-mer sizes, the compression level, blanks on either side of a window, its characters at most.
SEGMENT, DMER, LEVEL, BLANKS, WIDTH = 16, 8, 12, 3, 24
#: A cell counts from this log odds and as many toxic documents on; the sum of a text's weights is squashed at ``FULL``.
ODDS, SEEN, FULL = 1.0, 3, 30.0
CACHE = 400_000
WORD = re.compile(r"[^\W_]{1,%d}" % WIDTH)
PAD = b" " * BLANKS


def windows_of(text: str | None) -> Counter:
    """The windows of a whole text, with how often each occurs."""
    return Counter(WORD.findall(text.lower())) if text else Counter()


def padded(window: str) -> bytes:
    return PAD + window.encode("utf-8", "surrogatepass") + PAD


def trained(windows: list[bytes], size: int) -> bytes:
    """The content of a dictionary of ``size`` bytes that zstandard trains on the windows; their own bytes if it can't."""
    try:  # room for the header, which goes
        return zstandard.train_dictionary(size + 1200, windows, k=SEGMENT, d=DMER).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(windows)[-size:]


def sizer(content: bytes):
    """A function from bytes to their compressed length with this dictionary."""
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return lambda raw: len(compress(raw))


@dataclass
class Pair:
    """Two dictionaries and the weights of the cells."""

    ordinary: bytes
    toxic: bytes
    weights: dict[tuple[int, int, int], float] = field(default_factory=dict)

    def cells(self):
        """A function from a window to its cell."""
        carrier, ordinary, toxic = self.ordinary[-40:-8], sizer(self.ordinary), sizer(self.toxic)
        o0, t0 = ordinary(carrier + PAD), toxic(carrier + PAD)

        def cell(window: str, wanted: set | None = None) -> tuple[int, int, int] | None:
            """The cell; None if its last two numbers are not among those ``wanted``, without compressing twice."""
            raw = carrier + padded(window)
            takes, size = toxic(raw) - t0, min(len(raw), 64)
            return None if wanted is not None and (takes, size) not in wanted else (ordinary(raw) - o0 - takes, takes, size)

        return cell


@dataclass
class Model:
    """What the executors get: the pairs and the regression."""

    pairs: list[Pair] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    slope: list[float] = field(default_factory=list)
    bias: float = -5.0

    def features(self):
        """A function from a text's windows to its numbers; keeps the weights of at most ``CACHE`` windows."""
        cells, known = [(p.cells(), p.weights, {c[1:] for c in p.weights}) for p in self.pairs], {}

        def weigh(window: str) -> tuple[float, ...]:
            got = known.get(window)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = tuple(weights.get(cell(window, wanted), 0.0) for cell, weights, wanted in cells)
                got = known[window] = got if any(got) else ()
            return got

        def numbers(windows: Counter) -> list[float]:
            found = [(w, n) for window, n in windows.items() if (w := weigh(window))]
            out = []
            for k in range(len(cells)):
                mine = [(w[k], n) for w, n in found if w[k]]
                out += [min(sum(w * n for w, n in mine), FULL), max((w for w, _ in mine), default=0.0), float(len(mine))]
            return [*out, math.log1p(sum(windows.values()))]

        return numbers

    def scorer(self):
        """A function from a text to its score."""
        numbers = self.features()

        def score(text: str | None) -> float:
            z = self.bias
            if self.slope:
                z += sum(b * (x - m) / s for b, x, m, s in zip(self.slope, numbers(windows_of(text)), self.mean, self.scale, strict=True))
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def cell_weights(pair: Pair, texts: list[tuple[Counter, int]]) -> dict[tuple[int, int, int], float]:
    """Log odds of the cells in which the toxic dictionary saves bytes, by how many documents of each label have them."""
    cell, n = pair.cells(), Counter(y for _, y in texts)

    def count(label: int, wanted: set | None) -> Counter:
        known, hits = Lazy(lambda w: cell(w, wanted)), Counter()
        for windows, y in texts:
            if y == label:
                hits.update({known[w] for w in windows})
        return hits

    toxic = {c: k for c, k in count(1, None).items() if c[0] > 0 and k >= SEEN}
    ordinary = count(0, {c[1:] for c in toxic})
    odds = {c: math.log((k + 0.5) / (n[1] + 1)) - math.log((ordinary[c] + 0.5) / (n[0] + 1)) for c, k in toxic.items()}
    return {c: w for c, w in odds.items() if w > ODDS}


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x, b = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        b += np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
    return b


def fit(rows: Iterable[tuple[Counter, int]], pairs: tuple = PAIRS) -> Model:
    """Train on (windows, label 0 or 1): three of five rows make the dictionaries, the others calibrate."""
    teach, rest = ([], []), []
    for k, (windows, label) in enumerate(rows):
        if k % 5 < 3:
            teach[label].append(windows)
        else:
            rest.append((windows, label))
    if not (teach[0] and teach[1]) or len({y for _, y in rest}) < 2:
        return Model()
    made = []
    for size, shuffled in pairs:
        contents = []
        for texts in teach:
            samples = [padded(w) for windows in texts for w in sorted(windows)]
            if shuffled:
                random.Random(3).shuffle(samples)
            contents.append(trained(samples, size))
        made.append(Pair(*contents))
        made[-1].weights = cell_weights(made[-1], rest)
    numbers = Model(made).features()
    x, y = np.array([numbers(w) for w, _ in rest]), np.array([y for _, y in rest], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    slope = regression((x - mean) / scale, y)
    return Model(made, mean.tolist(), scale.tolist(), slope[:-1].tolist(), float(slope[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, toxic, text) of the sampled documents, one row an id; an id that is labelled more than once counts as its highest label."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = known.where(F.when(F.col("toxic") == 1, sampled("id", sample[1], counts.get(1, 0))).otherwise(sampled("id", sample[0], counts.get(0, 0))))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(chosen, "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))


def window_rows(rows: DataFrame) -> Iterator[tuple[Counter, int]]:
    """(windows, toxic) on the driver, by the hash of the id; texts are cut into windows where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [windows_of(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["at", "toxic", "words", "n"])

    cut = rows.select(F.xxhash64("id").alias("at"), "toxic", "text").mapInArrow(run, "at long, toxic int, words array<string>, n array<int>")
    same: dict[str, str] = {}
    got = [(r["at"], Counter({same.setdefault(w, w): n for w, n in zip(r["words"], r["n"], strict=True)}), r["toxic"]) for r in cut.toLocalIterator()]
    return ((windows, toxic) for _, windows, toxic in sorted(got, key=lambda r: r[0]))


def score(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row for each row of ``docs``.

    Null and empty texts have no windows and get the score of that. Ids with a null label, or that are null, teach
    nothing; repeated rows are scored alike, and of rows that share an id the smallest text teaches; without both labels
    in the training rows every score is the same, below 0.5; other columns are ignored; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, sample, id_col, text_col, label_col)
    told = share(docs.sparkSession, fit(window_rows(rows)))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = told.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rate(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    rated = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return rated.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
