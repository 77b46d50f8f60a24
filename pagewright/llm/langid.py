"""Language identification by a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of n-grams (1 to 3 bytes of the lower-cased
text, digits as one) that both have, over the root of the product of how many each has. A bounded sample of labelled
documents trains it: some are Nystroem landmarks L, and ridge regression, one language against the rest, runs on the
features k(x, L) K_LL^(-1/2). A text's scores are then its presence row times one matrix of n-grams by languages
(landmark presences times the regression's weights), which scores a batch of texts as one matrix product.

A text is accepted if its score is not under the lowest that a training text of its own language has: what no language's
n-grams explain is rejected, clean text hardly ever.

Training is bounded by rows: ``SAMPLE`` documents and ``LANDMARKS`` landmarks of a language, with many languages
``ALL_SAMPLES`` and ``ALL_LANDMARKS`` in all; more than ``MOST`` languages are an error. Only n-grams come to the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import held_out, prepare, sampled, share, ship

ship(__name__)

#: Training documents and landmarks of each language; ridge penalty.
SAMPLE, LANDMARKS, RIDGE = 300, 60, 1e-2
#: The same for all languages together, and how many languages there may be.
ALL_SAMPLES, ALL_LANDMARKS, MOST = 6000, 1200, 500
UND = "und"
#: Texts in one matrix product.
ROWS = 64
#: Presence codes: one byte, two bytes and three bytes take separate ranges.
ONE, TWO, CODES = 0, 1 << 8, (1 << 8) + (1 << 16) + (1 << 24)
DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """The distinct n-gram codes of a text, sorted."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(DIGITS), np.uint8).astype(np.int32)
    two = raw[:-1] * 256 + raw[1:]
    three = two[:-1] * 256 + raw[2:]
    parts = []
    for codes, base in ((raw, 0), (two, TWO), (three, TWO + (1 << 16))):
        codes = np.sort(codes)
        parts.append(codes[np.concatenate(([True], codes[1:] != codes[:-1]))] + base if len(codes) else codes)
    return np.concatenate(parts)


def kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The matrix of kernels of two lists of texts, given by their codes; ``ROWS`` texts of ``b`` at a time."""
    out = np.zeros((len(a), len(b)))
    for low in range(0, len(b), ROWS):
        now = b[low : low + ROWS]
        known = np.unique(np.concatenate(now))
        right = np.zeros((len(now), len(known)), np.float32)
        for i, codes in enumerate(now):
            right[i, np.searchsorted(known, codes)] = 1 / np.sqrt(len(codes))
        for i, codes in enumerate(a):
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            out[i, low : low + ROWS] = right[:, at[known[at] == codes]].sum(axis=1, dtype=np.float64) / np.sqrt(len(codes))
    return out


@dataclass
class Model:
    """Languages, the sorted n-gram codes of the landmarks, each code's weight by language, a softmax's factor, the least score."""

    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    factor: float
    floor: float = 0.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        place = np.full(CODES, -1, np.int32) if not hasattr(self, "_place") else self._place
        if not hasattr(self, "_place"):
            place[self.codes] = np.arange(len(self.codes), dtype=np.int32)
            self._place = place
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        for at in range(0, len(rows), ROWS):
            now = rows[at : at + ROWS]
            present, norm = np.zeros((len(now), len(self.codes)), np.float32), np.ones(len(now))
            for k, i in enumerate(now):
                found = grams(texts[i])
                norm[k] = len(found)
                found = place[found]
                present[k, found[found >= 0]] = 1
            values = (present @ self.weights) / np.sqrt(norm)[:, None]
            soft = softmax(values, self.factor)
            best = values.argmax(axis=1)
            for k, i in enumerate(now):
                langs[i], scores[i] = self.langs[best[k]], float(min(1.0, soft[k, best[k]]))
        return langs, scores


def softmax(values: np.ndarray, factor: float) -> np.ndarray:
    soft = np.exp((values - values.max(axis=1, keepdims=True)) * factor)
    return soft / soft.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Train on (n-gram codes, language); the first ``landmarks`` texts of each language are landmarks."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), 1.0)
    landmarks = max(1, min(landmarks, ALL_LANDMARKS // len(langs)))
    texts, label = [codes for codes, _ in rows], np.array([langs.index(lang) for _, lang in rows])
    chosen = np.sort(np.concatenate([np.nonzero(label == k)[0][:landmarks] for k in range(len(langs))]))
    marks = [texts[i] for i in chosen]
    both = kernel(texts, marks)
    values, vectors = np.linalg.eigh(both[chosen] + 1e-8 * np.eye(len(chosen)))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = both @ root
    y = np.where(label[:, None] == np.arange(len(langs)), 1.0, -1.0)
    w = root @ np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(x.shape[1]), x.T @ y)
    codes = np.unique(np.concatenate(marks))
    weights = np.zeros((len(codes), len(langs)))
    for row, mark in zip(w, marks, strict=True):
        weights[np.searchsorted(codes, mark)] += row / np.sqrt(len(mark))
    raw = both @ w
    gap = np.sort(raw, axis=1)
    factor = 4.0 / max(1e-3, float(np.median(gap[:, -1] - gap[:, -2]))) if len(langs) > 1 else 1.0
    right = raw.argmax(axis=1) == label
    floor = 0.95 * float(softmax(raw, factor)[right].max(axis=1).min()) if right.any() else 0.0
    return Model(langs, codes, weights.astype(np.float32), factor, floor)


def training_rows(docs: DataFrame, sample: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, text) of about twice ``sample`` documents of every language, those whose id's hash is under its threshold."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~held_out("id"))
    told = known.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("n")).limit(MOST + 1).collect()
    if len(told) > MOST:
        raise ValueError(f"more than {MOST} languages to learn")
    most = 2 * max(1, min(sample, ALL_SAMPLES // max(1, len(told)))) + 10
    wanted = F.lit(False)
    for n in sorted({r["n"] for r in told}):
        wanted = wanted | (F.col("lang").isin([r["lang"] for r in told if r["n"] == n]) & sampled("id", most, n))
    return known.where(wanted).groupBy("id", "lang").agg(F.min("text").alias("text"))


def gram_rows(rows: DataFrame, sample: int) -> list[tuple[np.ndarray, str]]:
    """(codes, language) of the first ``sample`` documents of every language by the hash of their ids; n-grams are taken where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, t in enumerate(batch.column(2).to_pylist()) if has_letter(t)]
            codes = [grams(batch.column(2)[i].as_py()).astype("<i4").tobytes() for i in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int32())), batch.column(1).take(pa.array(kept, pa.int32())), pa.array(codes, pa.binary())], ["at", "lang", "codes"])

    told = defaultdict(list)
    for r in rows.select(F.xxhash64("id").alias("at"), "lang", "text").mapInArrow(run, "at long, lang string, codes binary").toLocalIterator():
        told[r["lang"]].append((r["at"], bytes(r["codes"])))
    most = max(1, min(sample, ALL_SAMPLES // max(1, len(told))))
    first = sorted((at, lang, codes) for lang, found in told.items() for at, codes in sorted(found)[:most])
    return [(np.frombuffer(codes, "<i4").astype(np.int32), lang) for _, lang, codes in first]


def identify(docs: DataFrame, train_on: DataFrame | None = None, sample: int = SAMPLE, landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted``, one row for each row of ``docs``.

    Learns from ``train_on`` (``docs`` itself unless given) where lang and id are not null, every value of lang. Null texts and
    texts without a letter are ``und`` with score 0, as are all without training rows; these are not accepted, nor are those
    whose score is under the lowest of the training texts. Repeated rows are predicted alike, and of rows that share id and
    lang the smallest text teaches; other columns are ignored; an empty table gives an empty one. ``lang``, ``doc_id`` and other
    columns are no inputs of a prediction.
    """
    prepare(docs.sparkSession)
    rows = gram_rows(training_rows(docs if train_on is None else train_on, sample, id_col, text_col, lang_col), sample)
    model = fit(rows, landmarks)
    told = share(docs.sparkSession, model)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            langs, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", ((F.col("lang_pred") != UND) & (F.col("score") >= model.floor)).alias("accepted"))
