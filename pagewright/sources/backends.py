"""Backends at the edge: PDF pages, detectors, models and stores. Each runs in batches on the executors.

A backend is a class with the method named here; its libraries are imported inside that method. The stubs are
deterministic and need no library. Errors of a page are rows, not exceptions, so that a retried task repeats no call that
has been answered within it; the number of partitions is the number of callers at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

DETECTED = "doc_id string, page_number int, det_idx long, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"
ANSWERED = "doc_id string, page_number int, success boolean, raw_response string, error string"
INFORMED = "name string, n_pages int, metadata map<string,string>, sizes array<struct<width:double,height:double>>, error string"
RASTERISED = "name string, page_number int, image_path string, width int, height int, status string, content binary"


class PageSource(Protocol):
    def pages(self, name: str, content: bytes) -> list[tuple[int, int, int, bytes]]:
        """(number from 1, width, height, PNG) of a PDF's pages."""

    def info(self, name: str, content: bytes) -> tuple[dict[str, str], list[tuple[float, float]]]:
        """A PDF's metadata, and the sizes of its pages in points."""


class Detector(Protocol):
    def detect(self, image: bytes) -> list[tuple[int, str, float, float, float, float, float]]:
        """(class id, class name, confidence, x1, y1, x2, y2) on one page."""


class Model(Protocol):
    def ask(self, prompt: str, image: bytes) -> str:
        """A model's answer about one page."""


class Store(Protocol):
    def put(self, path: str, content: bytes) -> None:
        """Keep a file under a path."""


class StubPages:
    """One empty page for each 1000 bytes begun."""

    def pages(self, name: str, content: bytes) -> list[tuple[int, int, int, bytes]]:
        return [(k + 1, 1654, 2339, b"") for k in range(-(-len(content) // 1000))]

    def info(self, name: str, content: bytes) -> tuple[dict[str, str], list[tuple[float, float]]]:
        return {"title": name}, [(612.0, 792.0) for _ in self.pages(name, content)]


class StubDetector:
    """A figure with its caption on every page."""

    def detect(self, image: bytes) -> list[tuple[int, str, float, float, float, float, float]]:
        return [(3, "Figure", 0.9, 100.0, 100.0, 400.0, 300.0), (4, "Figure-Caption", 0.8, 100.0, 320.0, 400.0, 350.0)]


class StubModel:
    """Pairs the first figure with the first caption."""

    def ask(self, prompt: str, image: bytes) -> str:
        return '{"matches": [{"figure_id": 1, "figure_type": "figure", "caption_id": 1, "confidence": 0.9}], "unmatched_captions": []}'


class FolderStore:
    """Keeps files below a folder that all executors share."""

    def __init__(self, root: str) -> None:
        self.root = root

    def prepare(self) -> None:
        import os

        os.makedirs(self.root, exist_ok=True)

    def put(self, path: str, content: bytes) -> None:
        import os

        os.makedirs(os.path.dirname(f"{self.root}/{path}"), exist_ok=True)
        with open(f"{self.root}/{path}", "wb") as f:
            f.write(content)


def rasterise(files: DataFrame, source: PageSource) -> DataFrame:
    """Pages of files (name, content); a file that fails gives one row whose status is its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["name", "page_number", "image_path", "width", "height", "status", "content"]
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                try:
                    rows = [(name, k, f"{name}/pages/page_{k:04d}.png", w, h, "success", png) for k, w, h, png in source.pages(name, bytes(content))]
                except Exception as e:  # noqa: BLE001  the error is the result
                    rows = [(name, None, None, None, None, f"error: {e}", None)]
                yield pd.DataFrame(rows, columns=columns).astype({"page_number": "Int32", "width": "Int32", "height": "Int32"})

    return files.select("name", "content").mapInPandas(run, RASTERISED)


def pdf_info(files: DataFrame, source: PageSource) -> DataFrame:
    """Number, sizes (in points) and metadata of the pages of files (name, content), or the error of a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                try:
                    metadata, sizes = source.info(name, bytes(content))
                    rows.append((name, len(sizes), metadata, [{"width": w, "height": h} for w, h in sizes], None))
                except Exception as e:  # noqa: BLE001  the error is the result
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["name", "n_pages", "metadata", "sizes", "error"]).astype({"n_pages": "Int32"})

    return files.select("name", "content").mapInPandas(run, INFORMED)


def available(model: Model) -> str | None:
    """Why a model can't be asked, or None if it can, as its own ``check`` (if it has one) tells on the driver."""
    try:
        getattr(model, "check", lambda: None)()
    except Exception as e:  # noqa: BLE001  the error is the result
        return f"{type(e).__name__}: {e}"
    return None


def detect(pages: DataFrame, detector: Detector, minimum: float = 0.25) -> DataFrame:
    """Detections on pages (doc_id, page_number, content) with at least this confidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "page_number", "det_idx", "class_id", "class_name", "confidence", "x1", "y1", "x2", "y2"]
        for batch in batches:
            rows = []
            for doc, page, content in zip(batch["doc_id"], batch["page_number"], batch["content"], strict=True):
                kept = [d for d in detector.detect(bytes(content or b"")) if d[2] >= minimum]
                rows += [(doc, page, k, d[0], d[1], round(d[2], 4), *[round(v, 2) for v in d[3:]]) for k, d in enumerate(kept)]
            yield pd.DataFrame(rows, columns=columns)

    return pages.select("doc_id", "page_number", "content").mapInPandas(run, DETECTED)


def ask(pages: DataFrame, model: Model, callers: int | None = None, tries: int = 3) -> DataFrame:
    """A model's answers about pages (doc_id, page_number, prompt, content); ``callers`` caps the calls at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            rows = []
            for doc, page, prompt, content in zip(batch["doc_id"], batch["page_number"], batch["prompt"], batch["content"], strict=True):
                said, error = None, None
                for k in range(tries):
                    try:
                        said, error = model.ask(prompt, bytes(content or b"")), None
                        break
                    except Exception as e:  # noqa: BLE001  the error is the result
                        error = f"{type(e).__name__}: {e}"
                        if k + 1 < tries:
                            time.sleep(min(10, 2**k))
                rows.append((doc, page, error is None, said, error))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "success", "raw_response", "error"])

    asked = pages.select("doc_id", "page_number", "prompt", "content")
    return (asked.repartition(callers) if callers else asked).mapInPandas(run, ANSWERED)


def upload(files: DataFrame, store: Store) -> None:
    """Put files (path, content) in a store; putting one again replaces it, so a retried task does no harm.

    A store that has ``prepare`` is told first, on the driver, so that it can make its folder or bucket.
    """
    getattr(store, "prepare", lambda: None)()

    def run(rows) -> None:
        for r in rows:
            store.put(r["path"], bytes(r["content"]))

    files.select("path", "content").foreachPartition(run)
