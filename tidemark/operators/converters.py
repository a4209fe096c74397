"""Registry of page conversions that users plug in.

A plugged-in converter is ``convert(html, base_url) -> str``.  It runs in
``mapInArrow`` over slices of Arrow batches, page by page; a failure is recorded as
``Type: message`` with an empty output and the job goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Converter:
    name: str
    kind: str
    convert: Callable[[str, str], str]
    ranked: bool = True
    notes: str = ""


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Converter] = {}

    def register(self, name: str, kind: str, fn: Callable[[str, str], str], ranked: bool = True, notes: str = "") -> Converter:
        if kind not in ("converter", "extractor"):
            raise ValueError(f"kind must be converter or extractor, not {kind!r}")
        self._known[name] = Converter(name, kind, fn, ranked, notes)
        return self._known[name]

    def select(self, *names: str) -> list[Converter]:
        missing = [n for n in names if n not in self._known]
        if missing:
            raise KeyError(f"unknown converters: {', '.join(missing)}")
        return [self._known[n] for n in names] if names else list(self._known.values())


#: Bytes of pages that a task converts at once; its outputs are held as long.
SLICE_BYTES = 1 << 20
_OUT = pa.schema([("page_id", pa.int64()), ("tool", pa.string()), ("kind", pa.string()), ("ranked", pa.bool_()), ("md", pa.string()), ("error", pa.string())])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE_BYTES`` of pages; a page is never cut."""
    size = pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        yield batch.slice(start, end - start)


def _stage(converters: list[Converter]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                rows = []
                for page_id, url, page in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    for tool in converters:
                        try:
                            md, error = tool.convert(page, url) or "", None
                        except Exception as exc:  # recorded, never fatal
                            md, error = "", f"{type(exc).__name__}: {exc}"
                        rows.append((page_id, tool.name, tool.kind, tool.ranked, md, error))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)], schema=_OUT)

    return run


def convert_pages(pages: DataFrame, converters: list[Converter]) -> DataFrame:
    """``page_id, tool, kind, ranked, md, error`` for every page and converter."""
    return pages.select("page_id", "url", "html").mapInArrow(
        _stage(converters),
        "page_id bigint, tool string, kind string, ranked boolean, md string, error string",
    )


def conversion_errors(converted: DataFrame) -> DataFrame:
    return converted.filter("error IS NOT NULL").groupBy("tool", "error").agg(F.count("*").alias("n"))
