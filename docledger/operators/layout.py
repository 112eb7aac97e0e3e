"""Lines of text from fragments that lie on a page."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Height of a fragment where none is known, and the share of a mean height within which a line goes on.
HEIGHT, SHARE = 20.0, 0.5


def reconstructed(fragments: DataFrame, order: list[str], key: str = "doc_id") -> DataFrame:
    """``key``, text: the lines of each page, from fragments (``key``, x, y, y_bottom, text).

    Fragments are taken from top to bottom, those of equal y by ``order``. One belongs to the current line if its y
    is within half the page's mean height of the mean y of that line; a line's fragments go by x, joined by
    spaces, lines by line feeds. Missing coordinates are 0; fragments without text are left out, and a page without
    others has an empty text.

    One shuffle by page, sorted within tasks; the scan is linear in fragments and holds one page at a time."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    height = F.abs(F.col("y_bottom") - F.col("y")).cast("double").alias("_height")
    laid = fragments.select(key, zero("x"), zero("y"), height, "text", *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    laid = laid.repartition(key).sortWithinPartitions(key, "y", *[f"_o{k}" for k in range(len(order))])
    kind = fragments.schema[key].dataType.simpleString()
    return laid.select(key, "x", "y", "_height", "text").mapInArrow(_pages, f"`{key}` {kind}, text string")


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole pages of sorted fragments; the last one of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for b in chain((b for b in batches if b.num_rows), [None]):
        if b is None:
            if held:
                yield _texts(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            return
        code = _codes(b.column(0))
        last = int(np.flatnonzero(code != code[-1]).max(initial=-1)) + 1
        if last or held and held[-1].column(0)[-1] != b.column(0)[0]:
            yield _texts(pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks().to_batches()[0])
            held = []
        held.append(b.slice(last))


def _codes(keys: pa.Array) -> np.ndarray:
    return keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _texts(b: pa.RecordBatch) -> pa.RecordBatch:
    code = _codes(b.column(0))
    begin = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)
    page = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(code))))
    texts = b.column(4).to_pylist()
    kept = np.flatnonzero([bool(t) for t in texts])
    page, x, y, height = page[kept], *(b.column(k).to_numpy(zero_copy_only=False)[kept] for k in (1, 2, 3))
    known = ~np.isnan(height)
    count = np.bincount(page[known], minlength=len(begin))
    total = np.bincount(page[known], height[known], len(begin))
    near = np.where(count > 0, total / np.maximum(count, 1), HEIGHT) * SHARE
    line = np.cumsum(starts(page, y, near[page]))
    words = [texts[k] for k in kept[np.lexsort((x, line))].tolist()]  # a stable sort: equal x stay by y
    out: list[list[str]] = [[] for _ in begin]
    cut = np.append(np.flatnonzero(np.diff(line, prepend=-1)), len(line)).tolist()
    for p, q in zip(cut, cut[1:], strict=False):
        out[page[p]].append(" ".join(words[p:q]))
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(begin)), pa.array(["\n".join(lines) for lines in out], pa.string())], [b.schema.names[0], "text"])


def starts(page: np.ndarray, y: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Whether each of the fragments, sorted by page and y, starts a line.

    A step of more than ``near`` always does, as no mean is above the fragment before. What lies between such steps is
    one line if it spans no more than ``near``; only the rest is scanned fragment by fragment."""
    first = np.ones(len(y), bool)
    first[1:] = (page[1:] != page[:-1]) | (y[1:] - y[:-1] > near[1:])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(y)) if len(y) else begin
    for p, q in zip(begin.tolist(), end.tolist(), strict=True):
        if y[q - 1] - y[p] > near[p]:
            total, n, most = 0.0, 0, near[p]
            for k, here in enumerate(y[p:q].tolist(), p):
                if n and abs(here - total / n) > most:
                    first[k], total, n = True, 0.0, 0
                total, n = total + here, n + 1
    return first
