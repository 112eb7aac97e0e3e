"""Packing token sequences into windows by minimum bin slack.

Documents are cut into full windows and one remainder each. Of the remainders only the
histogram of lengths (at most ``window`` numbers) reaches the driver. There, a
bitset subset-sum dynamic programme picks the multiset of lengths that fills a window
closest to its capacity, the counts are read back from the bitsets, and the pattern is
used as often as the histogram allows. Rows find their place by their rank among the
pieces of equal length, which Spark computes with a range sort."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches_of, tokenizer
from .common import dense_slots, materialise, release

END = 1


def pieces(docs: DataFrame, path: str, window: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and the end id,
    cut into full windows and a remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = tokenizer(path), END.to_bytes(4, "little")
        for b in batches:
            for at, rows in batches_of(b.column(1)):
                part = b.slice(at, rows)
                out: list[tuple] = []
                for d, found in zip(part.column(0).to_pylist(), bpe.encode_many(part.column(1)), strict=True):
                    ids = found.astype("<u4").tobytes() + end
                    n = len(ids) // 4
                    out += [(d, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * min(n, s + window)]), n) for s in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is the largest up to
    ``capacity``; of equals, one that takes the longest pieces first. Bit s of a state
    says that the sum s can be reached by the lengths so far."""
    full = (1 << (capacity + 1)) - 1
    steps, state = [], 1
    for length in sorted((x for x in counts if counts[x] > 0 and x <= capacity), reverse=True):
        left, size = min(counts[length], capacity // length), 1
        while left:
            take = min(size, left)
            steps.append((length, take, state))
            state |= (state << (length * take)) & full
            left, size = left - take, size * 2
        if state >> capacity & 1:
            break
    total, chosen = state.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern, times)]: patterns that use up ``counts``."""
    counts, out = {k: v for k, v in counts.items() if v > 0}, []
    while counts:
        anchor = max(counts)
        counts[anchor] -= 1
        pattern = best_fill(counts, capacity - anchor)
        counts[anchor] += 1
        pattern[anchor] = pattern.get(anchor, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def pack(docs: DataFrame, path: str, window: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A null or empty text is one piece with the end id only; repeated rows are packed
    each; ties of length go by doc_id and start; an empty table gives an empty result;
    other columns are not read. Every id lies in exactly one piece."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, path, window, doc_id, text), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places, seen, base = [], {}, 0
    for pattern, times in plan(counts, window):
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            first = seen.get(length, 0)
            places.append((length, first, first + n * times, n, base, offset))
            seen[length], offset = first + n * times, offset + n * length
        base += times
    table = spark.createDataFrame(places, "_len long, _from long, _to long, _n long, _base long, _offset long")
    ranked = dense_slots(cut, ["length"], ["doc_id", "start"], "_rank")
    release(cut)
    here = (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    inside = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(table), here).select(
        *cut.columns,
        (F.col("_base") + F.floor(inside / F.col("_n"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + inside % F.col("_n") * F.col("length")).alias("offset"),
    )
