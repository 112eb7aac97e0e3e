"""Hard negatives by segment summaries.

Each vector of integers is stored with the mean and deviation of its segments: the whole, then ever
shorter ones. For two segments of length L the inner product is L * (mean * mean' +- deviation *
deviation') at most and at least (Cauchy and Schwarz on what is left after the means), so that sums
of these bound a score. An anchor's rows are filtered level by level: what the bounds of the whole
vectors leave is bounded again by shorter segments, and only the rest is scored exactly.

Anchors go in blocks of bounded bytes, each against all rows: a first pass finds the nearest rows of the
same label, a second one the other rows whose scores lie in the bands below these. A task
keeps the few best of its own rows, and the filter tightens as it finds them; the tasks' best meet
by anchor."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, release
from .vectors import integers, usable

SCALE, LEVELS = 256, (1, 4, 16, 32)
#: Components beyond this could make scores that no long holds.
MOST = 1 << 26
#: Bytes of a block of anchors, anchors and rows that meet at once, share of pairs up to which they go one by one.
BLOCK, ANCHORS, ROWS, SPARSE = 16 << 20, 512, 2048, 1 / 8
NOTHING = -(1 << 62)


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all levels, level by level; rows are padded with zeros."""
    x = _padded(x).astype(np.float64)
    parts = [x.reshape(len(x), n, -1) for n in LEVELS]
    return np.hstack([p.mean(2) for p in parts]), np.hstack([p.std(2) for p in parts])


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % LEVELS[-1])))


class Vectors:
    """Rows with their summaries, scaled by the root of the segments' lengths."""

    def __init__(self, row, vec_id, label, x, means, deviations):
        self.row, self.vec_id, self.label, self.x, self.means, self.deviations = row, vec_id, label, x, means, deviations

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Vectors:
        table = lambda k, kind: np.frombuffer(b"".join(b.column(k).to_pylist()), kind).reshape(b.num_rows, -1)
        x = table(3, np.int64)
        root = np.sqrt(np.repeat([(x.shape[1] + -x.shape[1] % LEVELS[-1]) / n for n in LEVELS], LEVELS))
        return cls(*(b.column(k).to_numpy() for k in range(3)), x, table(4, np.float64) * root, table(5, np.float64) * root)

    def __getitem__(self, at) -> Vectors:
        return Vectors(self.row[at], self.vec_id[at], self.label[at], self.x[at], self.means[at], self.deviations[at])

    def __len__(self) -> int:
        return len(self.row)


def candidates(a: Vectors, b: Vectors, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the pairs of ``alive`` whose inner product is in [low, high] of its row of ``a``."""
    slack = 1e-9 * (np.abs(a.x).max(initial=1) * np.abs(b.x).max(initial=1)) * a.x.shape[1]
    low_, high_, at = low - slack, high + slack, 0
    i = j = None
    for n in LEVELS:
        level, at = slice(at, at + n), at + n
        if i is None and np.count_nonzero(alive) > SPARSE * alive.size:
            means, spread = a.means[:, level] @ b.means[:, level].T, a.deviations[:, level] @ b.deviations[:, level].T
            alive = alive & (means + spread >= low_[:, None]) & (means - spread <= high_[:, None])
            continue
        if i is None:
            i, j = np.nonzero(alive)
        keep = []
        for k in range(0, len(i), 1 << 15):
            p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            means = np.einsum("ps,ps->p", a.means[p, level], b.means[q, level])
            spread = np.einsum("ps,ps->p", a.deviations[p, level], b.deviations[q, level])
            keep.append((means + spread >= low_[p]) & (means - spread <= high_[p]))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        i, j = i[keep], j[keep]
    if i is None:
        i, j = np.nonzero(alive)
    scores = [np.einsum("pd,pd->p", a.x[i[k : k + (1 << 15)]], b.x[j[k : k + (1 << 15)]]) for k in range(0, len(i), 1 << 15)]
    scores = np.concatenate(scores) if scores else np.zeros(0, np.int64)
    keep = (scores >= low[i]) & (scores <= high[i])
    return i[keep], j[keep], scores[keep]


class Best:
    """The first ``count`` (score falling, then vec_id, then row) of what is added, for each of some keys."""

    def __init__(self, keys: int, count: int):
        self.count, self.found = count, np.zeros((4, 0), np.int64)  # key, score, vec_id, row
        self.least = np.full(keys, NOTHING)  # the last score of a key that has ``count``

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if len(key):
            f = np.hstack([self.found, np.array([key, score, vec_id, row])])
            f = f[:, np.lexsort((f[3], f[2], -f[1], f[0]))]
            begin = np.flatnonzero(np.append(True, f[0, 1:] != f[0, :-1]))
            place = np.arange(f.shape[1]) - np.repeat(begin, np.diff(np.append(begin, f.shape[1])))
            self.found = f[:, place < self.count]
            last = f[:, place == self.count - 1]
            self.least[last[0]] = last[1]


def _pieces(batches: Iterator[pa.RecordBatch], anchors: Vectors) -> Iterator[tuple[int, Vectors, Vectors]]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            b = Vectors.of(batch.slice(k, ROWS))
            for p in range(0, len(anchors), ANCHORS):
                yield p, anchors[p : p + ANCHORS], b


def _positives(anchors, count: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor (place in the block), score, vec_id, row: a task's nearest rows of the anchors' labels."""
    best = Best(len(anchors.value), count)
    for p, a, b in _pieces(batches, anchors.value):
        alive = (a.label[:, None] == b.label) & (a.row[:, None] != b.row)
        i, j, score = candidates(a, b, alive, best.least[p : p + len(a)], np.full(len(a), -NOTHING))
        best.add(p + i, score, b.vec_id[j], b.row[j])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.found], ["anchor", "score", "vec_id", "row"])


def _negatives(anchors, bands, count: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, score, vec_id, row: a task's first rows of other labels in each band (anchor, low, high)."""
    owner, low, high = bands.value
    best, n = Best(len(owner), count), len(anchors.value)
    begin = np.searchsorted(owner, np.arange(n + 1))
    most = np.full(n, NOTHING)
    np.maximum.at(most, owner, high)
    for p, a, b in _pieces(batches, anchors.value):
        part = slice(begin[p], begin[p + len(a)])
        floor = np.maximum(low[part], best.least[part])
        least = np.full(len(a), -NOTHING)
        np.minimum.at(least, owner[part] - p, floor)
        i, j, score = candidates(a, b, a.label[:, None] != b.label, least, most[p : p + len(a)])
        # each pair with each band of its anchor
        times = begin[p + i + 1] - begin[p + i]
        each = np.repeat(np.arange(len(i)), times)
        band = np.repeat(begin[p + i], times) + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        fits = (score[each] >= np.maximum(low, best.least)[band]) & (score[each] <= high[band])
        each, band = each[fits], band[fits]
        best.add(band, score[each], b.vec_id[j[each]], b.row[j[each]])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.found], ["band", "score", "vec_id", "row"])


def _first(df: DataFrame, key: str, count: int) -> DataFrame:
    """The first ``count`` of the tasks' rows of a key: at most ``count`` from each task meet."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id", "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(df: DataFrame, anchor: Column | None = None, positives: int = 5, negatives: int = 5, percent: int = 80, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``anchor`` holds (ids divisible by 100). Scores are inner products of
    the integers floor(256 * entry); the higher comes first, of equal ones the smaller id. An anchor's positives are the first
    other rows of its label; for each, the first rows of other labels follow whose score is at least
    ``percent`` percent of the positive's and at most equal to it (none, if that is negative).

    Rows with a null id or label, or a vector that is null, empty, of another length than most, or holds a null or
    non-finite entry or one whose integer is beyond MOST, take no part. Rows that repeat an id are rows of
    their own: each is an anchor, and one may be the other's positive. An empty table gives an empty result; other
    columns are not read."""
    anchor = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    given = df.select(F.col(key).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).alias("v"))
    rows = usable(given.where("vec_id is not null and label is not null"), "v").withColumn("row", F.monotonically_increasing_id())
    fine = lambda x: F.abs(F.floor(x.cast("double") * SCALE)) <= MOST
    rows = rows.where(F.forall("v", fine)).select("row", "vec_id", "label", "v")
    kinds = "row long, vec_id long, label long, x binary, means binary, deviations binary"
    stored = materialise(rows.mapInArrow(_summarised, kinds), "vectors")
    spark, chosen = df.sparkSession, stored.where(anchor)
    n = chosen.count()
    width = chosen.select(F.octet_length("x") + F.octet_length("means") + F.octet_length("deviations")).first()
    found = []
    blocks = max(1, -(-n * (width[0] if width else 1) // BLOCK))
    for k in range(blocks):
        block = chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).orderBy("row").toArrow()
        if not block.num_rows:
            continue
        own = Vectors.of(block.combine_chunks().to_batches()[0])
        anchors = spark.sparkContext.broadcast(own)
        near = stored.mapInArrow(partial(_positives, anchors, positives), "anchor long, score long, vec_id long, row long")
        near = _first(near, "anchor", positives).orderBy("anchor", "rank").toArrow()
        owner, score, positive = (near.column(c).to_numpy() for c in ("anchor", "score", "vec_id"))
        bands = spark.sparkContext.broadcast((owner, -(-score * percent // 100), score))
        far = stored.mapInArrow(partial(_negatives, anchors, bands, negatives), "band long, score long, vec_id long, row long")
        names = spark.createDataFrame(pa.table({"band": np.arange(len(owner)), "anchor_id": own.vec_id[owner], "positive_id": positive, "positive_score": score}))
        out = _first(far, "band", negatives).join(F.broadcast(names), "band")  # a block's bands, of bounded number
        found.append(materialise(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    release(stored)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], empty)


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            part = b.slice(k, ROWS)
            x = integers(part.column(3), SCALE)
            blobs = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, *summaries(x))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *blobs], ["row", "vec_id", "label", "x", "means", "deviations"])
