"""Removal of long repeated strings across a corpus, by prefix-free parsing.

Texts are sequences of units: their bytes, or their words (with what stands between them).
A rolling-hash trigger cuts every text: for each window of ``length`` units the trigger is
the position of the smallest hash among the window's first ``span_of(length)`` positions, so
equal windows have their trigger at the same place, wherever they stand. All windows of one
trigger form a run, whose text around the trigger is its phrase. The dictionary of
phrases is named by digests and counted by Spark:

1. a run whose core (what all its windows share) is unique has no repeated window;
2. a run whose whole phrase occurs again is repeated as a whole;
3. the other phrases, at the ends of repeated passages, are sorted within tasks that each hold
   all phrases of some cores: the suffix array of what follows the triggers (the parse) and that
   of what precedes them, read backwards (the dictionary's phrase suffixes), with their common
   prefixes. A window that starts ``a`` units before its trigger is named by its class of
   preceding strings at depth a and its class of following ones at depth length - a; windows
   of equal names are neighbours in the corpus order of suffixes, and repeat.

Only distinct phrases go on, with their number of copies, so that large groups of copies cost
no more than one. A core that has more than MANY distinct phrases does not fit a task: these are split
into cells of CELL windows, which go through tests 1 and 2 again, and the rest into single windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, release, with_group

LEAST, CELL = 24, 16
#: Distinct phrases of one core that a task may hold; phrases that a task should hold.
MANY, TASK = 20_000, 20_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Searches that share one pass over the texts: the length of a window, and whether it counts words. A run's
#: number is its place among the runs of its search, times the number of searches, plus the search's.
Searches = list[tuple[int, bool]]


def span_of(length: int) -> int:
    """The largest power of two up to two thirds of ``length``: a third at least is a run's core."""
    return 1 << (2 * length // 3).bit_length() - 1


class Units:
    """A text as a sequence of units: bytes, or words, which ASCII white space separates. A
    slice of it has the bytes from its first unit's start to its last one's end."""

    def __init__(self, data: bytes, words: bool):
        self.data, self.view, self.words, self.count = data, memoryview(data), words, len(data)
        self.digests: dict[str, np.ndarray] = {}
        if words:
            b = np.frombuffer(data, np.uint8)
            word = np.concatenate([[False], (b != 32) & ((b < 9) | (b > 13)), [False]])
            self.starts, self.ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
            self.count = len(self.starts)

    def __len__(self) -> int:
        return self.count

    def place(self, a: int, b: int) -> tuple[int, int]:
        """The bytes [from, end) of the units [a, b), which are not empty."""
        return (int(self.starts[a]), int(self.ends[b - 1])) if self.words else (a, b)

    def __getitem__(self, part: slice) -> memoryview:
        a, b = self.place(part.start, part.stop)
        return self.view[a:b]

    def names(self, a: int, b: int, after: bool) -> bytes:
        """Names of the units [a, b): the byte itself, or eight bytes for the word with the white space
        before it or, with ``after``, behind it; backwards then."""
        if not self.words:
            return self.data[a:b][::-1] if after else self.data[a:b]
        if after:
            return self._named(self.starts[:-1], self.starts[1:], "behind")[a:b][::-1].tobytes()
        return self._named(self.starts, self.ends, "alone")[a : a + 1].tobytes() + self._named(self.ends[:-1], self.ends[1:], "before")[a : b - 1].tobytes()

    def _named(self, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
        """A 64-bit digest for each of the parts [start, end): sums over mixed bytes and their places."""
        if kind not in self.digests:
            sizes = ends - starts
            first = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            x = (np.frombuffer(self.data, np.uint8)[np.repeat(starts, sizes) + place].astype(np.uint64) + np.uint64(1)) | (place.astype(np.uint64) << np.uint64(9))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x ^ (x >> np.uint64(31)))])
            self.digests[kind] = sums[first + sizes] - sums[first]
        return self.digests[kind]

    def grams(self, count: int) -> np.ndarray:
        """The eight bytes from each of the first ``count`` units' starts on."""
        if not self.words:
            return np.ndarray((count,), "<u8", self.data, strides=(1,))
        return np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))[self.starts[:count]]


def runs_of(data: Units, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and trigger of each run of windows with one trigger."""
    windows, span = len(data) - length + 1, span_of(length)
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3
    count = windows + span - 1
    grams = data.grams(count)
    low = ((grams * FACTOR) & np.uint64(0xFFFFFFFF00000000)) | np.arange(count, dtype=np.uint64)
    step = 1
    while step < span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    trigger = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(trigger[1:] != trigger[:-1]) + 1])
    return first, np.append(first[1:] - 1, windows - 1), trigger[first]


class Views(dict):
    """By search: a text's units, and the first windows, last windows and triggers of its runs."""

    def __init__(self, data: bytes, searches: Searches):
        self.data, self.searches = data, searches

    def __missing__(self, kind: int) -> tuple[Units, np.ndarray, np.ndarray, np.ndarray]:
        length, words = self.searches[kind]
        view = Units(self.data, words)
        self[kind] = view, *runs_of(view, length)
        return self[kind]


def core(data: Units, t: int, length: int, kind: int = 0) -> int:
    """Digest of what all windows with trigger t share, as a signed 64-bit integer; searches share none."""
    return signed(xxhash.xxh3_64_intdigest(data[t : t + length - span_of(length) + 1], seed=kind))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def around(data: Units, a: int, b: int, t: int) -> bytes:
    """Digest of the context [a, b) of trigger t, cut at the ends of the text."""
    a, b = max(0, a), min(len(data), b)
    return xxhash.xxh3_128_digest(data[a:b], seed=(t - a) << 32 | (b - t))


def _parse(docs: DataFrame, searches: Searches) -> DataFrame:
    """doc_id, n_bytes, n_units of each search, sha, cores: the runs with the digests of their cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, size, units, sha, runs, cores, ends = b.slice(k, 256), [], [], [], [], [], [0]
                for data in part.column(1).to_pylist():
                    views = Views(data, searches)
                    size.append(len(data)), units.append([len(views[x][0]) for x in range(len(searches))]), sha.append(hashlib.sha256(data).digest())
                    for x, (length, _) in enumerate(searches):
                        view, _, _, ts = views[x]
                        runs.append(np.arange(len(ts), dtype=np.int32) * len(searches) + x)
                        cores += [core(view, t, length, x) for t in ts.tolist()]
                    ends.append(len(cores))
                struct = pa.StructArray.from_arrays([pa.array(np.concatenate(runs)), pa.array(cores, pa.int64())], ["run", "core"])
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(units, pa.list_(pa.int64())), pa.array(sha, pa.binary()), listed], ["doc_id", "n_bytes", "n_units", "sha", "cores"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_units array<long>, sha binary, cores array<struct<run:int,core:long>>")


def _contexts(texts: DataFrame, searches: Searches) -> DataFrame:
    """rid, run, kind, from, end (of its windows), core, context, copies for the runs listed with
    each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                out: list[tuple] = []
                for rid, copies, data, listed in zip(*(c.to_pylist() for c in b.slice(k, 128).columns), strict=True):
                    views = Views(data, searches)
                    for number in listed:
                        r, kind = divmod(number, len(searches))
                        view, first, last, ts = views[kind]
                        t, length = int(ts[r]), searches[kind][0]
                        out.append((rid, number, kind, int(first[r]), int(last[r]) + length, core(view, t, length, kind), around(view, t - span_of(length) + 1, t + length, t), copies))
                yield _batch(out, kinds)

    kinds = [("rid", pa.int64()), ("run", pa.int32()), ("kind", pa.int32()), ("from", pa.int64()), ("end", pa.int64()), ("core", pa.int64()), ("context", pa.binary()), ("copies", pa.int64())]
    return texts.select("rid", "copies", "data", "runs").mapInArrow(run, "rid long, run int, kind int, from long, end long, core long, context binary, copies long")


def _batch(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def _phrases(texts: DataFrame, searches: Searches) -> DataFrame:
    """rid, t, from, to, core, copies, left, right, kind for the listed runs: the names of the units
    before the trigger, backwards, and from it on, within the phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                out: list[tuple] = []
                for rid, data, listed in zip(*(c.to_pylist() for c in b.slice(k, 128).columns), strict=True):
                    views = Views(data, searches)
                    for x in listed:
                        r, kind = divmod(x["run"], len(searches))
                        view, first, last, ts = views[kind]
                        p, q, t = int(first[r]), int(last[r]), int(ts[r])
                        out.append((rid, t, p, q, x["core"], x["copies"], view.names(p, t, True), view.names(t, q + searches[kind][0], False), kind))
                yield _batch(out, kinds)

    kinds = [("rid", pa.int64()), ("t", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("core", pa.int64()), ("copies", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("kind", pa.int32())]
    return texts.select("rid", "data", "runs").mapInArrow(run, "rid long, t long, from long, to long, core long, copies long, left binary, right binary, kind int")


def suffix_order(rows: list[bytes], heads: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): ``rows`` sorted by head, then content; for each place of the order the number of
    units (of ``size`` bytes) in common with the place before, -1 where the head differs."""
    n = len(rows)
    table = np.zeros((n, 8 + width + 4), np.uint8)  # what is equal but for zero bytes at its end goes by its length
    ends = np.array([len(r) for r in rows], np.int64)
    table[:, :8] = heads.astype(">i8").view(np.uint8).reshape(n, 8)
    table[:, 8:-4][np.arange(width) < ends[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    table[:, -4:] = ends.astype(">u4").view(np.uint8).reshape(n, 4)
    order = np.argsort(table.view(f"S{table.shape[1]}").ravel(), kind="stable")
    table, ends = table[order], ends[order]
    differ = np.ones((n, 8 + width + 1), bool)
    differ[1:, :-1] = table[1:, :-4] != table[:-1, :-4]
    shared = differ.argmax(1) - 8
    shared[1:] = np.minimum(shared[1:], np.minimum(ends[1:], ends[:-1]))
    return order, np.where(shared < 0, -1, shared // size)


def repeated_windows(t: np.ndarray, first: np.ndarray, last: np.ndarray, core: np.ndarray, copies: np.ndarray, left: list[bytes], right: list[bytes], length: int, size: int) -> list[tuple[int, int, int]]:
    """(phrase, from, end): the windows of phrases, which have all those of their cores beside them, that occur
    more than once, as intervals of units. The phrases are distinct and ``copies`` says how often each occurs."""
    n, span = len(t), span_of(length)
    by_right, next_ = suffix_order(right, core, size * length, size)
    by_left, before = suffix_order(left, core, size * span, size)
    at_right, at_left = np.empty(n, np.int64), np.empty(n, np.int64)
    least, most = t - last, t - first  # of the units between a window's start and the trigger
    hits: list[tuple[np.ndarray, int]] = []
    for a in range(int(least.min()), int(most.max()) + 1):
        here = np.flatnonzero((least <= a) & (a <= most))
        if not len(here):
            continue
        at_left[by_left] = np.cumsum((before < a) | (before < 0))
        at_right[by_right] = np.cumsum((next_ < length - a) | (next_ < 0))
        name, place = np.unique(at_left[here] * (n + 1) + at_right[here], return_inverse=True)
        hits.append((here[np.bincount(place, copies[here], len(name))[place] > 1], a))
    who = np.concatenate([h for h, _ in hits]) if hits else np.zeros(0, np.int64)
    when = np.concatenate([np.full(len(h), a) for h, a in hits]) if hits else np.zeros(0, np.int64)
    order = np.lexsort((when, who))
    who, when = who[order], when[order]
    cut = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (when[1:] != when[:-1] + 1))) if len(who) else np.zeros(0, np.int64)
    stop = np.append(cut[1:], len(who)) - 1
    return [(int(who[i]), int(t[who[i]] - when[j]), int(t[who[i]] - when[i]) + length) for i, j in zip(cut.tolist(), stop.tolist(), strict=True)] if len(who) else []


def _sorted(phrases: DataFrame, searches: Searches) -> DataFrame:
    """rid, kind, from, end: the repeated windows of phrases, from suffix arrays within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        both = pa.Table.from_batches(parts)
        kinds_ = both.column(8).to_numpy()
        for kind, (length, words) in enumerate(searches):
            if not (kinds_ == kind).any():
                continue
            all_ = both.filter(pa.array(kinds_ == kind))
            rid, t, first, last, core, copies = (all_.column(k).to_numpy() for k in range(6))
            found = repeated_windows(t, first, last, core, copies, all_.column(6).to_pylist(), all_.column(7).to_pylist(), length, 8 if words else 1)
            for k in range(0, len(found), 100_000):
                yield _batch([(int(rid[x]), kind, p, q) for x, p, q in found[k : k + 100_000]], kinds)

    kinds = [("rid", pa.int64()), ("kind", pa.int32()), ("from", pa.int64()), ("end", pa.int64())]
    n = max(partitions(phrases.sparkSession), -(-phrases.count() // TASK))
    return phrases.repartition(n, "core").mapInArrow(run, "rid long, kind int, from long, end long")


def _cells(texts: DataFrame, searches: Searches) -> DataFrame:
    """Contexts of the cells of the listed runs; ``from`` and ``to``: their windows, ``end``: of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                out: list[tuple] = []
                for rid, data, listed in zip(*(c.to_pylist() for c in b.slice(k, 128).columns), strict=True):
                    views = Views(data, searches)
                    for x in listed:
                        r, kind = divmod(x["run"], len(searches))
                        view, first, last, ts = views[kind]
                        p, q, t, length = int(first[r]), int(last[r]), int(ts[r]), searches[kind][0]
                        for j in range((t - q) // CELL, (t - p) // CELL + 1):
                            near, far = t - CELL * j, t - CELL * j - CELL + 1
                            inner = signed(xxhash.xxh3_64_intdigest(view[near : far + length], seed=kind << 32 | t - near))
                            out.append((rid, kind, max(p, far), min(q, near), min(q, near) + length, t, inner, around(view, far, near + length, t), x["copies"]))
                yield _batch(out, kinds)

    kinds = [("rid", pa.int64()), ("kind", pa.int32()), ("from", pa.int64()), ("to", pa.int64()), ("end", pa.int64()), ("t", pa.int64()), ("core", pa.int64()), ("context", pa.binary()), ("copies", pa.int64())]
    return texts.select("rid", "data", "runs").mapInArrow(run, "rid long, kind int, from long, to long, end long, t long, core long, context binary, copies long")


def _singles(texts: DataFrame, searches: Searches) -> DataFrame:
    """rid, kind, from, end, context, copies for every window of the listed cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                out: list[tuple] = []
                for rid, data, listed in zip(*(c.to_pylist() for c in b.slice(k, 128).columns), strict=True):
                    views = [Units(data, words) for _, words in searches]
                    for x in listed:
                        kind, view, length = x["kind"], views[x["kind"]], searches[x["kind"]][0]
                        out += [(rid, kind, p, p + length, xxhash.xxh3_128_digest(view[p : p + length], seed=kind), x["copies"]) for p in range(x["from"], x["to"] + 1)]
                yield _batch(out, kinds)

    kinds = [("rid", pa.int64()), ("kind", pa.int32()), ("from", pa.int64()), ("end", pa.int64()), ("context", pa.binary()), ("copies", pa.int64())]
    return texts.select("rid", "data", "runs").mapInArrow(run, "rid long, kind int, from long, end long, context binary, copies long")


def _spans(texts: DataFrame, words: bool) -> DataFrame:
    """rid, spans: the bytes (from, end) of texts' marked intervals, in order, none touching another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                out: list[tuple] = []
                for rid, data, marks in zip(*(c.to_pylist() for c in b.slice(k, 128).columns), strict=True):
                    view = Units(data, words)
                    out.append((rid, [{"from": p, "end": q} for p, q in merged([view.place(x["from"], x["end"]) for x in marks])]))
                yield _batch(out, kinds)

    kinds = [("rid", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("end", pa.int64())])))]
    return texts.select("rid", "data", "marks").mapInArrow(run, "rid long, spans array<struct<from:long,end:long>>")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, in order."""
    out: list[tuple[int, int]] = []
    for p, q in sorted(spans):
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], max(q, out[-1][1]))
        else:
            out.append((p, q))
    return out


def _kept(texts: DataFrame) -> DataFrame:
    """rid, n_removed, n_spans, kept for texts with their marked intervals of bytes, and n_passages and
    passage_bytes for those of words, a second search's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                out: list[tuple] = []
                for rid, data, marks in zip(*(c.to_pylist() for c in b.slice(k, 128).columns), strict=True):
                    kept, at, passages = [], 0, []
                    spans = merged([(x["from"], x["end"]) for x in marks if x["kind"] == 0])
                    for p, q in spans:
                        kept.append(data[at:p])
                        at = q
                    if any(x["kind"] for x in marks):
                        view = Units(data, True)
                        passages = merged([view.place(x["from"], x["end"]) for x in marks if x["kind"]])
                    rest = b"".join([*kept, data[at:]])
                    out.append((rid, len(data) - len(rest), len(spans), rest if spans else None, len(passages), sum(q - p for p, q in passages)))
                yield _batch(out, kinds)

    kinds = [("rid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("n_passages", pa.int64()), ("passage_bytes", pa.int64())]
    return texts.select("rid", "data", "marks").mapInArrow(run, "rid long, n_removed long, n_spans long, kept binary, n_passages long, passage_bytes long")


def _named(rows: DataFrame, more: list[str]) -> DataFrame:
    """Add ``times`` (how often the context occurs) and ``lead`` (one row per context)."""
    total = rows.count()
    at = F.struct("rid", *more)
    return with_group(rows, ["kind", "context"], {"times": F.sum("copies"), "lead": F.min(at)}, total).withColumn("lead", F.col("lead") == at)


def _mixed(named: DataFrame) -> DataFrame:
    """One row for each distinct context whose core has several contexts, of which some
    occur once: what has to be split further."""
    lead = named.where("lead").withColumn("copies", F.least("times", F.lit(2)))
    aggs = {"several": F.count(F.lit(1)), "once": F.min("times")}
    return with_group(lead, ["core"], aggs, lead.count()).where("several > 1 and once = 1")


def _found(docs: DataFrame, searches: Searches, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(rows: rid, doc_id, n_bytes, sha, gone; marked: rid, data, marks; what may go once ``marked`` has
    been read).

    ``gone``: by search, whether the whole text goes, as it occurs again; ``marks``: the units [from, end)
    of each other text that go by a search (``kind``), overlapping ones too."""
    if min(length for length, _ in searches) < LEAST:
        raise ValueError(f"length must be at least {LEAST}")
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), data.alias("data"))
    parsed = materialise(_parse(docs, searches).withColumn("rid", F.monotonically_increasing_id()), "parsed")
    total = parsed.count()
    rows = with_group(parsed.select("rid", "doc_id", "n_bytes", "n_units", "sha"), ["sha"], {"copies": F.count(F.lit(1)), "rep": F.min("rid")}, total)
    rows = materialise(rows, "rows")

    runs = parsed.select("rid", F.inline("cores"))
    n_runs = parsed.agg(F.sum(F.size("cores"))).first()[0] or 0
    again = with_group(runs, ["core"], {"times": F.count(F.lit(1))}, n_runs).where("times > 1").groupBy("rid").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    nobody = F.lit(-1 << 63)
    first = rows.where("rid = rep").select("rid", "copies", "sha", F.coalesce("doc_id", nobody).alias("id"))
    keyed = docs.select("data", F.unhex(F.sha2("data", 256)).alias("sha"), F.coalesce("doc_id", nobody).alias("id"))
    texts = keyed.join(again.join(first, "rid"), ["id", "sha"]).select("rid", "copies", "data", "runs")
    if rows.groupBy("doc_id", "sha").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["rid"])  # rows that repeat id and text
    texts = materialise(texts, "texts")

    contexts = materialise(_contexts(texts, searches), "contexts")
    named = materialise(_named(contexts, ["run"]), "named")
    release(contexts)
    ends = materialise(_mixed(named), "ends")
    listed = lambda df, *columns: texts.drop("runs", "copies").join(df.groupBy("rid").agg(F.collect_list(F.struct(*columns)).alias("runs")), "rid")
    phrases = materialise(_phrases(listed(ends.where(F.col("several") <= MANY), "run", "core", "copies"), searches), "phrases")
    marks = materialise(_sorted(phrases, searches), "sorted")
    release(phrases)
    marks = [named.where("times > 1").select("rid", "kind", "from", "end"), marks]
    used = [parsed, texts, named, marks[1]]
    wide = ends.where(F.col("several") > MANY)
    if wide.limit(1).count():
        cells = materialise(_cells(listed(wide, "run", "copies"), searches), "cells")
        cells_named = materialise(_named(cells, ["kind", "from"]), "cells-named")
        singles = materialise(_singles(listed(_mixed(cells_named), "kind", "from", "to", "copies"), searches), "singles")
        release(cells)
        marks.append(cells_named.where("times > 1").select("rid", "kind", "from", "end"))
        marks.append(_named(singles, ["kind", "from"]).where("times > 1").select("rid", "kind", "from", "end"))
        used += [cells_named, singles]
    release(ends)
    marks = reduce(DataFrame.unionByName, marks)
    marks = marks.join(rows.where("copies = 1").select("rid"), "rid", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("kind", "from", "end")).alias("marks"))
    gone = F.array(*[(F.col("copies") > 1) & (F.col("n_units")[x] >= length) for x, (length, _) in enumerate(searches)])
    return rows.select("rid", "doc_id", "n_bytes", "sha", gone.alias("gone")), texts.select("rid", "data").join(marks, "rid"), used


def repeat_spans(docs: DataFrame, length: int, words: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans: the bytes (from, end) that ``remove_repeats`` removes, for rows that lose any.
    With ``words``, ``length`` counts words: what goes are words, and the white space between them,
    of passages of ``length`` whole words that also start elsewhere with the same bytes."""
    rows, marked, used = _found(docs, [(length, words)], doc_id, text)
    out = rows.join(materialise(_spans(marked, words), "spans"), "rid", "left")
    release(*used)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_bytes").alias("end")))
    return out.select("doc_id", F.when(F.col("gone")[0], whole).otherwise(F.col("spans")).alias("spans")).where("spans is not null")


def remove_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes, null if unchanged).

    Every byte covered by a ``length``-byte string that also starts elsewhere, in the
    same or another row, goes; overlapping occurrences count, matches never cross rows. Null
    texts count as empty; texts shorter than ``length`` keep all; of repeated rows each is an
    occurrence; an empty table gives an empty result; other columns are not read."""
    return _removed(docs, [(length, False)], doc_id, text).drop("n_passages", "passage_bytes")


def _removed(docs: DataFrame, searches: Searches, doc_id: str, text: str) -> DataFrame:
    rows, marked, used = _found(docs, searches, doc_id, text)
    cut = materialise(_kept(marked), "kept")
    release(*used)

    gone, again, sha, nothing = F.col("gone")[0], F.col("gone")[len(searches) - 1], F.lower(F.hex("sha")), F.lit(b"")
    out = rows.join(cut, "rid", "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(nothing, 256)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(sha).alias("kept_sha256"),
        F.when(gone, nothing).otherwise(F.col("kept")).alias("kept"),
        F.when(again, F.lit(1)).otherwise(F.coalesce("n_passages", F.lit(0))).cast("long").alias("n_passages"),
        F.when(again, F.col("n_bytes")).otherwise(F.coalesce("passage_bytes", F.lit(0))).cast("long").alias("passage_bytes"),
    )


def repeats_and_passages(docs: DataFrame, length: int = 400, passage: int = 51, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``remove_repeats``, and n_passages and passage_bytes: the maximal spans, and their
    bytes, of passages of ``passage`` whole words that also start elsewhere (these stay in the text).
    Rows that repeat an id, and rows without one, each keep their own figures. Both searches go over
    the texts together."""
    return _removed(docs, [(length, False), (passage, True)], doc_id, text)
