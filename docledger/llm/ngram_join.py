"""Self-join of documents on the Jaccard similarity of their word n-gram sets.

Universe-partition pigeonhole: in each band of set sizes, tokens (hashed n-grams) are
dealt to ``m`` segments by hash. Two similar sets differ in at most D = (|R| + |S|) *
(1 - t) / (1 + t) tokens, so if the points of the segments sum to D + 1, one segment
differs less than its points: an exact segment (1 point) is equal, a segment with its
one-deletion neighbourhood (2 points) differs by at most one token. A cost model allocates
the points within each band: it weighs the index rows against the candidates that come from
segments which say nothing, as they are empty or, with deletions, have one token. A few
tokens are best held in few segments with deletions, many tokens in exact segments,
with some more than needed: so many more agree, and a set does without its empty segments and
without as many of its most frequent ones, which get no points (a passage that many documents share
makes no large groups). Documents that share a signature are candidates, and all of them are
verified on the texts' n-grams themselves.

A signature's group is not expanded into pairs. First each document is held against one
other: of the smallest ones of its groups the one with which it shares most signatures. Only groups that
are then still in different components go on: small ones by pairs; large ones are split into
families by a byte of each segment, and of a family all documents outside its largest component are held
against the others, in rounds of bounded blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fitted, materialise, partitions, release, with_group
from .components import components, joins

RATIO, WORDS, MASK = 1.5, 300_000, (1 << 64) - 1
#: Cost of verifying a candidate, in index rows; share of the rows that are near in size.
VERIFY, NEAR = 100.0, 0.04
#: Signature groups of more than FEW documents are compared in blocks instead of by pairs: of BLOCK documents, or TOKENS tokens, and
#: before that by their marks in blocks of MARKED documents.
FEW, BLOCK, TOKENS, MARKED = 48, 256, 1 << 19, 1024
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bands:
    """Sizes from ``least`` on in bands that grow by RATIO, each with its allocation.
    ``percent`` is the threshold: links need 100 * intersection >= percent * union."""

    def __init__(self, percent: int, rows: int):
        self.percent, self.rows = percent, rows

    def differ(self, total: int) -> int:
        """The most tokens in which sets of ``total`` tokens together differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    @staticmethod
    def band(size: int) -> int:
        return int(math.log(size, RATIO) + 1e-9)

    def of(self, size: int) -> list[int]:
        """Bands in which a set meets its partners: that of each pair's larger set."""
        return list(range(self.band(size), self.band(size * 100 // self.percent) + 1))

    @lru_cache(maxsize=None)  # noqa: B019
    def allocation(self, band: int) -> tuple[int, int, int]:
        """(segments, how many of these have deletions, slack); no segments: only equal sets are similar.

        Exact segments alone: with ``slack`` more than needed, 1 + slack of them agree, so that
        empty ones need not be indexed but for sets that have more empty ones, and of the others as
        many of the most frequent ones as there are fewer. With deletions on
        ``k`` segments there are ``k`` fewer in all: each has more tokens, for a row per token."""
        low, high = math.ceil(RATIO**band - 1e-6), math.ceil(RATIO ** (band + 1) - 1e-6) - 1
        need = self.differ(2 * high) + 1
        if need == 1:
            return 0, 0, 0
        near, size, options = VERIFY * NEAR * self.rows, math.sqrt(low * high), []
        for slack in range(1 + need // 8, 4 + need // 2):
            m = need + slack
            mean = m * math.exp(-low / m)  # empty segments
            term, tail = math.exp(-mean), 1.0
            for k in range(slack + 1):
                tail, term = tail - term, term * mean / (k + 1)
            options.append((m + near * max(tail, 0) ** 2, m, 0, slack))
        for m in range((need + 1) // 2, need):
            k, c = need - m, low / m
            vain = k * ((1 + c) * math.exp(-c)) ** 2 + (m - k) * math.exp(-c) ** 2
            options.append((m + k * size / m + near * vain, m, k, 0))
        return min(options)[1:]

    def prefix(self, size: int, band: int) -> int:
        """How many of a band's segments a set of ``size`` needs: what does for the
        smaller set of a pair, and the larger one's prefix is longer."""
        most = math.ceil(RATIO ** (band + 1) - 1e-6) - 1
        need = self.differ(size + min(most, size * 100 // self.percent)) + 1
        _, k, slack = self.allocation(band)
        return (need + 1) // 2 if need < 2 * k else need - k + slack

    def may_link(self, size_a: int, size_b: int, marks_a: list[bytes], marks_b: list[bytes]) -> bool:
        """Whether enough segments agree, by one byte of each (which never hides that two agree)."""
        (small, few), (large, more) = sorted(((size_a, marks_a), (size_b, marks_b)), key=lambda x: x[0])
        band = self.band(large)
        k = band - self.band(small)
        if k >= len(few) or not few[k] or not more[0]:
            return True
        n = self.prefix(small, band)
        same = np.count_nonzero(np.frombuffer(few[k][:n], np.uint8) == np.frombuffer(more[0][:n], np.uint8))
        return same >= n - self.differ(small + large)

    def signatures(self, tokens: np.ndarray, marks: list[bytes] | None = None, drops: list[int] | None = None) -> np.ndarray:
        """What a set is indexed by; a signature's last bit is that of its band. ``marks`` gets a
        byte of each segment by band, nothing where a band has deletions; ``drops``, by the last bit
        of the band, how many of the most frequent signatures the set does without."""
        out, marks, drops = [], [] if marks is None else marks, [0, 0] if drops is None else drops
        for band in self.of(len(tokens)):
            m, deletions, slack = self.allocation(band)
            marks.append(b"")
            if not m:
                continue
            segment = ((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            order = np.argsort(segment, kind="stable")
            own, spread = segment[order].astype(np.int64), mix(tokens[order] + np.uint64(band))
            ends = np.searchsorted(own, np.arange(m + 1))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread)])
            total = sums[ends[1:]] - sums[ends[:-1]]
            salt = np.arange(m, dtype=np.uint64) * B + np.uint64((band + 1) * int(C) & MASK)
            named = lambda x: mix(x) & ~np.uint64(1) | np.uint64(band & 1)  # noqa: B023, E731
            k = self.prefix(len(tokens), band)
            full, exact = (ends[1:] > ends[:-1])[:k], named(total ^ salt)[:k]
            if deletions:
                near = own < min(k, deletions)
                out += [exact, named((total[own[near]] - spread[near]) ^ salt[own[near]])]
            else:
                marks[-1] = (exact >> np.uint64(1)).astype(np.uint8).tobytes()
                drops[band & 1] = max(0, slack - int((~full).sum()))
                out.append(exact if (~full).sum() > slack else exact[full])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words between spaces and \\x09-\\x0D, A-Z in lower case."""
    return (text or "").encode("utf-8").lower().split()


def shingles(text: str | None, n: int) -> set[bytes]:
    """The distinct n-grams; a shorter text is one n-gram; no words, none."""
    w = words_of(text)
    return {b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def similar(a: str | None, b: str | None, n: int, percent: int) -> bool:
    one, two = shingles(a, n), shingles(b, n)
    common = len(one & two)
    return 100 * common >= percent * (len(one) + len(two) - common)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def tokens_of(text: str | None, n: int, hashes: dict) -> np.ndarray:
    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    out, span = np.zeros(max(1, len(w) - n + 1), np.uint64), min(n, len(w))
    for k in range(span):
        out = mix(out * A + h[k : len(h) - span + k + 1] + np.uint64(span))
    return np.unique(out)


def _sets(docs: DataFrame, bands: Bands, n: int) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set, null if empty), signatures, marks, drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part, sizes, keys, signs, marks, drops = b.slice(k, 512), [], [], [], [], []
                for t in part.column(1).to_pylist():
                    tokens = tokens_of(t, n, hashes)
                    sizes.append(len(tokens))
                    keys.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                    marks.append([])
                    drops.append([0, 0])
                    signs.append(bands.signatures(tokens, marks[-1], drops[-1]) if len(tokens) else np.zeros(0, np.uint64))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in signs])]).astype(np.int32)
                flat = pa.array(np.concatenate(signs).view(np.int64))
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(marks, pa.list_(pa.binary())), pa.array(drops, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key", "signatures", "marks", "drops"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key binary, signatures array<long>, marks array<binary>, drops array<int>")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar, by their n-grams themselves.

    The texts that are held against ``b`` meet it in groups of about BLOCK, each with a copy of
    b's text, so that every text moves once for each of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams = None, set()
        for batch in batches:
            a, b, lead = (batch.column(k).to_pylist() for k in range(3))
            keep = []
            for k in range(batch.num_rows):
                own = shingles(batch.column(3)[k].as_py(), n)
                if lead[k]:
                    last, grams = b[k], own
                elif last != b[k]:
                    raise ValueError("a pair has come without its text")
                common = len(grams & own)
                keep.append(not lead[k] and 100 * common >= percent * (len(grams) + len(own) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    salted = with_group(pairs.select("a", "b"), ["b"], {"size": F.count(F.lit(1))}, pairs.count())
    salt = F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / BLOCK)).cast("int")
    members = salted.select(F.col("a").alias("id"), "b", salt.alias("salt"), F.lit(False).alias("lead"))
    leads = members.groupBy("b", "salt").agg(F.lit(True).alias("lead")).select(F.col("b").alias("id"), "b", "salt", "lead")
    rows = members.unionByName(leads).join(texts, "id")
    laid = rows.repartition(partitions(pairs.sparkSession), "b", "salt").sortWithinPartitions("b", "salt", F.desc("lead"))
    return laid.select("id", "b", "lead", "text").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, marks: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) of which enough segments agree: a small row stands for a text here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array([bands.may_link(*r) for r in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    one, two = (marks.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("marks").alias(f"m{x}")) for x in "ab")
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ma", "mb")
    return both.mapInArrow(run, "a long, b long")


def _joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of what is known and of new links; both frames go. Links are taken between the components
    that are known, so that what is known is only named anew."""
    if known is None:
        out = components(links)
        release(links)
        return out
    there = fitted(known)
    one, two = (there.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    between = fitted(links).join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(between)
    fresh = fitted(merged)
    names = fresh.select(F.col("node").alias("old"), F.col("component").alias("new"))
    renamed = there.join(names, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    out = materialise(renamed.unionByName(fresh.join(there, "node", "left_anti")), "known")
    release(links, known, merged)
    return out


def _mixed(shared: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``shared`` (sig, rep, n_shingles) of the signatures whose documents are in different components,
    with each row's component ``comp``, the group's ``size`` and its smallest document as ``lead``; written."""
    now = shared.select("sig", "rep", "n_shingles")
    comp = F.col("rep")
    if known is not None:
        now, comp = now.join(known, now["rep"] == known["node"], "left"), F.coalesce("component", "rep")
    now = now.select("sig", "rep", "n_shingles", comp.alias("comp"))
    at = F.struct("rep", "n_shingles", "comp")
    aggs = {"c1": F.min("comp"), "c2": F.max("comp"), "lead": F.min(at), "size": F.count(F.lit(1))}
    return materialise(with_group(now, ["sig"], aggs, shared.count()).where("c1 < c2").drop("c1", "c2"), "mixed")


def _fits(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _star(mixed: DataFrame, marks: DataFrame, bands: Bands) -> DataFrame:
    """One pair (a, b) for each document of ``mixed`` that may link with a lead of its groups: with the
    one that it shares most signatures with."""
    away = mixed.where((F.col("comp") != F.col("lead.comp")) & _fits("n_shingles", "lead.n_shingles", bands.percent))
    times = materialise(away.groupBy(F.col("rep").alias("a"), F.col("lead.rep").alias("b")).agg(F.count(F.lit(1)).alias("times")), "times")
    likely = _likely(times, marks, bands).join(times, ["a", "b"])
    best = likely.groupBy("a").agg(F.max(F.struct("times", (-F.col("b")).alias("b"))).alias("best"))
    out = materialise(best.select("a", (-F.col("best.b")).alias("b")), "pairs")
    release(times)
    return out


def _families(left: DataFrame, marks: DataFrame, bands: Bands) -> DataFrame:
    """Documents that share signatures with many others, in families (id, n_shingles, cluster), written.

    Documents that share such signatures, directly or through others, are held against each other in
    groups of two blocks by their marks alone, a few dozen bytes each. Those of different components of
    which enough segments agree are of one family; most documents of a common passage are of none."""

    def meet(key, pdf):
        ids, own, size, comp = (pdf[c].to_numpy() for c in ("id", "own", "n_shingles", "comp"))
        band = np.array([bands.band(n) for n in size])
        root: dict = {}
        edges = []
        for upper in np.unique(band).tolist():
            # pairs whose larger set is in this band: the mark of a set one band below is its second
            level = upper - band
            there = [m[k] if 0 <= k < len(m) else None for m, k in zip(pdf["marks"], level.tolist(), strict=True)]
            width = max((len(t) for t in there if t), default=0)
            has = np.array([t is not None for t in there])
            byte, bare = np.zeros((len(ids), width), np.uint8), np.array([not t for t in there])
            for k, t in enumerate(there):
                if t:
                    byte[k, : len(t)] = np.frombuffer(t, np.uint8)
            need = np.array([bands.prefix(n, upper) if h and not e else 0 for n, h, e in zip(size.tolist(), has, bare, strict=True)])
            for x in np.flatnonzero(has & (own == key[1])).tolist():
                y = np.flatnonzero(has & (own == key[2]) & ((level == 0) | (level[x] == 0)) & (comp != comp[x]))
                y = y[100 * np.minimum(size[y], size[x]) >= bands.percent * np.maximum(size[y], size[x])]
                y = y[y > x] if key[1] == key[2] else y
                if not len(y):
                    continue
                # agreements count on the smaller set's prefix
                n = np.where(size[y] < size[x], need[y], need[x])
                same = (byte[y] == byte[x]) & (np.arange(width) < n[:, None])
                most = (size[y] + size[x]) * (100 - bands.percent) // (100 + bands.percent)
                there_ = ids[y[(same.sum(1) >= n - most) | bare[y] | bare[x]]].tolist()
                fresh = joins(root, [int(ids[x])] * len(there_), there_)
                edges += [(ids[x], i) for i, ok in zip(there_, fresh, strict=True) if ok]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    cluster = components(left.where("rep <> lead.rep").select(F.col("rep").alias("a"), F.col("lead.rep").alias("b")))
    sizes = cluster.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / MARKED).cast("int").alias("blocks"))
    all_ = cluster.join(sizes, "component").select("component", F.col("node").alias("id"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    dealt = all_.select("component", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    comps = left.select(F.col("rep").alias("id"), "comp").distinct()
    rows = dealt.select("component", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "id", "own").join(marks.join(comps, "id"), "id")
    edges = materialise(rows.groupBy("component", "i", "j").applyInPandas(meet, "a long, b long"), "alike")
    family = components(edges)
    release(edges)
    out = materialise(marks.select("id", "n_shingles").join(family.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id"), "families")
    release(cluster, family)
    return out


def _blocks(families: DataFrame, texts: DataFrame, known: DataFrame, n: int, percent: int) -> DataFrame:
    """``known`` and the links within families.

    In each round a block of a family's documents outside its largest component is held against all
    others, in bounded blocks too, where the sizes of all intersections come from products of token
    matrices; of the links found those that join components are kept. A round moves each text about
    twice."""
    sized = materialise(families.join(texts, "id"), "sized")
    total = families.count()
    few = lambda df: fitted(df, total)
    written: DataFrame | None = None
    while True:
        there = fitted(known).select(F.col("node").alias("id"), "component")
        now = few(families).join(there, "id", "left").select("id", "cluster", "n_shingles", F.coalesce("component", "id").alias("comp"))
        each = now.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("tokens"))
        main = each.groupBy("cluster").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("all"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        state = materialise(with_cluster(now, main), "now")
        now = few(state)
        rest = now.where(F.col("comp") != F.col("main.comp"))
        rest = rest.join(few(written), "id", "left_anti") if written is not None else rest
        waiting = rest.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / TOKENS)).alias("turns"))
        turn = F.pmod(F.xxhash64("id", F.lit(7)), "turns")
        some = with_cluster(rest.select("id", "cluster", "comp"), waiting).withColumn("turn", turn)
        # the first of the turns that is not empty
        first = some.groupBy("cluster").agg(F.min("turn").alias("first"))
        leads = materialise(with_cluster(some, first).where("turn = first").select("id", "cluster", "comp"), "leads")
        if not leads.limit(1).count():
            release(state, leads, sized, *([] if written is None else [written]))
            return known
        chunks = F.ceil(F.greatest(F.col("all") / BLOCK, F.col("tokens") / TOKENS)).cast("int")
        active = few(leads).groupBy("cluster").agg(F.count(F.lit(1)).alias("_n")).select("cluster")
        members = with_cluster(now, active).select("id", "cluster", "comp", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"), F.lit(False).alias("lead"))
        dealt = members.select("cluster", "chunk").distinct()
        copies = dealt.join(few(leads), "cluster").select("id", "cluster", "comp", "chunk", F.lit(True).alias("lead"))
        rows = members.unionByName(copies).join(sized.select("id", "text"), "id")
        links = materialise(rows.groupBy("cluster", "chunk").applyInPandas(_meeting(n, percent), "a long, b long"), "links")
        heard = few(leads).select("id")
        before, written = written, materialise(heard if written is None else heard.unionByName(few(written)), "done")
        release(state, leads, *([] if before is None else [before]))
        known = _joined(known, links)


def with_cluster(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows of listed clusters with what is known of these. A cluster may hold a third of all rows, but there
    is one row for each at most on the other side, so that AQE can split it."""
    return rows.join(clusters, "cluster")


def _meeting(n: int, percent: int):
    def meet(key, pdf):
        pdf = pdf.sort_values("id", kind="stable")
        hashes = _Hashes()
        grams = [tokens_of(t, n, hashes) for t in pdf["text"]]
        ids, comp, lead, text = pdf["id"].to_numpy(), pdf["comp"].to_numpy(), pdf["lead"].to_numpy(bool), pdf["text"].to_list()
        one, two = np.flatnonzero(lead), np.flatnonzero(~lead)
        size, ends = np.array([len(g) for g in grams], np.float32), np.cumsum([len(g) for g in grams])
        tokens, place, seen = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        index = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[place]  # tokens of several documents
        listed = np.split(index, ends[:-1])
        common = np.zeros((len(one), len(two)), np.float32)
        for at in range(0, int((seen > 1).sum()), 2048):
            dense = np.zeros((len(grams), 2048), np.float32)
            for k, x in enumerate(listed):
                dense[k, x[(x >= at) & (x < at + 2048)] - at] = 1
            common += dense[one] @ dense[two].T
        union = size[one][:, None] + size[two][None] - common
        hit = (100 * common >= percent * union) & (comp[one][:, None] != comp[two][None])
        root: dict = {}
        out = []
        for x, y in zip(*np.nonzero(hit), strict=True):
            p, q = int(comp[one[x]]), int(comp[two[y]])
            if _apart(root, p, q) and similar(text[one[x]], text[two[y]], n, percent):
                joins(root, [p], [q])
                out.append((ids[one[x]], ids[two[y]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return meet


def _apart(root: dict, p: int, q: int) -> bool:
    while root.get(p, p) != p:
        p = root[p]
    while root.get(q, q) != q:
        q = root[q]
    return p != q


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Texts with fewer than n words are one n-gram; null, empty and blank texts have none,
    are linked with nothing and are their own component. Equal sets are linked. Rows that
    repeat a doc_id are taken as one document if their sets are equal. An empty table gives
    an empty result; other columns are not read. Documents with a null doc_id keep a row
    with a null component."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = docs.count()
    bands = Bands(percent, total)
    sets = materialise(_sets(docs, bands, n), "sets")
    columns = sets.select("doc_id", "n_shingles", "key", "drops")
    rows = with_group(columns.where("n_shingles > 0"), ["key"], {"rep": F.min("doc_id")}, total)
    rows = rows.unionByName(columns.where("n_shingles = 0").withColumn("rep", F.col("doc_id")))
    rows = materialise(rows.drop("key"), "reps")

    entries = sets.where("doc_id is not null").select(F.explode("signatures").alias("sig"), F.col("doc_id").alias("id"))
    count = sets.agg(F.sum(F.size("signatures"))).first()[0] or 0
    several = with_group(entries, ["sig"], {"low": F.min("id"), "high": F.max("id"), "times": F.count(F.lit(1))}, count).where("low < high").select("sig", "id", "times")
    reps = rows.where("n_shingles > 0 and doc_id = rep").select(F.col("doc_id").alias("id"), "rep", "n_shingles", "drops").distinct()
    each = several.join(reps, "id").select("sig", "times", "rep", "n_shingles", "drops").distinct()
    odd = F.col("sig").bitwiseAND(F.lit(1))
    rank = F.row_number().over(Window.partitionBy("rep", odd).orderBy(F.desc("times"), "sig"))  # as long as a document
    kept = each.withColumn("rank", rank).where(F.col("rank") > F.element_at("drops", (odd + 1).cast("int")))
    shared = materialise(kept.select("sig", "rep", "n_shingles"), "shared")
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()  # equal sets, or else any of them
    once = (lambda df: df.dropDuplicates(["id"])) if repeated else (lambda df: df)
    need = materialise(shared.select(F.col("rep").alias("id")).distinct(), "need")
    marks = materialise(once(sets.select(F.col("doc_id").alias("id"), "n_shingles", "marks").join(need, "id", "left_semi")), "marks")
    release(sets)
    texts = materialise(once(docs.withColumnRenamed("doc_id", "id").join(need, "id", "left_semi")), "texts")
    release(need)

    mixed = _mixed(shared)
    release(shared)
    pairs = _star(mixed, marks, bands)
    links = materialise(_verified(pairs, texts, n, percent), "links")
    release(pairs)
    known = _joined(None, links)
    left = _mixed(mixed, known)
    release(mixed)

    few = left.where(F.col("size") <= FEW)
    other = few.select("sig", F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n_shingles").alias("nb"))
    more = few.join(other, "sig").where((F.col("rep") > F.col("b")) & (F.col("comp") != F.col("cb")) & _fits("n_shingles", "nb", percent))
    more = materialise(more.select(F.col("rep").alias("a"), "b").distinct(), "pairs")
    likely = materialise(_likely(more, marks, bands), "likely")
    release(more)
    links = materialise(_verified(likely, texts, n, percent), "links")
    release(likely)
    known = _joined(known, links)
    many = left.where(F.col("size") > FEW)
    if many.limit(1).count():
        hot = _mixed(many, known)
        families = _families(hot, marks, bands)
        known = _blocks(families, texts, known, n, percent)
        release(hot, families)
    release(left, texts, marks)
    out = rows.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = materialise(out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")), "components")
    release(rows, known)
    return out
