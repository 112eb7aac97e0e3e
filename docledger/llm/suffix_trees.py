"""Removal of passages of words that repeat, by prefix-partitioned suffix trees.

A text is its words; a window is ``length`` consecutive words, a suffix of the text starts at each. Suffixes
travel in bundles: for each window the trigger is the position of the smallest hash among its first
``span_of(length)`` words, equal windows have it at the same place, and all windows of one trigger share
the words from it on that no window of the bundle lacks. These words are the bundle's prefix: suffixes
that could be equal are always in one group, the bundles of one prefix.

1. A prefix that occurs once has no repeated window below it. (Counted by Spark.)
2. A bundle all of whose words occur again as such a bundle is repeated as a whole, and counts as one from
   here on, however many copies it has.
3. The groups that remain, at the ends of repeated passages, go to tasks that each hold whole groups. A task
   builds the suffix trees of its groups downwards, word by word: the suffixes at a node part by their next
   word, and a suffix that is left alone ends as a leaf. Internal nodes as deep as a window are the repeats;
   repeated windows in a row are a maximal one.
4. A prefix that more than MANY bundles share does not fit a task. It is extended: the bundles are split in
   halves, whose windows share more words, and go through 1 to 4 again, down to single windows, whose
   prefix is all of the window and which are only counted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, release, with_group
from .repeats import merged, signed, span_of

#: Words of the shortest window, so that what is shared has the 16 bytes that are hashed.
LEAST = 24
#: Distinct bundles of one prefix that a task may hold; bundles that a task should hold.
MANY, TASK = 5_000, 20_000
F1, F2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


class Words:
    """A text with one space between its words, and where its words start and end."""

    def __init__(self, data: bytes):
        self.data = data
        space = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        self.starts = np.append(0, space + 1) if data else space
        self.ends = np.append(space, len(data)) if data else space

    def __len__(self) -> int:
        return len(self.starts)

    def part(self, a: int, b: int) -> bytes:
        """The words [a, b)."""
        return self.data[self.starts[a] : self.ends[b - 1]]

    def bundles(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, last window and trigger of each run of windows with one trigger."""
        windows, span = len(self) - length + 1, span_of(length)
        if windows <= 0:
            return (np.zeros(0, np.int64),) * 3
        count = windows + span - 1
        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        at = self.starts[:count]
        mixed = (eight[at] * F1 ^ eight[at + 8]) * F2
        low = (mixed & HIGH) | np.arange(count, dtype=np.uint64)
        step = 1
        while step < span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        trigger = (low & LOW).astype(np.int64)
        first = np.append(0, np.flatnonzero(trigger[1:] != trigger[:-1]) + 1)
        return first, np.append(first[1:] - 1, windows - 1), trigger[first]


def normal(text: bytes) -> bytes:
    return b" ".join(text.split())  # ASCII white space only


def _parsed(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, n_words, sha, text (normal), prefixes: the digests of the bundles' prefixes, in order."""
    shared = length - span_of(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, n, sha, texts, prefixes = b.slice(k, 256), [], [], [], []
                for data in part.column(1).to_pylist():
                    words = Words(normal(data))
                    t = words.bundles(length)[2]
                    slices = zip(words.starts[t].tolist(), words.ends[t + shared - 1].tolist(), strict=True)
                    n.append(len(words)), sha.append(hashlib.sha256(words.data).digest()), texts.append(words.data)
                    prefixes.append([signed(xxhash.xxh3_64_intdigest(words.data[p:q])) for p, q in slices])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(texts, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n_words", "sha", "text", "prefixes"])

    return docs.mapInArrow(run, "doc_id long, n_words long, sha binary, text binary, prefixes array<long>")


def _rows(df: DataFrame, make, schema: pa.Schema, kinds: str) -> DataFrame:
    """``make`` turns the values of a row of ``df`` into tuples of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                out = [x for row in zip(*(c.to_pylist() for c in b.slice(k, 128).columns), strict=True) for x in make(*row)]
                columns = zip(*out, strict=True) if out else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, kinds)


def _schema(**kinds: str) -> tuple[pa.Schema, str]:
    arrow = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(k, arrow[v]) for k, v in kinds.items()]), ", ".join(f"`{k}` {v}" for k, v in kinds.items())


def _bundles(length: int, rid: int, copies: int, text: bytes, listed: list[int]) -> Iterator[tuple]:
    """rid, from, to (windows), t, prefix, context, copies of the listed bundles of a text."""
    words = Words(text)
    first, last, t = words.bundles(length)
    yield from _cells(length, span_of(length), rid, copies, words, [(int(first[r]), int(last[r]), int(t[r])) for r in listed])


def _halves(length: int, width: int, rid: int, text: bytes, listed: list[dict]) -> Iterator[tuple]:
    """The same for the listed bundles, split into ones of ``width`` windows at most."""
    words = Words(text)
    for x in listed:
        yield from _cells(length, width, rid, x["copies"], words, [(x["from"], x["to"], x["t"])])


def _cells(length: int, width: int, rid: int, copies: int, words: Words, bundles: list[tuple[int, int, int]]) -> Iterator[tuple]:
    for first, last, t in bundles:
        for j in range((t - last) // width, (t - first) // width + 1):
            near = t - j * width  # the last window of the cell, if it is whole
            low, high = max(first, near - width + 1), min(last, near)
            prefix = signed(xxhash.xxh3_64_intdigest(words.part(near, near + length - width + 1), seed=j))
            yield rid, low, high, t, prefix, hashlib.blake2b(words.part(low, high + length), digest_size=16).digest(), copies


def _phrase(length: int, rid: int, text: bytes, listed: list[dict]) -> Iterator[tuple]:
    """rid, from, to, t, prefix, copies and the words of the listed bundles."""
    words = Words(text)
    for x in listed:
        yield rid, x["from"], x["to"], x["t"], x["prefix"], x["copies"], words.part(x["from"], x["to"] + length)


def deep_nodes(group: np.ndarray, start: np.ndarray, weight: np.ndarray, words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, node): the suffixes below the internal nodes at ``depth`` of the suffix trees of all groups.

    The suffix k starts at ``start[k]`` of ``words``, where ``depth`` words follow, and stands for ``weight[k]``
    equal ones. Trees grow downwards: at each depth the suffixes of a node part by their next word."""
    alive, node, kinds = np.arange(len(start)), group, int(words.max(initial=0)) + 1
    for d in range(depth):
        child, node = np.unique(node * kinds + words[start[alive] + d], return_inverse=True)
        leaves = np.bincount(node, weight[alive], len(child))
        inner = leaves[node] > 1
        alive, node = alive[inner], node[inner]
    return alive, node


def repeated_windows(prefix: np.ndarray, first: np.ndarray, last: np.ndarray, t: np.ndarray, copies: np.ndarray, texts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(bundle, from, end): the windows of bundles, which have all those of their prefixes beside them, that occur
    more than once, as intervals of words. The bundles are distinct; ``copies`` says how often each occurs."""
    split = [x.split(b" ") for x in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    words = pd.factorize(np.array([w for x in split for w in x], object))[0].astype(np.int64)
    windows = last - first + 1
    bundle = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(bundle)) - np.repeat(np.cumsum(windows) - windows, windows)
    before = t[bundle] - first[bundle] - place  # words of the window before its trigger: equal windows agree in it
    group = pd.factorize(prefix)[0].astype(np.int64)[bundle] * (int(before.max(initial=0)) + 1) + before
    start = np.repeat(np.cumsum(sizes) - sizes, windows) + place
    found = np.sort(deep_nodes(group, start, copies[bundle].astype(float), words, length)[0])
    cut = np.flatnonzero(np.append(True, (np.diff(found) != 1) | (np.diff(bundle[found]) != 0))) if len(found) else found
    stop = np.append(cut[1:], len(found)) - 1 if len(found) else cut
    return [(int(bundle[found[i]]), int(first[bundle[found[i]]] + place[found[i]]), int(first[bundle[found[j]]] + place[found[j]]) + length) for i, j in zip(cut.tolist(), stop.tolist(), strict=True)]


def _trees(phrases: DataFrame, length: int) -> DataFrame:
    """rid, from, end: the repeated windows of bundles, from suffix trees within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            all_ = pa.Table.from_batches(parts)
            rid, first, last, t, prefix, copies = (all_.column(k).to_numpy() for k in range(6))
            found = repeated_windows(prefix, first, last, t, copies, all_.column(6).to_pylist(), length)
            for k in range(0, len(found), 100_000):
                who, p, q = zip(*found[k : k + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(rid[list(who)]), pa.array(p, pa.int64()), pa.array(q, pa.int64())], ["rid", "from", "end"])

    tasks = max(partitions(phrases.sparkSession), -(-phrases.count() // TASK))
    return phrases.repartition(tasks, "prefix").mapInArrow(run, "rid long, `from` long, `end` long")


def _named(cells: DataFrame) -> DataFrame:
    """Add ``times`` (how often a context occurs) and ``lead`` (one row of each context)."""
    at = F.struct("rid", "from")
    return with_group(cells, ["context"], {"times": F.sum("copies"), "lead": F.min(at)}, cells.count()).withColumn("lead", F.col("lead") == at)


def _mixed(named: DataFrame) -> DataFrame:
    """One row of each context whose prefix has several contexts, of which some occur once."""
    lead = named.where("lead").withColumn("copies", F.least("times", F.lit(2))).select("rid", "from", "to", "t", "prefix", "copies")
    return with_group(lead, ["prefix"], {"several": F.count(F.lit(1)), "once": F.min("copies")}, lead.count()).where("several > 1 and once = 1")


def _marks(texts: DataFrame, again: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rid, from, end of what is repeated; what may go once that has been read). ``texts``: rid, text, copies;
    ``again``: rid, bundles whose prefixes occur more than once."""
    cell, phrase = _schema(rid="long", **{"from": "long"}, to="long", t="long", prefix="long", context="binary", copies="long"), _schema(rid="long", **{"from": "long"}, to="long", t="long", prefix="long", copies="long", words="binary")
    cells = _rows(texts.join(again, "rid").select("rid", "copies", "text", "bundles"), partial(_bundles, length), *cell)
    marks, used, width = [], [], span_of(length)
    listed = lambda df, *columns: texts.select("rid", "text").join(df.groupBy("rid").agg(F.collect_list(F.struct(*columns)).alias("listed")), "rid")
    while True:
        cells = materialise(cells, "cells")
        named = materialise(_named(cells), "named")
        release(cells)
        marks.append(named.where("times > 1").select("rid", "from", (F.col("to") + length).alias("end")))
        used.append(named)
        if width == 1:
            break
        ends = materialise(_mixed(named), "ends")
        phrases = materialise(_rows(listed(ends.where(F.col("several") <= MANY), "from", "to", "t", "prefix", "copies"), partial(_phrase, length), *phrase), "phrases")
        marks.append(materialise(_trees(phrases, length), "trees"))
        release(phrases)
        used += [ends, marks[-1]]
        wide = ends.where(F.col("several") > MANY)
        if not wide.limit(1).count():
            break
        width //= 2
        cells = _rows(listed(wide, "from", "to", "t", "copies"), partial(_halves, length, width), *cell)
    return reduce(DataFrame.unionByName, marks), used


def _found(docs: DataFrame, length: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(rows: rid, doc_id, n_words, sha, gone; marked: rid, text, marks, the words [from, end) that go; what may go
    once both have been read). ``gone``: the whole text goes, as it occurs again."""
    if length < LEAST:
        raise ValueError(f"length must be at least {LEAST}")
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), data.alias("data"))
    parsed = materialise(_parsed(docs, length).withColumn("rid", F.monotonically_increasing_id()), "parsed")
    rows = with_group(parsed.select("rid", "doc_id", "n_words", "sha"), ["sha"], {"copies": F.count(F.lit(1)), "rep": F.min("rid")}, parsed.count())
    rows = materialise(rows, "rows")
    bundles = parsed.select("rid", F.posexplode("prefixes").alias("bundle", "prefix"))
    n = parsed.agg(F.sum(F.size("prefixes"))).first()[0] or 0
    again = with_group(bundles, ["prefix"], {"times": F.count(F.lit(1))}, n).where("times > 1").groupBy("rid").agg(F.sort_array(F.collect_list("bundle")).alias("bundles"))
    first = rows.where("rid = rep").select("rid", "copies")
    texts = materialise(parsed.select("rid", "text").join(first.join(again, "rid"), "rid"), "texts")
    marks, used = _marks(texts.drop("bundles"), texts.select("rid", "bundles"), length)
    marks = marks.join(rows.where("copies = 1").select("rid"), "rid", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("from", "end")).alias("marks"))
    gone = (F.col("copies") > 1) & (F.col("n_words") >= length)
    return rows.select("rid", "doc_id", "n_words", "sha", gone.alias("gone")), texts.select("rid", "text").join(marks, "rid"), [parsed, texts, *used]


def _cut(rid: int, text: bytes, marks: list[dict]) -> Iterator[tuple]:
    """rid, n_removed, n_spans and the kept words."""
    words, spans = Words(text), merged([(x["from"], x["end"]) for x in marks])
    at, kept = 0, []
    for p, q in [*spans, (len(words), len(words))]:
        if p > at:
            kept.append(words.part(at, p))
        at = q
    yield rid, sum(q - p for p, q in spans), len(spans), b" ".join(kept)


def remove_repeated_passages(docs: DataFrame, length: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256, kept (words, null if none went).

    Words are what ASCII white space separates. Every word covered by a window of ``length`` words whose sequence
    also starts elsewhere, in the same or another row, goes; overlapping windows count, windows never cross rows;
    kept words are joined by one space. Null texts count as empty; texts of fewer words keep all; of repeated rows
    each is an occurrence, and null or repeated ids each keep their row; an empty table gives an empty result; other
    columns are not read. Equal phrases and texts are told by digests of 128 and 256 bits."""
    rows, marked, used = _found(docs, length, doc_id, text)
    cut = materialise(_rows(marked, _cut, *_schema(rid="long", n_removed="long", n_spans="long", kept="binary")), "kept")
    release(*used)
    gone, nothing = F.col("gone"), F.lit(b"")
    return rows.join(cut, "rid", "left").select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(nothing, 256)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
        F.when(gone, nothing).otherwise(F.col("kept")).alias("kept"),
    )
