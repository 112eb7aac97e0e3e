"""Language identification: averaged hashed subword embeddings with a linear softmax.

Words give character n-grams with word ends and the word itself, hashed to buckets. A
text's vector is the mean of its buckets' embeddings; a softmax layer on it is trained
together with the embeddings by stochastic gradient descent in numpy, on a bounded
sample (``sample_rows``) of labelled rows. A temperature calibrates the scores on documents
left out of the descent; what is ``accepted`` has a calibrated score from which on PRECISION
of these are right, and that all but ODD of the right ones reach. Scoring runs on the executors over
whole texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)  # characters of a subword of a word between < and >
PRECISION, ODD = 0.98, 0.01
BATCH_BYTES = 1 << 23


class Words:
    """The words (runs of letters, in lower case) of a column of texts: ``codes`` into the distinct
    words, with ``ends`` of each text's; ``buckets`` of the distinct words' subwords, with ``starts``."""

    def __init__(self, texts: pa.Array):
        spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\P{L}+", " ")
        cut = pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
        column = cut.values.dictionary_encode()
        self.codes = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = cut.offsets.to_numpy().astype(np.int64)
        marked = pc.binary_join_element_wise("<", column.dictionary, ">", "")
        empty = pc.equal(column.dictionary, "").to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(pc.utf8_length(marked).to_numpy(zero_copy_only=False), dtype=np.int64)])
        data = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(marked)), np.diff(offsets))
        left = offsets[owner + 1] - np.arange(len(owner))  # characters from here to the end of the word
        rolling, found, words = np.zeros(len(owner), np.uint64), [], []
        for n in GRAMS:
            fits = np.flatnonzero((left >= n) & ~empty[owner])
            rolling = rolling[fits] * np.uint64(0x100000001B3) + data[fits + n - 1] + np.uint64(n) if n > 1 else data[fits] + np.uint64(1)
            mixed = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
            words.append(owner[fits])
            whole = np.zeros(len(owner), np.uint64)
            whole[fits] = rolling
            rolling = whole
        place = (np.arange(len(owner)) - offsets[owner]).astype(np.uint64)
        each = (data + np.uint64(1) + (place << np.uint64(21))) * np.uint64(0xC2B2AE3D27D4EB4F)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each ^ (each >> np.uint64(31)))])
        some = np.flatnonzero(~empty)
        total = (sums[offsets[some + 1]] - sums[offsets[some]]) * np.uint64(0x9E3779B97F4A7C15)
        found.append((total >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))  # the word itself
        words.append(some)
        words, found = np.concatenate(words), np.concatenate(found)
        order = np.argsort(words, kind="stable")
        self.buckets = found[order]
        self.starts = np.searchsorted(words[order], np.arange(len(marked) + 1))

    def bag(self, codes: np.ndarray) -> np.ndarray:
        """Buckets of all subwords of some words."""
        counts = np.diff(self.starts)[codes]
        at = np.repeat(self.starts[codes] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return self.buckets[at]

    def totals(self, table: np.ndarray) -> np.ndarray:
        """For each text the sum of its subwords' rows of ``table``, and their number last."""
        text, last = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends)), len(self.ends) - 1
        out = []
        for column in [*table.T, None]:
            if column is None:
                words = np.diff(self.starts).astype(float)
            else:
                sums = np.concatenate([[0.0], np.cumsum(column[self.buckets])])
                words = sums[self.starts[1:]] - sums[self.starts[:-1]]
            out.append(np.bincount(text, words[self.codes], last))
        return np.stack(out, 1)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # logits of each bucket
    bias: np.ndarray
    temperature: float
    accept: float

    def scores(self, total: np.ndarray, n: float) -> np.ndarray:
        z = (total / n + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def train(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 5, rate: float = 0.5, seed: int = 1) -> LanguageModel | None:
    """None if there is nothing to learn from."""
    langs = sorted(set(labels))
    rng, bags = np.random.default_rng(seed), []
    words = Words(pa.array(texts, pa.string()))
    for k, label in enumerate(labels):
        codes = words.codes[words.ends[k] : words.ends[k + 1]]
        starts = rng.integers(0, max(1, len(codes)), 2).tolist()
        spans = [codes, *(codes[a : a + int(n)] for a, n in zip(starts, rng.integers(3, 40, 2), strict=True))]
        for span in spans:
            ids = words.bag(span)
            if len(ids):
                bags.append((*np.unique(ids, return_counts=True), langs.index(label), k))
    if not bags:
        return None
    # every sixth document, with all its spans, is left out of the descent
    held, fit = [b for b in bags if b[3] % 6 == 0] or bags, [b for b in bags if b[3] % 6] or bags
    e, w, bias = rng.normal(0, 0.1, (BUCKETS, dim)), np.zeros((dim, len(langs))), np.zeros(len(langs))
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            ids, n, y, _ = fit[k]
            lr, share = rate * (1 - step / steps), (n / n.sum())[:, None]
            h = (e[ids] * share).sum(0)
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = w @ p
            w -= lr * np.outer(h, p)
            bias -= lr * 0.1 * p
            e[ids] -= lr * 20 * share * g
            step += 1
    table = e @ w
    z = np.array([(table[i] * (n / n.sum())[:, None]).sum(0) + bias for i, n, _, _ in held])
    y = np.array([b[2] for b in held])

    def soft(t: float) -> np.ndarray:
        q = np.exp(z / t - (z / t).max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)

    best = min(np.geomspace(0.1, 10, 41), key=lambda t: -np.log(soft(t)[np.arange(len(y)), y] + 1e-12).mean())
    p = soft(best)
    top, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= PRECISION
    accept = max(float(top[order][np.flatnonzero(good)[-1]]), float(np.quantile(top[right], ODD))) if good.any() else 1.0
    return LanguageModel(langs, table, bias, float(best), accept)


def fit(docs: DataFrame, learn: Column, sample_rows: int = 3000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Train on about ``sample_rows`` rows, chosen by a hash of ``doc_id``, of those that
    ``learn`` allows and whose text and label are not null."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    some = sample(rows.select(F.col(doc_id).alias("_id"), F.col(text).alias("t"), F.col(lang).alias("y")), "_id", sample_rows).collect()
    some.sort(key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["t"]))
    return train([r["t"] for r in some], [r["y"] for r in some])


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(offset, length) of slices with about BATCH_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // BATCH_BYTES
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
    yield from ((a, b - a) for a, b in zip(at[:-1], at[1:], strict=True) if b > a)


def predict(docs: DataFrame, model: LanguageModel | None, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row.

    A text that is null or has no letter, or any text if there is no model, gives
    ``und`` with score 0 and is not accepted. Repeated rows are scored each; ties of
    the score go to the first language by name; other columns are not read."""
    langs = model.langs if model else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(2)):
                part = b.slice(at, n)
                pred, score, ok = ["und"] * n, [0.0] * n, [False] * n
                totals = Words(part.column(2)).totals(model.table) if model else np.zeros((n, 1))
                for k in np.flatnonzero(totals[:, -1] > 0).tolist():
                    p = model.scores(totals[k, :-1], totals[k, -1])
                    best = int(p.argmax())
                    pred[k], score[k], ok[k] = langs[best], float(p[best]), bool(p[best] >= model.accept)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
