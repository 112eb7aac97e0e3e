"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their prefixes of four and five letters, hashed to buckets. The
buckets that go with the label, alone or as pairs (G-tests on a bounded sample of labelled rows,
``sample_rows``), are the machine's features: a pair's terms may each be as frequent in clean texts. It learns a weight for each and a factor
vector whose dot products are the weights of pairs, so that, say, an insult next to the
mention of a group counts for more than both alone. Training is stochastic gradient
descent in numpy, in one task over the sample's buckets; scoring runs on the executors over whole texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample

LETTERS = regex.compile(r"\p{L}+")
BUCKETS = 1 << 20
CACHE = 150_000
#: Terms whose pairs are tested: the most frequent ones of toxic texts; pairs that are taken, and their least G.
PAIRED, PAIRS, PAIR_G = 1024, 256, 60.0


def terms(chunk: str) -> list[int]:
    out = []
    for word in LETTERS.findall(chunk.lower()):
        grams = {f"{word}>", *(word[:n] for n in (4, 5) if len(word) >= n)}
        out += [zlib.crc32(g.encode()) % BUCKETS for g in grams]
    return out


@dataclass
class ToxicityModel:
    index: dict[int, int]  # bucket -> feature
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def score(self, features: list[int]) -> float:
        v = self.factors[features]
        s = v.sum(0)
        z = self.bias + self.weight[features].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sets(texts: list[str]) -> list[np.ndarray]:
    known: dict[str, list[int]] = {}
    return [np.array(sorted({b for c in set(t.split()) for b in (known.get(c) or known.setdefault(c, terms(c)))}), np.int64) for t in texts]


def paired(bags: list[np.ndarray], y: np.ndarray, count: list[np.ndarray]) -> set[int]:
    """Terms of the pairs that go with the label much more than their terms do: at least four times as
    frequent among toxic texts as among others, and twice as much so as either term."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    terms_ = np.argsort(-count[1], kind="stable")[:PAIRED]
    terms_ = np.sort(terms_[count[1][terms_] >= 3])
    if len(terms_) < 2:
        return set()
    both = []
    for side in (0, 1):
        rows = [b for b, k in zip(bags, y, strict=True) if k == side]
        total = np.zeros((len(terms_), len(terms_)), np.float32)
        for at in range(0, len(rows), 2048):
            has = np.zeros((min(2048, len(rows) - at), len(terms_)), np.float32)
            for i, b in enumerate(rows[at : at + 2048]):
                spot = np.searchsorted(terms_, b)
                ok = (spot < len(terms_)) & (terms_[np.minimum(spot, len(terms_) - 1)] == b)
                has[i, spot[ok]] = 1
            total += has.T @ has
        both.append(total.astype(np.float64))
    with np.errstate(divide="ignore", invalid="ignore"):
        share1, share0 = both[1] / n1, both[0] / n0
        alone = (count[1][terms_] / n1) / np.maximum(count[0][terms_] / n0, 0.5 / n0)
        ratio = share1 / np.maximum(share0, 0.5 / n0)
        k = both[0] + both[1]
        g = np.zeros_like(k)
        for c, n in ((both[0], n0), (both[1], n1)):
            for o, mean in ((c, k * n / len(y)), (n - c, (len(y) - k) * n / len(y))):
                g += np.where(o > 0, 2 * o * np.log(o / mean), 0)
    g[(ratio < 4) | (ratio < 2 * np.maximum(alone[:, None], alone[None])) | (both[1] < 5)] = 0
    upper = np.triu(g, 1).ravel()
    best = np.argsort(-upper, kind="stable")[:PAIRS]
    best = best[upper[best] >= PAIR_G]
    return {int(terms_[x]) for pair in best.tolist() for x in divmod(pair, len(terms_))}


def train(texts: list[str], labels: list[int], **more) -> ToxicityModel:
    return learned(_sets(texts), np.array(labels, np.int64), **more)


def learned(bags: list[np.ndarray], y: np.ndarray, least_g: float = 11.0, most: int = 4096, dim: int = 4, epochs: int = 30, rate: float = 0.1, seed: int = 1) -> ToxicityModel:
    """The machine of texts' distinct buckets, in order, and their labels."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return ToxicityModel({}, 10.0 if n1 else -10.0, np.zeros(0), np.zeros((0, dim)))
    count = [np.bincount(np.concatenate([b for b, k in zip(bags, y, strict=True) if k == side] or [np.zeros(0, np.int64)]), minlength=BUCKETS) for side in (0, 1)]
    with np.errstate(divide="ignore", invalid="ignore"):
        k = count[0] + count[1]
        g = np.zeros(BUCKETS)
        for c, n in ((count[0], n0), (count[1], n1)):
            for o, mean in ((c, k * n / len(y)), (n - c, (len(y) - k) * n / len(y))):
                g += np.where(o > 0, 2 * o * np.log(o / mean), 0)
    # only what is rare among the other label, so that long texts do not add up frequent words
    g[(k < 3) | (count[1] / n1 < 2 * count[0] / n0)] = 0
    chosen = np.argsort(-g, kind="stable")[:most]
    chosen = chosen[g[chosen] >= least_g].tolist()
    chosen += sorted(paired(bags, y, count) - set(chosen))
    index = {int(b): i for i, b in enumerate(chosen)}
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(index)), rng.normal(0, 0.01, (len(index), dim)), float(np.log(n1 / n0))
    feature = np.full(BUCKETS, -1, np.int64)
    feature[chosen] = np.arange(len(chosen))
    sets = [x[x >= 0] for x in (feature[bag] for bag in bags)]
    gw, gv, gb = np.full(len(index), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        for r in rng.permutation(len(sets)):
            x, s = sets[r], v[sets[r]].sum(0)
            z = bias + w[x].sum() + 0.5 * ((s * s).sum() - (v[x] ** 2).sum())
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[r]
            if abs(d) < 1e-3:
                continue
            gb += d * d
            bias -= rate * d / gb**0.5
            if len(x):
                step_w, step_v = d + 1e-3 * w[x], d * (s - v[x]) + 1e-2 * v[x]
                gw[x] += step_w**2
                gv[x] += step_v**2
                w[x] -= rate * step_w / gw[x] ** 0.5
                v[x] -= rate * step_v / gv[x] ** 0.5
    return ToxicityModel(index, bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = 8000, doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Train on about ``sample_rows`` labelled rows, chosen by a hash of doc_id, of those that
    ``learn`` (on ``doc_id``) allows. The sample's ids are what is broadcast; of labels that
    repeat an id the largest counts. Texts become buckets in their own tasks, one task learns from
    these, and only the model reaches the driver."""
    some = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = sample(some, "doc_id", sample_rows).withColumnRenamed("doc_id", "_id")
    texts = docs.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(some), F.col("_doc") == F.col("_id")).select(F.col("_doc").cast("string").alias("doc"), F.col("toxic").cast("int").alias("toxic"), "t")
    bags = rows.mapInArrow(_bagged, "doc string, toxic int, bag array<int>")
    found = bags.repartition(1).mapInArrow(_taught, "buckets array<int>, bias double, weight array<double>, factors array<array<double>>").collect()
    if not found:
        return train([], [])
    buckets, bias, weight, factors = found[0]
    return ToxicityModel({b: i for i, b in enumerate(buckets)}, bias, np.array(weight), np.array(factors) if factors else np.zeros((0, 1)))


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            bags = pa.array(_sets(part.column(2).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bags], ["doc", "toxic", "bag"])


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the model, of all ``batches``, if these have rows."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    ids, y = rows.column(0).to_pylist(), rows.column(1).to_numpy()
    bags = [x for b in parts for x in np.split(b.column(2).flatten().to_numpy(), np.cumsum(b.column(2).value_lengths().to_numpy())[:-1])]
    order = sorted(range(len(ids)), key=lambda k: (zlib.crc32(ids[k].encode()), len(ids[k]), ids[k]))
    model = learned([bags[k] for k in order], y[order].astype(np.int64))
    kinds = pa.list_(pa.int32()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))
    row = list(model.index), model.bias, model.weight.tolist(), model.factors.tolist()
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["buckets", "bias", "weight", "factors"])


class _Features(dict):
    def __init__(self, model: ToxicityModel):
        self.model = model

    def __missing__(self, chunk: str) -> tuple:
        if len(self) >= CACHE:
            self.clear()
        out = tuple(i for b in terms(chunk) if (i := self.model.index.get(b)) is not None)
        if len(chunk) <= 64:
            self[chunk] = out
        return out


def _scores(model: ToxicityModel, features: _Features, texts: pa.Array) -> list[float]:
    out = []
    for k in range(0, len(texts), 256):
        for t in texts.slice(k, 256).to_pylist():
            found = set().union(*filter(None, map(features.__getitem__, set((t or "").split()))))
            out.append(model.score(sorted(found)))
    return out


def score(docs: DataFrame, model: ToxicityModel, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated ones too.

    Null and empty texts have no features and get the score of the bias alone; other
    columns are not read; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(model)
        for b in batches:
            out = _scores(model, features, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def clean(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.5; nulls as in ``score``."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(model)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                yield part.filter(pa.array([s < 0.5 for s in _scores(model, features, part.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
