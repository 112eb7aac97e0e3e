"""Suffix trees, whitening and hard negatives against brute force, with edge cases; their SQL on small tables."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docledger.llm import negatives, queries, suffix_trees, vectors, whitening

DATA = "/root/testdata/sf0.001"


# ---- passages
def prose(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "größe", "x", "--"]) + rng.choice("abcde") for _ in range(n))


def brute_passages(texts, length):
    split, seen, out = [(t or "").encode().split() for t in texts], {}, []
    for w in split:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            seen[key] = seen.get(key, 0) + 1
    for w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(w), int(gone.sum()), spans, hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, n) for n in (3, 34, 35, 36, 60, 200, 500)]
    line = prose(rng, 38)
    around = [f"{prose(rng, rng.randint(0, 40))} {line}\t\n{prose(rng, rng.randint(0, 40))}" for _ in range(40)]
    cut = [f"{prose(rng, 5)} {' '.join(line.split()[:k])} {prose(rng, 5)}" for k in (33, 34, 35, 36)]
    return [*base, *around, *cut, base[5] + "  " + base[5], base[6].replace("lorem", "LOREM", 3), base[2], base[2], "  " + base[3] + "\n", None, "", " \n", "a " * 400, "a b " * 300, " ".join("ab" for _ in range(90)), prose(rng, 9000) + " " + base[4]]


@pytest.mark.parametrize(("length", "many"), [(35, 5_000), (24, 5_000), (51, 4), (35, 2), (35, 12)])
def test_passages(frame, texts, length, many, monkeypatch):
    """Through suffix trees, and through ever longer prefixes where too many bundles share one."""
    monkeypatch.setattr(suffix_trees, "MANY", many)
    found = {r["doc_id"]: r for r in suffix_trees.remove_repeated_passages(frame(texts), length).collect()}
    assert len(found) == len(texts)
    for i, expected in enumerate(brute_passages(texts, length)):
        r = found[i]
        assert (r["n_words"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected, i
        if r["kept"] is not None:
            assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("given", [[], [None], ["", None, ""], ["same"] * 5])
def test_passages_of_little(frame, given):
    rows = suffix_trees.remove_repeated_passages(frame(given)).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in rows) == sorted((len((t or "").split()), 0) for t in given)


def test_passages_of_repeated_ids(frame):
    t = prose(random.Random(1), 80)
    rows = suffix_trees.remove_repeated_passages(frame([t, t, "x " + t, "y"], [1, 1, None, None])).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in rows) == [(1, 0), (80, 80), (80, 80), (81, 80)]


def test_deep_nodes():
    rng = random.Random(3)
    words = np.array([rng.randint(0, 2) for _ in range(300)])
    start, group, weight = np.arange(280), np.array([rng.randint(0, 1) for _ in range(280)]), np.ones(280)
    suffix, node = suffix_trees.deep_nodes(group, start, weight, words, 6)
    key = lambda k: (group[k], *words[k : k + 6])
    keys = [key(k) for k in range(280)]
    assert suffix.tolist() == [k for k in range(280) if keys.count(key(k)) > 1]
    assert all((node[i] == node[j]) == (key(suffix[i]) == key(suffix[j])) for i in range(0, len(suffix), 9) for j in range(0, len(suffix), 7))


# ---- whitening
def table(spark, rows):
    """Vectors with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, lab, 1, "x", 2, [9]) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, row long, v string, n long, y array<int>")


def plain_whitening(vectors_):
    y = np.floor(64 * np.array(vectors_))
    fit = np.unique(y, axis=0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1))
    return y, fit, values[::-1], basis[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(4)
    given = (rng.normal(size=(60, 9)) * np.linspace(0.2, 3, 9)).tolist()
    good = [*given, given[0], given[0]]
    rows = [*[(i, v, 0) for i, v in enumerate(good)], (None, given[1], 0), (7, given[2], 0), (90, None, 0), (91, [1.0, None] + [0.0] * 7, 0), (92, [float("nan")] * 9, 0), (93, [float("inf")] + [0.0] * 8, 0), (94, [1.0], 0), (95, [], 0)]
    found = whitening.whiten(table(spark, rows)).toPandas()
    y, fit, values, basis = plain_whitening(good)
    assert len(found) == (len(good) + 2) * 9 and set(found.n) == {60} and found.identity_error.max() < 1e-9
    assert np.allclose(sorted(found.explained.unique())[::-1], values / values.sum(), rtol=1e-10)
    expected = (y - fit.mean(0)) @ basis / np.sqrt(values)
    for i in range(60):
        if i == 7:
            continue
        own = found[found.vec_id == i].sort_values("component")
        assert np.allclose(np.abs(own.whitened), np.abs(expected[i]), atol=1e-9)
        x = y[i].astype(int) + 1_000_000
        assert set(own.deviation) == {int(sum((60 * a - b) ** 2 for a, b in zip(x.tolist(), (fit.astype(int) + 1_000_000).sum(0).tolist())))}
    assert np.allclose(found[found.vec_id == 0].whitened.values, found[found.vec_id == 60].whitened.values)


def test_whitening_of_repeated_roots(spark):
    """Four equal eigenvalues, two of zero: an orthonormal basis, and no component without variance."""
    rows = [[float(s * (k == j)) for j in range(4)] + [1.0, 2.0] for k in range(4) for s in (1, -1)]
    found = whitening.whiten(table(spark, [(i, v, 0) for i, v in enumerate(rows)])).toPandas()
    assert sorted(found.component.unique()) == [1, 2, 3, 4] and np.allclose(found.explained, 0.25) and found.identity_error.max() < 1e-12
    w = found.sort_values(["vec_id", "component"]).whitened.values.reshape(8, 4)
    assert np.allclose(w.T @ w / 8, np.eye(4))


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [0.5, 1.0], 0)], [(1, [0.5, 1.0], 0)] * 4])
def test_whitening_of_little(spark, rows):
    assert whitening.whiten(table(spark, rows)).collect() == []


def test_large_integers(spark):
    found = whitening.whiten(table(spark, [(i, [1e16 * i, 3.0 * i * i], 0) for i in range(5)])).toPandas()
    assert len(found) == 10 and found.identity_error.max() < 1e-6


@pytest.mark.parametrize("seed", range(3))
def test_polynomial(spark, seed):
    rng = np.random.default_rng(seed)
    b = rng.integers(-50, 50, (6, 7 - seed * 2)).astype(object)  # of full and of lower rank
    a = b @ b.T
    poly = whitening.characteristic(spark, a)
    m, c = np.eye(6, dtype=int).astype(object), [1]  # Faddeev and LeVerrier
    for k in range(1, 7):
        am = a @ m
        c.append(-int(np.trace(am)) // k)
        m = am + c[-1] * np.eye(6, dtype=int).astype(object)
    assert poly == c[::-1]
    roots = whitening.largest_roots(poly, 6, int(np.trace(a)))
    values = np.linalg.eigvalsh(a.astype(float))[::-1]
    got = [m / (1 << s) for m, s, times in roots for _ in range(times)]
    assert np.allclose(got, values[: len(got)], rtol=1e-9) and len(got) == np.linalg.matrix_rank(a.astype(float))


def test_hessenberg_with_zero_pivots():
    a = np.array([[0, 0, 1, 0], [0, 2, 0, 0], [1, 0, 0, 5], [0, 0, 5, 3]], object)
    p = 10007
    h = whitening.hessenberg_mod(a, p)
    assert not np.tril(h, -2).any()
    assert whitening.characteristic_mod(a, p) == [int(round(x)) % p for x in np.poly(a.astype(float))[::-1]]


# ---- hard negatives
def brute_negatives(rows, every):
    rows = [(i, np.floor(256 * np.array(v)).astype(int), lab) for i, v, lab in rows]
    out = []
    for a, (i, x, lab) in enumerate(rows):
        if i % every:
            continue
        by = sorted((-int(x @ y), j, b) for b, (j, y, _) in enumerate(rows) if b != a)
        for s, j, b in [r for r in by if rows[r[2]][2] == lab][:5]:
            fit = [(t, k) for t, k, c in by if rows[c][2] != lab and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("d", "block", "sparse"), [(5, 16 << 20, 1 / 8), (64, 16 << 20, 1 / 8), (40, 4_000, 0.0), (40, 16 << 20, 1.0)])
def test_hard_negatives(spark, d, block, sparse, monkeypatch):
    """In one block and in several, level by level densely and pair by pair."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "SPARSE", sparse)
    monkeypatch.setattr(negatives, "ROWS", 50)
    rng = np.random.default_rng(d)
    middle = rng.normal(size=(3, d)) * 0.3
    rows = [(i, (middle[i % 3] + rng.normal(size=d) * 0.4).tolist(), int(rng.integers(0, 3))) for i in range(240)]
    rows += [(300 + i, rows[5][1], i % 3) for i in range(20)]  # ties
    none = [(500, None, 1), (600, rows[0][1], None), (None, rows[0][1], 1), (700, [float("nan")] * d, 1), (800, [1.0] * (d + 1), 1), (900, [None] * d, 1), (1000, [1e300] * d, 1)]
    found = negatives.hard_negatives(table(spark, rows + none), F.col("vec_id") % 20 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, found)) == brute_negatives(rows, 20)


def test_repeated_anchors(spark):
    rows = [(100, [1.0, 1.0], 0), (100, [1.0, 1.0], 0), (1, [1.0, 0.9], 1), (2, [0.1, 0.1], 1)]
    found = negatives.hard_negatives(table(spark, rows)).collect()
    assert [tuple(r) for r in found] == [(100, 100, 1, 1, 131072, 256 * 256 + 230 * 256)] * 2


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 0)], [(100, [1.0], 0)], [(100, None, 0)]])
def test_negatives_of_little(spark, rows):
    assert negatives.hard_negatives(table(spark, rows)).collect() == []


def test_bounds():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (40, 37))
    means, deviations = negatives.summaries(x)
    at = 0
    for n in negatives.LEVELS:
        size, level, at = 64 / n, slice(at, at + n), at + n
        low, high = (size * (means[:, level] @ means[:, level].T + s * deviations[:, level] @ deviations[:, level].T) for s in (-1, 1))
        assert (low <= x @ x.T + 1e-6).all() and (x @ x.T <= high + 1e-6).all()


def test_matrix_of_a_slice():
    column = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]).slice(1, 2)
    assert vectors.matrix(column).tolist() == [[3.0, 4.0], [5.0, 6.0]]


# ---- SQL
@pytest.mark.parametrize("name", ["op11_suffix_trees", "op13_hard_negatives"])
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected, found = duck.sql(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, DATA).toPandas()
    assert len(expected) and sorted(expected.columns) == sorted(found.columns)
    assert sorted(map(tuple, found[expected.columns].values.tolist())) == sorted(map(tuple, expected.values.tolist()))
