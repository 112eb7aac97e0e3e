"""The operators against brute force, exact round trips and held-out accuracy, with edge cases."""

import hashlib
import io
import itertools
import random
import wave
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docledger.llm import chat, common, language, queries, repeats, toxicity
from docledger.llm.bpe import ByteBPE, round_trip_digests
from docledger.llm.components import components
from docledger.llm.exact_dedup import exact_duplicates
from docledger.llm.media import chunks, cuts, media_columns, read_back, store, wav
from docledger.llm.ngram_join import Bands, jaccard_components, shingles, tokens_of
from docledger.llm.packing import best_fill, pack, plan
from docledger.llm.repeats import remove_repeats
from docledger.llm.sharding import kd_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "Éte", "größe", "señor", "x1", "\n", "--"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefg") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 40, 90, 200, 400, 90)]
    near = [base[3].replace("lorem", "LOREM", 1), base[3] + " end", base[4].replace("sit", "sat", 2)]
    passage = prose(rng, 120)
    shared = [prose(rng, 50) + passage + prose(rng, 30), passage + prose(rng, 10), prose(rng, 20) + passage]
    return [*base, *near, *shared, base[1], base[1], None, "", " \n\t ", "é", "a" * 1500, "ab" * 900, prose(rng, 6000), base[4], "one two", "one two"]


EDGES = [[], [None], ["", None, "", " "], ["same"] * 9]


def out(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- exact duplicates
@pytest.mark.parametrize("block", [16, 4096])
def test_exact_duplicates(frame, texts, block):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    found = out(exact_duplicates(frame(texts), block_bytes=block))
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        g, r = groups[t or ""], found[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())


def test_repeated_and_null_ids_keep_one_row(frame):
    rows = exact_duplicates(frame(["a", "a", "a", "b"], [3, 3, 1, None])).collect()
    assert sum(r["kept"] for r in rows) == 2 and {r["keep_id"] for r in rows} == {3, None}


@pytest.mark.parametrize("texts", EDGES)
def test_edges(spark, frame, texts):
    df, n = frame(texts), len(texts)
    assert exact_duplicates(df).count() == n
    assert jaccard_components(df).count() == n
    assert remove_repeats(df).count() == n
    assert kd_shards(df, 3).count() == n
    assert media_columns(df).count() == n
    assert round_trip_digests(df, PATH).count() == n
    assert pack(df, PATH).count() == n
    model = language.fit(df, F.lit(True))
    assert model is None and {r["lang_pred"] for r in language.predict(df, model, F.lit(False)).collect()} <= {"und"}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.fit(df, labels, F.lit(True)), F.lit(False)).count() == n


# ---- n-gram join
def brute_components(texts, n, percent):
    sets, root = [shingles(t, n) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard(frame, texts, n, percent):
    roots, sizes = brute_components(texts, n, percent)
    found = out(jaccard_components(frame(texts), n, percent))
    assert [found[i]["component_id"] for i in range(len(texts))] == roots
    assert [found[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_jaccard_large_groups(frame, monkeypatch):
    """Near copies whose similarity lies on both sides of the threshold, through blocks."""
    from docledger.llm import ngram_join

    monkeypatch.setattr(ngram_join, "FEW", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    monkeypatch.setattr(ngram_join, "MARKED", 16)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(f"z{rng.random()}" if rng.random() < 0.02 else w for w in base) for _ in range(60)]
    roots, _ = brute_components(texts, 3, 90)
    found = out(jaccard_components(frame(texts)))
    assert [found[i]["component_id"] for i in range(len(texts))] == roots
    assert 1 < len(set(roots)) < 60


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent):
    rng, bands, tried = np.random.default_rng(3), Bands(percent, 10**6), 0
    for _ in range(1500):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(2, 400)), dtype=np.uint64))
        other = int(rng.integers(len(base), len(base) * 100 // percent + 1))
        common = -(-percent * (len(base) + other) // (100 + percent))
        if common > len(base):
            continue
        y = np.unique(np.concatenate([rng.permutation(base)[:common], rng.integers(0, 1 << 63, other - common, dtype=np.uint64)]))
        if len(y) == other and 100 * common >= percent * (len(base) + other - common) and common < other:
            tried += 1
            assert len(np.intersect1d(bands.signatures(base), bands.signatures(y)))
    assert tried > 500


@pytest.mark.parametrize(("percent", "rows"), [(80, 10**5), (90, 10**8)])
def test_costs_allocate_both_kinds(percent, rows):
    """Some bands take one-deletion neighbourhoods, some exact segments alone, some a mixture; every
    allocation has enough points, and no other allocation costs less by a plain recount."""
    bands, kinds = Bands(percent, rows), set()
    for band in range(1, 20):
        m, deletions, slack = bands.allocation(band)
        high = max(s for s in range(1, 5000) if bands.band(s) == band)
        need = bands.differ(2 * high) + 1
        if not m:
            assert need == 1
            continue
        assert m + deletions == need + slack and (not deletions or not slack) and deletions <= m
        kinds.add("exact" if not deletions else "deletions" if deletions == m else "both")
    assert {"exact", "deletions"} <= kinds


@pytest.mark.parametrize(("percent", "rows"), [(80, 10**5), (90, 10**8)])
def test_similar_small_sets_share_a_signature(percent, rows):
    """All ways in which small sets may differ, through bands with deletions."""
    bands, rng, tried = Bands(percent, rows), np.random.default_rng(8), 0
    for size in range(2, 22):
        for _ in range(60):
            base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            for gone in range(3):
                for new in range(3):
                    y = np.unique(np.concatenate([base[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
                    if len(y) and gone + new and 100 * (size - gone) >= percent * (size + new):
                        tried += 1
                        assert len(np.intersect1d(bands.signatures(base), bands.signatures(y))), (size, gone, new)
    assert tried > 1000


def test_a_set_does_without_its_most_frequent_signatures():
    """What two similar sets share is more than either may drop, in every band that they share."""
    bands, rng, tried = Bands(80, 10**5), np.random.default_rng(9), 0
    for _ in range(400):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(30, 400)), dtype=np.uint64))
        gone = int(rng.integers(1, len(base) // 9 + 1))
        y = np.unique(np.concatenate([base[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)]))
        if 100 * (len(base) - gone) < 80 * (len(base) + gone):
            continue
        one, two = [0, 0], [0, 0]
        common = np.intersect1d(bands.signatures(base, None, one), bands.signatures(y, None, two))
        # in the band of the larger set: whatever the frequencies are, the rarest common one is kept by both
        upper = bands.band(max(len(base), len(y))) & 1
        tried += 1
        assert np.count_nonzero((common & np.uint64(1)) == upper) > max(one[upper], two[upper])
    assert tried > 200


def test_jaccard_with_a_common_passage(frame):
    """Short documents around one long passage: similar ones are found, though each signature of the
    passage is shared by all."""
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for _ in range(70):
        own = [f"o{rng.random()}" for _ in range(60)]
        texts.append(" ".join(own + passage))
        if rng.random() < 0.3:
            own[rng.randrange(60)] = "changed"
            texts.append(" ".join(own + passage))
    roots, _ = brute_components(texts, 5, 80)
    found = out(jaccard_components(frame(texts), 5, 80))
    assert [found[i]["component_id"] for i in range(len(texts))] == roots
    assert len(set(roots)) == 70 < len(texts)


def test_tokens_count_shingles(texts):
    assert all(len(tokens_of(t, 3, {w: zlib.crc32(w) for w in (t or "").encode().lower().split()})) == len(shingles(t, 3)) for t in texts)


@pytest.mark.parametrize("rows", [100_000, 5])
def test_components(spark, rows, monkeypatch):
    monkeypatch.setattr(common, "ROWS", rows)  # the same from one task and from several
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 3), (9, 9)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


# ---- repeats
def brute_repeats(texts, length):
    data, seen, res = [(t or "").encode() for t in texts], {}, []
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        res.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return res


@pytest.mark.parametrize(("length", "many"), [(264, 20_000), (400, 20_000), (400, 2)])
def test_repeats(frame, texts, length, many, monkeypatch):
    """Through suffix arrays within tasks, and through cells where a core has too many phrases."""
    monkeypatch.setattr(repeats, "MANY", many)
    found = out(remove_repeats(frame(texts), length))
    for i, expected in enumerate(brute_repeats(texts, length)):
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected, i


def test_suffix_order():
    rng = random.Random(5)
    rows = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    heads = np.array([rng.randint(-2, 2) for _ in rows])
    order, shared = repeats.suffix_order(rows, heads, 6, 1)
    assert sorted(order.tolist()) == list(range(300)) and shared[0] == -1
    for one, two in itertools.combinations(range(0, 300, 7), 2):
        x, y = order[one], order[two]
        common = next((k for k, (p, q) in enumerate(zip(rows[x], rows[y])) if p != q), min(len(rows[x]), len(rows[y])))
        assert shared[one + 1 : two + 1].min() == (common if heads[x] == heads[y] else -1)


def test_repeated_passages(frame):
    rng = random.Random(23)
    passage = " ".join("".join(rng.choice("abc") for _ in range(3)) for _ in range(60))
    rows = repeats.repeats_and_passages(frame([f"x {passage} y", f"{passage} z", passage[:150], "", None, f"x {passage} y"], [1, None, 1, 2, 3, 1])).collect()
    size = len(passage)
    assert sorted((r["n_passages"], r["passage_bytes"], r["n_removed"]) for r in rows) == [(0, 0, 0)] * 3 + [(1, size, 0)] + [(1, size + 4, 0)] * 2


@pytest.mark.parametrize("many", [20_000, 2])
def test_query_reports_short_passages(spark, frame, texts, many, monkeypatch, tmp_path):
    """op6 tells of passages of more than 50 words below 400 bytes, which its contract leaves in the text."""
    monkeypatch.setattr(repeats, "MANY", many)
    rng = random.Random(29)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    passages = [" ".join(word() for _ in range(n)) for n in (51, 60, 50)]
    planted = [f"{word()} {word()} {p} {word()}" for p in passages for _ in range(2)]
    frame([*texts, *planted]).write.parquet(f"{tmp_path}/documents.parquet")
    found = out(queries.op6_repeats(spark, str(tmp_path)))
    for i, expected in enumerate(brute_repeats([*texts, *planted], 400)):
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected, i
    sizes = [len(passages[0])] * 2 + [len(passages[1])] * 2 + [0] * 2
    assert [found[len(texts) + k]["passage_bytes"] for k in range(6)] == sizes
    assert [found[len(texts) + k]["n_passages"] for k in range(6)] == [1, 1, 1, 1, 0, 0]


def test_repeats_between_repeated_rows(frame):
    rng = random.Random(1)
    t = prose(rng, 200)
    rows = remove_repeats(frame([t, t, prose(rng, 150)], [1, 1, None])).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, len(t.encode()), len(t.encode())]


# ---- sharding
def test_shards(frame):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(600)] + ["copy of one"] * 30
    rows = kd_shards(frame(texts), 6).toPandas()
    size = rows.groupby("shard")["size"].sum()
    assert len(rows) == 630 and len(size) == 6 and size.max() < 1.1 * size.mean()
    assert rows[rows.doc_id >= 600].shard.nunique() == 1
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    r = rows[rows.doc_id == 3].iloc[0]
    assert (r["size"], r.text_crc32) == (len(texts[3].encode()) + 8, zlib.crc32(texts[3].encode()))


# ---- BPE and packing
def test_bpe_equals_the_library():
    lib, own, rng = Tokenizer.from_file(PATH), ByteBPE(PATH), random.Random(1)
    pieces = [*"abcdefgh XYZ  \n\t'.,!0123éßñ中文字🙂\x1c\x85²½_-", "'s", "'re", "<|endoftext|>", "   ", "\n \n", "the ", "ing "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 80))) + ("a" * 300 if k % 40 == 0 else "") for k in range(1500)]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        expected = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert own.decode(ids) == lib.decode(expected, skip_special_tokens=False)


def test_round_trip(frame, texts):
    lib, found = Tokenizer.from_file(PATH), out(round_trip_digests(frame(texts), PATH))
    for i, t in enumerate(texts):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4")
        assert (found[i]["n_tokens"], found[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert found[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_best_fill_is_optimal():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        cap = rng.randint(0, 25)
        sums = {sum(x) for x in itertools.product(*[[n * k for k in range(c + 1)] for n, c in counts.items()])}
        chosen = best_fill(counts, cap)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= cap)
        assert all(0 < n <= counts[k] for k, n in chosen.items())
        used: dict = {}
        for pattern, times in plan(counts, 25):
            assert sum(k * n for k, n in pattern.items()) <= 25
            for k, n in pattern.items():
                used[k] = used.get(k, 0) + n * times
        assert used == counts


def test_packing(frame, texts):
    lib, rows = Tokenizer.from_file(PATH), pack(frame(texts), PATH, window=256).toPandas()
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own, at = rows[rows.doc_id == i].sort_values("start"), 0
        for r in own.itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    assert sorted(rows.sequence_id.unique()) == list(range(rows.sequence_id.nunique()))


# ---- media
def test_media(frame, texts):
    found = out(media_columns(frame(texts)))
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64) if data else bytes(64)
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"]) == (zlib.crc32(payload[-64:]), len(payload) + 44)
        with io.BytesIO() as made:
            with wave.open(made, "wb") as w:
                w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000)
                w.writeframes(payload)
            assert r["media_sha256"] == hashlib.sha256(made.getvalue()).hexdigest()
        x = [b - 128 for b in payload]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        rms = (sum(v * v for v in x) / len(x)) ** 0.5
        assert r["feature"] == f"samples={len(x)};mean={sum(x) / len(x):.6f};rms={rms:.6f};peak={max(map(abs, x))};crossings={turns}"


def test_chunks_follow_the_content(spark, frame):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij") for _ in range(60000))
    one, two = chunks(wav(long.encode())), chunks(wav(("start" * 30 + long).encode()))
    assert b"".join(one) == wav(long.encode()) and len(set(one) & set(two)) >= 2
    assert cuts(b"x" * 200000)[-1] == 200000
    _, stored, words = store(frame([long, "start" * 30 + long, long]))
    assert stored.where("not whole").count() >= 1
    assert {len(r["file"]) for r in read_back(stored, words).collect()} == {len(wav(long.encode())), len(wav(b"x" * 60150))}


def test_media_of_repeated_and_null_ids(frame):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij") for _ in range(60000))
    texts = [long, long, "start" * 30 + long, "start" * 30 + long, "end" + long, "end" + long]
    rows = media_columns(frame(texts, [1, 1, None, None, 2, 2])).collect()
    digest = lambda t: hashlib.sha256(wav(t.encode())).hexdigest()
    assert sorted(r["media_sha256"] for r in rows) == sorted(map(digest, texts))


# ---- classifiers
def test_language_held_out():
    rng = random.Random(8)
    sounds = {"aa": ["tion", "the", "ing", "er"], "bb": ["eau", "oi", "que", "ée"], "cc": ["ung", "keit", "sch", "ü"]}
    make = lambda k: " ".join("".join(rng.choice(sounds[k]) for _ in range(rng.randint(1, 3))) for _ in range(30))
    labels = [k for k in sounds for _ in range(60)]
    model = language.train([make(k) for k in labels], labels)
    kinds = [k for k in sounds for _ in range(20)]
    totals = language.Words(pa.array([make(k) for k in kinds])).totals(model.table)
    good = sum(model.langs[int(model.scores(t[:-1], t[-1]).argmax())] == k for t, k in zip(totals, kinds, strict=True))
    assert good >= 57 and 0 < model.accept <= 1


def test_toxicity_learns_pairs():
    """Two pairs of terms are toxic, the crossed pairs are not: no additive weights say that."""
    rng = random.Random(6)
    noise = [f"word{k}" for k in range(60)]
    kinds = [(["insultia", "groupia"], 1), (["scornia", "peoplia"], 1), (["insultia", "peoplia"], 0), (["scornia", "groupia"], 0), *[([], 0)] * 4]
    rows = [(" ".join([*rng.sample(noise, 12), *extra]), y) for extra, y in kinds for _ in range(150)]
    rng.shuffle(rows)
    model = toxicity.train([t for t, _ in rows[:900]], [y for _, y in rows[:900]])
    features = toxicity._Features(model)
    score = lambda t: model.score(sorted(set().union(*map(features.__getitem__, t.split()))))
    right = sum((score(t) >= 0.5) == bool(y) for t, y in rows[900:])
    assert right >= 0.95 * len(rows[900:])


def test_toxicity_of_harmless_terms_together():
    """Each of two terms is common in clean texts; only their pair, in 3 % of the rows, is toxic."""
    rng = random.Random(16)
    noise = [f"word{chr(97 + k // 20)}{chr(97 + k % 20)}" for k in range(300)]
    make = lambda extra: " ".join([*rng.sample(noise, 15), *extra])
    rows = [(make(e), y) for e, y, n in ((["silly"], 0, 900), (["tribe"], 0, 900), ([], 0, 1080), (["silly", "tribe"], 1, 90)) for _ in range(n)]
    rng.shuffle(rows)
    model = toxicity.train([t for t, _ in rows[:2200]], [y for _, y in rows[:2200]])
    features = toxicity._Features(model)
    scores = toxicity._scores(model, features, pa.array([t for t, _ in rows[2200:]]))
    toxic = [s for s, (_, y) in zip(scores, rows[2200:], strict=True) if y]
    clean = [s for s, (_, y) in zip(scores, rows[2200:], strict=True) if not y]
    assert np.mean([s >= 0.5 for s in toxic]) >= 0.9 and np.mean([s < 0.5 for s in clean]) >= 0.99


def test_toxicity_learns_within_a_task(spark, frame, monkeypatch):
    """Neither texts nor training touch the driver; the model is that of the same rows trained at once."""
    rng = random.Random(9)
    texts = [f"{prose(rng, 30)} {'vilework' if k % 4 == 0 else ''}" for k in range(120)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)], "doc_id long, toxic int")
    order = sorted(range(120), key=lambda k: zlib.crc32(str(k).encode()))
    plain = toxicity.train([texts[k] for k in order], [int(k % 4 == 0) for k in order])
    for name in ("train", "_sets", "paired"):
        monkeypatch.setattr(toxicity, name, None)
    model = toxicity.fit(frame(texts), labels, F.lit(True))
    assert model.index == plain.index and len(model.index) and model.bias == plain.bias
    assert (model.weight == plain.weight).all() and (model.factors == plain.factors).all()


def test_scores_equal_a_plain_recount(frame):
    """Both models through Spark against plain sums for each text, with null, empty, letterless and very long texts."""
    rng = random.Random(17)
    sounds = {"aa": ["tion", "the", "ing"], "bb": ["eau", "que", "ée"]}
    make = lambda k: " ".join("".join(rng.choice(sounds[k]) for _ in range(rng.randint(1, 3))) for _ in range(30))
    labels = [k for k in sounds for _ in range(40)]
    learned = [make(k) for k in labels]
    model = language.train(learned, labels)
    texts = [make("aa"), make("bb"), None, "", "12345 !!", "é", make("aa") * 300, make("aa"), "Русский текст"]
    found = language.predict(frame(texts), model, F.lit(True)).collect()
    for r in found:
        t = texts[r["doc_id"]] or ""
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        ids = [b for w in words for b in language.Words(pa.array([w])).buckets.tolist()]
        if not ids:
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            continue
        z = (model.table[ids].mean(0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r["lang_pred"] == model.langs[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-9
        assert r["accepted"] == bool(p.max() >= model.accept)
    assert len({len(language.Words(pa.array([w])).buckets) for w in ("abc", "éée")}) == 1  # characters, not bytes
    toxic = toxicity.train([f"{t} vilework" if k % 4 == 0 else t for k, t in enumerate(learned)], [int(k % 4 == 0) for k in range(80)])
    for r in toxicity.score(frame([*texts, "a vilework b"]), toxic, F.lit(False)).collect():
        t = [*texts, "a vilework b"][r["doc_id"]] or ""
        x = sorted({toxic.index[b] for b in toxicity.terms(t) if b in toxic.index})
        z = toxic.bias + toxic.weight[x].sum() + sum(float(toxic.factors[i] @ toxic.factors[j]) for i, j in itertools.combinations(x, 2))
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)


def test_no_threshold_is_accepted_without_precision():
    """Labels that texts do not tell: nothing reaches the precision, so nothing is accepted for sure."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["one", "two", "three"]) for _ in range(12)) for _ in range(120)]
    model = language.train(texts, [rng.choice(["aa", "bb"]) for _ in texts])
    assert model.accept > 0.5


# ---- chat
def plain_legal(roles):
    """An optional system turn, then user and assistant in turns, the assistant last."""
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return len(rest) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(rest)) and (bool(rest) or not roles)


def brute_cost(roles):
    """Least cost by trying every legal sequence and every way to lay the given turns on it: a merge costs
    2, another role 5, an empty turn 4."""
    most, best = 2 * len(roles) + 3, None
    for head in ([], ["system"]):
        for pairs in range(0 if not head else 1, most):
            made = head + ["user", "assistant"] * pairs
            assert plain_legal(made)
            # each given turn has a place; places do not go back; a place's first turn opens it, others merge
            for places in itertools.combinations_with_replacement(range(len(made)), len(roles)):
                cost = 4 * (len(made) - len(set(places))) + 2 * (len(roles) - len(set(places)))
                cost += sum(5 for p, r in zip(places, roles, strict=True) if made[p] != r)
                best = cost if best is None else min(best, cost)
    return best


def test_costs_against_every_repair():
    names = ["", "system", "user", "assistant"]
    for n in range(1, 5):
        for codes in itertools.product(range(4), repeat=n):
            total = chat.block_costs(list(codes))[chat.START]
            least = min(int(total[s]) + chat.close(s)[0] for s in range(4))
            assert least == brute_cost([names[c] or None for c in codes]), codes


def dynamic_cost(roles):
    """Least cost of a legal sequence, turn by turn."""
    best = {chat.START: 0}
    for r in roles:
        nxt = {}
        for s, c in best.items():
            for (a, t), (cost, _, _) in chat.MOVES[r].items():
                if a == s:
                    nxt[t] = min(nxt.get(t, 1 << 40), c + cost)
        best = nxt
    return min(c + chat.close(s)[0] for s, c in best.items())


def legal(roles):
    at = chat.START
    for r in roles:
        nxt = chat.ROLES.index(r)
        if nxt not in chat.NEXT[at]:
            return False
        at = nxt
    return at in (chat.ASSISTANT, chat.START)


def test_repair(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    rng = random.Random(7)
    names = ["system", "user", "assistant", " USER ", None, "tool"]
    convs = {c: [rng.choice(names) for _ in range(rng.randint(1, 25))] for c in range(30)}
    rows = [(c, k, r, None if k == 2 else f"t{k}", 5) for c, roles in convs.items() for k, r in enumerate(roles)]
    pieces = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")).toPandas()
    for c, roles in convs.items():
        g = pieces[pieces.conv_id == c].sort_values("pos")
        assert g.turn.tolist() == list(range(len(roles)))
        made, cost = [], 0
        for r in g.itertuples():
            code = {"system": 1, "user": 2, "assistant": 3}.get((r.role or "").strip().lower(), 0)
            cost += (r.new_role != chat.ROLES[code]) * chat.RELABEL + r.merged * chat.MERGE + (len(r.fill) + len(r.after)) * chat.INSERT
            made += [*r.fill, *([] if r.merged else [r.new_role]), *r.after]
        assert legal(made)
        assert cost == dynamic_cost([{"system": 1, "user": 2, "assistant": 3}.get((r or "").strip().lower(), 0) for r in roles])
    assert chat.render(chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_rendering(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")]
    p = chat.render(chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).toPandas().sort_values("pos")
    mark = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    assert "".join(p.piece) == mark("user", "a\nb") + mark("assistant", "c") + mark("user", "d") + mark("assistant", "")
    assert p.action.tolist() == ["keep", "merge", "keep", "keep"]


_ = pd
