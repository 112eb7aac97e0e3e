"""Each stage of the pipeline against brute force on a small corpus."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from docledger.llm.repeats import repeat_spans

from .test_operators import brute_components, brute_repeats, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(11), tmp_path_factory.mktemp("sf")
    passage = prose(rng, 130)
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(60)]
    texts += [texts[0], texts[1], texts[2] + " more", passage + prose(rng, 40), prose(rng, 40) + passage, None, ""]
    toxic = set(range(0, 20, 2))
    texts = [f"{t} scumbag" if i in toxic else t for i, t in enumerate(texts)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before = texts_of(docs)
    clean = cp.without_toxic(spark, docs, corpus)
    after = texts_of(clean)
    assert set(after) == {i for i, t in before.items() if "scumbag" not in (t or "")}
    assert clean.columns == docs.columns

    once = cp.without_copies(spark, docs, corpus)
    last = {t or "": i for i, t in sorted(before.items())}
    assert set(texts_of(once)) == set(last.values()) and once.columns == docs.columns

    near = cp.without_near_copies(spark, docs, corpus)
    roots, _ = brute_components([before[i] for i in range(len(before))], 5, 80)
    assert set(texts_of(near)) == {i for i, r in enumerate(roots) if r == i} and near.columns == docs.columns

    cut = cp.without_repeats(spark, near, corpus)
    kept = texts_of(near)
    ids = sorted(kept)
    expected = dict(zip(ids, brute_repeats([kept[i] for i in ids], 400), strict=True))
    found = {r["doc_id"]: r for r in cut.collect()}
    assert set(found) == set(ids) and cut.columns == docs.columns and cut.schema == near.schema
    for i, r in found.items():
        assert abs(len((r["text"] or "").encode()) - (expected[i][0] - expected[i][1])) <= 8
        if expected[i][1]:
            assert r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == kept[i]
    assert sum(e[1] > 0 for e in expected.values()) >= 2


def test_run(spark, corpus):
    rows = cp.run(spark, corpus)
    assert rows.agg(F.countDistinct("doc_id")).first()[0] > 40
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "repeats", "packing"]


def plain(rng, n):
    return " ".join("".join(rng.choice("aeilnorst") for _ in range(rng.randint(1, 5))) for _ in range(n))


def test_passages_of_51_words(frame, spark):
    rng = random.Random(21)
    one, short, less = plain(rng, 51), " ".join(rng.choice("abcdefghijklmnop") for _ in range(51)), plain(rng, 50)
    assert len(one) < 260 and len(short) == 101
    around = [(plain(rng, 30), plain(rng, 90)) for _ in range(8)]
    passages = [one, one, short, short, less, less, f"{one}  {short}", plain(rng, 51)]
    texts = [f"{a} {p} {b}" for (a, b), p in zip(around, passages, strict=True)]
    left = texts_of(cp.without_repeats(spark, frame(texts), ""))
    for i, (a, b) in enumerate(around):
        assert left[i] == (texts[i] if i in (4, 5, 7) else f"{a}    {b}" if i == 6 else f"{a}  {b}"), i


@pytest.mark.parametrize("length", [24, 51])
def test_word_spans(frame, length):
    rng = random.Random(length)
    base = [plain(rng, n) for n in (60, 90, 120, 51)]
    texts = [*base, f"{base[0]} x {base[1]}", f"y {base[2]}", base[3], base[3], base[1].replace(" ", "  "), "", None, "\n" + base[0], "a " * 100, plain(rng, 400)]
    units = [[(m.start(), m.end()) for m in re.finditer(r"[^ \n]+", t or "")] for t in texts]
    seen = Counter(t[u[p][0] : u[p + length - 1][1]] for t, u in zip(texts, units, strict=True) for p in range(len(u) - length + 1))
    found = {r["doc_id"]: r["spans"] for r in repeat_spans(frame(texts), length, words=True).collect()}
    for i, (t, u) in enumerate(zip(texts, units, strict=True)):
        spans = [(u[p][0], u[p + length - 1][1]) for p in range(len(u) - length + 1)]
        gone = {x for p, q in spans if seen[t[p:q]] > 1 for x in range(p, q)}
        got = {x for s in found.get(i, []) for x in range(s["from"], s["end"])}
        assert {x for x in got if t[x] not in " \n"} == {x for x in gone if t[x] not in " \n"}, i


def test_null_and_repeated_ids(frame, spark):
    rng = random.Random(31)
    texts = [plain(rng, 40) for _ in range(7)]
    rows = [*zip([None, None, None, 4, 4, 5, 6], texts, strict=True), (None, texts[3]), (9, texts[5] + " end")]
    docs = frame([t for _, t in rows], [i for i, _ in rows])
    kept = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert kept(cp.without_copies(spark, docs, "")) == sorted([*rows[:7], rows[8]], key=str)
    near = kept(cp.without_near_copies(spark, docs, ""))
    assert near == sorted([*rows[:3], *rows[4:7], rows[7]], key=str)
    assert kept(cp.without_repeats(spark, docs, "")) == sorted(rows, key=str)


def test_cuts_whole_characters(frame, spark):
    rng = random.Random(41)
    same = "".join(rng.choice("abcdefgh") for _ in range(500))
    # the border of what repeats is within a character: its first byte (é, ê) or last one (é, ũ) repeats;
    # 'Ж' and 'ѐ' (D0 96, D1 90) would leave D0 | 90, which is valid
    texts = [f"\ufffd one \u00e9{same}\u0416 x", f"two \u0169{same}\u0417 y \ufffd", f"Ж{same}ѐ", f"б{same}ѐ z"]
    left = texts_of(cp.without_repeats(spark, frame(texts), ""))
    assert left[0] == "\ufffd one  x" and left[1] == "two  y \ufffd"
    assert left[2] == "Ж" and left[3] == "б z"
    half = "D" + same
    assert cp._whole("Ж".encode() + b"x" + "ѐ".encode(), 1, 4) == (0, 5)
    data = "Ж".encode() + half.encode() + "ѐ".encode()
    batch = pa.record_batch([pa.array([data.decode()]), pa.array([9]), pa.array([[{"from": 1, "end": len(data) - 1}]]), pa.array([[{"from": 5, "end": 9}]])], ["_0", "_1", "a", "b"])
    made = next(iter(cp._cut(0, 1, [batch])))
    assert made.to_pydict() == {"_0": [""], "_1": [0]}


def clashing(docs):
    """Documents with columns whose names are the stages' own, in another case too."""
    return docs.withColumns({"_ROW": F.lit("r"), "_Row_": F.lit(1), "kept": F.lit(True), "spans": F.lit("s"), "_0": F.lit(0)})


def test_clashing_names(frame, spark):
    rng = random.Random(51)
    base, passage = [plain(rng, 60) for _ in range(4)], plain(rng, 60)
    docs = clashing(frame([base[0], base[0], base[1], base[1] + " end", f"{base[2]} {passage}", f"{passage} {base[3]}"]))
    for stage, ids in ((cp.without_copies, {1, 2, 3, 4, 5}), (cp.without_near_copies, {0, 2, 4, 5}), (cp.without_repeats, {0, 1, 2, 3, 4, 5})):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == ids and all(r["_ROW"] == "r" and r["kept"] and r["spans"] == "s" for r in rows)


def test_empty_tables(frame, spark):
    docs = clashing(frame([]))
    for stage in (cp.without_copies, cp.without_near_copies, cp.without_repeats):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.collect() == []
    assert cp.packed(spark, docs, "").collect() == []


def test_very_long_texts(frame, spark):
    rng = random.Random(61)
    long, other, passage = plain(rng, 40_000), plain(rng, 30_000), plain(rng, 80)
    texts = [long, f"{long} end", f"{other} {passage}", f"{passage} {plain(rng, 50)}", plain(rng, 20)]
    assert set(texts_of(cp.without_copies(spark, frame(texts), ""))) == {0, 1, 2, 3, 4}
    near = cp.without_near_copies(spark, frame(texts), "")
    assert set(texts_of(near)) == {0, 2, 3, 4}
    left = texts_of(cp.without_repeats(spark, near, ""))
    assert left[0] == long and left[2] == f"{other} " and left[3] == texts[3][len(passage) :] and left[4] == texts[4]
