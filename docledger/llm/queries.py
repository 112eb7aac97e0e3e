"""The training-data queries, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import chat, language, toxicity
from .bpe import round_trip_digests
from .common import documents
from .exact_dedup import exact_duplicates
from .media import media_columns
from .negatives import hard_negatives
from .ngram_join import jaccard_components
from .packing import pack
from .repeats import repeats_and_passages
from .sharding import kd_shards
from .suffix_trees import remove_repeated_passages
from .whitening import whiten


def remainder(n, doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language.fit(docs, remainder(3) != 1, sample_rows=3000)
    return language.predict(docs, model, remainder(3) == 1)


def op2_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, remainder(5) != 0, sample_rows=8000)
    return toxicity.score(docs, model, remainder(5) == 0)


def op3_ngram_jaccard(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir), n=3, percent=90)


def op4_chat_format(spark, sf_dir):
    return chat.render(chat.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op5_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir), vocabulary(), window=2048)


def op6_repeats(spark, sf_dir):
    return repeats_and_passages(documents(spark, sf_dir), length=400, passage=51).drop("kept")


def op9_media(spark, sf_dir):
    return media_columns(documents(spark, sf_dir))


def op10_bpe(spark, sf_dir):
    return round_trip_digests(documents(spark, sf_dir), vocabulary())


def op7_kd_tree_sharding(spark, sf_dir):
    return kd_shards(documents(spark, sf_dir), shards=24)


def op8_exact_dedup(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir))


def op11_suffix_trees(spark, sf_dir):
    return remove_repeated_passages(documents(spark, sf_dir), length=35).drop("kept")


def op12_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_ngram_jaccard, op4_chat_format, op5_packing, op6_repeats, op7_kd_tree_sharding, op8_exact_dedup, op9_media, op10_bpe, op11_suffix_trees, op12_whitening, op13_hard_negatives)}

ORACLES = {
    "op3_ngram_jaccard": r"""
        WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM words),
        sizes AS (SELECT doc_id, len(g) AS n FROM sets), grams AS (SELECT doc_id, unnest(g) AS g FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
        SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id FROM sizes s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n""",
    "op8_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
              FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
    "op11_suffix_trees": r"""
        WITH texts AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM texts WHERE len(w) >= 35)),
        again AS (SELECT doc_id, i FROM windows WHERE g IN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM texts) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256,
               coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = texts.doc_id AND NOT EXISTS (SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.p = g.p - 1)), 0) AS n_spans
        FROM texts LEFT JOIN kept USING (doc_id)""",
    "op13_hard_negatives": """
        WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
                      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::BIGINT AS score FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER band::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW band AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER band <= 5""",
}
