"""A corpus pipeline: what is toxic goes, then exact copies, near copies and passages
that repeat across documents; the rest is packed into training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's documents. Null
texts count as empty. Rows are told apart by a row id of the stage's own: doc_id may be null or
repeat, and only orders the copies of a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.llm import toxicity
from docledger.llm.common import delete, documents, only, rowed, scratch
from docledger.llm.exact_dedup import exact_duplicates
from docledger.llm.ngram_join import jaccard_components
from docledger.llm.packing import pack
from docledger.llm.queries import remainder, vocabulary
from docledger.llm.repeats import merged, repeat_spans

#: Near copies: five-word shingles, similarity of 0.8 or more. Repeats: passages of more than 50
#: words, however short these are, and strings of 400 bytes (scripts without spaces).
WORDS, PERCENT, PASSAGE, REPEAT, WINDOW, SAMPLE = 5, 80, 51, 400, 2048, 8000


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labelled rows of ``docs``, scores below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels, remainder(5) != 0, sample_rows=SAMPLE))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    rows, row = rowed(docs)
    return only(rows, exact_duplicates(rows, more=(row,)).where("kept"), row).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    rows, row = rowed(docs)
    found = jaccard_components(rows, n=WORDS, percent=PERCENT, doc_id=row).select(F.col("doc_id").alias(row), "component_id")
    named = found.join(rows.select(row, "doc_id"), row)
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first"))
    return only(rows, first.select(f"first.{row}"), row).select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of PASSAGE words and strings of REPEAT bytes that occur
    elsewhere; a character that loses some of its bytes goes. n_chars is counted anew where a text
    changed."""
    rows, row = rowed(docs)
    passages = repeat_spans(rows, PASSAGE, words=True, doc_id=row).select(F.col("doc_id").alias("row"), F.col("spans").alias("passages"))
    strings = repeat_spans(rows, REPEAT, doc_id=row).select(F.col("doc_id").alias("row"), F.col("spans").alias("strings"))
    given = [F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)]
    spans = passages.join(strings, "row", "full_outer")
    both = rows.select(F.col(row).alias("row"), *given).join(spans, "row", "left").drop("row")
    at = {c: k for k, c in enumerate(docs.columns) if c in ("text", "n_chars")}
    schema = T.StructType([T.StructField(f"_{k}", f.dataType) for k, f in enumerate(docs.schema)])
    cut = both.mapInArrow(partial(_cut, at["text"], at.get("n_chars")), schema)
    return cut.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def _cut(text: int, count: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without their last two columns, lists of spans: texts lose these, each widened to whole
    characters, and their number of characters is counted anew."""
    for b in batches:
        for k in range(0, b.num_rows, 128):
            part = b.slice(k, 128)
            columns = part.columns[:-2]
            texts = part.column(text).to_pylist()
            sizes = None if count is None else part.column(count).to_pylist()
            for i, lists in enumerate(zip(*(c.to_pylist() for c in part.columns[-2:]), strict=True)):
                if any(lists):
                    at, kept, data = 0, [], (texts[i] or "").encode()
                    for p, q in merged([_whole(data, x["from"], x["end"]) for spans in lists for x in spans or []]):
                        kept.append(data[at:p])
                        at = q
                    texts[i] = b"".join([*kept, data[at:]]).decode()
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            columns[text] = pa.array(texts, part.column(text).type)
            if sizes is not None:
                columns[count] = pa.array(sizes, part.column(count).type)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-2])


def _whole(data: bytes, p: int, q: int) -> tuple[int, int]:
    """[p, q) with all bytes of the characters that it has some bytes of."""
    while 0 < p < len(data) and data[p] & 0xC0 == 0x80:
        p -= 1
    while q < len(data) and data[q] & 0xC0 == 0x80:
        q += 1
    return p, q


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, one row each."""
    return pack(docs, vocabulary(), window=WINDOW)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard", without_near_copies),
    ("repeats", without_repeats),
    ("packing", packed),
]

#: Trained models, similarity joins and tokenisation have no SQL form; tests/llm holds
#: the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
