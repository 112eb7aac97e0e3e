"""A pluggable model stage: any callable from text to JSON, one client per partition."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..sources.store import Keyed

SCHEMA = "doc_id long, payload string, input_tokens int, output_tokens int, error string"
Extractor = Callable[[str], tuple[str, int, int]]


def run(texts: DataFrame, make: Callable[[], Extractor]) -> DataFrame:
    """doc_id, payload, input_tokens, output_tokens, error. Write the result before it is used twice, so
    that each text is sent once; a failing text is a row with an error."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = make()
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                try:
                    out.append((doc, *extract(text or ""), None))
                except Exception as e:  # noqa: BLE001  a model's failure is data here
                    out.append((doc, None, 0, 0, str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "payload", "input_tokens", "output_tokens", "error"])

    return texts.select("doc_id", "text").mapInPandas(each, SCHEMA)


def results(spark: SparkSession, path: str) -> Keyed:
    """The table of answers at ``path``, by text."""
    return Keyed(spark, path, ("doc_id",), spark.createDataFrame([], SCHEMA).schema)


def landed(texts: DataFrame, make: Callable[[], Extractor], table: Keyed) -> DataFrame:
    """``run`` on the texts that have no answer in ``table`` yet; the answers to all of ``texts``.

    Answers are written once, as one job: a run that breaks off writes none and may send its texts again; after that no
    text is sent again, also none that failed (delete its answer to try it anew). Texts without an id have no
    answer."""
    asked = texts.where("doc_id is not null").dropDuplicates(["doc_id"])
    table.append(run(table.missing(asked), make))
    return table.of(asked).drop("bucket").join(asked.select("doc_id"), "doc_id", "left_semi")


def patterns() -> Extractor:
    """An extractor without a model: total and items by the patterns of ``fields``."""
    flags = re.ASCII | re.IGNORECASE
    plain, european, last = ([re.compile(p, flags) for p in group] for group in (fields.PLAIN_TOTALS, fields.EUROPEAN_TOTALS, fields.LAST_TOTALS))
    lines = [(re.compile(fields.ITEM, re.ASCII), 2), (re.compile(fields.ITEM_DOLLAR, re.ASCII), 2), (re.compile(fields.ITEM_MARK, flags), 2), (re.compile(fields.ITEM_SPLIT, re.ASCII), 3)]

    def total(text: str) -> float | None:
        for p in (*plain, *european, *last):
            if m := p.search(text):
                x = m[1].replace(",", "") if p not in european else m[1] if "." in m[1] else m[1].replace(",", ".")
                with suppress(ValueError):  # then the next pattern is tried
                    return float(x)
        return None

    def extract(text: str) -> tuple[str, int, int]:
        items = []
        for line in text.split("\n"):
            for p, price in lines:
                if m := p.search(line.strip()):
                    items.append({"description": m[1], "price": float(m[price])})
                    break
        payload = json.dumps({"total": total(text), "items": items}, ensure_ascii=False)
        return payload, len(text.split()), len(payload.split())

    return extract


def by_rules(texts: DataFrame) -> DataFrame:
    """The columns of ``run`` from the field expressions alone: a payload without a model."""
    words = lambda c: F.size(F.array_remove(F.split(c, r"\s+"), ""))
    found = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("f", fields.all_fields(F.col("text")))
    priced = F.transform("f.items", lambda x: F.struct(x["description"].alias("description"), x["price"].alias("price")))
    made = found.withColumn("payload", F.to_json(F.struct(F.col("f.total").alias("total"), priced.alias("items"))))
    return made.select("doc_id", "payload", words(F.col("text")).alias("input_tokens"), words(F.col("payload")).alias("output_tokens"), F.lit(None).cast("string").alias("error"))
