"""Queries about files, streams and the pluggable model stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stage
from ..sources import files
from ..sources.store import shared
from ..streaming import ingest
from .registry import query
from .text_queries import LINES, TOTAL


@query("SRC1")
def file_scan(v):
    """The given tables' own files stand for images, by their extension."""
    return files.scan(v.spark, v.sf_dir, ("parquet",)).select("name", "extension", "length")


@query("SRC2")
def strict_scan(v):
    """Of several given paths those that exist."""
    paths = [f"{v.sf_dir}/{name}.parquet" for name in ("documents", "not_there", "labels")]
    return files.scan(v.spark, paths, ("parquet",), recursive=False).select("name", "length")


@query("SRC3")
def metadata(v):
    f = files.scan(v.spark, v.sf_dir, ("parquet",))
    return f.select("name", "extension", "length", (F.col("length") > 0).alias("is_file"), F.round(F.col("length") / 1024.0, 1).alias("kb"))


@query("HSH1")
def file_digest(v):
    """Digests of the given tables' files, and of a path where there is none."""
    lost = files.digests_of(v.spark, [f"{v.sf_dir}/not_there.png"])
    return files.digests(files.scan(v.spark, v.sf_dir, ("parquet",))).unionByName(lost)


@query("STR1", "SELECT sha256(CAST(o_orderkey % 5000 AS VARCHAR)) AS hash, min(o_orderkey) AS id FROM orders GROUP BY 1")
def incremental(v):
    """Orders as they arrive, saved once per hash; the job runs twice and the second run adds nothing."""
    rows = lambda: ingest.read_stream(v.spark, f"{v.sf_dir}/orders.parquet").select(F.sha2((F.col("o_orderkey") % 5000).cast("string"), 256).alias("hash"), F.col("o_orderkey").alias("id"))
    table, checkpoint = ingest.ledger(v.spark, shared(v.spark, "ledger"), ("hash",), rows().schema), shared(v.spark, "stream")
    for _ in range(2):
        ingest.ingest(rows(), table, checkpoint, "id")
    return table.rows().select("hash", "id")


@query("STR2", "SELECT DISTINCT user_id, event_type FROM events")
def suppression(v):
    """Kinds of events by user, once: within an hour by state, for good by the ledger."""
    rows = ingest.read_stream(v.spark, f"{v.sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    table = ingest.ledger(v.spark, shared(v.spark, "events"), ("user_id", "event_type"), rows.schema)
    ingest.ingest(ingest.suppressed(rows, "ts", "1 hour", ["user_id", "event_type"]), table, shared(v.spark, "stream"), "ts")
    return table.rows().select("user_id", "event_type")


@query("UDF1", f"SELECT s.doc_id, {TOTAL} AS total, n AS n_items, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS input_tokens, CAST(1 AS BIGINT) AS sent, TRUE AS success FROM slips s JOIN (SELECT doc_id, count(description) AS n FROM found GROUP BY 1) USING (doc_id)", LINES)
def model_stage(v):
    """The stage with an extractor of patterns; it runs twice, and the second run finds all texts answered."""
    table = stage.results(v.spark, shared(v.spark, "answers"))
    for _ in range(2):
        r = stage.landed(v.slips, stage.patterns, table)
    total, items = F.get_json_object("payload", "$.total").try_cast("double"), F.from_json(F.get_json_object("payload", "$.items"), "array<string>")
    counts = r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sent"))
    shown = r.select("doc_id", total.alias("total"), F.size(items).cast("long").alias("n_items"), F.col("input_tokens").cast("long").alias("input_tokens"), F.col("error").isNull().alias("success"))
    return shown.join(counts, "doc_id")
