"""Exact deduplication by deterministic block naming.

A text is cut into blocks of ``block_bytes`` bytes of its UTF-8. Equal blocks get one
integer name (the smallest id of an equal block, found by sorting blocks in a window);
then adjacent pairs of names are named in the same way, again and again, until each
document has one name. Names compare contents, not digests, so two documents with
the same number of blocks have the same name exactly when their texts are equal.
Native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, with_group


def block_names(docs: DataFrame, text: str = "text", keep: dict | None = None, block_bytes: int = 4096, used: list | None = None) -> DataFrame:
    """One row per row of ``docs``: a row id ``row``, the columns of ``keep`` (name ->
    expression), and its identity ``n_blocks, name``.

    A null text counts as empty and has one empty block; an empty table gives an empty
    result; repeated rows each keep a row; other columns of ``docs`` are not read. ``used`` gets what
    may be released once the result has been read."""
    keep, used = keep or {}, [] if used is None else used
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length(F.col("_data")) / block_bytes)).cast("int")
    rows = docs.select(data.alias("_data"), *[v.alias(k) for k, v in keep.items()])
    rows = rows.withColumn("n_blocks", blocks)
    total, longest = rows.agg(F.sum("n_blocks"), F.max("n_blocks")).first()
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("pos"))
    first = {k: F.when(F.col("pos") == 0, F.col(k)).alias(k) for k in keep}
    cut = cut.select(
        "row", "n_blocks", "pos", *first.values(), F.monotonically_increasing_id().alias("id"),
        F.substring(F.col("_data"), F.col("pos") * block_bytes + 1, block_bytes).alias("_block"),
    )
    named = with_group(cut, ["_block"], {"name": F.min("id")}, total or 0).drop("_block")
    named = materialise(named, "blocks")
    used.append(named)
    heads = named.where("pos = 0").select("row", "n_blocks", "name", *keep)
    if (longest or 1) == 1:
        return heads
    done, level, width = heads.where("n_blocks = 1"), named.where("n_blocks > 1").select("row", "pos", "id", "name"), longest
    while width > 1:
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy("row", (F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("id"))).alias("id"),
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = materialise(pairs, "pairs")
        before, level = level, with_group(pairs, ["left", "right"], {"name": F.min("id")}, pairs.count()).select("row", "pos", "id", "name")
        level = materialise(level, "level")
        release(pairs, before)
        width = (width + 1) // 2
    used.append(level)
    long = heads.where("n_blocks > 1").drop("name").join(level.select("row", "name"), "row")
    return done.unionByName(long.select(*done.columns))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 4096, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the columns ``more`` for every row of ``docs``.

    Texts are compared unchanged. The row with the largest doc_id of a group stays; if
    several rows have that doc_id, one of them. A null doc_id is the smallest. Null texts count as
    empty; an empty table gives an empty result; other columns are not read."""
    sha = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    used: list[DataFrame] = []
    named = materialise(block_names(docs, text, {"doc_id": F.col(doc_id), "sha": sha, **{c: F.col(c) for c in more}}, block_bytes, used), "named")
    release(*used)
    at = F.struct("doc_id", "row")
    out = with_group(named, ["n_blocks", "name"], {"keep": F.max(at), "group_size": F.count(F.lit(1))}, named.count())
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep") == at).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *more)
