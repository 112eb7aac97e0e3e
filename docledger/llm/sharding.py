"""Sharding by a k-d tree over the documents' metadata.

Nodes are split at the weighted (by bytes) median along their widest dimension until
every leaf is one shard. All dimensions are functions of the text alone, and ties are
ordered by a hash of the text, so equal texts always reach the same leaf and no join
is needed. A split is found by distributed histograms that zoom in on the median:
each pass brings at most (nodes x bins) sums to the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_slots, materialise, release

BITS, TIE, BINS = 20, 42, 1024
DIMS = ("d_size", "d_wide", "d_lines")


def _features(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.octet_length(t)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (n + 8).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        (F.xxhash64(t).bitwiseAND(F.lit((1 << TIE) - 1))).alias("tie"),
        F.least(F.lit(1.0), F.log2(n + 1.0) / 32).alias("d_size"),
        ((n - F.char_length(t)) / F.greatest(n, F.lit(1))).alias("d_wide"),
        ((F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit("")))) / F.greatest(n, F.lit(1))).alias("d_lines"),
    )


def _pick(cases: list, column: str = "node"):
    """A CASE over nodes: [(node, value column)]."""
    return reduce(lambda c, x: c.when(F.col(column) == x[0], x[1]), cases[1:], F.when(F.col(column) == cases[0][0], cases[0][1]))


def _cuts(rows: DataFrame, nodes: dict[int, dict], slack: float) -> None:
    """Give each node its ``dim``, ``cut`` (keys below go left) and ``left`` weight."""
    stats = rows.where(F.col("node").isin(list(nodes))).groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)])
    for r in stats.collect():
        v = nodes[r["node"]]
        v["dim"] = max(DIMS, key=lambda d: r[f"max_{d}"] - r[f"min_{d}"])
        lo, hi = r[f"min_{v['dim']}"], r[f"max_{v['dim']}"]
        v |= {"w": r["w"], "lo": lo << TIE, "hi": (hi + 1) << TIE, "below": 0, "open": True}
    for v in nodes.values():
        v.setdefault("open", False)
        v.setdefault("cut", 0)
        v.setdefault("left", 0)
    key = lambda n: (F.shiftleft(F.col(nodes[n]["dim"]), TIE) + F.col("tie"))
    while live := {n: v for n, v in nodes.items() if v["open"]}:
        for v in live.values():
            v["step"] = -(-(v["hi"] - v["lo"]) // BINS)
        inside = rows.where(F.col("node").isin(list(live))).withColumn("key", _pick([(n, key(n)) for n in live]))
        bin_ = _pick([(n, F.when((F.col("key") >= v["lo"]) & (F.col("key") < v["hi"]), F.floor((F.col("key") - v["lo"]) / F.lit(v["step"])) if v["step"] == 1 else F.expr(f"(key - {v['lo']}L) div {v['step']}L"))) for n, v in live.items()])
        sums: dict[int, dict[int, int]] = {}
        for r in inside.withColumn("bin", bin_.cast("long")).where("bin is not null").groupBy("node", "bin").agg(F.sum("size").alias("w")).collect():
            sums.setdefault(r["node"], {})[r["bin"]] = r["w"]
        for n, v in live.items():
            want, acc, at = v["w"] * v["share"], v["below"], None
            for b, w in sorted(sums.get(n, {}).items()):
                if acc + w > want:
                    at = (b, w)
                    break
                acc += w
            if at is None:
                v |= {"cut": v["hi"], "left": acc, "open": False}
                continue
            lo = v["lo"] + at[0] * v["step"]
            if v["step"] == 1 or at[1] <= slack:
                after = acc + at[1] - want < want - acc
                v |= {"cut": lo + (v["step"] if after else 0), "left": acc + at[1] * after, "open": False}
            else:
                v |= {"lo": lo, "hi": min(v["hi"], lo + v["step"]), "below": acc}


def kd_shards(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", tolerance: float = 0.0005) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    ``bytes`` is the law: the sums of ``size`` (UTF-8 bytes + 8) are near equal; a split
    is within ``tolerance`` of a shard's target, or at the border of a group of equal
    texts, which stays whole. Null texts count as empty, repeated rows each get a
    slot, an empty table gives an empty result; other columns are not read."""
    rows = written = materialise(_features(docs, doc_id, text), "features")
    lows = rows.agg(F.sum("size").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)]).first()
    scale = (1 << BITS) - 1
    for d in DIMS:
        lo, hi = lows[f"min_{d}"] or 0.0, lows[f"max_{d}"] or 0.0
        rows = rows.withColumn(d, F.floor((F.col(d) - lo) / F.lit((hi - lo) or 1.0) * scale).cast("long"))
    open_, node, ids = {0: (0, shards)}, F.lit(0), 1
    leaf: dict[int, int] = {} if shards > 1 else {0: 0}
    while open_ and shards > 1:
        at = rows.withColumn("node", node)
        nodes = {n: {"share": (k // 2) / k} for n, (_, k) in open_.items()}
        _cuts(at, nodes, tolerance * (lows["w"] or 0) / shards)
        cases, nxt = [], {}
        for n, (first, k) in open_.items():
            v = nodes[n]
            left, right = v["left"], v.get("w", 0) - v["left"]
            kl = min(range(1, k), key=lambda x: (max(left / x, right / (k - x)), abs(2 * x - k)))  # noqa: B023
            for side, start, count in ((ids, first, kl), (ids + 1, first + kl, k - kl)):
                if count == 1:
                    leaf[side] = start
                else:
                    nxt[side] = (start, count)
            dim = v.get("dim", DIMS[0])
            cases.append((n, F.when(F.shiftleft(F.col(dim), TIE) + F.col("tie") < F.lit(v["cut"]), F.lit(ids)).otherwise(F.lit(ids + 1))))
            ids += 2
        old = node
        new = F.lit(None).cast("int")
        for n, side in cases:
            new = F.when(F.col("_node") == n, side).otherwise(new)
        rows = rows.withColumn("_node", old).withColumn("_node", F.coalesce(new, F.col("_node")))
        rows = materialise(rows, "nodes")
        release(written)
        written = rows
        node, open_ = F.col("_node"), nxt
    pick = _pick([(n, F.lit(s)) for n, s in leaf.items()], "_leaf")
    out = rows.withColumn("_leaf", node).select("doc_id", "size", "text_crc32", pick.cast("int").alias("shard"))
    out = dense_slots(out, ["shard"], ["doc_id"], "slot")
    release(written)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
