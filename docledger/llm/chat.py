"""Chat formatting with minimum-cost role repair.

Legal conversations are the paths of a small automaton: an optional system turn, then
user and assistant turns in alternation, ending with an assistant turn. A dynamic
programme over its states chooses for each given turn whether to keep it, merge it into the turn
before, give it another role, or put an empty turn before it, at the least total cost, and
the repaired sequence is rendered.

The programme runs over blocks of BLOCK turns, so that no conversation has to fit into one
task: a block gives a small (state x state) matrix of least costs, BLOCK matrices in order
combine into one of the level above, and so on up to one for each conversation; on the way
down each block gets its first and last states and is traced back alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, partitions, release

#: State = role of the last turn; START has none.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT, BIG = 2, 5, 4, 1 << 40
BLOCK = 256
Step = tuple[int, tuple[int, ...], bool]  # cost, empty turns put before, merged


def _fills() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest legal sequences of empty turns that lead from a state to where a role may
    follow: (state, role) -> roles of the empty turns."""
    out = {}
    for s in range(4):
        paths = {s: ()}
        todo = [s]
        while todo:
            at = todo.pop(0)
            for r in NEXT[at]:
                if (s, r) not in out:
                    out[s, r] = paths[at]
                if r not in paths:
                    paths[r] = (*paths[at], r)
                    todo.append(r)
    return out


FILLS = _fills()


def moves(role: int) -> dict[tuple[int, int], Step]:
    """For a given turn: (state before, state after) -> the cheapest step. ``role`` 0 is an
    unknown or null role, which has to be given one. Ties: merge, then fewer empty turns."""
    out: dict[tuple[int, int], Step] = {}
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            change = 0 if t == role else RELABEL
            options = [(MERGE + change, (), True)] if s == t else []
            if (s, t) in FILLS:
                options.append((change + INSERT * len(FILLS[s, t]), FILLS[s, t], False))
            if options:
                out[s, t] = min(options, key=lambda x: (x[0], not x[2], len(x[1])))
    return out


MOVES = [moves(r) for r in range(4)]
COST = np.full((4, 4, 4), BIG, np.int64)
for _r, _m in enumerate(MOVES):
    for (_s, _t), _v in _m.items():
        COST[_r, _s, _t] = _v[0]


def close(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and empty turns that make a legal end of a last state."""
    return {START: (0, ()), ASSISTANT: (0, ()), USER: (INSERT, (ASSISTANT,)), SYSTEM: (2 * INSERT, (USER, ASSISTANT))}[state]


def block_costs(roles: list[int]) -> np.ndarray:
    """Least costs from each state before a block to each state after it."""
    total = np.where(np.eye(4, dtype=bool), 0, BIG)
    for r in roles:
        total = np.minimum((total[:, :, None] + COST[r][None]).min(1), BIG)
    return total


def trace(roles: list[int], first: int, last: int) -> list[tuple[int, Step]]:
    """For each turn of a block its new role and step, on a cheapest path from state
    ``first`` to state ``last``; ties go to the smaller previous state."""
    costs = [np.where(np.arange(4) == first, 0, BIG)]
    for r in roles:
        costs.append(np.minimum((costs[-1][:, None] + COST[r]).min(0), BIG))
    out, at = [], last
    for k in range(len(roles) - 1, -1, -1):
        s = int((costs[k] + COST[roles[k], :, at]).argmin())
        out.append((at, MOVES[roles[k]][s, at]))
        at = s
    return out[::-1]


def _places(df: DataFrame) -> DataFrame:
    """Add ``pos``, the turn's place in its conversation, and ``_i``, a row id.

    Turns are range-sorted; a window numbers the stretch of a conversation in one
    partition. Only conversations that lie across partitions need an offset: at most two
    stretches of each partition, whose counts the driver sums up."""
    spark = df.sparkSession
    keys = ["conv_id", "turn", "role", F.xxhash64("text")]  # range bounds are sampled on the driver: no texts there
    laid = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    laid = materialise(laid.withColumn("_pid", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "turns")
    runs = laid.groupBy("_pid", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    wide = runs.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("c"))
    seen: dict = {}
    shifts = []
    for r in sorted(runs.join(wide, F.col("conv_id").eqNullSafe(F.col("c"))).collect(), key=lambda r: r["_pid"]):
        shifts.append((r["_pid"], r["conv_id"], seen.get(r["conv_id"], 0)))
        seen[r["conv_id"]] = seen.get(r["conv_id"], 0) + r["n"]
    shift = F.broadcast(spark.createDataFrame(shifts, "_p int, _c long, _shift long"))
    own = F.row_number().over(Window.partitionBy("_pid", "conv_id").orderBy("_i")) - 1
    placed = laid.withColumn("_own", own).join(shift, (F.col("_pid") == F.col("_p")) & F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    out = materialise(placed.withColumn("pos", F.col("_own") + F.coalesce("_shift", F.lit(0))).drop("_own", "_p", "_c", "_shift", "_pid"), "placed")
    release(laid)
    return out


def _grouped(level: DataFrame, value: str) -> DataFrame:
    """conv_id, up, items: the (at most BLOCK) members of each block, in order."""
    return level.groupBy("conv_id", F.floor(F.col("idx") / BLOCK).alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", value))).alias("items"))


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    r = right.select(F.col("conv_id").alias("_c"), F.col("idx").alias("_k"), "first", "last", "end")
    return left.join(r, left["conv_id"].eqNullSafe(r["_c"]) & (left[key] == r["_k"])).drop("_c", "_k")


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for items in b["items"]:
            total = np.where(np.eye(4, dtype=bool), 0, BIG)
            for x in items:
                total = np.minimum((total[:, :, None] + np.array(x["cost"]).reshape(4, 4)[None]).min(1), BIG)
            out.append(total.ravel().tolist())
        yield pd.DataFrame({"conv_id": b["conv_id"].astype("Int64"), "idx": b["up"], "cost": out})


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        m = [block_costs([x["code"] for x in items]).ravel().tolist() for items in b["items"]]
        yield pd.DataFrame({"conv_id": b["conv_id"].astype("Int64"), "idx": b["up"], "cost": m})


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ends = np.array([close(s)[0] for s in range(4)])
    for b in batches:
        last = [int((np.array(c).reshape(4, 4)[START] + ends).argmin()) for c in b["cost"]]
        yield pd.DataFrame({"conv_id": b["conv_id"].astype("Int64"), "idx": b["idx"], "first": START, "last": last, "end": True})


def _down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last states of the members of blocks with known first and last states."""
    for b in batches:
        out = []
        for conv, items, first, last, end in zip(b["conv_id"].astype("Int64"), b["items"], b["first"], b["last"], b["end"], strict=True):
            mats, best, seen = [np.array(x["cost"]).reshape(4, 4) for x in items], np.where(np.arange(4) == first, 0, BIG), []
            for m in mats:
                seen.append(best)
                best = np.minimum((best[:, None] + m).min(0), BIG)
            at = int(last)
            for k in range(len(mats) - 1, -1, -1):
                before = int((seen[k] + mats[k][:, at]).argmin())
                out.append((conv, items[k]["idx"], before, at, bool(end) and k == len(mats) - 1))
                at = before
        yield pd.DataFrame(out, columns=["conv_id", "idx", "first", "last", "end"]).astype({"conv_id": "Int64"})


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for items, first, last, end in zip(b["items"], b["first"], b["last"], b["end"], strict=True):
            made = trace([x["code"] for x in items], int(first), int(last))
            for k, (x, (role, (_, fill, merged))) in enumerate(zip(items, made, strict=True)):
                final = bool(end) and k == len(items) - 1
                out.append((x["_i"], ROLES[role], [ROLES[y] for y in fill], merged, final, [ROLES[y] for y in close(role)[1]] if final else []))
        yield pd.DataFrame(out, columns=["_i", "new_role", "fill", "merged", "final", "after"])


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos, turn, role (as given), text, new_role, fill (roles of the empty turns
    put before), merged (into the turn before), final, after (roles of empty turns at the end).

    Roles are compared in lower case without outer spaces; null and unknown roles get
    a legal one. Null texts count as empty and stay; turns of equal number go by role and a
    digest of the text; repeated rows are turns of their own; rows without conv_id are one conversation; an
    empty table gives an empty result; other columns are not read."""
    kind = F.lower(F.trim(F.col(role)))
    code = F.when(kind == "system", SYSTEM).when(kind == "user", USER).when(kind == "assistant", ASSISTANT).otherwise(0)
    df = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), code.cast("int").alias("code"))
    placed = _places(df)
    ids = placed.select("conv_id", F.col("pos").alias("idx"), F.struct("_i", "code").alias("v"))
    members = ids.groupBy("conv_id", F.floor(F.col("idx") / BLOCK).alias("up")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"]).alias("items"))
    cost, state = "conv_id long, idx long, cost array<long>", "conv_id long, idx long, first int, last int, end boolean"
    levels = [materialise(members.mapInPandas(_leaves, cost), "costs")]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        levels.append(materialise(_grouped(levels[-1], "cost").mapInPandas(_combine, cost), "costs"))
    states = levels[-1].mapInPandas(_roots, state)
    for level in levels[-2::-1]:
        before, states = states, materialise(_joined(_grouped(level, "cost"), states, "up").mapInPandas(_down, state), "states")
        release(before, level)
    if len(levels) > 1:
        release(levels[-1])  # what is left is read with the result
    steps = _joined(members, states, "up").select("items", "first", "last", "end")
    made = steps.mapInPandas(_steps, "_i long, new_role string, fill array<string>, merged boolean, final boolean, after array<string>")
    return placed.join(made, "_i").select("conv_id", "pos", "turn", "role", "text", "new_role", "fill", "merged", "final", "after")


def render(repaired: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, pos, turn, role, action, inserted, piece: a conversation's string is its
    pieces in the order of pos. As a turn may be merged into the one before, the end mark
    of a turn stands at the head of the next piece that opens a turn."""
    opened = lambda r: F.concat(F.lit(start), r, F.lit("\n"))
    empties = lambda c: F.array_join(F.transform(c, lambda r: F.concat(opened(r), F.lit(f"{end}\n"))), "")
    head = F.when(F.col("pos") == 0, "").otherwise(f"{end}\n")
    piece = F.when(F.col("merged"), F.concat(F.lit("\n"), "text")).otherwise(F.concat(head, empties(F.col("fill")), opened(F.col("new_role")), F.col("text")))
    piece = F.when(F.col("final"), F.concat(piece, F.lit(f"{end}\n"), empties(F.col("after")))).otherwise(piece)
    given = F.lower(F.trim(F.col("role"))) == F.col("new_role")
    action = F.concat_ws("+", F.when(F.col("merged"), "merge"), F.when(~F.coalesce(given, F.lit(False)), "relabel"), F.when(~F.col("merged") & F.coalesce(given, F.lit(False)), "keep"))
    return repaired.select("conv_id", "pos", "turn", F.col("new_role").alias("role"), action.alias("action"), (F.size("fill") + F.size("after")).alias("inserted"), piece.alias("piece"))
