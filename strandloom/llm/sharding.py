"""Resharding by minimum-cost flow: documents of old shards go to new ones of given capacities with the fewest bytes moved.

A document weighs its text's UTF-8 bytes (none where null) and ``OVERHEAD``. How many bytes each old shard sends to
each new one is a transport problem over the shards' sizes alone, solved by successive shortest augmenting paths: a
byte that stays costs nothing, a byte that moves 1, or what ``cost`` says. Documents then follow in blocks. The rows of an
old shard have an order, classes of weight from heavy to light and a hash of id and text within a class, and each new shard
takes a stretch of it: what stays comes first, so that light documents move and cuts fall between light ones.
Cuts are found in a histogram of (old shard, class, bin of the hash), then in the rows of the bins that a cut meets. A
document over 1/64 of an even share of the bytes is placed by itself before the flow, at home where it fits and
else where there is most room; of these there can be at most 64 a shard, whatever the corpus. The room that is left
evens the shards out.

So new shards have sizes as near their capacities as whole documents allow. Only shards that lose or gain rows are
written again, sorted by slot, in files of about ``FILE_BYTES``; rows of the others are read where they lie. Texts move
once, by (shard, file).

Null and negative old shards, and those beyond the new ones' number, are places that are given up: all their rows move.
Equal rows are rows of equal weight and hash and lie on one side of a cut together; which of them has which slot is
arbitrary. Null ids and texts hash like any value, an empty table gives no rows, extra columns travel in the struct ``row``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.layout import scratch_path
from . import common as C

SHARDS, OLD_SHARDS = 40, 32
OVERHEAD = 16
#: A document of more than an even share of the bytes divided by this is placed by itself.
PARTS = 64
#: Bytes of documents a file and a bin aim at; bins that the driver plans with at most.
FILE_BYTES, MOST_BINS = 128 << 20, 1 << 20
UNITS = "old int, cls int, bin long, low long, high long, shard int, file int, place long, first long"


def min_cost_flow(supply: list[int], room: list[int], cost: np.ndarray) -> np.ndarray:
    """Whole units sent from each supplier to each room at the least cost; all of the supply is sent."""
    supply, room = list(map(int, supply)), list(map(int, room))
    if sum(supply) > sum(room):
        raise ValueError("capacities hold less than there is")
    n, m = len(supply), len(room)
    flow = np.zeros((n, m), object)
    cost = np.asarray(cost, float).reshape(n, m)
    while any(supply):
        # shortest ways over the residual graph: there at a cost, back along a flow for its refund
        at_old = np.where(np.array(supply, object) > 0, 0.0, np.inf)
        at_new, from_old, from_new = np.full(m, np.inf), np.full(m, -1), np.full(n, -1)
        sent = (flow > 0).astype(bool)
        while True:
            there = at_old[:, None] + cost
            best = there.argmin(axis=0)
            closer = there[best, np.arange(m)] < at_new - 1e-12
            at_new = np.where(closer, there[best, np.arange(m)], at_new)
            from_old = np.where(closer, best, from_old)
            back = np.where(sent, at_new[None, :] - cost, np.inf)
            best = back.argmin(axis=1)
            nearer = back[np.arange(n), best] < at_old - 1e-12
            at_old = np.where(nearer, back[np.arange(n), best], at_old)
            from_new = np.where(nearer, best, from_new)
            if not nearer.any():
                break
        j = min((x for x in range(m) if room[x]), key=lambda x: (at_new[x], x))
        path, end, amount = [], j, room[j]
        while True:
            i = int(from_old[j])
            path.append((i, j, 1))
            if from_new[i] < 0:
                break
            j = int(from_new[i])
            path.append((i, j, -1))
            amount = min(amount, flow[i, j])
        amount = min(amount, supply[i])
        for a, b, sign in path:
            flow[a, b] += sign * amount
        supply[i] -= amount
        room[end] -= amount
    return flow


def rooms(total: int, taken: list[int], capacity: list[int]) -> list[int]:
    """``total`` dealt over shards that hold ``taken``, so that those which get any are full to the same share of their capacity."""
    order = sorted((t / c, j) for j, (t, c) in enumerate(zip(taken, capacity, strict=True)) if c)
    if not order:
        return [0] * len(taken)
    level = 0.0
    have = held = 0
    for n, (share, j) in enumerate(order, 1):
        have, held = have + capacity[j], held + taken[j]
        level = (total + held) / have
        if n == len(order) or level <= order[n][0]:
            break
    out = [0] * len(taken)
    for _, j in order[:n]:
        out[j] = max(0, int(level * capacity[j]) - taken[j])
    spare = total - sum(out)
    for k in range(abs(spare)):  # what rounding left over, a byte a shard
        j = order[k % n][1]
        out[j] = max(0, out[j] + (1 if spare > 0 else -1))
    out[order[0][1]] += total - sum(out)
    return out


def equal_shares(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


class Plan:
    """Where rows of old shards go: a table of stretches (``UNITS``), of at most ``MOST_BINS`` bins and what cuts add."""

    def __init__(self, units: pd.DataFrame, limit: int, bits: int, flow: np.ndarray, unmoved: list[int]):
        self.units, self.limit, self.bits, self.flow, self.unmoved = units, limit, bits, flow, unmoved

    def keys(self) -> dict[str, Column]:
        """Of rows with ``old``, ``size`` and ``h``: the keys that lead to a stretch."""
        cls = F.length(F.bin("size")).cast("int")
        return {"cls": F.when(F.col("size") > self.limit, -cls).otherwise(cls), "bin": F.shiftright("h", 63 - self.bits)}


def weight(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def plan(thin: DataFrame, shards: int, capacity: list[int] | None = None, cost: np.ndarray | None = None, file_bytes: int = FILE_BYTES) -> Plan:
    """The stretches of stored rows (old, size, h). ``cost``: of a byte from each old shard, by number, to each new one."""
    size_of = {r.old: int(r.b) for r in thin.groupBy("old").agg(F.sum("size").cast("decimal(38,0)").alias("b")).collect()}
    total, olds = sum(size_of.values()), sorted(size_of)
    capacity = list(capacity) if capacity is not None else equal_shares(total, shards)
    if len(capacity) != shards or sum(capacity) < total:
        raise ValueError("capacities hold less than there is")
    limit = total // (PARTS * shards)
    home = {i: i for i in olds if 0 <= i < shards}
    p = Plan(pd.DataFrame(), limit, 4, np.zeros((0, 0), object), [])

    # heavy documents, one by one: their number has a bound, since each is over ``limit``
    heavy = thin.where(F.col("size") > limit).groupBy("old", "h", "size").count().withColumns(p.keys())
    taken, units = [0] * shards, []
    for r in sorted(heavy.collect(), key=lambda r: (-r["size"] * r["count"], r["h"], r["old"])):
        w, j = r["size"] * r["count"], home.get(r["old"])
        if j is None or taken[j] + w > capacity[j]:
            j = max(range(shards), key=lambda x: (capacity[x] - taken[x], -x))
        taken[j] += w
        size_of[r["old"]] -= w
        units.append((r["old"], r["cls"], r["h"], r["h"] - 1, r["h"], j, w, r["count"]))

    rest = [size_of[i] for i in olds]
    cost = np.array([[0 if home.get(i) == j else 1 for j in range(shards)] for i in olds]) if cost is None else np.array([np.asarray(cost)[i] if i >= 0 else np.ones(shards) for i in olds])
    p.flow = min_cost_flow(rest, rooms(sum(rest), taken, capacity), cost)

    # bins: as fine as a file wherever the driver's table allows
    light = thin.where(F.col("size") <= limit)
    classes = max(1, len(bin(limit)) - 2 - 4)
    want = max([0, *rest]) / (max(1, file_bytes) / 2)
    p.bits = int(min(max(4, np.ceil(np.log2(max(1, want)))), max(4, np.floor(np.log2(MOST_BINS / max(1, len(olds) * classes))))))
    bins = light.withColumns(p.keys()).groupBy("old", "cls", "bin").agg(F.sum("size").alias("b"), F.count("*").alias("n")).toPandas()
    bins = bins.sort_values(["old", "cls", "bin"], ascending=[True, False, True]).reset_index(drop=True)
    cuts, runs = [], []
    for k, i in enumerate(olds):
        own = bins[bins["old"] == i]
        end = own["b"].to_numpy(np.int64).cumsum()
        goal, at = [], 0
        for j in sorted(range(shards), key=lambda j: (j != home.get(i), j)):
            if p.flow[k, j]:
                at += int(p.flow[k, j])
                goal.append((j, at))
        runs.append((own, end, goal))
        for j, at in goal[:-1]:
            x = int(np.searchsorted(end, at))
            cuts.append((i, int(own["cls"].iloc[x]), int(own["bin"].iloc[x]), j, at - (int(end[x - 1]) if x else 0)))
    placed = _cut_places(light, p, cuts)
    for i, (own, end, goal) in zip(olds, runs, strict=True):
        inside = defaultdict(list)
        for c in (c for c in cuts if c[0] == i):
            inside[c[1:3]].append(c)
        target = iter([j for j, _ in goal])
        j = next(target, None)
        for cls, b, size, n in own[["cls", "bin", "b", "n"]].itertuples(index=False):
            low, b0, n0 = -1, 0, 0
            for c in inside.get((cls, b), ()):
                high, left, rows = placed.get((i, c[3]), (-1, 0, 0))
                units.append((i, cls, b, low, max(low, high), j, left - b0, rows - n0))
                low, b0, n0 = max(low, high), left, rows
                j = next(target)
            units.append((i, cls, b, low, (1 << 63) - 1, j, size - b0, n - n0))
    p.units, p.unmoved = _files(units, shards, olds, file_bytes, p.bits)
    return p


def _cut_places(light: DataFrame, p: Plan, cuts: list[tuple]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For each cut (old, cls, bin, shard before it, bytes of the bin before it): the last hash before it, and the bytes and
    rows of the bin up to there. A row lies before the cut that its middle lies before."""
    if not cuts:
        return {}
    spark = light.sparkSession
    told = spark.createDataFrame(cuts, "old int, cls int, bin long, shard int, at long")
    keys = ["old", "cls", "bin"]
    rows = light.withColumns(p.keys()).join(F.broadcast(told.select(keys).distinct()), keys, "left_semi")
    rows = rows.groupBy(*keys, "h").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("h")
    rows = rows.withColumns({"to_b": F.sum("b").over(upto), "to_n": F.sum("n").over(upto)})
    met = rows.join(F.broadcast(told), keys).where(2 * F.col("to_b") - F.col("b") <= 2 * F.col("at"))
    found = met.groupBy("old", "shard").agg(F.max("h").alias("h"), F.max("to_b").alias("b"), F.max("to_n").alias("n"))
    return {(r["old"], r["shard"]): (r["h"], r["b"], r["n"]) for r in found.collect()}


def _files(units: list[tuple], shards: int, olds: list[int], file_bytes: int, bits: int) -> tuple[pd.DataFrame, list[int]]:
    """The stretches with their files and the files' first slots, and the shards whose rows are as they were."""
    frame = pd.DataFrame(units, columns=["old", "cls", "bin", "low", "high", "shard", "b", "n"]).astype(np.int64)
    frame = frame[frame["n"] > 0]
    heavy = frame["cls"] < 0
    frame.loc[heavy, "bin"] = frame.loc[heavy, "bin"].to_numpy(np.int64) >> (63 - bits)
    frame = frame.assign(stays=frame["old"] != frame["shard"]).sort_values(["shard", "stays", "old", "cls", "bin", "low"]).reset_index(drop=True)
    before = frame.groupby("shard")[["b", "n"]].cumsum() - frame[["b", "n"]]
    frame["file"] = before["b"] // file_bytes
    frame["place"] = frame.index
    frame["first"] = before["n"].groupby([frame["shard"], frame["file"]]).transform("min")
    changed = set(frame.loc[frame["old"] != frame["shard"], "shard"]) | set(frame.loc[frame["old"] != frame["shard"], "old"])
    return frame, [j for j in range(shards) if j in olds and j not in changed]


def reshard(docs: DataFrame, old: Column, shards: int, capacity: list[int] | None = None, cost: np.ndarray | None = None, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> tuple[DataFrame, Plan]:
    """Rows (row, size, old, shard, slot) as they are stored after the change, and the plan: rows of changed
    shards from their new files, those of the others from where they were."""
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    h = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).bitwiseAND((1 << 63) - 1)
    weighed = docs.select(row.alias("row"), F.coalesce(old.cast("int"), F.lit(-1)).alias("old"), weight(F.col(f"`{text}`")).alias("size"), h.alias("h"))
    p = plan(C.written(weighed.drop("row"), "weights", in_few=True), shards, capacity, cost, file_bytes)
    fields = [x.split()[0] for x in UNITS.split(", ")]
    units = spark.createDataFrame([tuple(map(int, u)) for u in p.units[fields].itertuples(index=False)], UNITS)
    met = weighed.withColumns(p.keys()).join(F.broadcast(units), ["old", "cls", "bin"]).where("h > low and h <= high")
    within = Window.partitionBy("shard", "file").orderBy("place", "h", F.col(f"row.`{key}`"))
    dealt = met.repartition("shard", "file").withColumn("slot", F.col("first") + F.row_number().over(within) - 1)
    dealt = dealt.select("row", "size", "old", "slot", "shard")
    path = scratch_path(spark, "shards")
    if C.Scratch._open:
        C.Scratch._open[-1].paths.append(path)
    changed = dealt.where(~F.col("shard").isin(p.unmoved)) if p.unmoved else dealt
    changed.write.partitionBy("shard").parquet(path)
    stored = spark.read.schema(changed.schema).parquet(path)
    return stored.unionByName(dealt.where(F.col("shard").isin(p.unmoved))) if p.unmoved else stored, p


def op12_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout is by source, crc32 of it modulo 32, so that one shard has a third of the rows; the new one has 40
    shards of equal bytes. What is returned is computed from the files written."""
    old = F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")) % OLD_SHARDS
    stored, _ = reshard(C.table(spark, sf_dir, "documents"), old, SHARDS)
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
    return stored.select("row.doc_id", weight(F.col("row.text")).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))
