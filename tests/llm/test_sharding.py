import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import common as C
from strandloom.llm import sharding as S


def cheapest(supply, room, cost):
    """All ways to deal the supply out, by their least cost."""
    best = {tuple(room): 0}
    for i, s in enumerate(supply):
        nxt = {}
        for left, spent in best.items():
            for give in product(*[range(min(s, x) + 1) for x in left]):
                if sum(give) == s:
                    k, c = tuple(x - g for x, g in zip(left, give)), spent + sum(g * cost[i][j] for j, g in enumerate(give))
                    nxt[k] = min(c, nxt.get(k, 1e9))
        best = nxt
    return min(best.values())


def test_flow_is_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(25):
        n, m = rng.integers(1, 5), rng.integers(1, 4)
        supply = rng.integers(0, 5, n).tolist()
        room = rng.integers(0, 6, m).tolist()
        cost = rng.integers(0, 6, (n, m))
        if sum(supply) > sum(room):
            with pytest.raises(ValueError):
                S.min_cost_flow(supply, room, cost)
            continue
        flow = S.min_cost_flow(supply, room, cost)
        assert flow.sum(axis=1).tolist() == supply and all(a <= b for a, b in zip(flow.sum(axis=0), room)) and (flow >= 0).all()
        assert (flow * cost).sum() == cheapest(supply, room, cost)


def test_rooms_even_shards_out():
    for total, taken, capacity in ((100, [0, 0, 0], [10, 10, 10]), (7, [90, 0, 3], [30, 30, 30]), (0, [5, 0], [1, 1]), (10**6 + 1, [10, 10**6, 4, 0], [1, 3, 2, 2])):
        got = S.rooms(total, taken, capacity)
        assert sum(got) == total and min(got) >= 0
        full = [(t + g) / c for t, g, c in zip(taken, got, capacity) if g > len(taken)]
        assert not full or max(full) - min(full) <= len(taken) / min(capacity)


def corpus(n=3000):
    rng = np.random.default_rng(7)
    rows = [(int(i), "é" * int(rng.integers(0, 120)) if i % 50 else "long " * int(rng.integers(200, 400)), "hot" if rng.random() < 0.6 else f"s{i % 9}") for i in range(n)]
    rows += [(None, None, None), (None, "x", "s1"), (None, "x", "s1"), (7, "y", ""), (8, "", "hot"), (9, None, "hot")]
    return rows + [(10_000 + i, "the same text again", "hot") for i in range(1000)]


def held(rows, got):
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted((r.row.doc_id is None, r.row.doc_id or 0, r.row.text or "", r.row.text is None) for r in got) == sorted((i is None, i or 0, t or "", t is None) for i, t, _ in rows)
    assert all(r.size == len((r.row.text or "").encode()) + 16 for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_equal_shards_and_few_bytes_moved(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("shard", "size", "old", "h", "bin")})
    old = F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 32
    stored, plan = S.reshard(df.repartition(3), old, 10, file_bytes=20_000)
    got = stored.collect()
    sizes = held(rows, got)
    total, most = sum(sizes.values()), max(len((t or "").encode()) + 16 for _, t, _ in rows)
    assert max(sizes.values()) - min(sizes.values()) <= total / 10 / S.PARTS + 32
    had = defaultdict(int)
    for _, t, s in rows:
        had[zlib.crc32((s or "").encode()) % 32] += len((t or "").encode()) + 16
    least = sum(max(0, b - (total // 10 if i < 10 else 0)) for i, b in had.items())
    moved = sum(r.size for r in got if r.old != r.shard)
    assert least - most <= moved <= least + 12 * total / 10 / S.PARTS
    light = sum(f for i, row in zip(sorted(had), plan.flow) for j, f in enumerate(row) if i != j)
    assert light <= least


def test_only_changed_shards_are_written(spark):
    """Shard 0 is over its capacity, shard 3 under; 1 and 2 keep their files."""
    rows = [(i, "t" * 50, str(i % 4 if i < 800 else 0)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    with C.Scratch(spark) as scratch:
        stored, plan = S.reshard(df, F.col("source").cast("int"), 4, [400 * 66, 200 * 66, 200 * 66, 400 * 66])
    assert plan.unmoved == [1, 2]
    sizes = held(rows, stored.collect())
    assert [round(sizes[j] / 66) for j in range(4)] == [400, 200, 200, 400]
    written = spark.read.parquet(next(p for p in scratch.paths if "/shards-" in p))
    assert {r.shard for r in written.select("shard").distinct().collect()} == {0, 3}
    assert stored.where("old <> shard").count() == 200 and stored.where("shard in (1, 2) and old <> shard").count() == 0


def test_documents_beyond_a_share_few_rows_and_none(spark):
    rows = [(1, "a" * 5000, "x"), (2, "b" * 400, "x"), (3, "c" * 400, "x"), (4, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stored, _ = S.reshard(df, F.lit(None), 3)
    sizes = held(rows, stored.collect())
    assert sorted(sizes.values()) == [416, 432, 5016]
    empty, _ = S.reshard(df.limit(0), F.lit(0), 3)
    assert empty.collect() == []
    with pytest.raises(ValueError):
        S.reshard(df, F.lit(0), 2, [10, 10])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = S.op12_resharding(spark, sf).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 16, zlib.crc32(docs[r.doc_id]), "bytes", None)
    assert all(0 <= s < 40 and sorted(x) == list(range(len(x))) for s, x in slots.items())
