"""Pattern lists by automaton and long sequences in chunks, against pattern-by-pattern search of whole records."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom import schema
from strandloom.operators import patterns as P
from strandloom.operators import search

LETTERS = "ACGT"


def record(i, seq, name=None):
    name = name or f"s{i}"
    return ("f", 0, i, name, "", name, seq, None)


def genome(n, seed=1, letters="ACGTacgtNU"):
    rng = random.Random(seed)
    return "".join(rng.choices(letters, weights=[9] * 4 + [1] * (len(letters) - 4), k=n))


def some_patterns(text, n, seed=2, low=5, high=14):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        k = rng.randrange(low, high)
        a = rng.randrange(len(text) - k)
        p = text[a : a + k] if i % 2 else "".join(rng.choices("ACGT", k=k))
        out[f"p{i}"] = p if i % 5 else p[: k // 2] + "RNY"[i % 3] + p[k // 2 + 1 :]
    return out | {"short": "GC", "one": "N", "again": out["p1"]}


@pytest.mark.parametrize("how", [{}, {"mismatches": 1}, {"mismatches": 3}, {"degenerate": True}, {"ignore_case": True}, {"ignore_case": True, "degenerate": True}, {"ignore_case": True, "mismatches": 2}, {"circular": True}])
@pytest.mark.parametrize("greedy", [True, False])
def test_automaton_equals_single_searches(how, greedy):
    text = genome(700)
    items = list(some_patterns(text, 40).items())
    told = search._searcher(items, True, greedy, **how)
    want = [h for name, p in items for h in search.find_all(text, name, p, greedy=greedy, **how)]
    key = lambda h: tuple(h.values())
    assert sorted(map(key, told(text))) == sorted(map(key, want)) and want
    assert list(told("")) == [] and P.Patterns([]).within("ACGT") is False


def test_ten_thousand_patterns(spark, monkeypatch):
    text = genome(3000, letters="ACGT")
    rows = [record(i, text[i * 30 : i * 30 + 60]) for i in range(90)] + [record(90, ""), record(91, None), record(92, "TTTTTTTTTTTT")]
    df = spark.createDataFrame(rows, schema.RECORD).repartition(3)
    rng = random.Random(3)
    listed = ["".join(rng.choices("ACGT", k=16)) for _ in range(9_990)] + [text[a : a + 16] for a in (35, 400, 1234)] + [search.iupac.revcomp(text[2000:2016])]
    want = sorted(r[3] for r in rows if r[6] and any(p in r[6] or p in search.iupac.revcomp(r[6]) for p in listed))
    assert sorted(r.id for r in search.grep(df, listed, by_seq=True).select("id").collect()) == want and 4 <= len(want) < 20
    assert search.grep(df, listed, by_seq=True, invert=True).count() == len(rows) - len(want)
    monkeypatch.setattr(P, "LETTERS", 16 * 5000)
    assert len(P.shards(listed)) == 2 and sorted(r.id for r in search.grep(df, listed, by_seq=True).select("id").collect()) == want
    expressions = [f"^s{i}[05]$" for i in range(10)] + ["^(s)1\\1$", "x{3}"]
    assert sorted(r.id for r in search.grep(df, expressions, key="id", regex=True).collect()) == sorted(r[3] for r in rows if r[3][1:] in {f"{i}{j}" for i in range(10) for j in (0, 5)})


@pytest.mark.parametrize("how", [{}, {"mismatches": 2}, {"degenerate": True, "ignore_case": True}, {"circular": True}, {"circular": True, "only_positive": True, "mismatches": 1}])
def test_rows_are_equal_for_every_chunk_length(spark, how):
    rows = [record(i, genome(n, seed=n)) for i, n in enumerate((1, 5, 97, 400))] + [record(9, ""), record(10, None)]
    df = spark.createDataFrame(rows, schema.RECORD)
    items = some_patterns(rows[3][6], 12)
    want = sorted(map(tuple, search.locate(df, items, **how).collect()))
    assert len(want) > 50
    for chunk in (1, 7, 64, 400, 10_000):
        assert sorted(map(tuple, search.locate(df, items, chunk=chunk, **how).collect())) == want, chunk


def test_a_long_record_is_spread_over_tasks(spark):
    text = genome(3_000_000, letters="ACGT")
    df = spark.createDataFrame([record(0, text)], schema.RECORD)
    hits = search.locate(df, {"p": "GATTACAGA"}, chunk=50_000)
    got = hits.select("start", "strand", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.start, r.strand) for r in got) == sorted((h["start"], h["strand"]) for h in search.find_all(text, "p", "GATTACAGA"))
    with pytest.raises(ValueError):
        search.locate(df, {"p": "A+"}, chunk=10, regex=True)


@pytest.mark.parametrize("fold", [False, True])
def test_lists_with_mismatches_are_compared_as_arrays(spark, monkeypatch, fold):
    """All patterns at once, in whole words of eight letters and parts of one, in two shards, beside a text of wide letters."""
    text = genome(900)
    rng = random.Random(5)
    items = {f"p{i}": text[a : a + k] for i, (a, k) in enumerate((rng.randrange(800), k) for k in (3, 7, 8, 12, 16, 17, 40, 12, 15, 24))}
    told = P.Patterns(list(items.values()), 2, ignore_case=fold)
    low = text.lower() if fold else text
    want = [(i, a) for i, p in enumerate(told.patterns) for a in search.hamming_places(low.encode(), p.encode(), 2).tolist()]
    monkeypatch.setattr(P, "HITS", 50)
    monkeypatch.setattr(P, "PAIRS", 20)
    assert list(zip(*(x.tolist() for x in told.near(text)))) == want
    monkeypatch.setattr(P, "LETTERS", 60)
    rows = [record(1, text), record(2, "ACGTé" + text[:50]), record(3, "")]
    got = search.locate(spark.createDataFrame(rows, schema.RECORD), items, mismatches=2, ignore_case=fold).collect()
    hits = [(r[3], *h.values()) for r in rows for n, p in items.items() if r[6].isascii() for h in search.find_all(r[6], n, p, mismatches=2, ignore_case=fold)]
    assert sorted(tuple(r) for r in got if r.seqID != "s2") == sorted(hits) and len({tuple(r) for r in got}) == len(got)
