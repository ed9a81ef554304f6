import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import whitening as W

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, keep=4):
    """Straight from the definition, by numpy's own eigenvectors."""
    good = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max([0, *(len(v) for _, v in good)])
    whole = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (width - len(v))) for i, v in good]
    x = np.array(sorted({v for _, v in whole}), float).reshape(-1, width)
    n, sums = len(x), [sum(c) for c in zip(*{v for _, v in whole})]
    c = x - x.mean(axis=0)
    e, b = np.linalg.eigh(c.T @ c / n)
    e, b = e[::-1][:keep], b[:, ::-1][:, :keep]
    out = {}
    for i, v in whole:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        out.setdefault(i, []).append((n, deviation, (np.array(v) - x.mean(axis=0)) @ b / np.sqrt(e)))
    return out, e, np.trace(c.T @ c / n)


def vectors(n=700, width=24, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, width)) * np.linspace(0.2, 1.0, width) @ np.linalg.qr(rng.standard_normal((width, width)))[0]
    rows = [(int(i), [float(np.float32(c)) for c in v], 1) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(400)]  # a third are one vector
    return rows + [(None, rows[6][1], None), (2000, None, 1), (2001, [None] + rows[7][1][1:], 1), (2002, [float("nan")] * width, 1), (2003, [float("-inf")] + rows[8][1][1:], 1), (2004, [-0.0] * width, 1), (2005, rows[9][1][:3], 2)]


def test_equals_eigh(spark, tmp_path):
    rows = vectors()
    df = spark.createDataFrame(rows, KIND)
    spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("x", "v", "row", "place", "whitened")}).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = W.op11_whitening(spark, str(tmp_path)).collect()
    want, e, trace = plain(rows)
    assert len(got) == 4 * sum(map(len, want.values()))
    sign = {}
    for r in got:
        n, deviation, w = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9) and r.identity_error < 1e-9
        s = sign.setdefault(r.component, np.sign(w[r.component - 1] * r.whitened))
        assert r.whitened * s == pytest.approx(w[r.component - 1], abs=1e-7)
    model = W.fit(df)
    assert (model.residuals < 1e-11).all() and model.rounds < 100


def test_few_dimensions_few_rows_and_none(spark):
    told, model = W.whiten(spark.createDataFrame([], KIND))
    assert told.collect() == [] and len(model.values) == 0
    told, model = W.whiten(spark.createDataFrame([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)], KIND))
    assert [(r.deviation, r.whitened) for r in told.collect()] == [(0, []), (0, [])] and model.n == 1
    rows = [(i, [i * 1.0, i * 2.0, 3.0], 0) for i in range(5)]  # one direction only
    told, model = W.whiten(spark.createDataFrame(rows, KIND))
    assert len(model.values) == 1 and sorted(abs(r.whitened[0]) for r in told.collect())[-1] == pytest.approx(math.sqrt(2))
    told, model = W.whiten(spark.createDataFrame([(1, [], 0), (2, None, 0)], KIND))
    assert [r.whitened for r in told.collect()] == [[]]


def test_huge_entries_are_exact_or_null(spark):
    rows = [(1, [1e15, 1.0], 0), (2, [-1e15, 2.0], 0), (3, [1e30, 3.0], 0), (4, [2.0, 2.0], 0)]
    told, model = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    x = [[min(math.floor(256 * c), 2**63 - 1) for c in v] for _, v, _ in rows]
    assert model.sums == [sum(c) for c in zip(*x)]
    assert {r.deviation for r in told.collect()} == {None}


def test_close_eigenvalues_converge():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    e = np.concatenate([[3, 2, 1 + 1e-5, 1, 1 - 1e-5], np.linspace(0.9, 0.1, 195)])
    value, x, residual, rounds = W.lobpcg(lambda b: (q * e) @ (q.T @ b), 200, 4)
    assert value == pytest.approx(e[:4], rel=1e-12) and residual.max() < 1e-11 and rounds < 120
    assert np.abs(np.abs(q[:, :4].T @ x) - np.eye(4)).max() < 1e-6
