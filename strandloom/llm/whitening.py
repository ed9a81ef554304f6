"""Embedding whitening: leading components of a covariance by LOBPCG, and vectors projected on them.

An entry c becomes the integer x = floor(256 c) (entries beyond 64 bits: the nearest 64-bit integer); vectors that are
null or hold null, NaN or infinite entries are dropped. The fit list has each distinct x vector once. Its covariance V is never
made: ``product`` computes V B for a block B of columns in a pass over the stored fit list, as the sum over rows of
(x - mean) times ((x - mean) B), one block a task, summed by Spark. LOBPCG (locally optimal block preconditioned
conjugate gradients, without a preconditioner) looks for the best approximations in the span of the iterate, its residuals and
its previous directions (Rayleigh-Ritz), until every wanted residual |V b - e b| is under ``TOLERANCE`` times the largest
eigenvalue. The residuals are those of products with the iterate itself, so that they certify it. A block has ``GUARD``
columns more than are wanted, which makes close eigenvalues converge.

Components are numbered by falling eigenvalue; signs are such that the entry of largest size is positive. An eigenvalue of
``NONE`` times the largest or less counts as zero and its component is left out, as are components beyond the width: a fit list of
one vector has none and gives no rows. Vectors shorter than the longest count as ended by zeros. An empty table gives no
rows; repeated rows, null ids and extra columns (in the struct ``row``) come back as they are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCALE = 256
#: Columns beyond those wanted, the residual that is enough, the eigenvalue that counts as zero (both against the largest).
GUARD, TOLERANCE, NONE = 8, 1e-13, 1e-12
#: Rounds until an error; a residual that no longer falls is enough from ``LEAST`` on.
ROUNDS, LEAST = 500, 1e-11
#: Rows that a task multiplies at once.
ROWS = 4096


class Model(NamedTuple):
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray  #: eigenvalues, falling
    vectors: np.ndarray  #: components as columns
    residuals: np.ndarray  #: certified, against the largest eigenvalue
    rounds: int
    identity_error: float  #: largest entry of the covariance of the fit list's whitened vectors less the identity


def usable(vector: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda c: bad(c.cast("double"))), F.lit(False))


def integers(vector: Column, width: int | None = None) -> Column:
    """x of a vector, ended by zeros to ``width`` entries."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    return x if width is None else F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(n, S): rows and exact sums by dimension."""

    def run(batches):
        n, total = 0, [0] * width
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column(0).slice(at, ROWS), width)
                # halves of 32 bits: their sums over a few thousand rows fit 64 bits
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                total = [t + (int(h) << 32) + int(s) for t, h, s in zip(total, high, low)]
                n += len(x)
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(-1, width), pa.int32()), "total": pa.array([str(t) for t in [n, *total]])})

    told = fit.select("x").mapInArrow(run, "place int, total string").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    by = {r.place: int(r.total) for r in told.collect()}
    return by.get(-1, 0), [by.get(j, 0) for j in range(width)]


def product(fit: DataFrame, mean: np.ndarray, block: np.ndarray, n: int, squares: bool = False) -> np.ndarray:
    """V times a block, of as many rows as the vectors are wide; with ``squares`` a last column has V's diagonal."""
    width, m = len(mean), block.shape[1] + squares

    def run(batches):
        out = np.zeros((width, m))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                c = matrix(batch.column(0).slice(at, ROWS), width) - mean
                out[:, : block.shape[1]] += c.T @ (c @ block)
                if squares:
                    out[:, -1] += np.einsum("ij,ij->j", c, c)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), *[pa.array(out[:, j]) for j in range(m)]], names=["place", *[f"b{j}" for j in range(m)]])

    schema = ", ".join(["place int", *[f"b{j} double" for j in range(m)]])
    parts = fit.select("x").mapInArrow(run, schema).groupBy("place").agg(*[F.sum(f"b{j}").alias(f"b{j}") for j in range(m)])
    rows = sorted(parts.collect())  # as many as there are dimensions
    return np.array([r[1:] for r in rows]).reshape(len(rows), m) / n


def orthonormal(basis: np.ndarray, more: np.ndarray) -> np.ndarray:
    """``basis`` (orthonormal columns) and those of ``more`` that add to its span."""
    for j in range(more.shape[1]):
        v = more[:, j]
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            basis = np.column_stack([basis, v])
        if basis.shape[1] == basis.shape[0]:
            break
    return basis


def lobpcg(multiply, width: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(eigenvalues, vectors, residuals, rounds) of the ``wanted`` largest eigenvalues of a symmetric operator."""
    m = min(width, wanted + GUARD)
    start = np.random.default_rng(seed).standard_normal((width, m))
    basis, own, before = orthonormal(np.zeros((width, 0)), start), m, np.inf
    stuck = 0
    for rounds in range(1, ROUNDS + 1):
        image = multiply(basis)
        small = basis.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1][:m], turn[:, ::-1][:, :m]
        x, ax = basis @ turn, image @ turn
        residual = ax - x * value
        size = np.linalg.norm(residual, axis=0) / max(abs(value[0]), np.finfo(float).tiny)
        worst = size[:wanted].max()
        stuck = 0 if worst < before / 2 else stuck + 1
        before = min(before, worst)
        if worst <= TOLERANCE or stuck >= 8 and worst <= LEAST:
            # certified by a product with the vectors themselves
            x = np.linalg.qr(x[:, :wanted])[0]
            ax = multiply(x)
            value = np.einsum("ij,ij->j", x, ax)
            size = np.linalg.norm(ax - x * value, axis=0) / max(abs(value[0]), np.finfo(float).tiny)
            return value, x, size, rounds
        # what the iterate took from residuals and earlier directions is the direction it moved in
        moved = basis[:, own:] @ turn[own:]
        own = m
        basis = orthonormal(orthonormal(np.linalg.qr(x)[0], residual[:, size > TOLERANCE / 10]), moved)
    raise ArithmeticError(f"residuals of {before} after {ROUNDS} rounds")


def fit_list(docs: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The distinct x vectors of usable rows, stored, and their width."""
    rows = docs.select(F.col(f"`{vector}`").alias("v")).where(usable(F.col("v")))
    span = rows.agg(F.max(F.size("v")).alias("most"), F.min(F.size("v")).alias("least")).first()
    width = span.most or 0
    x = integers(F.col("v"), None if span.least == width else width).alias("x")
    return C.written(rows.select(x).distinct(), "fit-list", in_few=True), width


def fit(docs: DataFrame, vector: str = "embedding", keep: int = 4) -> Model:
    stored, width = fit_list(docs, vector)
    none = Model(0, [0] * width, 0.0, np.zeros(0), np.zeros((width, 0)), np.zeros(0), 0, 0.0)
    if not width:
        return none
    n, sums = totals(stored, width)
    if n < 2:
        return none._replace(n=n, sums=sums)
    mean = np.array([s / n for s in sums])
    trace = float(product(stored, mean, np.zeros((width, 0)), n, squares=True).sum())
    if not trace > 0:
        return none._replace(n=n, sums=sums)
    value, x, size, rounds = lobpcg(lambda b: product(stored, mean, b, n), width, min(keep, width))
    there = value > NONE * value[0]
    x = x[:, there] * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1, 1)[there]
    basis = x / np.sqrt(value[there])
    error = float(np.abs(basis.T @ product(stored, mean, basis, n) - np.eye(x.shape[1])).max())
    return Model(n, sums, trace, value[there], x, size[there], rounds, error)


def project(docs: DataFrame, model: Model, vector: str = "embedding") -> DataFrame:
    """Each usable row (struct ``row``) with its exact deviation (null where 64 bits do not hold it) and its whitened coordinates."""
    width, k = len(model.sums), len(model.values)
    mean, sums = np.array([s / max(model.n, 1) for s in model.sums]), model.sums
    basis = model.vectors / np.sqrt(model.values)
    small = max([0, *map(abs, sums)]) < 1 << 60

    def start():
        def step(batch: pa.RecordBatch):
            x = matrix(batch.column(1), width)
            most = float(np.abs(x.astype(float)).max(initial=0)) * model.n + max([0, *map(abs, sums)])
            if small and width * most * most < 2.0**62:
                deviation = ((x * model.n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                exact = [sum((model.n * v - s) ** 2 for v, s in zip(r, sums)) for r in x.tolist()]
                deviation = [v if v < 1 << 63 else None for v in exact]
            w = (x - mean) @ basis
            return {"row": batch.column(0), "deviation": pa.array(deviation, pa.int64()), "whitened": pa.FixedSizeListArray.from_arrays(pa.array(w.reshape(-1)), k).cast(pa.list_(pa.float64())) if k else pa.array([[]] * len(x), pa.list_(pa.float64()))}

        return step

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    schema = StructType([StructField("row", StructType.fromJson(docs.schema.jsonValue())), StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    ready = docs.where(usable(F.col(f"`{vector}`"))).select(row, integers(F.col(f"`{vector}`"), width).alias("x"))
    return C.map_batches(ready, start, schema, rows=ROWS)


def whiten(docs: DataFrame, vector: str = "embedding", keep: int = 4) -> tuple[DataFrame, Model]:
    model = fit(docs, vector, keep)
    return project(docs, model, vector), model


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, model = whiten(C.table(spark, sf_dir, "embeddings"))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    rows = told.select("row.vec_id", F.posexplode("whitened").alias("component", "whitened"), "deviation")
    return rows.select("vec_id", (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("component")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
