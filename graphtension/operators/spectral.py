"""Algebraic connectivity of a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtension.errors import NotConverged
from graphtension.operators.graph import undirected
from graphtension.operators.hops import betti
from graphtension.session import discard, materialize

#: Dense eigenvalues up to this many nodes; beyond, block Davidson rounds over DataFrames, to the same value.
DENSE = 1500
#: New directions a round, the most a basis holds, and what is kept of a full one.
BLOCK, BASIS, KEPT = 8, 64, 24
#: The preconditioner 1 / (degree - value) is held off its pole by this part of the degree.
OFF_POLE = 0.3


def _weighted(edges: DataFrame) -> DataFrame:
    """(v, n, w) both ways, symmetric: the mean of both directions, a direction without a positive weight being 1."""
    pair = undirected(edges).filter("v <> n")
    e = edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    one = e.select(F.col("src").alias("v"), F.col("dst").alias("n"), F.col("w").alias("a"))
    two = e.select(F.col("dst").alias("v"), F.col("src").alias("n"), F.col("w").alias("b"))
    pos = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    return pair.join(one, ["v", "n"], "left").join(two, ["v", "n"], "left").select("v", "n", ((pos("a") + pos("b")) / 2).alias("w"))


def _matrix(col: pa.Array, rows: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _pole(d: np.ndarray, value: float) -> np.ndarray:
    q = d - value
    return np.where(np.abs(q) < OFF_POLE * d, np.where(q < 0, -OFF_POLE, OFF_POLE) * d, q)


def _summed(rows: DataFrame, parts) -> list[np.ndarray]:
    """What ``parts`` (batch to a list of arrays) gives, added up over all rows: one small row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = parts(batch)
                total = got if total is None else [x + y for x, y in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist() for x in total], pa.list_(pa.float64())), pa.array([list(x.shape) for x in total], pa.list_(pa.int32())), pa.array(range(len(total)), pa.int32())], names=["x", "shape", "i"])

    out: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(run, "x array<double>, shape array<int>, i int").collect():
        out[r.i] = out.get(r.i, 0) + np.array(r.x).reshape(r.shape)
    return [out[i] for i in sorted(out)]


def _rows(make, kept: int):
    """Rows (v, d, s, ls, x): the first ``kept`` columns as they are, the others from ``make``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = [pa.array(list(x), pa.list_(pa.float64())) for x in make(batch)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(kept)] + made, names=["v", "d", "s", "ls", "x"])

    return run


def _fresh(gram: np.ndarray, k: int) -> np.ndarray:
    """T so that [S W] T is orthonormal and orthogonal to the ``k`` orthonormal columns S; directions within S go."""
    h = gram[:k, k:]
    rest = gram[k:, k:] - h.T @ h
    scale = 1 / np.sqrt(np.maximum(np.diag(gram)[k:], 1e-300))
    g, u = np.linalg.eigh(rest * scale[:, None] * scale)
    t = scale[:, None] * (u[:, g > 1e-12] / np.sqrt(g[g > 1e-12]))
    return np.vstack([-h @ t, t])


def _davidson(w: DataFrame, n: int, rounds: int, tolerance: float) -> float:
    """The least eigenvalue of the Laplacian of ``w`` beside the constant vector's, to a residual.

    Rows (v, d, s, ls, x): a node, its degree, its row of the basis S, of L S, and of the new directions. Only
    matrices of the basis' width come to the driver.
    """
    deg = w.groupBy("v").agg(F.sum("w").alias("d"))
    none = F.array().cast("array<double>")
    state = held = materialize(deg.select("v", "d", none.alias("s"), none.alias("ls"), F.array(*[F.xxhash64("v", F.lit(j)) / F.lit(2.0**63) for j in range(BLOCK)]).alias("x")), "vectors")
    # rounding in L x alone leaves this much
    floor = 16 * np.finfo(float).eps * held.agg(F.max("d")).first()[0]
    value = residual = float("inf")
    schema = "v string, d double, s array<double>, ls array<double>, x array<double>"
    k = 0
    for _ in range(rounds):

        def products(batch: pa.RecordBatch, value: float = value) -> list[np.ndarray]:
            m, d = batch.num_rows, batch.column(1).to_numpy()
            x = _matrix(batch.column(4), m)
            b = np.hstack([_matrix(batch.column(2), m), x])
            r = x[:, 0] * _pole(d, value) if np.isfinite(value) else np.zeros(m)
            return [b.T @ b, b.sum(axis=0), np.array([r @ r])]

        gram, mean, r2 = _summed(state, products)
        mean, residual = mean / n, float(np.sqrt(r2[0])) if np.isfinite(value) else float("inf")
        if np.isfinite(value) and residual <= max(tolerance * value, floor):
            discard(held)
            return value
        turn = _fresh(gram - n * np.outer(mean, mean), k)
        new = turn.shape[1]
        if not new:
            break

        def turned(batch: pa.RecordBatch, turn: np.ndarray = turn, shift: np.ndarray = mean @ turn) -> list[np.ndarray]:
            m = batch.num_rows
            return [np.hstack([_matrix(batch.column(2), m), _matrix(batch.column(4), m)]) @ turn - shift]

        base = materialize(state.mapInArrow(_rows(turned, 4), schema), "vectors")
        discard(held)
        far = w.join(base.select(F.col("v").alias("n"), "x"), "n").groupBy("v").agg(*[F.sum(F.col("w") * F.col("x")[j]).alias(f"y{j}") for j in range(new)])
        lx = F.array(*[F.col("d") * F.col("x")[j] - F.col(f"y{j}") for j in range(new)])
        held = materialize(base.join(far, "v").select("v", "d", "s", "ls", "x", lx.alias("lx")), "vectors")
        discard(base)

        def projected(batch: pa.RecordBatch) -> list[np.ndarray]:
            s, ls, x, y = (_matrix(batch.column(i), batch.num_rows) for i in (2, 3, 4, 5))
            return [np.hstack([s, x]).T @ np.hstack([ls, y])]

        a = _summed(held, projected)[0]
        values, c = np.linalg.eigh((a + a.T) / 2)
        k = k + new if k + new + BLOCK <= BASIS else KEPT
        c, value = c[:, :k], float(values[0])

        def directions(batch: pa.RecordBatch, c: np.ndarray = c, values: np.ndarray = values[:BLOCK]) -> list[np.ndarray]:
            s, ls, x, y = (_matrix(batch.column(i), batch.num_rows) for i in (2, 3, 4, 5))
            s, ls, d = np.hstack([s, x]) @ c, np.hstack([ls, y]) @ c, batch.column(1).to_numpy()
            r = ls[:, : len(values)] - s[:, : len(values)] * values
            return [s, ls, r / _pole(d, values[0])[:, None]]

        state = held.mapInArrow(_rows(directions, 2), schema)
    discard(held)
    raise NotConverged(f"second-smallest eigenvalue: residual {residual:.3g} at {value:.6g} after {rounds} rounds")


def fiedler_value(edges: DataFrame, rounds: int = 300, tolerance: float = 1e-8) -> DataFrame:
    """Second-smallest eigenvalue of the Laplacian; 0 with fewer than two nodes, an isolated node or several parts.

    Up to DENSE nodes one task computes it densely. Larger graphs take block Davidson rounds with the constant vector
    projected out, until the residual is below ``tolerance`` times the value (or what rounding allows): one join and
    three aggregations a round. NotConverged is raised if ``rounds`` don't suffice; long chains need many.
    """
    spark = edges.sparkSession
    w = materialize(_weighted(edges), "laplacian")
    ids = undirected(edges).select(F.col("v").alias("id")).distinct()
    n, linked = ids.count(), w.select("v").distinct().count()
    if n < 2 or linked < n:
        return spark.range(1).select(F.lit(0.0).alias("value"))
    if n <= DENSE:

        def dense(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(parts))
            names = {v: i for i, v in enumerate(sorted(set(rows.v)))}
            lap = np.zeros((len(names), len(names)))
            lap[rows.v.map(names), rows.n.map(names)] = -rows.w
            np.fill_diagonal(lap, -lap.sum(axis=1))
            value = float(np.linalg.eigvalsh(lap)[1])
            yield pd.DataFrame({"value": [value if value >= 1e-12 else 0.0]})

        return w.coalesce(1).mapInPandas(dense, "value double")
    if betti(edges).first().beta0 > 1:
        return spark.range(1).select(F.lit(0.0).alias("value"))
    value = _davidson(w, n, rounds, tolerance)
    return spark.range(1).select(F.lit(value if value >= 1e-12 else 0.0).alias("value"))
