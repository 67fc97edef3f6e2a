"""Exact top-k search by inner product, a block at a time.

Vectors are kept as a forward index in blocks; a block knows each term's largest and smallest value. For a query the
blocks are taken in the order of their bounds, the summed best that each term can add, until the next bound lies below
the k-th score. A bounded sample of the vectors gives each query a k-th score to begin with, in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtension.llm.common import table

#: Rows of a block; vectors that a task holds at once; queries that are sent to executors at once.
BLOCK, GROUP, QUERIES_AT_ONCE = 64, 16_384, 20_000
#: Vectors of the sample that gives first bounds.
SAMPLE = 16_384
#: Below this, sums of products of whole numbers are exact in doubles; others are taken as Python integers.
EXACT = 1 << 53


def usable(c: str) -> Column:
    """Not null, and no component null, infinite or not a number."""
    return F.col(c).isNotNull() & F.forall(F.coalesce(F.col(c), F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantized(v: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * v)


def _matrix(col: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros."""
    sizes = np.asarray(col.value_lengths().fill_null(0), dtype=np.int64)
    wide = max(int(sizes.max(initial=0)), dim or 0, 1)
    out = np.zeros((len(sizes), wide))
    flat = np.asarray(col.flatten(), dtype=np.float64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Blocks:
    """Vectors in an order that puts like ones together, and the bounds of each block."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        lead = np.abs(vecs).argmax(axis=1)
        sign = vecs[np.arange(len(vecs)), lead] > 0
        order = np.lexsort((ids, sign, lead))
        self.ids, self.vecs = ids[order], vecs[order]
        cuts = np.arange(0, len(ids), BLOCK)
        self.cuts = np.append(cuts, len(ids))
        self.high, self.low = np.maximum.reduceat(self.vecs, cuts), np.minimum.reduceat(self.vecs, cuts)
        self.most = np.abs(vecs).max(initial=0)

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """(query, vector, score): the k best of each query, ties to the smaller id, the query itself left out; none
        that scores below the query's ``floors``."""
        wide = max(queries.shape[1], self.vecs.shape[1])
        pad = lambda m: np.pad(m, ((0, 0), (0, wide - m.shape[1])))
        q, vecs = pad(queries), pad(self.vecs)
        bounds = np.maximum(q, 0) @ pad(self.high).T + np.minimum(q, 0) @ pad(self.low).T
        slack = np.abs(bounds) * 1e-9
        order = np.argsort(-bounds, axis=1, kind="stable")
        # the largest sum that the query and the vectors allow, however many components there are
        big = np.abs(q).max(1, initial=0) * self.most * wide >= EXACT
        for i, qid in enumerate(qids.tolist()):
            ids, scores = np.zeros(0, np.int64), np.zeros(0, object if big[i] else np.float64)
            kth = -np.inf if floors is None else floors[i]
            for b in order[i].tolist():
                if bounds[i, b] + slack[i, b] < kth:
                    break
                lo, hi = self.cuts[b], self.cuts[b + 1]
                new = np.array([sum(int(x) * int(y) for x, y in zip(r, q[i], strict=True)) for r in vecs[lo:hi]], dtype=object) if big[i] else vecs[lo:hi] @ q[i]
                take = self.ids[lo:hi] != qid
                take &= (new >= kth).astype(bool)
                if not take.any():
                    continue
                ids, scores = np.concatenate([ids, self.ids[lo:hi][take]]), np.concatenate([scores, new[take]])
                best = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) >= k:
                    kth = max(kth, scores[-1])
            for v, s in zip(ids.tolist(), scores.tolist(), strict=True):
                yield qid, v, max(min(int(s), 2**63 - 1), -(2**63))


def _sample(rows: DataFrame) -> Blocks | None:
    """About SAMPLE of the rows, by hash; half as many again at most."""
    share = SAMPLE / max(rows.count(), 1)
    some = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(SAMPLE * 3 // 2).toArrow()
    return Blocks(np.asarray(some.column(0), np.int64), quantized(_matrix(some.column(1).combine_chunks()))) if some.num_rows else None


def _floors(sampled: Blocks | None, qids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score among the sample: no smaller score is among its k best. -inf if the sample is short.

    A double just below, where scores don't fit it exactly."""
    out = np.full(len(qids), -np.inf)
    if sampled is not None:
        place, found = {q: i for i, q in enumerate(qids.tolist())}, {}
        for q, _, score in sampled.search(qids, queries, k):
            found.setdefault(q, []).append(score)
        for q, scores in found.items():
            if len(scores) == k:
                out[place[q]] = min(scores) if abs(min(scores)) < EXACT else np.nextafter(float(min(scores)), -np.inf)
    return out


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (vec_id, embedding) over ``rows`` (vec_id, embedding).

    Components count as floor(256 x); the score is the integer inner product, shorter vectors ending in zeros, exact
    at any length; one beyond 64 bits is given as the end of their range. Vectors that are null, or hold a null or
    non-finite component, take no part, nor do rows without an id. Rows with a query's own id aren't its candidates;
    queries that repeat an id are answered once, by the smallest of their vectors; candidates that repeat an id are
    candidates each. Fewer than k candidates are all returned; an empty table gives no rows; other columns are
    ignored. Queries go out in blocks of about QUERIES_AT_ONCE; each block is a pass over the rows.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    queries = queries.filter(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = queries.count()
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    out = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    blocks = -(-n // QUERIES_AT_ONCE)
    sampled = _sample(rows) if n else None
    for b in range(blocks):
        got = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        ids, vecs = np.asarray(got.column(0), np.int64), quantized(_matrix(got.column(1).combine_chunks()))
        held = spark.sparkContext.broadcast((ids, vecs, _floors(sampled, ids, vecs, k)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qids, q, floors = held.value

            def answer(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
                wide = max(v.shape[1] for _, v in parts)
                found = list(Blocks(np.concatenate([i for i, _ in parts]), np.concatenate([np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for _, v in parts])).search(qids, q, k, floors))
                cols = zip(*found, strict=True) if found else ([], [], [])
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

            parts, size = [], 0
            for batch in batches:
                if batch.num_rows:
                    parts.append((np.asarray(batch.column(0), np.int64), quantized(_matrix(batch.column(1)))))
                    size += batch.num_rows
                if size >= GROUP:
                    yield answer(parts)
                    parts, size = [], 0
            if parts:
                yield answer(parts)

        out = out.unionByName(rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % 50 == 0))
