"""Near-duplicate vectors by product quantisation: coarse lists, residual codes, table distances, exact rerank.

Probes suffice for every link: vectors with cosine at least t lie within r = sqrt(2 - 2t) of each other on the unit
sphere, so of two such vectors each has the other's list within r; one of them asks, and both are told. Table distances drop a pair only if the distance to
the quantised vector, less that vector's own error, is above r. So the index loses nothing; the exact cosine decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtension.llm.common import components, table, told
from graphtension.llm.topk import _matrix, usable
from graphtension.session import materialize

#: Vectors that the index is fitted on, by hash; it holds all vectors.
SAMPLE = 20_000
#: Residuals have SUBSPACES codes of CODES values.
SUBSPACES, CODES, MOST_LISTS = 16, 64, 1024
#: Centroids near a vector whose bisecting planes are tested against each list.
PLANES = 32
#: Members of a list that one group holds; larger lists are split, and probes go to every part.
PART = 4096
#: What a row in a list is: a vector of another list that asks, one of the list itself that asks, a member.
ASKS, OWN, MEMBER = 0, 1, 2


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.dim = sample.shape[1]
        self.subs = min(SUBSPACES, self.dim)
        self.cuts = np.linspace(0, self.dim, self.subs + 1).astype(int)
        self.coarse = _kmeans(sample, lists)
        self.gap = np.sqrt(np.maximum(((self.coarse[:, None] - self.coarse[None]) ** 2).sum(2), 0))
        res = sample - self.coarse[self._far(sample).argmin(1)]
        self.books = [_kmeans(res[:, a:b], CODES, 6) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def _far(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse * self.coarse).sum(1), 0)

    def lists(self, x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's own list, and pairs (vector, list) of the other lists that it asks.

        A list may hold something within r of a vector if its cell, by every bisecting plane, begins within r; the
        planes to a vector's nearest centroids are tested. Of two vectors in different lists one alone asks the
        other's: the sum of the lists' numbers says which, so that both kinds of lists are asked alike.
        """
        d = self._far(x)
        home = d.argmin(1)
        ahead = home[:, None] < np.arange(d.shape[1])
        even = (home[:, None] + np.arange(d.shape[1])) % 2 == 0
        asks = (even == ahead) & (np.arange(d.shape[1]) != home[:, None])
        i, j = np.nonzero(asks & (d - d.min(1, keepdims=True) <= 2 * r * self.gap[home] + 1e-9))
        few = min(PLANES, d.shape[1])
        for o in np.argpartition(d, few - 1, axis=1)[:, :few].T:
            within = d[i, j] - d[i, o[i]] <= 2 * r * self.gap[j, o[i]] + 1e-9
            i, j = i[within], j[within]
        return home, i, j

    def codes(self, res: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and each residual's distance to what its codes say."""
        out, left = np.zeros((len(res), self.subs), np.int64), np.zeros(len(res))
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            x, c = res[:, a:b], self.books[m]
            out[:, m] = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            left += ((x - c[out[:, m]]) ** 2).sum(1)
        return out, np.sqrt(left)

    def tables(self, res: np.ndarray) -> list[np.ndarray]:
        """For each subspace the squared distances from residuals to its codes."""
        return [((res[:, None, a:b] - self.books[m][None]) ** 2).sum(2).astype(np.float32) for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False))]


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    """Unit rows; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = _matrix(col, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def link(rows: DataFrame, t: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null and their cosine, in double precision, is at least t;
    shorter vectors end in zeros. Vectors that are null, empty or zero, or hold a null or non-finite component, link
    with nothing, as rows without an id do. Equal vectors of a label are one class: compared once, counted by its
    size, never paired. Repeated rows count as vectors of their own and share a component; rows that share an id but not
    the vector are vectors of their own too, linked or not as their vectors say. An empty table gives no rows; other
    columns are ignored.
    """
    spark, r = rows.sparkSession, math.sqrt(max(0.0, 2 - 2 * t))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    good = usable("embedding") & F.exists(F.coalesce("embedding", F.array().cast("array<double>")), lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = rows.filter(good).withColumn("h", F.xxhash64("embedding"))
    # an id may stand for several vectors, so a class has a number of its own, fixed as it is written
    classes = keyed.groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size")).withColumn("cls", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    n, dim, labels = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.count_distinct("label")).first()
    alone = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    if not n:
        return alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    u = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = classes.filter(u * n < SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    if not len(sample):
        sample = classes.limit(1).select("embedding").toArrow().column(0).combine_chunks()
    index = Index(_unit(sample, dim), int(min(MOST_LISTS, max(1, math.sqrt(n / max(labels, 1)) / 2))))
    held = spark.sparkContext.broadcast(index)

    dealt = pa.schema([("label", pa.string()), ("list", pa.int64()), ("kind", pa.int8()), ("cls", pa.int64()), ("size", pa.int64()), ("embedding", pa.list_(pa.float64()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                home, i, j = held.value.lists(_unit(batch.column(3), dim), r)
                all_ = np.arange(len(home))
                kind = np.repeat(np.array([ASKS, OWN, MEMBER], np.int8), [len(i), len(home), len(home)])
                pick = batch.take(pa.array(np.concatenate([i, all_, all_])))
                yield pa.RecordBatch.from_arrays([pick.column(0), pa.array(np.concatenate([j, home, home]), pa.int64()), pa.array(kind), *pick.columns[1:]], schema=dealt)

    dealt_sql = "label string, list bigint, kind tinyint, cls bigint, size bigint, embedding array<double>"
    spread = classes.select(F.col("label").cast("string").alias("label"), "cls", "size", "embedding").mapInArrow(deal, dealt_sql)
    sizes = spread.filter(F.col("kind") == MEMBER).groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    spread = spread.join(sizes, ["label", "list"])
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    spread = spread.withColumn("part", F.explode(F.when(F.col("kind") == MEMBER, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    spread = spread.select("label", "list", "part", "kind", "cls", "size", "embedding").repartition("label", "list", "part").sortWithinPartitions("label", "list", "part", F.desc("kind"))

    found_in = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, batch in _groups(batches):
            yield _met(held.value, int(key[1]), batch, dim, t, r, found_in)

    found = materialize(spread.mapInArrow(meet, "cls bigint, links bigint, other bigint"), "met")
    comp = components(found.filter("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "cls")
    # the smallest id of a component; a written table, so that AQE can split the rows of a large one in the join
    least = materialize(comp.join(classes, "cls").groupBy("component").agg(F.min("id").alias("least")), "least")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    per_class = classes.join(links, "cls", "left").join(comp.join(least, "component"), "cls", "left").select("label", "h", F.col("embedding").alias("e2"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("least", "id").alias("c"))
    linked = keyed.join(per_class, (keyed.label == per_class.label) & (keyed.h == per_class.h) & (keyed.embedding == per_class.e2)).select("vec_id", "n", "c")
    rest = alone.filter(~F.col("good")).select("vec_id", F.lit(0).cast("bigint").alias("n"), F.col("vec_id").alias("c"))
    out = linked.unionByName(rest)
    return out.select("vec_id", F.col("n").cast("bigint").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("c"), F.lit(True)).alias("kept"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows of one (label, list, part). Members come first; of the probes that follow, no more than a batch
    at a time is held, together with the members."""
    key, members = None, []
    for batch in batches:
        names, lists, parts = (batch.column(i).to_pylist() for i in range(3))
        keys = list(zip(names, lists, parts, strict=True))
        lo = 0
        while lo < len(keys):
            hi = lo + 1
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            run = batch.slice(lo, hi - lo)
            if keys[lo] != key:
                key, members = keys[lo], []
            k = int((np.asarray(run.column(3)) == MEMBER).sum())
            if k:
                members.append(run.slice(0, k))
            if k < run.num_rows:
                yield key, pa.Table.from_batches([*members, run.slice(k)]).combine_chunks().to_batches()[0]
            lo = hi


def _met(index: Index, lst: int, batch: pa.RecordBatch, dim: int, t: float, r: float, schema: pa.Schema) -> pa.RecordBatch:
    """Links of the probes with the members: the number that each has found here, and a forest that spans what is
    linked. Two members of the list meet twice, as each asks too; the one with the smaller number counts for both."""
    kind = np.asarray(batch.column(3))
    member = kind == MEMBER
    ids, sizes = np.asarray(batch.column(4), np.int64), np.asarray(batch.column(5), np.int64)
    x = _unit(batch.column(6), dim)
    mine, probe = np.flatnonzero(member), np.flatnonzero(~member)
    codes, err = index.codes(x[mine] - index.coarse[lst])
    links, up = np.zeros(len(ids), np.int64), {}

    def root(a: int) -> int:
        while up.setdefault(a, a) != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    forest = []
    for lo in range(0, len(probe), 256):
        p = probe[lo : lo + 256]
        tabs = index.tables(x[p] - index.coarse[lst])
        near = np.zeros((len(p), len(mine)), np.float32)
        for m, tab in enumerate(tabs):
            near += tab[:, codes[:, m]]
        i, j = np.nonzero(np.sqrt(np.maximum(near, 0)) - err[None, :] <= r + 1e-3)
        for a in range(0, len(i), 65_536):
            pi, mj = p[i[a : a + 65_536]], mine[j[a : a + 65_536]]
            once = np.where(kind[pi] == OWN, ids[pi] < ids[mj], ids[pi] != ids[mj])
            pi, mj = pi[once], mj[once]
            ok = (x[pi] * x[mj]).sum(1) >= t
            pi, mj = pi[ok], mj[ok]
            np.add.at(links, pi, sizes[mj])
            np.add.at(links, mj, sizes[pi])
            for q, w in zip(ids[pi].tolist(), ids[mj].tolist(), strict=True):
                ra, rb = root(q), root(w)
                if ra != rb:
                    up[max(ra, rb)] = min(ra, rb)
                    forest.append((q, w))
    rows = [(int(ids[q]), int(links[q]), None) for q in np.flatnonzero(links)] + [(a, 0, b) for a, b in forest]
    return told(rows, schema)


def op8_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
