"""Similarity join of word-shingle sets by Jaccard similarity, with signature trees.

Exact: no pair at or above the threshold is lost, and only such pairs link. Equal sets become one. A pair that links
shares one of the smallest hashes of both sets, a prefix whose length the threshold gives; sets that share such a hash
with another meet in that hash's block. The prefix is kept longer than that, by as many hashes again as may be missing:
then a pair that links shares many, and a set that shares too few of them, a passage's perhaps, is left out early. In a
block, a tree's nodes hold the OR of their sets' token bitmaps and their range of sizes; the tree is walked against
itself, and a pair of nodes is dropped if the largest overlap that bitmaps and sizes allow is below the least that the
threshold asks.

Blocks of copies first: sets meet once, at their smallest shared hash, and are linked inside the block, a forest of
links standing for all. Then every shared hash is a block, but only of sets that aren't connected yet. Blocks of a
frequent hash are split by size and into a grid of parts.

Shingles are told apart by two independent hashes under keys drawn for the run: one finds candidates, both count
before sets are called equal or a link is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtension.llm.common import PACKED, PACKED_SQL, SENT, SENT_SQL, bucket_bits, bucket_runs, by_document, components, hash_keys, lean, mix, n_parts, packed_rows, slices, table, told, unused, window_hashes, word_hashes
from graphtension.operators.graph import running
from graphtension.session import discard, materialize

#: Sets and shingles that a block of copies holds; sets and shingles in a part of an exact block.
BLOCK_SETS, BLOCK_SHINGLES, PART, PART_SHINGLES = 3000, 600_000, 4096, 4_000_000
FANOUT = 8
#: Bits of a bitmap: a power of two, at least four for each shingle, within these.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: In a first look, so many pairs of two components in one cell are tried; a second look takes on what that leaves open.
FIRST_PAIRS = 64
#: Hashes that a task gathers before it sends them; links that it gathers before it hands them on.
GATHERED, HANDED = 1_000_000, 200_000

Keys = tuple[int, int]


def sets(batches: Iterator[pa.RecordBatch], k: int, key: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each row's distinct shingles as sorted hashes: k lower-cased words each, or all words of a shorter text."""
    for rows, data, off in slices(batches):
        yield rows, [np.unique(x) for x in _shingles(rows, data, off, k, key)]


def _shingles(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, k: int, key: int) -> list[np.ndarray]:
    words, first = word_hashes(data, off, key, lower=True)
    keys, at = window_hashes(words, first, k)
    out = []
    for i in range(rows.num_rows):
        lo, hi = first[i], first[i + 1]
        out.append(window_hashes(words[lo:hi], np.array([0, hi - lo]), int(hi - lo))[0] if 0 < hi - lo < k else keys[at[i] : at[i + 1]])
    return out


Set = tuple[np.ndarray, np.ndarray]


def double_sets(batches: Iterator[pa.RecordBatch], k: int, keys: Keys) -> Iterator[tuple[pa.RecordBatch, list[Set]]]:
    """Each row's shingles as (sorted hashes, each one's second hash)."""
    for rows, data, off in slices(batches):
        out = []
        for a, b in zip(_shingles(rows, data, off, k, keys[0]), _shingles(rows, data, off, k, keys[1]), strict=True):
            one, at = np.unique(a, return_index=True)
            out.append((one, b[at]))
        yield rows, out


def _width(n: int) -> int:
    return min(max(1 << (4 * n - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _bitmap(s: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _fold(b: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as a narrower one."""
    while len(b) > words:
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return b


def least(n: int, num: int, den: int) -> int:
    """How many of its prefix's hashes a set of n shares with every set it links to: its prefix has so many more
    than may be missing. A set may link to smaller ones, whose prefixes are shorter."""
    return max(1, n - -(-num * n // den))


def needed(n: str, num: int, den: int):
    """The same over a column, for the smallest set that one of n may link to."""
    small = F.ceil(F.col(n) * num / den - F.lit(1e-9))
    return F.greatest(F.lit(1), small - F.ceil(small * num / den - F.lit(1e-9))).cast("bigint")


# shared prefix hashes: bucket rows of packed hashes, a few bytes each


def _print(s: np.ndarray, t: np.ndarray) -> str:
    """A set's fingerprint from both hashes of its shingles: 128 bits."""
    return f"{int(mix(s).sum(dtype=np.uint64)):016x}{int(mix(t).sum(dtype=np.uint64)):016x}"


def _send(k: int, num: int, den: int, keys: Keys, bits: int):
    """Documents to bucket rows of their prefixes' hashes (kind 0), hashes found shared here (kind 1), and a row about
    each document (kind 2): the number of its shingles and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for rows, data, off in slices(batches):
            about = []
            for doc, a, b in zip(rows.column(0).to_pylist(), _shingles(rows, data, off, k, keys[0]), _shingles(rows, data, off, k, keys[1]), strict=True):
                s, t = np.unique(a), np.unique(b)
                n, name = len(s), _print(s, t)
                about.append((0, 2, None, None, None, None, doc, n, name))
                if n and doc is not None:
                    held.append((doc, int(name[:16], 16), s[: least(n, num, den) + n - -(-num * n // den)]))
                    size += len(held[-1][2])
            yield told(about, SENT)
            if size >= GATHERED:
                yield from _dealt(held, bits)
                held, size = [], 0
        if size:
            yield from _dealt(held, bits)

    return run


def _dealt(held: list[tuple[int, int, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """A hash that different sets here share is settled here; only two of them speak for it to the others, so that a
    frequent hash arrives at its bucket twice from each task at most."""
    own = np.repeat(np.arange(len(held)), [len(p) for _, _, p in held])
    ids, names = np.array([d for d, _, _ in held], np.int64), np.array([f for _, f, _ in held], np.uint64)
    key = np.concatenate([p for _, _, p in held]) & (np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(32 - bits))
    order = np.lexsort((names[own], key))
    key, own = key[order], own[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.append(head[1:], len(key)) - 1
    here = names[own[head]] != names[own[last]]
    send = np.repeat(~here, last - head + 1)
    send[head[here]] = send[last[here]] = True
    settled = np.repeat(here, last - head + 1)
    if settled.any():
        packed = packed_rows(ids[own[settled]], key[settled] >> np.uint64(32 - bits), bits)
        yield pa.RecordBatch.from_arrays([packed.column(f.name) if f.name in PACKED.names else pa.nulls(packed.num_rows, f.type) for f in SENT], schema=SENT)
    key, own = key[send], own[send]
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((own, bucket))
    bucket, own, rest = bucket[order], own[order], ((key[order] << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
    at, rows = np.unique(bucket), []
    for b, lo, hi in zip(at.tolist(), np.searchsorted(bucket, at), np.searchsorted(bucket, at, "right"), strict=True):
        d, n = np.unique(own[lo:hi], return_counts=True)
        rows.append((b, 0, ids[d].astype("<i8").tobytes(), n.astype("<u4").tobytes(), rest[lo:hi].tobytes(), names[d].astype("<u8").tobytes(), None, None, None))
    yield told(rows, SENT)


def _shared(bits: int):
    """Bucket rows to packed rows of the hashes that a different set has too; the other kinds pass through."""

    def close(bucket: int, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.frombuffer(r["keys"], "<u4") for r in rows])
        times = [np.frombuffer(r["counts"], "<u4") for r in rows]
        docs = np.concatenate([np.repeat(np.frombuffer(r["ids"], "<i8"), n) for r, n in zip(rows, times, strict=True)])
        names = np.concatenate([np.repeat(np.frombuffer(r["extra"], "<u8"), n) for r, n in zip(rows, times, strict=True)])
        order = np.argsort(keys, kind="stable")
        keys, docs, names = keys[order], docs[order], names[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        differ = np.minimum.reduceat(names, head) != np.maximum.reduceat(names, head)
        keep = np.repeat(differ, np.diff(np.append(head, len(keys))))
        return docs[keep], (np.uint64(bucket) << np.uint64(32)) | keys[keep].astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, got, size = [], [], 0
        for bucket, rows in bucket_runs(batches):
            if bucket >= 0:
                got.append(close(bucket, rows))
                size += len(got[-1][0])
            elif rows[0]["kind"] == 1:
                about.append((1, rows[0]["bucket"], rows[0]["ids"], rows[0]["counts"], rows[0]["keys"], None, None, None))
            else:
                about.append((2, None, None, None, None, rows[0]["doc_id"], rows[0]["n_words"], rows[0]["sha"]))
            if len(about) >= 20_000:
                yield told(about, PACKED)
                about = []
            if size > 2 * GATHERED:
                yield packed_rows(np.concatenate([d for d, _ in got]), np.concatenate([k for _, k in got]), bits)
                got, size = [], 0
        if about:
            yield told(about, PACKED)
        if size:
            yield packed_rows(np.concatenate([d for d, _ in got]), np.concatenate([k for _, k in got]), bits)

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed hashes of each set as a sorted array."""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    for batch in batches:
        vals = [np.unique(np.frombuffer(v.as_py(), "<i8")) for v in batch.column(1)]
        at = np.concatenate([[0], np.cumsum([len(v) for v in vals])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(vals) if vals else [], pa.int64()))], schema=schema)


def _with_bitmaps(k: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in sets(batches, k, key):
            bits = pa.array([_bitmap(s, _width(len(s))).tobytes() if len(s) else b"" for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), bits], names=["doc_id", "text", "bits"])

    return run


# signature trees


class SignatureTree:
    """Levels of nodes over sets in order of size: OR-combined bitmaps, size ranges, most tokens beyond the bits."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, labels: np.ndarray) -> None:
        beyond = n - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, n, n, beyond, labels, labels)]
        while len(self.levels[-1][0]) > FANOUT:
            b, lo, hi, ex, la, lb = self.levels[-1]
            cuts = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(ex, cuts), np.minimum.reduceat(la, cuts), np.maximum.reduceat(lb, cuts)))

    def pairs(self, num: int, den: int, chunk: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets (i < j) that may be similar and have different labels, from a walk of the tree against
        itself; in chunks, near pairs first."""
        top = len(self.levels) - 1
        m = len(self.levels[top][0])
        i, j = np.triu_indices(m)
        stack = [(top, i, j)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > chunk:
                stack.append((level, i[chunk:], j[chunk:]))
                i, j = i[:chunk], j[:chunk]
            i, j = self._keep(level, i, j, num, den)
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            size = len(self.levels[level - 1][0])
            step = np.arange(FANOUT)
            a = (i[:, None] * FANOUT + step)[:, :, None].repeat(FANOUT, 2).reshape(-1)
            b = (j[:, None] * FANOUT + step)[:, None, :].repeat(FANOUT, 1).reshape(-1)
            ok = (a < size) & (b < size) & (a <= b)
            stack.append((level - 1, a[ok], b[ok]))

    def _keep(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        bits, lo, hi, ex, la, lb = self.levels[level]
        if level == 0:
            ok = i != j
            i, j = i[ok], j[ok]
        # one label on both sides: nothing to find
        ok = ~((la[i] == lb[i]) & (la[j] == lb[j]) & (la[i] == la[j]))
        # sizes: the smaller of the largest against the larger of the smallest
        ok &= den * np.minimum(hi[i], hi[j]) >= num * np.maximum(lo[i], lo[j])
        i, j = i[ok], j[ok]
        need = -(-num * (lo[i] + lo[j]) // (num + den))
        both = np.bitwise_count(bits[i] & bits[j]).sum(1).astype(np.int64)
        most = np.minimum(both + np.minimum(ex[i], ex[j]), np.minimum(hi[i], hi[j]))
        if level == 0:
            # a bit of one side alone is a token of one side alone
            most = np.minimum(most, np.minimum(lo[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(1), lo[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(1)))
        ok = most >= need
        return i[ok], j[ok]


def similar(a: Set, b: Set, num: int, den: int) -> bool:
    """By the first hashes; if they say so, by both."""
    x, y = a[0], b[0]
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    if den * inter < num * (len(x) + len(y) - inter):
        return False
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    inter = int((a[1][i] == b[1][j]).sum())
    return den * inter >= num * (len(x) + len(y) - inter)


class Forest:
    """Which of some sets are connected, by their places."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)

    def links(self, docs: list[int]) -> list[tuple[int, int]]:
        """A component's smallest id with each other one."""
        least_of: dict[int, int] = {}
        for i, d in enumerate(docs):
            least_of[self.root(i)] = min(d, least_of.get(self.root(i), d))
        return [(least_of[self.root(i)], d) for i, d in enumerate(docs) if d != least_of[self.root(i)]]


def _linked(docs: list[int], found: list[Set], num: int, den: int, start: np.ndarray | None = None, most_failed: int | None = 20, apart=None) -> list[tuple[int, int]]:
    """What links connect among sets; pairs that are connected already aren't compared.

    ``start`` labels what is connected before. ``most_failed`` pairs for each set may fail, then a block is left in
    which hardly any pair links, and the exact step looks at what isn't connected; None: all pairs are tried.
    ``apart`` (i, j) tells pairs that needn't meet here.
    """
    n = np.array([len(s) for s, _ in found], np.int64)
    order = np.lexsort((np.array([s[0] for s, _ in found]), n))
    forest, failed, hit = Forest(len(docs)), 0, False
    if start is not None:
        for c in np.unique(start):
            same = np.flatnonzero(start == c)
            for x in same[1:].tolist():
                forest.join(int(same[0]), x)

    def tried(pairs: Iterator[tuple[int, int]]) -> None:
        nonlocal failed, hit
        for x, y in pairs:
            a, b = int(order[x]), int(order[y])
            if forest.root(a) == forest.root(b) or (apart is not None and apart(a, b)):
                continue
            if similar(found[a], found[b], num, den):
                forest.join(a, b)
                hit = True
            else:
                failed += 1

    if most_failed is not None:
        tried((i, i + 1) for i in range(len(docs) - 1))
    if len(docs) > 2 or most_failed is None:
        width = _width(int(n.max()))
        bits = np.stack([_bitmap(found[i][0], width) for i in order])
        labels = np.array([forest.root(int(i)) for i in order], np.int64)
        for i, j in SignatureTree(n[order], bits, labels).pairs(num, den):
            now = np.array([forest.root(int(x)) for x in order], np.int64)
            ok = now[i] != now[j]
            tried(zip(i[ok].tolist(), j[ok].tolist(), strict=True))
            if most_failed is not None and failed > most_failed * len(docs):
                break
    return forest.links(docs) if hit else []


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return told(rows, _EDGE)


def _block_links(near: DataFrame, members: DataFrame, k: int, keys: Keys, num: int, den: int, n: int) -> DataFrame:
    """Links (a, b) within blocks of ``members`` (doc_id, key, n); large blocks go in parts."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).filter("c > 1")
    sizes = sizes.select("key", F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    placed = members.join(sizes, "key").select("doc_id", "key", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    rows = near.join(placed, "doc_id").select("doc_id", "text", "key", "part").repartition(n, "key", "part").sortWithinPartitions("key", "part", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held, out = None, [], [], []
        for batch, found in double_sets(batches, k, keys):
            names = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for (doc, key, part), s in zip(names, found, strict=True):
                if (key, part) != at:
                    if len(ids) > 1:
                        out += _linked(ids, held, num, den)
                    at, ids, held = (key, part), [], []
                ids.append(doc)
                held.append(s)
            if out:
                yield _edges(out)
                out = []
        if len(ids) > 1:
            yield _edges(_linked(ids, held, num, den))

    return materialize(rows.mapInArrow(lean(run), "a bigint, b bigint"), "links")


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())])


def _cell_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of one cell (token, cls, i, j) at a time, from rows sorted by cell; cells of one row are passed over."""
    at, held = None, []

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        keys = np.stack([np.asarray(batch.column(i), np.int64) for i in range(4)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if hi <= lo:
                continue
            cell = tuple(keys[:, lo].tolist())
            if cell != at:
                if held and sum(x.num_rows for x in held) > 1:
                    yield at, whole()
                at, held = cell, []
            held.append(batch.slice(lo, hi - lo))
        # a batch's rows aren't kept beyond it in pieces
        held = [whole()] if len(held) > 1 else held
    if held and sum(x.num_rows for x in held) > 1:
        yield at, whole()


def _candidates(num: int, den: int, first: int):
    """Cells of sets (doc, c, n, guest, h, bits) to pairs of different components that may be similar; ``more`` names
    two components that have more pairs in a cell than are tried."""

    def close(cell: tuple, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, c, n = (np.asarray(rows.column(i), np.int64) for i in (4, 5, 6))
        if c.min() == c.max():
            return
        guest, h = rows.column(7).to_numpy(zero_copy_only=False).astype(bool), np.asarray(rows.column(8), np.int64)
        raw = rows.column(9).to_pylist()
        narrow = min(map(len, raw)) // 8
        order = np.lexsort((doc, n))
        bits = np.stack([_fold(np.frombuffer(raw[i], np.uint64), narrow) for i in order])
        doc, c, n, guest, h = doc[order], c[order], n[order], guest[order], h[order]
        out, count = set(), {}
        for i, j in SignatureTree(n, bits, c).pairs(num, den):
            ok = (c[i] != c[j]) & ~(guest[i] & guest[j])
            if cell[2] != cell[3]:
                ok &= h[i] != h[j]
            for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                key = (min(c[x], c[y]), max(c[x], c[y]))
                seen = count[key] = count.get(key, 0) + 1
                if seen <= first:
                    out.add((int(min(doc[x], doc[y])), int(max(doc[x], doc[y])), False))
                elif seen == first + 1:
                    out.add((int(key[0]), int(key[1]), True))
            if len(out) > HANDED:
                yield told(list(out), _PAIR)
                out = set()
        if out:
            yield told(list(out), _PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _cell_runs(batches):
            yield from close(cell, rows)

    return run


def _settled(num: int, den: int):
    """Cells of sets (doc, c, n, guest, h, s, t) to links, every pair of different components tried here: a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _cell_runs(batches):
            doc, c = (np.asarray(rows.column(i), np.int64) for i in (4, 5))
            if c.min() == c.max():
                continue
            guest, h = rows.column(7).to_numpy(zero_copy_only=False).astype(bool), np.asarray(rows.column(8), np.int64)
            found = [(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(rows.column(9).to_pylist(), rows.column(10).to_pylist(), strict=True)]
            grid = cell[2] != cell[3]
            out = _linked(doc.tolist(), found, num, den, c, None, lambda a, b, guest=guest, h=h, grid=grid: (guest[a] and guest[b]) or (grid and h[a] == h[b]))
            if out:
                yield _edges(out)

    return run


def _double(near: DataFrame, k: int, keys: Keys) -> DataFrame:
    """(doc_id, s, t): both hashes of each set's shingles."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in double_sets(batches, k, keys):
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1))], names=["doc_id", "s", "t"])

    return near.select("doc_id", "text").mapInArrow(lean(whole), "doc_id bigint, s binary, t binary")


def _verified(near: DataFrame, pairs: DataFrame, k: int, keys: Keys, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    held = materialize(_double(near.join(ids, "doc_id", "left_semi"), k, keys), "sets")
    both = pairs.join(held.withColumnsRenamed({"doc_id": "a", "s": "sa", "t": "ta"}), "a").join(held.withColumnsRenamed({"doc_id": "b", "s": "sb", "t": "tb"}), "b").select("a", "b", "sa", "ta", "sb", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda i: [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(i)]  # noqa: E731, B023
            ok = [similar((a, b), (c, d), num, den) for a, b, c, d in zip(of(2), of(3), of(4), of(5), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    out = materialize(both.mapInArrow(lean(check), "a bigint, b bigint"), "links")
    discard(held)
    return out


def _undecided(more: DataFrame, comp: DataFrame) -> DataFrame | None:
    """(c): components that had more pairs between them than were tried, and aren't connected now."""
    if more.isEmpty():
        return None
    now = more.join(comp.withColumnsRenamed({"id": "a", "component": "x"}), "a", "left").join(comp.withColumnsRenamed({"id": "b", "component": "y"}), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).filter("x <> y")
    out = materialize(now.select(F.col("x").alias("c")).union(now.select("y")).distinct(), "undecided")
    return None if out.isEmpty() else out


def _labelled(tokens: DataFrame, comp: DataFrame) -> DataFrame:
    """(doc_id, tokens, n, c): sets with their component so far."""
    return tokens.join(comp.select(F.col("id").alias("doc_id"), F.col("component").alias("_c")), "doc_id", "left").withColumn("c", F.coalesce("_c", "doc_id")).drop("_c")


def _open(state: DataFrame, num: int, den: int) -> DataFrame:
    """(token, doc_id, c, n): hashes that sets of different components share, of sets that share enough of them.

    A pair that links shares at least ``needed`` of these hashes, so each set may leave out its last but one of so
    many in an order that holds for all sets, and the pair's first shared hash stays on both sides: the most frequent
    hashes go.
    """
    flat = state.select(F.explode("tokens").alias("token"), "doc_id", "c", "n")
    apart = flat.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("f")).filter("x < y").select("token", "f")
    by_set = flat.join(apart, "token").groupBy("doc_id", "c", "n").agg(F.collect_list(F.struct("f", "token")).alias("ts")).filter(F.size("ts") >= needed("n", num, den))
    keep = F.slice(F.sort_array("ts"), F.lit(1), F.size("ts") - needed("n", num, den).cast("int") + 1)
    return materialize(by_set.select(F.explode(keep).alias("t"), "doc_id", "c", "n").select("t.token", "doc_id", "c", "n"), "open")


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    A set: the distinct k-word shingles of the text, A-Z lower-cased, words being runs of anything but white space;
    with fewer words, all of them as one shingle. Two documents link if den * intersection >= num * union; the
    component is the smallest id that links reach, one's own included.

    Nulls and empties: without text or words the set is empty and links with nothing; rows without an id get a null
    component. Repeated rows share a component; rows that repeat an id with another text are documents of their own,
    each with its own links, that bear the same id. An empty table gives no rows. Other columns are ignored. Whole
    texts are read; one text's shingles are held at once.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys, parts = hash_keys(), n_parts(docs)
    bits = bucket_bits(parts)
    sent = docs.mapInArrow(lean(_send(k, num, den, keys, bits)), SENT_SQL)
    spread = F.when(F.col("kind") == 0, F.col("bucket").cast("bigint")).otherwise(F.xxhash64("doc_id", F.monotonically_increasing_id()))
    shared = materialize(sent.repartition(parts, spread).sortWithinPartitions("bucket").mapInArrow(lean(_shared(bits)), PACKED_SQL), "shared")
    same = ["n", "sha"]
    about = shared.filter("kind = 2").select("doc_id", F.col("n_words").alias("n"), "sha")
    first = materialize(about.filter("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep")), "first")
    if not first.groupBy("rep").count().filter("count > 1").isEmpty():
        return _own_ids(docs, k, num, den)
    reps = first.select(F.col("rep").alias("doc_id"), "n")
    tokens = by_document(shared, "<u8", parts).mapInArrow(lean(_tokens), "doc_id bigint, tokens array<bigint>").join(reps, "doc_id")
    tokens = materialize(tokens.filter(F.size("tokens") >= needed("n", num, den)), "tokens")
    near = docs.join(tokens.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    near = materialize(near.mapInArrow(lean(_with_bitmaps(k, keys[0])), "doc_id bigint, text string, bits binary"), "near")
    about = materialize(about, "about")
    discard(shared)

    edges = _block_links(near, tokens.select("doc_id", F.col("tokens")[0].alias("key"), "n"), k, keys, num, den, parts)
    # one set of each component, at the smallest hash that another component has
    comp = components(edges)
    apart = _open(_labelled(tokens, comp), num, den)
    discard(comp)
    heads = apart.filter("doc_id = c").groupBy("doc_id", "n").agg(F.min("token").alias("key"))
    edges = _more(edges, _block_links(near, heads.select("doc_id", "key", "n"), k, keys, num, den, parts))
    discard(apart)

    def cells(state: DataFrame, sets_of: DataFrame, *cols: str) -> DataFrame:
        names = ("token", "cls", "i", "j")
        dealt = _cells(state, num, den).join(sets_of, "doc_id").select(*names, "doc_id", "c", "n", "guest", "h", *cols)
        return dealt.repartition(parts, *names).sortWithinPartitions(*names)

    comp = components(edges)
    apart = _open(_labelled(tokens, comp), num, den)
    discard(comp)
    cand = materialize(cells(apart, near.select("doc_id", "bits"), "bits").mapInArrow(lean(_candidates(num, den, FIRST_PAIRS)), "a bigint, b bigint, more boolean"), "candidates")
    discard(apart)
    pairs = cand.filter("not more").select("a", "b").distinct()
    if not pairs.isEmpty():
        edges = _more(edges, _verified(near, pairs, k, keys, num, den))
    comp = components(edges)
    only = _undecided(cand.filter("more").select("a", "b").distinct(), comp)
    if only is not None:
        apart = _open(_labelled(tokens, comp).join(only, "c", "left_semi"), num, den)
        held = materialize(_double(near.join(apart.select("doc_id").distinct(), "doc_id", "left_semi"), k, keys), "sets")
        edges = _more(edges, materialize(cells(apart, held, "s", "t").mapInArrow(lean(_settled(num, den)), "a bigint, b bigint"), "links"))
        comp = components(edges)
        for t in (apart, held, only):
            discard(t)
    for t in (cand, edges, tokens, near):
        discard(t)
    groups = first.join(comp, first.rep == comp.id, "left").select(*same, F.coalesce("component", "rep").alias("g"))
    out = about.join(groups, same, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("g", "doc_id")).alias("component_id"))


def _more(edges: DataFrame, new: DataFrame) -> DataFrame:
    out = materialize(edges.unionByName(new), "links")
    discard(edges)
    discard(new)
    return out


def _own_ids(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """join() for a table in which an id has several texts: each text but an id's first goes by a number that is no
    id, in the join alone."""
    docs = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = docs.filter("doc_id is not null").select("doc_id", "sha").distinct()
    first = texts.groupBy("doc_id").agg(F.min("sha").alias("first"))
    more = texts.join(first, "doc_id").filter("sha > first").select("sha", "doc_id")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    count = more.count()
    start = high + 1 if high + count < 2**63 - 1 else low - count
    if start < -(2**63):
        raise ValueError("ids leave no room for numbers of texts that repeat them")
    named = materialize(running(more.select("sha", "doc_id", F.struct("doc_id", "sha").alias("at")), "at", {"i": F.lit(1).cast("bigint")}).select("sha", "doc_id", (F.col("i") + start).alias("node")), "nodes")
    docs = docs.join(named, ["doc_id", "sha"], "left").select(F.coalesce("node", "doc_id").alias("node"), "doc_id", "text")
    docs = materialize(docs, "renamed")
    out = materialize(join(docs.select(F.col("node").alias("doc_id"), "text"), k, num, den), "joined")
    names = named.select("node", F.col("doc_id").alias("was"))
    back = out.join(names, out.doc_id == names.node, "left").select(F.coalesce("was", "doc_id").alias("doc_id"), "n_shingles", "component_id")
    least_of = back.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return back.join(least_of, "component_id", "left").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def _cells(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Sets of each open hash dealt to cells: by size, each meeting its own class and the next, and, where a class
    is large, to a grid of parts."""
    width = math.log(den / num) * 1.0001 if num < den else 1e-6
    cls = F.floor(F.ln(F.col("n").cast("double")) / width)
    both = F.explode(F.array(F.struct(cls.alias("cls"), F.lit(False).alias("guest")), F.struct((cls + 1).alias("cls"), F.lit(True).alias("guest"))))
    dealt = rows.withColumn("x", both).select("token", "doc_id", "c", "n", "x.cls", "x.guest")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int")
    sizes = dealt.groupBy("token", "cls").agg(parts.alias("parts"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.count_if(~F.col("guest")).alias("own")).filter("lo < hi and own > 0")
    dealt = dealt.join(sizes.select("token", "cls", "parts"), ["token", "cls"]).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("token", "cls", F.least("h", "q").alias("i"), F.greatest("h", "q").alias("j"), "doc_id", "c", "n", "guest", "h")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), 4, 85, 100)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, one document of each group of near copies: the one with the smallest id.

    Of rows that repeat that id, all with its text stay. Rows without an id, and texts without words, stay. Columns
    of ``docs`` pass through, whatever their names; an empty table gives no rows.
    """
    comp = join(docs, k, num, den)
    gone = comp.filter("doc_id > component_id").select(F.col("doc_id").alias(name := unused(docs, "gone")[0])).distinct()
    return docs.join(gone, F.col("doc_id").cast("bigint") == F.col(name), "left_anti").select(*docs.columns)
