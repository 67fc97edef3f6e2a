"""What the operators share: reading tables, Arrow slices of text, NumPy words and hashes, components."""

from __future__ import annotations

import ctypes
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtension.session import discard, materialize

#: Text handled at once by a Python worker; longer texts are handled one by one.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Input that one shuffle partition of a pass over texts stands for, and the most partitions.
PART_BYTES, MOST_PARTS = 32 << 20, 1 << 17


def n_parts(rows: DataFrame) -> int:
    """Shuffle partitions for a pass over ``rows``: the session's number, and more where the input is larger, as the
    optimizer estimates it; an unknown size counts as none."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_BYTES), MOST_PARTS) if size < 1 << 56 else 1)


def unused(rows: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as make them differ from all columns of ``rows``."""
    taken, out = {c.lower() for c in rows.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
        taken.add(n.lower())
    return out


def words_in(col: str) -> object:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text column, 0 for null; generated code."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(r"[^ \t\n\x0b\f\r]+")), F.lit(0)).cast("bigint")


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, held in this worker process for the next tasks of ``lean(run, name)``."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def let_go(name: str | None = None) -> None:
    """Drop what this worker process holds for others than ``name``."""
    for other in [k for k in _KEPT if k != name]:
        del _KEPT[other]


def lean(run: Callable, keeps: str | None = None) -> Callable:
    """The same function for mapInArrow; a task that ends gives its freed memory back, since its worker lives on.

    What the worker holds from other operators' tasks goes first; ``keeps`` names what this one's tasks share.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return out


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of at most SLICE_BYTES of text, or of one row; a null text counts as empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        n = len(col)
        if not n:
            continue
        _, off_buf, data_buf = col.buffers()
        off = np.frombuffer(off_buf, np.int64)[col.offset : col.offset + n + 1]
        data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1)
            hi = min(hi, n)
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def text_runs(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of at most so many characters of ``text``, or one row, with their texts; null as empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        lo = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > chars:
                yield batch.slice(lo, i - lo), texts[lo:i]
                lo, size = i, 0
            size += len(t)
        if lo < len(texts):
            yield batch.slice(lo), texts[lo:]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The bytes of a block of eight that belong to a word with so many bytes left.
_TAKEN = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on all; one to one."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hash_keys(n: int = 2) -> tuple[int, ...]:
    """Keys of independent hashes, drawn anew by the driver for each run and sent with the code: nobody who writes a
    text can know which words collide, and two hashes decide wherever a result depends on equality."""
    return tuple(secrets.randbits(64) for _ in range(n))


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes; for each document the index of its first word (and the total)."""
    n = len(data)
    space = _SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], before[1:], after[-1], after[:-1] = True, space[:-1], True, space[1:]
        before[off[off < n]] = True
        after[off[off > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, key: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A keyed 64-bit hash of each word, and where each document's words begin.

    Each block of eight bytes is mixed with the key and its place in the word before blocks are added up, so no
    arrangement of bytes cancels out; words of up to eight bytes never share a block's value.
    """
    if lower:
        data = _LOWER[data]
    starts, ends, first = word_bounds(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    lens = ends - starts
    places = mix(np.uint64(key) + np.arange(1, (int(lens.max()) + 15) // 8 + 1, dtype=np.uint64) * _STEP)
    h = mix((eight[starts] & _TAKEN[np.minimum(lens, 8)]) ^ places[0])
    long = np.flatnonzero(lens > 8)
    if len(long):
        more = (lens[long] - 1) // 8
        heads = np.cumsum(more) - more
        at = np.arange(int(more.sum())) - np.repeat(heads, more) + 1
        left = np.repeat(lens[long], more) - 8 * at
        h[long] += np.add.reduceat(mix((eight[np.repeat(starts[long], more) + 8 * at] & _TAKEN[np.minimum(left, 8)]) ^ places[at]), heads)
    return mix(h + lens.astype(np.uint64) * _STEP), first


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) ^ (b + _STEP))


def window_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words that lie in one document; where each document's windows begin.

    Runs of 1, 2, 4, ... words are joined pair by pair, each join mixed; a window is the runs that k's bits name.
    """
    count = np.maximum(np.diff(first) - k + 1, 0)
    at = np.concatenate([[0], np.cumsum(count)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    out, done, size, run = None, 0, 1, words
    while True:
        if k & size:
            out = run if out is None else _join(out[: len(words) - done - size + 1], run[done:])
            done += size
        if 2 * size > k:
            break
        run = _join(run[:-size], run[size:])
        size *= 2
    return out[np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])], at


#: What a task sends: rows of a bucket of hashes (kind 0), of values it has settled itself (1), about a document (2).
SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("ids", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("extra", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])
SENT_SQL = "bucket int, kind tinyint, ids binary, counts binary, keys binary, extra binary, doc_id bigint, n_words bigint, sha string"


def bucket_bits(parts: int) -> int:
    """Twice as many buckets as shuffle partitions, at least 16: a power of two."""
    return max(4, (2 * parts - 1).bit_length())


def bucket_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one bucket at a time, from rows sorted by bucket; rows of other kinds come one by one as bucket -1."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] != 0:
                yield -1, [row]
                continue
            if row["bucket"] != key:
                if rows:
                    yield key, rows
                key, rows = row["bucket"], []
            rows.append(row)
    if rows:
        yield key, rows


def told(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Tuples as a batch."""
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


#: Values gathered for documents in a task: packed rows of a bucket of documents, then one row for each document.
PACKED = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])
PACKED_SQL = "kind tinyint, bucket int, ids binary, counts binary, keys binary, doc_id bigint, n_words bigint, sha string"


def packed_rows(docs: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of kind 1: for a bucket of documents their ids, how many values each has, and the values."""
    bucket = (mix(docs.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((docs, bucket))
    bucket, docs, values = bucket[order], docs[order], values[order]
    names, rows = np.unique(bucket), []
    for b, lo, hi in zip(names.tolist(), np.searchsorted(bucket, names), np.searchsorted(bucket, names, "right"), strict=True):
        d, n = np.unique(docs[lo:hi], return_counts=True)
        rows.append((1, b, d.astype("<i8").tobytes(), n.astype("<u4").tobytes(), values[lo:hi].tobytes(), None, None, None))
    return told(rows, PACKED)


def by_document(packed: DataFrame, dtype: str, parts: int) -> DataFrame:
    """(doc_id, vals): packed rows of all tasks, one row for each document; a task holds a bucket at a time."""
    schema = pa.schema([("doc_id", pa.int64()), ("vals", pa.binary())])

    def close(rows: list[tuple]) -> pa.RecordBatch:
        docs = np.concatenate([np.repeat(np.frombuffer(i, "<i8"), np.frombuffer(n, "<u4")) for i, n, _ in rows])
        vals = np.concatenate([np.frombuffer(v, dtype) for _, _, v in rows])
        order = np.argsort(docs, kind="stable")
        docs, raw = docs[order], vals[order].tobytes()
        names, at = np.unique(docs, return_index=True)
        step = vals.dtype.itemsize
        ends = np.append(at[1:], len(docs)) * step
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([raw[x:y] for x, y in zip((at * step).tolist(), ends.tolist(), strict=True)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for b, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != key:
                    if rows:
                        yield close(rows)
                    key, rows = b, []
                rows.append(tuple(row))
        if rows:
            yield close(rows)

    rows = packed.filter("kind = 1").select("bucket", "ids", "counts", "keys")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "doc_id bigint, vals binary")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of the links (a, b) reaches.

    Ids are numbers, or structs in their order. Each round takes the smallest label among neighbours, then the label's
    own label, which doubles the reach; both steps are written to the shared folder. Hot ids only meet partial minima;
    the join on labels is between two written tables, so that AQE can split the rows that share a label.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = materialize(both, "links")
    lab = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("c"))
    held = lab = materialize(lab, "labels")
    while True:
        near = both.join(lab, both.b == lab.id).groupBy("a").agg(F.min("c").alias("m"))
        # a label may learn from those that carry it, so that chains fold up quickly
        up = lab.join(near, lab.id == near.a).select("id", "c", F.least("c", "m").alias("m"))
        told = up.filter("m < c").groupBy(F.col("c").alias("id")).agg(F.min("m").alias("t"))
        step = materialize(up.join(told, "id", "left").select("id", "c", F.least("m", F.coalesce("t", "m")).alias("m")), "stepped")
        jump = step.select(F.col("id").alias("m"), F.col("m").alias("mm"))
        nxt = step.join(jump, "m", "left").select("id", F.col("c").alias("old"), F.least("m", F.coalesce("mm", "m")).alias("c"))
        nxt = materialize(nxt, "labels")
        discard(step)
        discard(held)
        held = nxt
        changed = nxt.filter("old <> c").limit(1).count()
        lab = nxt.select("id", "c")
        if not changed:
            discard(both)
            out = lab.select("id", F.col("c").alias("component"))
            out._written = held._written  # so that discard() takes it
            return out
