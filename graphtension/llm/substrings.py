"""Substring dedup by fixed-block anchors.

Every document's words are cut into blocks that don't overlap; these are the index. Every rolling window of a block's
length probes it. A window of twice the block's length that also stands in another document holds a whole block of
that document, so a hit lies in it: only windows around hits are candidates, and hits grow to the maximal repeat as
the windows around them are found to stand in a document with a smaller id. Two independent hashes of a window's words,
under keys drawn for the run, must agree before a word goes.

Hashes travel in bucket rows of packed bytes, each about a bucket's share of many documents: a few bytes a word. A
task's documents are settled among themselves first (copies, windows that many of them have), so that frequent text
arrives once from each task. Each bucket is one group of bounded size; no text is compared with all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtension.llm.common import PACKED, PACKED_SQL, SENT, SENT_SQL, bucket_bits, bucket_runs, by_document, hash_keys, lean, n_parts, packed_rows, slices, table, told, unused, window_hashes, word_hashes
from graphtension.session import discard, materialize

WINDOW = 50
#: Windows that a task settles together before it sends them.
GROUP_WINDOWS = 750_000
#: A window that so many of a task's documents have is a hit for all of them; one of them tells the others' tasks.
FREQUENT = 64

#: Values that a task gathers before it packs them.
GATHERED = 1_000_000


def _pack(doc: np.ndarray, ids: np.ndarray, keys: np.ndarray, bits: int, kind: int, refs: np.ndarray | None = None, width: str = "<u4") -> pa.RecordBatch:
    """Bucket rows of (document, key) pairs: the top bits name the bucket, the rest travels. Sorted by document."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((doc, bucket))
    bucket, doc, keys = bucket[order], doc[order], keys[order]
    rest = (keys << np.uint64(bits)) >> np.uint64(32) if width == "<u4" else keys
    names = np.unique(bucket)
    r_bucket = (refs >> np.uint64(64 - bits)).astype(np.int64) if refs is not None else None
    rows = []
    for b, lo, hi in zip(names.tolist(), np.searchsorted(bucket, names), np.searchsorted(bucket, names, "right"), strict=True):
        d, n = np.unique(doc[lo:hi], return_counts=True)
        r = b""
        if refs is not None:
            x, y = np.searchsorted(r_bucket, [b, b + 1])
            r = ((refs[x:y] << np.uint64(bits)) >> np.uint64(32)).astype("<u4").tobytes()
        rows.append((b, kind, ids[d].astype("<i8").tobytes(), n.astype("<u4").tobytes(), rest[lo:hi].astype(width).tobytes(), r, None, None, None))
    return told(rows, SENT)


def _anchors(window: int, key: int, bits: int):
    """Documents to bucket rows (kind 0), hits settled here (kind 1), and a row about each document (kind 2)."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size, base = 0, 0
        seen: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, base, seen
            if held:
                ids, docs, keys, first = (np.concatenate([h[i] for h in held]) for i in range(4))
                yield from _settle(ids, docs, keys, first, bits)
            held, size, base, seen = [], 0, 0, {}

        for rows, data, off in slices(batches):
            ids, tags = rows.column(0), rows.column(2)
            words, first = word_hashes(data, off, key)
            raw = data.tobytes()
            about, use = [], []
            for i in range(rows.num_rows):
                n = int(first[i + 1] - first[i])
                sha = hashlib.sha256(b" ".join(raw[off[i] : off[i + 1]].split())).hexdigest()
                about.append((0, 2, None, None, None, None, ids[i].as_py(), n, f"{sha}:{tags[i].as_py()}"))
                # a copy of a text that this task holds already adds nothing: the smallest id speaks for all
                if n >= window and ids[i].as_py() is not None:
                    use.append((i, sha, ids[i].as_py()))
            yield told(about, SENT)
            keys, at = window_hashes(words, first, block)
            for i, sha, doc in use:
                if sha in seen:
                    one = held[seen[sha]][0]
                    one[0] = min(one[0], doc)
                    continue
                seen[sha] = len(held)
                n = int(at[i + 1] - at[i])
                own = keys[at[i] : at[i + 1]]
                is_ref = np.zeros(n, bool)
                is_ref[::block] = True
                held.append((np.array([doc]), np.full(n, base, np.int32), own, is_ref))
                base += 1
                size += n
            if size >= GROUP_WINDOWS:
                yield from flush()
        yield from flush()

    return run


def _settle(ids: np.ndarray, docs: np.ndarray, keys: np.ndarray, is_ref: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    keep = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(32 - bits)
    keys = keys & keep
    refs = np.unique(keys[is_ref])
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    k, d = k[new], d[new]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    n = np.diff(np.append(head, len(k)))
    local = (n > 1) & (np.isin(k[head], refs, assume_unique=True) | (n >= FREQUENT))
    hit = np.repeat(local, n)
    if hit.any():
        yield _pack(d[hit], ids, k[hit], bits, 1)
    send = ~hit
    send[head[local]] = True
    yield _pack(d[send], ids, k[send], bits, 0, refs)


def _full(rest: np.ndarray, bucket: int, bits: int) -> np.ndarray:
    return (np.uint64(bucket) << np.uint64(64 - bits)) | (rest.astype(np.uint64) << np.uint64(32 - bits))


class _Gathered:
    """(document, value) pairs on their way to packed rows."""

    def __init__(self, bits: int) -> None:
        self.bits, self.docs, self.vals, self.size = bits, [], [], 0

    def add(self, docs: np.ndarray, vals: np.ndarray) -> None:
        if len(docs):
            self.docs.append(docs)
            self.vals.append(vals)
            self.size += len(docs)

    def rows(self) -> pa.RecordBatch:
        out = packed_rows(np.concatenate(self.docs), np.concatenate(self.vals), self.bits)
        self.docs, self.vals, self.size = [], [], 0
        return out


def _docs_of(row: dict) -> np.ndarray:
    return np.repeat(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["counts"], "<u4"))


def _probe(bits: int):
    """Bucket rows to hits: keys that are a block somewhere and that two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, got = [], _Gathered(bits)
        for bucket, rows in bucket_runs(batches):
            if bucket < 0:
                row = rows[0]
                if row["kind"] == 2:
                    about.append((2, None, None, None, None, row["doc_id"], row["n_words"], row["sha"]))
                else:
                    got.add(_docs_of(row), _full(np.frombuffer(row["keys"], "<u4"), row["bucket"], bits))
            else:
                every = [np.frombuffer(r["keys"], "<u4") for r in rows]
                value, n = np.unique(np.concatenate(every), return_counts=True)
                refs = np.unique(np.concatenate([np.frombuffer(r["extra"], "<u4") for r in rows]))
                hits = np.intersect1d(value[n > 1], refs, assume_unique=True)
                for r, keys in zip(rows, every, strict=True):
                    keep = np.isin(keys, hits)
                    if keep.any():
                        got.add(_docs_of(r)[keep], _full(keys[keep], bucket, bits))
            if len(about) >= 20_000:
                yield told(about, PACKED)
                about = []
            if got.size >= GATHERED:
                yield got.rows()
        if about:
            yield told(about, PACKED)
        if got.size:
            yield got.rows()

    return run


_WINDOWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("ids", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("more", pa.binary()), ("places", pa.binary()), ("doc_id", pa.int64())])
WINDOWS = "bucket int, kind tinyint, ids binary, counts binary, keys binary, more binary, places binary, doc_id bigint"


def _spots(tag: int, places: np.ndarray) -> np.ndarray:
    """Places with the lower half of their text's tag above them: rows may repeat an id with another text."""
    return np.uint64((tag & 0xFFFFFFFF) << 32) | places.astype(np.uint64)


def _candidates(window: int, keys: tuple[int, int], bits: int):
    """Documents with their hits to candidate windows: bucket rows (kind 0), or places settled here (kind 1)."""
    block = window // 2
    keep = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(32 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, data, off in slices(batches):
            words, first = word_hashes(data, off, keys[0])
            blocks, at = window_hashes(words, first, block)
            wide, wat = window_hashes(words, first, window)
            more = window_hashes(word_hashes(data, off, keys[1])[0], first, window)[0]
            hits = rows.column(rows.schema.get_field_index("hits")).to_pylist()
            for i, (doc, tag) in enumerate(zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True)):
                mine = np.unique(np.frombuffer(hits[i], np.uint64))
                spots = np.isin(blocks[at[i] : at[i + 1]] & keep, mine)
                n = int(wat[i + 1] - wat[i])
                # a window begins at most window - block words before the block that it covers
                mark = np.concatenate([[0], np.cumsum(spots)])
                lo = np.arange(n)
                cand = np.flatnonzero(mark[lo + window - block + 1] > mark[lo])
                held.append((np.full(len(cand), doc), wide[wat[i] : wat[i + 1]][cand], more[wat[i] : wat[i + 1]][cand], _spots(tag, cand)))
                size += len(cand)
            if size >= GROUP_WINDOWS:
                yield from _first_here(held, bits)
                held, size = [], 0
        if size:
            yield from _first_here(held, bits)

    return run


def _least(doc: np.ndarray, key: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by window and document, and, in it, the smallest document that has each one's window."""
    order = np.lexsort((doc, more, key))
    doc, key, more = doc[order], key[order], more[order]
    head = np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])])
    return order, doc[np.maximum.accumulate(np.where(head, np.arange(len(doc)), 0))]


def _first_here(held: list, bits: int) -> Iterator[pa.RecordBatch]:
    """Windows that a document with a smaller id has, among these: settled. The others' first documents ask on."""
    doc, key, more, place = (np.concatenate([h[i] for h in held]) for i in range(4))
    order, least = _least(doc, key, more)
    doc, key, more, place = doc[order], key[order], more[order], place[order]
    gone = doc > least
    out = []
    if gone.any():
        d, p = doc[gone], place[gone]
        order = np.argsort(d, kind="stable")
        d, p = d[order], p[order]
        names = np.unique(d)
        out += [(0, 1, None, None, None, None, p[lo:hi].astype("<u8").tobytes(), x) for x, lo, hi in zip(names.tolist(), np.searchsorted(d, names), np.searchsorted(d, names, "right"), strict=True)]
    out += _window_rows(doc[~gone], key[~gone], more[~gone], place[~gone], bits)
    for lo in range(0, len(out), 4096):
        yield told(out[lo : lo + 4096], _WINDOWS)


def _window_rows(doc: np.ndarray, key: np.ndarray, more: np.ndarray, place: np.ndarray, bits: int) -> list[tuple]:
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((doc, bucket))
    bucket, doc, key, more, place = bucket[order], doc[order], key[order], more[order], place[order]
    names, rows = np.unique(bucket), []
    for b, lo, hi in zip(names.tolist(), np.searchsorted(bucket, names), np.searchsorted(bucket, names, "right"), strict=True):
        d, n = np.unique(doc[lo:hi], return_counts=True)
        rows.append((b, 0, d.astype("<i8").tobytes(), n.astype("<u4").tobytes(), *(x[lo:hi].astype("<u8").tobytes() for x in (key, more, place)), None))
    return rows


def _first_of_all(bits: int):
    """Bucket rows to places of windows that a document with a smaller id has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Gathered(bits)
        for bucket, rows in bucket_runs(batches):
            if bucket < 0:
                places = np.frombuffer(rows[0]["places"], "<u8")
                got.add(np.full(len(places), rows[0]["doc_id"]), places)
            else:
                docs = np.concatenate([_docs_of(r) for r in rows])
                key, more, places = (np.concatenate([np.frombuffer(r[c], "<u8") for r in rows]) for c in ("keys", "more", "places"))
                order, least = _least(docs, key, more)
                docs, places = docs[order], places[order]
                gone = docs > least
                got.add(docs[gone], places[gone])
            if got.size >= GATHERED:
                yield got.rows()
        if got.size:
            yield got.rows()

    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _cut(window: int):
    """Documents with places to what is kept: words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, tag, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                spots = np.unique(np.frombuffer(places, "<u8"))
                begin = (spots[spots >> np.uint64(32) == np.uint64(tag & 0xFFFFFFFF)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, np.minimum(begin + window, len(words)), -1)
                gone = np.cumsum(cover[:-1]) > 0
                out.append((doc, tag, int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()))
            if out:
                yield told(out, _KEPT)

    return run


def tag_of(text: str):
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Two frames over ``docs`` (doc_id, text): about every row (doc_id, tag, n_words, sha of its words joined by one
    space, whole: all of it goes, being a copy), and, for rows that may lose a part, (doc_id, tag, n_removed, kept).

    A word goes if a window of ``window`` consecutive words covers it that also starts in a document with a smaller
    id. Windows are judged on the input. Nulls and empties: null or empty texts have no words; rows without an id
    lose nothing and take nothing. Rows that repeat an id are judged each by its own text, never by each other;
    ``tag`` tells their texts apart. An empty table gives no rows. Other columns are ignored. Whole texts are read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), tag_of("text").alias("tag"))
    keys, parts = hash_keys(), n_parts(docs)
    bits = bucket_bits(parts)
    spread = F.when(F.col("kind") == 0, F.col("bucket").cast("bigint")).otherwise(F.xxhash64("doc_id", F.monotonically_increasing_id()))
    sent = docs.mapInArrow(lean(_anchors(window, keys[0], bits)), SENT_SQL)
    found = materialize(sent.repartition(parts, spread).sortWithinPartitions("bucket").mapInArrow(lean(_probe(bits)), PACKED_SQL), "anchors")
    name = F.split("sha", ":")
    about = found.filter("kind = 2").select("doc_id", name[1].cast("bigint").alias("tag"), "n_words", name[0].alias("sha"))
    # only of texts that more than one row has; written, so that the join's sides are plain shuffles that AQE can split
    firsts = about.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("sha", "n_words").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    firsts = materialize(firsts.filter("rows > 1").select("sha", "n_words", "first"), "firsts")
    about = materialize(about.join(firsts, ["sha", "n_words"], "left").select("doc_id", "tag", "n_words", "sha", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("whole")), "about")
    discard(firsts)
    partial = about.filter(~F.col("whole")).select("doc_id").distinct()
    hits = by_document(found, "<u8", parts).withColumnRenamed("vals", "hits").join(partial, "doc_id", "left_semi")
    near = docs.join(hits, "doc_id")
    asked = near.mapInArrow(lean(_candidates(window, keys, bits)), WINDOWS)
    gone = materialize(asked.repartition(parts, spread).sortWithinPartitions("bucket").mapInArrow(lean(_first_of_all(bits)), PACKED_SQL), "places")
    discard(found)
    places = by_document(gone, "<u8", parts).withColumnRenamed("vals", "places")
    cut = docs.join(places, "doc_id").mapInArrow(lean(_cut(window)), "doc_id bigint, tag bigint, n_removed bigint, kept string").dropDuplicates(["doc_id", "tag"])
    return about, cut


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    about, cut = repeats(table(spark, sf_dir, "documents"))
    cut = cut.select("doc_id", "tag", "n_removed", F.sha2("kept", 256).alias("kept_sha"))
    none = F.sha2(F.lit(""), 256)
    rows = about.join(cut, ["doc_id", "tag"], "left")
    removed = F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return rows.select("doc_id", "n_words", removed.cast("bigint").alias("n_removed"), F.when(F.col("whole"), none).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, repeated passages taken out of their texts; rows that lose everything go.

    Texts that lose nothing stay as they are, null and empty ones too; others are their kept words joined by one
    space, and n_chars follows. Columns of ``docs`` pass through, whatever their names. Rows that repeat an id are
    judged each by its own text. An empty table gives no rows.
    """
    about, cut = repeats(docs, window)
    d, t, whole, left, n = unused(docs, "d", "t", "whole", "kept", "n_removed")
    gone = about.filter("whole").select(F.col("doc_id").alias(d), F.col("tag").alias(t), F.lit(True).alias(whole)).distinct()
    cut = cut.filter("n_removed > 0").select(F.col("doc_id").alias(d), F.col("tag").alias(t), F.col("kept").alias(left))
    told_of = gone.withColumn(left, F.lit(None).cast("string")).unionByName(cut.withColumn(whole, F.lit(False)).join(gone.select(d, t), [d, t], "left_anti"))
    here = (F.col("doc_id").cast("bigint") == F.col(d)) & (tag_of("text") == F.col(t))
    rows = docs.join(told_of, here, "left").filter(~F.coalesce(F.col(whole), F.lit(False)) & (F.coalesce(F.col(left), F.lit("x")) != ""))
    out = rows.withColumn("text", F.coalesce(left, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(left).isNotNull(), F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
