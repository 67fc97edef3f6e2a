"""Packing documents into fixed-length sequences with a bounded number of open windows.

Each partition keeps a fixed number of open windows. A piece goes into the window that it fits best; if it fits none,
the fullest window is emitted and the piece opens a new one. What is open at the end is merged in a last step.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtension.llm.common import kept, lean, table, text_runs
from graphtension.session import materialize

WINDOW, OPEN_WINDOWS, END_ID = 4096, 64, 2
#: So many partitions' open windows are merged together.
MERGE_PARTITIONS = 16
#: Words and runs in one of the two tables of ids that a worker remembers; characters of text tokenized at once.
CACHE_WORDS, SLICE_CHARS = 400_000, 1 << 18
#: Texts of these characters part into these runs: Latin letters up to U+012F, whose lower case is one letter each.
PLAIN = re.compile("[\\t\\n\\r -~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f]*").fullmatch
RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u012f]+|[0-9]|[^\\sa-z0-9\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u012f]+").findall
#: Marks that are a run of their own behind letters; most words that aren't letters alone end in one.
ENDS = frozenset(".,;:!?")

#: What a tokenizer file says that parts texts as RUNS does.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_PARTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
KNOWN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordTokenizer:
    """A tokenizer that drops white space and parts a text into runs of letters, single digits and runs of marks.

    White space never lies in a run, so the ids of a text are those of its words in turn, and those of a word are
    those of its runs; a word of letters is one run. Words and runs are remembered as bytes, in a table that becomes
    the old one when it is full: words that come again move to the new one, the others go with the old. New runs of
    many texts go to the library in one call; the tokens that end a run part them. Texts with characters for which
    the same runs aren't certain (PLAIN tells) are encoded whole; all texts are if the file's normalizer, parts and
    model aren't the ones that this class knows.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        told = json.loads(self.tok.to_str())
        model = {k: v for k, v in told["model"].items() if k not in ("vocab", "merges")}
        specials = all(t["content"].startswith("<|") for t in told["added_tokens"])
        self.known = (told["normalizer"], told["pre_tokenizer"], model) == (KNOWN_NORMALIZER, KNOWN_PARTS, KNOWN_MODEL) and specials
        # the same model over runs that are found already: only white space parts them
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        """Give back the older words."""
        self.old = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _learn_runs(self, runs: list[str]) -> None:
        raw = np.array(self.model.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()
        cuts = np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1
        if len(cuts) != len(runs):
            self.seen.update((r, self.whole(r)) for r in runs)
            return
        at = [0, *(4 * cuts).tolist()]
        self.seen.update(zip(runs, [raw[x:y] for x, y in zip(at, at[1:])], strict=True))  # noqa: RUF007

    def _learn(self, words: set[str]) -> None:
        mixed = {w: (w[:-1], w[-1]) if w[-1] in ENDS and w[:-1].isalpha() else RUNS(w) for w in words if not w.isalpha()}
        new = list((words - mixed.keys()).union(*mixed.values()).difference(self.seen))
        for lo in range(0, len(new), 10_000):
            self._learn_runs(new[lo : lo + 10_000])
        get = self.seen.__getitem__
        self.seen.update([(w, b"".join(map(get, runs))) for w, runs in mixed.items()])

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.known:
            return [self.whole(t) for t in texts]
        words = [t.lower().split() if PLAIN(t) and "<|" not in t else None for t in texts]
        if len(self.seen) > CACHE_WORDS:
            self.old, self.seen = self.seen, {}
        new = set().union(*[w for w in words if w]).difference(self.seen)
        known = self.old.keys() & new if self.old else ()
        self.seen.update([(w, self.old[w]) for w in known])
        new.difference_update(known)
        if new:
            self._learn(new)
        get = self.seen.__getitem__
        return [self.whole(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, words, strict=True)]


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, until it turns to another operator's tasks."""
    return kept(path, lambda: WordTokenizer(path))


@dataclass
class Packer:
    """Best fit over at most ``most`` open windows."""

    window: int = WINDOW
    most: int = OPEN_WINDOWS
    rooms: list[tuple[int, int]] = field(default_factory=list)  # (room, window), sorted
    next_id: int = 0

    def place(self, length: int) -> tuple[int, int, int | None]:
        """(window, offset, emitted window or none)."""
        if length == self.window:
            self.next_id += 1
            return self.next_id - 1, 0, self.next_id - 1
        i = bisect.bisect_left(self.rooms, (length, -1))
        gone = None
        if i < len(self.rooms):
            room, w = self.rooms.pop(i)
        else:
            if len(self.rooms) >= self.most:
                gone = self.rooms.pop(0)[1]
            room, w = self.window, self.next_id
            self.next_id += 1
        left = room - length
        if left:
            bisect.insort(self.rooms, (left, w))
        else:
            gone = w if gone is None else gone
        return w, self.window - room, gone

    def open(self) -> set[int]:
        return {w for _, w in self.rooms}


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids, with the end id behind them, are cut into full windows and a rest. ``tokenizer`` is a file of
    the tokenizers library, at the same place on all machines; one whose parts WordTokenizer doesn't know encodes
    whole texts, at the library's speed.

    Nulls and empties: a null or empty text is the end id alone. Repeated rows are packed as documents of their own;
    a null doc_id stays null. An empty table gives no rows; other columns are ignored. Whole texts are read; a task
    holds one text's ids and its open windows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [*[f.split()[0] for f in PIECE.split(", ")], "part"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tok, packer, out = word_tokenizer(tokenizer), Packer(window, open_windows), []
        for batch, texts in text_runs(batches, SLICE_CHARS):
            for doc, ids in zip(batch.column(0).to_pylist(), tok.ids(texts), strict=True):
                ids += end  # noqa: PLW2901
                n, view = len(ids) // 4, memoryview(ids)
                for start in range(0, n, window):
                    size = min(window, n - start)
                    w, offset, _ = packer.place(size)
                    out.append((doc, start, size, zlib.crc32(view[4 * start : 4 * (start + size)]), n, w, offset, part))
            if len(out) >= 50_000:
                yield _rows(out, schema)
                out = []
        # rows of windows that stay open can't be told apart before the end; the last row names them
        out += [(None, -1, w, 0, 0, w, 0, part) for w in sorted(packer.open())]
        tok.forget()  # the worker's next task may need the memory
        yield _rows(out, schema)

    told = materialize(rows.mapInArrow(lean(run, tokenizer), PIECE + ", part bigint"), "pieces")
    key = F.col("part") * (1 << 33) + F.col("sequence_id")
    left = told.filter("start = -1").select("part", "sequence_id", F.lit(True).alias("left"))
    pieces = told.filter("start >= 0").join(left, ["part", "sequence_id"], "left")
    closed = pieces.filter("left is null").withColumn("sequence_id", key)
    merged = pieces.filter("left").withColumn("team", F.floor(F.col("part") / MERGE_PARTITIONS).cast("bigint"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pieces of open windows anew, largest first, best fit; ids of their own space. Any number may be open."""
        team = int(pdf.team.iloc[0])
        pdf = pdf.sort_values(["length", "part", "sequence_id", "offset"], ascending=[False, True, True, True])
        packer = Packer(window, 1 << 60)
        spots = [packer.place(int(n))[:2] for n in pdf.length]
        return pdf.assign(sequence_id=[(1 << 62) + team * (1 << 33) + w for w, _ in spots], offset=[o for _, o in spots])[names[:-1]]

    tail = merged.select(*names, "team").groupBy("team").applyInPandas(merge, PIECE)
    return closed.select(*names[:-1]).unionByName(tail)


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
