"""Language identification by a bit-sliced Bloom filter of character trigrams.

One table holds, at every position, a bit for each language. The conjunction of a trigram's positions gives at once
all languages that have the trigram; each language's count over a text, less what false positives add, decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from graphtension.llm.common import lean, table, text_runs

#: About so many labelled documents of each language are learned from, chosen by hash.
SAMPLE_PER_LANGUAGE = 2000
#: At most so many trigrams of a language go into the filter, the most frequent that are typical of it: those at
#: least TYPICAL times as frequent, relative to all, as in the language where they are most frequent.
GRAMS_PER_LANGUAGE, TYPICAL = 20_000, 0.25
#: The filter has 2 ** TABLE_BITS positions; each trigram uses PROBES of them.
TABLE_BITS, PROBES = 20, 3
UNKNOWN = "und"
#: Characters handled at once.
SLICE_CHARS = 1 << 19

_LETTERS: np.ndarray | None = None
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _letters() -> np.ndarray:
    """Which code points are letters or combining marks (a mark never splits a word, but alone is no letter)."""
    global _LETTERS
    if _LETTERS is None:
        kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
        _LETTERS = np.array([1 if k == "L" else 2 if k == "M" else 0 for k in kinds], dtype=np.uint8)
    return _LETTERS


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram keys of all texts, where each text's keys begin (and the total), and which texts have a letter.

    Texts are lower-cased; anything but letters and marks becomes one gap, also at both ends.
    """
    joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _letters()[cp]
    marks = np.flatnonzero(cp == 0)
    doc = np.zeros(len(cp), np.int64)
    doc[marks] = 1
    doc = np.cumsum(doc)
    has = np.bincount(doc[kind == 1], minlength=len(texts)) > 0 if len(cp) else np.zeros(len(texts), bool)
    chars = np.where(kind > 0, cp, 0).astype(np.uint64)
    # one gap between words; a text's own gaps at its ends come from its neighbours' or are added
    prev = np.concatenate([[np.uint64(0)], chars[:-1]])
    keep = (chars > 0) | (prev > 0) | (cp == 0)
    c, d = np.concatenate([[0], chars[keep], [0]]).astype(np.uint64), np.concatenate([[0], doc[keep], [len(texts) - 1]])
    if len(c) < 3:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), has
    mid = c[1:-1] > 0
    key = (c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42))[mid]
    at = np.searchsorted(d[1:-1][mid], np.arange(len(texts) + 1))
    return key, at, has


def _position(keys: np.ndarray, probe: int, bits: int) -> np.ndarray:
    h = keys * _MULT[probe]
    h ^= h >> np.uint64(29)
    return ((h * _MULT[(probe + 1) % 3]) >> np.uint64(64 - bits)).astype(np.int64)


class BitSlicedBloom:
    """Rows of language bits; more than 64 languages take more planes."""

    def __init__(self, languages: list[str], bits: int = TABLE_BITS, probes: int = PROBES) -> None:
        self.languages, self.bits, self.probes = languages, bits, probes
        self.planes = [np.zeros(1 << bits, np.uint8 if len(languages) <= 8 else np.uint64) for _ in range(0, max(len(languages), 1), 64)]

    def add(self, language: int, keys: np.ndarray) -> None:
        plane = self.planes[language // 64]
        for p in range(self.probes):
            plane[_position(keys, p, self.bits)] |= plane.dtype.type(1 << language % 64)

    def false_rates(self) -> np.ndarray:
        """For each language the chance that a strange trigram seems to be its own."""
        fill = [np.count_nonzero(self.planes[i // 64] & self.planes[i // 64].dtype.type(1 << i % 64)) / (1 << self.bits) for i in range(len(self.languages))]
        return np.array(fill) ** self.probes

    def counts(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Documents by languages: how many trigrams each language has."""
        out = np.zeros((len(at) - 1, len(self.languages)))
        spots = [_position(keys, p, self.bits) for p in range(self.probes)]
        for j, plane in enumerate(self.planes):
            mask = plane[spots[0]]
            for s in spots[1:]:
                mask &= plane[s]
            for i in range(j * 64, min(len(self.languages), j * 64 + 64)):
                run = np.concatenate([[0], np.cumsum((mask >> plane.dtype.type(i % 64)) & plane.dtype.type(1), dtype=np.int64)])
                out[:, i] = run[at[1:]] - run[at[:-1]]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and evidence of each text. Score: the winner's share of all languages' corrected counts;
        evidence: the winner's corrected count over the number of trigrams. Ties go to the first language."""
        keys, at, has = grams(texts)
        n = np.diff(at).astype(float)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rate = self.false_rates()
        c = np.clip((self.counts(keys, at) - rate * n[:, None]) / (1 - np.minimum(rate, 0.999)), 0, None)
        best, total = c.argmax(axis=1), c.sum(axis=1)
        top = c[np.arange(len(texts)), best]
        score = np.where(has & (total > 0), top / np.maximum(total, 1e-9), 0.0)
        evidence = np.where(has & (n > 0), np.minimum(top / np.maximum(n, 1), 1.0), 0.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score, evidence


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, limit: int = GRAMS_PER_LANGUAGE) -> BitSlicedBloom:
    """Learn from rows (doc_id, text, lang); null languages are passed over.

    The sample is bounded by ``per_language`` in expectation: a language's rows are kept at the rate that gives it.
    Whole texts of the sample are counted on executors; only the chosen trigrams come to the driver.
    """
    rows = labelled.filter("lang is not null").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = rows.join(F.broadcast(sizes), "lang").filter(u * F.col("n") < per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches, SLICE_CHARS):
            names = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            keys, at, _ = grams(texts)
            for lang in dict.fromkeys(names):
                parts = [keys[at[i] : at[i + 1]] for i, x in enumerate(names) if x == lang]
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"lang": lang, "gram": k.astype(np.int64), "n": n.astype(np.int64)}), schema=out, preserve_index=False)

    out = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    sums = sample.mapInArrow(lean(count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    part = sums.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    typical = part.withColumn("top", F.max("p").over(Window.partitionBy("gram"))).filter((F.col("p") >= TYPICAL * F.col("top")) & (F.col("n") > 1))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    chosen = typical.withColumn("r", rank).filter(F.col("r") <= limit).select("lang", "gram").toPandas()
    known = sorted(r.lang for r in sizes.select("lang").collect())
    bloom = BitSlicedBloom(known)
    for i, lang in enumerate(known):
        bloom.add(i, chosen.gram[chosen.lang == lang].to_numpy(np.int64).astype(np.uint64))
    return bloom


def identify(docs: DataFrame, bloom: BitSlicedBloom) -> DataFrame:
    """Adds lang_pred, score and evidence to every row of ``docs`` (text and any other columns).

    Null texts and texts without a letter get ``und`` and 0; whole texts are read, in slices. Clashing columns of
    ``docs`` with these names are replaced. An empty table gives no rows; a filter that has learned no language
    answers ``und``. The filter that is sent to executors has a fixed size for each language.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(bloom)
    rows = docs.drop("lang_pred", "score", "evidence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches, SLICE_CHARS):
            lang, score, evidence = held.value.predict(texts)
            cols = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(evidence, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "lang_pred", "score", "evidence"])

    kind = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("evidence", DoubleType())])
    return rows.mapInArrow(lean(run), kind)


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bloom = train(docs.filter(remainder(3) != 1))
    out = identify(docs.select("doc_id", "text", (remainder(3) == 1).alias("held_out")), bloom)
    return out.select("doc_id", "held_out", "lang_pred", "score", "evidence")


#: A document whose best language has less than this part of its trigrams is in no learned language.
LEAST_EVIDENCE = 0.05


def keep_identified(docs: DataFrame, labelled: DataFrame | None = None, least: float = LEAST_EVIDENCE) -> DataFrame:
    """The rows of ``docs`` in a learned language, with their columns: neither ``und`` nor without evidence."""
    bloom = train(docs if labelled is None else labelled)
    slim = docs.withColumnsRenamed({c: f"_keep_{c}" for c in ("lang_pred", "score", "evidence") if c in docs.columns})
    out = identify(slim, bloom).filter((F.col("lang_pred") != UNKNOWN) & (F.col("evidence") >= least)).drop("lang_pred", "score", "evidence")
    return out.withColumnsRenamed({f"_keep_{c}": c for c in ("lang_pred", "score", "evidence")}).select(*docs.columns)
