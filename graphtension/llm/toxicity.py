"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matching, exception phrases, density by length.

Folding undoes disguises: homoglyphs, digit and symbol substitutions, zero-width characters, combining marks. Letters
that share a substitute (i, l, 1, !) become one letter, in texts and lexicon alike. The lexicon is learned: word
beginnings, and whole words, that labelled toxic documents have and clean ones hardly do.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtension.llm.common import table
from graphtension.llm.language import remainder

#: At most so many labelled documents are learned from, those with the smallest hashes.
SAMPLE_LABELS = 20_000
#: Word beginnings of these lengths are candidates; a word's end counts as one more character.
SHORTEST, LONGEST = 4, 12
#: A candidate is in at least so many toxic documents; at most so many candidates and entries are kept.
LEAST_TOXIC, MOST_CANDIDATES, MOST_ENTRIES = 4, 50_000, 5_000
#: ... and in at least this part of the toxic documents, so that copies of one document don't teach its words.
LEAST_SHARE = 0.01
#: Powers of the length that the sample chooses from.
POWERS = (1.0, 0.75, 0.5, 0.25)
#: An entry is at least so many times as frequent among toxic documents as among clean ones.
LEAST_RATIO = 12.0
#: Added to the length, so that very short texts don't jump.
LENGTH_FLOOR = 20.0

#: Characters that look like a Latin letter, and substitutes.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ո": "n", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ı": "i", "ɡ": "g", "ɑ": "a",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e", "£": "l",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d",
}
#: The letters that share a substitute.
CLASSES = {"l": "i"}
_SYMBOLS = "@$!|+€£"


class _Fold(dict):
    """Learns the fold of each character as it comes."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        out = ""
        for c in unicodedata.normalize("NFKD", ch).lower():
            c = HOMOGLYPHS.get(c, c)
            kind = unicodedata.category(c[0])
            if kind[0] == "M" or kind == "Cf":
                continue
            out += "".join(CLASSES.get(x, x) for x in c) if kind[0] == "L" else c if len(c) == 1 and c.isalpha() else " "
        self[code] = out
        return out


_FOLD = _Fold()
#: A symbol stands for a letter only inside a word; elsewhere it is a mark: "stop!" isn't "stopi".
_EDGE = re.compile(r"(?<![^\W_])[@$!|+€£]+|[@$!|+€£]+(?![^\W_])")
_SPACES = re.compile(r" +")


def fold(text: str) -> str:
    """Words of letters in classes, one gap between, a gap at both ends."""
    if any(s in text for s in _SYMBOLS):
        text = _EDGE.sub(" ", text)
    return _SPACES.sub(" ", f" {text.translate(_FOLD)} ")


@dataclass
class Lexicon:
    """Entries over folded text: pattern to weight, exceptions, and the density at which a text is toxic."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    cut: float = 1.0
    power: float = 1.0

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (len(p), w, p))
        for p in self.exceptions:
            a.add_word(p, (len(p), 0.0, ""))
        if len(a):
            a.make_automaton()
        return a

    def mass(self, folded: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
        """Summed weights, an entry's repeats counting by logarithm, and the number of words. Of entries that begin
        at one place the longest counts, and none inside an exception."""
        n_words = folded.count(" ") - 1
        hits = [(end - n + 1, end + 1, w, p) for end, (n, w, p) in automaton.iter(folded)] if len(automaton) else []
        spared = [(a, b) for a, b, _, p in hits if not p]
        best: dict[int, tuple[int, float, str]] = {}
        for a, b, w, p in hits:
            if p and not any(x <= a and b <= y for x, y in spared) and b - a > best.get(a, (0, 0.0, ""))[0]:
                best[a] = (b - a, w, p)
        times = Counter((p, w) for _, w, p in best.values())
        return sum(w * math.log2(1 + n) for (_, w), n in times.items()), n_words

    def density(self, folded: str, automaton: ahocorasick.Automaton) -> float:
        total, n_words = self.mass(folded, automaton)
        return total / (n_words + LENGTH_FLOOR) ** self.power

    def score(self, density: float) -> float:
        """0 to 1, 0.5 at the cut."""
        return density / (density + self.cut) if density > 0 else 0.0


def _beginnings(folded: str) -> set[str]:
    """Candidates of a text: a gap, then a word's beginning; with the gap behind it, the whole word."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= SHORTEST:
            full = f" {w} "
            out.update(full[: 1 + n] for n in range(SHORTEST, min(LONGEST, len(w) + 1) + 1))
    return out


def _counter(col: str, only: frozenset[str] | None = None):
    """Rows (text, toxic) to (gram, toxic documents, clean documents), summed in each task in bounded tables."""
    schema = pa.schema([(col, pa.string()), ("t", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tox, clean = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            keys = list(tox.keys() | clean.keys())
            out = pa.RecordBatch.from_pandas(pd.DataFrame({col: pd.Series(keys, dtype=object), "t": [tox[k] for k in keys], "c": [clean[k] for k in keys]}), schema=schema, preserve_index=False)
            tox.clear()
            clean.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _beginnings(fold(text or ""))
                (tox if toxic else clean).update(found if only is None else found & only)
                if len(tox) + len(clean) > 500_000:
                    yield flush()
        yield flush()

    return run


def train(docs: DataFrame, labels: DataFrame, exceptions: list[str] | None = None, sample: int = SAMPLE_LABELS) -> Lexicon:
    """Learn from ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic 0/1); null labels are passed over.

    At most ``sample`` labels are taken, so they are small enough for all executors and texts need no shuffle.

    Phrases of an entry and the word beside it that clean documents have, and toxic ones don't, become exceptions;
    ``exceptions`` adds more. Fewer than LEAST_TOXIC toxic texts teach nothing: every score is 0. Rows that repeat a
    doc_id count each; null texts count as empty.
    """
    chosen = labels.filter("toxic is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = docs.join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    rows = rows.persist()
    try:
        sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        n_t, n_c = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
        if not n_t:
            return Lexicon()
        gram = "gram string, t bigint, c bigint"
        toxic = rows.filter("toxic = 1").mapInArrow(_counter("gram"), gram).groupBy("gram").agg(F.sum("t").alias("t"))
        cand = toxic.filter(F.col("t") >= max(LEAST_TOXIC, LEAST_SHARE * n_t)).orderBy(F.desc("t"), "gram").limit(MOST_CANDIDATES).collect()
        only = frozenset(r.gram for r in cand)
        clean = rows.filter("toxic <> 1").mapInArrow(_counter("gram", only), gram).groupBy("gram").agg(F.sum("c").alias("c")).collect()
        lex = Lexicon(_entries({r.gram: r.t for r in cand}, {r.gram: r.c for r in clean}, n_t, n_c))
        # of the sample, only numbers and the phrases that become exceptions come to the driver
        kind = "toxic int, mass double, words int, phrases array<string>"
        told = lambda: rows.mapInPandas(_masses(lex), kind)
        beside = told().select("toxic", F.explode("phrases").alias("phrase")).groupBy("phrase")
        spared = beside.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") != 1).alias("c")).filter("c >= 3 and t = 0")
        lex.exceptions = sorted([r.phrase for r in spared.select("phrase").collect()] + [_SPACES.sub(" ", fold(x)) for x in exceptions or []])
        found = told().select("toxic", "mass", "words").collect()
        mass, words = np.array([r.mass for r in found]), np.array([r.words for r in found])
        toxic = np.array([r.toxic == 1 for r in found])
        fits = [(_best_cut(mass / (words + LENGTH_FLOOR) ** p, toxic), p) for p in POWERS]
        (_, lex.cut), lex.power = max(fits, key=lambda x: x[0][0])
        return lex
    finally:
        rows.unpersist()


def _masses(lex: Lexicon):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = lex.automaton()
        for pdf in parts:
            told, phrases = [], []
            for text in pdf.text:
                f = fold(text)
                told.append(lex.mass(f, a))
                near = set()
                for end, (n, _, entry) in a.iter(f) if len(a) else ():
                    if entry:
                        lo, hi = f.rfind(" ", 0, max(end - n + 1, 0)), f.find(" ", end)
                        word_end = hi if hi >= 0 else len(f) - 1
                        nxt = f.find(" ", word_end + 1)
                        if lo >= 0:
                            near.add(f[lo : word_end + 1])
                        if nxt > 0:
                            near.add(f[end - n + 1 : nxt + 1])
                phrases.append(sorted(near))
            yield pd.DataFrame({"toxic": pdf.toxic, "mass": [m for m, _ in told], "words": [n for _, n in told], "phrases": phrases})

    return run


def _entries(t: dict[str, int], c: dict[str, int], n_t: int, n_c: int) -> dict[str, float]:
    """The shortest pure beginnings, each grown while (nearly) all its documents go on alike; weight: log odds."""
    odds = lambda g: math.log((t[g] + 0.1) / n_t) - math.log((c.get(g, 0) + 0.1) / max(n_c, 1))
    longer: dict[str, list[str]] = {}
    for g in t:
        longer.setdefault(g[:-1], []).append(g)
    out: dict[str, float] = {}
    todo = [g for g in t if len(g) == 1 + SHORTEST]
    while todo:
        g = todo.pop()
        if odds(g) < math.log(LEAST_RATIO):
            todo += longer.get(g, [])
            continue
        while near := [x for x in longer.get(g, []) if t[x] >= 0.98 * t[g]]:
            g = near[0]
        out[g] = odds(g)
    top = sorted(out, key=lambda g: (-out[g] * math.sqrt(t[g]), g))[:MOST_ENTRIES]
    return {g: out[g] for g in top}


def _best_cut(density: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The best F1 on the sample, and the density from which calling a text toxic gives it, between two neighbours."""
    order = np.argsort(-density)
    d, hit = density[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(d) + 1) + max(toxic.sum(), 1))
    f1[np.append(d[:-1] == d[1:], False) | (d <= 0)] = -1
    i = int(f1.argmax())
    if d[i] <= 0:
        return 0.0, 1.0
    below = d[i + 1] if i + 1 < len(d) else 0.0
    return float(f1[i]), float((d[i] + max(below, 0.0)) / 2)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs`` (doc_id, text).

    Null and empty texts score 0. Whole texts are read. Repeated rows score alike; an empty table gives no rows;
    other columns are ignored. The lexicon that goes to executors has at most MOST_ENTRIES entries, and exceptions
    from a bounded sample.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        a = lex.automaton()
        for batch in batches:
            out = [lex.score(lex.density(fold(t), a)) if t else 0.0 for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.float64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    lexicon = train(docs, labels.filter(remainder(5) != 0))
    return score(docs, lexicon).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")
