import hashlib
import math
import random
import re
import unicodedata
import weakref
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphtension.llm import chat, common, jaccard, language, mixing, neardup_vectors, packing, substrings, topk, toxicity, urls
from graphtension.llm.queries import QUERIES

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def text(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def corpus(seed=3):
    """Copies, near copies, shared passages, short, empty, null and repeated rows."""
    rng = random.Random(seed)
    base = [text(rng, rng.choice([3, 8, 60, 130, 400])) for _ in range(40)]
    passage = text(rng, 70)
    rows = list(enumerate(base))
    for i in range(40, 90):
        w = base[rng.randrange(40)].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((i, "\n".join([" ".join(w), passage] if i % 5 == 0 else [" ".join(w)])))
    rng.shuffle(rows)
    return [*rows, (90, None), (91, ""), (92, " \t"), (93, "one"), (94, "ONE"), rows[0]]


def by_links(sets, num, den):
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            o = len(sets[x] & sets[y])
            if x < y and sets[x] and sets[y] and den * o >= num * (len(sets[x]) + len(sets[y]) - o):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(t, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_join_is_brute_force(spark, k, num):
    rows = corpus()
    want = by_links({i: shingles(t, k) for i, t in rows}, num, 100)
    got = jaccard.join(docs(spark, rows).withColumn("n", F.lit("clash")), k, num, 100).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, k)) for i, t in rows}


def test_substring_dedup_is_brute_force(spark):
    rows = corpus(5)
    first = {}
    for i, t in sorted(set(rows), key=lambda x: x[0]):
        w = WORD.findall(t or "")
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    want = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    about, cut = substrings.repeats(docs(spark, rows))
    cut = {r.doc_id: (r.n_removed, r.kept) for r in cut.collect()}
    for r in about.collect():
        n, removed, kept = want[r.doc_id]
        assert r.n_words == n
        got = (n, "") if r.whole else cut.get(r.doc_id, (0, None))
        assert got[0] == removed and (got[1] is None or got[1] == kept)
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    left = {r.doc_id: r.text for r in substrings.without_repeats(docs(spark, full, DOC)).collect()}
    assert all(" ".join((left[i] or "").split()) == want[i][2] for i in left)
    assert {i for i in want if want[i][0] and not want[i][2]}.isdisjoint(left)


def thue_morse():
    """Two words of 1024 characters that any polynomial hash modulo 2^64 takes for one."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    return a, b


def test_crafted_words_stay_apart(spark):
    a, b = thue_morse()
    got = jaccard.join(docs(spark, [(1, a), (2, b), (3, "x " * 3 + a), (4, "x " * 3 + b), (5, a)]), 4, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    tail = " ".join(f"w{i}" for i in range(50))
    about, cut = substrings.repeats(docs(spark, [(1, f"{a} {tail[:-1]}"), (2, f"{b} {tail[:-1]}x")]))
    assert not cut.filter("n_removed > 0").collect() and not about.filter("whole").collect()
    # the same trick with whole words in place of characters
    rows = [(1, " ".join(f"p{c}" for c in a[:64])), (2, " ".join(f"p{c}" for c in b[:64]))]
    assert not substrings.repeats(docs(spark, rows))[1].filter("n_removed > 0").collect()


def test_ids_that_repeat_with_other_texts(spark):
    rng = random.Random(9)
    x, y, z = (text(rng, 120, 10_000) for _ in range(3))
    rows = [(1, x), (2, y), (2, z), (3, z + " end"), (4, y), (5, z)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, rows), 4, 85, 100).collect()}
    assert got == {(1, 117, 1), (2, 117, 2), (3, 118, 2), (4, 117, 2), (5, 117, 2)}
    left = sorted((r.doc_id, r.text) for r in substrings.without_repeats(docs(spark, [(1, x), (2, f"{x} a b"), (2, f"c d {y}"), (3, f"{y} e")])).collect())
    assert left == [(1, x), (2, "a b"), (2, f"c d {y}"), (3, "e")]


@pytest.mark.parametrize("first", [0, 1])
def test_second_look_finds_what_the_first_leaves(spark, monkeypatch, first):
    """A hash that many components share, more pairs of two of them than the first look tries."""
    monkeypatch.setattr(jaccard, "FIRST_PAIRS", first)
    monkeypatch.setattr(jaccard, "PART", 7)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 2)
    rows = corpus(11)
    got = {r.doc_id: r.component_id for r in jaccard.join(docs(spark, rows), 4, 60, 100).collect()}
    assert got == by_links({i: shingles(t, 4) for i, t in rows}, 60, 100)


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(12)
    long = text(rng, 150_000, 50_000)
    rows = [(1, long), (2, f"{long} more"), (3, "short"), (4, None)]
    got = {r.doc_id: r.component_id for r in jaccard.join(docs(spark, rows), 5, 80, 100).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    df = docs(spark, rows)
    for c in ("_kept", "_whole", "kept", "whole", "d", "t", "tag", "gone", "n_removed", "_size", "_bin", "p_source", "_copy", "_base", "_cut", "base", "cut"):
        df = df.withColumn(c, F.lit(77))
    df = df.withColumn("source", F.lit("s"))
    for out in (substrings.without_repeats(df), jaccard.one_of_each(df), mixing.resample(df)):
        assert out.columns == df.columns and {r["_size"] + r["_kept"] + r["cut"] for r in out.collect()} == {231}
    assert {r.doc_id: r.text for r in substrings.without_repeats(df).collect()} == {1: long, 2: "more", 3: "short", 4: None}


def test_mixing(spark):
    rows = [(i, "a " * (i % 7 + 1), f"s{i % 4}" if i % 9 else None) for i in range(600)] + [(601, None, "s1"), (0, "a ", None)]
    got = mixing.mix(docs(spark, rows, "doc_id bigint, text string, source string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.size * r.copies
        assert 0 <= r.copies <= 3
    assert sum(x[1] for x in by.values()) == pytest.approx(sum(x[2] for x in by.values()))
    assert all(abs(taken - target) <= 0.05 * target + 7 and target <= 3 * size + 1e-6 for taken, target, size in by.values())
    sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 1000)], "source string, source_size bigint")
    assert {r.source: r.target for r in mixing.source_targets(sizes, (1, 2, 3), 3.0).collect()} == pytest.approx({"a": 30, "b": 300, None: 780})


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, rng.choice([0, 5, 700, 6000]))) for i in range(60)] + [(60, None), (61, "Hej <|endoftext|> ½ é́"), (1, "again")]
    path = packing.tokenizer_path()
    got = packing.pack(docs(spark, rows), path, open_windows=4).toPandas()
    tok = packing.WordTokenizer(path)
    ids = {i: tok.whole(t or "") + (2).to_bytes(4, "little") for i, t in rows if i != 1}
    for doc, g in got[got.doc_id != 1].groupby("doc_id"):
        g = g.sort_values("start")
        assert g.length.sum() == len(ids[doc]) // 4 == g.doc_tokens.iloc[0]
        for r in g.itertuples():
            assert zlib.crc32(ids[doc][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 4096


def test_word_ids_are_the_library_s():
    tok = packing.WordTokenizer(packing.tokenizer_path())
    rng = random.Random(2)
    chars = [*"abcXYZ  \t\n'.,!0123é_sS", "́", "\u0085", "　", "ß", "İ", "漢", "\x1c", "²", "'ll", "<|endoftext|>"]
    for _ in range(500):
        t = "".join(rng.choice(chars) for _ in range(rng.randrange(12)))
        assert tok.ids([t])[0] == tok.whole(t)


def test_chat_round_trip_and_branches(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\b<|im_end|>\n<|im_start|>user\nx", "<<SYS>>", "", None, "\\", "[/INST"]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(odd)] + [(2, 0, "we\\ird\nrole", "x"), (2, 0, None, "y")]
    segs = chat.segments(chat.chain(docs(spark, rows, "conv_id bigint, turn bigint, role string, text string")))
    for r in segs.collect():
        assert not re.search(r"<s>|</s>|\[/?INST\]|<</?SYS>>", r.segment) and r.segment.count("<|") == 2
    got = {r.conv: r for r in chat.digests(segs).collect()}
    said = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:7])
    loss = "".join(t or "" for _, _, r, t in rows[:7] if r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1].n_turns == 7 and got[1].loss_chars == len(loss) and got[2].n_turns == 2
    tree = [(5, 1, None, 0.0), (5, 2, 1, 1.0), (5, 3, 1, 2.0), (5, 4, 2, 5.0), (5, 5, 99, 1.0), (5, 7, 8, 1.0), (5, 8, 7, 1.0)]
    p = chat.paths(spark.createDataFrame(tree, "conv bigint, node bigint, parent bigint, score double"), keep=None).collect()
    found = {}
    for r in sorted(p, key=lambda r: r.pos):
        found.setdefault((r["rank"], r.leaf), []).append(r.node)
    assert found == {(1, 4): [1, 2, 4], (2, 3): [1, 3], (3, 5): [5]}


def test_language(spark):
    rng = random.Random(4)
    make = {"aa": "ka lo mi ta".split(), "bb": "ster umf gra pli".split()}
    rows = [(i, " ".join("".join(rng.choices(make[x], k=2)) for _ in range(30)), x) for i in range(60) for x in [["aa", "bb"][i % 2]]]
    rows += [(100, None, "aa"), (101, "12 !?", "bb"), (102, "KALO", None)]
    df = docs(spark, rows, "doc_id bigint, text string, lang string")
    bloom = language.train(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df.drop("lang").withColumn("score", F.lit("x")), bloom).collect()}
    assert all(got[i][0] == x for i, _, x in rows[:60]) and got[100] == got[101] == ("und", 0.0) and got[102][0] == "aa"
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*range(60), 102}
    assert language.identify(df, language.BitSlicedBloom([])).filter("lang_pred <> 'und'").count() == 0


def plain_grams(t):
    """Trigrams of letters and marks, one gap for anything else; the middle is never a gap."""
    kind = lambda c: unicodedata.category(c)[0]
    w = ["", *"".join(c if kind(c) in "LM" else " " for c in t.lower()).split(" "), ""]
    chars = [0, *[x for word in w if word for x in (*map(ord, word), 0)]]
    return [(chars[i - 1], chars[i], chars[i + 1]) for i in range(1, len(chars) - 1) if chars[i]]


def test_bloom_is_brute_force():
    rng = random.Random(21)
    letters = [*"abcdefgh ÄÖé", "é", "ж", "日", "1", "-", "\0", "ﬁ", "İ"]
    texts = ["", " ", "123", "a", *["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(80)]]
    keys, at, has = language.grams(texts)
    for i, t in enumerate(texts):
        mine = [(k & 0x1FFFFF, k >> 21 & 0x1FFFFF, k >> 42) for k in keys[at[i] : at[i + 1]].tolist()]
        assert mine == plain_grams(t) and has[i] == any(unicodedata.category(c)[0] == "L" for c in t.lower())
    names = [f"l{i:02}" for i in range(70)]  # more than one plane
    for langs in (names[:3], names):
        bloom = language.BitSlicedBloom(langs, bits=11)
        known = [{tuple(rng.choice(plain_grams(rng.choice(texts[3:])) or [(0, 97, 0)])) for _ in range(40)} for _ in langs]
        number = lambda g: g[0] | g[1] << 21 | g[2] << 42
        for i, grams in enumerate(known):
            bloom.add(i, np.array([number(g) for g in grams], np.uint64))

        def places(g):
            out = []
            for p in range(3):
                h = number(g) * int(language._MULT[p]) % 2**64
                h ^= h >> 29
                out.append((h * int(language._MULT[(p + 1) % 3]) % 2**64) >> (64 - 11))
            return out

        filters = [{x for g in grams for x in places(g)} for grams in known]
        rates = [(len(f) / 2**11) ** 3 for f in filters]
        lang, score, _ = bloom.predict(texts)
        for i, t in enumerate(texts):
            grams = plain_grams(t)
            c = [max(0.0, (sum(set(places(g)) <= f for g in grams) - r * len(grams)) / (1 - r)) for f, r in zip(filters, rates)]
            letter = any(unicodedata.category(x)[0] == "L" for x in t.lower())
            best = max(range(len(langs)), key=lambda j: (c[j], -j))
            assert lang[i] == (langs[best] if letter else "und")
            assert score[i] == pytest.approx(c[best] / sum(c) if letter and sum(c) > 0 else 0.0)


def test_lexicon_is_brute_force():
    rng = random.Random(22)
    weights = {" bad": 2.0, " badi": 1.0, "adi": 0.5, "d b": 3.0, " e ": 1.5}
    lex = toxicity.Lexicon(weights, [" bad e ", "badib"])
    a = lex.automaton()
    for _ in range(300):
        f = toxicity.fold("".join(rng.choices("bad ie", k=rng.randrange(30))))
        spared = [(i, i + len(x)) for x in lex.exceptions for i in range(len(f)) if f.startswith(x, i)]
        best = {}
        for i in range(len(f)):
            fits = [p for p in weights if f.startswith(p, i) and not any(x <= i and i + len(p) <= y for x, y in spared)]
            if fits:
                p = max(fits, key=len)
                best[p] = best.get(p, 0) + 1
        mass, n = lex.mass(f, a)
        assert mass == pytest.approx(sum(weights[p] * math.log2(1 + t) for p, t in best.items())) and n == len(f.split())


def test_held_out_documents(spark):
    """Floors of what the README states: languages, and toxic documents, that weren't learned from."""
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, sf).filter("held_out").join(d.filter("lang is not null"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    sf = "/root/testdata/sf0.1"  # fewer labels name too few toxic documents
    lab = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    got = QUERIES["op3_toxicity"](spark, sf).filter("held_out").join(lab, "doc_id").toPandas()
    yes, no = got.score[got.toxic == 1].to_numpy(), got.score[got.toxic != 1].to_numpy()
    auc = ((yes[:, None] > no).mean() + (yes[:, None] == no).mean() / 2) if len(yes) and len(no) else 1.0
    assert auc > 0.95 and 2 * ((got.predicted == 1) & (got.toxic == 1)).sum() / (got.predicted.sum() + got.toxic.sum()) > 0.9


def test_toxicity_of_odd_tables(spark):
    lex = toxicity.Lexicon({" vermin": 3.0}, [], 0.05, 0.25)
    none = docs(spark, [])
    assert toxicity.score(none, lex).count() == 0 and toxicity.train(none, spark.createDataFrame([], "doc_id bigint, toxic int")).weights == {}
    few = toxicity.train(docs(spark, [(i, "vermin vermin") for i in range(3)]), spark.createDataFrame([(i, 1) for i in range(3)], "doc_id bigint, toxic int"))
    assert few.weights == {}  # fewer toxic texts than an entry needs
    rows = [(1, "vermin " * 200_000), (2, "plain " * 200_000), (2, "plain"), (2, "plain"), (None, "vermin vermin")]
    got = sorted(((r.doc_id or 0), r.predicted) for r in toxicity.score(docs(spark, rows).withColumn("score", F.lit("x")), lex).collect())
    assert got == [(0, 1), (1, 1), (2, 0), (2, 0), (2, 0)]


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["wretch", "dolt", "vermin"]
    rows, labels = [], []
    for i in range(200):
        w = text(rng, 40).split()
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    lex = toxicity.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"), exceptions=["vermin control"])
    probe = [(1, "you dolt, you wretch"), (2, "you d0lt, you wr3tсh"), (3, "w1 w2 w3"), (4, None), (5, ""), (6, "vermin control vermin control")]
    got = {r.doc_id: r for r in toxicity.score(docs(spark, probe), lex).collect()}
    assert [got[i].predicted for i in range(1, 7)] == [1, 1, 0, 0, 0, 0] and got[4].score == 0
    empty = toxicity.train(docs(spark, rows), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(docs(spark, probe), empty).filter("score > 0").count() == 0


def test_toxicity_sees_all_phrases_of_long_texts(spark):
    """More than fifty phrases stand beside entries, and those that tell come last by the alphabet."""
    many = " ".join(f"a{x}{y} vermin" for x in "bcdefghj" for y in "bcdefghj")
    rows = [(i, f"{many} zed") for i in range(50)] + [(i, f"w{i} vermin zed" if i < 53 else f"{many} yaw" if i < 56 else f"plain words {i}") for i in range(50, 200)]
    lex = toxicity.train(docs(spark, rows), spark.createDataFrame([(i, int(i < 50)) for i, _ in rows], "doc_id bigint, toxic int"))
    assert " vermin zed " not in lex.exceptions and " vermin yaw " in lex.exceptions


VEC = "vec_id bigint, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + rng.normal(size=8) * 0.05).tolist(), i % 2) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0), (203, [0.0] * 8, 0), (204, [float("nan")] * 8, 1), (205, [1.0, None] * 4, 1), (206, rows[0][1], None), (207, [], 0)]
    return rows


def test_vector_search_is_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VEC)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, df.filter("vec_id % 50 = 0"), 5).collect()]
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, _ in rows if i not in (202, 204, 205)]
    pad = lambda v: np.pad(v, (0, 8 - len(v)))
    want = []
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(pad(x) @ pad(y)), i) for i, y in good if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_vector_links_are_brute_force(spark):
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup_vectors.link(spark.createDataFrame(rows, VEC)).collect()}
    good = {i: (np.array(v, np.float32).astype(float), x) for i, v, x in rows if i < 202}
    unit = {i: v / np.linalg.norm(v) for i, (v, _) in good.items()}
    near = {i: {j for j in good if j != i and good[i][1] == good[j][1] and unit[i] @ unit[j] >= 0.98} for i in good}
    for i, _, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        assert got[i] == (len(near.get(i, ())), min(reach), min(reach) == i)


def test_vectors_that_share_an_id_are_linked_each_by_itself(spark):
    """Ids from a few, in turn on equal, near and far vectors, against all pairs of rows."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 6))
    rows = [(int(rng.integers(0, 40)), (base[i % 12] + rng.normal(size=6) * 0.08 * (i % 4)).tolist(), i % 2) for i in range(140)]
    rows += [(5, rows[0][1], 0), (5, rows[0][1], 0), (5, rows[1][1], 0), (None, rows[0][1], 0)]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup_vectors.link(spark.createDataFrame(rows, VEC)).collect()]
    x = np.array([np.array(v, np.float32).astype(float) for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None])
    near &= np.array([r[0] is not None for r in rows])[:, None] & np.array([r[0] is not None for r in rows])[None]
    np.fill_diagonal(near, False)
    want = []
    for i, (v, _, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(near[todo.pop()]).tolist()) - reach
            reach |= new
            todo += new
        least = None if v is None else min(rows[j][0] for j in reach)
        want.append((v, int(near[i].sum()), least, least == v))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_scores_of_long_vectors_are_exact(spark):
    rng = random.Random(13)
    top = (1 << 22) - 1
    rows = [(i, [float(top - rng.randrange(5)) / 256 * rng.choice([1, 1, 1, -1]) for _ in range(2048)], 0) for i in range(6)]
    df = spark.createDataFrame([(i, v, x) for i, v, x in rows], "vec_id bigint, embedding array<double>, label int")
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    want = []
    for q in (0, 3):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    got = topk.search(df, df.filter("vec_id % 3 = 0"), 3).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want
    # ids that repeat with other vectors: one query, the smallest vector; each row a candidate
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, topk.search(two, two.filter("vec_id = 0"), 5).select("rank", "vec_id", "score").collect()))
    assert got == [(1, 1, 128 * 512), (2, 1, 128 * 256)]


def test_urls(spark):
    rows = [(1, "http://A.Example.com/en/71?x", None), (2, "https://example.com/en/8", ""), (3, "//x", "<a href='/a'>"), (4, None, "x"), (5, "http://b.net/de/1#f", '<a href="/x">'), (6, "http://c.org/es", ""), (7, "http://c.org/es/1", ""), (8, "http://d.net/x", '<a href="http://c.org/y">')]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i].rule for i in range(1, 9)] == ["example.com/en/7", "com/en/", None, None, "net/de/", None, "org/es/", None]
    assert [got[i].verdict for i in range(1, 9)] == ["allow", "block", "allow", "allow", "allow", "block", "block", "block"]
    many = [*urls.RULES, *[("block", f"h{i}.test/") for i in range(300)]]
    again = {r.page_id: r.rule for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string"), many).collect()}
    assert again == {i: got[i].rule for i in got}


def test_trust_settles_over_a_long_chain(spark):
    """Hosts far from every seed, against the fixed point solved densely."""
    rows = [(0, "http://example.com/en/7", "<a href='http://h0.x/'><a href='mailto:a@b'><a href='javascript:f()'>")]
    rows += [(i + 1, f"http://h{i}.x/", f"<a href='http://h{i + 1}.x/'><a href='http://h{max(i - 2, 0)}.x/'>") for i in range(9)]
    rows += [(20, "http://h9.x/", "<a href='//c.org/y'><a href='/own'>"), (21, "http://c.org/es/1", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages = df.select("page_id", urls.host_of(F.col("url")).alias("host"), "html")
    links = urls.host_links(pages)
    assert {(r.src, r.dst) for r in links.filter("src = 'example.com'").collect()} == {("example.com", "h0.x")}
    seeds = spark.createDataFrame([("example.com", 1, 0), ("c.org", 0, 1)], "host string, trusted bigint, blocked bigint")
    got = {r.host: r for r in urls.propagate(links, seeds).collect()}
    names = sorted(got)
    at = {h: i for i, h in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in links.collect():
        m[at[r.src], at[r.dst]] += r.n
    for way, seed, col in ((m, "example.com", "trust"), (m.T, "c.org", "distrust")):
        w = way.copy()
        w[w.sum(1) == 0] = np.eye(len(names))[w.sum(1) == 0]
        start = np.zeros(len(names))
        start[at[seed]] = 1
        want = np.linalg.solve(np.eye(len(names)) - 0.85 * (w / w.sum(1, keepdims=True)).T, 0.15 * start)
        assert [got[h][col] for h in names] == pytest.approx(want.tolist(), abs=1e-5)


def test_pipeline_is_plain_python(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    make = {"aa": [f"{x}{y}" for x in "klmt" for y in ("a", "oi", "ua", "emo")], "bb": [f"{x}{y}" for x in ("st", "gr", "pl", "br") for y in ("erz", "ums", "ack", "iff")]}
    prose = lambda lang, n: [rng.choice(make[lang]) + rng.choice(make[lang]) for _ in range(n)]
    rows = [(i, " ".join(prose(x, rng.choice([30, 90, 300]))), x, f"s{i % 4}" if i % 7 else None) for i in range(60) for x in [["aa", "bb"][i % 2]]]
    passage = prose("aa", 70)
    for i in range(60, 90):
        w = rows[rng.randrange(60)][1].split()
        w[rng.randrange(len(w))] = "kakaka"
        rows.append((i, " ".join(w + passage * (i % 3 == 0)), "aa", f"s{i % 4}"))
    rows += [(90, None, "aa", "s1"), (91, "12 34 ?", "bb", "s1"), (92, "", None, None), rows[5]]
    full = [(i, t, x, s, len(t or "")) for i, t, x, s in rows]
    docs(spark, full, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in full if r[1] and any(c.isalpha() for c in r[1])]
    comp = by_links({r[0]: shingles(r[1], 5) for r in kept}, 80, 100)
    kept = [r for r in kept if comp[r[0]] == r[0]]
    first = {}
    for r in sorted(kept):
        w = r[1].split()
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), r[0])
    cut = []
    for r in kept:
        w = r[1].split()
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < r[0]:
                gone[j : j + 50] = [True] * 50
        left = " ".join(x for x, g in zip(w, gone) if not g)
        if left:
            cut.append((r[0], left if any(gone) else r[1], r[3]))
    sizes = {}
    for _, t, s in cut:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in free)
        full_ones = {s for s in free if 3 * sizes[s] < level * weight[s]}
        if not full_ones:
            break
        target |= {s: 3.0 * sizes[s] for s in full_ones}
        free -= full_ones
    target |= {s: level * weight[s] for s in free}
    copies = []
    for s in order:
        mine = [(int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:8], 16) % 4096, len(t.split()), i, t) for i, t, x in cut if x == s]
        rate = target[s] / sizes[s]
        goal = (rate - int(rate)) * sizes[s]
        edges = [(abs(goal), 0)] + [(abs(sum(n for b, n, _, _ in mine if b <= e) - goal), e + 1) for e in {b for b, _, _, _ in mine}]
        edge = min(edges)[1]
        for b, _, i, t in mine:
            copies += [(i, t)] * (int(rate) + (b < edge))
    tok = packing.WordTokenizer(packing.tokenizer_path())
    want = sorted((i, len(tok.whole(t)) // 4 + 1, zlib.crc32(tok.whole(t) + (2).to_bytes(4, "little"))) for i, t in copies)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.doc_tokens, r.ids_crc32) for r in got) == want
    docs_now = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("_size", F.lit("x"))
    empty = docs_now.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_now = stage(spark, docs_now, str(tmp_path))
        assert docs_now.columns[-1] == "_size", name
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert docs_now.count() == len(copies)


def test_chat_of_odd_trees(spark):
    kind = "conv bigint, node bigint, parent bigint, score double, role string, text string"
    tree = [(1, 1, None, 0.0, "user", "a"), (1, 2, 1, 1.0, "assistant", "z"), (1, 2, 1, 1.0, "assistant", "b"), (1, 2, 1, 1.0, "assistant", "b")]
    tree += [(2, 1, 2, 0.0, "user", "x"), (2, 2, 1, 0.0, "user", "y"), (2, 3, 2, 0.0, "user", "below a cycle")]
    df = spark.createDataFrame(tree, kind).withColumn("rank", F.lit("clash")).withColumn("pos", F.lit("clash")).withColumn("up", F.lit(1))
    got = sorted((r.conv, r.pos, chat.read_turn(r.segment)) for r in chat.segments(df).collect())
    assert got == [(1, 0, ("user", "a")), (1, 1, ("assistant", "b"))]
    assert chat.segments(spark.createDataFrame([], kind)).count() == 0
    least = -(2**63)
    rows = docs(spark, [(least, 0, "user", "p"), (None, 0, "user", "q"), (None, 1, "assistant", "x" * 3_000_000)], "conv_id bigint, turn int, role string, text string")
    out = {r.conv: r.n_turns for r in chat.digests(chat.segments(chat.chain(rows))).collect()}
    assert out == {least: 1, chat.none_of(rows): 2} and chat.none_of(rows) != least


def test_other_tokenizers_encode_whole_texts():
    tok = packing.WordTokenizer(packing.tokenizer_path("byte_bpe_50k.json"))
    assert not tok.known and tok.ids(["Hello  World", ""]) == [tok.whole("Hello  World"), b""]
    assert packing.WordTokenizer(packing.tokenizer_path()).known


def test_empty_tables(spark):
    none = docs(spark, [], DOC)
    assert jaccard.join(none).count() == 0 and jaccard.one_of_each(none).count() == 0
    assert substrings.without_repeats(none).count() == 0 and mixing.mix(none).count() == 0 and mixing.resample(none).count() == 0
    assert packing.pack(none, packing.tokenizer_path()).count() == 0 and language.keep_identified(none).count() == 0
    v = spark.createDataFrame([], VEC)
    assert topk.search(v, v).count() == 0 and neardup_vectors.link(v).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_ten_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


def test_a_worker_holds_its_tokenizer_for_tasks_of_packing_alone():
    """Workers outlive their tasks: a table of words that stays counts beside all later operators' memory."""
    path = packing.tokenizer_path()
    held = weakref.ref(packing.word_tokenizer(path))
    assert held() is not None
    list(common.lean(lambda batches: batches)(iter(())))
    assert held() is None
    held = weakref.ref(packing.word_tokenizer(path))
    list(common.lean(lambda batches: batches, path)(iter(())))
    assert held() is packing.word_tokenizer(path)
    common.let_go()
