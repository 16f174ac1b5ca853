"""Splitting, tokens, reading levels: against plain loops, and on odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from codelattice.llm import reading, splitter, tokenizer, units

from ..helpers import rows

PATH = "/opt/tokenizers/byte_bpe_50k.json"
ODD = "key long, text string, piece_no string, level string, _k string, _t string, ids string, tag string"


def odd(spark, texts):
    """Texts, a repeated row, a null key, and columns whose names clash with inner ones."""
    more = ("x",) * 6
    data = [(i, t, *more) for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[0], (None, texts[0], *more)], ODD)


def test_word_and_white_space_classes():
    import unicodedata

    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        assert bool(units.TOKEN.match(c)) != bool(regex.match(r"\p{White_Space}", c))
        assert bool(units.WORD.match(c)) == (unicodedata.category(c)[0] in "LN")


def test_words():
    assert units.words_of("Der İSTANBUL-Weg: ΟΔΟΣ x²_y e\u0301") == ["der", "i̇stanbul", "weg", "οδος", "x²", "y", "e"]


# -- splitting


def by_hand(text, most=200, least=100, overlap=20):
    spans = [m.span() for m in regex.finditer(r"[^\p{White_Space}]+", text)]
    word = [text[a:b] for a, b in spans]
    gap = [""] + [text[a[1] : b[0]] for a, b in zip(spans, spans[1:])]
    out, a, n = [], 0, len(spans)
    while n - a > most:
        around = range(a + least + 1, a + most + 1)
        ends = lambda w: (s := w.rstrip("\"'”’»)]")) and s[-1] in ".!?…"
        b = max([b for b in around if gap[b].count("\n") >= 2] or [b for b in around if ends(word[b - 1])] or [a + most])
        out.append((a, b - 1))
        a = b - overlap
    return [*out, (a, n - 1)] if n > most else []


def made(rng, n):
    return "".join(rng.choice(["w", "end.", 'said?"', "x…)", "é"]) + rng.choice([" "] * 12 + ["\n\n", " \n \n", "\n", " ", "\xa0"]) for _ in range(n))


def test_pieces_like_the_rule(spark):
    rng = random.Random(4)
    texts = [made(rng, n) for n in (0, 1, 199, 200, 201, 220, 400, 401, 1500)] + ["a " * 900, "long" * 100_000, None, "", " \n\n "]
    got = splitter.split_oversized(odd(spark, texts), "key", "text").where("key is not null").collect()
    want = {(i, k, a, b) for i, t in enumerate(texts) if t for k, (a, b) in enumerate(by_hand(t))}
    assert {(r.key, r.piece_no, r.first_word, r.last_word) for r in got} == want and len(got) == len(want)
    for r in got:
        assert r.piece == texts[r.key][slice(*(lambda s: (s[r.first_word][0], s[r.last_word][1]))([m.span() for m in units.TOKEN.finditer(texts[r.key])]))]
    assert splitter.split_oversized(odd(spark, texts).limit(0), "key", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_least_total_cost(kinds):
    kind, most, least, overlap, price, balance = np.array([*kinds, 2]), 8, 4, 2, (0.0, 0.3, 1.0), 0.7
    n = len(kind) - 1

    def cost(a):
        if n - a <= most:
            return balance * ((most - (n - a)) / most) ** 2
        return min(price[kind[b]] + balance * ((most - (b - a)) / most) ** 2 + cost(b - overlap) for b in range(a + least + 1, a + most + 1))

    pieces = splitter.cut(kind, most, least, overlap, price, balance)
    total = sum(price[kind[b + 1]] * (b + 1 < n) + balance * ((most - (b + 1 - a)) / most) ** 2 for a, b in pieces)
    assert abs(total - cost(0)) < 1e-9
    assert pieces[0][0] == 0 and pieces[-1][1] == n - 1
    assert all(b2 == a1 + 1 - overlap for (_, a1), (b2, _) in zip(pieces, pieces[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(0, 4))
def test_costs_compared_cut_by_cut(kinds, overlap):
    kind, most, least = np.array([*kinds, 2]), 8, 4
    n = len(kind) - 1

    def least_way(a):
        """Costs of the cuts, compared in order, and pieces."""
        if n - a <= most:
            return (), ((a, n - 1),)
        return min(((((int(kind[b]), most - (b - a)),) + least_way(b - overlap)[0], ((a, b - 1),) + least_way(b - overlap)[1]) for b in range(a + least + 1, a + most + 1)), key=lambda x: x[0])

    if n <= 24:
        assert tuple(splitter.cut(kind, most, least, overlap)) == least_way(0)[1]
    pieces = splitter.cut(kind, most, least, overlap)
    for (a, last), (a2, _) in zip(pieces, pieces[1:]):
        b = last + 1
        assert a2 == b - overlap and (kind[b], -b) == min((kind[x], -x) for x in range(a + least + 1, a + most + 1))


def test_docids(spark):
    passages = spark.createDataFrame([(i, "w " * 201) for i in range(5)], "pid long, passage_text string")
    mapping = spark.createDataFrame([(0, "a_b_1", 1), (0, "c_1", 2), (1, None, 5), (1, "old_1", 1), (2, "none", 1), (3, "e__7", None)], "pid long, original_docid_chunkidx string, written_at int")
    got = splitter.traced_pieces(passages, mapping).where("piece_no = 0")
    assert rows(got.select("pid", "docid")) == {(0, "c"), (1, ""), (2, ""), (3, "e_"), (4, "")}


# -- tokens


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.Encoder(tokenizer.load_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def same(encoder, library, texts):
    offsets, ids = encoder.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == library(texts)
    assert [encoder.automaton.decode(ids[a:b]).decode() for a, b in zip(offsets, offsets[1:])] == texts


def test_tokens_like_the_library(encoder, library):
    rng = random.Random(1)
    same(encoder, library, ["aaa", "aaaaaaa", "", " ", "<|endoftext|> it's", "naïve 🎉👩‍👩‍👧", "é", "\r\n\t \xa0 x", "=" * 5000, "ab" * 3000])
    for letters in ("eatnso ", "ABCDEFabcdef0123456789+/", " \n\t-=_.#*", "".join(map(chr, [*range(0x20, 0x250), *range(0x400, 0x480), *range(0x4E00, 0x4E80), *range(0x1F600, 0x1F640)]))):
        same(encoder, library, ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)])


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text_like_the_library(encoder, library, text):
    same(encoder, library, [text])


def test_small_merges_against_the_rule():
    """All words over two letters: the automaton against merging pair by pair."""
    from itertools import product

    merges = [(0, 0, 2), (0, 1, 3), (2, 0, 4), (1, 3, 5), (2, 3, 6), (5, 5, 7)]
    spelled = {0: b"a", 1: b"b", 2: b"aa", 3: b"ab", 4: b"aaa", 5: b"bab", 6: b"aaab", 7: b"babbab"}
    m = tokenizer.MergeAutomaton({"bytes": spelled, "merges": merges})
    for n in range(1, 11):
        for w in product((0, 1), repeat=n):
            ids = list(w)
            for u, v, x in merges:
                out, i = [], 0
                while i < len(ids):
                    if i + 1 < len(ids) and (ids[i], ids[i + 1]) == (u, v):
                        out.append(x)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            assert m.encode(b"".join(b"ab"[c : c + 1] for c in w)) == ids


def test_every_row_has_ids(spark, library):
    texts = ["x y", None, "", "  ", "long " * 200_000]
    got = tokenizer.encode_documents(odd(spark, texts), "key", "text", PATH)
    assert got.count() == 7 and got.where("key is null").count() == 1
    assert {r.key: r.ids for r in got.where("key is not null").collect()} == dict(enumerate(library([t or "" for t in texts])))
    back = tokenizer.decode_ids(got, "key", "ids", PATH)
    assert {r.key: r.text for r in back.where("key is not null").collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokenizer.encode_documents(odd(spark, texts).limit(0), "key", "text", PATH).count() == 0


# -- reading levels


def level(text):
    w = regex.findall(r"\p{L}+", text)
    if len(w) < 20:
        return None
    s = max(1, len(regex.findall(r"""[.!?…]++["'”’»)\]]*+(?=\p{White_Space}|\Z)""", text)))
    return 1 + sum(len(w) / s + 100 * sum(len(x) > 6 for x in w) / len(w) >= x for x in (20, 35, 50, 65))


def test_levels(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["cat", "seventy", "elephants", "wörter", "x2y", "日本語"]) + rng.choice([" ", " ", ". ", '?!") ', "… ", ".a", ".\n"]) for _ in range(rng.randint(5, 80))) for _ in range(200)]
    texts += ["cat " * 20, "cat " * 19, None, "", "\n", "cat. " * 200_000, "seventy " * 13 + "cat " * 7 + "."]
    got = reading.formula_levels(odd(spark, texts), "key", "text").where("key is not null")
    assert {r.key: r.level for r in got.collect()} == {i: v for i, t in enumerate(texts) if t and (v := level(t))}
    assert reading.formula_levels(odd(spark, texts).limit(0), "key", "text").count() == 0


@pytest.mark.parametrize("words", [False, True])
def test_models_learn_the_levels(spark, words):
    rng = random.Random(3)
    easy, hard = ["cat", "dog", "sun", "run", "hat"], ["elephantine", "characteristic", "notwithstanding", "bureaucracy"]
    text = lambda words: " ".join(rng.choice(words) for _ in range(30)) + "."
    df = spark.createDataFrame([*((i, text(easy) if i % 2 else text(hard), "x") for i in range(200)), (200, None, "x"), (201, "", "x"), (202, "cat " * 19, "x"), (None, text(easy), "x")], "key long, text string, words string")
    got = reading.unigram_levels(df, "key", "text", sample=60, words=words)
    want = {r.key: r.level for r in reading.formula_levels(df, "key", "text").collect()}
    have = {r.key: r.level for r in got.collect()}
    assert have.keys() == want.keys() and np.mean([have[k] == want[k] for k in want]) > 0.95
    assert got.where("posterior <= 0 or posterior > 1").count() == 0
    assert reading.unigram_levels(df.limit(0), "key", "text", words=words).count() == 0
    given = spark.createDataFrame([(i, 4 if i % 2 else 2) for i in range(200)], "key long, level int")
    by_label = reading.unigram_levels(df, "key", "text", words=words, labels=given).collect()
    assert np.mean([r.level == (4 if r.key % 2 else 2) for r in by_label if r.key is not None]) > 0.95


def plain_posteriors(texts, words):
    """Models of all texts by loops and np.quantile: level and posterior of each text."""
    n = np.array([[len(regex.findall(r"\p{L}+", t)), len(regex.findall(r"\p{L}{7,}", t)), len(regex.findall(r"[.!?…]+(?=\s|$)", t))] for t in texts])
    levels, scores, of = np.array([level(t) for t in texts]), [], []
    u = np.stack([n[:, 0] - n[:, 1], n[:, 1], n[:, 2]], 1)
    cut = lambda x, k: np.searchsorted(np.quantile(x, np.linspace(0, 1, k + 1)[1:-1]), x)
    said = [units.words_of(t) for t in texts]
    count = {v: Counter(w for s, own in zip(said, levels) if own == v for w in s) for v in np.unique(levels)}
    every = sum(count.values(), Counter())
    known = {w for w, c in every.items() if c >= 3}

    def model(c):
        merged = Counter(dict.fromkeys([*known, None], 0.5))
        for w, x in c.items():
            merged[w if w in known else None] += x
        total = sum(merged.values())
        return {w: x / total for w, x in merged.items()}

    for v in np.unique(levels):
        own = levels == v
        if words:
            here, all_ = model(count[v]), model(every)
            scores.append([np.log(own.mean()) + sum(np.log((here[w] + all_[w]) / 2) for w in (w if w in known else None for w in s)) for s in said])
            of.append(v)
            continue
        first = cut((u[own][:, 2] + 0.5) / n[own][:, 0], 16)
        for i in np.unique(first):
            rows = u[own][first == i]
            second = cut((rows[:, 1] + 0.5) / rows[:, :2].sum(1), 4)
            for j in np.unique(second):
                c = rows[second == j].sum(0) + 0.5
                scores.append(np.log((second == j).sum() / len(texts)) + u @ np.log(c / c.sum()))
                of.append(v)
    return reading.likeliest(np.array(scores).T, np.array(of))


@pytest.mark.parametrize(("words", "size"), [(False, 21_000), (True, 400)])
def test_models_are_of_all_rows(spark, words, size):
    rng = random.Random(5)
    some = ["cat", "dog", "sun", "characteristic", "elephants", "seventy", "notwithstanding"]
    texts = []
    for _ in range(size):
        mine = rng.sample(some, 3)
        texts.append(" ".join(rng.choice(mine) + rng.choice(["", "", "", "", "", "."]) for _ in range(rng.randint(20, 45))) + f". {'rare' if rng.random() < 0.5 else 'once' + chr(97 + rng.randrange(26)) * rng.randint(1, 9)}")
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "key long, text string").repartition(4)
    got = {r.key: (r.level, r.posterior) for r in reading.unigram_levels(df, "key", "text", words=words).collect()}
    want, sure = plain_posteriors(texts, words)
    assert len(got) == size and [got[i][0] for i in range(size)] == want.tolist()
    assert np.abs(np.array([got[i][1] for i in range(size)]) - sure).max() < 1e-6


def test_held_out_levels_of_the_documents(spark):
    """Of documents not trained on, at least eight in ten get the formula's level."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: r.level for r in reading.unigram_levels(docs, "doc_id", "text", sample=5_000).collect()}
    want = {r.doc_id: r.level for r in reading.formula_levels(docs, "doc_id", "text").collect()}
    h = docs.where("length(text) >= 39").selectExpr("doc_id", "xxhash64(cast(doc_id as string), text) as h").orderBy("h").collect()
    rest = [r.doc_id for r in h[5_000:] if r.doc_id in want]
    assert got.keys() == want.keys() and np.mean([got[k] == want[k] for k in rest]) >= 0.8
