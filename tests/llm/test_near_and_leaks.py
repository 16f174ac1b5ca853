"""Near-duplicates and leaks: against plain loops over all pairs, and on odd rows."""

import random
from itertools import combinations

import numpy as np
import pytest

from codelattice.llm import leakage, neardup
from codelattice.llm.units import words_of

from ..helpers import rows

COLUMNS = "pid long, body string, class string, key string, keys string, sig string, bucket string"
WORDS = [f"wort{i}" for i in range(400)]


def noisy(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [rng.choice(WORDS)], [w[i], rng.choice(WORDS)]])
    return " ".join(w)


def shingles(text, width):
    w = words_of(text or "")
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= 20 else set()


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = " ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 120)))
        texts += [base, *(noisy(rng, base, rng.randint(0, 14)) for _ in range(4))]
    texts += [texts[0].upper(), texts[0].replace(" ", "\n-- "), "zu kurz", None, "", "   ", " ".join(WORDS[:20] * 3000), "same " * 30, "same " * 40]
    return texts


@pytest.mark.parametrize(("width", "threshold", "bucket"), [(3, (3, 5), 128), (5, (4, 5), 128), (3, (3, 5), 2)])
def test_all_pairs(spark, passages, width, threshold, bucket):
    more = ("x",) * 5
    data = [(i, t, *more) for i, t in enumerate(passages)]
    df = spark.createDataFrame([*data, *data[:7], (None, passages[0], *more)], COLUMNS).repartition(5)
    members, links = neardup.near_duplicates(df, "pid", "body", width=width, threshold=threshold, bucket=bucket)
    got = rows(neardup.pairs_of_keys(members, links, "pid"))
    sets = {i: s for i, t in enumerate(passages) if (s := shingles(t, width))}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * threshold[1] >= threshold[0] * len(sets[a] | sets[b])}
    # 'same same ...' of different lengths is one shingle, and the sequences differ
    assert got == want and (0, len(passages) - 9) in got and (len(passages) - 2, len(passages) - 1) in got
    by_key = neardup.classes(members, links, "pid").collect()
    assert {r.pid for r in by_key} == set(sets) and len(by_key) == len(sets)
    group = {r.pid: r.group_key for r in by_key}
    assert all(group[a] == group[b] for a, b in want)


def test_a_third_of_all_rows_may_be_copies(spark):
    rng = random.Random(8)
    text = " ".join(rng.choice(WORDS) for _ in range(50))
    data = [(i, text if i % 3 == 0 else " ".join(rng.choice(WORDS) for _ in range(40))) for i in range(600)]
    members, links = neardup.near_duplicates(spark.createDataFrame(data, "pid long, body string").repartition(6), "pid", "body")
    assert links.count() == 0 and members.count() == 600 and members.select("class").distinct().count() == 401


def test_a_template_family_is_split(spark):
    """Most rows are variants of one template: their A buckets are crowded, and so are some tensored ones."""
    rng = random.Random(11)
    base = [rng.choice(WORDS) for _ in range(80)]
    texts = []
    for _ in range(160):
        w = list(base)
        for i in rng.sample(range(80), rng.randint(1, 4)):
            w[i] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(80)]
    members, links = neardup.near_duplicates(spark.createDataFrame([*enumerate(texts), *enumerate(texts)], "pid long, body string").repartition(6), "pid", "body", width=3, threshold=(3, 5), bucket=20)
    sets = [shingles(t, 3) for t in texts]
    want = {(a, b) for a, b in combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    got = rows(neardup.pairs_of_keys(members, links, "pid"))
    assert got <= want and len(got) >= 0.999 * len(want) > 5_000


def test_empty_passages(spark):
    members, links = neardup.near_duplicates(spark.createDataFrame([], "pid long, body string"), "pid", "body")
    assert members.count() == 0 and links.count() == 0 and neardup.pairs_of_keys(members, links, "pid").count() == 0


# -- leaks

DOCS = "doc_id long, text string, words string, key string, item_id string"
ITEMS = "item_id long, item_text string, k string, t string"


def leaks(docs, items, n=10):
    grams = {}
    for k, t in items:
        w = words_of(t or "")
        for i in range(len(w) - n + 1):
            grams.setdefault(tuple(w[i : i + n]), set()).add(k)
    return {(d, k) for d, t in docs for w in [words_of(t or "")] for i in range(len(w) - n + 1) for k in grams.get(tuple(w[i : i + n]), ())}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice(WORDS[:150]) for _ in range(rng.randint(3, 60)))) for k in range(40)] + [(40, None), (41, ""), (42, "x"), (43, "der gleiche anfang " * 4 + "a b c"), (44, "der gleiche anfang " * 4 + "d e f")]
    docs = []
    for d in range(300):
        w = [rng.choice(WORDS) for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            it = words_of(rng.choice(items[:40])[1])
            a, n = rng.randrange(len(it)), rng.choice([8, 9, 10, 11, 30])
            w[len(w) // 2 : len(w) // 2] = it[a : a + n]
        docs.append((d, ", ".join(w)))
    docs += [(300, None), (301, ""), (302, " \n"), (303, "y " * 100_000 + items[0][1]), (304, "Der GLEICHE Anfang " * 4), (305, items[1][1]), (306, "ende")]
    return docs, items


def test_every_leak(spark, corpus):
    docs, items = corpus
    d = [(*x, "x", "x", "x") for x in docs]
    df = spark.createDataFrame([*d, d[3], (None, items[5][1], "x", "x", "x")], DOCS).repartition(4)
    it = spark.createDataFrame([*((*x, "x", "x") for x in items), (0, items[0][1], "x", "x"), (None, items[1][1], "x", "x")], ITEMS)
    got = leakage.leaked(df, it)
    want = leaks(docs, items)
    assert rows(got) == want and got.count() == len(want) > 20 and (304, 43) in want and (304, 44) in want
    assert leakage.leaked(df.limit(0), it).count() == 0 and leakage.leaked(df, it.limit(0)).count() == 0


def test_paraphrases(spark):
    rng = random.Random(7)
    items = [(k, " ".join(rng.sample(WORDS, 48))) for k in range(20)]
    docs = [(d, " ".join(rng.choice(WORDS) for _ in range(100))) for d in range(60)]
    for d in range(20):  # a word in five is another: hardly ten in a row are left
        w = items[d][1].split()
        w[::5] = [rng.choice(WORDS) for _ in w[::5]]
        docs.append((100 + d, " ".join(w)))
    got = rows(leakage.paraphrased(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"), least_telling=0.4).select("doc_id", "item_id"))
    want = {(100 + d, d) for d in range(20)}
    assert len(got & want) >= 18 and len(got - want) <= 2


def test_short_items_in_long_documents(spark):
    rng = random.Random(9)
    items = [(k, " ".join(rng.sample(WORDS, rng.randint(10, 40)))) for k in range(60)]
    docs = [(d, " ".join(rng.choice(WORDS) for _ in range(300))) for d in range(60)]
    for d in range(60):
        w = [rng.choice(WORDS) for _ in range(300)]
        at = rng.randrange(300)
        w[at:at] = items[d][1].split()
        docs.append((100 + d, " ".join(w)))
    docs += [(200, ""), (201, None), (202, "ganz anders"), (203, " ".join(["x"] * 50)), (204, items[7][1])]
    got = rows(leakage.paraphrased(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).select("doc_id", "item_id"))
    want = {(100 + d, d) for d in range(60)} | {(204, 7)}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 3


def test_common_subsequence():
    a, b = np.array([1, 2, 3, 4, 1]), np.array([3, 4, 1, 2, 1, 3])
    table = np.zeros((6, 7), int)
    for i in range(5):
        for j in range(6):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    assert leakage.common_subsequence(a, b) == table[5, 6]
    assert leakage.common_subsequence(np.array([1, 1, 1]), np.array([1])) == 1
