import random
import re
from collections import Counter

import numpy as np
import pytest

from sentinelle.llm import bagmin
from sentinelle.session import table

SCHEMA = "doc_id long, text string, print string"


def bag(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs):
    """Least id of the component, and links between different bags, by comparing all pairs."""
    bags = [bag(t) for _, t, *_ in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [set() for _ in docs]
    for i in range(len(docs)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)]) for i, (d, *_) in enumerate(docs))


def near(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.randrange(10**9)}"
    return " ".join(words)


def sample():
    r = random.Random(7)
    docs = [(900, None, "x"), (901, "", "x"), (902, " .,", "x"), (903, "Two words", "x"), (904, "two words!", None), (905, "two word", "x"), (906, "a a a a a a a a", "x"), (907, "a a a a a a a a a", "x")]
    for g in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(30, 400))]
        docs += [(g * 50 + k, near(r, base, r.randrange(0, len(base) // 25)), "x") for k in range(r.randrange(1, 14))]
    docs.append((903, "Two words", "x"))
    docs.append((950, " ".join(f"w{i % 50}" for i in range(30000)), "x"))
    return docs


@pytest.mark.parametrize(("hot", "block"), [(2048, 256), (4, 8)])
def test_classes_against_all_pairs(spark, monkeypatch, hot, block):
    monkeypatch.setattr(bagmin, "HOT", hot)
    monkeypatch.setattr(bagmin, "BLOCK", block)
    monkeypatch.setattr(bagmin, "LEADERS", 3)
    docs = sample()
    got = bagmin.classes(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(docs)
    assert all(r.class_id == r.doc_id for r in got if r.doc_id in (900, 901, 902))


def test_first_of_each_keeps_columns(spark):
    docs = spark.createDataFrame(sample(), SCHEMA)
    got = bagmin.first_of_each(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({c for _, c in brute(sample())})


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bagmin.classes(empty).count() == 0
    assert bagmin.first_of_each(empty).count() == 0


def test_signatures_are_unbiased():
    r = np.random.default_rng(0)
    off = []
    for _ in range(100):
        a = r.integers(0, 2**63, 60).astype(np.uint64)
        wa = r.integers(1, 9, 60)
        wb = np.where(np.arange(60) < r.integers(0, 40), r.integers(1, 9, 60), wa)
        h = bagmin.signatures(2, np.repeat([0, 1], 60), np.concatenate((a, a)), np.concatenate((wa, wb)))
        off.append((h[0] == h[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(off)) < 0.012


def test_query_against_all_pairs_on_the_small_table(spark):
    from sentinelle.llm.q_bagmin import op9_near_duplicates

    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = op9_near_duplicates(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(docs)


def classes_by_matrix(texts):
    """The least place of each text's component over all pairs; for many texts of which no shingle repeats in one."""
    bags = [set(bag(t)) for t in texts]
    n = Counter(s for b in bags for s in b)
    column = {s: k for k, s in enumerate(s for s in n if n[s] > 1)}
    held = np.zeros((len(bags), len(column)), np.float32)
    for i, b in enumerate(bags):
        held[i, [column[s] for s in b if s in column]] = 1
    size = np.array([len(b) for b in bags])
    least = np.arange(len(bags))
    both = held @ held.T
    linked = both >= 0.8 * (size[:, None] + size[None] - both) - 1e-3
    while True:
        after = np.array([least[row].min() for row in linked])
        if (after == least).all():
            return least.tolist()
        least = after


def spread(r, words, edits):
    """`edits` words changed, so far apart that each breaks five shingles."""
    words = list(words)
    step = len(words) // edits
    for k in range(edits):
        words[k * step + 4 + r.randrange(step - 9)] = f"new{r.randrange(10**9)}"
    return " ".join(words)


def test_a_star_of_copies_that_are_near_to_the_original_only(spark):
    r = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base)] + [spread(r, base, 4) for _ in range(3000)]
    want = classes_by_matrix(texts)
    assert set(want) == {0}
    got = bagmin.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))


def test_links_that_look_less_alike_than_others_are_kept(spark):
    texts = []
    for g in range(3):
        r = random.Random(g)
        base = [f"g{g}w{k}" for k in range(200)]
        texts += [near(r, base, 3 if g < 2 else 4) for _ in range(200)]
    got = bagmin.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(classes_by_matrix(texts)))


def test_null_ids_and_one_id_with_two_texts_lose_nothing(spark):
    r = random.Random(5)
    one, two, three, four = ([f"{c}{k}" for k in range(60)] for c in "abcd")
    rows = [(None, " ".join(one)), (None, near(r, one, 1)), (None, " ".join(two)), (None, " ".join(two)), (7, " ".join(three)), (7, " ".join(four)), (8, near(r, four, 1)), (None, near(r, three, 1)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(k.doc_id, k.text and k.text[0]) for k in bagmin.first_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a"), (None, "b"), (7, "c"), (7, "d"), (None, None)], key=str)
    found = {k.print: (k.class_id, k.class_print) for k in bagmin.classes(docs).collect() if k.print}
    assert sorted(Counter(found.values()).values()) == [1, 2, 2, 2]


def test_recall_on_templated_pages(spark):
    """700 pairs at 0.815 among 1,400 texts that are all 0.774 alike: at least nine links of ten, and no false one."""
    template = [f"t{k}" for k in range(175)]
    texts = []
    for g in range(700):
        one = template + [f"g{g}w{k}" for k in range(25)]
        two = list(one)
        for k in (179, 184, 189, 194):
            two[k] = f"g{g}new{k}"
        texts += [" ".join(one), " ".join(two)]
    got = {r.doc_id: r.class_id for r in bagmin.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(Counter(got.values()).values()) <= {1, 2}
    found = sum(got[2 * g] == got[2 * g + 1] == 2 * g for g in range(700))
    print("recall", found / 700)
    assert found >= 0.9 * 700


def test_which_row_of_one_id_and_the_same_words_stays(spark):
    rows = [(1, "Same words, here.", "b"), (1, "same words here", "a"), (1, "same words here", "c"), (2, "SAME WORDS HERE", "a"), (3, "other", "a"), (3, "Other!", None), (4, None, "x"), (4, None, "x")]
    first = lambda some: sorted(map(tuple, bagmin.first_of_each(spark.createDataFrame(some, SCHEMA).coalesce(1)).collect()), key=str)
    got = first(rows)
    assert [r[0] for r in got] == [1, 3, 4, 4]
    for turn in (rows[::-1], rows[3:] + rows[:3], rows[1:2] + rows[:1] + rows[2:]):
        assert first(turn) == got
