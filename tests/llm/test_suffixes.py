import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sentinelle.llm import skew, suffixes
from sentinelle.session import table

SCHEMA = "doc_id long, text string, h string"


def brute(docs, length=200):
    raws = [(t or "").encode() for _, t, *_ in docs]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, *_), r in zip(docs, raws, strict=True):
        gone = np.zeros(len(r) + 1, np.int32)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        cut = np.cumsum(gone[:-1]) > 0
        rest = bytes(b for b, c in zip(r, cut, strict=True) if not c)
        out.append((d, len(r), int(cut.sum()), len(suffixes.runs(cut)), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=str)


def sample(r=None):
    r = r or random.Random(11)
    text = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    shared = [text(n) for n in (199, 200, 201, 260, 700)]
    docs = [(i, text(r.randrange(0, 500)) + r.choice(shared) + text(r.randrange(0, 300)), "x") for i in range(40)]
    docs += [(100, None, "x"), (101, "", "x"), (102, "a" * 1000, "x"), (103, "ab" * 300, "x"), (104, shared[0], "x"), (105, shared[1], "x")]
    docs += [(106, docs[0][1], "x"), (106, docs[0][1], "x"), (None, docs[1][1], None), (None, None, None), (107, text(5000) + shared[3] + text(70) + shared[3], "x")]
    # An edit every so often, so that repeats end inside stretches.
    base = text(1500)
    docs += [(200 + k, base[: (j := r.randrange(1500))] + "#" + base[j + 1 :], "x") for k in range(20)]
    return docs


@pytest.mark.parametrize(("step", "bin_", "crowd"), [(1 << 20, 4 << 20, 12000), (400, 3000, 6), (300, 1, 10**6), (10**6, 3000, 1)])
def test_against_all_windows(spark, monkeypatch, step, bin_, crowd):
    monkeypatch.setattr(suffixes, "STEP", step)
    monkeypatch.setattr(suffixes, "BIN", bin_)
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(skew, "HEAD", 20)
    docs = sample()
    assert result(suffixes.removed(spark.createDataFrame(docs, SCHEMA))) == brute(docs)


def test_empty_table(spark):
    assert suffixes.removed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_two_stage_order_and_prefixes(monkeypatch):
    monkeypatch.setattr(suffixes, "LENGTH", 16)
    r = random.Random(3)
    for letters in ("ab", "abc", "a", "abcdefghij"):
        for n in (1, 2, 40, 300):
            raw = bytes(r.choice(letters).encode()[0] for _ in range(n))
            text = np.frombuffer(raw, np.uint8)
            word = suffixes.eights(text)
            order = suffixes.suffix_array(text, word)
            assert sorted(order.tolist()) == list(range(n))
            heads = [raw[i : i + 16].ljust(16, b"\0") for i in order]
            assert heads == sorted(heads)
            prefix = suffixes.common_prefixes(word, order)
            for k in range(1, n):
                same = next((j for j in range(16) if heads[k][j] != heads[k - 1][j]), 16)
                assert prefix[k] == same


def test_query_on_the_small_table(spark):
    from sentinelle.llm.q_suffixes import op7_repeated_strings

    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert result(op7_repeated_strings(spark, "/root/testdata/sf0.001")) == brute(docs)


def test_spans_of_one_document_are_united(spark):
    spans = [(1, 0, 5, 6), (1, 0, 6, 7), (1, 0, 205, 300), (1, 0, 499, 500), (1, 0, 700, 710), (1, 1, 0, 1)]
    got = suffixes.united(spark.createDataFrame(spans, suffixes.SPANS)).select("d", "h", "lo", "hi").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 5, 500), (1, 0, 700, 710), (1, 1, 0, 1)]
