import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sentinelle.llm import lattice
from sentinelle.llm.q_bpe import tokenizer_path
from sentinelle.llm.q_lattice import VOCABULARY, op5_lattice_score

PIECES = [b"\xff", b"\xffa", b"a", b"b", b"ab", b"ba", b"aba", b"\xffab"]


def all_ways(text, p):
    """The sum over segmentations, one by one."""
    return 1.0 if not text else sum(p[x] * all_ways(text[len(x) :], p) for x in p if text.startswith(x))


def test_forward_sums_all_segmentations():
    probability = np.array([0.2, 0.1, 0.15, 0.15, 0.1, 0.1, 0.1, 0.1])
    have = lattice.Pieces(PIECES, np.log(probability))
    found = ["a", "b", "abab", "abaabba", "bbbbbbbbbbbb"]
    got = lattice.word_scores(pa.array([w.encode() for w in found]), have)
    for w, s in zip(found, got, strict=True):
        assert s == pytest.approx(math.log10(all_ways(b"\xff" + w.encode(), dict(zip(PIECES, probability, strict=True)))))


def test_expected_uses_match_enumeration():
    probability = dict(zip(PIECES, [0.2, 0.1, 0.15, 0.15, 0.1, 0.1, 0.1, 0.1], strict=True))

    def ways(text):
        if not text:
            yield ()
        for x in PIECES:
            if text.startswith(x):
                for rest in ways(text[len(x) :]):
                    yield (x, *rest)

    text, uses, total = b"\xffabab", Counter(), 0.0
    for way in ways(text):
        q = math.prod(probability[x] for x in way)
        total += q
        for x in way:
            uses[x] += q
    have = lattice.Pieces(PIECES, np.log(list(probability.values())))
    which, share = lattice.expected(*lattice.lattices(np.frombuffer(text, np.uint8).astype(np.uint64)[None], have), np.array([3.0]))
    got = np.bincount(which, weights=share, minlength=len(PIECES))
    assert got == pytest.approx([3 * uses[x] / total for x in PIECES])


@pytest.mark.parametrize("part", [1, 2, 7, 1000])
def test_a_long_word_part_by_part(monkeypatch, part):
    monkeypatch.setattr(lattice, "PART", part)
    have = lattice.Pieces(PIECES, np.log([0.2, 0.1, 0.15, 0.15, 0.1, 0.1, 0.1, 0.1]))
    text = np.frombuffer(b"\xffabaabbabababbbaab", np.uint8)
    whole = lattice.lattices(text.astype(np.uint64)[None], have)
    sums = [x for f in lattice.long_forward(text, have) for x in f]
    assert sums == pytest.approx(whole[2][0, -len(sums) :].tolist())
    count = lambda which, share: np.bincount(which, weights=share, minlength=len(PIECES))
    got = sum(count(*x) for x in lattice.long_expected(text, have, 3.0))
    assert got == pytest.approx(count(*lattice.expected(*whole, np.array([3.0]))))


def test_long_and_short_words_meet_at_the_bound(monkeypatch):
    pieces, p = lattice.vocabulary(tokenizer_path(VOCABULARY))
    have = lattice.Pieces(pieces, np.log(p))
    assert have.widest > 16
    words = pa.array(["x" * 256, "неправительственных" * 9, "ab1" * 40], pa.string()).cast(pa.binary())
    short = lattice.word_scores(words, have)
    monkeypatch.setattr(lattice, "LONG", 10)
    assert lattice.word_scores(words, have) == pytest.approx(short)


def base(docs):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = {k: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for k, (i, _) in enumerate(docs)}
    c = Counter(w for k, (_, t) in enumerate(docs) if not held[k] for w in cut(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, held[k], len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in cut(t)), 6)) for k, (i, t) in enumerate(docs)), key=str)


@pytest.mark.parametrize("head", [0, 3, 100000])
def test_scores_against_plain_counting(spark, monkeypatch, head, tmp_path):
    monkeypatch.setattr(lattice, "HEAD", head)
    docs = [(i, f"the cat {'sat ' * (i % 5)}on Éé w{i} İ") for i in range(40)] + [(5, None), (5, ""), (6, "x" * 3000), (6, "x" * 3000), (7, "ab1" * 300_000), (None, " a\tb\n")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_lattice_score(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base(docs)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = {}
    for r in got:
        same.setdefault((r.doc_id, r.n_tokens), set()).add(round(r.score, 6))
    assert all(len(x) == 1 for x in same.values())


def test_fitting_helps_on_held_out_text(spark):
    from sentinelle.llm.q_lattice import held_out
    from sentinelle.session import table

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").withColumn("held", held_out())
    of = lambda rounds: sum(r.score for r in lattice.score(docs, tokenizer_path(VOCABULARY), "held", rounds=rounds).collect() if r.held_out)
    assert of(1) > of(0) + 1000


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op5_lattice_score(spark, str(tmp_path)).count() == 0


def test_long_words_stay_out_of_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "ab " + "long" * 100 + " ab b" * (i % 3), "extra", i) for i in range(20)], "doc_id long, text string, word string, n int")
    score = lambda: sorted(map(tuple, lattice.score(docs.selectExpr("*", "doc_id % 4 = 1 as held"), tokenizer_path(VOCABULARY), "held").collect()))
    want = score()
    monkeypatch.setattr(lattice, "LONGEST", 1 << 20)
    for a, b in zip(want, score(), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
