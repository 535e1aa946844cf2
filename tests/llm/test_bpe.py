import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sentinelle.llm import bpe
from sentinelle.llm.q_bpe import tokenizer_path

SCHEMA = "doc_id long, text string, ids string"


def library(text):
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def texts():
    r = random.Random(5)
    long_word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000))
    likely = "".join(r.choice(["the", "ing", "tion", "er", "an", "s"]) for _ in range(3000))
    runs = ["a" * 4097, "!?" * 1500, "é" * 1300, "日本語" * 700, "x'st" * 600, long_word, likely, likely + "<|endoftext|>" + long_word]
    return [None, "", " \n\t", "Plain text, isn't it?", "ÀÉÎ ΣΑΣ İstanbul ́x é", "<|startoftext|>a<|ENDOFTEXT|> <|endoftext|>", "\x00\x1c\x85  q", *runs, " ".join(runs)]


def test_same_ids_and_text_as_the_library(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(3, "Plain text, isn't it?", None)]
    got = bpe.encode(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), ids="coded").collect()
    assert len(got) == len(rows)
    assert {r.ids for r in got} == {"clash", None}
    for r in got:
        ids, said = library(rows[r.doc_id][1])
        assert np.frombuffer(r.coded, "<u4").tolist() == ids, r.doc_id
        assert r.decoded == said, r.doc_id


@pytest.mark.parametrize("leaf", [1, 3, 5, 16])
def test_trees_equal_one_encoding(monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "MANY", 50)
    c, r = bpe.Coder(tokenizer_path()), random.Random(1)
    found = ["".join(r.choice("theinaoxzé'") for _ in range(r.randrange(1, 90))) for _ in range(400)]
    for word, tree in zip(found, c.trees(found), strict=True):
        assert [i for i, _ in tree] == c.last.encode(word, add_special_tokens=False).ids
        assert sum(n for _, n in tree) == len(word)


def test_a_long_unsplit_run_in_a_table(spark):
    r = random.Random(8)
    run = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    got = bpe.encode(spark.createDataFrame([(1, f"start {run} end", ""), (2, run[:99], "")], SCHEMA), tokenizer_path(), ids="coded").collect()
    for row, text in zip(sorted(got, key=lambda x: x.doc_id), (f"start {run} end", run[:99]), strict=True):
        assert (np.frombuffer(row.coded, "<u4").tolist(), row.decoded) == library(text)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA).drop("ids"), tokenizer_path()).count() == 0


def test_query_against_the_library(spark):
    from sentinelle.llm.q_bpe import op10_bpe_round_trip
    from sentinelle.session import table

    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    got = op10_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids, said = library(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
