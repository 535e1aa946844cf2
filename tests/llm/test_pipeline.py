import hashlib
import random
import re
from collections import Counter

import numpy as np
import test_bagmin
import test_bpe
import test_decontam
import test_lines

import corpus_pipeline
from sentinelle.llm.quality import RULES, STOP_WORDS
from sentinelle.session import table

SF = "/root/testdata/sf0.001"


def good(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(ws)
    seen = Counter(tuple(ws[i : i + 3]) for i in range(n - 2))
    repeat = {i + k for i in range(n - 2) if seen[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    kept = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    if n < 50 or 100 * len(repeat) > 50 * n:
        return False
    of = {"n_words": n, "mean_word_chars": sum(map(len, ws)) / n, "symbol_ratio": len(re.findall(r"[#*$%&|<>]", text)) / n, "stop_ratio": sum(w in STOP_WORDS.split() for w in ws) / n}
    of |= {"dup_line_ratio": (len(kept) - len(set(kept))) / len(kept), "repeat_word_ratio": len(repeat) / n}
    return all((r.low is None or of[r.metric] >= r.low) and (r.high is None or of[r.metric] <= r.high) for r in RULES)


def test_against_plain_python(spark):
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    docs = [d for d in docs if good(d[1])]
    site = {d: s for d, _, s in docs}
    docs = [(d, t) for d, t, gone in test_lines.brute(docs, 5) if not gone or t.strip(" \t\n\x0b\x0c\r")]
    docs = [(d, t) for (d, t), (_, least) in zip(sorted(docs), test_bagmin.brute(sorted(docs)), strict=True) if d == least]
    bad = {d for d, *_, contaminated in test_decontam.brute(docs, items, 13) if contaminated}
    want = {}
    for d, t in docs:
        if d not in bad:
            ids, said = test_bpe.library(t)
            want[d] = (site[d], len(t), np.asarray(ids, "<u4").tobytes(), hashlib.sha256(said.encode()).hexdigest())
    got = {r.doc_id: (r.source, r.n_chars, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert 0 < len(want) < 200


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _key string, _print string, q_words int, line_n int, _line_doc int"


def same(frame, rows):
    assert frame.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(rows, key=str)


def test_stages_on_odd_rows(spark):
    r = random.Random(3)
    text = lambda seed: " ".join(f"{seed}{r.randrange(10**6)} the" for _ in range(40))
    one, two = text("a"), text("b")
    more = ("k", "p", 1, 2, 3)
    row = lambda d, t, source="s": (d, t, "en", source, None if t is None else len(t), *more)
    none = (1, None, None, None, None, None, None, None, None, None)
    rows = [none, row(None, ""), row(2, one), row(2, one), row(2, two), row(None, text("c")), row(3, "few words")]
    frame = spark.createDataFrame(rows, COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    same(stages["quality rules"](spark, frame, SF), rows[2:6])
    same(stages["decontamination"](spark, frame, SF), rows)
    # The two rows of one id and one text are one document; blank ones all stay.
    same(stages["near-duplicates"](spark, frame, SF), rows[:3] + rows[4:])
    plate = [row(k, f"common line\nown {k}", f"s{k}") for k in range(5)] + [row(9, "common line", "s9"), row(10, "\ncommon line\n", None)]
    cut = [row(0, "common line\nown 0", "s0")] + [row(k, f"own {k}", f"s{k}") for k in range(1, 5)]
    same(stages["line dedup"](spark, spark.createDataFrame(rows + plate, COLUMNS), SF), rows + cut)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        same(stage(spark, spark.createDataFrame([], COLUMNS), SF), [])
    assert corpus_pipeline.tokens(spark, frame, SF).count() == len(rows)
