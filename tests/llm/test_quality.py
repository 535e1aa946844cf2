import random
import re
from collections import Counter

from sentinelle.llm import quality

SCHEMA = "doc_id long, text string, q_words string, H int, i int"


def brute(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    repeat = {i + k for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n_symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(ws), sum(map(len, ws)), n_symbols, len(lines) - len(set(lines)), len(repeat), len(ws) < 50 or 100 * len(repeat) > 50 * len(ws)


def texts():
    r = random.Random(2)
    odd = [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "a b c", "a a a", "a a a a", "\x1c\x85  b", "x\ny\nx\n\n \nx", "#*$%&|<> é日本", "a b c a b c d"]
    return odd + [" ".join(r.choice("abcd") for _ in range(r.randrange(1, 200))).replace("a b", "a\nb") for _ in range(60)]


def measured(frame):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return frame.select("doc_id", *[f"q_{x}" for x in names], "q_kept").collect()


def test_counts_against_plain_python(spark):
    rows = [(k, t, "clash", k, k) for k, t in enumerate(texts())] + [(0, "a a a", None, None, None), (None, "a a a", None, None, None)]
    got = measured(quality.judge(spark.createDataFrame(rows, SCHEMA)))
    assert sorted((tuple(r[:7]) for r in got), key=str) == sorted(((k, *brute(t)) for k, t, *_ in rows), key=str)
    assert not any(r.q_base_failed and r.q_kept for r in got)


def test_kept_returns_the_columns_it_was_given(spark):
    good = " ".join(f"the word{k}" for k in range(60))
    rows = [(1, good, "mine", 4, 5), (1, good, "mine", 4, 5), (None, good, None, None, None), (2, None, "x", 1, 1)]
    got = quality.kept(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows[:3], key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judge(empty).count() == 0
    assert quality.kept(empty).count() == 0


def test_a_very_long_text_of_distinct_words(spark):
    one = spark.range(1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 1000000), x -> hex(x * 2003))) AS text")
    two = spark.range(1).selectExpr("id + 1 AS doc_id", "concat_ws(' ', 'p q r', concat_ws(' ', transform(sequence(1, 1000000), x -> hex(x))), 'p q r') AS text")
    got = {r.doc_id: (r.q_n_words, r.q_n_repeat_words) for r in measured(quality.judge(one.union(two)))}
    assert got == {0: (1_000_000, 0), 1: (1_000_006, 6)}
