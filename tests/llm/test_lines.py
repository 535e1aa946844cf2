import random

import pytest

from sentinelle.llm import lines, skew

SCHEMA = "doc_id long, text string, source string, line string, place int, _line_doc int"


def brute(docs, spread):
    sites, first = {}, {}
    for d, t, s, *_ in docs:
        for i, x in enumerate([] if t is None else t.split("\n")):
            if x.strip(" \t\n\x0b\x0c\r"):
                sites.setdefault(x, set()).add(s)
                first[x] = min(first.get(x, (d, i)), (d, i))
    out = []
    for d, t, *_ in docs:
        said = [] if t is None else t.split("\n")
        kept = [x for i, x in enumerate(said) if len(sites.get(x, ())) < spread or first[x] == (d, i)]
        out.append((d, None if t is None else "\n".join(kept), len(said) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("near", "head"), [(0.5, 10**4), (0.0, 30), (3.0, 1)])
def test_against_brute_force(spark, monkeypatch, near, head):
    monkeypatch.setattr(skew, "HEAD", head)
    r = random.Random(1)
    docs = [(i, "\n".join(f"line {r.choice([0, 1, 2, 3, r.randrange(60)])}" for _ in range(r.randrange(0, 9))), f"s{r.randrange(12)}", "x", 1, i) for i in range(150)]
    docs += [(500, None, "s1", "x", 1, 1), (501, "", "s2", None, None, None), (502, "\n \n\t\n", "s3", "x", 1, 1), (503, "line 0\nline 0\r\nline 0", None, "x", 1, 1), (504, "line 1\n" * 4000, "s1", "x", 1, 1)]
    frame = spark.createDataFrame(docs, SCHEMA)
    got = lines.without_boilerplate(frame, near=near)
    assert set(frame.columns) < set(got.columns)
    assert sorted(((x.doc_id, x.text, x.line_removed) for x in got.collect()), key=str) == brute(docs, 5)


def test_rows_that_share_an_id(spark):
    docs = [(1, "a", f"s{k}", "", 0, 0) for k in range(6)] + [(1, None, "s", "", 0, 0), (None, "a", "s", "", 0, 0)]
    got = lines.without_boilerplate(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(got) == len(docs)
    assert any(r.text == "a" for r in got)


def test_empty_table(spark):
    assert lines.without_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0
