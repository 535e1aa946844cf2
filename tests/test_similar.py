"""The similarity join against all pairs."""

import math
import random

import pytest

from sentinelle.operators import similar as S


def alike(a, b):
    return round(len(a & b) / math.sqrt(len(a) * len(b)), 4)


@pytest.mark.parametrize("least", [0.2, 0.4, 0.8, 1.0])
def test_all_pairs(spark, least):
    r = random.Random(2)
    sets = []
    for i in range(150):
        base = r.sample(range(60), r.randrange(1, 25)) if i < 60 or r.random() < 0.5 else [x for x in sets[r.randrange(60)][2] if r.random() < 0.8] + r.sample(range(60, 3000), 2)
        sets.append((i, "xy"[i % 2], sorted({int(x) for x in base})))
    rows = [(i, g, [f"w{x}" for x in s] * (1 + i % 2)) for i, g, s in sets] + [(900, "x", []), (901, "x", None)]
    got = S.pairs(spark.createDataFrame(rows, "id long, g string, tokens array<string>"), least, by=["g"]).collect()
    want = {(a, b): alike(set(x), set(y)) for a, g, x in sets for b, h, y in sets if a < b and g == h and alike(set(x), set(y)) >= least}
    assert {(p.a, p.b): p.similarity for p in got} == want and len(got) == len(want)


def test_equal_sets_are_one(spark):
    rows = [(3, ["a", "b"]), (1, ["b", "a", "a"]), (2, ["a,b"]), (4, []), (5, None)]
    got = S.distinct_sets(spark.createDataFrame(rows, "id long, tokens array<string>"), "id", "tokens").collect()
    assert sorted((r.id, r.copies) for r in got) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("by", [None, ["g"]])
def test_blocks_meet_once_and_no_pair_is_made_for_a_word(spark, monkeypatch, by):
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "STEP", 50)
    r = random.Random(5)
    # All sets share frequent words, most pairs only these.
    sets = [(i, {f"often{x}" for x in r.sample(range(12), 6)} | {f"w{x}" for x in r.sample(range(40 if i % 3 == 0 else 4000), 9)}) for i in range(200)]
    rows = spark.createDataFrame([(i, "g", sorted(s)) for i, s in sets], "id long, g string, tokens array<string>")
    found = S.pairs(rows, 0.4, by=by)
    assert "code" not in str(found._jdf.queryExecution().optimizedPlan())
    want = {(a, b): alike(x, y) for a, x in sets for b, y in sets if a < b and alike(x, y) >= 0.4}
    got = found.collect()
    assert {(p.a, p.b): p.similarity for p in got} == want and len(got) == len(want) > 200
    packed = S.blocks(rows, 0.4, "id", "tokens", by or []).collect()
    assert len(packed) >= 13 and sum(len(b.ids) for b in packed) == 8 * len(sets)


@pytest.mark.parametrize("name", ["lexical_wording_classes", "duplicate_documents"])
def test_texts_are_read_once(spark, name):
    from sentinelle.plans import registry

    plan = str(registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan())
    assert "regexp" not in plan and "text" not in plan


def test_wordings_are_of_whole_texts(spark, tmp_path):
    from sentinelle.plans import registry

    start = "alpha beta " * 300
    rows = [(4, start + "gamma"), (2, start + "delta"), (9, "Beta, alpha: GAMMA"), (7, start), (5, "of the"), (6, None)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["lexical_wording_classes"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.wording for r in got} == {4: 4, 9: 4, 2: 2, 7: 7, 5: 5, 6: 6}
    assert "2000" not in registry.oracle_sql()["lexical_wording_classes"] and "2000" in registry.oracle_sql()["lexical_similarity_pairs"]


def test_each_item_that_an_ask_sees():
    import pandas as pd

    from sentinelle.operators import correlate as R

    r = random.Random(3)
    items = pd.DataFrame([(r.randrange(900), i, 0, r.randrange(900), r.randrange(900), i, *((r.randrange(900), i) if i % 3 else (None, None))) for i in range(400)], columns=["o1", "o2", "o3", "occurred", "born1", "born2", "gone1", "gone2"])
    asks = pd.DataFrame([(i, r.randrange(1, 60), s := r.randrange(900), s + r.randrange(500), lo := r.randrange(900), lo + r.randrange(600), r.randrange(1000), i, i % 2 == 0) for i in range(150)], columns=["ask", "most", "start", "stop", "lo", "hi", "now1", "now2", "whole"])
    got = R._each(items, asks, 16, 40).set_index("ask")
    rows = sorted(items.itertuples(), key=lambda x: (x.o1, x.o2))
    for a in asks.itertuples():
        gone = lambda x: x.gone1 == x.gone1 and (x.gone1, x.gone2) < (a.now1, a.now2)  # noqa: E731, B023
        want = [x.o2 for x in rows if a.start <= x.o1 <= a.stop and a.lo <= x.occurred <= a.hi and (x.born1, x.born2) < (a.now1, a.now2) and not gone(x)][: a.most]
        assert list(got.o2[a.ask]) == want
        assert not got.open[a.ask] or not a.whole


def test_claims_support_each_other_as_at_the_desk(spark):
    from sentinelle.operators import correlate as R
    from sentinelle.operators import desk

    r = random.Random(4)
    hour, spots = 3_600_000_000, [(0.0, 179.95), (0.1, -179.95), (89.9, 10.0), (89.95, -150.0), (50.0, 10.0), (50.2, 10.1), (50.1, 10.3), (-60.0, 20.0)]
    rows = []
    for i in range(160):
        lat, lon = spots[r.randrange(8)] if i % 5 else (None, None)
        rows.append((i, "t", f"C{r.randrange(6)}" if i % 9 else None, r.randrange(60) * hour, lat, lon, "Country" if i % 7 == 0 else "Exact", f" P{r.randrange(4)}", [f"w{x}" for x in r.sample(range(12), 5)], [f"a{r.randrange(9)}"]))
    claims = spark.createDataFrame(rows, "id long, event_type string, identity string, occurred long, lat double, lon double, precision string, place string, tokens array<string>, actors array<string>")
    got = R.corroborated(claims, 24 * hour)
    assert got.columns == ["id_a", "id_b"]
    report = lambda x: desk.Report(x[0], 0, x[3], x[4], x[5], x[6], x[7], frozenset(x[8]), tuple(x[9]), True, x[2])
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] and b[2] and a[2] != b[2] and abs(a[3] - b[3]) <= 24 * hour and desk.supports(report(a), report(b), frozenset(b[8]), b[9])}
    found = [tuple(x) for x in got.collect()]
    assert set(found) == want and len(found) == len(want) > 20


def test_hashed_words_of_a_report_are_plain_numbers():
    import numpy as np
    import pandas as pd

    from sentinelle.operators import desk

    row = {"id": 1, "received": 2, "occurred": 2, "lat": None, "lon": None, "precision": None, "place": "p", "tokens": np.array([5, 7]), "actors": np.array(["a"], dtype=object), "claim": False, "identity": None}
    (report,) = desk.reports(pd.DataFrame([row]))
    assert report.tokens == {5, 7} and {type(x) for x in report.tokens} == {int} and report.actors == ("a",)


def test_frequent_words_make_few_counts(monkeypatch):
    """Words that are marked in both sets are counted for pairs that may be alike by the others, and sizes far apart do not meet."""
    import numpy as np

    r = random.Random(8)
    least = 0.4 - S.ROUNDING
    sets = [sorted(r.sample(range(40), r.randrange(2, 20)) + r.sample(range(100, 3000), r.randrange(1, 30))) for _ in range(120)]
    sets += [sorted({*r.sample(s, max(1, len(s) * 2 // 3)), 3500 + i}) for i, s in enumerate(sets)]

    def block(some):
        n = [len(s) for s in some]
        cut = [int(S.MARKED * least * k) for k in n]
        # Small numbers are the frequent words.
        flat = sorted((w, k < cut[i], i) for i, s in enumerate(some) for k, w in enumerate(s))
        codes, often, at = zip(*flat, strict=True)
        return (np.arange(len(some), dtype=np.int64).tobytes(), *(np.array(x, np.int32).tobytes() for x in (n, cut, codes, at)), (~np.array(often)).tobytes())

    counted = []
    common = S._common
    monkeypatch.setattr(S, "_common", lambda *x: (counted.append(len(y)) or y for y in common(*x)))
    monkeypatch.setattr(S, "STEP", 300)
    x, y = S.met(block(sets), block(sets), least, True)
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len({*a} & {*b}) >= least * math.sqrt(len(a) * len(b)) - 1e-6}
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == want and len(x) == len(want) > 100
    assert sum(counted) < 0.6 * sum(len({*a} & {*b}) for a in sets for b in sets)
