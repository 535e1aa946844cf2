import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinelle.functions import marks
from sentinelle.functions import text as X
from sentinelle.operators import conflicts as C
from sentinelle.operators import lexicon as L
from sentinelle.operators import mentions as M
from sentinelle.operators import pipeline as P
from sentinelle.plans import api
from sentinelle.session import settled
from sentinelle.sources import views as V
from sentinelle.sources.views import HOUR, NOW

SF = "/root/testdata/sf0.001"
DAY = 24 * HOUR


def test_a_name_with_several_bearers(spark):
    rows = [
        ("one", 1, 0.0, 0.0, 10),
        ("same", 2, 1.0, 1.0, 900), ("same", 3, 1.04, 1.0, 5),
        ("nested", 4, 1.0, 1.0, 9000), ("nested", 5, 2.0, 1.0, 0),
        ("clear", 6, 1.0, 1.0, 60000), ("clear", 7, 9.0, 1.0, 5000),
        ("open", 8, 1.0, 1.0, 60000), ("open", 9, 9.0, 1.0, 7000),
        ("small", 10, 1.0, 1.0, 4000), ("small", 11, 9.0, 1.0, 1),
    ]
    got = {r.key: r.chosen for r in L.disambiguated(spark.createDataFrame(rows, "key string, id long, lat double, lon double, population long")).collect()}
    assert got == {"one": 1, "same": 2, "nested": 4, "clear": 6, "open": None, "small": None}


def test_entities(spark):
    row = spark.range(1).select(L.capitalised(F.lit("Near Port Sudan the Sudan Army met Omar's men in Port Sudan")).alias("e")).first()
    assert row.e == ["Near Port Sudan", "Sudan Army", "Omar's"]


def test_entities_have_no_limit(spark):
    r = random.Random(6)
    names = ["".join(r.choice("ABab") for _ in range(r.randrange(2, 6))) for _ in range(400)]
    texts = [" ".join(x + r.choice(["", ".", " of"]) for x in r.sample(names, n)) for n in (3, 40, 400)] + ["", "Xa Xb Xc. Xd. Xe. Xf. Xg. Xh. Xb Xc"]

    def want(text):
        runs = list(dict.fromkeys(re.findall("[AB][ABab]+(?: [AB][ABab]+)*" if "X" not in text else "X[a-h](?: X[a-h])*", text)))
        return [x for x in runs if not any(x in y for y in runs if x != y)]

    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {x.id: x.e for x in docs.select("id", L.capitalised(F.col("text")).alias("e")).collect()}
    assert got == {i: want(t) for i, t in enumerate(texts)} and max(map(len, got.values())) > 40 and len(got[4]) == 6
    # Long runs, and many of them, of which none lies in another.
    word = lambda: r.choice("ABCDEFGH") + "".join(r.choice("abcdefgh") for _ in range(7))
    odd = [" ".join(word().upper() for _ in range(20000)), ". ".join(f"{word()}{'x' * (i % 9)}" for i in range(20000))]
    sizes = spark.createDataFrame([(x,) for x in odd], "text string").select(F.size(L.capitalised(F.col("text"))).alias("n")).collect()
    assert sizes[0].n == 1 and sizes[1].n > 19000


def claims(spark, rows):
    return spark.createDataFrame([("P", NOW - d * DAY, s, c, a, src) for d, s, c, a, src in rows], "place string, at long, signal string, coded boolean, actor string, source string")


@pytest.mark.parametrize(
    ("rows", "verdict"),
    [
        ([(1, "WithdrawalReported", True, "A", "s")], "Insufficient"),
        ([(1, "TerritoryTransferred", False, "A", "s"), (2, "TerritoryTransferred", False, "A", "S")], "Insufficient"),
        ([(1, "TerritoryTransferred", False, "A", "s"), (2, "TerritoryTransferred", False, "a", "t")], "Assessed"),
        ([(1, "TerritoryTransferred", True, "A", "s"), (10, "TerritoryTransferred", True, "B", "s")], "Contested"),
        ([(1, "TerritoryTransferred", True, "A", "s"), (20, "TerritoryTransferred", True, "B", "s")], "Assessed"),
        ([(31, "TerritoryTransferred", True, "A", "s")], "Stale"),
    ],
)
def test_control(spark, rows, verdict):
    assert C.control(claims(spark, rows), NOW, DAY).first().verdict == verdict


def test_placement(spark):
    lexicon = spark.createDataFrame([("kyiv", 1, 50.0, 30.0, "Settlement"), ("spring", 1, 1.0, 1.0, "Settlement"), ("spring", 2, 2.0, 2.0, "Region")], "key string, country int, g_lat double, g_lon double, g_precision string")
    rows = [(1, "Kyiv!", 9, None, None, None), (2, "Spring", 2, None, None, None), (3, "Spring", 9, None, None, None), (4, "Nowhere", 1, None, None, None), (5, None, 1, None, None, None), (6, "Kyiv", 1, 3.0, 4.0, "Exact")]
    o = spark.createDataFrame(rows, "id int, place string, country int, lat double, lon double, precision string")
    got = {r.id: (r.at_lat, r.confidence, r.reason) for r in P.resolved(o, lexicon).collect()}
    assert got == {1: (50.0, 0.7, None), 2: (2.0, 0.55, None), 3: (None, None, "ambiguous"), 4: (None, None, "unknown"), 5: (None, None, "no place"), 6: (3.0, 0.95, None)}


def test_api(spark):
    o, i = V.observations(spark, SF), V.incidents(spark, SF)
    assert api.incidents(i, take=9999).count() == 250
    assert api.incidents(i, NOW - DAY, NOW).where(F.col("occurred") < NOW - DAY).count() == 0
    assert api.observations(o, 0).count() == 1
    assert api.incidents_near(i, 0.0, 0.0, 10**9).where("km > 5000").count() == 0
    assert api.analytics(i, "7D", NOW)["series"].count() == 28
    assert api.windows(spark).count() == 4
    with pytest.raises(ValueError, match="no such window"):
        api.analytics(i, "2y", NOW)
    number = i.first().id
    assert api.incident(i, number).count() == 1
    assert api.chokepoints(i, V.chokepoints(spark), NOW).count() == 8
    assert api.conflict_activity(V.conflict_reports(spark, SF), "30d", NOW).count() > 0


def test_fingerprints(spark):
    f = lambda s, i, c: X.fingerprint(F.lit(s), F.lit(i).cast("string"), F.lit(c))
    r = spark.range(1).select(f(" A ", None, "Hello,  World!").alias("a"), f("a", " ", "hello world").alias("b"), f("a", "ID1", "x").alias("c"), f("A", " id1 ", "y").alias("d")).first()
    assert r.a == r.b
    assert r.c == r.d != r.a


def test_places_inside_places_by_codes(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, None), (8, 9), (9, 8)], "id long, parent long")
    up = L.ancestors(tree)
    assert sorted((r.id, r.ancestor, r.steps) for r in up.where("id < 8").collect()) == [(2, 1, 1), (3, 1, 2), (3, 2, 1), (4, 1, 2), (4, 2, 1)]
    # A loop ends too.
    assert {r.ancestor for r in up.where("id = 8").collect()} == {8, 9}
    rows = [("york", 1, "a"), ("york", 3, "a"), ("york", 5, "b"), ("kent", 2, "a"), ("kent", 1, "b")]
    entries = spark.createDataFrame(rows, "key string, id long, country string")
    assert sorted((r.key, r.id) for r in L.deepest(entries, up).collect()) == [("kent", 1), ("kent", 2), ("york", 3), ("york", 5)]
    far = spark.createDataFrame([("york", 1, 10.0, 10.0, 9000), ("york", 3, 14.0, 10.0, 8000)], "key string, id long, lat double, lon double, population long")
    assert [(r.chosen, r.places) for r in L.disambiguated(far).collect()] == [(None, 2)]
    assert [(r.chosen, r.places) for r in L.disambiguated(far, up).collect()] == [(1, 1)]


def test_names_in_prose(spark):
    entries = spark.createDataFrame([("Kyiv", ["Kiev", "Kyyiv"], 3000000), ("Oslo", None, 19999), ("", ["", "Bergen"], 90000), ("New York", ["york city"], None)], "name string, aliases array<string>, population long")
    names = M.searchable(entries)
    assert {r.name for r in names.collect()} == {"Kyiv", "Kyyiv", "Bergen", "New York", "york city"}
    long = "x" * 50_000 + "Bergenser" + "y" * 50_000
    texts = {1: "in KYIV and new york City", 2: None, 3: "", 4: long, 5: "kyi v", 6: "kyyivkyiv kyiv"}
    docs = spark.createDataFrame([(k, v, "extra") for k, v in texts.items()], "id int, text string, name string")
    got = {r.id: r.names for r in M.contained(docs, names).collect()}
    assert got == {1: ["york city", "New York", "Kyiv"], 2: [], 3: [], 4: ["Bergen"], 5: [], 6: ["Kyyiv", "Kyiv"]}
    assert M.contained(docs, names, most=1).where("id = 1").first().names == ["york city"]
    assert {len(r.names) for r in M.contained(docs, names.limit(0)).collect()} == {0}


def test_lexicon_faults(spark):
    places = spark.createDataFrame([("a", 1, 0.05, 0.0), ("b|c", 1, 0.0, 0.0), ("d", 1, 0.2, 0.0), ("e", 2, 0.0, 0.0)], "key string, country int, g_lat double, g_lon double")
    extents = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0)], "country int, south double, north double, west double, east double")
    anchors = spark.createDataFrame([("a", 1), ("a", 2)], "key string, country int")
    assert sorted(tuple(r) for r in L.faults(places, extents, anchors).collect()) == [("missing", "a", 2), ("outside", "d", 1), ("outside", "e", 2), ("separator", "b|c", 1)]


def test_ancestors_know_no_limit_of_rows(spark):
    tree = spark.createDataFrame([(k, k // 2 if k > 1 else None) for k in range(1, 64)], "id long, parent long")
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "10")
    try:
        assert L.ancestors(tree).count() == sum(k.bit_length() - 1 for k in range(1, 64))
    finally:
        spark.conf.set(limit, before)


def test_texts_are_searched_once(spark):
    rows = [(1, "Київ місто abc"), (2, "ΑΘΗΝΑ да"), (3, "東京 ひら"), (4, "plain"), (5, ""), (6, None), (7, "서울"), (8, "مدينة Киев")]
    docs = spark.createDataFrame(rows, "id long, text string")
    told = docs.select("id", X.language(F.col("text")).alias("l"))
    assert {r.id: r.l for r in told.collect()} == {1: "ru", 2: "el", 3: "ja", 4: "en", 5: "en", 6: None, 7: "ko", 8: "ar"}
    found = docs.select(L.capitalised(F.col("text")).alias("e"))
    assert found.where("e is null").count() == 1
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert plan(told).count("regexp_replace(") <= 1 + len(X.SCRIPTS)
    assert plan(found).count("regexp_extract_all(") == 1


def test_names_in_prose_are_found_in_tasks(spark, monkeypatch):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcİé東 ") for _ in range(n))
    names = {word(r.choice((1, 2, 3, 5, 8, 9, 16, 21))) for _ in range(60)} | {"Ab", "aB", "AB"}
    texts = ["".join(r.choice([*names, word(4)]) for _ in range(r.choice((0, 3, 30)))) for _ in range(60)]
    # One lies across two pieces; in one the names that end it are found beside thousands of short ones.
    texts += ["z" * (marks.PIECE - 3) + "Abcİé東abc", "a" * 3000 + max(names, key=len)]
    names |= {"bcİé東ab"}
    best = lambda t, most: sorted((n for n in names if n.lower() in t.lower()), key=lambda n: (-len(n), n))[:most]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    listed = spark.createDataFrame([(n,) for n in names], "name string")
    rows = []
    monkeypatch.setattr(M, "settled", lambda df: rows.append((out := settled(df)).count()) or out)
    got = {x.id: x.names for x in M.contained(docs, listed, most=3).collect()}
    assert got == {i: best(t, 3) for i, t in enumerate(texts)}
    # Rows are made for what is found, not for what is looked at.
    assert max(rows) < 5_000 < marks.PIECE
    # A table without a bit to spare says yes to everything: nothing wrong is found, and nothing is lost.
    monkeypatch.setattr(marks, "LARGEST", 1 << 15)
    monkeypatch.setattr(marks, "known", lambda table, h: np.arange(len(h)))
    few = docs.where("id < 25")
    assert {x.id: x.names for x in M.contained(few, listed, most=3).collect()} == {i: got[i] for i in range(25)}
