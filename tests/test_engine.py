"""Behaviours of the operators on small cases; results on the tables are checked against SQL in test_oracle.py."""

import math
import random
import unicodedata
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinelle.functions import geo, marks, scores
from sentinelle.functions import text as X
from sentinelle.operators import analytics as A
from sentinelle.operators import correlate as R
from sentinelle.operators import mentions as M
from sentinelle.operators import snapshot
from sentinelle.operators import spatial as S
from sentinelle.plans import registry
from sentinelle.sources import coded, history, readers
from sentinelle.sources.views import HOUR, NOW

SF = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_empty_window_scores_zero(spark):
    empty = spark.createDataFrame([], "occurred long, severity int, evidence long, confidence double")
    rows = A.activity(empty, NOW).collect()
    assert len(rows) == 4
    assert all(r.score == 0 and r.band == "Low" for r in rows)


def test_series_is_full_and_half_open(spark):
    rows = [(NOW, 4), (NOW - 1, 4), (NOW - 24 * HOUR, 0), (NOW - 24 * HOUR - 1, 0)]
    got = A.series(spark.createDataFrame(rows, "occurred long, severity int"), "occurred", NOW, 24, 1).orderBy("bucket").collect()
    assert [r.n for r in got] == [1] + [0] * 22 + [1]
    assert got[-1].elevated == 1


def test_box_holds_circle_across_the_seam_and_pole(spark):
    for lat, lon in ((-17.0, 179.5), (89.0, 10.0), (0.0, 0.0)):
        box = geo.box_from_radius(F.lit(lat), F.lit(lon), F.lit(300.0))
        for bearing in range(0, 360, 30):
            d, b, la = 299 / geo.EARTH_KM, math.radians(bearing), math.radians(lat)
            y = math.asin(math.sin(la) * math.cos(d) + math.cos(la) * math.sin(d) * math.cos(b))
            x = math.radians(lon) + math.atan2(math.sin(b) * math.sin(d) * math.cos(la), math.cos(d) - math.sin(la) * math.sin(y))
            x = (math.degrees(x) + 180) % 360 - 180
            assert one(spark, v=geo.box_contains(box, F.lit(math.degrees(y)), F.lit(x))).v


def test_grid_join_equals_all_pairs(spark):
    points = spark.createDataFrame([(float(a), float(o)) for a in range(-90, 91, 9) for o in range(-180, 181, 12)], "lat double, lon double").withColumn("id", F.monotonically_increasing_id())
    centres = spark.createDataFrame([(1, 0.0, 179.9, 1500.0), (2, 85.0, -100.0, 1500.0), (3, -89.0, 0.0, 900.0), (4, 40.0, -180.0, 1200.0)], "c int, c_lat double, c_lon double, radius double")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    want = {(r.id, r.c) for r in points.crossJoin(centres).where(km <= F.col("radius")).collect()}
    got = [(r.id, r.c) for r in S.near_any(points, centres, 1500.0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_quiet_areas_stay(spark):
    areas = spark.createDataFrame([("quiet", 0.0, 0.0, 10.0)], "name string, c_lat double, c_lon double, radius double")
    got = S.watch_areas(spark.createDataFrame([(50.0, 50.0)], "lat double, lon double"), areas, 10.0).first()
    assert (got.n, got.nearest_km) == (0, None)


def test_similarity(spark):
    t = lambda s: X.tokens(F.lit(s))
    a, b = "Shelling near the northern port", "Port shelling continued overnight"
    r = one(spark, same=X.similarity(t(a), t(a)), ab=X.similarity(t(a), t(b)), ba=X.similarity(t(b), t(a)), none=X.similarity(t(""), t(a)))
    assert r.same == 1
    assert r.ab == r.ba == pytest.approx(0.5774)
    assert r.none == 0


def test_keyword_quirks(spark):
    r = one(spark, died=X.event_type(F.lit("Two died")), pirates=X.event_type(F.lit("Pirates near a vessel")), none=X.marked_severity(F.lit("  ")), crit=X.marked_severity(F.lit("killed dozens")))
    assert (r.died, r.pirates, r.none, r.crit) == ("Terrorism", "Piracy", "Unknown", "Critical")


@pytest.mark.parametrize(
    ("text", "place", "signal"),
    [
        ("Forces captured the town of Sana'a (Old City).", "Sana'a (Old City)", "TerritoryTransferred"),
        ("Army pulled  out of Київ", "Київ", "WithdrawalReported"),
        ("Army captured йКиїв", "Київ", "None"),
        ("Bakhmut fell to the enemy", "Bakhmut", "TerritoryTransferred"),
        ("Bakhmut", None, "None"),
    ],
)
def test_control_claims(spark, text, place, signal):
    assert one(spark, v=X.control_signal(F.lit(text), F.lit(place).cast("string"))).v == signal


@pytest.mark.parametrize(
    ("now", "before", "sources", "sources_before", "verdict"),
    [(10, 0, 2, 0, "NoBaseline"), (4, 9, 1, 1, "TooThin"), (10, 20, 2, 4, "NotStated"), (20, 10, 4, 2, "NotStated"), (40, 10, 4, 2, "Rising"), (10, 10, 2, 2, "Steady"), (20, 10, 2, 2, "Rising"), (5, 10, 2, 2, "Falling")],
)
def test_tempo(spark, now, before, sources, sources_before, verdict):
    assert one(spark, v=scores.tempo(*[F.lit(x) for x in (now, before, sources, sources_before)])).v == verdict


def test_pair_score_edges(spark):
    at = lambda km: R.pair_score(R.ceiling(F.lit(km).cast("double"), F.lit(False), F.lit(False), F.lit(1.0), F.lit(0)), F.lit(None).cast("double"), F.lit(1.0))
    r = one(spark, zero=at(0.0), edge=at(75.0), beyond=at(75.1), words=R.pair_score(R.ceiling(F.lit(None).cast("double"), F.lit(False), F.lit(False), F.lit(0.5), F.lit(1)), F.lit(1.0), F.lit(0.5)))
    assert (r.zero, r.edge, r.beyond) == (1.0, 0.55, None)
    assert r.words == pytest.approx(0.54)


def mentions_in(text, names, most=12):
    """Every name at every place, then the leftmost and longest of those that overlap."""
    fold = lambda t: unicodedata.normalize("NFKC", t).lower()
    gapless = lambda c: any(lo <= ord(c) <= hi for lo, hi in ((0x0E00, 0x0E7F), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF)))
    word = lambda c: c.isalnum() or c == "_"
    edge = lambda a, b: gapless(a) or gapless(b) or not (word(a) and word(b))
    low, spans = fold(text or ""), []
    for name in {fold(n) for n in names if n}:
        for at in range(len(low) - len(name) + 1):
            end = at + len(name)
            if low.startswith(name, at) and (at == 0 or edge(low[at - 1], low[at])) and (end == len(low) or edge(low[end - 1], low[end])):
                spans.append((at, -len(name), name))
    out, after = [], 0
    for at, size, name in sorted(spans):
        if at >= after:
            after = at - size
            out += [name] * (name not in out)
    return out[:most]


def test_mentions_leftmost_longest_whole(spark):
    names = ["York", "New York", "Kyiv", "东京", "京都", "Sana'a (Old City)", "san", "San José", "a b c d e", "b c", "ﬁne", "", None, "กรุง", "x_1"]
    texts = ["York, New York and Kyivan Kyiv; 在东京都 Sana'a (Old City)!", None, "", "SAN JOSÉ san", "a b c d, a b c d e b c", "fine ﬁne refine", "กรุงเทพ x_1 x_12 ax_1", "new  york new york york", "京都东京京都", "São Kyiv\nKyiv"]
    r = random.Random(1)
    texts += ["".join(r.choice([" ", "a", "b", " c ", "york", "New ", "東", "京", "都", ".", "san"]) for _ in range(40)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {x.id: x.mentions for x in M.with_mentions(docs, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {i: mentions_in(t, names) for i, t in enumerate(texts)}
    assert {len(x.mentions) for x in M.with_mentions(docs, spark.createDataFrame([], "name string")).collect()} == {0}



def test_capped_windows():
    full = {100, 50, 25}
    got = history.capped_windows(0, 100, 10, lambda a, b: b - a in full)
    assert got == [(0, 12), (12, 25), (25, 37), (37, 50), (50, 62), (62, 75), (75, 87), (87, 100)]


def test_readers(spark, tmp_path):
    (tmp_path / "f.csv").write_text("latitude,longitude,bright_ti4,acq_date,acq_time,satellite,confidence,frp,daynight\n10.5,20.5,300.1,2024-01-02,145,N,n,5.5,N\nx,1,1,2024-01-02,1,N,h,1,D\n1,2,3,2024-01-02,2359,N,140,,D\n")
    got = readers.firms(spark, str(tmp_path / "f.csv")).orderBy("lat").collect()
    assert [(r.lat, r.confidence, r.power, r.night) for r in got] == [(1.0, 100, None, False), (10.5, 60, 5.5, True)]
    assert got[1].at.hour == 1
    (tmp_path / "a.json").write_text('{"data":[{"event_id_cnty":"E1","event_date":"2024-01-02","event_type":"Battles","sub_event_type":"Government regains territory","actor1":"A","latitude":"1.5","longitude":2,"geo_precision":1,"fatalities":0},{"event_date":"x"}]}')
    r = coded.coded_events(spark, str(tmp_path / "a.json")).first()
    assert (r.identifier, r.event_type, r.severity, r.precision, r.control_signal, r.lat) == ("E1", "Conflict", "Medium", "Settlement", "TerritoryTransferred", 1.5)
    (tmp_path / "u.json").write_text('{"NextPageUrl":"","Result":[{"id":7,"type_of_violence":3,"where_prec":1,"where_coordinates":" ","adm_1":"Up","latitude":1,"longitude":2,"date_start":"2024-01-02T00:00","best":30}]}')
    r = coded.ged_events(spark, str(tmp_path / "u.json")).first()
    assert (r.event_type, r.severity, r.place, r.precision, r.more) == ("Terrorism", "Critical", "Up", "Exact", False)
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>A &lt;b&gt;x&lt;/b&gt;</title><guid>g</guid><pubDate>Tue, 2 Jan 2024 03:04:05 +0000</pubDate></item></channel></rss>")
    r = readers.feed_items(spark, str(tmp_path / "r.xml")).first()
    assert (r.identifier, r.title, r.published) == ("g", "A x", datetime(2024, 1, 2, 3, 4, 5))
    (tmp_path / "bad.xml").write_text("<!DOCTYPE x><rss><item><title>a</title></item></rss>")
    assert readers.feed_items(spark, str(tmp_path / "bad.xml")).count() == 0


def test_bundles_are_strict(spark, tmp_path):
    item = '{"kind":"document","url":"https://a.b/c","publisher":"P","publishedAt":"2024-01-01T00:00:00Z","retrievedAt":"2024-01-02T00:00:00Z","contentHash":"sha256:' + "0" * 64 + '","excerpt":"e","placeNames":[]}'
    for name, extra in (("good", ""), ("odd", ',"more":1'), ("torn", ',"')):
        (tmp_path / f"{name}.json").write_text('{"schemaVersion":1,"bundleId":"b","collectedAt":"2024-01-30T00:00:00Z","items":[' + item + "," + item + "]" + extra + "}")
    now = F.timestamp_micros(F.lit(NOW))
    kept = readers.bundles(spark, str(tmp_path / "*.json"), now)
    assert [r.file for r in kept.select("file").collect()] == ["good.json"]
    assert [r.reason for r in readers.bundle_items(kept, now).orderBy("pos").collect()] == [None, "url repeated"]


def test_snapshot(spark, tmp_path):
    for path in snapshot.export(spark, SF, str(tmp_path), registry.queries(), ("count_by_severity", "snapshot_meta")):
        assert spark.read.parquet(path).count() > 0


def test_areas_of_any_size_miss_no_point(spark):
    r = random.Random(3)
    spot = lambda: (r.choice([r.uniform(-90, 90), r.uniform(84, 90), -90.0, 90.0, 0.0, 45.0]), r.choice([r.uniform(-180, 180), 180.0, -180.0, 179.99]))
    points = [(i, *spot()) for i in range(300)] + [(900, None, 1.0)]
    areas = [(i, *spot(), r.choice([0.0, 0.5, 5.0, 80.0, 700.0, 3000.0, 9000.0, 20100.0])) for i in range(150)] + [(900, 1.0, 1.0, None)]
    areas += [(200 + i, points[i][1], points[i][2], 0.0) for i in range(5)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    got = S.near_each(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(areas, "area long, c_lat double, c_lon double, radius double"))
    pairs = [(x.id, x.area) for x in got.collect()]
    want = {(i, k) for i, a, b in points[:300] for k, c, d, radius in areas if radius is not None and km(a, b, c, d) <= radius + 1e-9}
    sure = {(i, k) for i, a, b in points[:300] for k, c, d, radius in areas if radius is not None and km(a, b, c, d) <= radius - 1e-6}
    assert len(pairs) == len(set(pairs)) and sure <= set(pairs) <= want
    assert S.near_each(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame([], "area long, c_lat double, c_lon double, radius double")).count() == 0


def test_mentions_are_found_in_tasks(spark, monkeypatch):
    r = random.Random(3)
    names = ["a b", "b", "b c d", "東京", "京", "x_1", "É", "ﬁ n", "d"]
    texts = [None, "", "b", "東京x_1", *(" ".join(r.choice(["a", "b", "c", "d", "東", "京", "x_1", "é", "fi n", "."]) for _ in range(r.choice((1, 5, 40)))) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    listed = spark.createDataFrame([(n,) for n in names], "name string")
    joined = []
    real = M.hits
    monkeypatch.setattr(M, "hits", lambda *a: joined.append(1) or real(*a))
    want = {i: mentions_in(t, names) for i, t in enumerate(texts)}
    assert {x.id: x.mentions for x in M.mentioned(docs, listed).collect()} == want
    # No run of units met the names in a join.
    assert not joined
    # A table that says yes to every third run as well: what is found and is no name is found out, and the join tells the names.
    first = lambda table, h: (table[(h & np.uint64(len(table) * 8 - 1)) >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1
    monkeypatch.setattr(marks, "known", lambda table, h: np.flatnonzero(first(table, h) | (h % np.uint64(3) == 0)))
    assert {x.id: x.mentions for x in M.mentioned(docs, listed).collect()} == want
    assert joined
