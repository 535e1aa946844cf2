"""The read side, providers, feeds and rules that decide between several answers."""

import pytest
from pyspark.sql import functions as F

from sentinelle.functions import text as X
from sentinelle.operators import conflicts as C
from sentinelle.operators import correlate as R
from sentinelle.operators import metrics as M
from sentinelle.operators import pipeline as P
from sentinelle.plans import api
from sentinelle.sources import history, readers
from sentinelle.sources import views as V
from sentinelle.sources.views import HOUR, NOW

SF = "/root/testdata/sf0.001"


def members(spark, rows):
    return spark.createDataFrame(rows, "id int, key string, basis int, shared int")


@pytest.mark.parametrize(
    ("rows", "conflicts", "candidates"),
    [
        ([("A", 4, 0), ("B", 4, 0), ("C", 3, 5)], ["B", "A"], ["C"]),
        ([("A", 3, 1)], ["A"], []),
        ([("A", 3, 1), ("B", 3, 1)], [], ["B", "A"]),
        ([("A", 3, 2), ("B", 3, 2), ("C", 3, 1)], ["B", "A"], ["C"]),
        ([(f"K{n}", 3, 2) for n in range(9)], [], [f"K{n}" for n in range(8)]),
        ([("A", 2, 0), ("C", 1, 0)], ["A"], ["C"]),
        ([("A", 2, 0), ("B", 2, 0)], [], ["B", "A"]),
    ],
)
def test_assignment(spark, rows, conflicts, candidates):
    register = spark.createDataFrame([("A", 1), ("B", 9), ("C", 5), *[(f"K{n}", 3) for n in range(9)]], "key string, events long")
    r = C.assigned(members(spark, [(1, *x) for x in rows]), register).first()
    assert (r.conflicts, r.candidates) == (conflicts, candidates)


def test_context_narrows_a_shared_name(spark):
    lexicon = spark.createDataFrame([("spring", 1, 1.0, 1.0, "Settlement"), ("spring", 2, 2.0, 2.0, "Region"), ("kyiv", 2, 5.0, 5.0, "Settlement"), ("nordland", 1, 6.0, 6.0, "Country")], "key string, country int, g_lat double, g_lon double, g_precision string")
    rows = [(1, "Spring", 9, "near Kyiv"), (2, "Spring", 9, "in Nordland, then Kyiv"), (3, "Spring", 9, "nothing"), (4, "Spring", 1, "near Kyiv"), (5, "Spring", 9, None)]
    o = spark.createDataFrame(rows, "id int, place string, country int, text string").withColumns({c: F.lit(None).cast(t) for c, t in (("lat", "double"), ("lon", "double"), ("precision", "string"))})
    got = {r.id: (r.at_lat, r.confidence, r.reason) for r in P.resolved_in_context(o, lexicon).collect()}
    assert got == {1: (2.0, 0.55, None), 2: (2.0, 0.55, None), 3: (None, None, "ambiguous"), 4: (1.0, 0.7, None), 5: (None, None, "ambiguous")}


def test_control_claims_need_one_actor(spark):
    claim = lambda place, *actors: X.control_claim(F.lit("Forces captured X\\E(b)."), F.lit(place), F.array(*map(F.lit, actors)) if actors else F.lit(None).cast("array<string>"))
    place = "X\\E(b)"
    r = spark.range(1).select(claim(place, "Army", "ARMY").alias("one"), claim(place, "A", "B").alias("two"), claim(place).alias("none"), claim("X.E(b)", "A").alias("other")).first()
    assert (r.one.signal, r.one.actor) == ("TerritoryTransferred", "Army")
    assert {r.two.signal, r.none.signal, r.other.signal} == {"None"}


def test_small_text_functions(spark):
    r = spark.range(1).select(X.folded(F.lit("ＡB ﬁ")).alias("f"), *[X.byte_size(F.lit(n)).alias(f"b{k}") for k, n in enumerate((0, 1023, 1536, 5 << 30))]).first()
    seen = spark.createDataFrame([("e\u0301x",), (None,)], "t string").select(X.composed(F.col("t")).alias("c"), X.elements(F.col("t")).alias("n")).collect()
    assert [tuple(x) for x in seen] == [("\u00e9x", 2), (None, None)]
    assert (r.f, r.b0, r.b1, r.b2, r.b3) == ("ab fi", "0 B", "1023 B", "1.5 KB", "5.0 GB")


def test_submissions_are_anonymous_and_limited(spark):
    rows = [("c", k * 1000, "News", "x", "y") for k in range(32)] + [("c", 70_000_000, "News", None, None), ("d", 0, None, None, None)]
    got = P.submitted(spark.createDataFrame(rows, "client string, at long, kind string, platform string, channel string"), 99).collect()
    assert {(r.kind, r.tier, r.platform, r.received) for r in got} == {("Manual", "UserGenerated", None, 99)}
    assert sum(r.reject_reason is not None for r in got) == 2


def test_feeds_of_three_kinds(spark, tmp_path):
    feeds = {
        "rss.xml": '<rss><channel><item><title>A &amp; b</title><link>http://a/1</link><description>&lt;p&gt;Hi  there&lt;/p&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>',
        "atom.xml": '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="text">T</title><id>urn:1</id><link rel="alternate" href="http://a/2"/><updated>2024-01-02T00:00:00Z</updated><summary>S</summary></entry></feed>',
        "rdf.xml": '<rdf:RDF xmlns:rdf="r" xmlns:dc="d" xmlns="x"><item rdf:about="http://a/3"><title>R</title><link>http://a/3</link><description>D</description><dc:date>2024-01-03T00:00:00+00:00</dc:date><dc:language>EN-gb</dc:language></item></rdf:RDF>',
        "bad.xml": "<!DOCTYPE x><rss><item><title>no</title></item></rss>",
    }
    for name, text in feeds.items():
        (tmp_path / name).write_text(text)
    got = {r.url: r for r in readers.feed_items(spark, str(tmp_path)).collect()}
    assert set(got) == {"http://a/1", "http://a/2", "http://a/3"}
    assert [(got[f"http://a/{k}"].title, str(got[f"http://a/{k}"].published)[:10]) for k in (1, 2, 3)] == [("A & b", "2024-01-01"), ("T", "2024-01-02"), ("R", "2024-01-03")]
    assert (got["http://a/1"].summary, got["http://a/2"].identifier, got["http://a/3"].identifier, got["http://a/3"].language) == ("Hi there", "urn:1", "http://a/3", "en-gb")


def test_providers(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0)], "id int, lat double, lon double")
    fire, post = readers.envelopes(rows, "firms", "FIRMS").first(), readers.envelopes(rows, "feed", "userGenerated").first()
    assert (fire.kind, fire.event_type, fire.severity, fire.lat) == ("Satellite", "NaturalHazard", "Low", 1.0)
    assert (post.kind, post.tier, post.provenance, post.lat) == ("Manual", "UserGenerated", "Collected", None)


def test_backfill_moves_only_past_whole_windows():
    whole = lambda a, b: False
    assert history.backfilled(100, 0, 40, 5, 10, whole) == ([(60, 100), (20, 60), (0, 20)], 0)
    assert history.backfilled(100, 0, 40, 5, 2, whole) == ([(60, 100), (20, 60)], 20)
    windows, frontier = history.backfilled(100, 0, 40, 5, 4, lambda a, b: b - a > 10)
    assert (windows, frontier) == ([], 100)
    windows, frontier = history.backfilled(100, 60, 40, 5, 9, lambda a, b: b - a > 10)
    assert (windows, frontier) == ([(60, 70), (70, 80), (80, 90), (90, 100)], 60)


def test_read_side(spark):
    o, i = V.observations(spark, SF), V.incidents(spark, SF)
    seen = api.coverage(o, "30d", NOW)
    assert set(seen) == {"source", "precision", "country", "tier", "platform", "language", "unplaced"}
    live = o.where((F.col("received") >= NOW - 720 * HOUR) & (F.col("received") < NOW) & (F.col("status") != "Duplicate"))
    assert seen["language"].agg(F.sum("n")).first()[0] == live.count()
    held = {r.holding: r for r in api.operations({"observations": (o, "received", 900), "incidents": (i, "occurred", 500)}, NOW).collect()}
    assert held["observations"].n == o.count()
    told = api.narrative(V.conflict_reports(spark, SF), "K3", "30d", NOW)
    assert told["gate"].first().gate == "Offered"
    assert 0 < told["evidence"].count() <= 40
    assert api.narrative(V.conflict_reports(spark, SF), "none", "30d", NOW)["gate"].first().gate == "TooFewReports"
    shown = api.incident_view(i).first()
    assert shown.correlated == (shown.observation_count > 1)
    view = api.observation_view(o.withColumns({"content": F.repeat(F.lit("x"), 5000), "guess": F.lit(4)}), opinion="guess").first()
    assert (len(view.excerpt), view.opinion.severity) == (4000, "Critical")
    assert [api.health(1, 10), api.health(8, 10), api.health(0, 0)] == ["Healthy", "Degraded", "Degraded"]


def test_severity_model_learns_words(spark):
    rows = [(k, ("bomb blast kills" if k % 2 else "quiet market day") + f" {k}", "Other", 1.0, 0.5, float(k % 3), 0.0, 4 if k % 2 else 1, k < 80) for k in range(100)]
    frame = spark.createDataFrame(rows, "id int, text string, event_type string, sources double, confidence double, entities double, located double, severity int, train boolean")
    got = M.predictions(frame, rounds=20).where("not train").collect()
    assert len(got) == 20
    assert not any(r.disagrees for r in got)
    classes = {r.id: r.classes for r in api.severity_predict(M.severity_pipeline(20).fit(frame), frame).collect()}
    assert all(c[0].severity == (4 if k % 2 else 1) and c[0].probability >= c[1].probability for k, c in classes.items())


def test_entity_keys_in_order_of_mention(spark):
    rows = [(1, "I", 2, ["b", "c"]), (2, "I", 1, ["a", "b"]), (3, None, 0, ["z"]), (4, "J", 1, [])]
    frame = spark.createDataFrame(rows, "id int, incident string, received int, actors array<string>")
    got = {r.incident: r.actors for r in R.entity_keys(frame, "incident", ["received", "id"], 2).collect()}
    assert got == {"I": ["a", "b"]}


def test_texts_are_cut_between_characters(spark):
    family = "👨‍👩‍👧"
    rows = [(family * 4 + "xy",), ("é" * 6,), ("short",), (None,), ("a" * 7,)]
    got = [r.t for r in spark.createDataFrame(rows, "t string").select(X.truncated(F.col("t"), 5).alias("t")).collect()]
    assert got == [family * 4 + "…", "é" * 4 + "…", "short", None, "aaaa…"]
