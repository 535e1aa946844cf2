import json

import pytest
from pyspark.sql import functions as F

from sentinelle.functions import text as X
from sentinelle.sources import coded, history, posts

HOUR = 3_600_000_000


def test_references_are_decoded_once(spark):
    cases = {
        "a &amp; b &lt;i&gt;": "a & b <i>", "caf&#233; &#xE9;&#X1F600;": "café é😀", "&amp;lt; &#38;lt; &#x26;#65;": "&lt; &lt; &#65;",
        "&nope; &AMP &#0; &#xD800; &#1114112;": "&nope; &AMP &#0; &#xD800; &#1114112;", "&quot;&apos;&nbsp;&eacute;&ndash;": "\"'\xa0é–", "": "", None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.unescaped("t").alias("u")).collect()
    assert {r.t: r.u for r in rows} == cases


def test_pages_that_cannot_be_read_say_why(spark):
    pages = ["", "{torn", "[1]", '{"success":false,"message":"no","data":[]}', '{"rows":[]}', '{"data":{}}', '{"data":[]}', None]
    df = spark.createDataFrame(list(enumerate(pages)), "page long, value string")
    got = {r.page: (r.position, r.reason, r.event_type) for r in coded.coded_rows(df).collect()}
    assert got == {k: (None, v, None) for k, v in {0: "not json", 1: "not json", 2: "not an object", 3: "refused", 4: "no data", 5: "no data", 7: "not json"}.items()}


def test_records_that_cannot_be_used_say_why(spark):
    records = [7, {"event_id_cnty": " "}, {"event_id_cnty": "E"}, {"event_id_cnty": {"x": 1}, "data_id": 5, "event_type": "Riots", "location": "L"}, {"event_id_cnty": " E2 ", "notes": "n", "latitude": "91", "longitude": 1, "fatalities": "1e12", "geo_precision": "2", "event_date": "2024-02-30"}]
    rows = coded.coded_rows(spark.createDataFrame([(json.dumps({"data": records}),)], "value string"), 5).orderBy("position").collect()
    assert [r.reason for r in rows] == ["not an object", "no identifier", "nothing said", None, None]
    assert (rows[3].identifier, rows[3].title, rows[3].content, rows[3].event_type, rows[3].place) == ("5", "Riots in L", "Riots in L", "Protest", "L")
    assert (rows[4].identifier, rows[4].lat, rows[4].severity, rows[4].precision, rows[4].occurred, rows[4].event_type) == ("E2", None, "Critical", "Region", None, "Other")
    assert all(r.truncated for r in rows)
    ged = [{"relid": 3, "source_headline": "h"}, {"id": 4}, {"id": "x", "country": "C", "date_end": "2024-01-05", "conflict_id": 9, "type_of_violence": "3"}]
    rows = coded.ged_rows(spark.createDataFrame([(json.dumps({"Result": ged, "TotalPages": 2}),)], "value string")).orderBy("position").collect()
    assert [(r.identifier, r.reason, r.more) for r in rows] == [("3", None, True), ("4", "nothing said", True), ("x", None, True)]
    assert (rows[2].place, rows[2].conflict_key, rows[2].event_type, str(rows[2].occurred)[:10]) == ("C", "9", "Terrorism", "2024-01-05")


def test_posts_and_what_is_none(spark):
    page = '<div data-post="c/1"><div class="x_message_text y">one<br/>two</div><time datetime="T1"></div><div data-post="c/2"><img></div>'
    sky = {"feed": [{"post": {"uri": "at://d/p/k1", "record": {"text": " t ", "createdAt": "T", "langs": ["uk"]}}}, {"reason": {}, "post": {"record": {"text": "again"}}}]}
    toots = [{"uri": "u", "content": "<p>a&#39;b</p>", "created_at": "T", "reblog": None}, {"url": "v", "content": "x", "reblog": {"id": 1}}, {"url": "w", "content": "y"}]
    rows = [("Telegram", "c", page), ("telegram", "e", ""), ("bluesky", "b", json.dumps(sky)), ("mastodon", "m", json.dumps(toots)), ("mastodon", "n", '{"error":1}'), ("bluesky", "n", "[1"), ("x", "q", "?"), (None, "q", None)]
    fetched = spark.createDataFrame(rows, "platform string, channel string, body string").withColumn("body", F.encode("body", "UTF-8"))
    got = sorted(((r.channel, r.position, r.url, r.said, r.language, r.reason) for r in posts.post_rows(fetched).collect()), key=str)
    assert got == sorted([
        ("c", 0, "https://t.me/c/1", "one two", None, None), ("c", 1, "https://t.me/c/2", None, None, "no text"),
        ("b", 0, "https://bsky.app/profile/b/post/k1", "t", "uk", None), ("b", 1, None, "again", None, "repost"),
        ("m", 0, "u", "a'b", None, None), ("m", 1, "v", "x", None, "repost"), ("m", 2, "w", "y", None, "no time"),
        ("n", None, None, None, None, "no statuses"), ("n", None, None, None, None, "not json"), ("q", None, None, None, None, "platform"), ("q", None, None, None, None, "platform"),
    ], key=str)
    assert {r.url for r in posts.posts(fetched).collect()} == {"https://t.me/c/1", "https://bsky.app/profile/b/post/k1", "u"}


@pytest.fixture(scope="module")
def past(spark, tmp_path_factory):
    """300 records over 100 hours, 120 of them within one hour, in four files; and the counts."""
    root = tmp_path_factory.mktemp("past")
    at = F.when(F.col("id") < 120, F.lit(50 * HOUR) + F.col("id")).otherwise((F.col("id") - 120) * F.lit(100 * HOUR) / 180).cast("long")
    rows = spark.range(300).select("id", F.timestamp_micros(at).cast("timestamp_ntz").alias("ts")).union(spark.sql("select -1L, cast(null as timestamp_ntz)"))
    rows.repartition(4).write.parquet(str(root / "a b"))
    history.bins(spark.read.parquet(str(root / "a b")), "ts", HOUR).write.parquet(str(root / "bins"))
    spark.dataSource.register(history.HistorySource)
    return root


def options(past, **more):
    return {"path": str(past / "a b"), "bins": str(past / "bins"), "column": "ts", "least": HOUR, "step": 16 * HOUR, "cap": 20} | more


def test_windows_hold_a_page_and_every_record_once(spark, past):
    got = spark.read.format("history").options(**options(past)).load()
    rows = got.select("id", *history.ADDED, F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).collect()
    assert sorted(r.id for r in rows) == list(range(300))
    sizes = {}
    for r in rows:
        assert r._window_from <= r.t < r._window_to
        sizes.setdefault((r._window_from, r._window_to, r._truncated), []).append(r.id)
    assert {k for k, v in sizes.items() if len(v) > 20} == {(50 * HOUR, 51 * HOUR, 1)}
    assert {k[2] for k, v in sizes.items() if len(v) <= 20} == {0}
    some = spark.read.format("history").options(**options(past, until=60 * HOUR + 7, horizon=10 * HOUR + 9)).load()
    want = sorted(r.id for r in rows if 10 * HOUR + 9 <= r.t < 60 * HOUR + 7)
    assert sorted(r.id for r in some.select("id").collect()) == want


@pytest.mark.parametrize("rows", [1, 45, 70])
def test_tasks_read_no_record_of_another_one(past, monkeypatch, rows):
    monkeypatch.setattr(history, "ROWS", rows)
    source = history.HistorySource(options(past))
    reader = source.reader(source.schema())
    parts = reader.partitions()
    assert len(parts) > 1
    at = [r["id"] for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
    assert sorted(at) == list(range(300))


def test_options_that_cannot_work(spark, past):
    with pytest.raises(Exception, match="power of two"):
        spark.read.format("history").options(**options(past, step=3 * HOUR)).load().count()


def test_empty_history(spark, past, tmp_path):
    spark.read.parquet(str(past / "bins")).limit(0).write.parquet(str(tmp_path / "none"))
    assert spark.read.format("history").options(**options(past, bins=str(tmp_path / "none"))).load().count() == 0


def test_the_walk_back_survives_restarts(spark, past, tmp_path):
    def once():
        frame = spark.readStream.format("history").options(**options(past, step=32 * HOUR, frontier=str(tmp_path / "frontier"))).load()
        frame.select("id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()), json.loads((tmp_path / "frontier").read_text())["frontier"]

    seen = [once() for _ in range(5)]
    assert [f // HOUR for _, f in seen] == [68, 36, 4, 0, 0]
    assert seen[0][0] == sorted(120 + k for k in range(180) if k * 100 / 180 >= 68)
    assert seen[3][0] == seen[4][0] == list(range(300))
