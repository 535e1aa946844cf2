import json
import shutil
import time

from pyspark.sql import functions as F

from sentinelle.operators import snapshot
from sentinelle.sources import views as V
from sentinelle.streaming import events as S

SF = "/root/testdata/sf0.001"


def landed(tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in/a.parquet")
    return str(tmp_path / "in")


def drained(stream, name, tmp_path, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_windows_as_in_batch(spark, tmp_path):
    got = drained(S.windowed(S.read(spark, landed(tmp_path))), "win", tmp_path, "complete")
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(r.n for r in got.collect()) == sorted(r.n for r in batch.collect())


def test_state_as_in_batch(spark, tmp_path):
    got = drained(S.running_incidents(S.read(spark, landed(tmp_path))), "state", tmp_path, "update")
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.session_window("ts", "6 hours"), "event_type", "user_id").count().groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    want = {(r.event_type, r.user_id): r.n for r in batch.collect()}
    assert {(r.event_type, r.user_id): r.incident for r in got.collect()} == want


def test_dedup_and_dead_letters(spark, tmp_path):
    s = S.deduplicated(S.read(spark, landed(tmp_path)), ["user_id", "event_type"])
    q = S.land(s.withColumn("reject_reason", F.when(F.col("value") < 50, "small")), str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "failed"))
    q.awaitTermination()
    kept, dead = spark.read.parquet(str(tmp_path / "out")), spark.read.parquet(str(tmp_path / "failed"))
    assert kept.count() + dead.count() <= spark.read.parquet(f"{SF}/events.parquet").count()
    assert dead.where("value >= 50").count() == 0


def test_counters_follow_a_stream(spark, tmp_path):
    counters = S.Counters()
    spark.streams.addListener(counters)
    s = S.observed(S.read(spark, landed(tmp_path)).withColumn("status", F.when(F.col("value") < 50, "Failed").otherwise("Persisted")))
    drained(s, "counted", tmp_path, "append")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for _ in range(100):
        if counters.totals:
            break
        time.sleep(0.1)
    spark.streams.removeListener(counters)
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert counters.totals["processed"] == events.count()
    assert counters.totals["failed"] == events.where("value < 50").count()


def test_bundles_as_they_land(spark, tmp_path):
    item = {"kind": "document", "url": "https://a/1", "publisher": "p", "publishedAt": "2024-01-01T00:00:00Z", "retrievedAt": "2024-01-01T01:00:00Z", "contentHash": "sha256:" + "0" * 64, "excerpt": "x"}
    (tmp_path / "b").mkdir()
    for k, urls in enumerate((["https://a/1", "https://a/2"], ["https://a/2", "https://a/3", "bad"])):
        body = {"schemaVersion": 1, "bundleId": str(k), "collectedAt": "2024-01-02T00:00:00Z", "items": [item | {"url": u} for u in urls]}
        (tmp_path / "b" / f"{k}.json").write_text(json.dumps(body))
    (tmp_path / "b" / "broken.json").write_text("{")
    got = drained(S.bundle_items(spark, str(tmp_path / "b"), F.lit("2024-01-03").cast("timestamp"), files_per_batch=1), "bundled", tmp_path, "append")
    assert sorted(r.url for r in got.collect()) == ["https://a/1", "https://a/2", "https://a/3"]


def test_snapshot_parts(spark, tmp_path):
    o = V.observations(spark, SF)
    snapshot.export_parts(o, V.incidents(spark, SF), V.conflict_reports(spark, SF), V.NOW, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "analytics")).groupBy("window").count().count() == 4
    assert spark.read.parquet(str(tmp_path / "observations")).count() == o.count()
    assert spark.read.parquet(str(tmp_path / "incidents")).count() == V.incidents(spark, SF).count()
    assert spark.read.parquet(str(tmp_path / "evidence")).count() == o.where("incident is not null").count()
