"""Provider pages built from the tables, as the providers would send them, and read back by the engine's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sentinelle.session import shared_folder, table
from sentinelle.sources import coded, history
from sentinelle.sources import posts as P
from sentinelle.sources import views as V
from sentinelle.sources.views import HOUR, Queries

Q = Queries()
#: Records of a page; one page of CYCLE arrives torn.
PAGE, CYCLE = 500, 37


def _pages(rows, key: list[str], before: str, after, *, by: str = "id", joined: str = ","):
    """Texts of pages of at most PAGE records: `rows` has the key, the order `by` and `record`."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "record"))), lambda r: r.record), joined)
    return rows.groupBy(*key).agg(listed.alias("listed")).select(*key, F.concat(F.lit(before), "listed", after).alias("value"))


def _torn(pages):
    return pages.withColumn("value", F.when(F.col("page") % CYCLE == 1, F.expr("left(value, length(value) - 2)")).otherwise(F.col("value")))


def _pick(key, *names):
    return F.get(F.array(*[F.lit(n) for n in names]), key.cast("int"))


_CODED = f""", r AS (SELECT *, id // {PAGE} AS page, id % 23 <> 0 AND lat IS NOT NULL AS placed,
  ['Battles', 'Protests', 'Explosions/Remote violence', 'Violence against civilians', 'Strategic developments', NULL][id % 6 + 1] AS coded FROM v_observations)
SELECT page, CASE WHEN id % 19 <> 0 THEN 'E' || id WHEN id % 38 <> 0 THEN id::VARCHAR END AS identifier,
  CASE coded WHEN 'Battles' THEN 'Conflict' WHEN 'Protests' THEN 'Protest' WHEN 'Explosions/Remote violence' THEN 'Conflict' WHEN 'Violence against civilians' THEN 'Terrorism' WHEN 'Strategic developments' THEN 'MilitaryMovement' ELSE 'Other' END AS event_type,
  CASE WHEN k >= 25 THEN 'Critical' WHEN k >= 5 THEN 'High' WHEN k >= 1 THEN 'Medium' WHEN coded = 'Battles' THEN 'Medium' ELSE 'Low' END AS severity,
  CASE WHEN placed THEN lat END AS lat, CASE WHEN placed THEN lon END AS lon, CASE id % 4 WHEN 1 THEN 'Settlement' WHEN 2 THEN 'Region' WHEN 3 THEN 'Region' END AS precision,
  CASE WHEN id % 3 <> 0 THEN place ELSE 'N' || country END AS place, strftime(ts, '%Y-%m-%d') AS day,
  CASE WHEN id % 4 = 0 THEN 'None' WHEN id % 7 = 0 THEN 'TerritoryTransferred' WHEN id % 7 = 1 THEN 'PresenceEstablished' ELSE 'None' END AS control_signal,
  CASE WHEN id % 38 = 0 THEN 'no identifier' WHEN coded IS NULL AND id % 7 > 1 AND id % 3 = 0 THEN 'nothing said' END AS reason
FROM r WHERE page % {CYCLE} <> 1
UNION ALL SELECT page, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not json' FROM r WHERE page % {CYCLE} = 1 GROUP BY page"""


@Q.add("coded_pages_read", _CODED)
def coded_pages_read(spark, d):
    i = F.col("id")
    record = F.struct(
        F.when(i % 19 != 0, F.concat(F.lit("E"), i)).alias("event_id_cnty"),
        F.when((i % 19 == 0) & (i % 38 != 0), i).alias("data_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("event_date"),
        _pick(i % 6, "Battles", "Protests", "Explosions/Remote violence", "Violence against civilians", "Strategic developments").alias("event_type"),
        _pick(i % 7, "Government regains territory", "Headquarters or base established").alias("sub_event_type"),
        F.when(i % 4 != 0, F.concat(F.lit("A"), F.col("user_id") % 5)).otherwise(" ").alias("actor1"),
        F.when(i % 23 != 0, F.col("lat").cast("string")).otherwise("95").alias("latitude"),
        F.col("lon").alias("longitude"),
        (i % 4).alias("geo_precision"),
        F.col("k").cast("string").alias("fatalities"),
        F.when(i % 3 != 0, F.col("place")).alias("location"),
        F.concat(F.lit("N"), "country").alias("country"),
    )
    rows = V.observations(spark, d).select("id", F.floor(i / PAGE).alias("page"), F.to_json(record).alias("record"))
    read = coded.coded_rows(_torn(_pages(rows, ["page"], '{"success":true,"data":[', F.lit("]}"))), PAGE)
    return read.select("page", "identifier", "event_type", "severity", "lat", "lon", "precision", "place", F.date_format("occurred", "yyyy-MM-dd").alias("day"), "control_signal", "reason")


_GED = f""", r AS (SELECT *, id // {PAGE} AS page, id % 23 <> 0 AND lat IS NOT NULL AS placed FROM v_observations)
SELECT page, id::VARCHAR AS identifier, CASE WHEN id % 3 = 2 THEN 'Terrorism' ELSE 'Conflict' END AS event_type, CASE WHEN k >= 25 THEN 'Critical' WHEN k >= 5 THEN 'High' WHEN k >= 1 THEN 'Medium' ELSE 'Low' END AS severity,
  CASE WHEN id % 2 = 0 THEN place WHEN id % 5 = 1 THEN 'Up' || country ELSE 'N' || country END AS place, ['Exact', 'Settlement', 'Region', 'Region', 'Region', 'Country', 'Region'][id % 8] AS precision,
  CASE WHEN placed THEN lat END AS lat, CASE WHEN placed THEN lon END AS lon, 'K' || (user_id % 9) AS conflict_key, strftime(ts, '%Y-%m-%d') AS day, page % 2 = 0 AS more, NULL AS reason FROM r WHERE page % {CYCLE} <> 1
UNION ALL SELECT page, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not json' FROM r WHERE page % {CYCLE} = 1 GROUP BY page"""


@Q.add("ged_pages_read", _GED)
def ged_pages_read(spark, d):
    i = F.col("id")
    record = F.struct(
        i.alias("id"),
        (i % 3 + 1).alias("type_of_violence"),
        F.when(i % 2 == 0, F.col("place")).otherwise("  ").alias("where_coordinates"),
        F.when(i % 5 == 1, F.concat(F.lit("Up"), "country")).alias("adm_1"),
        F.concat(F.lit("N"), "country").alias("country"),
        F.when(i % 23 != 0, F.col("lat")).otherwise(-91).alias("latitude"),
        F.col("lon").cast("string").alias("longitude"),
        (i % 8).alias("where_prec"),
        F.col("k").alias("best"),
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00")).alias("date_start"),
        F.concat(F.lit("K"), F.col("user_id") % 9).alias("conflict_new_id"),
    )
    rows = V.observations(spark, d).select("id", F.floor(i / PAGE).alias("page"), F.to_json(record).alias("record"))
    more = F.when(F.col("page") % 4 == 0, '],"NextPageUrl":"https://a.example/2"}').when(F.col("page") % 4 == 2, '],"NextPageUrl":" ","TotalPages":"2"}').otherwise('],"NextPageUrl":"","TotalPages":1}')
    read = coded.ged_rows(_torn(_pages(rows, ["page"], '{"Result":[', more)))
    return read.select("page", "identifier", "event_type", "severity", "place", "precision", "lat", "lon", "conflict_key", F.date_format("occurred", "yyyy-MM-dd").alias("day"), "more", "reason")


_POSTS = f""", r AS (SELECT *, coalesce(channel, 'none') AS c, id // {PAGE} AS page, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM v_observations WHERE platform IS NOT NULL)
SELECT platform, c AS channel, 'https://t.me/' || c || '/' || id AS url, CASE WHEN id % 7 <> 0 THEN 'R&D café &lt; ' || place END AS said, t AS posted, NULL AS language, CASE WHEN id % 7 = 0 THEN 'no text' END AS reason FROM r WHERE platform = 'telegram'
UNION ALL SELECT platform, c, 'https://bsky.app/profile/' || c || '/post/p' || id, CASE WHEN id % 7 <> 0 THEN 'R&D <' || place END, t, 'en', CASE WHEN id % 5 = 0 THEN 'repost' WHEN id % 7 = 0 THEN 'no text' END FROM r WHERE platform = 'bluesky'
UNION ALL SELECT platform, c, 'https://m.example/' || id, 'R&D – ' || place, CASE WHEN id % 7 <> 0 THEN t END, 'fr', CASE WHEN id % 5 = 0 THEN 'repost' WHEN id % 7 = 0 THEN 'no time' END FROM r WHERE platform = 'mastodon' AND page % {CYCLE} <> 1
UNION ALL SELECT platform, c, NULL, NULL, NULL, NULL, 'not json' FROM r WHERE platform = 'mastodon' AND page % {CYCLE} = 1 GROUP BY platform, c, page
UNION ALL SELECT platform, c, NULL, NULL, NULL, NULL, 'platform' FROM r WHERE platform = 'x' GROUP BY platform, c, page"""


@Q.add("post_pages_read", _POSTS)
def post_pages_read(spark, d):
    i, place, at = F.col("id"), F.col("place"), F.col("t")
    o = V.observations(spark, d).where("platform is not null").withColumns({"channel": F.coalesce("channel", F.lit("none")), "page": F.floor(i / PAGE), "t": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")})
    text = F.when(i % 7 != 0, F.concat(F.lit("R&amp;D  caf&#233; &amp;lt; <b>"), place, F.lit("</b>"))).otherwise("<i></i>")
    html = F.concat(F.lit('<div data-post="'), "channel", F.lit("/"), i, F.lit('"><div class="js-message_text" dir="auto">'), text, F.lit('</div><time datetime="'), at, F.lit('"></time></div>'))
    post = F.struct(F.concat(F.lit("at://did/post/p"), i).alias("uri"), F.struct(F.when(i % 7 != 0, F.concat(F.lit("R&D <"), place)).alias("text"), at.alias("createdAt"), F.array(F.lit("en")).alias("langs")).alias("record"))
    entry = F.to_json(F.struct(post.alias("post"), F.when(i % 5 == 0, F.struct(F.lit("again").alias("by"))).alias("reason")))
    status = F.to_json(F.struct(F.concat(F.lit("https://m.example/"), i).alias("url"), F.concat(F.lit("<p>R&amp;D &ndash;<br>"), place, F.lit("</p>")).alias("content"), F.when(i % 7 != 0, at).alias("created_at"), F.lit("fr").alias("language"), F.when(i % 5 == 0, F.struct(F.lit("u").alias("url"))).alias("reblog")))
    record = F.when(F.col("platform") == "telegram", html).when(F.col("platform") == "bluesky", entry).when(F.col("platform") == "mastodon", status).otherwise("")
    key = ["platform", "channel", "page"]
    opening = F.when(F.col("platform") == "bluesky", '{"feed":[').when(F.col("platform") == "mastodon", "[").otherwise("")
    closing = F.when(F.col("platform") == "bluesky", "]}").when((F.col("platform") == "mastodon") & (F.col("page") % CYCLE != 1), "]").otherwise("")
    pages = _pages(o.select(*key, "id", record.alias("record")), key, "", F.lit(""))
    fetched = pages.select("platform", "channel", F.encode(F.concat(opening, "value", closing), "UTF-8").alias("body"))
    return P.post_rows(fetched).select("platform", "channel", "url", "said", "posted", "language", "reason")


#: Least width, step and page of the walk through history.
LEAST, STEP, CAP = HOUR, 64 * HOUR, 500
_WINDOWS = f"""
WITH e AS (SELECT epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL), x AS (SELECT (max(t) // {LEAST} + 1) * {LEAST} AS last, min(t) // {LEAST} * {LEAST} AS low FROM e),
c AS (SELECT l, (last - 1 - t) // ({STEP} // (1 << l)) AS w, last, low, count(*) AS n FROM e, x, range(7) AS r(l) GROUP BY ALL)
SELECT greatest(last - (c.w + 1) * ({STEP} // (1 << c.l)), low) AS window_from, last - c.w * ({STEP} // (1 << c.l)) AS window_to, c.n, c.n > {CAP} AS truncated
FROM c LEFT JOIN (SELECT l + 1 AS l, w, n FROM c) AS p ON p.l = c.l AND p.w = c.w // 2 WHERE (c.l = 0 OR p.n > {CAP}) AND (c.n <= {CAP} OR c.l = 6)"""


@Q.add("history_windows", _WINDOWS, prelude=None)
def history_windows(spark, d):
    counts = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    history.bins(table(spark, d, "events"), "ts", LEAST).write.parquet(counts)
    spark.dataSource.register(history.HistorySource)
    rows = spark.read.format("history").options(path=f"{d}/events.parquet", bins=counts, column="ts", least=LEAST, step=STEP, cap=CAP).load()
    start, end, cut = history.ADDED
    return rows.groupBy(F.col(start).alias("window_from"), F.col(end).alias("window_to")).agg(F.count("*").alias("n"), (F.max(cut) == 1).alias("truncated"))


QUERIES, ORACLE = Q.QUERIES, Q.ORACLE
