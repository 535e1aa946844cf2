"""Posts from fetched pages and timelines: bytes in, rows out, all in built-in functions.

`fetched` has platform, channel and body (binary). JSON is read as VARIANT, a rendered channel page by patterns. What is
no post of the channel's own (a repost, a picture without text) or cannot be read is kept with its reason in `post_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinelle.functions import text as X
from sentinelle.sources import coded

_POST = r'(?s)data-post="[^"]+".*?(?=data-post="|\z)'
_TEXT = r'(?s)class="[^"]*message_text[^"]*"[^>]*>(.*?)</div>'


def plain(markup) -> Column:
    """The text of a post's markup, with its character references decoded; null if there is none."""
    text = F.trim(F.regexp_replace(X.unescaped(F.regexp_replace(markup, r"<[^>]{0,2000}>", " ")), r"(?U)\s+", " "))
    return F.nullif(text, F.lit(""))


def _rendered(fetched: DataFrame) -> DataFrame:
    """Posts of a channel's rendered page, at which there is no faulty page, only one without posts."""
    part = F.col("part")
    found = lambda pattern: F.nullif(F.regexp_extract(part, pattern, 1), F.lit(""))
    rows = fetched.where("platform = 'telegram'").select("platform", "channel", F.posexplode(F.regexp_extract_all("text", F.lit(_POST), F.lit(0))).alias("position", "part"))
    return rows.select("platform", "channel", "position", F.concat(F.lit("https://t.me/"), found(r'data-post="([^"]+)"')).alias("url"), plain(found(_TEXT)).alias("said"), found(r'datetime="([^"]+)"').alias("posted"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("reason"))


def _feed(fetched: DataFrame) -> DataFrame:
    e = F.col("record")
    post = coded.unpacked(fetched.where("platform = 'bluesky'").withColumnRenamed("text", "value"), "feed")
    key = F.element_at(F.split(coded.said(e, "post.uri"), "/"), -1)
    url = F.concat(F.lit("https://bsky.app/profile/"), F.col("channel"), F.lit("/post/"), key)
    repost = F.array_contains(F.map_keys(F.try_variant_get(e, "$", coded.OBJECT)), "reason")
    return post.select("platform", "channel", "position", url.alias("url"), coded.said(e, "post.record.text").alias("said"), coded.said(e, "post.record.createdAt").alias("posted"), coded.said(e, "post.record.langs[0]").alias("language"), F.coalesce("reason", F.when(repost, "repost")).alias("reason"))


def _statuses(fetched: DataFrame) -> DataFrame:
    # The page is a bare list; as a field of an object it is read like the others.
    listed = F.concat(F.lit('{"statuses":'), F.col("text"), F.lit("}"))
    rows = coded.unpacked(fetched.where("platform = 'mastodon'").withColumn("value", listed).drop("text"), "statuses")
    e = F.col("record")
    boosted = F.try_variant_get(e, "$.reblog", coded.OBJECT).isNotNull()
    return rows.select("platform", "channel", "position", F.coalesce(coded.said(e, "url"), coded.said(e, "uri")).alias("url"), plain(coded.said(e, "content")).alias("said"), coded.said(e, "created_at").alias("posted"), coded.said(e, "language").alias("language"), F.coalesce("reason", F.when(boosted, "repost")).alias("reason"))


def post_rows(fetched: DataFrame) -> DataFrame:
    """platform, channel, position in the page, url, said, posted, language, and the reason why it is no post (null: none).
    A page of an unknown platform is one row with that reason."""
    pages = fetched.select(F.lower("platform").alias("platform"), "channel", F.decode("body", "UTF-8").alias("text"))
    known = F.coalesce(F.col("platform").isin("telegram", "bluesky", "mastodon"), F.lit(False))
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("position", "int"), ("url", "string"), ("said", "string"), ("posted", "string"), ("language", "string"))]
    other = pages.where(~known).select("platform", "channel", *blank, F.lit("platform").alias("reason"))
    rows = _rendered(pages).unionByName(_feed(pages)).unionByName(_statuses(pages)).unionByName(other)
    silent = F.when(F.coalesce("said", F.lit("")) == "", "no text").when(F.col("posted").isNull(), "no time")
    return rows.withColumn("reason", F.coalesce("reason", silent))


def posts(fetched: DataFrame) -> DataFrame:
    """The posts that can be used; `post_rows` also has the others."""
    return post_rows(fetched).where("reason is null").select("platform", "channel", "url", "said", "posted", "language")
