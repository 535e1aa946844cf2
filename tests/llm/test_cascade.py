import random

import numpy as np
from pyspark.sql import functions as F

from sentinelle.llm import cascade
from sentinelle.llm.q_cascade import RULES


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key long")


def test_exact_over_the_universe(spark):
    r = random.Random(2)
    universe = [r.getrandbits(63) - (1 << 62) for _ in range(20000)]
    listed = set(universe[:700])
    got = cascade.build(keys(spark, [*listed, *listed]), keys(spark, universe))
    assert len(got.levels) > 2
    assert got.has(np.array(universe)).tolist() == [u in listed for u in universe]


def test_everything_or_nothing_listed(spark):
    assert not cascade.build(keys(spark, []), keys(spark, [1, 2])).has(np.array([1, 2])).any()
    assert cascade.build(keys(spark, [1, 2]), keys(spark, [1, 2])).has(np.array([1, 2])).all()
    assert len(cascade.build(keys(spark, [1]), keys(spark, [])).levels) == 1


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(cascade, "MAX_BYTES", 64)
    listed, universe = keys(spark, range(0, 300, 3)), keys(spark, range(-50, 300))
    cascades = cascade.build_sharded(listed, universe)
    assert len(cascades) > 1
    rows = universe.select("key", F.array("key", F.col("key") + 1).alias("ks"), F.lit("x").alias("clash"))
    for r in cascade.with_membership(rows, cascades, "ks", "hit").where("key < 299").collect():
        assert r.hit == [k in range(0, 300, 3) for k in r.ks]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:n].lower() if rest[:n].isascii() else rest[:n], rest[n:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


def test_rules_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "x://com/en/", "x://com/en", "x://dot.com/en/1", "x://notcom/en/1"]
    urls += ["x://example.net/de/81", "x://b.example.net/de/7", "x://net", "x://org/es/?a", "x://a.org?x/es/", "x://a.org#/es/", "x://a://b.com/en/", "x://..com/en/7", "x://ex.com\n/en/7"]
    urls += ["https://a.example.com/en/7", "https://a.example.com/en/7"]
    urls += ["x://" + "a." * 100_000 + "com/en/7", "x://net/de/8" + "/" * 1_000_000]
    rows = spark.createDataFrame([(i, u, "clash", "mine", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, _url_at string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in cascade.judge(rows, RULES).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert {r._url_at for r in cascade.judge(rows, RULES).collect()} == {"mine"}
    assert cascade.judge(rows.limit(0), RULES).count() == 0
    assert {r.verdict for r in cascade.judge(rows, []).collect()} == {"allow"}
