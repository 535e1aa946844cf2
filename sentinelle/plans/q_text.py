"""Text, validation and pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinelle.functions import scores
from sentinelle.functions import text as X
from sentinelle.operators import lexicon as L
from sentinelle.operators import mentions as M
from sentinelle.operators import pipeline as P
from sentinelle.operators import similar as S
from sentinelle.operators import skew
from sentinelle.session import settled, table
from sentinelle.sources import views as V
from sentinelle.sources.views import HOUR, NOW, Queries

Q = Queries()


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@Q.add("fingerprint_documents", "SELECT doc_id, sha256(lower(trim(source)) || '|' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g'))) AS fingerprint FROM documents")
def fingerprint_documents(spark, d):
    return _docs(spark, d).select("doc_id", X.fingerprint(F.col("source"), F.lit(None).cast("string"), F.col("text")).alias("fingerprint"))


@Q.add("duplicate_documents", ", f AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g'))) AS f FROM documents) SELECT doc_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY f) THEN min(doc_id) OVER (PARTITION BY f) END AS duplicate_of FROM f")
def duplicate_documents(spark, d):
    f = settled(_docs(spark, d).select("doc_id", F.unhex(F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{Nd}]+", " ")), 256)).alias("f")))
    first = settled(f.groupBy("f").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")))
    return skew.met(f, first, ["f"], "times").select("doc_id", F.when(F.col("doc_id") != F.col("first"), F.col("first")).alias("duplicate_of"))


_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(substr({0}, 1, 2000)), '[\\p{{L}}\\p{{Nd}}]+(?:-[\\p{{L}}\\p{{Nd}}]+)*'), lambda w: length(w) >= 3 AND w NOT IN (" + _STOPS + ")))"


@Q.add("lexical_tokens", f"SELECT doc_id, len({_TOKENS.format('text')}) AS n, array_to_string(list_sort({_TOKENS.format('text')})[1:5], ' ') AS head FROM documents")
def lexical_tokens(spark, d):
    t = X.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(F.slice(F.array_sort(t), 1, 5), " ").alias("head"))


_SETS = f""", w AS (SELECT doc_id, list_sort({_TOKENS.format('text')}) AS w FROM documents), s AS (SELECT w, min(doc_id) AS id, count(*) AS copies FROM w WHERE len(w) > 0 GROUP BY w)"""


@Q.add("lexical_similarity_pairs", f"""{_SETS}, i AS (SELECT id, copies, len(w)::DOUBLE AS n, unnest(w) AS word FROM s), m AS (SELECT a.id AS a, b.id AS b, round_even(count(*) / sqrt(any_value(a.n * b.n)), 4) AS similarity FROM i a JOIN i b ON a.word = b.word AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, similarity, x.copies AS copies_a, y.copies AS copies_b FROM m JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE similarity >= 0.4""")
def lexical_similarity_pairs(spark, d):
    """All pairs of different wordings that are 0.4 alike or more, each under the least document that has it."""
    sets = settled(S.distinct_sets(_wordings(spark, d), "doc_id", "w").select("doc_id", "w", "copies"))
    found = S.pairs(sets, 0.4, "doc_id", "w")
    copies = lambda s: sets.select(F.col("doc_id").alias(s), F.col("copies").alias(f"copies_{s}"))
    return found.join(copies("a"), "a").join(copies("b"), "b").select("a", "b", "similarity", "copies_a", "copies_b")


#: Wordings of whole texts.
_WHOLE = _SETS.replace("substr(text, 1, 2000)", "text")


@Q.add("lexical_wording_classes", f"{_WHOLE} SELECT doc_id, coalesce(id, doc_id) AS wording FROM w LEFT JOIN s USING (w)")
def lexical_wording_classes(spark, d):
    """Every document with the least one of the same wording, whole texts taken; those without words stand for themselves."""
    # Words are looked for once: what is settled of a document is its number and the key of its wording.
    keyed = settled(_wordings(spark, d, None).select("doc_id", F.when(F.size("w") > 0, F.unhex(S.set_key(F.col("w")))).alias("set")))
    some = keyed.where("set is not null")
    sets = settled(some.groupBy("set").agg(F.min("doc_id").alias("wording"), F.count("*").alias("copies")))
    several = skew.met(some, sets, ["set"], "copies").select("doc_id", "wording")
    return several.unionByName(keyed.where("set is null").select("doc_id", F.col("doc_id").alias("wording")))


def _wordings(spark, d, limit=2000):
    return _docs(spark, d).select("doc_id", X.tokens(F.coalesce("text", F.lit("")), limit).alias("w"))


def _any(keys, c="t"):
    return " OR ".join(f"contains({c}, '{k}')" for k in keys)


_REPORT = ", r AS (SELECT event_id AS id, lower(['Pirates boarded a tanker near the ', 'Warship convoy moves; ', 'Cyber attack, data breach and ', 'Troops died after shelling; killed dozens in ', 'Protest over embargo disrupts ', 'Nothing of note in '][event_id % 6 + 1] || event_type || [' strait', ' with casualties', ' flood damage', ' and a ceasefire'][event_id % 4 + 1]) AS t FROM events)"


def _reports(spark, d):
    i = F.col("event_id")
    starts = ["Pirates boarded a tanker near the ", "Warship convoy moves; ", "Cyber attack, data breach and ", "Troops died after shelling; killed dozens in ", "Protest over embargo disrupts ", "Nothing of note in "]
    ends = [" strait", " with casualties", " flood damage", " and a ceasefire"]
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (i % len(xs)).cast("int"))
    return table(spark, d, "events").select(i.alias("id"), F.concat(pick(starts), "event_type", pick(ends)).alias("t"))


_CLASS = "CASE " + " ".join(f"WHEN {_any(keys)} THEN '{name}'" for name, keys in X.TYPE_KEYWORDS.items()) + " ELSE 'Other' END"
_HITS = " + ".join(f"contains(t, '{k}')::INT" for keys in X.TYPE_KEYWORDS.values() for k in keys)


@Q.add("keyword_classify", _REPORT + f" SELECT id, {_CLASS} AS event_type, {_HITS} AS hits, round((CASE WHEN {_CLASS} = 'Other' THEN 0.2 ELSE least(0.65, 0.35 + 0.1 * ({_HITS})) END)::DOUBLE, 4) AS confidence FROM r")
def keyword_classify(spark, d):
    r = _reports(spark, d).withColumns({"event_type": X.event_type(F.col("t")), "hits": X.keyword_hits(F.col("t"))})
    return r.select("id", "event_type", "hits", F.round(X.type_confidence(F.col("event_type"), F.col("hits")), 4).alias("confidence"))


@Q.add("severity_markers", _REPORT + " SELECT id, CASE " + " ".join(f"WHEN {_any(keys)} THEN '{name}'" for name, keys in X.SEVERITY_MARKERS.items()) + " ELSE 'Low' END AS severity FROM r")
def severity_markers(spark, d):
    return _reports(spark, d).select("id", X.marked_severity(F.col("t")).alias("severity"))


_SCRIPT = {tag: f"length(regexp_replace(t, '[^\\p{{{script}}}]', '', 'g'))" for tag, script in X.SCRIPTS.items()}
_TOP = f"greatest({', '.join(_SCRIPT.values())})"
_MIXED = ", m AS (SELECT doc_id, text || ['', 'Київ місто', 'ΑΘΗΝΑ', 'مدينة', '東京', 'ひらがな', '서울'][doc_id % 7 + 1] AS t FROM documents)"


@Q.add("language_by_script", _MIXED + f" SELECT doc_id, CASE WHEN {_TOP} = 0 THEN 'en' " + " ".join(f"WHEN {n} = {_TOP} THEN '{tag}'" for tag, n in _SCRIPT.items()) + " END AS language FROM m")
def language_by_script(spark, d):
    ends = F.get(F.array(*[F.lit(x) for x in ("", "Київ місто", "ΑΘΗΝΑ", "مدينة", "東京", "ひらがな", "서울")]), (F.col("doc_id") % 7).cast("int"))
    return _docs(spark, d).select("doc_id", X.language(F.concat("text", ends)).alias("language"))


_UNIT = f"(?i)\\s+(?:{'|'.join(X.PLACE_UNITS)})$"


@Q.add("place_key_unit_words", f", p AS (SELECT s_suppkey AS id, s_name || [' city', ' refugee camp', ' Oblast', '', ' bay'][s_suppkey % 5 + 1] AS name FROM supplier) SELECT id, lower(regexp_replace(regexp_replace(trim(name), '{_UNIT}', ''), '{_UNIT}', '')) AS key FROM p")
def place_key_unit_words(spark, d):
    ends = F.get(F.array(*[F.lit(x) for x in (" city", " refugee camp", " Oblast", "", " bay")]), (F.col("s_suppkey") % 5).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), X.place_key(F.concat("s_name", ends)).alias("key"))


@Q.add("sanitise_truncate", ", s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\p{Cc}‪-‮⁦-⁩]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN rtrim(substr(t, 1, 119)) || '…' ELSE t END AS excerpt FROM s")
def sanitise_truncate(spark, d):
    return _docs(spark, d).select("doc_id", X.truncated(X.sanitised(F.col("text")), 120).alias("excerpt"))


@Q.add("html_strip_pages", "SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]{0,1000}>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_sha256 FROM pages")
def html_strip_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(X.stripped_html(F.col("html")), 256).alias("text_sha256"))


@Q.add("url_and_tag_predicates", "SELECT page_id, regexp_matches(url, '^https?://[^/\\s]+') AS web, starts_with(url, 'https://') AS secure, split_part(split_part(url, '://', 2), '/', 1) AS host, regexp_matches(split_part(split_part(url, '://', 2), '/', 2), '^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$') AS tagged FROM pages")
def url_and_tag_predicates(spark, d):
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    part = lambda n: F.split_part(rest, F.lit("/"), F.lit(n))
    return table(spark, d, "pages").select("page_id", F.col("url").rlike(r"^https?://[^/\s]+").alias("web"), F.col("url").startswith("https://").alias("secure"), part(1).alias("host"), X.language_tag_ok(part(2)).alias("tagged"))


@Q.add("private_address_predicate", ", a AS (SELECT event_id AS id, event_id % 240 AS x, user_id % 256 AS y FROM events) SELECT id, x IN (0, 10, 127) OR (x = 172 AND y BETWEEN 16 AND 31) OR (x = 192 AND y = 168) OR (x = 169 AND y = 254) OR (x = 100 AND y BETWEEN 64 AND 127) OR x >= 224 AS refused FROM a")
def private_address_predicate(spark, d):
    ip = F.concat_ws(".", F.col("event_id") % 240, F.col("user_id") % 256, F.lit(3), F.lit(4))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), X.private_address(ip).alias("refused"))


_STARTS = ["Forces captured the town of ", "Army withdrew from ", "Reports from ", "It was quiet; ", "Units seized  "]
_ENDS = [".", " fell to rebels", " has been captured by nobody", "ville burned", " is now held by units"]


@Q.add(
    "control_claim_detect",
    f""", c AS (SELECT event_id AS id, 'P' || (user_id % 4) AS place, {_STARTS}[event_id % 5 + 1] || 'P' || (event_id % 4) || {_ENDS}[event_id % 7 % 5 + 1] AS t FROM events),
f AS (SELECT *, '(?i)(?:^|[^\\p{{L}}\\p{{Nd}}_])' AS b, '(?:$|[^\\p{{L}}\\p{{Nd}}_])' AS e, '{X.FILLER.replace("'", "''")}' AS z FROM c)
SELECT id, CASE WHEN regexp_matches(t, b || '(?:{"|".join(X.WITHDRAWAL).replace(" ", "\\s+")})' || z || '\\s+' || place || e) THEN 'WithdrawalReported'
  WHEN regexp_matches(t, b || '(?:{"|".join(X.GAIN).replace(" ", "\\s+")})' || z || '\\s+' || place || e) OR regexp_matches(t, b || place || '\\s+(?:{"|".join(X.GAINED).replace(" ", "\\s+")})' || e) THEN 'TerritoryTransferred' ELSE 'None' END AS signal FROM f""",
)
def control_claim_detect(spark, d):
    i = F.col("event_id")
    pick = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    text = F.concat(pick(_STARTS, i), F.lit("P"), i % 4, pick(_ENDS, i % 7))
    return table(spark, d, "events").select(i.alias("id"), X.control_signal(text, F.concat(F.lit("P"), F.col("user_id") % 4)).alias("signal"))


@Q.add("same_actor_prefix", ", n AS (SELECT n_nationkey AS id, lower(n_name) AS a FROM nation) SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON left(x.a, 2) = left(y.a, 2) AND x.id < y.id WHERE x.a = y.a OR (least(length(x.a), length(y.a)) >= 4 AND (starts_with(x.a, y.a) OR starts_with(y.a, x.a)))")
def same_actor_prefix(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("w"), F.lower(F.substring("n_name", 1, 2)).alias("p"))
    return n.toDF("a", "wa", "p").join(n.toDF("b", "wb", "p"), "p").where(F.col("a") < F.col("b")).where(X.same_actor(F.col("wa"), F.col("wb"))).select("a", "b")


# --- envelopes

_ENV = """, e AS (SELECT id, CASE WHEN id % 17 = 0 THEN ' ' ELSE source END AS source, CASE id % 19 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 20001) ELSE 'Report ' || id END AS content, kind,
  CASE WHEN id % 13 = 0 THEN lat * 2 ELSE lat END AS lat, CASE WHEN id % 23 = 0 THEN NULL WHEN id % 29 = 0 THEN lon * 2 ELSE lon END AS lon, CASE WHEN id % 3 = 0 THEN precision END AS precision FROM v_observations)"""


def _envelopes(spark, d):
    i, o = F.col("id"), V.observations(spark, d)
    return o.select(
        "id",
        F.when(i % 17 == 0, " ").otherwise(F.col("source")).alias("source"),
        F.when(i % 19 == 0, "").when(i % 19 == 1, F.repeat(F.lit("x"), 20001)).otherwise(F.concat(F.lit("Report "), i)).alias("content"),
        "kind",
        F.when(i % 13 == 0, F.col("lat") * 2).otherwise(F.col("lat")).alias("lat"),
        F.when(i % 23 == 0, None).when(i % 29 == 0, F.col("lon") * 2).otherwise(F.col("lon")).alias("lon"),
        F.when(i % 3 == 0, F.col("precision")).alias("precision"),
    )


@Q.add("envelope_validation_reasons", _ENV + """ SELECT id, CASE WHEN trim(source) = '' THEN 'source' WHEN trim(content) = '' THEN 'content' WHEN length(content) > 20000 THEN 'too long' WHEN lat NOT BETWEEN -90 AND 90 THEN 'latitude'
  WHEN lon NOT BETWEEN -180 AND 180 THEN 'longitude' WHEN (lat IS NULL) <> (lon IS NULL) THEN 'half a pair' WHEN lat IS NOT NULL AND kind NOT IN ('Satellite', 'ExternalEvent') THEN 'kind may not place'
  WHEN precision IS NOT NULL AND lat IS NULL THEN 'precision without place' END AS reason FROM e""")
def envelope_validation_reasons(spark, d):
    return _envelopes(spark, d).select("id", P.reject_reason().alias("reason"))


@Q.add("normalise_observation", _REPORT + f""", n AS (SELECT r.id, upper(substr(t, 1, 1)) || substr(t, 2) || '. More follows! ' AS content, t, o.received, o.occurred, o.id % 4 = 0 AS stated FROM r JOIN v_observations o USING (id))
SELECT id, regexp_extract(trim(content), '^(.[^.!?]*[.!?])', 1) AS title, least(occurred, received) AS occurred, CASE WHEN stated THEN 'Sanctions' ELSE {_CLASS} END AS event_type, round((CASE WHEN stated THEN 0.9 WHEN {_CLASS} = 'Other' THEN 0.2 ELSE least(0.65, 0.35 + 0.1 * ({_HITS})) END)::DOUBLE, 4) AS confidence, CASE WHEN stated THEN 'source-declared' ELSE 'keyword' END AS method FROM n""")
def normalise_observation(spark, d):
    o = V.observations(spark, d).select("id", "received", "occurred")
    t = _reports(spark, d).select("id", F.concat(F.upper(F.substring("t", 1, 1)), F.lower(F.substr("t", F.lit(2))), F.lit(". More follows! ")).alias("content"))
    e = o.join(t, "id").select("id", "content", "received", F.col("occurred").alias("declared_at"), F.lit(None).cast("string").alias("declared_title"), F.when(F.col("id") % 4 == 0, "Sanctions").alias("declared_type"), F.lit(None).cast("string").alias("declared_severity"))
    return P.normalised(e).select("id", "title", "occurred", "event_type", F.round("confidence", 4).alias("confidence"), "method")


@Q.add("enrichment_validate_errors", """, j AS (SELECT event_id AS id, event_id % 3 + 1 AS v, ['Naval Incident', 'piracy', 'weather', NULL][event_id % 4 + 1] AS t, ['high', 'LOW', 'dire'][event_id % 3 + 1] AS s, (event_id % 14) / 10.0 AS c, event_id % 8 AS l FROM events)
SELECT id, array_to_string(list_filter([CASE WHEN v <> 2 THEN 'version' END, CASE WHEN t IS NULL OR t = 'weather' THEN 'event type' END, CASE WHEN s = 'dire' THEN 'severity' END, CASE WHEN c > 1 THEN 'confidence' END, CASE WHEN l > 5 THEN 'locations' END], lambda x: x IS NOT NULL), ',') AS errors FROM j""")
def enrichment_validate_errors(spark, d):
    i = F.col("event_id")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (i % len(xs)).cast("int"))
    body = F.to_json(
        F.struct((i % 3 + 1).alias("schemaVersion"), pick(["Naval Incident", "piracy", "weather", None]).alias("eventType"), pick(["high", "LOW", "dire"]).alias("severity"), ((i % 14) / 10).alias("confidence"), F.array_repeat(F.lit("p"), (i % 8).cast("int")).alias("locations"))
    )
    j = table(spark, d, "events").select(i.alias("id"), F.from_json(body, P.ENRICHMENT).alias("e"))
    return j.select("id", F.array_join(P.enrichment_errors(F.col("e")), ",").alias("errors"))


@Q.add("enrichment_merge", """, m AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'Sanctions' END AS declared, event_type, 'M' || (id % 3) AS model, (id % 10) / 10.0 AS c, CASE WHEN id % 5 <> 0 THEN place END AS place, 'MP' AS mp FROM v_observations)
SELECT id, coalesce(declared, CASE WHEN c >= 0.35 THEN model ELSE event_type END) AS event_type, coalesce(place, mp) AS place, CASE WHEN id % 2 = 0 THEN 'Ann,Bob,cat' ELSE 'Ann,Bob' END AS entities, CASE WHEN c >= 0.35 AND declared IS NOT NULL THEN 'source-declared+ai' WHEN c >= 0.35 THEN 'ai' ELSE 'keyword' END AS method FROM m""")
def enrichment_merge(spark, d):
    i = F.col("id")
    m = V.observations(spark, d).select(
        "id", F.when(i % 4 == 0, "Sanctions").alias("declared_type"), "event_type", F.concat(F.lit("M"), i % 3).alias("model_type"), (i % 10 / 10).alias("model_confidence"), F.when(i % 5 != 0, F.col("place")).alias("place"), F.lit("MP").alias("model_place"),
        F.array(F.lit("Ann"), F.lit("Bob")).alias("entities"), F.when(i % 2 == 0, F.array(F.lit("ANN"), F.lit("cat"))).otherwise(F.array(F.lit("bob"))).alias("model_entities"),
    )
    return P.merged(m).withColumn("entities", F.array_join("entities", ","))


@Q.add("translation_state", "SELECT id, CASE WHEN id % 9 = 0 THEN 'MachineTranslated' WHEN lower(coalesce(declared_language, detected_language)) = 'en' THEN 'AlreadyEnglish' ELSE 'NotTranslated' END AS state FROM v_observations")
def translation_state(spark, d):
    english = F.when(F.col("id") % 9 == 0, "text")
    return V.observations(spark, d).select("id", P.translation_state(F.col("declared_language"), F.col("detected_language"), english, F.lit("model")).alias("state"))


# --- bundles, built from the tables as nested rows


def _items(spark, d):
    i = F.col("id")
    at = lambda us: F.timestamp_micros(us)
    item = F.struct(
        F.when(i % 31 == 0, "post").when(F.col("tier") == "UserGenerated", "userGenerated").otherwise("document").alias("kind"), F.concat(F.lit("https://n.example/"), i % 700).alias("url"), F.when(i % 7 != 0, F.col("source")).alias("publisher"), "platform", "channel",
        at("occurred").alias("publishedAt"), F.lit(None).cast("timestamp").alias("postedAt"), at(F.col("received") + F.when(i % 41 == 0, -120 * 60_000_000).otherwise(0)).alias("retrievedAt"), F.concat(F.lit("sha256:"), F.sha2(i.cast("string"), 256)).alias("contentHash"),
        F.when(i % 43 == 0, "x").alias("excerptTranslation"), F.when(i % 47 != 0, "said").alias("excerpt"), F.array_repeat(F.lit("p"), (i % 10).cast("int")).alias("placeNames"),
    )
    bundles = V.observations(spark, d).groupBy(F.floor(F.col("received") / (24 * HOUR)).alias("file")).agg(F.collect_list(F.struct("id", item.alias("item"))).alias("x"))
    return bundles.select("file", F.transform(F.array_sort("x"), lambda s: s.item).alias("items"))


@Q.add("bundle_item_reasons", f""", i AS (SELECT received // {24 * HOUR} AS file, id, 'https://n.example/' || (id % 700) AS url, CASE WHEN id % 31 = 0 THEN 'kind' WHEN tier <> 'UserGenerated' AND id % 7 = 0 THEN 'publisher' WHEN tier = 'UserGenerated' AND channel IS NULL THEN 'channel'
  WHEN id % 41 = 0 AND id % 90 < 120 THEN 'retrieved before published' WHEN id % 43 = 0 THEN 'translation' WHEN id % 47 = 0 THEN 'excerpt' WHEN id % 10 > 8 THEN 'places' END AS reason FROM v_observations),
r AS (SELECT *, row_number() OVER (PARTITION BY file, url, reason IS NULL ORDER BY id) AS n FROM i)
SELECT coalesce(CASE WHEN reason IS NULL AND n > 1 THEN 'url repeated' ELSE reason END, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1""")
def bundle_item_reasons(spark, d):
    from sentinelle.sources import readers

    items = readers.bundle_items(_items(spark, d), F.timestamp_micros(F.lit(NOW)))
    return items.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


# --- places


def _lexicon(spark, d):
    """A place for every customer; every third one shares its name with the one before it."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("p"), F.when(k % 3 == 0, k - 1).otherwise(k)).alias("key"), (F.col("c_nationkey") % 25).cast("int").alias("country"), (k % 90 * 1.0).alias("g_lat"), (k % 170 * 1.0).alias("g_lon"), F.get(F.array(F.lit("Settlement"), F.lit("Region"), F.lit("Country")), (k % 3).cast("int")).alias("g_precision"))


_LEX = """, g AS (SELECT 'p' || CASE WHEN c_custkey % 3 = 0 THEN c_custkey - 1 ELSE c_custkey END AS key, c_nationkey % 25 AS country, c_custkey % 90 * 1.0 AS g_lat, c_custkey % 170 * 1.0 AS g_lon, ['Settlement', 'Region', 'Country'][c_custkey % 3 + 1] AS g_precision FROM customer),
s AS (SELECT key, count(*) AS entries, min(g_lat) AS lat1 FROM g GROUP BY 1), i AS (SELECT key, country, count(*) AS here, min(g_lat) AS lat2 FROM g GROUP BY 1, 2),
j AS (SELECT o.id, o.lat, o.precision, entries, here, CASE WHEN entries = 1 THEN lat1 WHEN here = 1 THEN lat2 END AS found FROM v_observations o LEFT JOIN s ON s.key = lower(o.place) LEFT JOIN i ON i.key = lower(o.place) AND i.country = o.country)"""


@Q.add("gazetteer_resolve", _LEX + " SELECT id, coalesce(lat, found) AS at_lat, CASE WHEN coalesce(lat, found) IS NOT NULL THEN NULL WHEN entries IS NULL THEN 'unknown' ELSE 'ambiguous' END AS reason FROM j")
def gazetteer_resolve(spark, d):
    return P.resolved(V.observations(spark, d), _lexicon(spark, d)).select("id", "at_lat", "reason")


_CONTEXT = _LEX.replace("lower(o.place)", "'p' || (o.id % 90)") + """, t AS (SELECT id, country, 'p' || (id % 90) AS key, id % 7 AS m FROM v_observations), w AS (SELECT key, any_value(country) AS country FROM g GROUP BY 1 HAVING count(*) = 1),
n AS (SELECT t.id, t.key, w.country FROM t JOIN w ON w.key = 'p' || (t.m * 3 + 1)),
u AS (SELECT n.id, min(g.g_lat) AS told FROM n JOIN g ON g.key = n.key AND g.country = n.country GROUP BY n.id HAVING count(*) = 1)
SELECT id, coalesce(lat, found, told) AS at_lat, CASE WHEN coalesce(lat, found, told) IS NOT NULL THEN NULL WHEN entries IS NULL THEN 'unknown' ELSE 'ambiguous' END AS reason FROM j LEFT JOIN u USING (id)"""


@Q.add("gazetteer_context_narrow", _CONTEXT)
def gazetteer_context_narrow(spark, d):
    i = F.col("id")
    o = V.observations(spark, d).withColumns({"place": F.concat(F.lit("P"), i % 90), "text": F.concat(F.lit("Seen near P"), i % 7 * 3 + 1, F.lit(", it is said."))})
    return P.resolved_in_context(o, _lexicon(spark, d)).select("id", "at_lat", "reason")


@Q.add("location_confidence", _LEX + " SELECT id, CASE precision WHEN 'Exact' THEN 0.95 WHEN 'Settlement' THEN 0.85 WHEN 'Region' THEN 0.6 ELSE 0.35 END::DOUBLE AS confidence FROM j WHERE lat IS NOT NULL")
def location_confidence(spark, d):
    o = V.observations(spark, d).where("lat is not null")
    return P.resolved(o, _lexicon(spark, d)).select("id", "confidence")


@Q.add("lexicon_quality_checks", _LEX + ", e AS (SELECT country, min(g_lat) AS s, max(g_lat) AS n, min(g_lon) AS w, max(g_lon) AS e FROM g WHERE g_precision = 'Settlement' GROUP BY 1) SELECT count(*) AS places, (SELECT count(*) FROM g AS x LEFT JOIN e USING (country) WHERE NOT coalesce(x.g_lat BETWEEN s - 0.1 AND n + 0.1 AND x.g_lon BETWEEN w - 0.1 AND e + 0.1, false)) AS outside, count(DISTINCT key) AS names, (SELECT count(*) FROM (VALUES ('p1'), ('p2'), ('nowhere')) AS a(k) WHERE k NOT IN (SELECT key FROM g)) AS missing_anchors FROM g")
def lexicon_quality_checks(spark, d):
    g = _lexicon(spark, d)
    anchors = spark.createDataFrame([("p1",), ("p2",), ("nowhere",)], "key string")
    missing = anchors.join(g, "key", "left_anti").agg(F.count("*").alias("missing_anchors"))
    extents = g.where("g_precision = 'Settlement'").groupBy("country").agg(F.min("g_lat").alias("south"), F.max("g_lat").alias("north"), F.min("g_lon").alias("west"), F.max("g_lon").alias("east"))
    beyond = L.outside(g, extents).agg(F.count("*").alias("outside"))
    return g.agg(F.count("*").alias("places"), F.count_distinct("key").alias("names")).crossJoin(F.broadcast(beyond)).crossJoin(F.broadcast(missing))


@Q.add("lexicon_faults", _LEX + ", e AS (SELECT country, min(g_lat) AS s, max(g_lat) AS n, min(g_lon) AS w, max(g_lon) AS e FROM g WHERE g_precision = 'Settlement' GROUP BY 1), a AS (SELECT 'p' || (n_nationkey % 9) AS key, n_nationkey AS country FROM nation) SELECT 'outside' AS fault, x.key, x.country FROM g AS x LEFT JOIN e USING (country) WHERE NOT coalesce(x.g_lat BETWEEN s - 0.1 AND n + 0.1 AND x.g_lon BETWEEN w - 0.1 AND e + 0.1, false) UNION ALL SELECT 'separator', key, country FROM g WHERE contains(key, '7') UNION ALL SELECT 'missing', key, country FROM a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.key = a.key AND g.country = a.country)")
def lexicon_faults(spark, d):
    g = _lexicon(spark, d)
    extents = g.where("g_precision = 'Settlement'").groupBy("country").agg(F.min("g_lat").alias("south"), F.max("g_lat").alias("north"), F.min("g_lon").alias("west"), F.max("g_lon").alias("east"))
    anchors = table(spark, d, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey") % 9).alias("key"), F.col("n_nationkey").alias("country"))
    # The names of this lexicon hold no separator; a digit stands for one.
    return L.faults(g, extents, anchors, ("7",))


@Q.add("lexicon_alias_difference", ", a AS (SELECT n_nationkey AS id, n_name AS name, list_sort(list_distinct([lower(n_name), lower(n_name), 'x' || n_nationkey, n_name])) AS aliases FROM nation) SELECT id, array_to_string(list_filter(aliases, lambda x: x <> name), '|') AS aliases FROM a")
def lexicon_alias_difference(spark, d):
    a = F.array(F.lower("n_name"), F.lower("n_name"), F.concat(F.lit("x"), "n_nationkey"), F.col("n_name"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array_join(F.array_sort(F.array_except(a, F.array("n_name"))), "|").alias("aliases"))


@Q.add("first_rule_wins", ", r AS (SELECT c_nationkey AS place, c_custkey % 4 AS rule, c_custkey AS rank FROM customer) SELECT place, arg_min(rank, (rule, rank)) AS rank, min(rule) AS rule FROM r GROUP BY 1")
def first_rule_wins(spark, d):
    r = table(spark, d, "customer").select(F.col("c_nationkey").alias("place"), (F.col("c_custkey") % 4).alias("rule"), F.col("c_custkey").alias("rank"))
    return r.groupBy("place").agg(F.min_by("rank", F.struct("rule", "rank")).alias("rank"), F.min("rule").alias("rule"))


@Q.add("alternate_names_join", ", n AS (SELECT n_nationkey AS id, n_name AS name FROM nation), a AS (SELECT s_nationkey AS id, lower(s_name) AS alias FROM supplier) SELECT id, name, array_to_string(list_sort(list(DISTINCT alias)), '|') AS aliases FROM n JOIN a USING (id) GROUP BY 1, 2")
def alternate_names_join(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("id"), F.lower("s_name").alias("alias"))
    return n.join(a, "id").groupBy("id", "name").agg(F.array_join(F.sort_array(F.collect_set("alias")), "|").alias("aliases"))


@Q.add("collector_term_match", _REPORT + " SELECT id, contains(t, 'tanker') OR contains(t, 'embargo') AS matched FROM r")
def collector_term_match(spark, d):
    terms = F.array(F.lit("tanker"), F.lit("EMBARGO"))
    return _reports(spark, d).select("id", F.exists(terms, lambda w: F.contains(F.lower("t"), F.lower(w))).alias("matched"))


_IN_PROSE = """
WITH e AS (SELECT regexp_extract(text, '[A-Za-z]{3,} [A-Za-z]{3,}') AS name, regexp_extract(text, '[A-Za-z]+') AS alias, doc_id * 7919 % 40000 AS population FROM documents WHERE text IS NOT NULL),
n AS (SELECT name FROM e WHERE len(name) > 4 OR (name <> '' AND population >= 20000) UNION SELECT alias FROM e WHERE len(alias) > 4),
h AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY len(name) DESC, name) AS r FROM documents JOIN n ON contains(lower(text), lower(name)))
SELECT d.doc_id, coalesce(string_agg(name, '|' ORDER BY r), '') AS places FROM documents AS d LEFT JOIN h ON h.doc_id = d.doc_id AND r <= 8 GROUP BY d.doc_id"""


@Q.add("collector_place_names", _IN_PROSE, prelude=None)
def collector_place_names(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    first = lambda pattern: F.regexp_extract("text", pattern, 0)
    entries = docs.where("text is not null").select(first("[A-Za-z]{3,} [A-Za-z]{3,}").alias("name"), F.array(first("[A-Za-z]+")).alias("aliases"), (F.col("doc_id") * 7919 % 40000).alias("population"))
    return M.contained(docs, M.searchable(entries), key="doc_id").select("doc_id", F.array_join("names", "|").alias("places"))


@Q.add("humanised_labels", "SELECT DISTINCT status, trim(regexp_replace(status, '([A-Z])', ' \\1', 'g')) AS label FROM v_observations")
def humanised_labels(spark, d):
    return V.observations(spark, d).select("status", F.trim(F.regexp_replace("status", "([A-Z])", " $1")).alias("label")).distinct()


@Q.add("age_in_days", f"SELECT id, greatest(0, round_even(({NOW} - received) / {24 * HOUR}.0, 0))::BIGINT AS days FROM v_observations")
def age_in_days(spark, d):
    return V.observations(spark, d).select("id", F.greatest(F.lit(0).cast("long"), F.bround((F.lit(NOW) - F.col("received")) / (24 * HOUR), 0).cast("long")).alias("days"))


@Q.add("severity_from_deaths", "SELECT id, CASE WHEN k >= 25 THEN 'Critical' WHEN k >= 5 THEN 'High' WHEN k >= 1 THEN 'Medium' ELSE 'Low' END AS severity FROM v_observations")
def severity_from_deaths(spark, d):
    return V.observations(spark, d).select("id", scores.severity_from_deaths(F.col("k")).alias("severity"))


QUERIES, ORACLE = Q.QUERIES, Q.ORACLE
