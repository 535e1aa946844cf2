"""Text functions of the engine, as column expressions."""

from __future__ import annotations

import json
import re
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Category keywords in order of precedence.
TYPE_KEYWORDS = {
    "Piracy": ("pirac", "pirate", "hijack", "boarded", "skiff"),
    "NavalIncident": ("naval", "warship", "frigate", "destroyer"),
    "MaritimeIncident": ("vessel", "tanker", "cargo ship", "shipping lane", "strait"),
    "CyberIncident": ("cyber", "ransomware", "malware", "data breach"),
    "Sanctions": ("sanction", "embargo", "export control"),
    "Terrorism": ("terror", "suicide bomb", "ied"),
    "Protest": ("protest", "demonstration", "rally", "strike action"),
    "MilitaryMovement": ("troop", "deployment", "convoy", "mobilis", "mobiliz"),
    "NaturalHazard": ("earthquake", "wildfire", "flood", "thermal anomaly", "cyclone"),
    "Conflict": ("airstrike", "shelling", "clash", "offensive", "artillery", "ceasefire"),
}
# Severity markers, strongest first.
SEVERITY_MARKERS = {
    "Critical": ("mass casualt", "killed dozens", "nuclear", "chemical weapon", "state of emergency"),
    "High": ("killed", "fatalit", "casualt", "airstrike", "explosion", "hijack", "evacuat"),
    "Medium": ("injur", "damage", "disrupt", "seiz", "detain", "blockad"),
}
# Words that say nothing about what a report is about.
STOP_WORDS = (
    "a", "about", "after", "against", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "before", "being", "but", "by",
    "can", "could", "did", "do", "for", "from", "further", "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "more", "most", "near", "no", "not", "of", "on", "one", "only", "or", "other", "our", "out", "over", "reported",
    "reportedly", "said", "say", "says", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there",
    "these", "they", "this", "those", "to", "two", "under", "up", "was", "we", "were", "what", "when", "where", "which", "while", "who",
    "why", "will", "with", "would", "you", "your",
)
# Unit words that coded place names end in.
PLACE_UNITS = (
    "city", "town", "village", "district", "subdistrict", "sub-district", "province", "oblast", "raion", "region", "state", "governorate",
    "county", "department", "municipality", "woreda", "zone", "prefecture", "commune", "camp", "refugee", "parish", "area", "territory",
    "division", "township", "borough", "canton", "circle",
)
# Phrases of control claims.
WITHDRAWAL = ("withdrew from", "pulled out of", "pulled back from", "abandoned", "ceded", "lost control of", "retreated from")
GAIN = ("captured", "recaptured", "retook", "seized", "overran", "liberated", "took control of", "took over")
GAINED = (
    "fell to", "has fallen to", "was captured by", "was seized by", "was taken by", "has been captured by", "has been seized by", "is now held by",
    "is now under the control of",
)
FILLER = r"(?:\s+(?:the|a|an|of|city|town|village|settlement|district|port|airfield|border\s+crossing))*"
# Scripts and the language each stands for.
SCRIPTS = {"ar": "Arabic", "el": "Greek", "he": "Hebrew", "ja": "Hiragana", "ko": "Hangul", "ru": "Cyrillic", "zh": "Han"}


def fingerprint(source, identifier, content) -> Column:
    """sha256 over the source and its identifier, or over the content's letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(content), r"[^\p{L}\p{Nd}]+", " "))
    name = F.when(F.trim(F.coalesce(identifier, F.lit(""))) != "", F.lower(F.trim(identifier))).otherwise(plain)
    return F.sha2(F.concat(F.lower(F.trim(source)), F.lit("|"), F.coalesce(name, F.lit(""))), 256)


def tokens(text, limit: int | None = 2000) -> Column:
    """Distinct words that carry meaning, of the opening or (`limit` None) of the whole text."""
    opening = text if limit is None else F.substring(text, 1, limit)
    found = F.regexp_extract_all(F.lower(opening), F.lit(r"[\p{L}\p{Nd}]+(?:-[\p{L}\p{Nd}]+)*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def similarity(a, b) -> Column:
    """Shared tokens over the geometric mean of both counts; `a` and `b` are token arrays."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.bround(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b)), 4))


def entity_overlap(observed, known) -> Column:
    """Share of the observed actors that are known; null if either side names none."""
    return F.when((F.size(observed) > 0) & (F.size(known) > 0), F.bround(F.size(F.array_intersect(observed, known)) / F.size(observed), 4))


def event_type(text) -> Column:
    low, out = F.lower(text), F
    for name, keys in TYPE_KEYWORDS.items():
        out = out.when(low.rlike("|".join(map(re.escape, keys))), name)
    return out.otherwise("Other")


def keyword_hits(text) -> Column:
    low = F.lower(text)
    return sum((F.when(F.contains(low, F.lit(k)), 1).otherwise(0) for keys in TYPE_KEYWORDS.values() for k in keys), F.lit(0))


def marked_severity(text) -> Column:
    low, out = F.lower(text), F
    for name, keys in SEVERITY_MARKERS.items():
        out = out.when(low.rlike("|".join(map(re.escape, keys))), name)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "Unknown").otherwise(out.otherwise("Low"))


def type_confidence(kind, hits) -> Column:
    return F.when(kind == "Other", 0.2).otherwise(F.least(F.lit(0.65), 0.35 + 0.1 * hits))


def language(text, fallback: str = "en") -> Column:
    """The language of the script with most letters; ties go to the first tag.

    Letters of any of the scripts are taken out of the text once, and counted by script among themselves; the lambdas
    hold what is used more than once.
    """
    other = lambda *scripts: rf"[^{''.join(rf'\p{{Is{s}}}' for s in scripts)}]+"
    counts = lambda t: F.array(*[F.length(F.regexp_replace(t, other(s), "")) for s in SCRIPTS.values()])
    tag = lambda n: F.get(F.array(*[F.lit(t) for t in SCRIPTS]), (F.array_position(n, F.array_max(n)) - 1).cast("int"))
    counted = F.transform(F.array(F.regexp_replace(text, other(*SCRIPTS.values()), "")), counts)
    return F.get(F.transform(counted, lambda n: F.when(F.array_max(n) == 0, fallback).otherwise(tag(n))), 0)


def place_key(name) -> Column:
    """A coded place name without at most two trailing unit words."""
    unit = rf"(?i)\s+(?:{'|'.join(PLACE_UNITS)})$"
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), unit, ""), unit, ""))


def plain_key(name) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}]+", "")


def truncated(text, limit: int) -> Column:
    """At most `limit` characters that a reader sees, the last of a cut text an ellipsis; no character is cut in two."""
    long = (F.length(text) > limit) & (elements(text) > limit)
    return F.when(long, F.concat(F.rtrim(F.regexp_extract(text, rf"(?s)^\X{{0,{limit - 1}}}", 0)), F.lit("…"))).otherwise(text)


def sanitised(text) -> Column:
    """Without control and direction characters, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{Cc}‪-‮⁦-⁩]", " "), r" +", " "))


def stripped_html(html) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]{0,2000}>", " "), r"\s+", " "))


def unescaped(text) -> Column:
    """Character references decoded once: numbers, and the names of HTML 4 with their semicolon. A number that is no
    character stays as it stands."""
    text = F.col(text) if isinstance(text, str) else text
    names = F.from_json(F.lit(json.dumps({n: chr(c) for n, c in name2codepoint.items() if n != "amp"} | {"apos": "'"})), "map<string,string>")
    refs = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    digits = lambda r: F.regexp_extract(r, "([0-9A-Fa-f]+);", 1)
    code = lambda r: F.when(F.substring(r, 3, 1).isin("x", "X"), F.conv(digits(r), 16, 10)).otherwise(digits(r)).cast("long")
    sound = lambda c: c.between(1, 0x10FFFF) & ~c.between(0xD800, 0xDFFF) & (c != 38)
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    put = lambda acc, r: F.replace(acc, r, F.when(sound(code(r)), char(F.when(sound(code(r)), code(r)).otherwise(F.lit(32)))).otherwise(r))
    named = lambda acc, r: F.replace(acc, r, F.coalesce(F.element_at(names, F.substring(r, F.lit(2), F.length(r) - 2)), r))
    # Ampersands come last, so that what one of them begins is not decoded again.
    numbered = F.aggregate(refs("&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"), text, put)
    spelled = F.aggregate(refs("&[A-Za-z][A-Za-z0-9]*;"), numbered, named)
    return F.regexp_replace(spelled, "&amp;|&#0*38;|&#[xX]0*26;", "&")


def same_actor(a, b) -> Column:
    """Equal tokens, or one that begins the other with four characters or more."""
    short = F.least(F.length(a), F.length(b))
    return (a == b) | ((short >= 4) & (F.startswith(a, b) | F.startswith(b, a)))


def control_signal(text, place) -> Column:
    """What a report claims about who holds `place`; the pattern is built for each row from its place."""
    phrases = lambda xs: "|".join(x.replace(" ", r"\s+") for x in xs)
    name = F.regexp_replace(F.trim(place), r"([^\p{L}\p{Nd}\s])", r"\\$1")
    starts, ends = r"(?iU)(?<!\w)", r"(?!\w)"
    leaves = F.concat(F.lit(f"{starts}(?:{phrases(WITHDRAWAL)}){FILLER}\\s+"), name, F.lit(ends))
    takes = F.concat(F.lit(f"{starts}(?:{phrases(GAIN)}){FILLER}\\s+"), name, F.lit(ends))
    falls = F.concat(F.lit(starts), name, F.lit(rf"\s+(?:{phrases(GAINED)}){ends}"))
    return (
        F.when(F.trim(F.coalesce(place, F.lit(""))) == "", "None")
        .when(F.rlike(text, leaves), "WithdrawalReported")
        .when(F.rlike(text, takes) | F.rlike(text, falls), "TerritoryTransferred")
        .otherwise("None")
    )


def control_claim(text, place, actors) -> Column:
    """The signal and its actor, as a struct: a claim counts only if the report names exactly one actor. `actors` are the
    names of its organisations, states and military units."""
    signal = control_signal(text, place)
    distinct = F.array_distinct(F.transform(F.coalesce(actors, F.array().cast("array<string>")), F.lower))
    one = (signal != "None") & (F.size(distinct) == 1)
    return F.struct(F.when(one, signal).otherwise("None").alias("signal"), F.when(one, F.get(actors, F.lit(0))).alias("actor"))


def byte_size(n) -> Column:
    """A number of bytes as people read it."""
    units = ("B", "KB", "MB", "GB", "TB")
    step = F.least(F.lit(len(units) - 1), F.floor(F.log(1024.0, F.greatest(n, F.lit(1)).cast("double")))).cast("int")
    value = n / F.pow(F.lit(1024.0), step)
    return F.when(step == 0, F.concat_ws(" ", n.cast("long").cast("string"), F.lit("B"))).otherwise(F.concat_ws(" ", F.format_number(value, 1), F.get(F.array(*[F.lit(u) for u in units]), step)))


def composed(text: Column) -> Column:
    """NFC, so that equal texts have equal characters."""

    @F.pandas_udf(StringType())
    def compose(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return compose(text)


def elements(text: Column) -> Column:
    """How many characters a reader sees: a letter with its marks, or a joined emoji, is one."""
    return F.regexp_count(text, F.lit(r"\X"))


def folded(text: Column) -> Column:
    """NFKC and lower case, which no built-in function gives; batches of texts at once."""

    @F.pandas_udf(StringType())
    def fold(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())

    return fold(text)


def first_sentence(text) -> Column:
    """Up to and including the first full stop, exclamation or question mark after the first character."""
    found = F.regexp_extract(F.trim(text), r"(?s)^(.[^.!?]*[.!?])", 1)
    return F.when(found == "", F.trim(text)).otherwise(found)


def language_tag_ok(tag) -> Column:
    return tag.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$")


def sha256_ok(text) -> Column:
    return text.rlike(r"^sha256:[0-9a-f]{64}$")


def private_address(ip) -> Column:
    """Whether an IPv4 address lies in a range that must not be fetched from."""
    part = F.split(ip, r"\.")
    a, b = F.get(part, 0).cast("int"), F.get(part, 1).cast("int")
    return a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
