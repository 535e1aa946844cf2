from collections import Counter

import pytest

from sentinelle.llm import licences

SCHEMA = "doc_id long, text string, source string"


SOME = licences.TEMPLATES[:20]


def slow(text, templates=SOME):
    """The greatest coefficient of any stretch with any template, without bounds."""
    ws = licences.normal(text or "")
    grams, best = list(zip(ws[:-1], ws[1:])), None
    for name, template in templates:
        said = licences.normal(template)
        want = Counter(zip(said[:-1], said[1:]))
        for i in range(len(grams)):
            have, common = Counter(), 0
            for j in range(i, min(len(grams), i + 2 * want.total())):
                have[grams[j]] += 1
                common += have[grams[j]] <= want[grams[j]]
                dice = 2 * common / (want.total() + j - i + 1)
                if dice >= licences.ALIKE and (best is None or dice > best[1]):
                    best = (name, dice)
    return best or (None, None)


def texts():
    whole = [t for _, t in SOME]
    edited = [t.replace("software", "program", 1).replace("granted", "given") for t in whole]
    inside = ["Copyright (c) 2001 Somebody. All rights reserved. And more words here.", "This module is\nLicensed under the Apache\nLicense, Version 2.0. See below."]
    return [None, "", "word", "\n\n", *whole, *edited, *inside, "x\n" + whole[3], "some words\n\n" + whole[-2].replace(". ", ".\n") + " after", "all rights " * 300, " ".join(whole[:9])]


def test_bounds_lose_nothing(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] * 2
    got = licences.scan(spark.createDataFrame(rows, SCHEMA), templates=SOME).collect()
    assert len(got) == len(rows)
    for r in got:
        name, dice = slow(r.text)
        assert r.licence == name, r.text
        assert r.dice == (None if dice is None else pytest.approx(dice))


def test_all_licences_are_found_with_their_words(spark):
    mit = licences.TEMPLATES[18][1]
    text = f"Some words. {mit} More words, Licensed under CC BY 4.0. The end. All rights reserved."
    r = licences.scan(spark.createDataFrame([(1, text, "x")], SCHEMA)).first()
    ws = licences.normal(text)
    assert [(x.licence, round(x.dice, 6)) for x in r.licences] == [("CC-BY-4.0", 1.0), ("All-rights-reserved", 1.0), ("MIT", 1.0)]
    assert [ws[x.start : x.stop] for x in r.licences] == [licences.normal("Licensed under CC BY 4.0"), licences.normal("All rights reserved"), licences.normal(mit)]


def test_a_very_long_text(spark):
    text = "all rights " * 200_000 + "all rights reserved"
    r = licences.scan(spark.createDataFrame([(1, text, "x")], SCHEMA)).first()
    assert (r.licence, r.dice) == ("All-rights-reserved", 1.0)


def test_clashing_names_and_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA + ", licence string, dice string")
    assert licences.scan(frame, licence="found", dice="how").columns[-3:] == ["found", "how", "licences"]
    assert licences.scan(frame, licence="found", dice="how").count() == 0
    assert licences.scan(frame).columns.count("licence") == 1
