import random
import re

from sentinelle.llm import decontam

DOCS, ITEMS = "doc_id long, text string, start string", "item_id long, text string"


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for i, text, *_ in docs:
        ws, hit, seen = cut(text), set(), set()
        for item, q in items:
            qs = cut(q)
            k = min(window, len(qs))
            grams = {tuple(qs[j : j + k]) for j in range(len(qs) - k + 1)} if k else set()
            for j in range(len(ws) - k + 1):
                if k and tuple(ws[j : j + k]) in grams:
                    hit |= set(range(j, j + k))
                    seen.add(str(item))
        out.append((i, len(ws), len(hit), sorted(seen), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


def check(spark, docs, items, window=4):
    index = decontam.build_index(spark.createDataFrame(docs, DOCS))
    got = decontam.judged(index, decontam.search(index, spark.createDataFrame(items, ITEMS), window=window)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got), key=str) == brute(docs, items, window)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "STARTS", 7)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["a", "b", "C", "dé", "x9"]) + r.choice(["", ".", ","]) for _ in range(n))
    docs = [(i, text(r.randrange(0, 80)), "s") for i in range(60)] + [(7, None, None), (7, "", "s"), (8, "a a a a a a a", "s"), (8, "a a a a a a a", "s"), (9, text(6000), "s")]
    items = [(i, text(r.randrange(0, 12))) for i in range(20)] + [(50, None), (51, "?!"), (52, "a"), (3, "b b b b b")]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)


def test_items_longer_than_a_segment(spark):
    r = random.Random(4)
    long = " ".join(f"w{r.randrange(3000)}" for _ in range(5000))
    check(spark, [(1, "x " + long[900:1200] + " y", "s"), (2, long, "s")], [(1, long)], window=13)


def test_proximity(spark):
    index = decontam.build_index(spark.createDataFrame([(1, "one x two y three", ""), (2, "three two z z z z z one", ""), (3, "three one two", "")], DOCS))
    got = decontam.search(index, spark.createDataFrame([(1, "one two three")], ITEMS), window=3, slop=2).collect()
    assert sorted((r.doc_id, r.start, r.stop) for r in got) == [(1, 0, 5), (3, 0, 3)]


def test_long_words_make_short_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 500)
    items = spark.createDataFrame([(i, " ".join(f"{'x' * 3000}{i}{k}" for k in range(5))) for i in range(12)], ITEMS)
    assert len(list(decontam.blocks(items, "item_id", "text", 4))) > 6
    check(spark, [(1, items.first().text, "s"), (2, "short", "s")], [tuple(r) for r in items.collect()])


def test_shards_are_stored_one_by_one(spark, monkeypatch):
    """No page, row group or file of the index holds a task's shards, and no footer their values."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(decontam, "SHARD", 200)
    docs = [(i, f"word{i} " * 30, "s") for i in range(60)]
    index = decontam.build_index(spark.createDataFrame(docs, DOCS).coalesce(1))
    stored = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    assert sum(m.num_rows for m in stored) == 60 and max(m.num_rows for m in stored) == 8
    assert all(m.num_row_groups == m.num_rows and not m.row_group(0).column(k).is_stats_set for m in stored for k in range(m.num_columns))
    check(spark, docs, [(1, "word3 word3 word3 word3"), (2, "word3 word4")])
