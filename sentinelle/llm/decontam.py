"""Benchmark decontamination with a positional inverted index.

`build_index` cuts the training texts into shards of whole documents and stores, for each shard, the posting list
of every term: the positions, in order, at which the shard has it. Shards are made where their documents are read
and searched where they are stored, so no term, however frequent, gathers in one task. A search takes each phrase's
rarest term in the shard, turns its list into candidate starts (position less offset), and intersects them with the
offset-adjusted lists of the other terms, from rare to frequent; what is left are the exact matches. Proximity
matches come from the same lists: windows of a given width that hold all terms of a phrase in any order.

Test items are taken in blocks of at most `BLOCK_WORDS` words, each broadcast on its own; the number of blocks
follows the test set, not the corpus.

Defined cases: a null or wordless document is indexed with no words; a null or wordless item has no windows; items
that share an id count once; documents that share an id are separate; repeated rows are judged one by one. A very long
document is a shard of its own, a very long item several segments. Empty documents give empty results, an empty test
set no hits. Items of one document are sorted by id, so there are no ties. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinelle.llm import storage, words

WINDOW = 13
#: Bytes of text in a shard (a longer document is a shard of its own), words of a block, and candidate starts at once.
SHARD, BLOCK_WORDS, STARTS = 8 << 20, 500_000, 1 << 21

INDEX = "shard string, doc_ids array<long>, doc_words array<long>, terms binary, term_ends binary, list_ends binary, positions binary"
MATCHES = "shard string, doc long, doc_id long, item_id string, start long, stop long"


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of `docs`: one row for each shard, its posting lists as columns of packed integers."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in words.pieces(batches, text, SHARD):
            counts, found = words.cut(*words.utf8(batch.column(text)), words.LETTERS, lower=True)
            which, terms = words.distinct(found)
            order = np.argsort(which, kind="stable").astype(np.int32)
            data, off = words.utf8(terms)
            row = {
                "shard": uuid.uuid4().hex,
                "doc_ids": batch.column(doc_id).to_pylist(),
                "doc_words": counts.tolist(),
                "terms": data.tobytes(),
                "term_ends": off[1:].astype("<i4").tobytes(),
                "list_ends": np.cumsum(np.bincount(which, minlength=len(terms))).astype("<i4").tobytes(),
                "positions": order.tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    return storage.written(storage.mapped(docs.select(F.col(doc_id).cast("long").alias(doc_id), text), shards, INDEX), "postings", wide=True)


SCHEMA = pa.schema(
    [("shard", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int64()))]
    + [(x, pa.binary()) for x in ("terms", "term_ends", "list_ends", "positions")]
)


class Shard:
    """One shard's documents and posting lists."""

    def __init__(self, row: dict):
        self.name, self.doc_ids = row["shard"], row["doc_ids"]
        self.doc_at = np.concatenate(([0], np.cumsum(np.asarray(row["doc_words"], np.int64))))
        ends = np.frombuffer(row["term_ends"], "<i4")
        self.terms = words.binary(np.frombuffer(row["terms"], np.uint8), np.concatenate(([0], ends)))
        self.list_at = np.concatenate(([0], np.frombuffer(row["list_ends"], "<i4"))).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], "<i4")
        # Lists follow each other in term order, so (term, position) is one ascending key.
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64) << 32, np.diff(self.list_at)) | self.positions

    def numbers(self, vocabulary: pa.Array) -> np.ndarray:
        """The shard's number of each term of `vocabulary`, -1 if it has none."""
        return pc.fill_null(pc.index_in(vocabulary, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 32) | position
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return (position >= 0) & (self.keys[at] == key)

    def same_doc(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether positions first and last exist and lie in one document."""
        doc = np.searchsorted(self.doc_at, first, "right")
        return (first >= 0) & (last < self.doc_at[-1]) & (np.searchsorted(self.doc_at, last, "right") == doc)

    def starts(self, lists: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, position - offset) for every posting of each phrase's list, a bounded number at a time."""
        ends = np.cumsum(sizes)
        at = 0
        while at < len(lists):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STARTS, "right")))
            n = sizes[at:stop]
            phrase = np.repeat(np.arange(at, stop), n)
            within = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
            yield phrase, self.positions[self.list_at[lists[phrase]] + within].astype(np.int64) - offsets[phrase]
            at = stop

    def phrases(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of `grams`, start) of every exact occurrence; `grams` holds the shard's term numbers, row by row."""
        rows = np.flatnonzero((grams >= 0).all(axis=1))
        grams = grams[rows]
        size = (self.list_at[1:] - self.list_at[:-1])[grams] if len(rows) else np.zeros(grams.shape, np.int64)
        rarest = np.argsort(size, axis=1, kind="stable")
        pick = np.arange(len(rows))
        out_row, out_start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(rows):
            first = rarest[:, 0]
            for phrase, start in self.starts(grams[pick, first], size[pick, first], first):
                ok = self.same_doc(start, start + grams.shape[1] - 1)
                phrase, start = phrase[ok], start[ok]
                for r in range(1, grams.shape[1]):
                    offset = rarest[phrase, r]
                    ok = self.has(grams[phrase, offset], start + offset)
                    phrase, start = phrase[ok], start[ok]
                out_row.append(rows[phrase])
                out_start.append(start)
        return np.concatenate(out_row), np.concatenate(out_start)

    def near(self, terms: np.ndarray, width: int) -> np.ndarray:
        """Starts of windows of `width` words, within a document, that hold every one of `terms` and begin with one."""
        terms = np.unique(terms)
        if not len(terms) or (terms < 0).any():
            return np.zeros(0, np.int64)
        lists = sorted((self.positions[self.list_at[t] : self.list_at[t + 1]].astype(np.int64) for t in terms), key=len)
        step = max(1, STARTS // width)
        found = [self._near(lists, lists[0][k : k + step], width) for k in range(0, len(lists[0]), step)]
        return np.unique(np.concatenate(found))

    def _near(self, lists: list[np.ndarray], rarest: np.ndarray, width: int) -> np.ndarray:
        """The starts whose window has one of the positions `rarest`."""
        start = np.unique(rarest[:, None] - np.arange(width))
        ok = np.zeros(len(start), bool)
        last = np.zeros(len(start), np.int64)
        for one in lists:
            at = np.searchsorted(one, start)
            hit = one[np.minimum(at, len(one) - 1)]
            hit = np.where((at < len(one)) & (hit < start + width), hit, np.iinfo(np.int64).max)
            last = np.maximum(last, hit)
            ok |= hit == start
        ok &= last < np.iinfo(np.int64).max
        start, last = start[ok], last[ok]
        return start[self.same_doc(start, last)]


def blocks(items: DataFrame, item_id: str, text: str, window: int) -> Iterator[tuple[pa.Array, dict[int, tuple[np.ndarray, np.ndarray]], list[str]]]:
    """The test set block by block: its vocabulary, for each phrase length (phrases, their items), and the items' ids.

    Items are cut into overlapping segments of bounded length, and equal segments of an item are one, so that no item
    exceeds a block. Segments are dealt into buckets by hash; buckets are put together up to BLOCK_WORDS words,
    where 16 bytes count as much as a word: long words make short blocks.
    """
    step = 2048

    def segments(batches):
        for batch in words.pieces(batches, text, 1 << 20):
            counts, found = words.cut(*words.utf8(batch.column(text)), words.LETTERS, lower=True)
            at = np.concatenate(([0], np.cumsum(counts)))
            out = []
            for k, item in enumerate(batch.column(item_id).to_pylist()):
                for lo in range(at[k], max(at[k + 1] - window + 1, at[k] + 1), step):
                    if counts[k] and item is not None:
                        seg = found.slice(lo, min(step + window - 1, at[k + 1] - lo))
                        out.append({"item": item, "words": seg.to_pylist(), "n": len(seg), "cost": len(seg) + seg.nbytes // 16})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item", pa.string()), ("words", pa.list_(pa.binary())), ("n", pa.int64()), ("cost", pa.int64())]))

    segmented = storage.mapped(items.select(F.col(item_id).cast("string").alias(item_id), text), segments, "item string, words array<binary>, n long, cost long")
    cut = storage.written(segmented.distinct(), "segments")
    total = cut.agg(F.sum("cost")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("item", "words"), F.lit(max(1, 8 * total // BLOCK_WORDS)))
    dealt: list[list[int]] = []
    room = 0
    for r in cut.groupBy(bucket.alias("k")).agg(F.sum("cost").alias("n")).orderBy("k").collect():
        if r.n > room:
            dealt.append([])
            room = BLOCK_WORDS
        dealt[-1].append(r.k)
        room -= r.n
    for mine in dealt:
        rows = cut.where(bucket.isin(mine)).collect()
        which, vocabulary = words.distinct(pa.array([w for r in rows for w in r.words], pa.binary()))
        names = sorted({r.item for r in rows})
        number = {x: i for i, x in enumerate(names)}
        by: dict[int, list] = {}
        at = 0
        for r in rows:
            k = min(window, r.n)
            grams = np.lib.stride_tricks.sliding_window_view(which[at : at + r.n], k).astype(np.int64)
            by.setdefault(k, []).append((grams, np.full(len(grams), number[r.item])))
            at += r.n
        yield vocabulary, {k: (np.concatenate([g for g, _ in x]), np.concatenate([i for _, i in x])) for k, x in by.items()}, names


def merged(doc: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Occurrences of one item in one document that touch or overlap, as one stretch."""
    order = np.lexsort((start, item, doc))
    doc, item, start, stop = doc[order], item[order], start[order], stop[order]
    if not len(doc):
        return doc, item, start, stop
    new = np.ones(len(doc), bool)
    # All matches of a length have the same width, so within an item stops ascend with starts.
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > stop[:-1])
    first = np.flatnonzero(new)
    return doc[first], item[first], start[first], stop[np.concatenate((first[1:], [len(doc)])) - 1]


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Where windows of the items occur: shard, document (its place in the shard, its id), item, words [start, stop).

    A window is `window` consecutive words of an item (all of a shorter one). With `slop`, proximity matches
    instead: stretches of `window` + `slop` words that hold all words of a window in any order.
    """
    spark = index.sparkSession
    found = None
    for block in blocks(items, item_id, text, window):
        shared = spark.sparkContext.broadcast((block[0].to_pylist(), block[1], block[2]))

        def run(batches, shared=shared):
            vocabulary, by, names = shared.value
            vocabulary, names = pa.array(vocabulary, pa.binary()), pa.array(names, pa.string())
            for batch in batches:
                for at in range(batch.num_rows):
                    shard = Shard(batch.slice(at, 1).to_pylist()[0])
                    number = shard.numbers(vocabulary)
                    for k, (grams, item) in by.items():
                        if slop is None:
                            which, start = shard.phrases(number[grams])
                            stop = start + k
                        else:
                            each = [shard.near(g, k + slop) for g in number[grams]]
                            which, start = np.repeat(np.arange(len(grams)), [len(x) for x in each]), np.concatenate(each)
                            stop = np.minimum(start + k + slop, shard.doc_at[np.searchsorted(shard.doc_at, start, "right")])
                        doc = np.searchsorted(shard.doc_at, start, "right") - 1
                        doc, who, start, stop = merged(doc, item[which], start, stop)
                        base = shard.doc_at[doc]
                        columns = [pa.array([shard.name] * len(doc), pa.string()), pa.array(doc, pa.int64()), pa.array([shard.doc_ids[d] for d in doc], pa.int64())]
                        columns += [pc.take(names, pa.array(who, pa.int64())), pa.array(start - base, pa.int64()), pa.array(stop - base, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc", "doc_id", "item_id", "start", "stop"])

        part = storage.mapped(index, run, MATCHES)
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], MATCHES)


def judged(index: DataFrame, matches: DataFrame, share: int = 20) -> DataFrame:
    """One row for each indexed document: n_words, n_hit, item_ids (sorted strings) and contaminated.

    n_hit counts words inside any match; a document is contaminated once they are at least 1/`share` of its words.
    Documents and matches meet in one aggregation, keyed by shard and place, where nothing is larger than a document.
    """
    docs = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("doc", "d")).select(
        "shard", F.col("doc").cast("long").alias("doc"), F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_words").alias("n_words"), F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("struct<start:long,stop:long>").alias("hit")
    )
    hits = matches.select("shard", "doc", "doc_id", F.lit(0).cast("long").alias("n_words"), "item_id", F.struct("start", "stop").alias("hit"))
    whole = docs.unionByName(hits).groupBy("shard", "doc").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sort_array(F.collect_set("hit")).alias("hits")
    )
    n_hit = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, h: F.struct((a.n + F.greatest(F.lit(0), h.stop - F.greatest(h.start, a.end))).alias("n"), F.greatest(a.end, h.stop).alias("end")),
        lambda a: a.n,
    )
    out = whole.select("doc_id", "n_words", n_hit.alias("n_hit"), "item_ids")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
