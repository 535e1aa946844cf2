"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banded and verified.

A document is the multiset of its five-word shingles. Each shingle carries, for every stretch of the weight axis
[0,1), [1,2), [2,4), [4,8) ..., a Poisson process in time whose rate is the stretch's length, seeded by the shingle
and the stretch alone. A point falls on one component of the signature and one weight level; it counts for a
document whose weight is above that level. A component keeps its earliest point, so two documents agree on it with
the probability of their weighted Jaccard similarity. A process stops once it is later than every component.

Documents whose words are the same, in order, are one text. Texts that share a band meet in its bucket, and classes
are the connected components of the promising pairs that hold on the full multisets. They are found in two passes.
The first only saves work: a bucket is read block by block, with leaders of earlier blocks kept beside the current
one (above `HOT` texts, by pairs of bands), and spanning forests of the most alike are verified. The second is whole:
wherever texts of a bucket are still in different components, every block meets every other, each cell of two blocks
a task's group, and every promising pair is verified there unless verified links join its ends already. A text of
the bucket's largest component meets only those outside it. No bucket, class or fingerprint list comes to the driver.

Defined cases: a document without words (null, blank) is a class of its own; fewer than five words are one shingle;
rows are never merged, each comes back with its class; a null id comes after all others, and texts under null ids are
linked like any; different texts under one id are different classes with one class_id, told apart by class_print;
of equal ids the least print names the class. A very long text is one multiset, held by the task that reads it. Empty
tables give empty results. Extra columns are ignored here, and kept by `first_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinelle.llm import storage, words

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: Bytes of text at once; texts compared at once in a bucket; leaders kept; forests of a block; texts of a hot bucket.
STEP, BLOCK, LEADERS, FORESTS, HOT = 4 << 20, 256, 64, 2, 2048
#: Shingles of a block of the second pass; the estimate above which a pair is promising (it is off by 0.036 at 0.8).
SHARE, PROMISING = 1 << 19, 0.66
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray]:
    """For a batch: words of each text, its fingerprint (None: no words), and (text, shingle) of every shingle."""
    import xxhash

    counts, found = words.cut(*words.utf8(texts), words.LETTERS, lower=True)
    which, terms = words.distinct(found)
    hashed = np.array([xxhash.xxh3_64_intdigest(t) for t in terms.to_pylist()], np.uint64)[which] if len(terms) else np.zeros(0, np.uint64)
    at = np.concatenate(([0], np.cumsum(counts)))
    prints = [xxhash.xxh3_128_hexdigest(hashed[a:b].tobytes()) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), n)
    start = at[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(counts[text], SHINGLE)
    value = np.zeros(len(text), np.uint64)
    padded = np.concatenate((hashed, np.zeros(SHINGLE, np.uint64)))
    for k in range(SHINGLE):
        value = mix(value * _MULT + np.where(k < length, padded[start + k], np.uint64(k + 1)))
    return counts, prints, text, value


def weighted(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multisets: (text, shingle, how often)."""
    _, first, times = np.unique(mix(value + mix(text.astype(np.uint64) * _MULT)), return_index=True, return_counts=True)
    return text[first], value[first], times


def signatures(n: int, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """SIZE times for each of n multisets: the earliest point of every component."""
    h = np.full((n, SIZE), np.inf)
    reach = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1  # stretches below the weight
    item = np.repeat(np.arange(len(text)), reach)
    stretch = np.arange(len(item)) - np.repeat(np.cumsum(reach) - reach, reach)
    doc, w = text[item], weight[item]
    low = np.where(stretch == 0, 0, 1 << np.maximum(stretch - 1, 0))
    span = np.where(stretch == 0, 1, low)
    state = mix(shingle[item] + (stretch.astype(np.uint64) + np.uint64(1)) * _MULT)
    time = np.zeros(len(item))
    while len(doc):
        state = state + _MULT
        r = mix(state)
        time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / span
        late = h.max(axis=1)[doc]
        on = time <= late
        doc, w, low, span, state, time, r = doc[on], w[on], low[on], span[on], state[on], time[on], r[on]
        s = mix(r ^ np.uint64(0xD6E8FEB86659FD93))
        level = low + ((s >> np.uint64(32)).astype(np.int64) * span >> 32)
        good = level < w
        component = (s & np.uint64(0xFFFFFFFF)).astype(np.int64) * SIZE >> 32
        np.minimum.at(h.reshape(-1), doc[good] * SIZE + component[good], time[good])
    return h


def bands(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of signatures, and one byte for each component to estimate similarity by."""
    bits = mix(h.view(np.uint64))
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(h), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key * _MULT + bits[:, k::ROWS])
    return key.view(np.int64), (bits >> np.uint64(56)).astype(np.uint8)


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (a key that finds the row again), print (null: no words), n (shingles), bands, sig for every row."""

    def run(batches):
        for batch in words.pieces(batches, "text", STEP):
            counts, prints, doc, value = shingles(batch.column("text"))
            key, sig = bands(signatures(len(counts), *weighted(doc, value)))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * BANDS, pa.int32()), pa.array(key.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(prints, pa.string()), pa.array(np.bincount(doc, minlength=len(counts)), pa.int64()), keys, pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["doc_id", "row", "print", "n", "bands", "sig"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    return storage.mapped(rows, run, "doc_id long, row long, print string, n long, bands array<long>, sig binary")


def row_key(doc_id: str, text: str) -> Column:
    """Never null; rows that share it by chance are told apart by their prints."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def block_pairs(sig: np.ndarray, n_old: int) -> tuple[np.ndarray, np.ndarray]:
    """Promising pairs among signatures, of which the first n_old have met before.

    FORESTS spanning forests of greatest estimates leave the block; pairs left out wait for `rest`.
    """
    n = len(sig)
    alike = np.zeros((n, n))
    for a in range(0, n, 32):
        alike[a : a + 32] = (sig[a : a + 32, None] == sig[None]).mean(axis=2)
    alike[:n_old, :n_old] = 0
    i, j = np.nonzero(np.triu(alike, 1) >= PROMISING)
    order = np.argsort(-alike[i, j], kind="stable")
    left = list(zip(i[order].tolist(), j[order].tolist(), strict=True))
    take = []
    for _ in range(FORESTS):
        root, rest = list(range(n)), []
        for x, y in left:
            a, b = x, y
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a == b:
                rest.append((x, y))
            else:
                root[a] = b
                take.append((x, y))
        left = rest
    a, b = np.array(take, np.int64).reshape(-1, 2).T
    return a, b


def buckets(texts: DataFrame) -> DataFrame:
    """(key, print, band, n) of the texts of every bucket of more than one; both passes read them, and most bands share nothing."""
    keys = texts.select("print", F.posexplode("bands").alias("band", "key"))
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def candidates(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of prints to verify first, not all; `texts` has print, bands and sig, one row a print."""
    hot = members.where(F.col("n") > HOT).select("print", "band").join(texts.select("print", "bands"), "print")
    # A hot bucket's texts meet by pairs of bands instead, each with the three that follow.
    pairs = hot.select("print", F.explode(F.transform(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: F.xxhash64(F.get("bands", F.col("band")), F.get("bands", (F.col("band") + k) % BANDS), k))).alias("key"))
    small = members.where(F.col("n") <= HOT).select("print", "key")
    rows = small.unionByName(pairs).join(texts.select("print", "sig"), "print").repartition("key").sortWithinPartitions("key", "sig", "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prints, sig, old = None, [], [], 0

        def flush():
            a, b = block_pairs(np.array(sig), old)
            lo = [min(prints[i], prints[j]) for i, j in zip(a, b, strict=True)]
            hi = [max(prints[i], prints[j]) for i, j in zip(a, b, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(lo, pa.string()), pa.array(hi, pa.string())], names=["a", "b"])

        for batch in batches:
            for k, p, s in zip(batch.column("key").to_pylist(), batch.column("print").to_pylist(), batch.column("sig").to_pylist(), strict=True):
                if k != key or len(prints) == BLOCK:
                    if len(prints) > max(old, 1):
                        yield flush()
                    keep = np.linspace(0, len(prints) - 1, LEADERS).astype(int) if k == key else []
                    key, prints, sig = k, [prints[i] for i in keep], [sig[i] for i in keep]
                    old = len(prints)
                prints.append(p)
                sig.append(np.frombuffer(s, np.uint8))
        if len(prints) > max(old, 1):
            yield flush()

    return storage.mapped(rows.select("key", "print", "sig"), run, "a string, b string").distinct()


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return 0.0
    (x, nx), (y, ny) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    return both / (len(a) + len(b) - both)


def bags(prints: DataFrame, texts: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(print, bag): the sorted multisets of `prints`, read again from a row that shows each."""
    rows = texts.join(prints.distinct(), "print", "left_semi").select("row").distinct()
    shown = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text")).join(rows, "row", "left_semi").select("text")

    def run(batches):
        for batch in words.pieces(batches, "text", STEP):
            counts, found, doc, value = shingles(batch.column("text"))
            ends = np.searchsorted(doc, np.arange(len(counts) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([np.sort(value[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["print", "bag"])

    return storage.written(storage.mapped(shown, run, "print string, bag binary").dropDuplicates(["print"]), "bags")


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Those pairs (a, b) of prints whose multisets overlap by SIMILAR or more."""
    have = bags(pairs.select(F.col("a").alias("print")).union(pairs.select("b")), texts, docs, doc_id, text)

    def compare(batches):
        for batch in words.pieces(batches, "bag_a", STEP):
            good = [overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= SIMILAR for x, y in zip(batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(have.toDF("a", "bag_a"), "a").join(have.toDF("b", "bag_b"), "b")
    return storage.mapped(both.select("a", "b", "bag_a", "bag_b"), compare, "a string, b string")


def cells(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(key, band, lo, hi, side, print) of every text in every cell of its buckets; `texts` has a label.

    Buckets of one label have no cells. The largest label of a bucket and all others are cut into blocks by hash; a
    cell is a block of the others with itself (side 0), or with another block of either kind (sides 0 and 1).
    """
    keys = members.select("print", "band", "key").join(texts.select("print", "label", "n"), "print")
    labels = keys.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / SHARE)).cast("int")
    top = labels.groupBy("key").agg(F.max(F.struct("c", "s", "label")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("k")).where("k > 1")
    top = top.select("key", F.col("top.label").alias("largest"), blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("m"), blocks(F.col("top.c"), F.col("top.s")).alias("of_largest"))
    apart = F.col("label") != F.col("largest")
    members = keys.join(top, "key").withColumn("at", F.when(apart, F.pmod(F.xxhash64("print"), "m")).otherwise(F.col("m") + F.pmod(F.xxhash64("print"), "of_largest")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(apart, F.col("m") + F.col("of_largest")).otherwise(F.col("m")) - 1)))
    return members.select("key", "band", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), (F.col("at") > F.col("other")).cast("int").alias("side"), "print")


def cell_pairs(rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """Promising pairs of a cell, most alike first: labels that differ, and no band before this one in common, so that
    a pair is taken up in one bucket alone."""
    side, band = np.array(rows["side"]), rows["band"][0]
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(-1, SIZE)
    label = np.unique(np.array(rows["label"], object), return_inverse=True)[1]
    keys = np.array([k[:band] for k in rows["bands"]], np.int64).reshape(len(sig), band)
    within = rows["lo"][0] == rows["hi"][0]
    left, right = (np.arange(len(sig)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    found = []
    for k in range(0, len(left), 32):
        rows_at = left[k : k + 32]
        alike = np.count_nonzero(sig[rows_at, None] == sig[None, right], axis=2)
        x, y = np.nonzero((alike >= PROMISING * SIZE) & (label[rows_at, None] != label[None, right]))
        i, j, alike = rows_at[x], right[y], alike[x, y]
        if within:
            i, j, alike = i[i < j], j[i < j], alike[i < j]
        first = np.ones(len(i), bool)
        for b in range(band):
            first &= keys[i, b] != keys[j, b]
        found.append((i[first], j[first], alike[first]))
    i, j, alike = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.argsort(-alike, kind="stable")
    return i[order], j[order]


def cell_links(rows: dict[str, list]) -> list[tuple[int, int]]:
    """A spanning forest, over the labels, of the cell's promising pairs whose multisets overlap by SIMILAR or more."""
    bag = [np.frombuffer(b, np.uint64) for b in rows["bag"]]
    # As sets: the k-th time of a shingle is an element of its own.
    size = np.array([len(b) for b in bag])
    flat = np.concatenate(bag)
    starts = np.ones(len(flat), bool)
    starts[1:] = flat[1:] != flat[:-1]
    starts[(np.cumsum(size) - size)[size > 0]] = True
    nth = np.arange(len(flat)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
    element = np.unique(np.where(nth == 0, flat, mix(flat + nth.astype(np.uint64) * _MULT)), return_inverse=True)[1]
    element = np.split(element, np.cumsum(size)[:-1])
    mark = np.zeros(len(flat) + 1, bool)
    name = np.unique(np.array(rows["label"], object), return_inverse=True)[1]
    root = list(range(len(bag)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links, shown = [], -1
    for i, j in zip(*(x.tolist() for x in cell_pairs(rows)), strict=True):
        a, b = find(name[i]), find(name[j])
        if a == b or min(size[i], size[j]) < SIMILAR * max(size[i], size[j]):
            continue
        if i != shown:
            if shown >= 0:
                mark[element[shown]] = False
            mark[element[i]] = True
            shown = i
        both = int(np.count_nonzero(mark[element[j]]))
        if both >= SIMILAR * (size[i] + size[j] - both):
            root[a] = b
            links.append((i, j))
    return links


def by_cell(frame: DataFrame, work, schema: str) -> DataFrame:
    """`work` (from a cell's columns to a batch) over every cell of `frame`; cells are whole in their task."""
    names = frame.columns

    def run(batches):
        at, rows = None, {}
        for batch in batches:
            key = list(zip(*(batch.column(k).to_pylist() for k in ("key", "lo", "hi")), strict=True))
            columns = [batch.column(k).to_pylist() for k in names]
            begin = 0
            for end in range(1, len(key) + 1):
                if end < len(key) and key[end] == key[begin]:
                    continue
                if key[begin] != at:
                    if rows:
                        yield work(rows)
                    at, rows = key[begin], {k: [] for k in names}
                for k, column in zip(names, columns, strict=True):
                    rows[k] += column[begin:end]
                begin = end
        if rows:
            yield work(rows)

    return storage.mapped(frame.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", "print"), run, schema)


def rest(texts: DataFrame, buckets: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct links (a, b) between the labels of `texts`: they join all that promising, verified pairs join."""
    at = ["key", "band", "lo", "hi", "side", "print"]

    def promising(rows):
        met = np.unique(np.concatenate(cell_pairs(rows))).tolist()
        return pa.RecordBatch.from_pylist([{k: rows[k][m] for k in at} for m in met], schema=shape)

    def links(rows):
        found = cell_links(rows)
        return pa.RecordBatch.from_arrays([pa.array([pick(rows["label"][i], rows["label"][j]) for i, j in found], pa.string()) for pick in (min, max)], names=["a", "b"])

    shape = pa.schema([("key", pa.int64()), ("band", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("side", pa.int32()), ("print", pa.string())])
    known = texts.select("print", "label", "bands", "sig")
    met = storage.written(by_cell(cells(texts, buckets).join(known, "print"), promising, "key long, band int, lo int, hi int, side int, print string"), "met")
    have = bags(met.select("print"), texts, docs, doc_id, text)
    return by_cell(met.join(known, "print").join(have, "print"), links, "a string, b string").distinct()


def components(links: DataFrame) -> DataFrame:
    """(print, least): every linked print and the least print of its component, by least neighbours and pointer jumps."""
    edges = storage.written(links.union(links.select("b", "a")).toDF("v", "to"), "edges")
    state = storage.written(edges.groupBy("v").agg(F.least(F.min("to"), F.col("v")).alias("least")), "least")
    while True:
        near = edges.join(state.toDF("to", "l"), "to").groupBy("v").agg(F.min("l").alias("l"))
        step = state.join(near, "v").select("v", "least", F.least("least", "l").alias("next"))
        step = storage.written(step, "step")
        jump = step.select(F.col("v").alias("next"), F.col("next").alias("far"))
        after = storage.written(step.join(jump, "next").select("v", "least", F.least("next", "far").alias("far")), "least")
        if after.where("far != least").isEmpty():
            return after.select(F.col("v").alias("print"), "least")
        state = after.select("v", F.col("far").alias("least"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, print, and its class: class_id (the least doc_id) and class_print (the least
    print that shows it)."""
    rows = storage.written(sketch(docs, doc_id, text), "sketches")
    # Equal prints have equal sketches, so any row shows them.
    shown = [F.min_by(c, "row").alias(c) for c in ("n", "bands", "sig")]
    texts = storage.written(rows.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), *shown), "texts")
    ids = texts.select("print", "doc_id")
    members = storage.written(buckets(texts), "buckets")
    links = storage.written(verified(storage.written(candidates(texts, members), "pairs"), texts, docs, doc_id, text), "links")
    labelled = texts.join(components(links), "print", "left").withColumn("label", F.coalesce("least", "print")).drop("least", "doc_id")
    labelled = storage.written(labelled, "labelled")
    more = components(storage.written(rest(labelled, members, docs, doc_id, text), "rest")).toDF("label", "least")
    linked = labelled.select("print", "label").join(more, "label", "left").select("print", F.coalesce("least", "label").alias("least")).join(ids, "print")
    # A class is named by its least (doc_id, print), null ids last: two texts under one id stay two classes.
    heads = linked.groupBy("least").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("head"))
    linked = linked.join(heads, "least").select("print", F.struct("head.doc_id", "head.print").alias("head"))
    own = ids.join(linked, "print", "left").select("print", F.coalesce("head", F.struct("doc_id", "print")).alias("head"))
    found = rows.select("doc_id", "print").join(own, "print", "left").withColumn("head", F.coalesce("head", F.struct("doc_id", "print")))
    return found.select("doc_id", "print", F.col("head.doc_id").alias("class_id"), F.col("head.print").alias("class_print"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row for each class: the one with the least id and, of that id, the least print. Of rows with
    that id and the same words, the one stays whose text has the least SHA-256, then the one whose other columns, as
    JSON, have. Documents without words all stay."""
    found = classes(docs, doc_id, text)
    shown = storage.free(docs, "_print")
    stay = storage.written(found.where("class_print is not null").select(F.col("class_id").alias(f"{shown}_id"), F.col("class_print").alias(f"{shown}_head")).distinct(), "stay")
    schema = T.StructType([*docs.schema.fields, T.StructField(shown, T.StringType())])

    def run(batches):
        for batch in words.pieces(batches, text, STEP):
            prints = shingles(batch.column(text))[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], names=[f.name for f in schema.fields])

    marked = storage.mapped(docs, run, schema)
    blank = marked.where(F.col(shown).isNull())
    first = marked.join(stay, (F.col(shown) == F.col(f"{shown}_head")) & F.col(doc_id).cast("long").eqNullSafe(F.col(f"{shown}_id")), "left_semi")
    others = [c for c in docs.columns if c != text]
    order = F.struct(F.sha2(text, 256), F.sha2(F.to_json(F.struct(*others)), 256)) if others else F.sha2(text, 256)
    first = first.groupBy(shown).agg(F.min_by(F.struct(*docs.columns), order).alias(shown + "_row"))
    return first.select(shown + "_row.*").unionByName(blank.select(*docs.columns))
