"""Removal of repeated byte strings by suffix sorting.

A byte goes if some `LENGTH`-byte string that covers it starts anywhere else as well. Candidate search: in every
window of LENGTH bytes the `GRAM`-byte substring with the least hash is its anchor, so equal windows have equal
anchors at equal distances. Consecutive windows with one anchor form a stretch; the text under a stretch is its
context. Contexts with the same 128-bit cryptographic digest are one: their windows repeat. The distinct contexts
of anchors that have more than one are dealt out by anchor and suffix-sorted in bounded bins.

The sort is two-stage: suffixes smaller than their successors are sorted directly, by words of eight bytes; all
others are induced by scanning the 256 buckets in order, each suffix placing its predecessor in the bucket of its
first byte. Adjacent common prefixes then show which windows repeat. Equal windows agree on WING bytes before their anchor or after
it, so contexts that share neither with another one of their anchor are not sorted.

An anchor with more than `CROWD` contexts would overfill a bin. Its contexts are cut into pieces of `WIDTHS[0]`
windows at most, by distance from the anchor, and dealt out by the bytes that all windows of a piece's place share;
pieces then are collapsed, counted and sorted like contexts. Where one such core still has too many pieces, they are
cut into single windows, whose core is the window itself, so that no more than one is left of it.

Defined cases: null is the empty text; texts shorter than LENGTH keep all bytes; identical rows are copies of each
other and both lose what repeats; overlapping repeats inside one text count; matches never cross documents; long
texts are read in segments, so memory is bounded by a segment; empty tables give empty results; extra columns are
ignored. Where a text is copied whole stretches are, so most repeated windows of a corpus with many copies are found by
digest, and the suffix sort decides the others.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinelle.llm import skew, storage, words
from sentinelle.llm.bagmin import mix

LENGTH, GRAM = 200, 32
#: Window of grams in a string of LENGTH bytes.
REACH = LENGTH - GRAM + 1
#: Bytes of text handled at once, of a bin of contexts, and a bin's contexts of one anchor.
STEP, BIN, CROWD = 1 << 20, 4 << 20, 12_000
#: Windows of a piece of a crowded anchor's contexts, round by round.
WIDTHS = (16, 1)
_ODD = 0xD1342543DE82EF95
_INVERSE = pow(_ODD, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any substring of a text, by one prefix sum."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(_ODD, n), out=self.total[1:])
        self.back = powers(_INVERSE, n + 1)

    def of(self, start, stop) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * self.back[start])


def units(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, where documents begin in them, their numbers, their offsets) with at most STEP bytes or so at once.

    A long document comes in segments that overlap by LENGTH - 1 bytes, so that each window is in exactly one.
    """
    at = 0
    while at < len(off) - 1:
        if off[at + 1] - off[at] > STEP:
            for lo in range(int(off[at]), int(off[at + 1]) - LENGTH + 1, STEP):
                hi = min(lo + STEP + LENGTH - 1, int(off[at + 1]))
                yield data[lo:hi], np.array([0, hi - lo]), np.array([at]), np.array([lo - off[at]])
            at += 1
            continue
        stop = max(at + 1, int(np.searchsorted(off, off[at] + STEP, "right")) - 1)
        yield data[off[at] : off[stop]], off[at : stop + 1] - off[at], np.arange(at, stop), np.zeros(stop - at, np.int64)
        at = stop


def stretches(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window in it, first window, windows, distance of the anchor, anchor hash) of every stretch."""
    n = len(text)
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 5 + (np.zeros(0, np.uint64),)
    roll = Rolling(text)
    grams = np.arange(n - GRAM + 1)
    low = np.uint64((1 << 24) - 1)
    least = (roll.of(grams, grams + GRAM) & ~low) | grams.astype(np.uint64)
    width = 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    start = np.arange(len(least))
    start = start[(start + LENGTH) <= at[doc[: len(least)] + 1]]
    anchor = (least[start] & low).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    lo, anchor = start[first], anchor[first]
    return doc[lo], lo - at[doc[lo]], lo, count, anchor - lo, roll.of(anchor, anchor + GRAM)


def digests(contexts: list[bytes] | list[memoryview], distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a digest of each context and its anchor's distance."""
    both = np.frombuffer(b"".join(hashlib.blake2b(c, digest_size=16).digest() for c in contexts), np.uint64).reshape(-1, 2)
    return (both[:, 0] ^ mix(distance.astype(np.uint64))).view(np.int64), both[:, 1].view(np.int64)


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; beyond the end are zeros."""
    n = len(text)
    padded = np.zeros(n + LENGTH + 16, np.uint8)
    padded[:n] = text
    out = np.zeros(n + LENGTH + 8, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def sort_directly(word: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """`suffix` sorted by the LENGTH bytes from each on, eight bytes at a time; only ties go on."""
    suffix = suffix[np.argsort(word[suffix], kind="stable")]
    key = word[suffix]
    new = np.ones(len(suffix), bool)
    new[1:] = key[1:] != key[:-1]
    tied = np.flatnonzero(~(new & np.append(new[1:], True))) if len(suffix) else np.zeros(0, np.int64)
    group = np.cumsum(new)[tied]
    for depth in range(8, LENGTH, 8):
        if not len(tied):
            break
        key = word[suffix[tied] + depth]
        order = np.lexsort((key, group))
        suffix[tied] = suffix[tied][order]
        key, group = key[order], group[order]
        new = np.ones(len(tied), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        single = new & np.append(new[1:], True)
        group = np.cumsum(new)[~single]
        tied = tied[~single]
    return suffix


def suffix_array(text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """All suffixes in order of their first LENGTH bytes, by two-stage sorting."""
    n = len(text)
    step = np.full(n, -1, np.int8)
    step[:-1] = np.sign(np.diff(text.astype(np.int16)))
    there = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]
    smaller = step[there] > 0  # than its successor
    direct = sort_directly(word, np.flatnonzero(smaller))
    edges = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    done = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(level):  # runs of one byte follow their own ends
            bucket.append(level)
            level = level[level > 0] - 1
            level = level[text[level] == c]
        bucket.append(direct[edges[c] : edges[c + 1]])
        bucket = np.concatenate(bucket)
        if not len(bucket):
            continue
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        for part in np.split(before, np.flatnonzero(np.diff(byte)) + 1):
            if len(part):
                waiting[text[part[0]]].append(part)
    return np.concatenate(done)


def common_prefixes(word: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it (0 for the first), LENGTH at most."""
    out = np.zeros(len(suffix), np.int64)
    alive = np.arange(1, len(suffix))
    for depth in range(0, LENGTH, 8):
        differ = word[suffix[alive] + depth] ^ word[suffix[alive - 1] + depth]
        same = differ == 0
        equal = np.zeros((~same).sum(), np.int64)
        for k in range(1, 8):
            equal += (differ[~same] >> np.uint64(64 - 8 * k)) == 0
        out[alive[~same]] = depth + equal
        alive = alive[same]
    out[alive] = LENGTH
    return np.minimum(out, LENGTH)


def repeated(contexts: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each context, which of its first `count` windows stand in another place among the contexts."""
    sizes = np.array([len(c) + 1 for c in contexts])
    text = np.frombuffer(b"".join(c + b"\xff" for c in contexts), np.uint8)  # no UTF-8 text has this byte
    base = np.cumsum(sizes) - sizes
    counts = np.array(counts)
    inside = np.zeros(len(text), bool)
    window = np.repeat(base, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    inside[window] = True
    word = eights(text)
    order = suffix_array(text, word)
    order = order[inside[order]]
    full = common_prefixes(word, order) >= LENGTH
    hit = np.zeros(len(text), bool)
    hit[order[full | np.append(full[1:], False)]] = True
    return [hit[b : b + c] for b, c in zip(base, counts, strict=True)]


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


KEYED = "d long, h long"


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents with a key that leads from windows back to texts: the id and a hash of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("d"), F.xxhash64(t).alias("h"), F.col(doc_id).alias("doc_id"), t.alias("text"))


PLACE = ["d", "h", "lo", "n", "at"]
CONTEXT = ["key", "c1", "c2"]
COLUMNS = ", ".join(f"{x} long" for x in PLACE + CONTEXT)
_LONGS = [(x, pa.int64()) for x in PLACE + CONTEXT]


def all_stretches(docs: DataFrame) -> DataFrame:
    """PLACE (document, first window, windows, distance of the anchor) and CONTEXT (anchor, digest) of every stretch."""

    def run(batches):
        for batch in words.pieces(batches, "text", 4 * STEP):
            d, h = batch.column("d").to_numpy(), batch.column("h").to_numpy()
            for text, at, number, shift in units(*words.utf8(batch.column("text"))):
                doc, lo, first, n, distance, anchor = stretches(text, at)
                view = memoryview(np.ascontiguousarray(text))
                c1, c2 = digests([view[a:b] for a, b in zip(first.tolist(), (first + n - 1 + LENGTH).tolist(), strict=True)], distance)
                row = number[doc]
                columns = [d[row], h[row], lo + shift[doc], n.astype(np.int64), distance, anchor.view(np.int64), c1, c2]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=PLACE + CONTEXT)

    return storage.mapped(docs.select("d", "h", "text"), run, COLUMNS)


TEXTS = f"{COLUMNS}, contexts long, bytes binary"
_TEXTS = pa.schema([*_LONGS, ("contexts", pa.int64()), ("bytes", pa.binary())])


def with_texts(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """`needed` (PLACE, CONTEXT, contexts) with the bytes under each stretch. A document's list has an entry for
    each of its stretches, not for each window."""
    rest = [x for x in [*PLACE, *CONTEXT, "contexts"] if x not in ("d", "h")]
    lists = needed.groupBy("d", "h").agg(F.collect_list(F.struct(*rest)).alias("parts"))

    def run(batches):
        for batch in words.pieces(batches, "text", 4 * STEP):
            data, off = words.utf8(batch.column("text"))
            for k, (d, h, parts) in enumerate(zip(batch.column("d").to_pylist(), batch.column("h").to_pylist(), batch.column("parts"), strict=True)):
                for a in range(0, len(parts), 4096):
                    rows = [p | {"d": d, "h": h, "bytes": data[off[k] + p["lo"] : off[k] + p["lo"] + p["n"] - 1 + LENGTH].tobytes()} for p in parts.values.slice(a, 4096).to_pylist()]
                    yield pa.RecordBatch.from_pylist(rows, schema=_TEXTS)

    # Rows that are the same throughout show the same bytes; one of them is enough.
    shown = docs.select("d", "h", "text").join(lists, ["d", "h"])
    return storage.mapped(shown, run, TEXTS)


def split(contexts: DataFrame, width: int) -> DataFrame:
    """Contexts with their bytes, cut into pieces of at most `width` windows, whose key is their common core."""

    def run(batches):
        for batch in words.pieces(batches, "bytes", STEP):
            out = []
            for r in batch.to_pylist():
                # Windows k of a range of distances at - k all cover the bytes from the farthest start to the nearest end.
                for far in range((r["at"] - r["n"] + 1) // width, r["at"] // width + 1):
                    a, b = max(0, r["at"] - far * width - width + 1), min(r["n"] - 1, r["at"] - far * width)
                    core = r["bytes"][r["at"] - far * width : r["at"] - far * width - width + 1 + LENGTH]
                    key = hashlib.blake2b(core + far.to_bytes(4, "little", signed=True) + r["key"].to_bytes(8, "little", signed=True), digest_size=8).digest()
                    out.append(r | {"lo": r["lo"] + a, "n": b - a + 1, "at": r["at"] - a, "key": int.from_bytes(key, "little", signed=True), "bytes": r["bytes"][a : b + LENGTH]})
            c1, c2 = digests([p["bytes"] for p in out], np.array([p["at"] for p in out], np.int64))
            columns = [pa.array([p[x] for p in out], pa.int64()) for x in [*PLACE, "key"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(c1), pa.array(c2), pa.array([p["bytes"] for p in out], pa.binary())], names=[*PLACE, *CONTEXT, "bytes"])

    return storage.mapped(contexts, run, f"{COLUMNS}, bytes binary")


SPANS = f"{KEYED}, lo long, hi long"
_SPANS = pa.schema([(x, pa.int64()) for x in ("d", "h", "lo", "hi")])


#: Bytes beside an anchor that equal windows share on one side at least: half of what a window has besides the anchor.
WING = (LENGTH - GRAM) // 2


def promising(rows: list[dict]) -> list[dict]:
    """Those of a bin's contexts that share a wing with another one under their key; no others have a window in common."""
    wings = [[(r["key"], side, r["bytes"][a : a + WING]) for side, a in enumerate((r["at"] - WING, r["at"] + GRAM)) if 0 <= a <= len(r["bytes"]) - WING] for r in rows]
    times = Counter(w for own in wings for w in own)
    return [r for r, own in zip(rows, wings, strict=True) if any(times[w] > 1 for w in own)]


def sorted_bins(contexts: DataFrame) -> DataFrame:
    """Runs [lo, hi) of repeated windows, from suffix sorting; contexts of a key stay in one bin."""

    def run(batches):
        held, size, key = [], 0, None

        def flush():
            bin_ = promising(held)
            found = repeated([r["bytes"] for r in bin_], [r["n"] for r in bin_]) if bin_ else []
            rows = [{"d": r["d"], "h": r["h"], "lo": r["lo"] + a, "hi": r["lo"] + b} for r, hit in zip(bin_, found, strict=True) for a, b in runs(hit)]
            return pa.RecordBatch.from_pylist(rows, schema=_SPANS)

        last = None
        for batch in words.pieces(batches, "bytes", STEP):
            for r in batch.to_pylist():
                same = tuple(r[x] for x in CONTEXT)
                if same == last:
                    continue
                last = same
                if r["key"] != key and size >= BIN:
                    yield flush()
                    held, size = [], 0
                key = r["key"]
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield flush()

    columns = [*PLACE, *CONTEXT, "bytes"]
    return storage.mapped(contexts.select(columns).repartition("key").sortWithinPartitions(*CONTEXT), run, SPANS)


def collapsed(members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Spans of members whose context stands in several places, and one member (with `contexts`, the number under its
    key) of every context whose key has several, of which some stand in one place only."""
    shown = [F.min(F.struct(*PLACE)).alias("one")] + [F.first("bytes").alias("bytes")] * ("bytes" in members.columns)
    distinct = storage.written(members.groupBy(*CONTEXT).agg(F.count("*").alias("times"), *shown), f"{name}-contexts")
    copied = skew.met(members.select("d", "h", "lo", "n", *CONTEXT), distinct.where("times > 1").select(*CONTEXT, "times"), CONTEXT, "times")
    keys = distinct.groupBy("key").agg(F.count("*").alias("contexts"), F.min("times").alias("rarest")).where("contexts > 1 and rarest = 1").drop("rarest")
    open_ = skew.met(distinct, storage.written(keys, f"{name}-keys"), ["key"], "contexts").select("one.*", *CONTEXT, "contexts", *["bytes"] * ("bytes" in members.columns))
    return copied.select("d", "h", "lo", (F.col("lo") + F.col("n")).alias("hi")), open_


def repeats(docs: DataFrame) -> DataFrame:
    """d, h and the runs [lo, hi) of window starts that repeat; `docs` is keyed."""
    found, open_ = collapsed(storage.written(all_stretches(docs), "stretches"), "all")
    texts = storage.written(with_texts(open_, docs), "texts")
    for width in WIDTHS:
        found = found.union(sorted_bins(texts.where(F.col("contexts") <= CROWD)))
        crowded = texts.where(F.col("contexts") > CROWD)
        if crowded.isEmpty():
            return found
        copied, open_ = collapsed(storage.written(split(crowded, width), "pieces"), f"of-{width}")
        found, texts = found.union(copied), storage.written(open_, "texts")
    return found.union(sorted_bins(texts))


def united(spans: DataFrame) -> DataFrame:
    """`spans` of each document with those whose bytes touch or overlap as one: fewer than one for LENGTH bytes of text."""
    along = Window.partitionBy("d", "h").orderBy("lo", "hi")
    far = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("new", F.coalesce(F.col("lo") >= far + LENGTH, F.lit(True)).cast("int"))
    return begins.withColumn("run", F.sum("new").over(along)).groupBy("d", "h", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the bytes kept, if asked for)."""
    have = keyed(docs, doc_id, text)
    spans = united(storage.written(repeats(have), "spans").distinct()).groupBy("d", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    rows = have.join(spans, ["d", "h"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in words.pieces(batches, "text", 4 * STEP):
            data, off = words.utf8(batch.column("text"))
            change = np.zeros(len(data) + 1, np.int32)
            lists = batch.column("spans")
            flat = lists.flatten()
            if len(flat):
                doc = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                np.add.at(change, off[doc] + flat.field("lo").to_numpy(), 1)
                np.add.at(change, off[doc] + flat.field("hi").to_numpy() - 1 + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            out = []
            for k in range(batch.num_rows):
                cut, own = gone[off[k] : off[k + 1]], data[off[k] : off[k + 1]]
                rest = own[~cut].tobytes()
                row = [len(own), int(cut.sum()), len(runs(cut)), hashlib.sha256(rest).hexdigest()]
                out.append(row + [rest] * keep_text)
            columns = [batch.column("doc_id").cast(pa.int64())] + [pa.array([r[k] for r in out]) for k in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return storage.mapped(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
