"""Language-model scores from a subword lattice.

The model writes a text as a sequence of pieces and one end. Pieces are those of an existing public vocabulary;
their probabilities start from the vocabulary's scores (merge ranks, read as Zipf ranks) and are fitted to the
training documents by expectation-maximisation over the corpus's word counts. The probability of a text sums the
products of piece probabilities over all its segmentations, by the forward recursion in log space. A piece that
opens a word begins with a mark, so segmentations never cross words: the sum of a text is the product of the sums
of its words, and each distinct word needs one lattice.

Words are counted over all documents. The most frequent in all of them (at most `HEAD`, none above `LONGEST` bytes) are broadcast
with their counts and scores; all others meet their documents in a join keyed by word, where none has more than a
`HEAD`-th of the occurrences.

Defined cases: null is the empty text (only the end is scored); a word outside the vocabulary is spelled with byte
pieces, so every score is finite; a word of any length is scored, part by part beyond `LONG` bytes; repeated rows are
scored one by one; very long texts are cut a few megabytes at once; words of equal frequency are broadcast together or
not at all; empty tables give empty results; extra columns are ignored; with no training documents every count is 0 and the piece probabilities stay the vocabulary's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinelle.llm import storage, words

#: Places of lattices at once, bytes of text at once, words broadcast, added count of a piece.
CELLS, STEP, HEAD, ADDED = 1 << 16, 4 << 20, 200_000, 0.1
#: Bytes of the longest words that may be among them; longer ones meet the documents in a shuffle.
LONGEST = 256
#: A word of more bytes goes through its lattice alone, PART places at once.
LONG, PART = 256, 1 << 16
#: Stands for the mark that opens a word; no UTF-8 text has this byte.
MARK = b"\xff"
_ODD, _SLOTS = np.uint64(0x9E3779B97F4A7C15), 20


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The usable pieces of a sentencepiece file (all single bytes among them) and their starting probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = sp.id_to_piece(i)
        raw = bytes([int(piece[1:-1], 16)]) if sp.is_byte(i) else piece.encode("utf-8").replace("▁".encode(), MARK)
        if MARK not in raw[1:] and raw not in found:
            found[raw] = 1.0 / (10.0 - sp.get_score(i) if not sp.is_byte(i) else 1e6)
    for b in range(256):
        found.setdefault(bytes([b]), 1e-6)
    p = np.array(list(found.values()))
    return list(found), p / p.sum()


class Pieces:
    """Lookup from bytes to piece number by a rolling hash, whole arrays at a time."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.log_p = np.append(log_p, -np.inf)
        self.widest = max(map(len, pieces))
        self.keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.arange(len(pieces))
        while len(left):  # pieces that share a slot wait for the next table
            slot = self._slot(self.keys[left], len(self.rounds))
            _, first = np.unique(slot, return_index=True)
            number = np.full(1 << _SLOTS, -1, np.int32)
            number[slot[first]] = left[first]
            self.rounds.append((number, np.append(self.keys, 0)[number]))
            left = np.delete(left, first)

    @staticmethod
    def _key(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_ODD) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _slot(key: np.ndarray, k: int) -> np.ndarray:
        return ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)) >> np.uint64(64 - _SLOTS)

    def find(self, key: np.ndarray) -> np.ndarray:
        out = np.full(key.shape, -1, np.int32)
        for k, (number, keys) in enumerate(self.rounds):
            slot = self._slot(key, k)
            np.copyto(out, number[slot], where=keys[slot] == key)
        return out


def lattices(text: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length (rows of bytes): piece numbers by (word, end, width from wide to narrow), their log
    probabilities, and the forward sums by (word, end) behind as many columns of nothing as the widest piece."""
    n, length = text.shape
    widest = min(pieces.widest, length)
    number = np.full((n, length + 1, widest), -1, np.int32)
    key = np.zeros((n, length + 1), np.uint64)
    for w in range(1, widest + 1):
        key = key[:, : length - w + 1] * _ODD + text[:, w - 1 :] + np.uint64(1)
        number[:, w:, widest - w] = pieces.find(key)
    log_p = pieces.log_p[number]
    forward = np.full((n, widest + length + 1), -np.inf)
    forward[:, widest] = 0.0
    for end in range(1, length + 1):
        forward[:, widest + end] = log_sum(forward[:, end : widest + end] + log_p[:, end])
    return number, log_p, forward


def log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def expected(number: np.ndarray, log_p: np.ndarray, forward: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, expected uses) over weighted words, by the backward recursion beside the forward one."""
    n, ends, widest = number.shape
    backward = np.full((n, widest + ends), -np.inf)
    backward[:, widest + ends - 1] = 0.0
    for end in range(ends - 1, 0, -1):
        # What follows `end` flows back to the starts end - widest ... end - 1.
        into = backward[:, widest + end, None] + log_p[:, end]
        backward[:, end : widest + end] = np.logaddexp(backward[:, end : widest + end], into)
    word, end, w = np.nonzero(number >= 0)
    start = widest + end - (widest - w)
    share = np.exp(forward[word, start] + log_p[word, end, w] + backward[word, widest + end] - forward[word, -1])
    return number[word, end, w], share * weight[word]


def opened(text: np.ndarray, lo: int, hi: int, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, width, number) of every piece of one word that starts in [lo, hi), by start."""
    part = text[lo : hi + pieces.widest - 1].astype(np.uint64)
    key = np.zeros(len(part) + 1, np.uint64)
    found = []
    for w in range(1, min(pieces.widest, len(part)) + 1):
        key = key[: len(part) - w + 1] * _ODD + part[w - 1 :] + np.uint64(1)
        number = pieces.find(key[: hi - lo])
        at = np.flatnonzero(number >= 0)
        found.append((at + lo, np.full(len(at), w), number[at]))
    start, width, number = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(start, kind="stable")
    return start[order], width[order], number[order]


def added(a: float, b: float) -> float:
    """Log of the sum of two numbers given by their logs."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def long_forward(text: np.ndarray, pieces: Pieces) -> Iterator[list[float]]:
    """The forward sums of one word at places 0, 1, ... part by part; the last is that of the whole word."""
    here = [0.0] + [-math.inf] * pieces.widest
    for lo in range(0, len(text), PART):
        hi = min(lo + PART, len(text))
        here += [-math.inf] * (hi - lo)
        start, width, number = opened(text, lo, hi, pieces)
        for s, w, p in zip((start - lo).tolist(), width.tolist(), pieces.log_p[number].tolist(), strict=True):
            here[s + w] = added(here[s + w], here[s] + p)
        yield here[: hi - lo]
        here = here[hi - lo :]
    yield here[:1]


def long_expected(text: np.ndarray, pieces: Pieces, weight: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(piece, expected uses) over one weighted word, part by part from its end."""
    forward = np.concatenate([np.array(f) for f in long_forward(text, pieces)])
    after = [0.0] + [-math.inf] * pieces.widest
    for lo in reversed(range(0, len(text), PART)):
        hi = min(lo + PART, len(text))
        start, width, number = opened(text, lo, hi, pieces)
        log_p = pieces.log_p[number]
        back = [-math.inf] * (hi - lo) + after
        for s, w, p in zip((start - lo).tolist()[::-1], width.tolist()[::-1], log_p.tolist()[::-1], strict=True):
            back[s] = added(back[s], back[s + w] + p)
        yield number, weight * np.exp(forward[start] + log_p + np.array(back)[start - lo + width] - forward[-1])
        after = back[: pieces.widest + 1]


def by_length(found: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in `found`, bytes as rows) of words of one length, with the mark in front, a bounded number at once; a
    word longer than LONG comes alone, as one row of eight-bit bytes."""
    data, off = words.utf8(found)
    size = np.diff(off)
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, edges):
        if len(group):
            length = int(size[group[0]])
            kind = np.uint64 if length <= LONG else np.uint8
            for part in np.array_split(group, max(1, len(group) * (length + 1) // CELLS) if length <= LONG else len(group)):
                rows = np.full((len(part), length + 1), MARK[0], kind)
                rows[:, 1:] = data[off[part][:, None] + np.arange(length)]
                yield part, rows


def word_scores(found: pa.Array, pieces: Pieces) -> np.ndarray:
    """Log10 of the marginal probability of each word."""
    out = np.zeros(len(found))
    for part, rows in by_length(found):
        if rows.shape[1] - 1 <= LONG:
            out[part] = lattices(rows, pieces)[2][:, -1]
        else:
            for sums in long_forward(rows[0], pieces):
                out[part] = sums[-1]
    return out / math.log(10)


def count_words(docs: DataFrame, text: str, held: str) -> DataFrame:
    """(word, c, m): how often each word stands in training documents and in all; the end is null."""

    def run(batches):
        for batch in words.pieces(batches, text, STEP):
            counts, found = words.cut(*words.utf8(batch.column(text)), words.UNSPACED, lower=True)
            train = ~batch.column(held).to_numpy(zero_copy_only=False).astype(bool)
            which, terms = words.distinct(found)
            c = np.bincount(which, weights=np.repeat(train, counts), minlength=len(terms)).astype(np.int64)
            m = np.bincount(which, minlength=len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([terms.cast(pa.binary()), pa.array(c), pa.array(m)], names=["word", "c", "m"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), *(pa.array([int(x)], pa.int64()) for x in (train.sum(), len(train)))], names=["word", "c", "m"])

    return storage.mapped(docs.select(text, held), run, "word binary, c long, m long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))


def fit(counts: DataFrame, pieces: list[bytes], p: np.ndarray, ends: int, rounds: int = 1) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the end, after `rounds` of expectation-maximisation over word counts."""
    spark = counts.sparkSession
    total = 1.0 + 1e-3
    log_p, log_end = np.log(p / total), math.log(1e-3 / total)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, log_p))

        def run(batches, shared=shared):
            have = Pieces(*shared.value)
            total = np.zeros(len(shared.value[0]))
            for batch in batches:
                weight = batch.column("c").to_numpy().astype(float)
                for part, rows in by_length(batch.column("word")):
                    short = rows.shape[1] - 1 <= LONG
                    for which, share in [expected(*lattices(rows, have), weight[part])] if short else long_expected(rows[0], have, weight[part[0]]):
                        total += np.bincount(which, weights=share, minlength=len(total))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["piece", "uses"])

        # At most one row for each piece of the vocabulary comes back, however large the corpus.
        fitted = np.full(len(pieces), ADDED)
        for r in storage.mapped(counts.where("c > 0 and word is not null"), run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            fitted[r.piece] += r.uses
        total = fitted.sum() + ends + ADDED
        log_p, log_end = np.log(fitted / total), math.log((ends + ADDED) / total)
    return log_p, log_end


def score(docs: DataFrame, vocabulary_path: str, held: str, doc_id: str = "doc_id", text: str = "text", rounds: int = 1) -> DataFrame:
    """One row for each document: doc_id, held, n_tokens, n_known, train_tokens, base_score, score.

    `held` names a boolean column: true rows are scored but not learned from.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    counts = storage.written(count_words(docs, "text", "held"), "words")
    size = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.max(F.when(F.col("word").isNull(), F.col("c"))).alias("ends")).first()
    n, v, ends = size.n or 0, size.v or 0, size.ends or 0
    pieces, p = vocabulary(vocabulary_path)
    log_p, log_end = fit(counts, pieces, p, ends, rounds)
    model = spark.sparkContext.broadcast((pieces, log_p))
    floor = math.log10(n + v + 1)

    def with_scores(batches):
        have = Pieces(*model.value)
        for batch in batches:
            lp = word_scores(batch.column("word"), have)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("word", "c", "m")), pa.array(lp)], names=["word", "c", "m", "lp"])

    scored = storage.written(storage.mapped(counts.where("word is not null"), with_scores, "word binary, c long, m long, lp double"), "scores")
    # Words of LONGEST bytes at most in frequency classes of an eighth of a power of two: a few hundred, of which the upper ones fit the head.
    klass = F.floor(8 * F.log2("m"))
    cutoff, room = math.inf, HEAD
    short = F.octet_length("word") <= LONGEST
    for r in scored.where(short).groupBy(klass.alias("k")).count().orderBy(F.desc("k")).collect():
        room -= r["count"]
        if room < 0:
            break
        cutoff = r.k
    frequent = short & (klass >= cutoff) if cutoff < math.inf else F.lit(False)
    head = scored.where(frequent).select("word", "c", "lp").toArrow().combine_chunks()
    top = spark.sparkContext.broadcast((pa.array(head["word"].to_pylist(), pa.binary()), head["c"].to_numpy(), head["lp"].to_numpy()))

    def rows(batches):
        from pyspark import TaskContext

        known, c, lp = top.value
        base, c, lp = np.append(np.log10(c + 1.0) - floor, 0.0), np.append(c, 0), np.append(lp, 0.0)
        key = (TaskContext.get().partitionId()) << 40
        for batch in words.pieces(batches, "text", STEP):
            count, found = words.cut(*words.utf8(batch.column("text")), words.UNSPACED, lower=True)
            which, terms = words.distinct(found)
            at = pc.fill_null(pc.index_in(terms.cast(pa.binary()), value_set=known), -1).to_numpy(zero_copy_only=False)[which]
            doc = np.repeat(np.arange(len(count)), count)
            total = lambda x: np.bincount(doc, weights=x, minlength=len(count))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key + np.arange(len(count))), batch.column("doc_id"), batch.column("held"), pa.nulls(len(count), pa.binary()), pa.array(count + 1)]
                + [pa.array(total(c[at] > 0).astype(np.int64) + (ends > 0)), pa.array(total(base[at]) + math.log10(ends + 1) - floor), pa.array(total(lp[at]) + log_end / math.log(10))],
                names=NAMES,
            )
            rest = at < 0
            pair, times = np.unique(doc[rest] * len(terms) + which[rest], return_counts=True)
            none = lambda kind: pa.nulls(len(pair), kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key + pair // max(1, len(terms))), none(pa.int64()), none(pa.bool_()), pc.take(terms, pa.array(pair % max(1, len(terms)))).cast(pa.binary()), pa.array(times.astype(np.int64))] + [none(pa.int64()), none(pa.float64()), none(pa.float64())],
                names=NAMES,
            )
            key += len(count)

    found = storage.written(storage.mapped(docs, rows, "key long, doc_id long, held boolean, word binary, n long, known long, base double, score double"), "tokens")
    rare = found.where("word is not null").select("key", "word", "n").join(scored.where(~frequent), "word")
    rare = rare.select(
        "key",
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("boolean").alias("held"),
        F.lit(0).cast("long").alias("n"),
        F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * (F.log10(F.col("c") + 1) - floor)).alias("base"),
        (F.col("n") * F.col("lp")).alias("score"),
    )
    whole = found.where("word is null").drop("word").unionByName(rare)
    return (
        whole.groupBy("key")
        .agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), F.max("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    )


NAMES = ["key", "doc_id", "held", "word", "n", "known", "base", "score"]
