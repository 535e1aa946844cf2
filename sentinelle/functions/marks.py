"""Runs of characters of texts that may be one of many strings, found in tasks by a table of bits of bounded size.

A string sets PROBES bits of the table, by its hash and length, and so may its beginnings. A run whose bits are all set is
one of the strings, or rarely another: who asks verifies what was found, and nothing is missed. A hash of any run of a text
is the difference of two running sums, so all runs are looked at by array operations on a piece of the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that a string sets, and how many the table has for each string, up to LARGEST bits (32 MB) in all.
PROBES, SPARSE, LARGEST = 4, 64, 1 << 28
#: Characters of texts that are looked at in one go.
PIECE = 1 << 16
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, which is odd, and of its inverse, all modulo 2^64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Runs:
    """Hashes of the runs of one string."""

    def __init__(self, text: str) -> None:
        self.codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(self.codes)
        up, self._down = _powers(1 << max(PIECE.bit_length() + 1, n.bit_length()))
        spread = (self.codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_SPREAD)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((spread ^ (spread >> np.uint64(32))) * up[:n], out=self._sums[1:])

    def hashes(self, at: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        h = (self._sums[end] - self._sums[at]) * self._down[at]
        h ^= ((end - at).astype(np.uint64) * np.uint64(2) + np.uint64(kind)) * np.uint64(_BASE)
        h *= np.uint64(_SPREAD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(_SPREAD)
        return h ^ (h >> np.uint64(29))


WHOLE, BEGUN = 1, 0


def _bit(h: np.ndarray, probe: int, size: int) -> np.ndarray:
    return (h + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(size - 1)


def known(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in `h` of those whose bits are all set."""
    left = np.arange(len(h))
    for probe in range(PROBES):
        bit = _bit(h[left], probe, len(table) * 8)
        left = left[(table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return left


def table(strings: DataFrame, name: str, begun: list[int]) -> Broadcast:
    """The bits of all `strings`, and of their beginnings of `begun` characters, for tasks to read."""
    size = 1 << max(15, min(LARGEST.bit_length() - 1, (SPARSE * (1 + len(begun)) * strings.count()).bit_length()))

    @F.pandas_udf("array<bigint>")
    def bits(texts: pd.Series) -> pd.Series:
        runs, long = Runs("".join(texts)), texts.str.len().to_numpy(np.int64)
        at = np.cumsum(long) - long
        out = [runs.hashes(at, at + long, WHOLE)]
        out += [runs.hashes(at, at + np.where(long < p, 0, p), BEGUN) for p in begun]
        return pd.Series(list(np.stack([_bit(h, probe, size) for h in out for probe in range(PROBES)], 1).astype(np.int64)))

    each = strings.select(F.explode(bits(F.col(name))).alias("bit"))
    rows = each.groupBy((F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        out[r.part * 4096 : r.part * 4096 + 4096] = np.frombuffer(r.bits, np.uint8)
    return strings.sparkSession.sparkContext.broadcast(out)


def _pieces(texts: Iterable[str], reach: int | None) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and pieces of texts, some PIECE characters at a time; a piece reaches `reach` into the next, or texts stay whole."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        step = PIECE if reach is not None else max(len(text), 1)
        for i in range(0, len(text), step):
            rows.append(row)
            parts.append(text[i : i + step + (reach or 0)])
            held += len(parts[-1])
            if held >= PIECE:
                yield rows, parts
                rows, parts, held = [], [], 0
    if parts:
        yield rows, parts


def longest(text: Column, marks: Broadcast, sizes: list[int], begun: list[int], most: int | None) -> Column:
    """(least, found): the distinct runs of a text that may be strings, of one of the lengths `sizes`, down to the length
    `least` at which there are `most` of them; `least` is 0 if that is all of them."""

    @F.pandas_udf("least int, found array<string>")
    def look(texts: pd.Series) -> pd.DataFrame:
        least, found = np.zeros(len(texts), np.int64), [set() for _ in texts]
        for rows, parts in _pieces(texts, sizes[-1]):
            joined, long = "".join(parts), np.array([len(p) for p in parts])
            runs, stop, row = Runs(joined), np.repeat(np.cumsum(long), long), np.repeat(rows, long)
            at, ats, ends, codes = np.arange(len(joined)), [], [], []
            for p, after in zip(begun, [*begun[1:], sizes[-1] + 1]):
                at = at[at + p <= stop[at]]
                at = at[known(marks.value, runs.hashes(at, at + p, BEGUN))]
                for n in (n for n in sizes if p <= n < after):
                    whole = at[at + n <= stop[at]]
                    h = runs.hashes(whole, whole + n, WHOLE)
                    hit = known(marks.value, h)
                    ats, ends, codes = [*ats, whole[hit]], [*ends, whole[hit] + n], [*codes, h[hit]]
            at, end, code = np.concatenate(ats), np.concatenate(ends), np.concatenate(codes)
            whose, n = row[at], end - at
            if most is not None and len(at):
                order = np.lexsort((code, -n, whose))
                w, m, c = whose[order], n[order], code[order]
                new = np.r_[True, (w[1:] != w[:-1]) | (m[1:] != m[:-1]) | (c[1:] != c[:-1])]
                count = np.cumsum(new)
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                count -= np.repeat(count[first] - 1, np.diff(np.r_[first, len(w)]))
                last = new & (count == most)
                np.maximum.at(least, w[last], m[last])
            keep = n >= least[whose]
            for r, a, e in zip(whose[keep].tolist(), at[keep].tolist(), end[keep].tolist()):
                found[r].add(joined[a:e])
        kept = [[s for s in some if len(s) >= low] for some, low in zip(found, least.tolist())]
        return pd.DataFrame({"least": least.astype(np.int32), "found": kept})

    return look(text)


#: Scripts that write without gaps between words: Thai, Hiragana to Katakana, Han, Hangul.
GAPLESS = ((0x0E00, 0x0E7F), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF))


@lru_cache(1)
def _joins() -> np.ndarray:
    """Of every character, whether it is one unit with its like beside it: letters and digits are."""
    out = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)
    out[ord("_")] = True
    for first, last in GAPLESS:
        out[first : last + 1] = False
    return out


def _starts(runs: Runs, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of some texts begin, and how many units there are before each text."""
    joined = _joins()[runs.codes]
    begins = np.r_[True, ~(joined[1:] & joined[:-1])]
    first = np.cumsum([0, *map(len, parts)])
    begins[first[:-1]] = True
    at = np.flatnonzero(begins)
    return at, np.searchsorted(at, first)


def _fold(text: str | None) -> str:
    return "" if not text else (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def units(text: Column) -> Column:
    """How many units a folded text has."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), np.int32)
        for rows, parts in _pieces(texts, None):
            out[rows] = np.diff(_starts(Runs("".join(parts)), parts)[1])
        return pd.Series(out)

    return count(text)


def places(text: Column, marks: Broadcast, sizes: list[int]) -> Column:
    """(clear, hits): the runs of `sizes` units of a text, when folded, that may be strings, as [(at, back, name)] in this
    order, where `at` counts units and `back` is less than 0 by the run's own; and whether no two of them overlap."""

    @F.arrow_udf("clear boolean, hits array<struct<at: int, back: int, name: string>>")
    def look(texts: pa.Array) -> pa.Array:
        many, clear, ats, backs, names = np.zeros(len(texts) + 1, np.int32), np.ones(len(texts), bool), [], [], []
        for rows, parts in _pieces([_fold(t) for t in texts.to_pylist()], None):
            joined = "".join(parts)
            runs = Runs(joined)
            start, before = _starts(runs, parts)
            bound, owner = np.r_[start, len(joined)], np.repeat(np.arange(len(parts)), np.diff(before))
            found = []
            for n in sizes:
                i = np.flatnonzero(owner[n - 1 :] == owner[: max(len(owner) - n + 1, 0)])
                i = i[known(marks.value, runs.hashes(bound[i], bound[i + n], WHOLE))]
                found.append(np.stack([i, np.full(len(i), -n)]))
            i, back = (found := np.concatenate(found, 1))[:, np.lexsort((found[1], found[0]))]
            clear[np.array(rows)[owner[i[1:][(i[1:] < (i - back)[:-1]) & (owner[i[1:]] == owner[i[:-1]])]]]] = False
            ats.append(i - before[owner[i]])
            backs.append(back)
            names += [joined[a:b] for a, b in zip(bound[i].tolist(), bound[i - back].tolist())]
            many[np.array(rows) + 1] = np.bincount(owner[i], minlength=len(parts))
        flat = [pa.array(np.concatenate(x or [np.zeros(0, np.int64)]).astype(np.int32)) for x in (ats, backs)]
        each = pa.StructArray.from_arrays([*flat, pa.array(names, pa.string())], ["at", "back", "name"])
        hits = pa.ListArray.from_arrays(pa.array(np.cumsum(many, dtype=np.int32)), each)
        return pa.StructArray.from_arrays([pa.array(clear), hits], ["clear", "hits"])

    return look(text)
