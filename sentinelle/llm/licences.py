"""License scans: texts against licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised to lower-cased words and compared as multisets of word bigrams: twice the common
bigrams over the sum of both sizes. A template is held against every stretch of a text, wherever it stands and
whatever surrounds it: a stretch that reaches a coefficient of t has between t / (2 - t) and (2 - t) / t times the
template's bigrams, and has t / (2 - t) times as many in common with it at least. Whole batches are cut at once, and
only bigrams that some template has are looked at; a template is a candidate only where enough of its own bigrams
stand close enough together. There every stretch that begins and ends with one of them is compared, so that the
greatest coefficient is found.

Defined cases: a null text has no words; a text of one word has no bigrams and matches nothing; equal coefficients go
to the template that stands first, then to the stretch that begins and ends first; repeated rows are scanned one by
one; very long texts are scanned whole, in memory that follows the text; empty tables stay empty; extra columns pass through, but for those of the names that are asked for.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sentinelle.llm import storage, words
from sentinelle.llm.licence_texts import TEMPLATES

ALIKE = 0.8
#: Bytes of text at once.
STEP = 4 << 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def normal(text: str) -> list[str]:
    return _WORD.findall(text.translate(_UPPER))


class Templates:
    """The templates' bigrams by number, and each template's bounds at a coefficient of `alike`."""

    def __init__(self, templates=TEMPLATES, alike: float = ALIKE):
        self.alike = alike
        self.names = [name for name, _ in templates]
        said = [normal(text) for _, text in templates]
        self.vocabulary = sorted({w for ws in said for w in ws})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        bags = [Counter(number[a] * len(number) + number[b] for a, b in zip(ws[:-1], ws[1:], strict=True)) for ws in said]
        #: Word pairs that some template has, in order, and how often each template has each of them.
        self.pairs = np.array(sorted({g for bag in bags for g in bag}), np.int64)
        self.times = np.array([[bag[g] for g in self.pairs.tolist()] for bag in bags], np.int64).reshape(len(bags), len(self.pairs))
        self.sizes = [bag.total() for bag in bags]
        self.longest = [math.floor(n * (2 - alike) / alike + 1e-9) for n in self.sizes]
        self.least = [max(1, math.ceil(n * alike / (2 - alike) - 1e-9)) for n in self.sizes]
        self.words = pa.array([w.encode() for w in self.vocabulary], pa.binary())

    def bigrams(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in it, number) of every bigram that some template has."""
        counts, found = words.cut(*words.utf8(texts), words.LETTERS, lower=True)
        which, terms = words.distinct(found)
        known = pc.fill_null(pc.index_in(terms.cast(pa.binary()), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[which]
        text = np.repeat(np.arange(len(counts)), counts)
        both = np.flatnonzero((known[:-1] >= 0) & (known[1:] >= 0) & (text[:-1] == text[1:])) if len(known) else np.zeros(0, np.int64)
        pair = known[both] * len(self.vocabulary) + known[both + 1]
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        ok = self.pairs[at] == pair if len(self.pairs) else np.zeros(len(pair), bool)
        both, at = both[ok], at[ok]
        return text[both], both - (np.cumsum(counts) - counts)[text[both]], at

    def stretches(self, k: int, text: np.ndarray, place: np.ndarray, pair: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(text, coefficient, first bigram, last bigram): for each start, the stretch most like template k, if it reaches `alike`."""
        mine = np.flatnonzero(self.times[k, pair] > 0)
        text, place, pair = text[mine], place[mine], pair[mine]
        m = self.least[k]
        if len(mine) < m:
            return []
        far = np.arange(len(mine) - m + 1) + m - 1
        starts = np.flatnonzero((text[far] == text[: len(far)]) & (place[far] - place[: len(far)] < self.longest[k]))
        found, have, size = [], self.times[k], self.sizes[k]
        for i in starts.tolist():
            stop = int(np.searchsorted(place[i : i + self.longest[k]], place[i] + self.longest[k]))
            same = text[i : i + stop] == text[i]
            stop = i + (stop if same.all() else int(np.argmin(same)))
            seen: Counter = Counter()
            common, best = 0, (0.0, 0)
            for j in range(i, stop):
                g = int(pair[j])
                seen[g] += 1
                common += seen[g] <= have[g]
                best = max(best, (2 * common / (size + int(place[j] - place[i]) + 1), -int(place[j])))
            if best[0] >= self.alike:
                found.append((int(text[i]), best[0], int(place[i]), -best[1]))
        return found

    def scan(self, texts: pa.Array) -> list[list[tuple[str, float, int, int]]]:
        """For each text (licence, coefficient, first word, end) of the stretches found, best first, none overlapping a better one."""
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in range(len(texts))]
        here = self.bigrams(texts)
        found = sorted((t, -dice, k, a, b) for k in range(len(self.names)) for t, dice, a, b in self.stretches(k, *here))
        taken: list[tuple[int, int]] = []
        last = -1
        for t, dice, k, a, b in found:
            if t != last:
                last, taken = t, []
            # Disjoint stretches in order: only the neighbours of a new one can overlap it.
            at = bisect.bisect(taken, (a, b))
            if (at == 0 or taken[at - 1][1] < a) and (at == len(taken) or b < taken[at][0]):
                taken.insert(at, (a, b))
                out[t].append((self.names[k], -dice, a, b + 2))
        return out


FOUND = T.ArrayType(T.StructType([T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, alike: float = ALIKE, licence: str = "licence", dice: str = "dice", found: str = "licences") -> DataFrame:
    """`docs` with the identifier of the closest template (null: none) and its coefficient, and all that was `found`:
    licence, dice and the words [start, stop) of every stretch, best first. No row leaves its task."""
    mine = (licence, dice, found)
    kept = [f for f in docs.schema.fields if f.name not in mine]
    schema = T.StructType([*kept, T.StructField(licence, T.StringType()), T.StructField(dice, T.DoubleType()), T.StructField(found, FOUND)])
    arrow = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        have = Templates(templates, alike)
        for batch in words.pieces(batches, text, STEP):
            got = have.scan(batch.column(text))
            best = [g[0] if g else (None, None) for g in got]
            columns = [pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())]
            columns.append(pa.array([[dict(zip(("licence", "dice", "start", "stop"), x, strict=True)) for x in g] for g in got], arrow))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[f.name for f in schema.fields])

    return storage.mapped(docs, run, schema)
