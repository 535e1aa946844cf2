"""BPE encoding and decoding with a public tokenizer file.

A text is cut where the tokenizer itself always cuts it (ASCII white space); each distinct chunk of a batch is
encoded once. In a chunk longer than `LEAF` characters each pre-token longer than a leaf goes through tree
concatenation, all pre-tokens of the batch together: every one is halved down to leaves, all leaves are encoded at
once and in parallel, and then, level by level, all joins are made at once. At a join a window of tokens around it is
encoded again, growing until its first token agrees with the left half and its last with the right half. Neighbouring
tokens then are, at every place, neighbours in an encoding of their own text, which makes the whole the encoding of
the whole. A batch is bounded by its bytes, so only the text of one very long row can make it larger.

Defined cases: null is the empty text (no ids, decoded ''); strings of special tokens inside a text become those
tokens, as in the library; repeated rows are encoded alike; very long texts are encoded whole, alone in their batch;
empty tables stay empty; other columns pass through, but for those of the names that are given to ids and decoded text.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sentinelle.llm import storage, words

LEAF = 16
#: Bytes of text handled at once, and chunks of at most 64 bytes that a Python worker remembers; both only bound memory.
STEP, REMEMBERED = 1 << 20, 50_000
#: Leaves or windows beyond which the library encodes them on threads.
MANY = 4096


class Coder:
    """The parts of one tokenizer file that encoding and decoding need."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        bpe, merges = spec["model"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        suffix = bpe.get("end_of_word_suffix")
        kinds = (models.BPE(bpe["vocab"], merges), models.BPE(bpe["vocab"], merges, **({"end_of_word_suffix": suffix} if suffix else {})))
        #: Encoders of bare text: inside a pre-token, and up to its end.
        self.inner, self.last = (Tokenizer(kind) for kind in kinds)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[bytes, tuple[bytes, bytes]] = {}

    def leaves(self, texts: list[str], ends: list[bool]) -> list[list[tuple[int, int]]]:
        """(id, characters) of the tokens of every text; one that `ends` ends its pre-token."""
        os.environ["TOKENIZERS_PARALLELISM"] = str(len(texts) > MANY).lower()
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for encoder, end in ((self.inner, False), (self.last, True)):
            mine = [k for k, e in enumerate(ends) if e == end]
            for k, coded in zip(mine, encoder.encode_batch([texts[k] for k in mine], add_special_tokens=False), strict=True):
                out[k] = [(i, b - a) for i, (a, b) in zip(coded.ids, coded.offsets, strict=True)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return out

    def trees(self, tokens: list[str]) -> list[list[tuple[int, int]]]:
        """(id, characters) of the tokens of each pre-token, by tree concatenation of all of them level by level."""
        # A token's bounds at each level halve those of the level above, down to leaves.
        levels = [[[0, len(t)] for t in tokens]]
        while any(b - a > LEAF for at in levels[-1] for a, b in zip(at[:-1], at[1:], strict=True)):
            levels.append([sorted({*at, *((a + b) // 2 for a, b in zip(at[:-1], at[1:], strict=True) if b - a > LEAF)}) for at in levels[-1]])
        cut = [(t[a:b], b == len(t)) for t, at in zip(tokens, levels[-1], strict=True) for a, b in zip(at[:-1], at[1:], strict=True)]
        coded = iter(self.leaves([c for c, _ in cut], [e for _, e in cut]))
        have = [{a: next(coded) for a in at[:-1]} for at in levels[-1]]
        for above, below in zip(levels[-2::-1], levels[:0:-1], strict=True):
            joins = []
            for k, (up, down) in enumerate(zip(above, below, strict=True)):
                joins += [(k, m, up[bisect.bisect_right(up, m) - 1], up[bisect.bisect_right(up, m)]) for m in sorted(set(down) - set(up))]
            self.join(tokens, have, joins)
        return [h[0] for h in have]

    def join(self, tokens: list[str], have: list[dict[int, list]], joins: list[tuple[int, int, int, int]]) -> None:
        """Put together, for each (token, middle, start, stop), the two halves that meet in the middle."""
        size = 1
        while joins:
            windows = []
            for k, mid, lo, hi in joins:
                left, right = have[k][lo], have[k][mid]
                a, b = max(0, len(left) - size), min(len(right), size)
                start, stop = mid - sum(n for _, n in left[a:]), mid + sum(n for _, n in right[:b])
                windows.append((a, b, tokens[k][start:stop], b == len(right) and hi == len(tokens[k])))
            again = []
            for join, (a, b, _, _), window in zip(joins, windows, self.leaves([w[2] for w in windows], [w[3] for w in windows]), strict=True):
                k, mid, lo, _ = join
                left, right = have[k][lo], have[k][mid]
                if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                    have[k][lo] = left[:a] + window + right[b:]
                    del have[k][mid]
                else:
                    again.append(join)
            joins, size = again, size * 2

    def long(self, chunks: list[str]) -> list[list[int]]:
        """The ids of chunks that may hold long unsplit text."""
        out: list[list[int | None]] = []
        waiting: list[str] = []
        for chunk in chunks:
            ids: list[int | None] = []
            for part in self.special_re.split(chunk) if self.special_re else [chunk]:
                if part in self.special:
                    ids.append(self.special[part])
                elif part:
                    clean = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                    for token, _ in self.whole.pre_tokenizer.pre_tokenize_str(clean):
                        ids.append(None)
                        waiting.append(token)
            out.append(ids)
        trees = iter(self.trees(waiting))
        return [[i for one in ids for i in ([one] if one is not None else [t for t, _ in next(trees)])] for ids in out]

    def chunks(self, found: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids (unsigned 32 bits each) and decoded text of chunks; a chunk with tokens decodes to text with a blank after it."""
        fresh = [c for c in found if c not in self.known]
        texts = [c.decode("utf-8") for c in fresh]
        quick = iter(self.whole.encode_batch_fast([t for t in texts if len(t) <= LEAF], add_special_tokens=False))
        slow = iter(self.long([t for t in texts if len(t) > LEAF]))
        new: dict[bytes, tuple[bytes, bytes]] = {}
        for c, t in zip(fresh, texts, strict=True):
            ids = next(quick).ids if len(t) <= LEAF else next(slow)
            said = self.whole.decode(ids, skip_special_tokens=False) + " " if ids else ""
            new[c] = (np.asarray(ids, "<u4").tobytes(), said.encode("utf-8"))
        out = [self.known.get(c) or new[c] for c in found]
        if len(self.known) < REMEMBERED:
            self.known |= {c: v for c, v in new.items() if len(c) <= 64}
        return out

    def batch(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The ids (as bytes) and the decoded text of every text."""
        counts, chunks = words.cut(*words.utf8(texts), words.UNSPACED)
        which, found = words.distinct(chunks)
        coded = self.chunks(found.to_pylist())
        at = np.concatenate(([0], np.cumsum(counts)))
        out = []
        for k in (0, 1):
            flat = pc.take(pa.array([c[k] for c in coded], pa.large_binary()), pa.array(which))
            data, off = words.utf8(flat)
            out.append(words.binary(data, off[at]))
        return out[0], pc.ascii_rtrim(out[1].cast(pa.string()), " ")


@functools.cache
def coder(path: str) -> Coder:
    """One coder for each Python worker."""
    return Coder(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`docs` without `text`, with `ids` (binary: little-endian unsigned 32-bit integers) and `decoded` (string).

    `ids` and `decoded` name the new columns, so that they need not clash with those of `docs`. No row leaves its
    partition: there is no shuffle, and a batch in memory is bounded by its bytes.
    """
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def run(batches):
        for batch in words.pieces(batches, text, STEP):
            got, said = coder(path).batch(batch.column(text))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], got, said], names=[f.name for f in schema.fields])

    return storage.mapped(docs, run, schema)
