"""URL filters as a cascade of Bloom filters.

A cascade holds a set of listed keys exactly, relative to a universe that has every key it will ever be asked about.
Its first filter encodes the listed keys; the second those other keys of the universe that the first wrongly
admits; the third the listed keys that the second wrongly admits; and so on, until a level admits nothing wrongly.
A key is listed if it drops out at an even level (counted from one), or passes all of an odd number of them.

Keys are 64-bit hashes made by Spark. Each level is built by one aggregation: tasks mark bits, words of bits are
OR-ed by the shuffle, and only a filter, whose bytes follow from the number of keys it holds, comes to the driver.
A list too long for `MAX_BYTES` is dealt into shards by hash, each with a cascade of its own, and a key asks its
shard; shards are broadcast one after another. Membership needs no join.

Defined cases: a null URL, or one without `://`, has an empty host and path and matches nothing; an empty list or an
empty universe gives a cascade that lists nothing; repeated URLs are judged one by one. The longest fitting rule wins,
and of a rule that both lists have, allow. Very long hosts and paths are judged whole. An empty table stays empty. Extra columns pass through, but for those of the names that `judge` gives
its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinelle.llm import storage

MAX_BYTES = 32 << 20
#: False-positive rates of the first and the later levels.
FIRST, LATER = 0.1, 0.5


def key(*parts: Column) -> Column:
    """The 64-bit key of a tuple of columns."""
    return F.xxhash64(*parts)


@dataclass
class Filter:
    """A Bloom filter over 64-bit keys; `salt` makes the levels of a cascade independent."""

    words: np.ndarray
    hashes: int
    salt: int

    @staticmethod
    def shape(n: int, rate: float) -> tuple[int, int]:
        """Number of 64-bit words and of hashes for n keys."""
        bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        return -(-bits // 64), max(1, round(-math.log2(rate)))

    @staticmethod
    def places(keys: np.ndarray, n_words: int, hashes: int, salt: int) -> np.ndarray:
        x = keys.astype(np.int64).view(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        out = np.empty((hashes, len(x)), np.uint64)
        for k in range(hashes):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            out[k] = x % np.uint64(n_words * 64)
        return out

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys, len(self.words), self.hashes, self.salt)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


@dataclass
class Cascade:
    levels: list[Filter] = field(default_factory=list)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key of the universe is listed."""
        inside = np.ones(len(keys), bool)
        listed = np.zeros(len(keys), bool)
        for i, level in enumerate(self.levels):
            inside[inside] = level.has(keys[inside])
            listed = np.where(inside, i % 2 == 0, listed)
        return listed


def build_filter(keys: DataFrame, n: int, rate: float, salt: int) -> Filter:
    """One level over the column `key`."""
    n_words, hashes = Filter.shape(n, rate)

    def marks(batches):
        for batch in batches:
            at = Filter.places(batch.column("key").to_numpy(), n_words, hashes, salt).ravel()
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    rows = storage.mapped(keys.select("key"), marks, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(n_words, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return Filter(words, hashes, salt)


def passing(keys: DataFrame, level: Filter) -> DataFrame:
    """The keys that a level admits."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column("key").to_numpy())))

    return storage.mapped(keys, run, "key long")


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of `listed` over `universe`, both with a column `key`.

    A level keeps a falling share of the keys before it, so each round works on what the last one wrote.
    """
    inside = storage.written(listed.select("key").where("key is not null").distinct(), "listed")
    n = inside.count()
    outside = universe.select("key").where("key is not null").distinct().join(inside, "key", "left_anti")
    levels: list[Filter] = []
    while n:
        level = build_filter(inside, n, LATER if levels else FIRST, len(levels) + 1)
        levels.append(level)
        inside, outside = storage.written(passing(outside, level), "passing"), inside
        n = inside.count()
    return Cascade(levels)


def shards(n: int) -> int:
    """How many shards keep the filters of n listed keys within MAX_BYTES; a cascade takes a few bits more than its first level."""
    return max(1, -(-Filter.shape(n, FIRST)[0] * 8 * 3 // MAX_BYTES))


def build_sharded(listed: DataFrame, universe: DataFrame) -> list[Cascade]:
    """One cascade for each shard of the keys."""
    n = shards(listed.select("key").distinct().count())
    if n == 1:
        return [build(listed, universe)]
    of = lambda df, s: df.where(F.pmod("key", F.lit(n)) == s)
    return [build(of(listed, s), of(universe, s)) for s in range(n)]


def with_membership(rows: DataFrame, cascades: list[Cascade], keys: str, out: str) -> DataFrame:
    """`rows` with `out`: for each key of the array column `keys`, whether it is listed."""
    from pyspark.sql import types as T

    for s, cascade in enumerate(cascades):
        shared = rows.sparkSession.sparkContext.broadcast(cascade)
        again = s > 0
        schema = rows.schema if again else T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.BooleanType()))])

        def run(batches, shared=shared, s=s, again=again, schema=schema):
            for batch in batches:
                lists = batch.column(keys)
                flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
                mine = np.mod(flat, len(cascades)) == s
                listed = np.zeros(len(flat), bool)
                listed[mine] = shared.value.has(flat[mine])
                if again:
                    listed |= batch.column(out).flatten().to_numpy(zero_copy_only=False)
                column = pa.ListArray.from_arrays(pa.array(off - off[0], pa.int32()), pa.array(listed))
                rest = [batch.column(f.name) for f in schema.fields if f.name != out]
                yield pa.RecordBatch.from_arrays([*rest, column], names=[f.name for f in schema.fields if f.name != out] + [out])

        rows = storage.mapped(rows, run, schema)
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_keys(host: Column, path: Column, labels: list[int], path_lengths: list[int]) -> Column:
    """Every (host, path start) that a rule fitting the URL could have, longest first.

    Hosts are the host's last labels, as many as some rule has; path starts are of the lengths that some rule has. A
    URL thus has as many keys as rules have shapes, however long it is.
    """
    kind = "array<struct<n:int,host:string,path:string>>"
    hosts = F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in labels]))
    starts = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda s: F.struct(F.length(F.concat(h, s)).alias("n"), h.alias("host"), s.alias("path"))))).cast(kind)
    return F.when(host == "", F.array().cast(kind)).otherwise(F.reverse(F.array_sort(pairs))) if labels else F.array().cast(kind)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", names: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """`pages` with host, path, rule and verdict under `names`, which replace columns of these names.

    `rules` are (verdict, host, path start). Two cascades, over all candidate keys of the corpus, hold the rules that
    block and those that allow; the longest candidate that either lists decides. A URL that none lists is allowed.
    """
    p = storage.free(pages, "_url_")
    pairs, keys, at = (f"{p}{x}" for x in ("pairs", "keys", "at"))
    lengths, labels = sorted({len(start) for _, _, start in rules}), sorted({host.count(".") + 1 for _, host, _ in rules})
    host, path = host_and_path(F.col(url))
    rows = pages.withColumns({names[0]: host, names[1]: path}).withColumn(pairs, rule_keys(F.col(names[0]), F.col(names[1]), labels, lengths))
    rows = rows.withColumn(keys, F.transform(pairs, lambda x: key(x.host, x.path)))
    universe = storage.written(rows.select(F.explode(keys).alias("key")).distinct(), "universe")
    for verdict in ("block", "allow"):
        mine = [(h, start) for v, h, start in rules if v == verdict]
        listed = pages.sparkSession.createDataFrame(mine, "host string, path string").select(key(F.col("host"), F.col("path")).alias("key"))
        rows = with_membership(rows, build_sharded(listed, universe), keys, f"{p}{verdict}")
    block, allow = F.col(f"{p}block"), F.col(f"{p}allow")
    # array_position counts from 1 and gives 0 for none.
    rows = rows.withColumn(at, F.array_position(F.zip_with(block, allow, lambda b, a: b | a), F.lit(True)).cast("int"))
    found = F.get(pairs, F.col(at) - 1)
    rule = F.when(F.col(at) > 0, F.concat(found.host, found.path))
    verdict = F.when((F.col(at) > 0) & F.get(block, F.col(at) - 1) & ~F.get(allow, F.col(at) - 1), "block").otherwise("allow")
    return rows.withColumns({names[2]: rule, names[3]: verdict}).drop(pairs, keys, f"{p}block", f"{p}allow", at)
