"""History read in windows, each of a page's size, and the walk back through it.

A page of a provider holds at most `cap` records. Windows of `step` are halved, down to `least`, until each fits; what
fits is known beforehand from the counts by time bin, which Spark takes once (`bins`). `HistorySource` then reads the
windows as a batch, or backwards as a stream whose offset is the frontier: how far back everything is read.

    history.bins(spark.read.parquet(path), "ts", least).write.parquet(counts)
    spark.dataSource.register(history.HistorySource)
    spark.read.format("history").options(path=path, bins=counts, column="ts", least=least, step=step, cap=cap).load()

Times are microseconds of the epoch. Rows without a time are in no window. A bin that alone holds more than `cap` is one
window, read whole and marked truncated, since a provider would have cut it short.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructType

#: Columns that the source adds: the window a row was read by, and whether it holds more than a page.
ADDED = ("_window_from", "_window_to", "_truncated")
#: Records that a task reads, in as many windows as hold them.
ROWS = 100_000


def capped_windows(since: int, until: int, least: int, truncated) -> list[tuple[int, int]]:
    """Windows to fetch so that no page is cut short: a window whose page is, is halved, down to `least`."""
    todo, done = [(since, until)], []
    while todo:
        a, b = todo.pop()
        if truncated(a, b) and (b - a) // 2 >= least:
            mid = (a + b) // 2
            todo += [(mid, b), (a, mid)]
        else:
            done.append((a, b))
    return done


def backfill_frontier(old: DataFrame, new: DataFrame) -> DataFrame:
    """Checkpoints by source: a frontier only ever moves back."""
    return old.unionByName(new).groupBy("source").agg(F.min("frontier").alias("frontier"))


def backfilled(frontier: int, horizon: int, step: int, least: int, budget: int, truncated) -> tuple[list[tuple[int, int]], int]:
    """Windows to fetch on a walk back from `frontier` to `horizon`, and the new frontier.

    The walk goes in windows of `step`, each halved while its page is cut short. At most `budget` pages are asked for;
    the frontier moves past a window only once all of it is read.
    """
    found: list[tuple[int, int]] = []
    asked = 0

    def counted(a, b):
        nonlocal asked
        asked += 1
        return truncated(a, b)

    while frontier > horizon and asked < budget:
        since = max(horizon, frontier - step)
        windows = capped_windows(since, frontier, least, counted)
        if asked > budget:
            break
        found += windows
        frontier = since
    return found, frontier


def bins(df: DataFrame, column: str, least: int) -> DataFrame:
    """(bin, file, n): records by time bin of `least` and file. A table that lands in order of time has about as many
    rows here as files and bins together; the counts, not the records, are what the planner reads."""
    at = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({column} AS timestamp_ntz))")
    rows = df.select(F.floor(at / F.lit(least)).alias("bin"), F.col("_metadata.file_path").alias("file")).where("bin is not null")
    return rows.groupBy("bin", "file").agg(F.count("*").alias("n"))


class Planned:
    """The counts as running sums, from which the size of any window of whole bins is two look-ups."""

    def __init__(self, counts: list[tuple[int, str, int]], least: int):
        self.least = least
        self.files: dict[int, list[str]] = {}
        sizes: dict[int, int] = {}
        for b, file, n in counts:
            sizes[b] = sizes.get(b, 0) + n
            self.files.setdefault(b, []).append(file)
        self.at = sorted(sizes)
        self.upto = [0, *accumulate(sizes[b] for b in self.at)]

    def span(self) -> tuple[int, int]:
        return (self.at[0] * self.least, (self.at[-1] + 1) * self.least) if self.at else (0, 0)

    def _edges(self, a: int, b: int) -> tuple[int, int]:
        return bisect_left(self.at, a // self.least), bisect_left(self.at, -(-b // self.least))

    def size(self, a: int, b: int) -> int:
        i, j = self._edges(a, b)
        return self.upto[j] - self.upto[i]

    def of(self, a: int, b: int) -> list[str]:
        i, j = self._edges(a, b)
        return sorted({f for b in self.at[i:j] for f in self.files[b]})

    def walk(self, until: int, horizon: int, step: int, cap: int) -> list[tuple[int, int]]:
        """Windows from `until` back to `horizon`, newest step first; empty ones go.

        Steps are whole from the end of `until`'s bin on, so that halves are whole bins, and cut at the two limits after.
        """
        last = -(-until // self.least) * self.least
        first = last - -(-(last - horizon) // step) * step
        found, _ = backfilled(last, first, step, self.least, 1 << 62, lambda a, b: self.size(a, b) > cap)
        return [(max(a, horizon), min(b, until)) for a, b in found if self.size(a, b) and a < until and b > horizon]


@dataclass
class Windows(InputPartition):
    """Neighbouring windows, (from, to, truncated) each, that one task reads."""

    pages: list
    files: list


class _Reader:
    """What both ways of reading share: the options, the plan, and the reading of one window."""

    def __init__(self, options, schema: StructType):
        self.options, self.schema = options, schema
        self.column = options["column"]
        self.least, self.step, self.cap = (int(options[k]) for k in ("least", "step", "cap"))
        if self.step % self.least or (self.step // self.least) & (self.step // self.least - 1):
            raise ValueError("step must be least times a power of two, so that halves are whole bins")

    def planned(self) -> Planned:
        table = _dataset([self.options["bins"]]).to_table(columns=["bin", "file", "n"])
        return Planned(list(zip(*(table[c].to_pylist() for c in ("bin", "file", "n")), strict=True)), self.least)

    def windows(self, plan: Planned, until: int, horizon: int) -> list[Windows]:
        """One task for each ROWS records; a window is never cut. A task's windows are neighbours, since it reads all that
        lies between its first and its last one: `walk` has steps newest first but the windows in a step oldest first."""
        parts: list[Windows] = []
        room = 0
        for a, b in sorted(plan.walk(until, horizon, self.step, self.cap), reverse=True):
            n = plan.size(a, b)
            if room < n or not parts:
                parts.append(Windows([], []))
                room = ROWS
            parts[-1].pages.append((a, b, n > self.cap))
            room -= n
        for part in parts:
            part.files = plan.of(min(a for a, _, _ in part.pages), max(b for _, b, _ in part.pages))
        return parts

    def read(self, partition: Windows | None) -> Iterator[pa.RecordBatch]:
        """The records of some windows in one scan, a batch at a time; row groups outside are passed over by their
        statistics. Spark asks with None where there are no windows."""
        if partition is None:
            return
        data = _dataset(partition.files)
        kind = data.schema.field(self.column).type
        edge = lambda v: pa.scalar(int(v), pa.timestamp("us", getattr(kind, "tz", None))).cast(kind, safe=False)
        at = ds.field(self.column)
        names = [f.name for f in self.schema.fields if f.name not in ADDED]
        pages = np.array(sorted(partition.pages), dtype=np.int64)
        batches = data.scanner(columns=names, filter=(at >= edge(pages[0, 0])) & (at < edge(pages[-1, 1])), batch_size=8192).to_batches()
        for batch in batches:
            # Whatever lies between two windows is in a window of no records, so the last one begun is a record's own.
            times = batch.column(names.index(self.column)).cast(pa.timestamp("us", getattr(kind, "tz", None)), safe=False).cast(pa.int64())
            own = pages[np.searchsorted(pages[:, 0], times.to_numpy(zero_copy_only=False), side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(own[:, k]) for k in range(3)]], names=[*names, *ADDED])


def _dataset(paths: list[str]) -> ds.Dataset:
    """A dataset over files or one folder, on whatever file system their address names."""
    system, first = fs.FileSystem.from_uri(paths[0]) if "://" in paths[0] or paths[0].startswith("file:") else (fs.LocalFileSystem(), paths[0])
    if len(paths) == 1:
        return ds.dataset(unquote(first), filesystem=system, format="parquet")
    return ds.dataset([unquote(fs.FileSystem.from_uri(p)[1]) for p in paths], filesystem=system, format="parquet")


class HistoryReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Windows]:
        plan = self.planned()
        low, high = plan.span()
        until, horizon = int(self.options.get("until", high)), int(self.options.get("horizon", low))
        return self.windows(plan, until, horizon)


class HistoryWalk(_Reader, DataSourceStreamReader):
    """The walk back: each batch is one `step` further. The frontier is kept in the file `frontier` as well, written when
    a batch is planned: Spark runs a planned batch again until it is done, so the file never runs ahead of the stream."""

    def _limits(self) -> tuple[int, int]:
        low, high = self.planned().span()
        return int(self.options.get("until", high)), int(self.options.get("horizon", low))

    def _file(self) -> tuple[fs.FileSystem, str]:
        place = self.options["frontier"]
        return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)

    def _kept(self) -> int | None:
        system, path = self._file()
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(path) as f:
            return json.loads(f.read())["frontier"]

    def initialOffset(self) -> dict:
        return {"frontier": self._limits()[0]}

    def latestOffset(self) -> dict:
        until, horizon = self._limits()
        kept = self._kept()
        frontier = until if kept is None else kept
        return {"frontier": max(min(horizon, frontier), frontier - self.step)}

    def partitions(self, start: dict, end: dict) -> list[Windows]:
        system, path = self._file()
        kept = self._kept()
        if kept is None or end["frontier"] < kept:
            with system.open_output_stream(path) as f:
                f.write(json.dumps(end).encode())
        return self.windows(self.planned(), start["frontier"], end["frontier"])

    def commit(self, end: dict) -> None:
        """Nothing to release: windows are read from a table that stays."""


class HistorySource(DataSource):
    """Options: path, bins (the table that `bins` gave), column, least, step, cap; until and horizon (default: what the
    counts span); for a stream, frontier (a file)."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        out = from_arrow_schema(_dataset([self.options["path"]]).schema)
        clash = [c for c in ADDED if c in out.names]
        if clash:
            raise ValueError(f"the table has columns of the source's own names: {clash}")
        for c in ADDED:
            out = out.add(c, LongType())
        return out

    def reader(self, schema: StructType) -> HistoryReader:
        return HistoryReader(self.options, schema)

    def streamReader(self, schema: StructType) -> HistoryWalk:
        return HistoryWalk(self.options, schema)
