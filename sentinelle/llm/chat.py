"""Chat formatting from event logs.

A log has one row for each event of a conversation: its sequence number, the position of the message it concerns,
and what happened. `message` opens a message with its text, `delta` adds a streamed part, `edit` replaces the text
so far, `regenerate` empties the message and voids every earlier event of later positions, which answered a text
that is gone. Logs are dealt out by conversation and sorted; the fold then reads them as a stream and holds one
message at a time, so a conversation of any length needs the memory of its longest message.

The template writes a user's turn as `<s>[INST] text [/INST]`, an assistant's as `<s>text</s>`, any other as
`<s>[ROLE] role[/ROLE] text</s>`. Inside texts and roles a control string gets a backslash after its first
character, one more if it has some; reading back takes one away, so every text comes back exactly. The loss mask
covers each assistant text and nothing else.

Defined cases: null texts and roles are empty; a null conversation id is a conversation of its own; null positions
and sequence numbers come first; messages opened at the same position are separate turns, in order of sequence
number, role and text; extra columns are ignored; an empty log has no turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinelle.llm import storage

# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_REST = "|".join(f"{re.escape(c[0])}(?P<b{i}>\\\\*){re.escape(c[1:])}" for i, c in enumerate(CONTROL))
_ANY = re.compile(_REST)

EVENTS = "conv_id long, seq long, position long, kind string, role string, text string"
SEGMENTS = "conv_id long, turn long, segment string, loss_start long, loss_stop long"


def escape(text: str) -> str:
    return _ANY.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ANY.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and where its loss text lies in it."""
    said = escape(text)
    if role == "user":
        return f"<s>[INST] {said} [/INST]", 0, 0
    if role == "assistant":
        return f"<s>{said}</s>", 3, 3 + len(said)
    return f"<s>[ROLE] {escape(role)}[/ROLE] {said}</s>", 0, 0


def parse(written: str) -> tuple[str, str]:
    """Role and text of a segment."""
    body = written[3:]
    if body.startswith("[INST] "):
        return "user", unescape(body[7:-8])
    if body.startswith("[ROLE] "):
        role, _, said = body[7:-4].partition("[/ROLE] ")
        return unescape(role), unescape(said)
    return "assistant", unescape(body[:-4])


def _rows(batches: Iterator[pa.RecordBatch], limit: int = 1024) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            yield from batch.slice(at, limit).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row.get("segment") or "")
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=schema)


_OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_stop", pa.int64())])


def render(events: DataFrame) -> DataFrame:
    """The turns of every conversation, written by the template: one row for each, whose segments in order of `turn`
    are the formatted conversation; loss_start and loss_stop bound the loss text inside it (equal: none)."""
    columns = ("conv_id", "seq", "position", "kind", "role", "text")
    log = events.select(*columns)
    # What a regeneration voids; ranges of a null position would compare with nothing, so nulls take the lowest place.
    place = F.coalesce(F.col("position"), F.lit(-(1 << 62)))
    later = Window.partitionBy("conv_id").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("place", place).withColumn("void", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(later))
    log = log.where(F.col("void").isNull() | (F.col("seq") > F.col("void")))
    log = log.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place", F.col("seq").asc_nulls_first(), "role", "text").select("conv_id", "place", "kind", "role", "text")

    def fold(batches):
        def turns():
            at, turn, role, parts = None, 0, "", None
            for e in _rows(batches):
                here = (e["conv_id"], e["place"])
                if parts is not None and (here != at or e["kind"] == "message"):
                    written, lo, hi = segment(role, "".join(parts))
                    yield {"conv_id": at[0], "turn": turn, "segment": written, "loss_start": lo, "loss_stop": hi}
                    turn, parts = turn + 1, None
                if at is None or here[0] != at[0]:
                    turn = 0
                at = here
                if parts is None:
                    role, parts = e["role"] or "", []
                if e["kind"] in ("edit", "regenerate"):
                    parts = []
                if e["kind"] != "regenerate":
                    parts.append(e["text"] or "")
            if parts is not None:
                written, lo, hi = segment(role, "".join(parts))
                yield {"conv_id": at[0], "turn": turn, "segment": written, "loss_start": lo, "loss_stop": hi}

        yield from _batches(turns(), _OUT)

    return storage.mapped(log, fold, SEGMENTS)


_SUM = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(segments: DataFrame) -> DataFrame:
    """One row for each conversation, read back from what `render` wrote: its turns, its loss text and its length.

    The segments of a conversation are read as a stream in order of `turn`; hashes grow with it.
    """
    ordered = segments.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "turn")

    def read(batches):
        def conversations():
            at, n = object(), 0
            for s in _rows(batches):
                if s["conv_id"] != at:
                    if n:
                        yield done(at, n, turns, chars, loss, length)
                    at, n, turns, chars, loss, length = s["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                role, text = parse(s["segment"])
                turns.update(f"{role}\n{text}\n".encode())
                masked = unescape(s["segment"][s["loss_start"] : s["loss_stop"]])
                loss.update(masked.encode())
                n, chars, length = n + 1, chars + len(masked), length + len(s["segment"])
            if n:
                yield done(at, n, turns, chars, loss, length)

        def done(at, n, turns, chars, loss, length):
            return {"conv_id": at, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": length}

        yield from _batches(conversations(), _SUM)

    return storage.mapped(ordered, read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(segments: DataFrame) -> DataFrame:
    """One row for each conversation with its whole formatted text; for conversations that fit a row."""
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "segment"))), lambda s: s.segment), "").alias("formatted"))
