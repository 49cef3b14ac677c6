"""Chat formatting by columnar byte assembly.

A turn becomes ``<s>[INST] role [/INST]text</s>``. Control strings inside roles
and texts are escaped, so the output holds them only where the template put
them, and unescaping gives every text back. Turns of a conversation are brought
together and ordered by the engine's shuffle and sort; a batch of turns is then
formatted as a whole: segment lengths, their running sum and the places of all
bytes are numpy arrays, and headers and contents are copied into one buffer
that becomes the output column. Loss spans are the assistants' texts.

A conversation's turns may lie in several batches, so it is written as parts
(conv_id, part, formatted, loss spans in bytes) that follow each other in the
output; no conversation is ever gathered into one row, however long.

Null texts and roles are empty. A null conv_id is a conversation of its own. A
null turn comes first; equal turns are ordered by role, then text, and repeated
rows all stay. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# The template's control strings, and the escapes of those and of the escape character.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
ESCAPES = (("\\", "\\\\"), ("<s>", "\\(s>"), ("</s>", "\\(/s>"), ("[INST]", "\\{INST]"), ("[/INST]", "\\{/INST]"))
BACK = {"\\\\": "\\", "\\(": "<", "\\{": "["}
ESCAPED = re.compile(r"\\[\\({]")
PARTS = "conv_id long, part long, formatted string, loss array<struct<start:bigint,end:bigint>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(column: pa.Array) -> pa.Array:
    for raw, safe in ESCAPES:
        column = pc.replace_substring(column, raw, safe)
    return column


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: BACK[m[0]], text) if "\\" in text else text


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the lengths of its values."""
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and len(column) else np.empty(0, np.uint8), np.diff(ends)


def scatter(out: np.ndarray, places: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
    """Copy ``data``, segments of ``lengths``, to ``places`` of ``out``."""
    shift = places - (np.cumsum(lengths) - lengths)
    out[np.repeat(shift, lengths) + np.arange(len(data))] = data


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array, assistant: np.ndarray) -> tuple[np.ndarray, pa.Array, list[list[dict]]]:
    """First rows of the conversations in a batch of turns in order, their formatted texts and loss spans."""
    n = len(conv)
    fixed = [np.frombuffer(s.encode(), np.uint8) for s in (OPEN, MIDDLE, CLOSE)]
    (role, role_n), (text, text_n) = bytes_of(escape(roles)), bytes_of(escape(texts))
    parts = np.empty((n, 5), np.int64)
    parts[:, 0], parts[:, 1], parts[:, 2], parts[:, 3], parts[:, 4] = len(fixed[0]), role_n, len(fixed[1]), text_n, len(fixed[2])
    ends = np.cumsum(parts.ravel()).reshape(n, 5)
    at = ends - parts
    out = np.empty(int(ends[-1, -1]), np.uint8)
    for k, segment in zip((0, 2, 4), fixed):
        out[at[:, k][:, None] + np.arange(len(segment))] = segment
    scatter(out, at[:, 1], role_n, role)
    scatter(out, at[:, 3], text_n, text)
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    offsets = np.append(at[first, 0], ends[-1, -1])
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    group = np.searchsorted(first, np.arange(n), side="right") - 1
    spans: list[list[dict]] = [[] for _ in first]
    for r in np.flatnonzero(assistant):
        g = group[r]
        spans[g].append({"start": int(at[r, 3] - offsets[g]), "end": int(ends[r, 3] - offsets[g])})
    return first, formatted.cast(pa.string()), spans


def format_chats(conversations: DataFrame) -> DataFrame:
    """Parts of formatted conversations, each conversation's in order within one partition."""
    text, role = (F.coalesce(c, F.lit("")).alias(c) for c in ("text", "role"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role, text)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            # Nulls sort first and get a number that none of the batch's ids has.
            conv = np.unique(np.array([(0, 0) if v is None else (1, v) for v in ids.to_pylist()], np.int64), axis=0, return_inverse=True)[1].ravel()
            first, formatted, loss = assemble(conv, b.column(2), b.column(3), pc.equal(b.column(2), "assistant").to_numpy(zero_copy_only=False))
            names = [ids[int(i)].as_py() for i in first]
            numbers = [0] * len(names)
            if names[0] == last:
                numbers[0] = part + 1
            last, part = names[-1], numbers[-1]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(numbers, pa.int64()), formatted, pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv_id", "part", "formatted", "loss"])

    return map_batches(rows, per_batch, PARTS)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn, unescaped."""
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn[len(OPEN) :].partition(MIDDLE)
        yield unescape(role), unescape(text)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of the conversations in ``parts``, as ``format_chats`` orders them; one running state a task."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], [c.split()[0] for c in DIGESTS.split(", ")])

        for b in batches:
            for conv, text, loss in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                raw = text.encode()
                for span in loss:
                    said = unescape(raw[span["start"] : span["end"]].decode())
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield out()
                done.clear()
        close()
        if done:
            yield out()

    return map_batches(parts, per_batch, DIGESTS)
