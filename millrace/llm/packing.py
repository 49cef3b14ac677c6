"""Sequence packing by non-negative least squares over window-filling patterns.

Documents are tokenised once where they lie and cut at multiples of the window;
only (document, start, length, checksum) rows go on. Piece lengths are counted
in bins of ``step`` tokens. All combinations of up to three bins that fill the
window (less ``slack`` bins) are the columns of a least-squares problem whose
right side is the histogram; its non-negative solution, rounded down, says how
often each pattern is used, and what is left is packed greedily, again on
counts. Pieces then take their place by their rank within their bin, so no
sequence is ever built on the driver: it holds at most window / step counts.

Nulls and empty texts are documents of one token (the end id). Repeated rows
are packed each on their own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, gapless_rank, map_batches
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """Every document's tokens with the end id, cut into pieces of at most ``window``."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, tokens in encoder(tokenizer).encode_column(batch.column(0), batch.column(1)):
                ids = memoryview(tokens + end)
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    for column, value in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(docs.select("doc_id", "text"), cut, PIECES)


def enumerate_patterns(bins: int, slack: int, present: np.ndarray) -> np.ndarray:
    """Rows of three bins (0: unused) of which all are present and the sum is bins - slack to bins."""
    have = np.flatnonzero(present[: bins + 1])
    have = have[have > 0]
    found = [(a, 0, 0) for a in have if bins - slack <= a]
    with_zero = np.concatenate(([0], have))
    for a in have:
        for b in have[have <= min(a, bins - a)]:
            rest = with_zero[(with_zero <= b) & (with_zero >= bins - slack - a - b) & (with_zero <= bins - a - b)]
            found += [(a, b, c) for c in rest]
    return np.array(sorted(set(map(tuple, found))), dtype=np.int64).reshape(-1, 3)


def solve_nnls(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 600, tol: float = 1e-6) -> np.ndarray:
    """Lawson-Hanson active sets for min |A x - h|, x >= 0, where column p of A counts pattern p's bins."""
    n = len(patterns)
    x = np.zeros(n)
    if not n:
        return x
    scale = max(histogram.max(), 1.0)
    h = histogram / scale
    passive: list[int] = []

    def columns(which: list[int]) -> np.ndarray:
        a = np.zeros((len(h), len(which)))
        for slot in range(3):
            np.add.at(a, (patterns[which, slot], np.arange(len(which))), 1.0)
        a[0] = 0.0
        return a

    for _ in range(rounds):
        rest = h - (columns(passive) @ x[passive] if passive else 0.0)
        rest[0] = 0.0
        gain = rest[patterns].sum(axis=1)
        gain[passive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tol:
            break
        passive.append(best)
        while passive:
            s = np.linalg.lstsq(columns(passive), h, rcond=None)[0]
            if s.min() > 1e-12:
                x[:] = 0.0
                x[passive] = s
                break
            bad = s <= 1e-12
            now = x[passive]
            ratio = now[bad] / np.maximum(now[bad] - s[bad], 1e-300)
            now = now + ratio.min() * (s - now)
            x[:] = 0.0
            x[passive] = np.maximum(now, 0.0)
            keep = [p for p, v, b in zip(passive, now, bad) if not (b and v <= 1e-12)]
            if len(keep) == len(passive):
                keep.remove(passive[int(np.argmin(np.where(bad, now, np.inf)))])
            passive = keep
    return x * scale


def plan_patterns(histogram: dict[int, int], bins: int, slack: int = 2) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, how often) for all pieces: the rounded solution, then a greedy best fit of the rest."""
    left = np.zeros(bins + 1, dtype=np.int64)
    for b, n in histogram.items():
        left[b] = n
    plan = [((bins,), int(left[bins]))] if left[bins] else []
    left[bins] = 0
    patterns = enumerate_patterns(bins, slack, left > 0)
    for p, x in zip(patterns, solve_nnls(patterns, left.astype(float))):
        used = tuple(int(b) for b in p if b)
        n = min([int(x + 1e-9), *(int(left[b]) // used.count(b) for b in used)])
        if n > 0:
            plan.append((used, n))
            for b in used:
                left[b] -= n
    while left.any():
        used, room, spare = [], bins, left.copy()
        while (fits := np.flatnonzero(spare[: room + 1])).size:
            used.append(int(fits[-1]))
            spare[fits[-1]] -= 1
            room -= used[-1]
        n = min(int(left[b]) // used.count(b) for b in used)
        plan.append((tuple(used), n))
        for b in used:
            left[b] -= n
    return plan


def pack_pieces(pieces: DataFrame, window: int, step: int = 8) -> DataFrame:
    """``pieces`` (kept; read more than once) with sequence_id and offset."""
    spark = pieces.sparkSession
    bins = -(-window // step)
    binned = pieces.withColumn("_bin", F.ceil(F.col("length") / step).cast("long"))
    counts = {r["_bin"]: r["n"] for r in binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    lows, base, rows = dict.fromkeys(counts, 0), 0, {b: [] for b in counts}
    for used, n in plan_patterns(counts, bins):
        for slot, b in enumerate(used):
            rows[b].append((lows[b], lows[b] + n, base, slot))
            lows[b] += n
        base += n
    table = spark.createDataFrame(list(rows.items()), "_bin long, _at array<struct<lo:long,hi:long,base:long,slot:int>>")
    ranked = gapless_rank(binned, ["_bin"], ["doc_id", "start", "ids_crc32"], "_rank", sum(counts.values()))
    # At most window / step rows, with an entry a pattern and slot: bounded by the window, not by the corpus.
    placed = ranked.join(F.broadcast(table), "_bin").withColumn("_hit", F.filter("_at", lambda p: (F.col("_rank") >= p["lo"]) & (F.col("_rank") < p["hi"]))[0])
    placed = placed.withColumn("sequence_id", F.col("_hit.base") + F.col("_rank") - F.col("_hit.lo")).withColumn("_slot", F.col("_hit.slot"))
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack_pieces(durable(cut_documents(docs, tokenizer, window, end_id)), window)
