"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are made where the documents lie. Copies fold into one row a
fingerprint before anything else is shuffled. Two fingerprints that differ in
at most ``budget`` bits agree wholly in one of ``budget`` + 1 blocks of bits, so
the fingerprints are written, turned so that each block leads in turn, to one
trie a turn in which the top levels have no error budget: a trie's subtrees
below its leading block are independent groups, and whole subtrees are dealt
out to tasks. A subtree too large for a task is dealt out again in the same way
by the bits below its leading block. In a task, pairs of trie nodes are walked down together, bit by
bit: differing bits add up, and a pair is dropped once it exceeds the budget.
Links between different fingerprints are bounded by the trie, never by the
square of a group of copies. Components follow from alternating large-star and
small-star steps on the links.

A null or empty text has no words and fingerprint zero, linked like any other.
Very long texts are hashed in parts. Repeated rows share all they get. Rows
without doc_id get their group's smallest doc_id, which is null if no row of the
group has one. Other columns, whatever their names, are not read, and
``keep_one`` returns them unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, free, map_batches

#: For a byte v, the 64-bit number whose byte k is bit k of v: adding such numbers counts eight bits at once.
SPREAD = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], dtype="<u8")
PART = 1 << 18
#: Up to so many rows a table of keys is broadcast.
SMALL = 500_000


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``h`` (some, at most PART) have each bit."""
    spread = SPREAD[h.view(np.uint8)].reshape(len(h), 8)
    sums = np.add.reduceat(spread, np.arange(0, len(h), 255), axis=0)  # bytes can't overflow within 255 rows
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of hashes; 0 of none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), PART):
        counts += bit_counts(hashes[at : at + PART])
    return packed(2 * counts > len(hashes))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words) - width + 1
    if not words:
        return 0
    if n < 2:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, PART):
        counts += bit_counts(np.fromiter(hashes, dtype="<u8", count=min(PART, n - at)))
    return packed(2 * counts > n)


def text_hash() -> Column:
    return F.xxhash64("text")


def small(df: DataFrame) -> DataFrame:
    """``df`` (kept; read more than once), to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_hash and fp of every row."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), width) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text")
    return map_batches(rows, per_batch, "doc_id long, text_hash long, fp long")


def walk_tries(keys: np.ndarray, first: np.ndarray, lead: np.ndarray, budget: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in ``keys`` that differ in at most ``budget`` bits.

    ``keys`` are sorted within subtrees; ``first`` are the subtrees' first
    positions and ``lead`` the number of leading bits that all of one share.
    At most ``most`` node pairs are expanded at once; others wait.
    """
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ends = np.append(first[1:], len(keys))
    zeros: dict[int, np.ndarray] = {}
    for start in np.unique(lead):
        mine = (lead == start) & (ends - first > 1)
        a0, a1 = first[mine], ends[mine]
        waiting = [(int(start), a0, a1, a0, a1, np.zeros(len(a0), np.int64))]
        while waiting:
            level, a0, a1, b0, b1, d = waiting.pop()
            while len(a0):
                if len(a0) > most:
                    cut = len(a0) // 2
                    waiting.append((level, a0[cut:], a1[cut:], b0[cut:], b1[cut:], d[cut:]))
                    a0, a1, b0, b1, d = a0[:cut], a1[:cut], b0[:cut], b1[:cut], d[:cut]
                single = (a1 - a0 == 1) & (b1 - b0 == 1)  # two leaves: the rest of the path is plain
                i, j = a0[single], b0[single]
                near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
                out_a.append(i[near])
                out_b.append(j[near])
                open_ = ~single
                a0, a1, b0, b1, d = a0[open_], a1[open_], b0[open_], b1[open_], d[open_]
                if not len(a0):
                    break
                if level not in zeros:
                    bit = (keys >> np.uint64(63 - level)) & np.uint64(1)
                    zeros[level] = np.concatenate(([0], np.cumsum(bit == 0)))
                z = zeros[level]
                am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
                both = a0 != b0  # a node with itself has its mixed pair once
                parts = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), (am[both], a1[both], b0[both], bm[both], d[both] + 1)]
                a0, a1, b0, b1, d = (np.concatenate(x) for x in zip(*parts))
                keep = (a1 > a0) & (b1 > b0) & (d <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
                a0, a1, b0, b1, d = a0[keep], a1[keep], b0[keep], b1[keep], d[keep]
                level += 1
    return np.concatenate(out_a), np.concatenate(out_b)


def splits(budget: int, per_subtree: int) -> list[tuple[int, int]]:
    """(bits agreed on before, bits of a block) of each dealing out, until no subtree can hold more than ``per_subtree`` prints."""
    out, lead = [], 0
    while (64 - lead) // (budget + 1) and (not out or 1 << (64 - lead) > per_subtree):
        out.append((lead, (64 - lead) // (budget + 1)))
        lead += out[-1][1]
    return out


def turned(keys: np.ndarray, lead: int, by: int) -> np.ndarray:
    """``keys`` with the bits below the leading ``lead`` turned left by ``by``."""
    if not by:
        return keys
    mask = (1 << (64 - lead)) - 1
    low = keys & mask
    return (keys ^ low) | (((low << by) | (low >> (64 - lead - by))) & mask)


def deal(rows: DataFrame, lead: int, size: int, blocks: int) -> DataFrame:
    """``rows`` (fp, key, path) once for each block, with that block of ``key`` turned to the front and noted in ``path``."""
    mask = -1 if lead == 0 else (1 << (64 - lead)) - 1
    low = F.col("key").bitwiseAND(F.lit(mask))

    def turn(k: int):
        if not k:
            return F.col("key")
        moved = F.shiftleft(low, k * size).bitwiseOR(F.shiftrightunsigned(low, 64 - lead - k * size)).bitwiseAND(F.lit(mask))
        return F.col("key").bitwiseXOR(low).bitwiseOR(moved)

    turns = F.array(*(F.struct(turn(k).alias("key"), (F.col("path") * blocks + k).alias("path")) for k in range(blocks)))
    return rows.select("fp", F.explode(turns).alias("t")).select("fp", "t.key", "t.path", F.shiftrightunsigned("t.key", 64 - lead - size).alias("prefix"))


def trie_self_join(prints: DataFrame, budget: int = 2, per_task: int = 4_000, per_subtree: int = 20_000) -> DataFrame:
    """Links (a, b) between the distinct values ``fp`` that differ in at most ``budget`` bits, each once.

    A subtree of more than ``per_subtree`` prints is dealt out again by blocks
    of the bits below its leading ones, so no task holds a group that grows with
    the input: the bits that are left bound it.
    """
    n, levels = budget + 1, splits(budget, per_subtree)

    def joiner(depth: int):
        below = sum(levels[depth - 1])

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            fp, keys, path = pdf["fp"].to_numpy().view(np.uint64), pdf["key"].to_numpy().view(np.uint64), pdf["path"].to_numpy()
            order = np.lexsort((keys, path))
            fp, keys, path = fp[order], keys[order], path[order]
            prefix = keys >> np.uint64(64 - below)
            first = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (prefix[1:] != prefix[:-1])])
            i, j = walk_tries(keys, first, np.full(len(first), below), budget)
            a, b, path = fp[i], fp[j], path[i]
            x, own = a ^ b, np.ones(len(i), dtype=bool)
            for k, (lead, size) in enumerate(levels[:depth]):  # a pair that agrees in an earlier block is found there
                block = path // n ** (depth - 1 - k) % n
                for q in range(n - 1):
                    own &= ~((((x << np.uint64(lead + q * size)) >> np.uint64(64 - size)) == 0) & (q < block))
                x = np.select([block == q for q in range(n)], [turned(x, lead, q * size) for q in range(n)])
            a, b = a[own].view(np.int64), b[own].view(np.int64)
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

        return join

    links, rows = None, prints.select("fp", F.col("fp").alias("key"), F.lit(0).cast("long").alias("path"))
    for depth, (lead, size) in enumerate(levels, 1):
        bins = max(1, -(-rows.count() * n // per_task))
        rows, hot = deal(rows, lead, size, n), None
        if depth < len(levels):
            hot = durable(rows.groupBy("path", "prefix").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > per_subtree).select("path", "prefix"))
            many = hot.count()
            hot = None if not many else F.broadcast(hot) if many <= 100_000 else hot
        few = rows if hot is None else rows.join(hot, ["path", "prefix"], "left_anti")
        binned = few.select("fp", "key", "path", F.pmod(F.xxhash64("path", "prefix"), F.lit(bins)).alias("bin"))
        found = binned.groupBy("bin").applyInPandas(joiner(depth), "a long, b long")
        links = found if links is None else links.union(found)
        if hot is None:
            break
        rows = durable(rows.join(hot, ["path", "prefix"], "left_semi").select("fp", "key", "path"))
    return links


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, root of every node of ``edges`` (u, v), where root is the smallest node reachable.

    Large-star and small-star steps in turn, each a partial aggregate and a
    join on the node, until the edges are stars; a hub's edges are split by
    the engine's skew handling and no neighbourhood is gathered into a row.
    ``rounds`` (they grow with the logarithm of the longest chain) that don't
    settle are an error.
    """
    def stamp(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    was, settled = stamp(e), False
    for _ in range(rounds):
        settled = was[0] == 0
        if settled:
            break
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = durable(small.filter("u > v").distinct())
        now = stamp(e)
        settled = now == was
        if settled:
            break
        was = now
    if not settled:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grouped(prints: DataFrame, budget: int) -> DataFrame:
    """``prints`` (kept) with root (the fingerprint that names the group) and component_id."""
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = trie_self_join(distinct.select("fp"), budget)
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    groups = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "root", "component_id")
    return prints.join(groups, "fp")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fp, root (the fingerprint that names the group) and component_id of every row."""
    return grouped(durable(fingerprints(docs, width)), budget).select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of ``found`` (doc_id, text_hash, root; a row for each of docs).

    It is the one with the smallest doc_id (rows without come last), then text hash. What goes is told by both,
    so a doc_id under several texts loses no group; rows that repeat both are one.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    groups = durable(found.groupBy("root").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", F.struct("best.doc_id", "best.text_hash").alias("best")))
    mine = F.struct("doc_id", "text_hash")
    key = free(docs.columns, "_key")
    keys = (F.col("doc_id").alias(f"{key}_id"), F.col("text_hash").alias(f"{key}_hash"))
    gone = found.join(small(groups), "root").filter(~mine.eqNullSafe(F.col("best"))).select(*keys).distinct()
    again = durable(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys))

    def match(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, (text_hash() == keys[f"{key}_hash"]) & rows["doc_id"].cast("long").eqNullSafe(keys[f"{key}_id"]), how)

    kept = match(docs, small(durable(gone)), "left_anti")
    if not again.isEmpty():  # rows that repeat id and text: one of them
        kept = match(kept, again, "left_anti").unionByName(match(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept


def keep_one(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """``docs`` with one row of each group: one with its smallest doc_id."""
    found = durable(grouped(durable(fingerprints(docs, width)), budget).select("doc_id", "text_hash", "root"))
    return one_of_each(docs, found)
