"""Benchmark decontamination by a prefix-filtered set join.

An item's windows of ``window`` words are sets of word shingles; an occurrence
holds all of them, so the necessary prefix is a window's rarest shingle. One
pass counts the benchmark's shingles over all documents. A second pass looks up
each document's shingles among the windows' rarest ones; a match fixes where
the window would start, which must lie within the document (positional and
length bounds), and the words are then compared one by one.

A benchmark of at most ``block_chars`` characters is an index that is broadcast,
and documents are judged where they lie. A larger one stays in tables: bits of
its shingles' hashes, of a bounded size, tell which of a document's shingles are
worth sending, and these are joined with counts and prefixes by shuffles, each
with the words around it, to be verified in the join. Both ways take two passes
over the documents and give the same result.

Null and empty texts have no words: such documents are clean and such items
have no windows. Repeated items count once by item_id; a null item_id is named
``null``. Repeated documents are judged alike; empty tables give empty or clean
results. Very long texts are split into words in parts. Other columns, whatever
their names, come back unchanged.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, free, judged, map_batches, named
from .licenses import words_of
from .neardup import PLACES, mixed, word_hashes
from .simhash import small

#: Lower-cases A-Z and turns every byte that is in no word into a space.
TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
PART = 1 << 22


def word_ids(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The ids of all words of ``text``; -1 for words that aren't ``known``."""
    data, at, parts = (text or "").encode("utf-8", "surrogatepass").translate(TABLE), 0, []
    while at < len(data):
        end = data.find(b" ", at + PART) if len(data) - at > PART else -1
        words = data[at : end if end >= 0 else len(data)].split()
        parts.append(np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words)))
        at = end if end >= 0 else len(data)
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


@dataclass
class Index:
    """Items: their words, windows and shingles, by number."""

    words: dict[bytes, int]
    lengths: np.ndarray  # of windows
    matrix: np.ndarray  # windows by words, padded
    items: list[list[str]]  # of windows
    width: int
    codes: dict[int, np.ndarray]  # by shingle size, sorted
    window_codes: list[tuple[int, list[int]]]  # shingle size and shingles of windows

    def shingles(self, ids: np.ndarray, k: int) -> np.ndarray:
        """One number for each run of ``k`` known words, -1 for others."""
        n = len(ids) - k + 1
        if n < 1:
            return np.empty(0, np.int64)
        out, ok = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(k):
            part = ids[i : i + n]
            out = out * (len(self.words) + 1) + part
            ok &= part >= 0
        return np.where(ok, out, -1)

    def places(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the items' shingles of size ``k`` and their numbers."""
        table = self.codes[k]
        s = self.shingles(ids, k)
        at = np.minimum(np.searchsorted(table, s), len(table) - 1)
        hit = np.flatnonzero(table[at] == s)
        return hit, at[hit]


def build_index(items: list[tuple[str, str]], window: int, width: int) -> Index:
    words: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, text in items:
        own = [words.setdefault(w, len(words)) for w in (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()]
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            windows[tuple(own[i : i + size])].add(item)
    keys = list(windows)
    matrix = np.full((len(keys), window), -1, np.int64)
    for r, k in enumerate(keys):
        matrix[r, : len(k)] = k
    index = Index(words, np.array([len(k) for k in keys], np.int64), matrix, [sorted(windows[k]) for k in keys], width, {}, [])
    sizes = [min(width, len(k)) for k in keys]
    own = [index.shingles(np.array(k, np.int64), s) for k, s in zip(keys, sizes)]
    for s in set(sizes):
        index.codes[s] = np.unique(np.concatenate([o for o, z in zip(own, sizes) if z == s]))
    index.window_codes = [(s, np.searchsorted(index.codes[s], o).tolist()) for o, s in zip(own, sizes)]
    return index


def count_shingles(docs: DataFrame, shared, sizes: list[int]) -> dict[tuple[int, int], int]:
    """Occurrences of the items' shingles over all documents; one row a shingle reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        sums = {k: np.zeros(len(index.codes[k]), np.int64) for k in sizes}
        for batch in batches:
            for text in batch.column(0):
                ids = word_ids(text.as_py(), index.words)
                for k in sizes:
                    np.add.at(sums[k], index.places(ids, k)[1], 1)
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], ["k", "shingle", "n"])

    rows = map_batches(docs.select("text"), count, "k long, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n").alias("n")).collect()
    return {(r["k"], r["shingle"]): r["n"] for r in rows}


def prefix_tables(index: Index, counts: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By shingle size: the shingles that are some window's rarest, sorted, with that window and the place in it."""
    rows = defaultdict(list)
    for w, (k, own) in enumerate(index.window_codes):
        place = min(range(len(own)), key=lambda i: (counts.get((k, own[i]), 0), own[i], i))
        rows[k].append((own[place], w, place))
    return {k: tuple(np.array(c, np.int64) for c in zip(*sorted(r))) for k, r in rows.items()}


def find_windows(ids: np.ndarray, index: Index, prefix: dict) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every occurrence of a window in a document."""
    starts, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k, (shingle, window, place) in prefix.items():
        at, code = index.places(ids, k)
        lo, hi = np.searchsorted(shingle, code), np.searchsorted(shingle, code, side="right")
        n = hi - lo
        if not n.sum():
            continue
        row = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        start, w = np.repeat(at, n) - place[row], window[row]
        size = index.lengths[w]
        ok = (start >= 0) & (start + size <= len(ids))
        start, w, size = start[ok], w[ok], size[ok]
        same = np.ones(len(w), bool)
        for i in range(index.matrix.shape[1]):
            here = i < size
            same[here] &= ids[start[here] + i] == index.matrix[w[here], i]
        starts.append(start[same])
        found.append(w[same])
    return np.concatenate(starts), np.concatenate(found)


def named_items(benchmark: DataFrame) -> DataFrame:
    return benchmark.filter("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")


def by_index(docs: DataFrame, items: list[tuple[str, str]], window: int, width: int, name: str) -> DataFrame:
    """The way for a benchmark that can be broadcast."""
    sc, index = docs.sparkSession.sparkContext, build_index(items, window, width)
    shared = sc.broadcast(index) if index.items else None
    prefix = sc.broadcast(prefix_tables(index, count_shingles(docs, shared, sorted(index.codes)))) if shared else None
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def judge(text: str | None) -> dict:
        ids, found = word_ids(text, shared.value.words if shared else {}), set()
        hit = np.zeros(len(ids) + 1, np.int64)
        if shared:
            starts, windows = find_windows(ids, shared.value, prefix.value)
            np.add.at(hit, starts, 1)
            np.add.at(hit, starts + shared.value.lengths[windows], -1)
            for w in np.unique(windows):
                found.update(shared.value.items[w])
        n = int((np.cumsum(hit)[:-1] > 0).sum())
        return {"n_words": len(ids), "n_hit": n, "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": n > 0}

    def per_batch(texts: pa.Array) -> pa.Array:
        return pa.array([judge(t.as_py()) for t in texts], kind)

    return judged(docs, per_batch, name, "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean>")


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words, given the words' hashes."""
    n = max(len(words) - k + 1, 0)
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += words[i : i + n] * PLACES[i]
    return mixed(total)


def plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE)


def window_table(items: DataFrame, window: int, width: int) -> DataFrame:
    """item, words, size and shingles (hashes in turn) of every window of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for item, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = plain(text.as_py()).split()
                size = min(window, len(words))
                hashes = shingle_hashes(word_hashes(b" ".join(words)), min(width, size)).view(np.int64) if size else []
                each = size - min(width, size) + 1
                for i in range(len(words) - size + 1 if size else 0):
                    for column, value in zip(out, (item, b" ".join(words[i : i + size]).decode(), size, hashes[i : i + each])):
                        column.append(value)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["item", "words", "size", "shingles"])

    return map_batches(items, cut, "item string, words string, size long, shingles array<bigint>")


def bits_of(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """A bit for the last digits of every ``s`` of ``hashes``, about eight times as many as these; only the bits reach the driver."""
    n = hashes.count()
    size = min(most_bits, 1 << max(10, (8 * n).bit_length()))
    at = F.col("s").bitwiseAND(size - 1)
    rows = hashes.groupBy(F.shiftright(at, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(31).cast("int"))).alias("v")).toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy().astype(np.uint32)
    return out


def worth(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of ``hashes`` that have their bit."""
    at = hashes & np.uint64(32 * len(bits) - 1)
    return np.flatnonzero((bits[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1))


def text_keys() -> list[Column]:
    """What tells different texts apart."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def by_joins(docs: DataFrame, items: DataFrame, window: int, width: int, name: str, most_bits: int = 1 << 30) -> DataFrame:
    """The way for a benchmark of any size."""
    sc, texts = docs.sparkSession.sparkContext, docs.select("text")
    windows = durable(window_table(items, window, width))
    distinct = durable(windows.dropDuplicates(["words"]).select("words", "size", "shingles"))
    sizes = [r["k"] for r in distinct.select(F.least("size", F.lit(width)).alias("k")).distinct().collect()]
    shingles = durable(distinct.select(F.explode("shingles").alias("s")).distinct())
    known = sc.broadcast(bits_of(shingles, most_bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.empty(0, np.uint64)]
            for text in b.column(0):
                words = word_hashes(plain(text.as_py()))
                for k in sizes:
                    own = shingle_hashes(words, k)
                    found.append(own[worth(own, known.value)])
            s, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], ["s", "n"])

    counts = map_batches(texts, count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    counts = durable(shingles.join(counts, "s", "left").select("s", F.coalesce("n", F.lit(0)).alias("n")))
    rarest = distinct.select("words", "size", F.posexplode("shingles").alias("place", "s")).join(counts, "s")
    rarest = rarest.groupBy("words", "size").agg(F.min(F.struct("n", "s", "place")).alias("r"))
    prefix = durable(rarest.select("words", "size", "r.s", F.col("r.place").cast("long").alias("place")))
    wanted = sc.broadcast(bits_of(prefix.select("s").distinct(), most_bits))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each place of a document whose shingle may be a prefix, with the words around it."""
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for h1, h2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data, words = plain(text.as_py()), None
                hashes = word_hashes(data)
                for k in sizes:
                    own = shingle_hashes(hashes, k)
                    for at in worth(own, wanted.value).tolist():
                        words = words or data.split()
                        first = max(0, at - window + 1)
                        for column, value in zip(out, (h1, h2, int(own[at].view(np.int64)), at, first, b" ".join(words[first : at + window]).decode())):
                            column.append(value)
            kinds = (pa.int64(),) * 5 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["h1", "h2", "s", "at", "first", "around"])

    places = map_batches(docs.select(*text_keys(), "text"), look, "h1 long, h2 long, s long, at long, first long, around string")
    start = F.col("at") - F.col("place")
    # An occurrence that would begin before the words around, or end after them, leaves the document.
    same = F.array_join(F.slice(F.split("around", " "), (F.greatest(start - F.col("first"), F.lit(0)) + 1).cast("int"), F.col("size").cast("int")), " ") == F.col("words")
    hits = places.join(small(prefix), "s").filter((start >= F.col("first")) & same)
    hits = durable(hits.select("h1", "h2", start.alias("start"), "size", "words").distinct())
    seen = F.max(F.col("start") + F.col("size")).over(Window.partitionBy("h1", "h2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", F.coalesce(seen, F.lit(0))))
    covered = hits.groupBy("h1", "h2", "start").agg(F.max("size").alias("size")).withColumn("fresh", fresh).groupBy("h1", "h2").agg(F.sum("fresh").alias("n_hit"))
    listed = hits.select("h1", "h2", "words").distinct().join(windows.select("words", "item").distinct(), "words").select("h1", "h2", "item").distinct()
    listed = listed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    found = durable(covered.join(listed, ["h1", "h2"]))
    mine = free(docs.columns, "_d_")
    found = small(found.toDF(*(f"{mine}{c}" for c in found.columns)))
    first, second = text_keys()
    rows = docs.withColumns({f"{mine}h1": first, f"{mine}h2": second}).join(found, [f"{mine}h1", f"{mine}h2"], "left")
    verdict = F.struct(
        F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        F.coalesce(f"{mine}n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(f"{mine}n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(f"{mine}items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col(f"{mine}n_hit").isNotNull().alias("contaminated"),
    )
    return rows.select(*named(docs.columns), verdict.alias(name))


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, width: int = 3, block_chars: int = 2_000_000) -> DataFrame:
    """``docs`` with a last column, a struct of n_words, n_hit, n_items, items_sha256, contaminated.

    It is called ``_leak``, with more underscores while ``docs`` has a column that starts like it.
    """
    name, items = free(docs.columns, "_leak"), named_items(benchmark)
    if (items.agg(F.sum(F.length("text") + F.length("item") + 1)).first()[0] or 0) > block_chars:
        return by_joins(docs, items, window, width, name)
    return by_index(docs, [tuple(r) for r in items.collect()], window, width, name)
