"""SimHash near-duplicates at word-shingle similarity: the trie self-join with verified links, the pipeline's stage.

Rows with one set of shingles fold into one key with a SimHash of the set. Sets
of similarity 0.8 differ in 10 bits of 64 on average and in up to 24, and so wide
a budget prunes nothing before a trie is some 40 levels deep: one walk over the
whole corpus would compare all pairs. So tries are dealt out by similarity first:
a set has ``BANDS`` hashes of its smallest members (min-hashes) in one band each,
and the sets that agree in a band form a trie of their own (for similarity 0.8,
a pair agrees in at least one band with probability 0.9998, for 0.3 in 0.12). In
each trie pairs of nodes are walked down together, differing bits add up, and
pairs over the budget are dropped. What is left is verified exactly on whole
sets, unless its two sides are connected already; so a trie of m sets gives at
most m - 1 links, and a group of near copies isn't squared in the output.

Bands with the same members are walked once. A band of more than ``per_trie``
sets is dealt out again, in ``TURNS`` turns, by further min-hashes; what agrees
in those too is cut into salted parts that share about ``PIVOTS`` sets. That
connects most of a large band's groups, but not all, so its rest follows: where
its sets are not one group by then, it is cut into parts, and all pairs of parts
are compared, each in a task that holds two parts. Pairs that are connected or
met in an earlier band are left out. So no pair is lost by a band's size; the
rest of a band of m sets of many groups takes time in proportion to m * m.

A null or empty text has no shingles; such texts are copies of each other. Sets
are compared by 64-bit hashes of their shingles, and folded by a hash of these.
Very long texts are hashed in parts. Repeated rows are one. Other columns,
whatever their names, come back unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches, shared_dir
from .simhash import connected_components, majority, one_of_each, small, text_hash, walk_tries

BANDS, ROWS = 16, 4
#: Of min-hashes beyond the bands, by which a band of too many sets is dealt out again.
TURNS, MORE = 8, 2
PIVOTS = 20
#: Odd multipliers, one a min-hash: each orders the shingles anew.
ORDERS = np.random.default_rng(64).integers(0, 1 << 31, BANDS * ROWS + TURNS * MORE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Odd multipliers of a shingle's words, and of a band's min-hashes.
PLACES = np.random.default_rng(65).integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of a part of a large band, of which a task holds two.
PART_SHINGLES = 1 << 20
PART = 1 << 12
#: Bytes hashed at once.
SEGMENT = 1 << 19
#: Lower-cases A-Z and turns white space into blanks.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
VALUES = np.random.default_rng(66).integers(1, 1 << 62, 256, dtype=np.uint64)
PRINTS = "doc_id long, text_hash long, key long, fp long, size long, bands array<bigint>, turns array<bigint>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(of: int) -> np.ndarray:
    out = np.full(2 * SEGMENT + 1, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = powers(BASE := 6364136223846793005), powers(pow(BASE, -1, 1 << 64))
#: The hash of a line feed.
END = VALUES[10]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``data``, which is plain: a polynomial in a word's bytes, by running sums over many words at once."""
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(data):
        end = data.find(b" ", at + SEGMENT) if len(data) - at > SEGMENT else -1
        end = end if end >= 0 else len(data)
        if end - at > 2 * SEGMENT:  # a word longer than a segment: such words are hashed one by one
            words = data[at:end].split()
            long = np.array([len(w) > SEGMENT for w in words])
            own = np.empty(len(words), np.uint64)
            own[long] = [xxhash.xxh3_64_intdigest(w) for w in words if len(w) > SEGMENT]
            own[~long] = word_hashes(b" ".join(w for w in words if len(w) <= SEGMENT))
            out.append(own)
        else:
            part = np.frombuffer(data, np.uint8)[at:end]
            letter = part != 32
            edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(VALUES[part] * POWERS[: len(part)], out=sums[1:])
            own = (sums[edge[1::2]] - sums[edge[::2]]) * INVERSES[edge[::2]]
            long = np.flatnonzero(edge[1::2] - edge[::2] > SEGMENT)
            own[long] = [xxhash.xxh3_64_intdigest(part[edge[2 * k] : edge[2 * k + 1]].tobytes()) for k in long]
            out.append(own)
        at = end
    return np.concatenate(out)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text with the word hashes ``words``; fewer than ``width`` are one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += words[k : k + n] * PLACES[k]
    total = np.sort(mixed(total))
    return total[np.r_[True, total[1:] != total[:-1]]]


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """``shingle_set`` of each text of ``column``; short ones are hashed together."""
    group: list[bytes] = []

    def done() -> Iterator[np.ndarray]:
        # A line feed of its own, which is no word elsewhere, ends each text.
        words = word_hashes(b" \n ".join(group))
        ends = np.append(np.flatnonzero(words == END), len(words))
        for k, end in enumerate(ends):
            yield shingle_set(words[ends[k - 1] + 1 if k else 0 : end], width)
        group.clear()

    size = 0
    for text in column:
        group.append((text.as_py() or "").encode("utf-8", "surrogatepass").translate(PLAIN))
        size += len(group[-1])
        if size >= SEGMENT:
            yield from done()
            size = 0
    if group:
        yield from done()


def min_hashes(own: np.ndarray) -> np.ndarray:
    """The smallest member of the set in each of the orders."""
    out, high = np.full(len(ORDERS), 0xFFFFFFFF, np.uint32), (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), PART):
        np.minimum(out, (ORDERS[:, None] * high[at : at + PART]).min(axis=1), out=out)
    return out


def in_bands(hashes: np.ndarray, rows: int) -> np.ndarray:
    """One number for each ``rows`` of the min-hashes in turn, with its place."""
    parts = hashes.reshape(-1, rows).astype(np.uint64)
    return mixed((parts * PLACES[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(1, len(parts) + 1, dtype=np.uint64) * PLACES[-1])


def set_key(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)) if len(own) else 0


def prints_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, key (of the set), fp (its SimHash), size, bands and turns (its min-hashes) of every row."""

    def numbers(x: list[np.ndarray]) -> pa.Array:
        return pa.array([v.view(np.int64) for v in x], pa.list_(pa.int64()))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        for b in batches:
            keys, fps, sizes, bands, turns = [], [], [], [], []
            for own in shingle_sets(b.column(2), width):
                least = min_hashes(own)
                keys.append(set_key(own))
                fps.append(majority(own))
                sizes.append(len(own))
                bands.append(in_bands(least[: BANDS * ROWS], ROWS) if len(own) else none)
                turns.append(in_bands(least[BANDS * ROWS :], MORE) if len(own) else none)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), numbers(bands), numbers(turns)], [c.split()[0] for c in PRINTS.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text"), per_batch, PRINTS)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, of which readers take the columns they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/neardup-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def dealt_tries(distinct: DataFrame, per_trie: int) -> tuple[DataFrame, DataFrame | None]:
    """trie, key, fp: a row for every trie of two sets or more that a set is in; ``distinct`` has one row a set.

    And trie, band: those of more than ``per_trie`` sets, of which the first only has a part of the pairs; None if there are none.
    """
    rows = distinct.select("key", "fp", F.posexplode("bands").alias("band", "trie"))
    sizes = rows.groupBy("trie", "band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("members")).filter("n > 1")
    # Of bands with the same members the first stays: so the first band that a pair agrees in always does.
    sizes = durable(sizes.groupBy("n", "members").agg(F.min(F.struct("band", "trie")).alias("s")).select("s.trie", "s.band", "n"))
    few = rows.select("key", "fp", "trie").join(small(sizes.filter(F.col("n") <= per_trie).select("trie")), "trie")
    large = durable(sizes.filter(F.col("n") > per_trie).select("trie", "band"))
    if large.isEmpty():
        return few, None
    again = distinct.select("key", "fp", "turns", F.explode("bands").alias("trie")).join(small(large.select("trie")), "trie")
    again = again.select("key", "fp", "trie", F.posexplode("turns").alias("turn", "least"))
    again = durable(again.select(F.xxhash64("trie", "turn", "least").alias("trie"), "key", "fp"))
    parts = again.groupBy("trie").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = again.join(parts, "trie").withColumn("parts", F.ceil(F.col("n") / per_trie))
    own = F.array(F.pmod(F.xxhash64("key", "trie"), F.col("parts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    again = again.withColumn("part", F.explode(F.when(F.pmod(F.xxhash64("key"), F.col("n")) < PIVOTS, every).otherwise(own)))
    return few.unionByName(again.select(F.xxhash64("trie", "part").alias("trie"), "key", "fp")), large


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """key, own (the set as bytes) of ``wanted`` (key, text_hash)."""
    texts = docs.select("text", text_hash().alias("text_hash")).join(small(wanted), "text_hash")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [x.tobytes() for x in shingle_sets(b.column(0), width)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(own, pa.binary())], ["key", "own"])

    # Copies of the text that stands for a key fold here; they are equal.
    return map_batches(texts.select("text", "key"), per_batch, "key long, own binary").groupBy("key").agg(F.first("own").alias("own"))


def near_pairs(trie: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions (i < j) of one trie that differ in at most ``budget`` bits; both arrays are sorted by trie, then fp."""
    leaf = np.flatnonzero(np.r_[True, (trie[1:] != trie[:-1]) | (fp[1:] != fp[:-1])])  # sets of one print share a leaf
    size = np.diff(np.append(leaf, len(fp)))
    own = trie[leaf]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    a, b = walk_tries(fp[leaf], first, np.zeros(len(first), np.int64), budget, 1 << 18)
    shared = np.flatnonzero(size > 1)
    a, b = np.r_[a, shared], np.r_[b, shared]
    n = size[a] * size[b]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(size[b], n)
    i, j = np.repeat(leaf[a], n) + at // width, np.repeat(leaf[b], n) + at % width
    keep = (i < j) | np.repeat(a != b, n)
    return np.minimum(i, j)[keep], np.maximum(i, j)[keep]


def by_first(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The pairs (i, j) as each i with all its j."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    heads = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
    for lo, hi in zip(heads, [*heads[1:], len(i)]):
        yield int(i[lo]), j[lo:hi]


def verified_links(candidates: Iterable[tuple[int, np.ndarray]], sets: list[np.ndarray], threshold: float, root: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the candidates, each a set with others, those that are similar and join two groups; each set's are verified in one go. ``root``: the groups so far."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    starts = ends - size
    root, marks = root.copy(), np.zeros(tokens.max(initial=0) + 1, bool)
    for x, ys in candidates:
        ys = ys[root[ys] != root[x]]
        ys = ys[np.minimum(size[ys], size[x]) >= threshold * np.maximum(size[ys], size[x]) - 1e-9]
        if not len(ys):
            continue
        marks[tokens[starts[x] : ends[x]]] = True
        similar = []
        for own in np.split(ys, np.flatnonzero(np.diff(np.cumsum(size[ys]) // PART_SHINGLES)) + 1):
            n = size[own]
            at = np.cumsum(n) - n
            places = np.arange(n.sum()) + np.repeat(starts[own] - at, n)
            same = np.add.reduceat(marks[tokens[places]].astype(np.int64), at)
            similar.append(own[same >= threshold * (size[x] + n - same) - 1e-9])
        marks[tokens[starts[x] : ends[x]]] = False
        ys = np.concatenate(similar)
        groups, one = np.unique(root[ys], return_index=True)
        yield from ((x, int(y)) for y in ys[one])
        if len(groups):
            root[np.isin(root, groups)] = root[x]


def rest_links(docs: DataFrame, distinct: DataFrame, large: DataFrame, links: DataFrame, width: int, threshold: float, budget: int, per_part: int) -> DataFrame:
    """Links between sets that share a band of ``large`` and are not connected by ``links``: of all pairs, by pairs of parts."""
    roots = durable(connected_components(links))
    members = distinct.select("key", "fp", "size", "bands", F.explode("bands").alias("trie")).join(small(large), "trie")
    members = members.join(small(roots), members["key"] == roots["node"], "left").withColumn("root", F.coalesce("root", "key")).drop("node")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / per_part, F.sum("size") / PART_SHINGLES))
    open_ = members.groupBy("trie").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), parts.alias("parts")).filter("lo <> hi")
    members = durable(members.join(small(durable(open_.select("trie", "parts"))), "trie"))
    wanted = durable(distinct.select("key", "text_hash").join(small(durable(members.select("key").distinct())), "key"))
    part = members.withColumn("part", F.pmod(F.xxhash64("key", "trie"), F.col("parts")))
    part = part.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    part = part.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other", "parts", "size")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, band, keys = pdf["fp"].to_numpy().view(np.uint64), int(pdf["band"].iloc[0]), pdf["key"].to_numpy()
        before = np.stack(pdf["bands"].to_numpy())[:, :band]
        lower, upper = (np.flatnonzero(pdf["part"] == pdf[c]) for c in ("lo", "hi"))
        one_part = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]

        def candidates() -> Iterator[tuple[int, np.ndarray]]:
            for k, x in enumerate(lower):
                ys = upper[k + 1 :] if one_part else upper
                ys = ys[np.bitwise_count(fp[ys] ^ fp[x]) <= budget]
                yield int(x), ys[~(before[ys] == before[x]).any(axis=1)]  # what agrees in an earlier band is found there

        root = np.unique(pdf["root"], return_inverse=True)[1]
        found = np.array(list(verified_links(candidates(), [np.frombuffer(x, "<u8") for x in pdf["own"]], threshold, root)), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": keys[found[:, 0]], "v": keys[found[:, 1]]})

    return part.join(sets_of(docs, wanted, width), "key").groupBy("trie", "lo", "hi").applyInPandas(join, "u long, v long")


def similar_links(docs: DataFrame, prints: DataFrame, width: int, threshold: float, budget: int, per_trie: int, per_task: int = 1_000) -> DataFrame:
    """Links (u, v) between keys, each of similarity ``threshold``, that connect the similar pairs of all tries."""
    one = F.min_by(F.struct("text_hash", "fp", "size", "bands", "turns"), "text_hash")
    distinct = stored(prints.groupBy("key").agg(one.alias("s")).select("key", "s.*"))
    tries, large = dealt_tries(distinct, per_trie)
    tries = durable(tries)
    wanted = durable(distinct.select("key", "text_hash").join(small(durable(tries.select("key").distinct())), "key"))
    bins = max(1, -(-tries.count() // per_task))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        trie, fp = pdf["trie"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fp, trie))
        keys, own = pdf["key"].to_numpy()[order], pdf["own"].to_numpy()[order]
        i, j = near_pairs(trie[order], fp[order], budget)
        found = np.array(list(verified_links(by_first(i, j), [np.frombuffer(x, "<u8") for x in own], threshold, np.arange(len(own)))), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": keys[found[:, 0]], "v": keys[found[:, 1]]})

    rows = tries.join(sets_of(docs, wanted, width), "key").withColumn("bin", F.pmod(F.xxhash64("trie"), F.lit(bins)))
    links = rows.groupBy("bin").applyInPandas(join, "u long, v long")
    if large is None:
        return links
    links = durable(links)
    return links.unionByName(rest_links(docs, distinct, large, links, width, threshold, budget, 2 * per_trie))


def keep_one(docs: DataFrame, width: int = 5, threshold: float = 0.8, budget: int = 24, per_trie: int = 1_000) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: one with its smallest doc_id (none: last), then text hash.

    Groups are connected by pairs whose sets of ``width``-word shingles have a Jaccard similarity of ``threshold``.
    """
    prints = stored(prints_of(docs, width))
    roots = durable(connected_components(similar_links(docs, prints, width, threshold, budget, per_trie)))
    rows = prints.select("doc_id", "text_hash", "key")
    found = rows.join(small(roots), rows["key"] == roots["node"], "left").select("doc_id", "text_hash", F.coalesce("root", "key").alias("root"))
    return one_of_each(docs, found)
