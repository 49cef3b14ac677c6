"""URL filter: path rules, then exact host lists by a Bloom filter cascade.

The key universe is every suffix at a dot of every host of the corpus. Level 1
of the cascade encodes the listed keys of the universe; level 2 encodes the
other keys that level 1 lets through; level 3 the listed keys that level 2 lets
through, and so on until a level lets nothing wrong through. A key of the
universe walks down to the first level that lacks it, and that level's parity
says, exactly, whether the key is listed. Bits are made by aggregates over the
universe and tested by column expressions, so no row is joined with the list.

Levels are literals of a plan, of a size bounded by the list: where they would
exceed ``max_bits``, keys are split by their hash into parts with a cascade each,
which are applied one after another, each in a plan of its own. A null url, or
one without ``://``, has an empty host and path and is allowed. Repeated urls are
judged alike, whatever their length; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# Fixed values: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The block list where none is given: every listed name under every domain of the tables' sites.
NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{name}.{domain}" for name in NAMES for domain in DOMAINS)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = (F if found is None else found).when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def suffixes(host: Column) -> Column:
    """All of a host and its parents: a.b.c, b.c, c."""
    return let(F.split(host, r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


@dataclass(frozen=True)
class Level:
    """One Bloom filter."""

    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]  # of 32 bits

    def has(self, key: Column) -> Column:
        return let(tables([self])[0], lambda words: has(words, self, key))


def positions(key: Column, level: Level) -> Column:
    """Where the key's bits are: one hash gives two numbers, whose combinations are the positions."""
    pair = lambda h: F.transform(
        F.sequence(F.lit(0), F.lit(level.hashes - 1)), lambda k: F.pmod(h.bitwiseAND(0x7FFFFFFF) + k * F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1)), F.lit(level.bits))
    )
    return let(F.xxhash64(key, F.lit(level.seed)), pair)


def bit_of(at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(1 << b) for b in range(32))).cast("array<bigint>"), at.bitwiseAND(31).cast("int") + 1)


def tables(levels: list[Level]) -> Column:
    """All levels' words, as one constant to be bound once a row."""
    return F.array(*(F.split(F.lit(",".join(map(str, x.words))), ",").cast("array<bigint>") for x in levels))


def has(words: Column, level: Level, key: Column) -> Column:
    return F.forall(positions(key, level), lambda at: F.get(words, F.shiftright(at, 5).cast("int")).bitwiseAND(bit_of(at)) != 0)


def build_level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """The Bloom filter of ``keys`` (key) at about ``rate`` false positives; only its words reach the driver."""
    bits = max(64, 32 * math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 32))
    empty = Level(bits, max(1, min(16, round(bits / max(count, 1) * math.log(2)))), seed, ())
    at = keys.select(F.explode(positions(F.col("key"), empty)).alias("at"))
    found = at.groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(bit_of(F.col("at"))).alias("v")).toArrow()
    words = dict(zip(found.column("w").to_pylist(), found.column("v").to_pylist()))
    return Level(bits, empty.hashes, seed, tuple(words.get(i, 0) for i in range(bits // 32)))


def build_cascade(universe: DataFrame, max_levels: int = 64) -> list[Level]:
    """Levels over ``universe`` (key, listed), which is kept and read once a level."""
    sizes = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    inside, outside = sizes.get(True, 0), sizes.get(False, 0)
    levels: list[Level] = []
    if not inside:
        return levels
    encode, test = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    n, rate = inside, min(0.5, inside / max(outside, 1) / math.sqrt(2))
    while n and len(levels) < max_levels:
        level = build_level(encode, n, rate, len(levels) + 1)
        levels.append(level)
        passed = durable(test.filter(level.has(F.col("key"))))
        encode, test, n, rate = passed, encode, passed.count(), 0.5
    if n:
        raise RuntimeError("the cascade did not end; raise max_levels")
    return levels


def any_listed(keys: Column, levels: list[Level]) -> Column:
    """Whether one of ``keys`` is listed, exact for keys of the universe: the parity of the first level that lacks a key tells."""
    if not levels:
        return F.lit(False)

    def listed(key: Column, words: Column) -> Column:
        answer = F.lit(len(levels) % 2 == 1)
        for i in reversed(range(len(levels))):
            answer = F.when(~has(F.get(words, F.lit(i)), levels[i], key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer

    return let(tables(levels), lambda words: F.exists(keys, lambda k: listed(k, words)))


def listed_by(key: Column, levels: list[Level]) -> Column:
    return any_listed(F.array(key), levels)


def key_universe(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct suffix keys of ``hosts`` (host) with their place in ``listed`` (key)."""
    keys = hosts.distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    return keys.join(listed.distinct().withColumn("_in", F.lit(True)), "key", "left").select("key", F.col("_in").isNotNull().alias("listed"))


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(parts))


def judge_urls(pages: DataFrame, rules=RULES, listed=LISTED, max_bits: int = 1 << 26) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    spark: SparkSession = pages.sparkSession
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    list_df = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(h,) for h in listed], "key string")
    universe = durable(key_universe(rows.select("host"), list_df))
    n = universe.filter("listed").count()
    bits = 4 * n + 1.5 * n * math.log2(max(universe.count() / max(n, 1), 2))  # of all levels
    parts = max(1, math.ceil(bits / max(max_bits, 4096)))
    rows = rows.withColumn("blocked", F.lit(False))
    for part in range(parts):
        mine = universe if parts == 1 else durable(universe.filter(part_of(F.col("key"), parts) == part))
        levels = build_cascade(mine)
        keys = suffixes(F.col("host"))
        if parts > 1:
            keys = F.filter(keys, lambda k: part_of(k, parts) == part)  # noqa: B023
        rows = rows.withColumn("blocked", F.col("blocked") | any_listed(keys, levels))
        if part + 1 < parts:
            rows = durable(rows)
    rows = rows.withColumn("fits", rule_for(F.col("host"), F.col("path"), rules))
    return rows.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
