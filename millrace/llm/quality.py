"""Quality rules: base measures of a text and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets. One pass over all documents
counts the buckets of the raw corpus and, in the same aggregate, those of the
trusted target: documents labelled good, at most ``trusted_rows`` of them,
taken in hash order. A document's score is the sum of its n-grams' log ratios
log p(target) / p(raw) divided by their number. Weights are rounded to
millionths and summed as integers, so a verdict does not depend on the order of
evaluation, and every document is held against the same threshold.

Everything is per row; only bucket counts are shuffled. A null text has no
words and fails; an empty table gives an empty result. Without any trusted row
all weights are zero and the base rules alone decide. Repeated rows are judged
alike. 64-bit hashes stand for words and windows. A very long text is one row's
arrays in memory. Other columns, whatever their names, come back unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, let, named

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
BUCKETS = 1 << 13  # for words; as many again for pairs
WINDOW = 8
THRESHOLD = -0.12
MICRO = 1_000_000
TRUSTED_ROWS = 50_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def joined_hashes(hashes: Column, gap: int) -> Column:
    """Hash of each item with the one ``gap`` further on."""
    return let(hashes, lambda h: F.slice(F.zip_with(h, F.slice(h, gap + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(h) - gap, F.lit(0))))


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``windows`` are all of a text, by start."""
    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, i, k: F.coalesce(F.get(s, i)["x"] == F.get(s, i + k)["x"], F.lit(False))
        starts = lambda s: F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(s, i, -1) | same(s, i, 1)), lambda i: F.get(s, i)["i"]))
        length = lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width)))), F.lit(0).cast("long"), lambda s, x: s + x)
        return let(ranked, lambda s: let(starts(s), length))

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def with_hashes(docs: DataFrame, own: str) -> DataFrame:
    """``docs`` with the words of the text and the hashes of words and pairs; ``own`` starts the names of these columns."""
    rows = docs.withColumn(f"{own}words", words_of(F.col("text")))
    rows = rows.withColumn(f"{own}h1", F.transform(f"{own}words", lambda w: F.xxhash64(w)))
    return rows.withColumn(f"{own}h2", joined_hashes(F.col(f"{own}h1"), 1))


def buckets(own: str) -> Column:
    return F.concat(
        F.transform(f"{own}h1", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")),
        F.transform(f"{own}h2", lambda h: (F.pmod(h, F.lit(BUCKETS)) + BUCKETS).cast("int")),
    )


def log_ratios(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> list[int]:
    """A weight in millionths for every bucket; 2 * BUCKETS numbers, whatever the corpus."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_good")).distinct()
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(trusted_rows).withColumn("_is", F.lit(1))
    rows = docs.select("doc_id", "text")
    rows = rows.join(F.broadcast(good), rows["doc_id"] == good["_good"], "left")  # at most trusted_rows ids
    counts = with_hashes(rows, "_").select("_is", F.explode(buckets("_")).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("_is").alias("target")).collect()
    raw, target = [0] * (2 * BUCKETS), [0] * (2 * BUCKETS)
    for r in counts:
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    if not sum(target):
        return [0] * (2 * BUCKETS)
    out: list[int] = []
    for at in (0, BUCKETS):  # words and pairs are multinomials of their own
        t, r = target[at : at + BUCKETS], raw[at : at + BUCKETS]
        nt, nr = sum(t) + BUCKETS, sum(r) + BUCKETS
        out += [round(MICRO * (math.log((a + 1) / nt) - math.log((b + 1) / nr))) for a, b in zip(t, r)]
    return out


def judge_quality(docs: DataFrame, weights: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a last column: a struct of measures, score and verdict.

    It is called ``_quality``, with more underscores while ``docs`` has a column that starts like it.
    """
    own, result = free(docs.columns, "_q_"), free(docs.columns, "_quality")
    rows = with_hashes(docs, own)
    rows = rows.withColumn(f"{own}h8", joined_hashes(joined_hashes(F.col(f"{own}h2"), 2), 4))
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folded to one constant
    total = F.aggregate(buckets(own), F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
    grams = F.size(f"{own}h1") + F.size(f"{own}h2")
    text = F.coalesce("text", F.lit(""))
    n = F.size(f"{own}words").cast("long")
    measures = f"{own}measures"
    rows = rows.withColumn(measures, F.struct(
        n.alias("n_words"),
        F.length(F.array_join(f"{own}words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col(f"{own}h8")).alias("n_repeat_words"),
        F.when(grams > 0, total / MICRO / grams).otherwise(F.lit(0.0)).alias("score"),
    ))
    m = F.col(measures)
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    done = F.struct(f"{measures}.*", failed.alias("base_failed"), (~failed & (m["score"] >= threshold)).alias("kept"))
    # Through a generator, so that a filter on the verdict is not planned below it, evaluating it once more.
    return rows.select(*named(docs.columns), F.explode(F.array(done)).alias(result))
