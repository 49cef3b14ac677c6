"""The pipeline's near-duplicate stage against brute-force Jaccard groups."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("millrace.llm")
import corpus_pipeline


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(find(i), []).append(r)
    return list(out.values())


def made():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    common = " ".join(word() for _ in range(12))
    texts = [None, "", " \n", "one", "ONE", "a b c d e", "a b c d f"]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(5, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):  # copies of the base or of the last copy, some changed too much
            own = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own) if rng.random() < 0.8 else f"{common}\n{' '.join(own)}")
            base = own if rng.random() < 0.5 else base
    for n in range(60):  # one line in many texts, and many texts near one
        texts.append(f"{common} {' '.join(word() for _ in range(30))}")
        texts.append(" ".join(f"v{i}" if i != 3 * n else "other" for i in range(180)))
    rng.shuffle(texts)
    return [(i, t, i % 3) for i, t in enumerate(texts)] + [(3, "another text of some words under a used id", 0), (None, "no id", 1), (None, "no id", 1), (None, "one", 1)]


@pytest.mark.parametrize("table", ("made", "sf0.001", "sf0.01"))
def test_near_dedup_keeps_one_of_each_jaccard_group(spark, table):
    if table == "made":
        docs = spark.createDataFrame(made(), "doc_id long, text string, _h int")
    else:
        docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = groups(rows)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(want)
    for g in want:
        ids = [r[0] for r in g if r[0] is not None]
        assert sum(r in g for r in got) == 1
        assert any(r in g and r[0] == (min(ids) if ids else None) for r in got)


def nearly_alike(pairs):
    """Pairs of similarity 0.81, with 0.795 between all others, so that nearly all bands hold most of the texts."""
    rows = []
    for p in range(pairs):
        common = [f"c{i}" for i in range(400)]
        shared = [f"s{p}_{i}" for i in range(3)]
        rows += [(2 * p + k, " ".join(common + shared + [f"u{p}_{k}_{i}" for i in range(48)])) for k in range(2)]
    return rows


def test_a_band_of_many_sets_loses_no_pair(spark, monkeypatch):
    from millrace.llm import neardup

    monkeypatch.setattr(neardup, "PIVOTS", 0)  # the shared sets only save time; in small bands they would hide a loss
    rows = nearly_alike(150)
    x, y, z = (shingles(rows[i][1]) for i in (0, 1, 2))
    assert 5 * len(x & y) >= 4 * len(x | y) and 5 * len(x & z) < 4 * len(x | z)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    distinct = neardup.prints_of(docs, 5).select("key", "fp", "bands", F.explode("bands").alias("trie"))
    together = distinct.alias("a").join(distinct.alias("b"), "trie").filter("a.key < b.key and bit_count(a.fp ^ b.fp) <= 24").select("a.key", "b.key").distinct().count()
    assert together > 40_000  # of 44,850 pairs
    got = {r["doc_id"] for r in neardup.keep_one(docs, per_trie=10).collect()}
    assert got == {2 * p for p in range(150)}


def test_near_dedup_of_nothing(spark):
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0
