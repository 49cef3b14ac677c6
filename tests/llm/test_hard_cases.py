"""Bounds, copies, clashing columns and the registered queries, against brute force."""

import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("millrace.llm")
import corpus_pipeline
from tokenizers import Tokenizer

from millrace.llm import langid, neardup, queries, records, sharding, simhash, urlfilter
from tests.llm.test_neardup import groups

SF = "/root/testdata/sf0.001"
CLASH = ("_words", "_h1", "_q", "_Q_words", "_h8", "_quality", "_lang", "_leak", "_LEAK2", "_hits", "_license", "_key", "a b.c", "key", "fp", "root", "n", "c1")


def test_components_raise_when_not_settled(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(400)], "u long, v long")
    with pytest.raises(RuntimeError):
        simhash.connected_components(chain, rounds=2).count()
    assert {r["root"] for r in simhash.connected_components(chain).collect()} == {0}


def test_one_id_under_two_texts_loses_no_group(spark):
    far = " ".join(f"z{i}" for i in range(40))
    rows = [(3, "alpha beta gamma delta", 1), (5, "alpha beta gamma delta", 2), (3, far, 3), (9, far, 4), (5, "other words than these here", 5), (5, "other words than these here", 6), (None, "one more text of no id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int")
    for kept in (simhash.keep_one(docs), neardup.keep_one(docs)):
        got = sorted((tuple(r)[:2] for r in kept.collect()), key=str)
        assert got == sorted([(3, rows[0][1]), (3, far), (5, rows[4][1]), (None, rows[6][1])], key=str) and kept.columns == docs.columns


def test_large_tries_are_dealt_again(spark):
    rng = random.Random(8)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(150):  # near copies of one text, some too far from it, and others
        own = list(base)
        for _ in range(rng.randrange(7)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(999)}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, " ".join(f"y{rng.randrange(99)}" for _ in range(50))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {min(r[0] for r in g) for g in groups(rows)}
    for per_trie in (2_000, 40):
        assert {r["doc_id"] for r in neardup.keep_one(docs, per_trie=per_trie).collect()} == want


def test_language_of_copies_and_many_languages(spark):
    few = [f"bonjour le monde numero {i}" for i in range(7)]
    rows = [(few[i % 7], "fr") for i in range(3000)] + [(f"hello the world number {i} {i * 7}", "en") for i in range(3000)]
    windows = langid.sample_windows(spark.createDataFrame(rows, "text string, lang string"))
    count = Counter(lang for _, lang in windows)
    assert count["fr"] == 7 and 200 < count["en"] < 800
    many = spark.createDataFrame([(f"text {i} of language {i % 100}", f"l{i % 100}") for i in range(2000)], "text string, lang string")
    assert {lang for _, lang in langid.sample_windows(many)} == {f"l{i}" for i in range(100)}
    with pytest.raises(ValueError):
        langid.sample_windows(many, max_languages=99)


def test_network_against_a_plain_convolution(spark):
    rng = np.random.default_rng(4)
    model = langid.train([(rng.integers(97, 110 + 10 * k, 200).astype(np.uint8).tobytes(), f"l{k}") for k in (0, 1) for _ in range(30)], rounds=1)

    def brute(text):
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        total = np.zeros(len(model.languages))
        for at in range(0, len(data), langid.WINDOW):
            own = data[at : at + langid.WINDOW]
            padded = own + bytes(langid.WINDOW - len(own))
            feature = []
            for w in model.filters:
                width = len(w)
                feature += list(np.max([sum(model.embed[padded[i + k]] @ w[k] for k in range(width)) for i in range(langid.WINDOW - width + 1)], axis=0))
            z = np.maximum(np.array(feature) + model.bias, 0) @ model.dense + model.offset
            p = np.exp(z - z.max())
            total += len(own) * p / p.sum()
        return total / len(data)

    texts = ["Abc", "hello World " * 60, "é" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predict_languages(docs, model).collect():
        p = brute(r["text"])
        assert r["_lang"]["lang_pred"] == model.languages[int(p.argmax())] and abs(r["_lang"]["score"] - p.max()) < 1e-4


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_shards_by_recomputed_draws(spark):
    def winner(nodes, key):
        def draw(n):
            h = xxhash.xxh64_intdigest(n.name.encode(), xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42))
            return -math.log(((h >> 11) + 0.5) / 2**53) / n.weight
        return min(nodes, key=draw)

    def shard(tree, key):
        while tree:
            node = winner(tree, key)
            tree = node.children
        return node.shard

    tree = sharding.balanced_tree()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op1_sharding(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["shard"], r["grown_shard"]) == (shard(tree, r["doc_id"]), shard(sharding.grown(tree), r["doc_id"]))
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")


def test_registered_queries(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in texts}
    byte, word = Tokenizer.from_file(queries.PACK_TOKENIZER), Tokenizer.from_file(queries.RECORD_TOKENIZER)
    pieces = defaultdict(list)
    for r in queries.op2_packing(spark, SF).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    start = 0
    records_of = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op10_token_records(spark, SF).collect()}
    for d in sorted(texts):
        ids = np.array(byte.encode(texts[d] or "", add_special_tokens=False).ids + [0], "<u4")
        for at, n, crc, total in sorted(pieces[d]):
            assert crc == zlib.crc32(ids[at : at + n].tobytes()) and total == len(ids)
        assert sum(p[1] for p in pieces[d]) == len(ids)
        ids = np.array(word.encode(texts[d] or "", add_special_tokens=False).ids + [1], "<u4")
        assert records_of[d] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    prints = {}
    for r in queries.op3_simhash(spark, SF).collect():
        w = (texts[r["doc_id"]] or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        assert r["fingerprint"] == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"
        prints[r["doc_id"]] = (int(r["fingerprint"], 16), r["component_id"])
    for a, (x, c) in prints.items():
        assert c <= a and all(e == c for _, (y, e) in prints.items() if (x ^ y).bit_count() <= 2)
    found = queries.op5_language_id(spark, SF).collect()
    assert len(found) == len(texts) and all(r["held_out"] == held[r["doc_id"]] and 0 <= r["score"] <= 1 for r in found)
    judged = queries.op8_quality(spark, SF).collect()
    for r in judged:
        w = [x for x in (texts[r["doc_id"]] or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w)) and (not r["base_failed"] or not r["kept"])
        assert r["base_failed"] == (len(w) < 20 or 100 * r["n_repeat_words"] > 30 * len(w))


def test_large_block_list_in_parts(spark):
    n = 3_000
    pages = spark.range(2 * n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://w.h"), F.col("id").cast("string"), F.lit(".example/x")).alias("url"), F.lit(1).alias("blocked"))
    pages = pages.unionByName(spark.createDataFrame([(-1, "http://" + "a." * 400 + "h0.example", 1), (-2, None, 1)], "page_id long, url string, blocked int"))
    listed = spark.range(n).select(F.concat(F.lit("h"), (7 * F.col("id")).cast("string"), F.lit(".example")).alias("key"))
    for most in (1 << 26, 1 << 13):
        got = {r["page_id"] for r in urlfilter.judge_urls(pages, rules=(), listed=listed, max_bits=most).filter("verdict = 'block'").collect()}
        assert got == {-1} | {i for i in range(2 * n) if i % 7 == 0 and i < 7 * n}


def test_record_files_are_in_the_order_of_their_numbers(spark, tmp_path):
    rows = [(i, f"document number {i}") for i in range(60)] + [(None, f"none {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    records.write_records(docs, f"{tmp_path}/r", queries.RECORD_TOKENIZER, file_bytes=300)
    files = sorted(Path(tmp_path, "r").glob("part-*"))
    assert len(files) >= 3  # rows without an id are in several
    for k, f in enumerate(files):
        f.rename(f.with_name(f"part-{99_999 + k}-{f.name[11:]}"))
        Path(f.parent, f".{f.name}.crc").unlink(missing_ok=True)
    index = records.write_index(spark, f"{tmp_path}/r", f"{tmp_path}/i").orderBy("start").collect()
    assert [r["doc_id"] for r in index] == [None] * 40 + list(range(60))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(index, index[1:]))


def test_stages_on_hard_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    extra = spark.createDataFrame([(None, None, None), (900, "", "en"), (900, "", "en"), (901, "word " * 30_000, "en"), (None, "No id. " + " ".join(f"the{i} word" for i in range(40)), "en")], "doc_id long, text string, lang string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    for k, c in enumerate(CLASH):
        docs = docs.withColumn(c, F.lit(k))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        out = stage(spark, docs, SF)
        if name != "packing":
            out = out.cache()
            assert out.columns == docs.columns and 0 < out.count() <= docs.count() and out.exceptAll(docs).count() == 0
            assert all(r[c] == k for r in out.limit(5).collect() for k, c in enumerate(CLASH))
            docs = out
    assert out.agg(F.sum("length")).first()[0] > 0
