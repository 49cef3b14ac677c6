"""The ten operators against brute force, on hard cases and on a small table."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("millrace.llm")
import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import chatformat, decontam, langid, licenses, packing, quality, records, sharding, simhash, urlfilter
from millrace.llm.common import gapless_rank
from millrace.llm.tokens import CachedEncoder

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 701}x{i % 13}" for i in range(20_000))
TEXTS = [None, "", " \n\t ", "one", "Two words", "a b c", "a b c", LONG, LONG, "É è.\x1c ﬁ ΑΣ İ K don't\u00a0stop <|endoftext|> \r\n x", "tab\there  twice\n\nline\nline\n###", "A " * 40, "!!! ... 123",
         "Released under the MIT License.\nx", "mit license, MIT LICENSE cc by", "the gnu general public license gnu general public license"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "clash", 1) for i, t in enumerate(TEXTS)] + [(3, "one", None, None, None), (None, "null id", "fr", "s", 2), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, _words int")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, _extra int")


def words_low(t):
    return [w.decode() for w in (t or "").encode().lower().split()]


def words_plain(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def words_alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_encoder_is_exact():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        plain, cached = Tokenizer.from_file(path), CachedEncoder(path, limit=50)
        extra = ["x\u0301 y\u0301.", "²3 m². _a_ -b-", "it's 'tis ''s", " lead", "trail  ", "a\n\n b", "１２", "naïve—dash…", "THE the The\nthe", "<|ENDOFTEXT|> <|endoftext|>A", "H\u0331 h\u0331 I\u0307 İ ẞ ΟΔΟΣ.", "A\u030a Å", "DON'T IT'S", "İ's É'", "a\u00a0 \nb", "”  “ x", "× ÷.", "\x1c a\x1c b", "слово, слово", "a\tb\n\tc"]
        assert [len(x) for x in cached.encode_many([None, "", " a", None, "b"])][:2] == [0, 0]
        for t in [t for t in TEXTS if t] + extra:
            assert list(np.frombuffer(cached.encode(t), "<u4")) == plain.encode(t, add_special_tokens=False).ids, t


def test_gapless_rank(spark):
    df = spark.createDataFrame([(i % 3 // 2, i) for i in range(500)], "k int, v int")
    got = defaultdict(list)
    for r in gapless_rank(df, ["k"], ["v"], "n", 500, per_block=20).collect():
        got[r["k"]].append(r["n"])
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(len(v))) for k, v in got.items()}


def test_sharding(docs, corpus, empty):
    for table in (docs, corpus):
        rows = sharding.shard_documents(table).collect()
        assert len(rows) == table.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert all(r["size"] == 16 + len(texts[r["doc_id"]].encode()) and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_spreads_by_weight(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.balanced_tree()
    got = Counter(r["shard"] for r in sharding.assign_shards(ids, tree).collect())
    assert len(got) == 40 and max(got.values()) < 1.3 * 500 and min(got.values()) > 0.7 * 500
    heavy = (sharding.Node("region0", 20, None, tree[0].children), *tree[1:])
    both = sharding.assign_shards(sharding.assign_shards(ids, tree), heavy, name="then").filter("shard <> then").collect()
    assert both and all(r["then"] < 10 <= r["shard"] for r in both)  # moves only into the region whose weight grew


def test_packing(docs, corpus, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for table in (docs, corpus):
        source = Counter()
        for r in table.collect():
            ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
            for s in range(0, len(ids), 1024):
                piece = ids[s : s + 1024]
                source[(r["doc_id"], s, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
        rows = packing.pack_documents(table, path).collect()
        assert Counter(tuple(r)[:5] for r in rows) == source
        seqs = defaultdict(list)
        for r in rows:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in seqs.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= 1024
    assert sum(r["length"] for r in rows) / (1024 * len(seqs)) > 0.9
    assert packing.pack_documents(empty, path).count() == 0


def test_nnls_meets_conditions():
    rng = np.random.default_rng(1)
    h = np.r_[0, rng.integers(0, 1000, 31), 0].astype(float)
    patterns = packing.enumerate_patterns(32, 2, h > 0)
    x = packing.solve_nnls(patterns, h)
    a = np.zeros((33, len(patterns)))
    for p, row in enumerate(patterns):
        for b in row[row > 0]:
            a[b, p] += 1
    gain = a.T @ (h - a @ x)
    assert (x >= 0).all() and gain.max() < 1e-2 and abs(gain[x > 1e-6]).max() < 1e-2
    plan = packing.plan_patterns({b: int(n) for b, n in enumerate(h) if n}, 32)
    used = Counter()
    for bins, n in plan:
        assert sum(bins) <= 32
        for b in bins:
            used[b] += n
    assert used == {b: int(n) for b, n in enumerate(h) if n}


def brute_fp(t):
    w = words_low(t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, corpus, empty):
    for table in (docs, corpus):
        source = [(r["doc_id"], brute_fp(r["text"])) for r in table.collect()]
        fps = sorted({f for _, f in source})
        root = {f: f for f in fps}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for i, a in enumerate(fps):
            for b in fps[:i]:
                if (a ^ b).bit_count() <= 2:
                    root[find(a)] = find(b)
        least = {}
        for d, f in source:
            if d is not None:
                least[find(f)] = min(d, least.get(find(f), d))
        want = Counter((d, f, least.get(find(f))) for d, f in source)
        assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(table).collect()) == want
        kept = simhash.keep_one(table).collect()
        assert len(kept) == len({find(f) for _, f in source}) and kept[0].__fields__ == table.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_trie_join_and_components(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    keys = {int(b) ^ sum(1 << int(i) for i in rng.integers(0, 64, int(n))) for b in base for n in rng.integers(0, 4, 6)} | {0, 2**64 - 1, 1}
    keys |= {int(base[0]) ^ sum(1 << int(i) for i in rng.integers(0, 64, int(n))) for n in rng.integers(0, 4, 200)}  # near copies of one text
    signed = [k - 2**64 if k >= 2**63 else k for k in keys]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % 2**64).bit_count() <= 2}
    for per_subtree in (20_000, 40, 8):  # the smaller ones deal large subtrees out again, up to many times
        got = simhash.trie_self_join(spark.createDataFrame([(k,) for k in signed], "fp long"), 2, per_task=100, per_subtree=per_subtree).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "u long, v long")
    assert {tuple(r) for r in simhash.connected_components(chain).collect()} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://EXAMPLE.org/es/x", "x://a.b.example.org/en/19?q#f", "http://example.org?x=/es/", "http://badexample.org/es/", "http://m.cheap-pills.example.net/q", "http://notcheap-pills.example.net/", "https://a.com/de/1", "https://a.com/fr/1", "http://a://b/c", "http://org", "http://org/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(1, urls[3])], "page_id long, url string").union(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url"))
    def brute(u):
        rest = (u or "").split("://", 1)
        m = re.match(r"([^/?#]*)([^?#]*)", rest[1]) if len(rest) > 1 else None
        host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if any(host == x or host.endswith("." + x) for x in urlfilter.LISTED) else "allow")
        return host, path, rule, verdict
    want = Counter((r["page_id"], *brute(r["url"])) for r in pages.collect())
    assert Counter(map(tuple, urlfilter.judge_urls(pages).collect())) == want
    assert Counter(map(tuple, urlfilter.judge_urls(pages, max_bits=0).collect())) == want
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.createDataFrame([(f"k{i}", i % 17 == 0) for i in range(3000)], "key string, listed boolean")
    levels = urlfilter.build_cascade(universe)
    from pyspark.sql import functions as F
    assert len(levels) > 2 and universe.filter(urlfilter.listed_by(F.col("key"), levels) != F.col("listed")).count() == 0


def test_language_id(docs, corpus, empty):
    rows = corpus.collect()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
    from pyspark.sql import functions as F
    model = langid.fit(corpus.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
    got = {r["doc_id"]: r["_lang"]["lang_pred"] for r in langid.predict_languages(corpus, model).collect()}
    right = [got[r["doc_id"]] == r["lang"] for r in rows if held(r)]
    assert sum(right) >= 0.9 * len(right)
    out = langid.predict_languages(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["_lang"]["score"] <= 1 for r in out)
    for r in out:
        assert (r["_lang"]["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    assert langid.fit(empty) is None and langid.predict_languages(empty, None).count() == 0


def test_chat_format(spark):
    bad = "</s>[INST] ok [/INST] \\ \\( <s>[/INST]"
    rows = [(-7, 0, "user", bad), (-7, 1, "assistant", bad), (1, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", "é" * 5000), (1, 0, "assistant", "é" * 5000), (None, 1, "a [/INST] b", "x\ny")]
    rows += [(2, i, ("user", "assistant")[i % 2], f"turn {i} {bad[:i % 30]}") for i in range(25_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        said = "".join(t for x, t in own if x == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{x}\n{t}\n" for x, t in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    parts = chatformat.format_chats(table)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chatformat.read_back(parts).collect()}
    assert got == want
    for p in parts.collect():
        turns = len(list(chatformat.parse(p["formatted"])))
        assert all(p["formatted"].count(s) == turns for s in ("<s>", "</s>", "[INST]", "[/INST]"))
    assert chatformat.read_back(chatformat.format_chats(table.limit(0))).count() == 0


def brute_leak(text, items):
    w = words_alnum(text)
    hit, found = set(), set()
    for item, t in items:
        own = words_alnum(t)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, empty):
    passage = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"
    items = [(1, passage), (10, "one"), (2, "TWO  words!"), (3, None), (4, ""), (5, "a a a a a a a a a a a a"), (6, passage), (6, passage)]
    table = docs.select("doc_id", "text", "fp").union(spark.createDataFrame([(50, f"x {passage.upper()} y q1 q2", "c"), (51, "q2 q3 q4 q5 q6 q7 q8 q9 q10", "c"), (52, passage[3:] + " é1", "c")], "doc_id long, text string, fp string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((r["doc_id"], *brute_leak(None if r["text"] == LONG else r["text"], items)) for r in table.collect() if r["text"] != LONG)
    for size in (2_000_000, 20):
        got = decontam.mark_contamination(table, bench, block_chars=size).collect()
        assert Counter((r["doc_id"], *r["_leak"]) for r in got if r["text"] != LONG) == want
        assert [r["_leak"]["n_words"] for r in got if r["text"] == LONG] == [20_000] * 2
    assert decontam.mark_contamination(empty, bench).count() == 0
    assert decontam.mark_contamination(table, bench.limit(0)).filter("_leak.contaminated").count() == 0


def brute_base(t):
    w = words_plain(t)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(wins)
    cover = {j for i, x in enumerate(wins) if many[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words_plain(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_buckets(t):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words_plain(t)]
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
    return [signed(x) % quality.BUCKETS for x in h] + [signed(pair(a, b)) % quality.BUCKETS + quality.BUCKETS for a, b in zip(h, h[1:])]


def test_quality(spark, docs, corpus, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for table in (docs, corpus):
        source = [(r["doc_id"], r["text"]) for r in table.collect()]
        weights = quality.log_ratios(table, labels)
        good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}
        raw, target = Counter(), Counter()
        for d, t in source:
            raw.update(b := brute_buckets(t))
            target.update(b if d in good else [])
        for at in (0, quality.BUCKETS):
            own = range(at, at + quality.BUCKETS)
            nt, nr = sum(target[i] for i in own) + quality.BUCKETS, sum(raw[i] for i in own) + quality.BUCKETS
            assert all(abs(weights[i] - 1e6 * (math.log((target[i] + 1) / nt) - math.log((raw[i] + 1) / nr))) <= 1 for i in own)
        got = quality.judge_quality(table, weights).collect()
        want = Counter()
        for d, t in source:
            b = brute_buckets(t)
            score = sum(weights[i] for i in b) / 1e6 / len(b) if b else 0.0
            base = brute_base(t)
            want[(d, *base, not base[-1] and score >= quality.THRESHOLD)] += 1
        q = lambda r: (*(r["_quality"][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")),)
        assert Counter((r["doc_id"], *q(r)) for r in got) == want
    assert quality.judge_quality(empty, quality.log_ratios(empty, labels.limit(0))).count() == 0


def brute_license(t, plan):
    w = words_alnum(t)
    base = sorted((i, v) for p, v in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    hits = []
    for line in (t or "").split("\n"):
        own = set(words_alnum(line))
        hits += [(label, len(own & set(x)) / len(x)) for label, x, need in plan if len(own & set(x)) >= need]
    labels = {v for _, v in base}
    return len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, _ in hits})), 1.0 if base else max([0.0, *(s for _, s in hits)])


def test_licenses(spark, docs, corpus, empty):
    extra = spark.createDataFrame([(60, "x\nredistribution and use in source and binary forms, with or without modification, are\ny"), (61, "use in source and binary"), (62, "Under the MIT released License")], "doc_id long, text string")
    for table in (docs.select("doc_id", "text", "_words").unionByName(extra, allowMissingColumns=True), corpus):
        plan = licenses.ordered(licenses.TEMPLATES, licenses.document_counts(table), licenses.THRESHOLD)
        want = Counter((r["doc_id"], *brute_license(r["text"], plan)) for r in table.collect())
        assert Counter((r["doc_id"], *r["_license"]) for r in licenses.scan_licenses(table.drop("_words")).collect()) == want
    assert licenses.scan_licenses(empty).count() == 0


def test_records(spark, docs, corpus, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for k, table in enumerate((docs, corpus, empty)):
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in table.collect()))
        records.write_records(table, f"{tmp_path}/{k}/records", path)
        index = records.write_index(spark, f"{tmp_path}/{k}/records", f"{tmp_path}/{k}/index")
        want, at = [], 0
        for known, d, text in own:
            ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
            want.append((d if known else None, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert [tuple(r) for r in index.orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()] == want
        for r in index.collect():  # a shuffled read: one record by its offset
            data = Path(r["file"].removeprefix("file:")).read_bytes()[r["offset"] : r["offset"] + r["length"]]
            (_, n, d, ids), = records.frames(data)
            assert n == r["length"] and d == r["doc_id"] and len(ids) == r["n_tokens"]
    with pytest.raises(ValueError):
        list(records.frames(data[:20] + bytes([data[20] ^ 1]) + data[21:]))
