"""The rows of the whole pipeline, and of each stage on its own input, against brute force."""

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
import corpus_pipeline
from tokenizers import Tokenizer

from millrace.llm import langid, quality, queries
from tests.llm.test_neardup import groups

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPAN = quality.BUCKETS


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def grams(text):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
    return [x % SPAN for x in h] + [SPAN + x % SPAN for x in pairs]


def of_quality(docs, trusted):
    own = {d: grams(t) for d, t in docs.items()}
    raw, target, weight = Counter(), Counter(), {}
    for d, g in own.items():
        raw.update(g)
        target.update(g if d in trusted else ())
    for span in (range(SPAN), range(SPAN, 2 * SPAN)):
        nt, nr = (sum(c[b] for b in span) + SPAN for c in (target, raw))
        weight |= {b: round(1e6 * (math.log((target[b] + 1) / nt) - math.log((raw[b] + 1) / nr))) for b in span}

    def good(d, text):
        words = WORD.findall(text or "")
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
        return len(words) >= 20 and 100 * len(repeated) <= 30 * len(words) and sum(weight[b] for b in own[d]) / 1e6 / len(own[d]) >= quality.THRESHOLD

    return {d: t for d, t in docs.items() if good(d, t)}


def language_score(text, model):
    data = lowered(text).encode()
    total = np.zeros(len(model.languages))
    for at in range(0, len(data), langid.WINDOW):
        part = data[at : at + langid.WINDOW]
        x = model.embed[np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)]
        feature = [np.einsum("pek,kef->pf", np.lib.stride_tricks.sliding_window_view(x, len(w), axis=0), w).max(axis=0) for w in model.filters]
        z = np.maximum(np.concatenate(feature) + model.bias, 0) @ model.dense + model.offset
        p = np.exp(z - z.max())
        total += len(part) * p / p.sum()
    return total.max() / max(1, len(data))


def in_language(docs, model):
    score = {d: language_score(t, model) if any(map(str.isalpha, t or "")) else 0.0 for d, t in docs.items()}
    assert all(abs(s - corpus_pipeline.MIN_LANGUAGE_SCORE) > 1e-3 for s in score.values())
    return {d: t for d, t in docs.items() if score[d] >= corpus_pipeline.MIN_LANGUAGE_SCORE}


def first_of_groups(docs):
    return {d: docs[d] for d in (min(r[0] for r in g) for g in groups(list(docs.items())))}


def without(docs, items):
    windows = set()
    for text in items:
        w = PLAIN_WORD.findall(lowered(text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()

    def leaks(text):
        w = PLAIN_WORD.findall(lowered(text))
        return any(tuple(w[i : i + k]) in windows for k in {len(x) for x in windows} for i in range(len(w) - k + 1))

    return {d: t for d, t in docs.items() if not leaks(t)}


def check_packed(rows, docs):
    tokenizer, pieces, sequences = Tokenizer.from_file(queries.PACK_TOKENIZER), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == docs.keys()
    for d, own in pieces.items():
        ids, at = np.array(tokenizer.encode(docs[d] or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for start, length, crc, total in sorted(own):
            assert (start, crc, total) == (at, zlib.crc32(ids[at : at + length].tobytes()), len(ids))
            at += length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_rows_of_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 1 and not r["toxic"]}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = [len(want)]
    brute = {
        "quality_rules": lambda _, x: of_quality(x, trusted),
        "language_id": lambda df, x: in_language(x, langid.fit(df)),
        "near_dedup": lambda _, x: first_of_groups(x),
        "decontamination": lambda _, x: without(x, items),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = brute[name](docs, want)
        docs = stage(spark, docs, SF).cache()
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want and docs.count() == len(want), name
        sizes.append(len(want))
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > sizes[4] > 0
    check_packed(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), want)
    check_packed(corpus_pipeline.run(spark, SF).collect(), want)
