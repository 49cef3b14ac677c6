"""Decontamination by joins, as for a benchmark too large to broadcast, against the way by an index and brute force."""

import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("millrace.llm")
from millrace.llm import decontam


def brute(text, items):
    w, hit, found = re.findall("[a-z0-9é]+", text or ""), set(), set()
    for item, t in items:
        own = re.findall("[a-z0-9é]+", t or "")
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_both_ways_agree(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghij") + rng.choice(("é", "1", ""))
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 25)))) for i in range(40)] + [(1, "a a a a a a a a a a a a"), (41, "z"), (42, "y  z"), (43, None)]
    rows = []
    for i in range(80):
        text = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split()
            at, cut = rng.randrange(len(text) + 1), rng.randrange(3)
            text[at:at] = own[cut:]
        rows.append((i, " ".join(text), 1, i))
    rows += [(90, None, 1, 1), (91, "", 1, 1), (92, "a " * 300, 1, 1), (92, "a " * 300, 1, 1), (93, "x y z", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _leak int, _d_h1 int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((r[0], *brute(r[1], items)) for r in rows)
    for size in (2_000_000, 10):
        found = decontam.mark_contamination(docs, bench, block_chars=size)
        assert found.columns[:-1] == docs.columns
        got = found.collect()
        assert Counter(tuple(r)[:-1] for r in got) == Counter(map(tuple, rows))
        assert Counter((r["doc_id"], *r[found.columns[-1]]) for r in got) == want
    few_bits = decontam.by_joins(docs, decontam.named_items(bench), 10, 3, "found", most_bits=64)  # nearly all places are sent
    assert Counter((r["doc_id"], *r["found"]) for r in few_bits.collect()) == want
