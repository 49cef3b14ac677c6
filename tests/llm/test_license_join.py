"""The license scan's join with many templates, and among columns of any name, against brute force."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("millrace.llm")
from millrace.llm import licenses


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def brute(text, templates, threshold):
    """Labels by lines, and by windows for templates in no line; the largest share."""
    labels, best = set(), 0.0
    w = words(text)
    for t, label in templates:
        own = set(t.split())
        need = -(-int(round(threshold * 1000)) * len(own) // 1000)
        lines = [len(own & set(words(line))) for line in (text or "").split("\n")]
        size = -(-len(own) * 1000 // int(round(threshold * 1000)))
        n = max(lines)
        if n < need:
            n = max((len(own & set(w[i : i + size])) for i in range(len(w)) if w[i] in own), default=0)
        if n >= need:
            labels.add(label)
            best = max(best, n / len(own))
    return ",".join(sorted(labels)), best


def test_many_templates(spark):
    rng = random.Random(11)
    vocabulary = [f"t{i}" for i in range(400)]
    templates = tuple((" ".join(rng.sample(vocabulary, rng.randrange(3, 16))), f"label{i}") for i in range(300))
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(1, 5)):
            own = rng.choice(templates)[0].split()
            rng.shuffle(own)
            kept = [w for w in own if rng.random() < 0.9] + rng.choices(vocabulary, k=rng.randrange(4))
            text.append(("\n" if rng.random() < 0.3 else " ").join(kept))
        rows.append((i, rng.choice((" x ", "\n")).join(text), i, str(i), True))
    rows += [(200, None, 1, "a", None), (201, "", 1, "a", None), (201, "", 1, "a", None), (202, "t1 " * 5000, 2, "b", False)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _words int, _l_hits string, _license boolean")
    found = licenses.scan_licenses(table, templates)
    result = found.columns[-1]
    assert found.columns[:-1] == table.columns and result not in table.columns
    assert Counter(tuple(r)[:-1] for r in found.collect()) == Counter(map(tuple, rows))
    for r in found.collect():
        labels, best = brute(r["text"], templates, licenses.THRESHOLD)
        assert r[result]["labels"] == labels and abs(r[result]["score"] - best) < 1e-12, r


def test_few_words_needed(spark):
    templates = (("one two", "pair"), ("a", "single"))
    rows = [(1, "two x one"), (2, "one"), (3, "A"), (4, "two\none")]
    got = {r["doc_id"]: r["_license"]["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert got == {1: "pair", 2: "", 3: "single", 4: "pair"}
