"""Template sentences are found wherever their lines are wrapped."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("millrace.llm")
from millrace.llm import licenses

BSD = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided"


def test_wrapped_templates(spark):
    rows = [(0, BSD, "bsd"), (1, ISC, "isc"), (2, None, ""), (3, "in source\n" * 50 + "and binary forms", "")]
    rows += [(10 + k, "some words\n" + "\n".join(text.split()) + "\nmore", label) for k, (text, label) in enumerate(licenses.TEMPLATES)]
    rows.append((40, "\n".join(" word ".join(["", w, "x", "y"]) for w in licenses.TEMPLATES[5][0].split()), ""))  # all words, but far apart
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string")
    for r in licenses.scan_licenses(docs).collect():
        found = set(filter(None, r["_license"]["labels"].split(",")))
        assert (r["want"] in found) if r["want"] else not found, r
