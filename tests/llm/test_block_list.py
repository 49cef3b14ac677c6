"""The url filter's block list on the tables: the cascade really decides, on the larger one by more than one level."""

import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("millrace.llm")
from millrace.llm import urlfilter
from millrace.llm.common import durable

BAD = re.compile(r"(?:^|\.)(?:ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(?:com|net|org)$")


@pytest.mark.parametrize("size", ("sf0.01", "sf0.1"))
def test_listed_hosts_are_blocked(spark, size):
    pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet").select("page_id", "url")
    names = spark.createDataFrame([(h,) for h in urlfilter.LISTED], "key string")
    rows = urlfilter.judge_urls(pages).collect()
    assert Counter(map(tuple, urlfilter.judge_urls(pages, listed=names).collect())) == Counter(map(tuple, rows))  # the list as a table
    bad = [r["verdict"] for r in rows if BAD.search(r["host"]) and r["rule"] is None]
    print(size, "bad hosts without a rule", len(bad), "blocked", bad.count("block"))
    assert bad and set(bad) == {"block"}
    universe = durable(urlfilter.key_universe(pages.select(urlfilter.host_of(F.col("url")).alias("host")), names))
    levels = urlfilter.build_cascade(universe)
    through = universe.filter("not listed").filter(levels[0].has(F.col("key"))).count()
    print(size, "listed keys", universe.filter("listed").count(), "of", universe.count(), "levels", len(levels), "false positives", through)
    assert universe.filter("listed").count() > 0 and levels
    if size == "sf0.1":  # the smaller table has too few keys for a false positive
        assert len(levels) > 1 and through > 0
