"""The queries that SQL can express, against their SQL; the others give the columns they promise."""

import pytest

pytest.importorskip("millrace.llm")
from millrace.llm.queries import ORACLES, QUERIES

from ..compare import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_language_query_learns_from_the_rest_only(spark):
    rows = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and 30 < sum(r["held_out"] for r in rows) < 70
