"""Every registered query against its SQL on the smallest tables (all topics with CHATLAKE_ALL=1)."""

import os

import oracle
import pytest

from chatlake import catalog

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracles()
SLOW = {"keyword_relaxed", "search_keyword_only", "semantic_anchors", "hybrid_hits", "grouped_hits", "result_counts", "eval_topk", "keyword_bm25", "search_snippets"}
NAMES = [n for n in QUERIES if os.environ.get("CHATLAKE_ALL") or n not in SLOW]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert oracle.compare(df, con, SQL[name]) is None
    else:
        assert df.count() >= 0
