"""Top-k with bounds against a full scan: the same rows from fewer postings."""

from __future__ import annotations

import random

import pytest

from textmill.operators import bounded as BD
from textmill.operators import index as I
from textmill.operators import rank as R
from textmill.operators import store as ST

WORDS = [f"w{i}" for i in range(3000)]


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(3)
    pick = lambda n: [rng.choice(WORDS[:30] if rng.random() < 0.5 else WORDS) for _ in range(n)]  # noqa: E731  few frequent words, many rare
    docs = [(i, " ".join(pick(rng.randint(1, 120)))) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(12)] + [(3000, ""), (3001, None)]  # ties and empties
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return docs, ST.unstored(I.tokenised(frame, "doc_id"), "doc_id")


@pytest.mark.parametrize(("k", "block_units"), [(5, 16), (1, 64), (40, 8)])
def test_rows_of_a_full_scan(spark, index, k, block_units, tmp_path):
    docs, full = index
    rng = random.Random(k)
    asked = [(1, "w0 w1 w2"), (2, "w2999 w1"), (3, docs[7][1]), (4, "none of these"), (5, ""), (6, " ".join(rng.choice(WORDS) for _ in range(30)))]
    queries = I.tokenised(spark.createDataFrame(asked, "item_id long, text string"), "item_id")
    BD.write_blocks(full, str(tmp_path / "b"), block_units)
    blocks = BD.Blocks("doc_id", spark.read.parquet(str(tmp_path / "b" / "impacts")), spark.read.parquet(str(tmp_path / "b" / "maxima")))
    search = BD.bounded_top_k(blocks, queries, "item_id", k)
    expected = R.top_k(R.bm25(full, queries, "item_id"), "item_id", "doc_id", "score", k).select("item_id", "doc_id", "score", "rank")
    assert sorted(map(tuple, search.rows.select("item_id", "doc_id", "score", "rank").collect())) == sorted(map(tuple, expected.collect()))


def test_fewer_postings_are_read(spark, index):
    """A text that is in the table: its own words bound all other blocks away; fewer still with smaller blocks."""
    docs, full = index
    queries = I.tokenised(spark.createDataFrame([(i, docs[i][1]) for i in (7, 30, 55)], "item_id long, text string"), "item_id")
    shares = []
    for units in (256, 64, 8):
        blocks = BD.blocks_of(full, units)
        read, all_ = BD.postings_read(blocks, BD.bounded_top_k(blocks, queries, "item_id", 1))
        shares.append(read / all_)
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.3, shares
