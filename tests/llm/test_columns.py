"""Columns of the user named as the operators name their own; rows without an id; hashes that share their upper bits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import line_chunks, media, near_dedup, suffix_dedup, urls

OWN = ("_g", "_t", "_kept", "_tokens", "_rule", "_row", "_doc", "_text", "_order", "_class", "_keys", "_confidence", "_bytes")
LINES = "first shared line of text\nsecond shared line of text\nthird shared line"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, LINES), (2, LINES + "\nits own"), (3, "alone"), (None, LINES), (None, None), (4, None)]
    return spark.createDataFrame([(*r, *[f"{c} {i}" for c in OWN]) for i, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in OWN))


def same_columns(before, after):
    key = lambda rows: sorted((tuple(r[c] for c in ("doc_id", *OWN)) for r in rows), key=repr)
    assert key(before.collect()) == key(after.collect())


def test_user_columns_keep_their_values(spark, odd):
    strings = suffix_dedup.suffix_dedup(odd, as_text=True)
    assert strings.columns == [*odd.columns, "kept", "n_bytes", "n_removed", "spans"]
    same_columns(odd, strings)
    lines = line_chunks.line_dedup(odd)
    assert lines.columns == [*odd.columns, "n_lines", "n_removed_lines", "n_removed_runs"]
    same_columns(odd, lines)
    assert near_dedup.one_of_each_class(odd).columns == odd.columns
    kept = {r["doc_id"]: r for r in near_dedup.one_of_each_class(odd).where("doc_id IS NOT NULL").collect()}
    assert kept[1]["_g"] == "_g 0" and kept[3]["_order"] == "_order 2"


def test_user_columns_of_pages(spark):
    pages = spark.createDataFrame([(i, f"https://a.example/p{i % 3}?k={i}", *[f"{c} {i}" for c in OWN]) for i in range(12)], "page_id long, url string, " + ", ".join(f"{c} string" for c in OWN))
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(12)], "page_id long, bad boolean")
    out = urls.filter_urls(pages, labels)
    assert out.columns == [*pages.columns, "host", "path", "rule", "mined_confidence", "verdict"]
    assert all(r[c] == f"{c} {r['page_id']}" for r in out.collect() for c in OWN)


def test_rows_without_an_id_give_and_lose_nothing(spark):
    text = "x" * 30 + "repeated in every one of these rows, without an id or with one" * 2
    rows = [(None, text)] * 200 + [(1, text), (2, text), (None, None)]
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], len(r["spans"])) for r in out.collect()}
    n = len(text)
    assert out.count() == 203 and found == {(None, text.encode(), n, 0, 0), (None, b"", 0, 0, 0), (1, text.encode(), n, 0, 0), (2, b"", n, n, 1)}


def test_triggers_with_equal_sent_bits_meet_in_one_bucket():
    rng = np.random.default_rng(5)
    bare = rng.integers(0, 1 << 46, 1000, dtype=np.uint64) << np.uint64(18)
    low = rng.integers(0, 1 << 18, (2, 1000), dtype=np.uint64)
    for buckets in (48, 144, 1001):
        a, b = (suffix_dedup.bucket_of(bare | x, buckets) for x in low)
        assert (a == b).all() and len(np.unique(a)) == buckets or buckets > 500


def test_tag_notes_that_are_digits_in_unicode_only():
    """A length that is no ASCII decimal is no length: the payload is then all of the data."""
    stream = media.write_stream(b"payload" * 40)
    assert media.read_stream(stream)["payload"] == b"payload" * 40
    assert media.read_stream(stream.replace(b"280", "\u00b2".encode("latin-1") + b"80", 1))["payload"].startswith(b"payload" * 40)


def test_table_of_runs():
    """A stream whose first frame has a VBRI table: frames, bytes and runs are read, and the frame holds no payload."""
    body = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (5000).to_bytes(4, "big") + (3).to_bytes(4, "big")
    body += b"".join(n.to_bytes(2, "big") for n in (2, 1, 2, 2)) + (800).to_bytes(2, "big") + (400).to_bytes(2, "big")
    frames = [media._frame(9, bytes([i]) * 50) for i in range(3)]
    info = media.read_stream(media._frame(9, bytes(13) + body) + b"".join(frames))
    assert info["vbr"] == {"frames": 3, "bytes": 5000, "toc": [800, 400], "frames_per_entry": 2}
    assert info["frames"] == 3 and info["payload"].startswith(bytes(50)) and "vbr=1" in media.feature(info)
    cut = media._frame(9, bytes(13) + body.replace((2).to_bytes(2, "big"), (9999).to_bytes(2, "big"), 1))
    assert media.read_stream(cut + frames[0])["vbr"]["toc"] is None


def test_repeated_rows_of_one_document(spark):
    docs = spark.createDataFrame([(1, LINES), (1, LINES), (2, LINES)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dedup.one_of_each_class(docs).collect()) == [1]
    assert near_dedup.near_duplicates(docs).where(F.col("class_id") != 1).count() == 0
