"""Tables larger or other than the driver's smallest: the same rows as the SQL."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import functions as F

from textmill.plans import catalogue


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    frame = catalogue.QUERIES[name](spark, str(folder))
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    ours = sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in frame.collect())
    theirs = sorted(repr(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names))) for r in found.fetchall())
    assert sorted(frame.columns) == sorted(names)
    assert ours == theirs
    return ours


def test_added_parts_that_have_the_number_of_old_ones(spark, tmp_path):
    keys = [*range(0, 200), *range(1_000_000, 1_000_200)]
    spark.createDataFrame([(k, k % 50) for k in keys], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert len(same_as_sql(spark, tmp_path, "contract_diff")) > 100


def test_an_index_is_shuffled_to_terms_and_units_once(spark, tmp_path):
    """Postings pass to their terms once: what is written later is derived from the bucketed table."""
    from textmill.operators import store as ST

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 300}" for j in range(400))) for i in range(300)], "doc_id long, text string")
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(spark.sparkContext._jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a large vocabulary
    try:
        ST.build(docs, "doc_id", str(tmp_path / "index"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = stages()
    rows = sum(s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size())) if s.stageId() not in before)
    index = ST.open_index(spark, str(tmp_path / "index"), "doc_id")
    n = index.postings.count()
    assert n > 10_000 and rows < 3.5 * n, (rows, n)
    sums = index.postings.groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(F.col("tf") / F.col("length") * index.idf(), F.lit(2.0)))).alias("x"))
    far = index.units.join(sums, "doc_id").where("abs(norm - x) > 1e-12").count()
    assert far == 0 and index.units.join(sums, "doc_id").count() == 300


def test_negation_of_a_long_text_takes_time_in_proportion(spark):
    """Tokens are cut once for a text, not once for each of its markers (which took minutes here)."""
    import time

    from textmill.operators.features import negation

    words = [w for i in range(20_000) for w in ("no", f"a{i}")]
    frame = spark.createDataFrame([(" ".join(words),)], "t string")
    began = time.time()
    found = [tuple(r) for r in frame.select(F.explode(negation(F.col("t"))).alias("f")).select("f.*").collect()]
    assert time.time() - began < 60
    assert found[:3] == [("a0", "negated"), ("no", "negated"), ("a1", "negated")]
    assert sorted(found) == sorted([("no", "negated")] + [(f"a{i}", p) for i in range(20_000) for p in ("negated", "affirmed")])
