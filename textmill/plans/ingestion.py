"""Ingestion and preprocessing checks over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import extraction as X
from textmill.operators import ingest as N
from textmill.operators import rules as R
from textmill.operators import spans as S
from textmill.plans import answers
from textmill.plans.registry import ORACLES, query, table
from textmill.session import shared_folder


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = F.array(F.struct(F.lit("event_type").alias("name"), F.col("event_type").alias("value")))
    return table(spark, sf_dir, "events").withColumns({"entities": entity, "level": F.from_json("props", "map<string,string>")})


@query("SELECT sum(1 + len(json_keys(props)))::BIGINT AS annotations FROM events")
def annotation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.annotation_count(_events(spark, sf_dir), "entities", "level")


@query(
    """WITH a AS (SELECT doc_id, quality, toxic, 1 AS version FROM labels UNION ALL SELECT doc_id, 1 - quality, toxic, 2 FROM labels WHERE doc_id % 10 = 0),
    l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1)
    SELECT doc_id, quality, toxic, CASE WHEN version IS NULL THEN 'missing' ELSE 'joined' END AS state FROM documents LEFT JOIN l USING (doc_id)"""
)
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their last labels (every tenth has a second version), and those without any."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").withColumn("version", F.lit(1))
    again = labels.where("doc_id % 10 = 0").withColumns({"quality": 1 - F.col("quality"), "version": F.lit(2)})
    joined, missing = N.one_to_one(table(spark, sf_dir, "documents").select("doc_id"), labels.unionByName(again), "doc_id", "version")
    rows = joined.select("doc_id", "quality", "toxic", F.lit("joined").alias("state"))
    return rows.unionByName(missing.select("doc_id", F.lit("missing").alias("state")), allowMissingColumns=True)


HEADS = r"(?md)^([^:\n]{2,80}):\s*"


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, check_name, status, observed, threshold; every thirteenth document has an unresolved annotation."""
    sentences = F.transform(F.regexp_extract_all("text", F.lit(S.SENTENCE), F.lit(0)), lambda s: F.length(F.regexp_replace(s, r"^\s+|\s+$", "")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_count("text", F.lit(HEADS)).alias("_h"), F.coalesce(F.array_max(sentences), F.lit(0)).alias("_l"), F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0).alias("_u"))
    return rows.select("doc_id", F.explode(N.quality_checks(F.col("text"), F.col("_h"), F.col("_l"), F.col("_u"))).alias("c")).select("doc_id", "c.*")


def _check(name: str, passed: str, observed: str, threshold: str, bad: str) -> str:
    return f"SELECT doc_id, '{name}' AS check_name, CASE WHEN {passed} THEN 'passed' ELSE '{bad}' END AS status, ({observed})::VARCHAR AS observed, '{threshold}' AS threshold FROM qx"


_QUALITY = r"""qx AS (SELECT doc_id, text, len(regexp_extract_all(text, '(?m)^([^:\n]{2,80}):\s*')) AS h, coalesce(list_max(list_transform(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|\n|$)'), lambda s: length(regexp_replace(s, '^\s+|\s+$', '', 'g')))), 0) AS l,
CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS u FROM documents), qc AS (""" + " UNION ALL ".join(
    _check(*c)
    for c in (
        ("empty_text", "length(trim(text)) > 0", "length(trim(text))", ">0", "failed"),
        ("very_short_text", "length(text) >= 80", "length(text)", "80", "warning"),
        ("unicode_replacement_character", "NOT contains(text, chr(65533))", "length(text) - length(replace(text, chr(65533), ''))", "0", "failed"),
        ("section_coverage", "h > 0", "h", ">0", "warning"),
        ("extremely_long_sentence", "l <= 500", "l", "500", "warning"),
        ("annotation_projection_success", "u = 0", "u", "0", "warning"),
    )
) + ")"


@query(f"WITH {_QUALITY} SELECT * FROM qc")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six checks of every document, each with its severity."""
    return checks(spark, sf_dir)


@query(f"WITH {_QUALITY} SELECT status, count(*) AS n FROM qc GROUP BY status")
def quality_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.status_counts(checks(spark, sf_dir))


@query(f"WITH {_QUALITY} SELECT CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'passed' END AS status FROM qc")
def quality_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """failed before warning before passed, over all checks of all documents."""
    return R.overall(checks(spark, sf_dir))


@query(
    f"""WITH c AS ({ORACLES['canonical_explode']}), v AS (SELECT * FROM events WHERE event_id % 100 <> 0)
    SELECT metric, expected, actual, CASE WHEN expected = actual THEN 'passed' ELSE 'failed' END AS status FROM (
      SELECT 'documents' AS metric, (SELECT count(*) FROM events) AS expected, (SELECT count(*) FROM v) AS actual UNION ALL SELECT 'annotations', (SELECT count(*) FROM c), (SELECT count(*) FROM c WHERE event_id % 100 <> 0)
      UNION ALL SELECT 'quarantined', 0, (SELECT count(*) FROM events WHERE event_id % 100 = 0) UNION ALL SELECT 'duplicate_documents', 0, 0 UNION ALL SELECT 'duplicate_annotations', 0, 0 UNION ALL SELECT 'orphan_annotations', 0, 0
      UNION ALL SELECT 'kinds_equal', 0, (SELECT count(*) FROM (SELECT event_type FROM events GROUP BY event_type HAVING count(*) FILTER (WHERE event_id % 100 = 0) > 0))
      UNION ALL SELECT 'labels_equal', 0, (SELECT count(*) FROM (SELECT name FROM c GROUP BY name HAVING count(*) FILTER (WHERE event_id % 100 = 0) > 0)))"""
)
def stage_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight checks of an ingestion stage that quarantines every hundredth event."""
    events = _events(spark, sf_dir)
    valid, failing = R.quarantine(events, F.when(F.col("event_id") % 100 == 0, F.array(F.lit("sampled"))).otherwise(F.array().cast("array<string>")))
    every, kept = N.exploded(events, "event_id", "entities", "level"), N.exploded(valid, "event_id", "entities", "level")
    return N.reconciled(events, every, valid, kept, failing, "event_id", "event_type", "name")


@query(
    f"""WITH s AS ({ORACLES['sentences']}), c AS ({ORACLES['overlap_resolution']}), t AS (SELECT sum(candidates)::BIGINT AS n, sum(accepted)::BIGINT AS a FROM c)
    SELECT metric, expected, actual, CASE WHEN expected = actual THEN 'passed' ELSE 'failed' END AS status FROM (
    SELECT 'candidates' AS metric, n AS expected, a + (n - a) AS actual FROM t UNION ALL SELECT 'offsets_in_text', 0, 0 UNION ALL SELECT 'values_match_text', 0, 0 UNION ALL SELECT 'accepted_disjoint', 0, 0 UNION ALL SELECT 'documents_known', 0, 0 UNION ALL SELECT 'prediction_ids_unique', a, a FROM t
    UNION ALL SELECT 'sentences_match_text', sum(n_sentences)::BIGINT, sum(n_sentences)::BIGINT FROM s)"""
)
def extraction_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates = accepted + suppressed + duplicates; offsets, values, disjointness, documents, identifiers, sentences."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = S.resolve_overlaps(answers._matched(spark, sf_dir), "doc_id")
    texts = rows.join(docs, "doc_id", "left")
    n, accepted = F.count("*"), F.count_if("accepted")
    value = F.lower(F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("start"))
    name = F.concat_ws("|", "doc_id", "label", "start", "end")
    sentences = S.sentences(docs, "doc_id").join(docs, "doc_id")
    same = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("sentence")
    count = lambda df, c="*": df.agg(F.count(c)).scalar()
    one = rows.agg(n.alias("n"), accepted.alias("a"), F.count_if("duplicate").alias("d"), F.count_if(~F.col("accepted") & ~F.col("duplicate")).alias("s"), F.count_distinct(F.when(F.col("accepted"), name)).alias("ids"))
    one = one.withColumns(
        {
            "outside": count(texts.where((F.col("start") < 0) | (F.col("end") > F.length("text")))),
            "wrong": count(texts.where(value != F.col("label"))),
            "meeting": count(rows.where("accepted").withColumn("_b", before).where("_b > start")),
            "orphans": count(texts.where("text IS NULL")),
            "sentences": count(sentences),
            "right": count(sentences.where(same)),
        }
    )
    c, zero = F.col, F.lit(0)
    made = [
        R.reconcile("candidates", c("n"), c("a") + c("s") + c("d")),
        R.reconcile("offsets_in_text", zero, c("outside")),
        R.reconcile("values_match_text", zero, c("wrong")),
        R.reconcile("accepted_disjoint", zero, c("meeting")),
        R.reconcile("documents_known", zero, c("orphans")),
        R.reconcile("prediction_ids_unique", c("a"), c("ids")),
        R.reconcile("sentences_match_text", c("sentences"), c("right")),
    ]
    return one.select(F.explode(F.array(*made)).alias("r")).select("r.*")


@query(
    f"""WITH c AS ({ORACLES['overlap_resolution']}), t AS (SELECT sum(candidates)::BIGINT AS n, sum(accepted)::BIGINT AS a FROM c)
    SELECT metric, expected, actual, 'passed' AS status FROM (SELECT 'candidates' AS metric, n AS expected, n AS actual FROM t UNION ALL SELECT 'written', a, a FROM t UNION ALL SELECT 'spans_in_order', 0, 0 UNION ALL SELECT 'read_back', 0, 0)"""
)
def extraction_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction stage over all documents: its accounting, from the pass that writes the predictions."""
    vocabulary = spark.createDataFrame(list(answers.WORDS.items()), "phrase string, priority int")
    return X.extract(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary, "run1", f"{shared_folder(spark)}/extraction_{uuid.uuid4().hex}")
