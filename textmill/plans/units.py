"""Queries over retrieval units of three grains, the stored index and extraction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators import blockwise as BW
from textmill.operators import corpus as C
from textmill.operators import index as I
from textmill.operators import spans as S
from textmill.operators import store as ST
from textmill.plans import answers, extended, retrieval
from textmill.plans.registry import query, table
from textmill.plans.retrieval import tokens_sql


def all_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, their turns as sections, and the sentences of these."""
    docs = answers.lines(spark, sf_dir)
    sections = S.sections(docs, "conv_id")
    keyed = sections.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("section_index").cast("string")).alias("_k"), F.col("section_text").alias("text"))
    place = F.split("_k", ":")
    sentences = S.sentences(keyed, "_k").select(place[0].cast("long").alias("conv_id"), place[1].cast("long").alias("section_index"), "sentence_index", "sentence")
    return C.units(docs, sections, sentences, "conv_id")


UNITS = rf"""
ln AS (SELECT conv_id, string_agg(role || ': ' || regexp_replace(text, '[:\n]', ' ', 'g'), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
sec AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS section_index, role AS label,
        regexp_replace(regexp_replace(text, '[:\n]', ' ', 'g') || CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN '' ELSE chr(10) END, '^\s+', '') AS section_text FROM conversations),
sen AS (SELECT conv_id, section_index, label, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sentence_index FROM (
        SELECT conv_id, section_index, label, list_filter(list_transform(regexp_extract_all(section_text, '[^.!?\n]+(?:[.!?]+|\n|$)'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0) AS s FROM sec)),
src AS (SELECT conv_id, 'document' AS unit_type, NULL AS section_label, conv_id::VARCHAR AS source_id, text FROM ln
        UNION ALL SELECT conv_id, 'section', label, conv_id || ':' || section_index, section_text FROM sec
        UNION ALL SELECT conv_id, 'sentence', label, conv_id || ':' || section_index || ':' || sentence_index, sentence FROM sen),
un AS (SELECT 'RU_' || substr(sha256('{{"corpus_version":"1.0.0","source_id":"' || source_id || '","unit_type":"' || unit_type || '"}}'), 1, 24) AS unit_id, *, {tokens_sql('text')} AS toks FROM src)
"""


@query(f"WITH {UNITS} SELECT unit_id, conv_id, unit_type, section_label, source_id, len(toks)::BIGINT AS token_count, sha256(text) AS checksum FROM un")
def retrieval_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, sections and sentences as one table of units."""
    return C.described(all_units(spark, sf_dir))


@query(
    f"""WITH {UNITS} SELECT coalesce(unit_type, 'all') AS unit_type, count(*) AS units, count(DISTINCT conv_id) AS documents, sum(len(toks))::BIGINT AS tokens,
    round(avg(len(toks)), 6) AS average, min(len(toks))::BIGINT AS least, max(len(toks))::BIGINT AS most FROM un GROUP BY GROUPING SETS ((unit_type), ())"""
)
def unit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unit_statistics(all_units(spark, sf_dir), "conv_id")


_UNIT_BM25 = f"""
uq AS (SELECT conv_id AS query_id, {tokens_sql('nfc_normalize(text)')} AS toks FROM conversations WHERE turn = 0 AND conv_id % 5 = 0),
ul AS (SELECT unit_id, unit_type, len(toks) AS length, toks FROM un), up AS (SELECT unit_id, any_value(unit_type) AS unit_type, any_value(length) AS length, term, count(*) AS tf FROM (SELECT unit_id, unit_type, length, unnest(toks) AS term FROM ul) GROUP BY unit_id, term),
uf AS (SELECT term, count(*) AS df FROM up GROUP BY term), us AS (SELECT count(*) AS n, avg(length)::DOUBLE AS a FROM ul),
ut AS (SELECT DISTINCT query_id, unnest(toks) AS term FROM uq),
sc AS (SELECT query_id, unit_type, unit_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / a))), 6) AS score
       FROM ut JOIN up USING (term) JOIN uf USING (term), us GROUP BY query_id, unit_type, unit_id)"""


@query(f"WITH {UNITS}, {_UNIT_BM25} SELECT query_id, unit_type, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_type, unit_id) AS rank FROM sc QUALIFY rank <= 5")
def unit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search across grains: the first turns of a stated query set (conv_id divisible by 5) against all units."""
    first = table(spark, sf_dir, "conversations").where("turn = 0 AND conv_id % 5 = 0").select(F.col("conv_id").alias("query_id"), "text")
    index = ST.index_for(all_units(spark, sf_dir), "unit_id", first, ("unit_type",))
    types = index.units.select("unit_id", "unit_type")
    named = F.concat("unit_type", F.lit("\0"), "unit_id")  # ties go by type, then by id
    rows = BW.best(index, I.tokenised(first, "query_id"), "query_id", "bm25", 5, types, named)
    parts = F.split("unit_id", "\0")
    return rows.select("query_id", parts[0].alias("unit_type"), parts[1].alias("unit_id"), "score", "rank")


_CHECKS = ("unit_ids_unique", "vector_dimension", "vector_finite", "unit_count", "token_count", "document_frequency", "posting_unique")


@query(" UNION ALL ".join(f"SELECT '{c}' AS check_name, 0::BIGINT AS violations" for c in _CHECKS))
def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index read back: every check must find nothing."""
    return ST.read_back(retrieval.stored(spark, sf_dir))


@query(f"SELECT item_id, i - 1 AS position, round(raw[i] / CASE WHEN norm > 0 THEN norm ELSE 1 END, 8) + 0 AS value FROM (SELECT item_id, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS norm, unnest(range(1, 9)) AS i FROM (SELECT item_id, list_transform(range(0, 8), lambda o: ((s + o * 17) % 23 - 11)::DOUBLE) AS raw FROM (SELECT item_id, list_sum(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)))::BIGINT AS s FROM benchmark)))")
def encoder_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the test encoder's vectors of the benchmark texts."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(C.test_encoder(F.col("text"))).alias("position", "value"))
    return rows.select("item_id", F.col("position").cast("long").alias("position"), (F.col("value") + 0.0).alias("value"))


@query("SELECT vec_id, CASE WHEN len(embedding) <> (SELECT any_value(len(embedding)) FROM embeddings WHERE vec_id = 0) OR vec_id % 9 = 0 THEN 'dimension' ELSE 'not_finite' END AS fault FROM embeddings WHERE vec_id % 9 = 0 OR vec_id % 11 = 0")
def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors checked; every ninth is cut short and every eleventh spoilt beforehand, so that both faults occur."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    dimension = rows.where("vec_id = 0").select(F.size("v")).first()[0]
    spoilt = F.when(F.col("vec_id") % 9 == 0, F.slice("v", 1, dimension - 1)).when(F.col("vec_id") % 11 == 0, F.transform("v", lambda x: F.lit(float("nan")))).otherwise(F.col("v"))
    return C.vector_faults(rows.withColumn("v", spoilt), "vec_id", "v", dimension)


_VOC = (("VOC_A", "site", 3, ["note"], ["findings"]), ("VOC_B", "site", 2, [], ["findings"]), ("VOC_C", "word", 1, ["note"], []), ("VOC_D", "word", 1, [], []))


@query("SELECT * FROM (VALUES ('RULE_A', 'site', 'VOC_A', 3, 1.0::DOUBLE), ('RULE_B', 'site', 'VOC_B', 2, 0.95::DOUBLE), ('RULE_C', 'word', 'VOC_C', 1, 0.9::DOUBLE), ('RULE_D', 'word', 'VOC_D', 1, 0.85::DOUBLE)) t(rule_id, label, entry_id, priority, confidence)")
def extraction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of four vocabulary entries, one of each specificity."""
    return C.rules(spark.createDataFrame(list(_VOC), "entry_id string, label string, priority int, types array<string>, sections array<string>"))


@query(
    f"""WITH s AS ({extended._spans_sql('[A-Za-z]{9,}')})
    SELECT 'PRED-' || substr(sha256(concat_ws('␟', 'run1', doc_id, 'long_word', start, stop)), 1, 24) AS prediction_id, doc_id, 'long_word' AS label, start, stop AS "end", lower(value) AS normalised_value FROM s"""
)
def extraction_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every long word of every document as a prediction with its identifier."""
    found = S.matches(table(spark, sf_dir, "documents"), "doc_id", "text", "[A-Za-z]{9,}")
    rows = found.select("doc_id", F.lit("long_word").alias("label"), "start", "end", F.col("matched").alias("value"))
    return C.predictions(rows, "doc_id", "run1")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS section_index, role AS predicted, 1.0::DOUBLE AS confidence FROM conversations")
def section_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.section_labels(S.sections(answers.lines(spark, sf_dir), "conv_id"), "conv_id")


_PROHIBITED = ("email", "phone", "address", "html", "c_name")


@query("SELECT table_name, column_name, CASE WHEN column_name IN ('email', 'phone', 'address', 'html', 'c_name') THEN 'failed' ELSE 'passed' END AS status FROM duckdb_columns() WHERE table_name IN ('documents', 'pages', 'customer', 'benchmark') AND NOT internal")
def prohibited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of four tables against prohibited names."""
    return C.prohibited_columns({t: table(spark, sf_dir, t) for t in ("documents", "pages", "customer", "benchmark")}, _PROHIBITED)


@query(
    r"""WITH n0 AS (SELECT page_id, html AS t0, regexp_replace(html, '\r\n?', chr(10), 'g') AS t1 FROM pages), n1 AS (SELECT *, replace(t1, chr(9), '    ') AS t2 FROM n0), n2 AS (SELECT *, regexp_replace(t2, '[ ]+(\n|$)', '\1', 'g') AS t3 FROM n1), n3 AS (SELECT *, regexp_replace(t3, '(\S) {2,}', '\1 ', 'g') AS t4 FROM n2)
    SELECT page_id, step, b <> a AS changed, sha256(b) AS before, sha256(a) AS after FROM (SELECT page_id, 'line_endings' AS step, t0 AS b, t1 AS a FROM n3 UNION ALL SELECT page_id, 'tabs', t1, t2 FROM n3 UNION ALL SELECT page_id, 'trailing_spaces', t2, t3 FROM n3 UNION ALL SELECT page_id, 'inner_spaces', t3, t4 FROM n3)"""
)
def transformation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums before and after each normalisation step of every page."""
    steps = X.normalise_steps(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(X.transformations(F.col("html"), steps)).alias("s")).select("page_id", "s.*")
