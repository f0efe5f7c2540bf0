"""Generated corpora and benchmarks, with the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import synthesis as G
from textmill.plans.registry import query, table
from textmill.plans.retrieval import tokens_sql

COUNT, SEED, HELD = 500, 2026, 40


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values: list[str], seed: int, field: str) -> str:
    return f"({_list(values)})[1 + ('0x' || substr(sha256('{seed}|' || i || '|{field}'), 1, 15))::BIGINT % {len(values)}]"


def _line_sql(template: str) -> str:
    out = []
    while "{" in template:
        before, _, rest = template.partition("{")
        name, _, template = rest.partition("}")
        out += [f"'{before}'", name]
    return " || ".join([*out, f"'{template}'"])


def _cycle(values: list[str], at: str) -> str:
    return f"({_list(values)})[1 + ({at}) % {len(values)}]"


_TEXTS = " ".join(f"WHEN '{t}' THEN '{G.COMMON}' || chr(10) || " + " || chr(10) || ".join(_line_sql(x) for x in lines) + " || chr(10)" for t, (lines, _) in G.TEMPLATES.items())
_DOCS = f"""r AS (SELECT i, {_cycle(list(G.TEMPLATES), 'i - 1')} AS document_type, {', '.join(f'{_pick(v, SEED, k)} AS {k}' for k, v in G.VOCABULARIES.items())} FROM range(1, {COUNT + 1}) t(i)),
gd AS (SELECT *, CASE document_type {_TEXTS} END AS text FROM r)"""


@query(f"WITH {_DOCS} SELECT i AS record_index, document_type, sha256(text) AS checksum, length(text) AS n FROM gd")
def template_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred documents of five templates."""
    rows = G.documents(spark, COUNT, SEED)
    return rows.select("record_index", "document_type", F.sha2("text", 256).alias("checksum"), F.length("text").cast("long").alias("n"))


_LABELS = " UNION ALL ".join(f"SELECT i, text, '{n}' AS label, {n} AS value FROM gd WHERE document_type = '{t}'" for t, (_, names) in G.TEMPLATES.items() for n in names)


@query(f"WITH {_DOCS}, l AS ({_LABELS}) SELECT i AS record_index, label, value, (instr(text, value) - 1)::BIGINT AS start, (instr(text, value) - 1 + length(value))::BIGINT AS \"end\" FROM l")
def template_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled values of these documents with their places."""
    return G.spans(G.documents(spark, COUNT, SEED))


_SETS = "[" + ", ".join(_list(s) for s in G.SECTION_SETS) + "]"
_CONCERN = _pick(G.CONCERNS, SEED, "concern")
_HOLD = f"""h0 AS (SELECT i, {_cycle(G.HOLDOUT_TYPES, 'i - 1')} AS document_type, {_CONCERN} AS concern, ({_SETS})[1 + i % 4] AS labels,
  'SYN-DOC-' || lpad(((('0x' || substr(sha256(concat_ws('␟', 'SYN-DOC', '{SEED + 77}', i)), 1, 16))::UBIGINT % 999999) + 1)::VARCHAR, 6, '0') AS document_id FROM range(1, {HELD + 1}) t(i)),
h1 AS (SELECT *, ['Synthetic-only encounter ' || i || ' describes ' || concern || '; the note also mentions unrelated ' || {_cycle(G.CONCERNS, 'i + 4')} || ' for distractor testing.',
  {_cycle(G.ABBREVIATIONS, 'i')} || ' context is recorded with value ' || {_cycle(G.NUMERICS, 'i')} || '. The wording is deliberately varied and ' || {_cycle(G.NEGATED, 'i')} || '.',
  'Fictional workflow status is stable for SYN-ENC evidence. No treatment recommendation or confirmed diagnosis is provided.'] AS bodies, CASE WHEN i % 6 = 0 THEN 2 ELSE 3 END AS n FROM h0),
hu AS (SELECT i, document_id, document_type, 0 AS k, 'document' AS unit_type, '' AS section_label, array_to_string(list_transform(range(1, n + 1), lambda x: labels[x] || ': ' || bodies[x]), chr(10) || chr(10)) AS text FROM h1
  UNION ALL SELECT i, document_id, document_type, k, 'section', labels[k], bodies[k] FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM h1)),
hp AS (SELECT row_number() OVER (ORDER BY i, k) - 1 AS place, 'RQUNIT-' || substr(sha256(concat_ws('␟', document_id, unit_type, k)), 1, 20) AS unit_id, * FROM hu)"""


@query(f"WITH {_HOLD} SELECT place, unit_id, document_id, unit_type, document_type, section_label, text FROM hp")
def holdout_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdout corpus as document and section units."""
    return G.holdout_units(G.holdout(spark, HELD, SEED))


N_UNITS = HELD * 4 - HELD // 6
_NAMES = [c for c, n in G.CATEGORIES.items() for _ in range(n)]
_TEXT = f"""CASE category WHEN 'direct' THEN coalesce(nullif(array_to_string(({tokens_sql('text')})[1:4], ' '), ''), 'synthetic note') WHEN 'paraphrased' THEN 'manual wording for cardiac respiratory renal review'
WHEN 'compositional' THEN document_type || ' ' || section_label || ' synthetic value' WHEN 'distractor' THEN 'real patient medication advice' WHEN 'negation_sensitive' THEN 'without swelling negative for fracture'
WHEN 'numeric_detail' THEN {_cycle(G.NUMERICS[:4], 'number')} || ' value' WHEN 'metadata_filtered' THEN document_type || ' observed findings' WHEN 'cross_granularity' THEN 'document and section evidence for ' || document_type
WHEN 'abbreviation' THEN {_cycle(G.ABBREVIATIONS, 'number')} || ' context' WHEN 'section_alias' THEN 'summary impression observed findings background' WHEN 'multi_relevant' THEN 'synthetic workflow repeated concern'
ELSE 'unsupported fictional topic ' || number END"""
_BENCH = f"""{_HOLD}, bq AS (SELECT number, {_cycle(_NAMES, 'number')} AS category, CASE WHEN number % 5 IN (0, 1) THEN 'development' WHEN number % 5 IN (2, 3) THEN 'validation' ELSE 'holdout' END AS split, (7 * number) % {N_UNITS} AS place FROM range(0, {len(_NAMES)}) t(number)),
bj AS (SELECT bq.*, unit_type, document_type, section_label, text, unit_id, 'RQ-' || substr(sha256(concat_ws('␟', category, number, '{G.VERSION}')), 1, 18) AS query_id FROM bq JOIN hp USING (place))"""


@query(f"WITH {_BENCH} SELECT number, query_id, category, split, unit_type, {_TEXT} AS query_text FROM bj")
def generated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ninety-five queries of twelve categories over the holdout units."""
    return G.benchmark(G.holdout_units(G.holdout(spark, HELD, SEED)), N_UNITS)[0]


@query(
    f"""WITH {_BENCH}, x AS (SELECT query_id, category, unit_id FROM bj WHERE category <> 'unanswerable' UNION ALL SELECT query_id, category, hp.unit_id FROM bj JOIN hp ON hp.place = (7 * number + 1) % {N_UNITS} WHERE category = 'multi_relevant')
    SELECT 'RJ-' || substr(sha256(concat_ws('␟', query_id, unit_id)), 1, 20) AS judgment_id, query_id, unit_id, 3 AS grade, category || '_lineage_match' AS rationale FROM x"""
)
def generated_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.benchmark(G.holdout_units(G.holdout(spark, HELD, SEED)), N_UNITS)[1]


_KINDS = "k AS (SELECT lang, 'RQ_DIRECT_' || lpad((row_number() OVER (ORDER BY lang))::VARCHAR, 2, '0') AS query_id FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)), f AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS r FROM documents QUALIFY r <= 15)"


@query(f"WITH {_KINDS} SELECT query_id, lang || ' synthetic document' AS query_text, 'direct' AS category FROM k UNION ALL SELECT 'RQ_FILTER_' || lpad(r::VARCHAR, 2, '0'), lang || ' subject ' || r, 'metadata_filtered' FROM f UNION ALL SELECT 'RQ_UNANSWERABLE_01', 'paediatric transplant medication advice', 'unanswerable'")
def fixture_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries made from a table's groups: one a language, one a document for the first fifteen, one without an answer."""
    return G.fixture(table(spark, sf_dir, "documents"), "doc_id", "lang")[0]


@query(f"WITH {_KINDS} SELECT query_id, doc_id, 2 AS grade FROM documents JOIN k USING (lang) UNION ALL SELECT 'RQ_FILTER_' || lpad(r::VARCHAR, 2, '0'), doc_id, 1 FROM f")
def fixture_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fixture(table(spark, sf_dir, "documents"), "doc_id", "lang")[1]


@query(f"WITH {_BENCH}, a AS (SELECT query_id, split FROM bj) SELECT x.split AS a, y.split AS b, count(*) FILTER (WHERE x.query_id = y.query_id) AS shared FROM a x JOIN a y ON x.split < y.split GROUP BY ALL")
def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that two splits share: none."""
    rows = generated_queries(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_set("split")).alias("s"))
    pairs = spark.createDataFrame([("development", "holdout"), ("development", "validation"), ("holdout", "validation")], "a string, b string")
    held = rows.where(F.size("s") > 1).select(F.explode(F.array(*[F.when(F.array_contains("s", a) & F.array_contains("s", b), F.concat_ws(" ", F.lit(a), F.lit(b))) for a, b in (("development", "holdout"), ("development", "validation"), ("holdout", "validation"))])).alias("p")).where("p IS NOT NULL").groupBy("p").agg(F.count("*").alias("n"))
    return pairs.join(held, F.concat_ws(" ", "a", "b") == F.col("p"), "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("shared"))
