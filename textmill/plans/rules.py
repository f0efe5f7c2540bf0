"""Queries over rule tables, text features and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import ids
from textmill.functions import text as X
from textmill.operators import features as Q
from textmill.operators import index as I
from textmill.operators import rules as R
from textmill.plans.registry import query, table
from textmill.plans.retrieval import TOKENS, tokens_sql

_QUOTE = str.maketrans({"'": "''"})


def _checks_sql(patterns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{n}' AS check_name, CASE WHEN regexp_matches(text, '{p.translate(_QUOTE)}') THEN 'failed' ELSE 'passed' END AS status FROM documents" for n, p in patterns.items())


_PLAIN = {k: p for k, p in R.PRIVACY.items() if "(?!" not in p}


@query(_checks_sql(_PLAIN))
def privacy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and privacy check (the check with a look-ahead has a query of its own)."""
    return R.long_checks(table(spark, sf_dir, "documents"), "doc_id", R.pattern_checks(F.col("text"), _PLAIN))


@query("SELECT doc_id, 'long_unapproved_number' AS check_name, CASE WHEN regexp_matches(replace(text, 'SYN-', 'SYN-x'), '\\b\\d{7,}\\b') THEN 'failed' ELSE 'passed' END AS status FROM documents")
def privacy_long_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = {"long_unapproved_number": R.PRIVACY["long_unapproved_number"]}
    return R.long_checks(table(spark, sf_dir, "documents"), "doc_id", R.pattern_checks(F.col("text"), only))


_ARRAY = "[" + ", ".join(f"'{p}'" for p in R.PROHIBITED) + "]"


@query(f"SELECT conv_id, turn, len(list_filter({_ARRAY}, lambda p: contains(lower(text), p)))::BIGINT AS violations FROM conversations")
def answer_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(R.prohibited(F.col("text"))).cast("long").alias("violations"))


def _class_sql() -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(t, '{p}')" for p in phrases) + f" THEN '{name}'" for name, phrases in R.UNSUPPORTED)
    return f"CASE {whens} WHEN contains(t, 'metadata') THEN 'synthetic_metadata_query' WHEN contains(t, 'compare') THEN 'synthetic_comparison' WHEN contains(t, 'summary') THEN 'synthetic_summary_request' ELSE 'synthetic_record_lookup' END"


_PROBES = ("is this an emergency", "show my patient", "which dosage", "what should happen", "do i have it", "give medical advice", "metadata of this", "compare these", "a summary", "Nothing special")
_PROBE_ARRAY = "[" + ", ".join(f"'{p}'" for p in _PROBES) + "]"


@query(f"SELECT conv_id, turn, {_class_sql()} AS category FROM (SELECT conv_id, turn, lower(text || ' ' || {_PROBE_ARRAY}[1 + (conv_id + turn) % 10]) AS t FROM conversations WHERE role = 'user')")
def query_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each user turn, to which one of ten probe phrases is added so that every class occurs."""
    probes = F.array(*[F.lit(p) for p in _PROBES])
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    text = F.concat("text", F.lit(" "), F.element_at(probes, (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(10)) + 1).cast("int")))
    return asked.select("conv_id", "turn", R.query_class(text).alias("category"))


_CHECKS = {"too_short": "length(text) < 80", "replacement_character": "contains(text, chr(65533))", "no_sentence_end": "NOT regexp_matches(text, '[.!?]')", "empty": "length(trim(text)) = 0"}


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CHECKS.items()) + "], lambda x: x IS NOT NULL) AS reasons FROM documents")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the quality checks that it fails."""
    text = F.col("text")
    failed = F.array_compact(
        F.array(
            F.when(F.length(text) < 80, F.lit("too_short")),
            F.when(F.contains(text, F.lit("�")), F.lit("replacement_character")),
            F.when(~text.rlike("[.!?]"), F.lit("no_sentence_end")),
            F.when(F.length(F.trim(text)) == 0, F.lit("empty")),
        )
    )
    valid, failing = R.quarantine(table(spark, sf_dir, "documents").select("doc_id", "text"), failed)
    return valid.select("doc_id", F.array().cast("array<string>").alias("reasons")).unionByName(failing.select("doc_id", "reasons"))


@query(
    """SELECT metric, expected, actual, CASE WHEN expected = actual THEN 'passed' ELSE 'failed' END AS status FROM (
    SELECT 'unique_documents' AS metric, count(*) AS expected, count(DISTINCT doc_id) AS actual FROM documents
    UNION ALL SELECT 'unique_texts', count(*), count(DISTINCT text) FROM documents
    UNION ALL SELECT 'orphan_labels', 0, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'declared_characters', sum(n_chars)::BIGINT, sum(length(text))::BIGINT FROM documents
    UNION ALL SELECT 'labelled_documents', (SELECT count(*) FROM documents), (SELECT count(*) FROM labels))"""
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    one = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_distinct("text").alias("texts"), F.sum("n_chars").alias("declared"), F.sum(F.length("text")).alias("chars"))
    one = one.withColumns({"orphans": labels.join(docs, "doc_id", "left_anti").agg(F.count("*")).scalar(), "labels": labels.agg(F.count("*")).scalar()})
    c = F.col
    rows = [R.reconcile("unique_documents", c("n"), c("ids")), R.reconcile("unique_texts", c("n"), c("texts")), R.reconcile("orphan_labels", F.lit(0), c("orphans")), R.reconcile("declared_characters", c("declared"), c("chars")), R.reconcile("labelled_documents", c("n"), c("labels"))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_EXTRA = {"the": ["this"], "erst": ["first"]}


def _expansion_sql() -> str:
    kinds = {"synonym": Q.SYNONYMS | _EXTRA, "abbreviation": Q.ABBREVIATIONS, "section_alias": Q.ALIASES}
    rows = ", ".join(f"('{k}', '{e}', '{kind}')" for kind, t in kinds.items() for k, v in t.items() for e in v)
    return f"WITH {TOKENS}, rules(term, expanded, kind) AS (VALUES {rows}) SELECT item_id, term, expanded, kind, count(*) AS n FROM qt JOIN rules USING (term) GROUP BY ALL"


@query(_expansion_sql())
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansions of the benchmark texts; two entries are added for words that these texts use."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(Q.expansions(F.col("text"), _EXTRA)).alias("e")).select("item_id", "e.*")
    return rows.groupBy("item_id", "term", "expanded", "kind").agg(F.count("*").alias("n"))


_NEGATED = rf"""
SELECT doc_id, term, polarity FROM (
  SELECT doc_id, unnest(list_filter(toks, lambda t: t NOT IN ('no', 'not', 'without', 'denies', 'negative', 'for', 'absence', 'of'))) AS term, 'affirmed' AS polarity FROM n
  UNION ALL SELECT doc_id, unnest(flatten(list_transform(list_filter(range(1, len(toks) + 1), lambda i: toks[i] IN ('no', 'not', 'without', 'denies')), lambda i: toks[i + 1:i + 5]))), 'negated' FROM n
  UNION ALL SELECT doc_id, unnest({tokens_sql("regexp_replace(t, '(?s)^.*?negative for', '')")}[1:5]), 'negated' FROM n WHERE contains(t, 'negative for')
  UNION ALL SELECT doc_id, unnest({tokens_sql("regexp_replace(t, '(?s)^.*?absence of', '')")}[1:5]), 'negated' FROM n WHERE contains(t, 'absence of'))
"""


@query(rf"WITH n AS (SELECT doc_id, lower(regexp_replace(text, '\bthe\b', 'no', 'g')) AS t, {tokens_sql("regexp_replace(text, '\\bthe\\b', 'no', 'g')")} AS toks FROM documents) SELECT doc_id, polarity, count(DISTINCT term) AS terms FROM ({_NEGATED}) GROUP BY ALL")
def negation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct negated and affirmed terms; "the" is read as "no", a marker that the invented texts lack."""
    text = F.regexp_replace("text", r"\bthe\b", "no")
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("t")).select("doc_id", F.explode(Q.negation(F.col("t"))).alias("f"))
    return rows.groupBy("doc_id", F.col("f.polarity").alias("polarity")).agg(F.count("*").alias("terms"))


@query(
    r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\d+(?:\.\d+)?)(?:\s?(?i:mm|cm|kg|mg|ml|bpm|percent|%))?')) AS raw FROM documents)
    SELECT doc_id, regexp_extract(raw, '^\d+(?:\.\d+)?')::DOUBLE AS value, CASE lower(regexp_extract(raw, '(?i)(mm|cm|kg|mg|ml|bpm|percent|%)$')) WHEN '%' THEN 'percent' WHEN '' THEN 'number' ELSE lower(regexp_extract(raw, '(?i)(mm|cm|kg|mg|ml|bpm|percent|%)$')) END AS unit, count(*) AS n FROM r GROUP BY ALL"""
)
def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(Q.numbers(F.col("text"))).alias("f")).select("doc_id", "f.value", "f.unit")
    return rows.groupBy("doc_id", "value", "unit").agg(F.count("*").alias("n"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, 'SYN-[A-Z]+-\d+|\d+(?:\.\d+)?|[A-Za-z]+(?:-[A-Za-z]+)?') AS toks FROM documents)
SELECT doc_id, len(toks)::BIGINT AS n_tokens, len(list_distinct(toks))::BIGINT AS n_distinct, len(list_filter(toks, lambda x: regexp_matches(x, '^\d')))::BIGINT AS n_numbers,
CASE WHEN len(toks) = 0 THEN 0 ELSE round(list_sum(list_transform(toks, lambda x: length(x)))::DOUBLE / len(toks), 4) END AS mean_length FROM t""")
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each document; word, number and identifier tokens."""
    pattern = X.PROFILE_TOKEN.removesuffix(r"|[^\w\s]")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("t"))
    n = F.size("t")
    return rows.select("doc_id", n.cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.size(F.filter("t", lambda x: x.rlike(r"^\d"))).cast("long").alias("n_numbers"), F.when(n == 0, 0.0).otherwise(F.round(F.aggregate("t", F.lit(0), lambda s, x: s + F.length(x)) / n, 4)).alias("mean_length"))


@query(r"""SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, round((length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::DOUBLE / length(text), 6) AS digit_share,
round((length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::DOUBLE / length(text), 6) AS upper_share, contains(text, chr(65533)) AS has_replacement, sha256(text) AS checksum FROM documents""")
def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), X.share(t, "[0-9]").alias("digit_share"), X.share(t, "[A-Z]").alias("upper_share"), F.contains(t, F.lit("�")).alias("has_replacement"), ids.checksum_text(t).alias("checksum"))


@query(r"SELECT page_id, sha256(regexp_replace(regexp_replace(replace(regexp_replace(nfc_normalize(html), '\r\n?', chr(10), 'g'), chr(9), '    '), '[ ]+(\n|$)', '\1', 'g'), '(\S) {2,}', '\1 ', 'g')) AS checksum FROM pages")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of the normalised pages."""
    return table(spark, sf_dir, "pages").select("page_id", ids.checksum_text(X.normalise(X.nfc(F.col("html")))).alias("checksum"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(lower(translate(text, '‐‑‒–—‘’“”', '-----''''""')), '\s+', ' ', 'g'))) AS checksum FROM documents""")
def analytical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.checksum_text(X.analytical(F.col("text"))).alias("checksum"))


@query(f"WITH {TOKENS} SELECT count(*) AS n_units, sum(length)::BIGINT AS n_tokens, round(avg(length), 6) AS avg_length, min(length)::BIGINT AS min_length, max(length)::BIGINT AS max_length, (SELECT count(DISTINCT term) FROM dt) AS n_distinct FROM dl")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.corpus_statistics(I.tokenised(table(spark, sf_dir, "documents"), "doc_id"))


@query(f"WITH {TOKENS} SELECT DISTINCT term FROM dt")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.term_statistics(I.tokenised(table(spark, sf_dir, "documents"), "doc_id")).select("term")


@query(f"WITH {TOKENS} SELECT term, df FROM df")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.term_statistics(I.tokenised(table(spark, sf_dir, "documents"), "doc_id"))


@query(f"WITH {TOKENS}, b AS (SELECT count(*) AS n FROM (SELECT DISTINCT term FROM qt)), c AS (SELECT count(*) AS n FROM df), s AS (SELECT count(*) AS n FROM (SELECT DISTINCT term FROM qt) JOIN df USING (term)) SELECT b.n AS query_terms, c.n AS corpus_terms, s.n AS shared, round(s.n::DOUBLE / b.n, 6) AS overlap FROM b, c, s")
def vocabulary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.term_statistics(I.tokenised(table(spark, sf_dir, "documents"), "doc_id")).select("term", F.lit(1).alias("d"), F.lit(0).alias("q"))
    items = I.term_statistics(I.tokenised(table(spark, sf_dir, "benchmark"), "item_id")).select("term", F.lit(0).alias("d"), F.lit(1).alias("q"))
    both = docs.unionByName(items).groupBy("term").agg(F.max("d").alias("d"), F.max("q").alias("q"))
    sums = both.agg(F.sum("q").alias("query_terms"), F.sum("d").alias("corpus_terms"), F.sum(F.col("q") * F.col("d")).alias("shared"))
    return sums.select("query_terms", "corpus_terms", "shared", X.ratio(F.col("shared"), F.col("query_terms")).alias("overlap"))


@query("SELECT doc_id, 'DOC-' || substr(sha256(concat_ws('␟', lang, source, doc_id)), 1, 24) AS stable_id, 'D_' || substr(sha256('\"' || source || '\"'), 1, 32) AS quoted_id, 'SYN-DOC-' || lpad(((('0x' || substr(sha256(source), 1, 16))::UBIGINT % 999999) + 1)::VARCHAR, 6, '0') AS numbered_id FROM documents")
def deterministic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "documents").select("doc_id", ids.stable_id("DOC", c("lang"), c("source"), c("doc_id")).alias("stable_id"), ids.quoted_id("D", c("source")).alias("quoted_id"), ids.numbered_id("SYN-DOC", F.sha2("source", 256)).alias("numbered_id"))
