"""Segmentation, span and answer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import answers as A
from textmill.operators import phrases as PH
from textmill.operators import rules as R
from textmill.operators import spans as S
from textmill.plans.registry import query, table
from textmill.plans.retrieval import BM25, Q, TOKENS, U, bm25_ranked, ranked_sql, tokens_sql

#: Literal vocabulary of the matching queries: frequent words of the generated texts, with priorities.
WORDS = {"the": 1, "the and": 3, "and": 1, "for the": 2, "of the": 2, "with": 1}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as lines ``role: text``."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat("role", F.lit(": "), F.regexp_replace("text", r"[:\n]", " ")).alias("l")).alias("x"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("text"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS section_index, role AS label, sha256(regexp_replace(regexp_replace(text, '[:\\n]', ' ', 'g') || CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN '' ELSE chr(10) END, '^\\s+', '')) AS checksum FROM conversations")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sections(lines(spark, sf_dir), "conv_id").select("conv_id", "section_index", "label", F.sha2("section_text", 256).alias("checksum"))


@query(r"""WITH m AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|\n|$)'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0)) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, sum(length(s))::BIGINT AS n_chars, sum(regexp_matches(s, '(?i)(^|[^\p{L}\p{N}_])(no|not|without|denies|none)($|[^\p{L}\p{N}_])')::INT)::BIGINT AS n_negated, sum(regexp_matches(s, '\d')::INT)::BIGINT AS n_numeric FROM m GROUP BY doc_id""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.sentences(table(spark, sf_dir, "documents"), "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"), F.sum(F.col("negated").cast("long")).alias("n_negated"), F.sum(F.col("numeric").cast("long")).alias("n_numeric"))


@query("SELECT 1 AS doc_id WHERE false")
def sentence_offsets_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariant: no sentence differs from the slice of its document at its offsets (no row)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = S.sentences(docs, "doc_id").join(docs, "doc_id")
    return rows.where(F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) != F.col("sentence")).select(F.col("doc_id").cast("int").alias("doc_id"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vocabulary phrase found on its own, so that overlapping candidates arise."""
    found = S.matches_each(table(spark, sf_dir, "documents"), "doc_id", "text", {w: S.vocabulary_pattern([w]) for w in WORDS})
    priority = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    return found.withColumn("priority", F.element_at(priority, F.col("label")))


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) AS w FROM documents) SELECT doc_id, lower(w) AS label, count(*) AS n FROM w WHERE lower(w) IN ('the', 'and', 'with') GROUP BY ALL")
def vocabulary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the one-word entries by document."""
    return _matched(spark, sf_dir).where("label IN ('the', 'and', 'with')").groupBy("doc_id", "label").agg(F.count("*").alias("n"))


_WORDS_AT = r"""
ws AS (SELECT doc_id, string_split_regex(text, '[\p{L}\p{N}_]+') AS p, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS m FROM documents),
wk AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS w, unnest(p[2 : len(m) + 1]) AS gap, unnest(p[1 : len(m)]) AS lead FROM ws),
wa AS (SELECT doc_id, i, lower(w) AS w, length(w) AS n, gap, (sum(length(lead) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w))::BIGINT AS start FROM wk),
wp AS (SELECT *, lead(w) OVER o AS w2, lead(n) OVER o AS n2, lead(start) OVER o AS start2 FROM wa WINDOW o AS (PARTITION BY doc_id ORDER BY i))
"""
_SINGLE = ", ".join(f"('{w}', {p})" for w, p in WORDS.items() if " " not in w)
_DOUBLE = ", ".join(f"('{w}', {p})" for w, p in WORDS.items() if " " in w)


@query(
    f"""WITH RECURSIVE {_WORDS_AT}, s1(label, priority) AS (VALUES {_SINGLE}), s2(label, priority) AS (VALUES {_DOUBLE}),
    ca AS (SELECT doc_id, label, start, start + n AS stop, priority FROM wp JOIN s1 ON w = label UNION ALL SELECT doc_id, label, start, start2 + n2, priority FROM wp JOIN s2 ON w || ' ' || w2 = label AND gap = ' '),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, stop - start DESC, start, label) AS r FROM ca),
    f(doc_id, r, label, ok, taken) AS (
      SELECT DISTINCT doc_id, 0::BIGINT, NULL::VARCHAR, NULL::BOOLEAN, []::STRUCT(a BIGINT, b BIGINT)[] FROM o
      UNION ALL SELECT doc_id, r, label, ok, CASE WHEN ok THEN list_append(taken, {{'a': start, 'b': stop}}) ELSE taken END FROM (
        SELECT o.doc_id, o.r, o.label, o.start, o.stop, f.taken, len(list_filter(f.taken, lambda x: x.a < o.stop AND o.start < x.b)) = 0 AS ok FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1))
    SELECT doc_id, label, count(*) AS candidates, sum(ok::INT)::BIGINT AS accepted, 0::BIGINT AS duplicates FROM f WHERE r > 0 GROUP BY doc_id, label"""
)
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, accepted and suppressed spans by document and label."""
    rows = S.resolve_overlaps(_matched(spark, sf_dir), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.count("*").alias("candidates"), F.sum(F.col("accepted").cast("long")).alias("accepted"), F.sum(F.col("duplicate").cast("long")).alias("duplicates"))


_PHRASES = r"""
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS m FROM benchmark),
ph AS (SELECT DISTINCT unnest(m) AS phrase FROM bw UNION SELECT DISTINCT unnest(list_transform(list_filter(range(1, len(m)), lambda i: m[i] <> m[i + 1]), lambda i: m[i] || ' ' || m[i + 1])) FROM bw)
"""


def benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words and pairs of neighbouring (different) words of the benchmark texts, lower-cased."""
    words = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("m"))
    pairs = F.transform(F.slice("m", 2, F.size("m")), lambda w, i: F.when(F.get("m", i) != w, F.concat_ws(" ", F.get("m", i), w)))
    return words.select(F.explode(F.concat("m", F.array_compact(pairs))).alias("phrase")).distinct()


@query(
    f"""WITH {_WORDS_AT}, {_PHRASES},
    ca AS (SELECT doc_id, phrase, start, start + n AS stop FROM wp JOIN ph ON w = phrase UNION ALL SELECT doc_id, phrase, start, start2 + n2 FROM wp JOIN ph ON w || ' ' || w2 = phrase WHERE gap = ' ')
    SELECT doc_id, count(*) AS spans, count(DISTINCT phrase) AS phrases, sum(start)::BIGINT AS starts, sum(stop)::BIGINT AS ends FROM ca GROUP BY doc_id"""
)
def phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase of the benchmark's vocabulary in every document: how many spans and phrases, and the sums of their places."""
    found = PH.phrase_spans(table(spark, sf_dir, "documents"), "doc_id", "text", benchmark_phrases(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count("*").alias("spans"), F.count_distinct("label").alias("phrases"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@query(
    r"""WITH s AS (SELECT doc_id, text, regexp_replace(text, '\n+', ' ', 'g') AS t2, regexp_extract(text, '[A-Za-z]{6,}') AS v FROM documents), x AS (SELECT *, instr(text, v) - 1 AS start, instr(t2, v) AS first FROM s WHERE v <> '')
    SELECT doc_id, CASE WHEN text = t2 THEN 'unchanged' WHEN first > 0 AND instr(substr(t2, first + 1), v) = 0 THEN 'projected' ELSE 'unresolved' END AS status,
    CASE WHEN text = t2 THEN start WHEN first > 0 AND instr(substr(t2, first + 1), v) = 0 THEN first - 1 ELSE -1 END AS start FROM x"""
)
def annotation_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first long word of each document, carried over to a text without line breaks; -1 where that fails."""
    value = F.regexp_extract("text", "[A-Za-z]{6,}", 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace("text", "\n+", " ").alias("t2"), value.alias("v")).where("v <> ''")
    start = (F.instr(F.col("text"), F.col("v")) - 1).cast("long")
    return docs.select("doc_id", S.projected(F.col("text"), F.col("t2"), start, F.col("v")).alias("p")).select("doc_id", "p.status", F.coalesce("p.start", F.lit(-1)).cast("long").alias("start"))


_TYPES = ", ".join(f"('{t}', '{h}', {len(hs)})" for t, hs in S.DOCUMENT_TYPES.items() for h in hs)
_HEADED = "SELECT conv_id, ['findings', 'impression', 'study', 'observations', 'referral reason'][1 + (conv_id + turn) % 5] AS label FROM conversations"


@query(
    f"""WITH rules(type, label, required) AS (VALUES {_TYPES}), h AS (SELECT DISTINCT conv_id, label FROM ({_HEADED})), c AS (SELECT conv_id, type, required, count(*) AS score FROM h JOIN rules USING (label) GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, type) AS r FROM c) SELECT conv_id, type AS predicted, score, round(least(1.0::DOUBLE, 0.55::DOUBLE + score::DOUBLE / required * 0.45::DOUBLE), 6) AS confidence FROM b WHERE r = 1"""
)
def document_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, each turn a section with one of five headings."""
    names = F.array(*[F.lit(x) for x in ("findings", "impression", "study", "observations", "referral reason")])
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.element_at(names, (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) + 1).cast("int")).alias("label"))
    return S.document_types(turns, "conv_id")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = bm25_ranked(spark, sf_dir).join(table(spark, sf_dir, "documents").select(U, "text"), U)
    return A.bundle(ranked, Q, U, "text")


_BUNDLE = f"""WITH {TOKENS}, {BM25}, r AS ({ranked_sql('bm25')}), e AS (SELECT r.item_id, r.doc_id, rank, substr(replace(d.text, chr(10), ' '), 1, 700) AS snippet, 'E' || row_number() OVER (PARTITION BY r.item_id ORDER BY rank) AS label FROM r JOIN d USING (doc_id))"""


@query(f"{_BUNDLE} SELECT item_id, doc_id, label, sum(length(snippet)) OVER (PARTITION BY item_id ORDER BY rank)::BIGINT AS characters, sha256(snippet) AS checksum FROM e")
def evidence_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select(Q, U, "label", "characters", F.sha2("snippet", 256).alias("checksum"))


@query(f"{_BUNDLE} SELECT item_id, label, doc_id, 0::BIGINT AS start, least(120, length(snippet))::BIGINT AS \"end\", substr(snippet, 1, 120) AS quote FROM e WHERE rank <= 2")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of the first two pieces of evidence with their offsets in the snippet."""
    rows = evidence(spark, sf_dir).where("rank <= 2")
    return rows.select(Q, "label", U, F.lit(0).cast("long").alias("start"), F.least(F.lit(A.QUOTE), F.length("snippet")).cast("long").alias("end"), A.quote(F.col("snippet")).alias("quote"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's text as a claim against its first evidence."""
    items = table(spark, sf_dir, "benchmark").select(Q, F.substring("text", 1, A.ANSWER).alias("claim"))
    return evidence(spark, sf_dir).where("rank = 1").join(items, Q).select(Q, "claim", "snippet", "label", A.support(F.col("claim"), F.col("snippet")).alias("support"))


_SUPPORT = f"""{_BUNDLE}, c AS (SELECT item_id, substr(b.text, 1, 180) AS claim, snippet FROM e JOIN benchmark b USING (item_id) WHERE rank = 1),
ct AS (SELECT item_id, list_distinct({tokens_sql('claim')}) AS ct, list_distinct({tokens_sql('snippet')}) AS et FROM c),
gr AS (SELECT DISTINCT item_id, side, substr(t, i, n) AS g FROM (SELECT item_id, side, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM (
  SELECT item_id, 'c' AS side, ' ' || trim(regexp_replace(lower(claim), '\\s+', ' ', 'g')) || ' ' AS t, unnest([3, 4, 5]) AS n FROM c UNION ALL SELECT item_id, 'e', ' ' || trim(regexp_replace(lower(snippet), '\\s+', ' ', 'g')) || ' ', unnest([3, 4, 5]) FROM c))),
gj AS (SELECT item_id, sum((k = 2)::INT)::DOUBLE / count(*) AS j FROM (SELECT item_id, g, count(*) AS k FROM gr GROUP BY item_id, g) GROUP BY item_id),
sp AS (SELECT item_id, round(greatest(CASE WHEN len(ct) > 0 THEN len(list_intersect(ct, et))::DOUBLE / len(ct) ELSE 0 END, j), 6) AS support FROM ct JOIN gj USING (item_id))"""


@query(f"{_SUPPORT} SELECT item_id, support, support >= 0.20 AS grounded FROM sp")
def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select(Q, "support", (F.col("support") >= A.SUPPORT).alias("grounded"))


@query(f"{_SUPPORT} SELECT count(*) AS answers, round(sum((support >= 0.20)::INT)::DOUBLE / count(*), 6) AS grounded_rate, 1.0::DOUBLE AS citation_rate, 1.0::DOUBLE AS safety_rate FROM sp")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims(spark, sf_dir).select((F.col("support") >= A.SUPPORT).alias("grounded"), F.col("label").isNotNull().alias("cited"), (F.size(R.prohibited(F.col("claim"))) == 0).alias("safe"))
    return A.answer_metrics(rows)
