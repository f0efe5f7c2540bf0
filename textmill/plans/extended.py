"""Composed scores, guarded answers, generation, lookups and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators import answers as A
from textmill.operators import features as QF
from textmill.operators import generate as G
from textmill.operators import grams as GR
from textmill.operators import intervals as IV
from textmill.operators import rank as R
from textmill.operators import rules as RU
from textmill.operators import spans as S
from textmill.plans import answers, retrieval
from textmill.plans.registry import ORACLES, query, table
from textmill.plans.retrieval import BM25, PAIRS, Q, TOKENS, U, pairs, tokens_sql

BASE = f"WITH {TOKENS}, {BM25}, {PAIRS}"
_NUM = r"'(\d+(?:\.\d+)?)(?:\s?(?i:mm|cm|kg|mg|ml|bpm|percent|%))?'"
_UNIT = r"'(?i)(mm|cm|kg|mg|ml|bpm|percent|%)$'"


def _numbers_sql(text: str) -> str:
    unit = f"lower(regexp_extract(r, {_UNIT}))"
    return f"list_transform(regexp_extract_all({text}, {_NUM}), lambda r: regexp_extract(r, '^\\d+(?:\\.\\d+)?')::DOUBLE::VARCHAR || ' ' || CASE {unit} WHEN '' THEN 'number' WHEN '%' THEN 'percent' ELSE {unit} END)"


@query(
    f"""{BASE}, n AS (SELECT item_id, doc_id, {_numbers_sql("q_text || ' 7'")} AS a, {_numbers_sql("d_text || CASE doc_id % 3 WHEN 0 THEN ' 7' WHEN 1 THEN ' 9 mg' ELSE '' END")} AS b FROM p)
    SELECT item_id, doc_id, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE WHEN len(b) = 0 THEN 0.5::DOUBLE WHEN list_has_any(a, b) THEN 1.0::DOUBLE
      WHEN list_has_any(list_transform(a, lambda x: split_part(x, ' ', 1)), list_transform(b, lambda x: split_part(x, ' ', 1))) THEN 0.8::DOUBLE
      WHEN list_has_any(list_transform(a, lambda x: split_part(x, ' ', 2)), list_transform(b, lambda x: split_part(x, ' ', 2))) THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS compatibility FROM n"""
)
def numeric_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the query (with a 7 added) against those of its documents (with a number added to two thirds)."""
    extra = F.when(F.col(U) % 3 == 0, " 7").when(F.col(U) % 3 == 1, " 9 mg").otherwise("")
    p = pairs(spark, sf_dir).select(Q, U, QF.numbers(F.concat("q_text", F.lit(" 7"))).alias("a"), QF.numbers(F.concat("d_text", extra)).alias("b"))
    return p.select(Q, U, QF.numeric_compatibility(F.col("a"), F.col("b")).alias("compatibility"))




@query(
    rf"""{BASE}, t AS (SELECT item_id, doc_id, 'q' AS side, {tokens_sql("regexp_replace(q_text, '\\bthe\\b', 'no', 'g')")} AS toks FROM p
      UNION ALL SELECT item_id, doc_id, 'd', {tokens_sql('d_text')} FROM p),
    f AS (SELECT DISTINCT item_id, doc_id, side, term, polarity FROM (
      SELECT item_id, doc_id, side, unnest(list_filter(toks, lambda t: t NOT IN ('no', 'not', 'without', 'denies', 'negative', 'for', 'absence', 'of'))) AS term, 'affirmed' AS polarity FROM t
      UNION ALL SELECT item_id, doc_id, side, unnest(flatten(list_transform(list_filter(range(1, len(toks) + 1), lambda i: toks[i] IN ('no', 'not', 'without', 'denies')), lambda i: toks[i + 1:i + 5]))), 'negated' FROM t)),
    c AS (SELECT a.item_id, a.doc_id, count(*) AS n FROM f a JOIN f b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND a.term = b.term AND a.polarity <> b.polarity WHERE a.side = 'q' AND b.side = 'd' GROUP BY ALL)
    SELECT item_id, doc_id, greatest(0.0::DOUBLE, 1 - 0.25::DOUBLE * coalesce(n, 0)) AS compatibility FROM p LEFT JOIN c USING (item_id, doc_id)"""
)
def negation_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarity clashes between the query ("the" read as "no") and its documents."""
    p = pairs(spark, sf_dir).select(Q, U, QF.negation(F.regexp_replace("q_text", r"\bthe\b", "no")).alias("a"), QF.negation(F.col("d_text")).alias("b"))
    return p.select(Q, U, QF.negation_compatibility(QF.negation_clashes(F.col("a"), F.col("b"))).alias("compatibility"))


_GRAPH = QF.GRAPH | {"the": ["this", "that"], "and": ["also"]}
_EDGES = ", ".join(f"('{k}', '{e}')" for k, v in _GRAPH.items() for e in v)


@query(f"WITH {TOKENS}, g(term, added) AS (VALUES {_EDGES}) SELECT item_id, added, count(*) AS n FROM qt JOIN g USING (term) GROUP BY ALL")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the items' tokens in the synonym graph, to which two frequent words are added."""
    rows = table(spark, sf_dir, "benchmark").select(Q, F.explode(QF.graph_terms(F.col("text"), _GRAPH)).alias("added"))
    return rows.groupBy(Q, "added").agg(F.count("*").alias("n"))


@query(
    f"""SELECT item_id, doc_id, round(lexical + 0.22::DOUBLE * jaccard + 0.20::DOUBLE * phrase_score + 0.15::DOUBLE * proximity, 5) AS score FROM
    ({ORACLES["char_jaccard"]}) JOIN ({ORACLES["phrase_score"]}) USING (item_id, doc_id) JOIN ({ORACLES["proximity_score"]}) USING (item_id, doc_id)
    JOIN ({BASE} SELECT item_id, doc_id, round(len(list_intersect(list_distinct(q_toks), list_distinct(d_toks)))::DOUBLE / len(list_distinct(q_toks)), 6) AS lexical FROM p) USING (item_id, doc_id)"""
)
def remediation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical coverage with character, phrase and proximity features; nothing in it reads a label."""
    q, d = F.array_distinct("q_toks"), F.array_distinct("d_toks")
    positions = F.filter(F.transform("q_toks", lambda t: F.array_position("d_toks", t)), lambda i: i > 0)
    p = pairs(spark, sf_dir).select(
        Q,
        U,
        F.round(F.size(F.array_intersect(q, d)) / F.size(q), 6).alias("lexical"),
        F.round(GR.pair_jaccard(F.col("q_text"), F.col("d_text")), 6).alias("jaccard"),
        R.phrase_share(X.ngrams(F.col("q_toks"), 2), F.lower("d_text")).alias("phrase"),
        positions.alias("_p"),
    )
    return p.select(Q, U, F.round(F.col("lexical") + 0.22 * F.col("jaccard") + 0.20 * F.col("phrase") + 0.15 * R.proximity(F.col("_p")), 5).alias("score"))


@query(
    f"""{BASE} SELECT item_id, doc_id, item_id % 3 = 0 OR (lang = 'en' AND (item_id % 3 = 1 OR source = 'src1')) AS passes FROM p JOIN documents USING (doc_id)"""
)
def metadata_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunctive equality filters that each query carries as a map: none, one or two fields."""
    filters = F.when(F.col(Q) % 3 == 0, F.create_map().cast("map<string,string>")).when(F.col(Q) % 3 == 1, F.create_map(F.lit("lang"), F.lit("en"))).otherwise(F.create_map(F.lit("lang"), F.lit("en"), F.lit("source"), F.lit("src1")))
    docs = table(spark, sf_dir, "documents").select(U, F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("fields"))
    rows = retrieval.bm25_ranked(spark, sf_dir).join(docs, U).select(Q, U, "fields", filters.alias("filters"))
    return rows.select(Q, U, F.forall(F.map_entries("filters"), lambda e: F.try_element_at("fields", e["key"]) == e["value"]).alias("passes"))


def _spans_sql(pattern: str) -> str:
    """Distinct (doc_id, start, stop, value) of a pattern's matches: where a match begins is the length of all before it."""
    return f"""SELECT DISTINCT doc_id, s + list_sum([0] || list_transform(p[1 : i], lambda x: length(x)))::BIGINT AS start, s + list_sum([0] || list_transform(p[1 : i], lambda x: length(x)))::BIGINT + length(m[i]) AS stop, m[i] AS value FROM (
      SELECT doc_id, p, m, i, list_sum([0] || list_transform(m[1 : i - 1], lambda x: length(x)))::BIGINT AS s FROM (
        SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM documents)))"""


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    o AS (SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l),
    v AS ({_spans_sql('[A-Za-z]{9,}')})
    SELECT doc_id, i AS interval_index, v.start, v.stop AS "end" FROM v JOIN o USING (doc_id) WHERE a <= v.start AND v.stop <= a + length(line)"""
)
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds each long word of each document."""
    docs = table(spark, sf_dir, "documents")
    lines = S.matches(docs, U, "text", r"[^\n]+|(?<=\n)(?=\n|$)|^(?=\n)|^$").select(U, "index", "start", "end")
    words = S.matches(docs, U, "text", "[A-Za-z]{9,}").select(U, "start", "end")
    return IV.containing(words, lines, U).where("contained").select(U, "interval_index", "start", "end")


_POLICIES = {"exact": "t.start = p.start AND t.stop = p.stop", "normalised": "lower(t.value) = lower(p.value)", "relaxed": "t.start < p.stop AND p.start < t.stop"}


@query(
    f"WITH t AS ({_spans_sql('[0-9]{3,}')}), p AS ({_spans_sql('[0-9]{3,5}')}) "
    + " UNION ALL ".join(
        f"""SELECT 'number' AS label, (SELECT count(*) FROM t WHERE EXISTS (SELECT 1 FROM p WHERE p.doc_id = t.doc_id AND {c})) AS tp,
        (SELECT count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE p.doc_id = t.doc_id AND {c})) AS fp, (SELECT count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = t.doc_id AND {c})) AS fn, '{n}' AS policy"""
        for n, c in _POLICIES.items()
    )
)
def matching_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number spans of two rules under three matching policies."""
    docs = table(spark, sf_dir, "documents")
    spans = lambda pattern: S.matches(docs, U, "text", pattern).select(U, F.lit("number").alias("label"), "start", "end", F.col("matched").alias("value"))
    out = None
    for policy in ("exact", "normalised", "relaxed"):
        rows = S.span_scores(spans("[0-9]{3,}"), spans("[0-9]{3,5}"), U, policy).withColumn("policy", F.lit(policy))
        out = rows if out is None else out.unionByName(rows)
    return out


_PICK = {k: f"([{', '.join(repr(x) for x in v)}])[1 + ('0x' || substr(sha256('2026|' || i || '|{k}'), 1, 15))::BIGINT % {len(v)}]" for k, v in G.VALUES.items()}


@query(
    f"""WITH r AS (SELECT i, ([{', '.join(repr(t) for t in G.TYPES)}])[1 + (i - 1) % 5] AS document_type, {', '.join(f'{e} AS {k}' for k, e in _PICK.items())} FROM range(1, 501) t(i)),
    d AS (SELECT *, 'Reason: ' || concern || chr(10) || 'Test: ' || investigation || ' of ' || site || chr(10) || 'Status: ' || status AS text FROM r)
    SELECT i AS record_index, document_type, text, epoch(TIMESTAMP '2026-01-01 08:00:00' + INTERVAL (3 * i) HOUR)::BIGINT AS created_at, instr(text, site) - 1 AS site_start, instr(text, site) - 1 + length(site) AS site_end FROM d"""
)
def generated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred generated documents with the place of one labelled value."""
    rows = G.documents(spark, 500, 2026).withColumn("_s", G.span_of(F.col("text"), F.col("site")))
    return rows.select("record_index", "document_type", "text", F.unix_timestamp(F.col("created_at").cast("timestamp")).alias("created_at"), F.col("_s.start").alias("site_start"), F.col("_s.end").alias("site_end"))


@query("SELECT role, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS r FROM conversations) WHERE r <= 5")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five turns of each role (a sampling operator)."""
    return G.capped(table(spark, sf_dir, "conversations").select("role", "conv_id", "turn"), "role", ["conv_id", "turn"], 5)


@query("SELECT CASE WHEN item_id % 5 IN (0, 1) THEN 'train' WHEN item_id % 5 IN (2, 3) THEN 'validation' ELSE 'holdout' END AS split, count(*) AS n, min(item_id) AS first_item, count(DISTINCT text) AS texts FROM benchmark GROUP BY ALL")
def benchmark_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when((F.col(Q) % 5).isin(0, 1), "train").when((F.col(Q) % 5).isin(2, 3), "validation").otherwise("holdout")
    return table(spark, sf_dir, "benchmark").groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min(Q).alias("first_item"), F.count_distinct("text").alias("texts"))


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, status and answer of every benchmark text, asked as a query."""
    return guarded_rows(spark, sf_dir).select(Q, "status", "answer")


def guarded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with question, confidence, support, and the label and snippet of the first evidence."""
    asked = table(spark, sf_dir, "benchmark").select(Q, F.concat("text", F.when(F.col(Q) % 10 == 0, " which dosage").otherwise("")).alias("question"))
    sure = retrieval.confidence_abstain(spark, sf_dir).select(Q, "confidence")
    claims = answers.claims(spark, sf_dir)
    rows = asked.join(sure, Q, "left").join(claims, Q, "left")
    state = A.status(RU.query_class(F.col("question")), F.col("confidence"), F.coalesce("support", F.lit(0.0)), F.size(RU.prohibited(F.coalesce("snippet", F.lit("")))) == 0)
    text = F.when(F.col("status") == "grounded_answer", F.concat(F.lit(A.OPENING), F.substring("snippet", 1, A.ANSWER), F.lit(" ["), F.col("label"), F.lit("]"))).otherwise(A.refusal(F.col("status")))
    return rows.withColumn("status", state).select(Q, "question", "confidence", "support", "label", "snippet", "status", text.alias("answer"))


_REFUSE = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.REFUSALS.items()) + f" ELSE '{A.REFUSALS['unanswerable_query']}' END"
_GUARDED = f"""WITH sure AS ({ORACLES["confidence_abstain"]}), ground AS ({ORACLES["groundedness"]}), ev AS ({ORACLES["citations"]}),
top AS ({answers._BUNDLE} SELECT item_id, snippet, label FROM e WHERE rank = 1),
s AS (SELECT b.item_id, snippet, label, CASE WHEN b.item_id % 10 = 0 THEN 'unsupported_medication_request' WHEN confidence IS NULL THEN 'unanswerable_query' WHEN confidence < 0.65 THEN 'retrieval_abstention' WHEN coalesce(support, 0) < 0.20 THEN 'groundedness_validation_failed' ELSE 'grounded_answer' END AS status
      FROM benchmark b LEFT JOIN sure USING (item_id) LEFT JOIN ground USING (item_id) LEFT JOIN top USING (item_id))"""


@query(f"{_GUARDED} SELECT item_id, status, CASE WHEN status = 'grounded_answer' THEN '{A.OPENING}' || substr(snippet, 1, 180) || ' [' || label || ']' ELSE {_REFUSE} END AS answer FROM s")
def guarded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification, evidence, grounding and refusals in one pass; every tenth question asks for a dosage."""
    return guarded(spark, sf_dir)


@query(f"{_GUARDED} SELECT CASE WHEN item_id % 5 IN (0, 1) THEN 'train' WHEN item_id % 5 IN (2, 3) THEN 'validation' ELSE 'holdout' END AS split, status, count(*) AS n FROM s GROUP BY ALL")
def answer_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when((F.col(Q) % 5).isin(0, 1), "train").when((F.col(Q) % 5).isin(2, 3), "validation").otherwise("holdout")
    return guarded(spark, sf_dir).groupBy(split.alias("split"), "status").agg(F.count("*").alias("n"))


@query(f"{answers._BUNDLE}, c AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'E9' ELSE label END AS label, CASE WHEN item_id % 7 = 0 THEN 'not there' ELSE substr(snippet, 1, 120) END AS quote FROM e WHERE rank <= 2) SELECT c.item_id, c.label, coalesce(contains(e.snippet, quote), false) AS valid, count(*) AS n FROM c LEFT JOIN e ON c.item_id = e.item_id AND c.label = e.label GROUP BY ALL")
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with some labels and quotes spoilt, checked against their bundles."""
    bundle = answers.evidence(spark, sf_dir)
    spoilt = bundle.where("rank <= 2").select(Q, F.when(F.col(Q) % 4 == 0, "E9").otherwise(F.col("label")).alias("label"), F.when(F.col(Q) % 7 == 0, "not there").otherwise(A.quote(F.col("snippet"))).alias("quote"))
    return A.check_citations(spoilt, bundle, Q).groupBy(Q, "label", "valid").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, sha256(props) AS props_checksum, sha256('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}') AS row_checksum FROM events")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their text replaced by a checksum, and a checksum of each canonical row."""
    from textmill.functions import ids

    return table(spark, sf_dir, "events").select("event_id", "event_type", F.sha2("props", 256).alias("props_checksum"), ids.row_checksum(F.col("event_id"), F.col("event_type")).alias("row_checksum"))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) SELECT 'textmill_events_total{type=\"' || event_type || '\"} ' || n AS line FROM c UNION ALL SELECT 'textmill_events_all ' || count(*) FROM events")
def metric_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters in text form, one line each; counts by type and in total from one grouping-sets pass."""
    counts = table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 0, F.concat(F.lit('textmill_events_total{type="'), F.col("event_type"), F.lit('"} '))).otherwise("textmill_events_all ")
    return counts.select(F.concat(name, F.col("n").cast("string")).alias("line"))


_CHECKS = ("unique_documents", "unique_vectors", "labels_have_documents", "ranks_contiguous", "query_unit_unique", "accepted_disjoint", "shares_in_range")


@query(" UNION ALL ".join(f"SELECT '{c}' AS check_name, 0::BIGINT AS violations" for c in _CHECKS))
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that must find nothing, with the number of rows that violate each."""
    t = lambda n: table(spark, sf_dir, n)
    ranked = retrieval.bm25_ranked(spark, sf_dir)
    spans = S.resolve_overlaps(answers._matched(spark, sf_dir), U).where("accepted")
    from pyspark.sql import Window

    before = F.lag("end").over(Window.partitionBy(U).orderBy("start"))
    found = {
        "unique_documents": t("documents").groupBy(U).count().where("count > 1"),
        "unique_vectors": t("embeddings").groupBy("vec_id").count().where("count > 1"),
        "labels_have_documents": t("labels").join(t("documents"), U, "left_anti"),
        "ranks_contiguous": ranked.groupBy(Q).agg(F.count("*").alias("n"), F.max("rank").alias("m")).where("n <> m OR m > 5"),
        "query_unit_unique": ranked.groupBy(Q, U).count().where("count > 1"),
        "accepted_disjoint": spans.withColumn("_b", before).where("_b > start"),
        "shares_in_range": t("documents").where((X.share(F.col("text"), "[0-9]") < 0) | (X.share(F.col("text"), "[0-9]") > 1)),
    }
    out = None
    for name, rows in found.items():
        one = rows.agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out
