"""The opN queries: whole tables through each operator, digests of its outputs, and SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textmill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textmill.llm.pieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.media import from_media, to_media

    back = from_media(to_media(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "duration", F.size("seek_offsets").cast("long").alias("n_offsets"),
    )


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.chat import format_chats, read_back

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    says = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(extra)))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.line_chunks import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_runs", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _line_sql() -> str:
    from textmill.llm.line_chunks import SQL

    return SQL


ORACLES["op6_line_dedup"] = _line_sql()


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.hashed import held_out_column
    from textmill.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out_column().alias("held_out"), "score", "predicted")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.quality import fit_quality, quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, model).drop("text")


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the label of its number marks poor quality or toxic text; rules may have any number of tokens."""
    from textmill.llm.urls import filter_urls

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels)


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def _codes_sql() -> str:
    from textmill.llm.vector_codes import SQL

    return SQL


ORACLES["op13_vector_codes"] = _codes_sql()


@query
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.classifier import classify, fit_classifier
    from textmill.llm.hashed import held_out_column

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_classifier(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out_column().alias("held_out"), "score", "predicted")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation begins with the first turns of the one whose id is the next lower multiple of 100."""
    from textmill.llm.prefix_trie import trie_nodes, with_shared_heads

    rebuilt = with_shared_heads(
        table(spark, sf_dir, "conversations"),
        head=lambda c: F.crc32(c.cast("string").cast("binary")) % 6,
        base=lambda c: c - c % 100,
        most=5,
    )
    return trie_nodes(rebuilt)


def _trie_sql() -> str:
    from textmill.llm.prefix_trie import SQL

    return SQL


ORACLES["op11_prefix_trie"] = _trie_sql()
