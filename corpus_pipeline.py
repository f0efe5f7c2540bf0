"""Corpus pipeline: toxicity, line dedup, near-duplicate removal, repeated-string removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` applies them to the documents table,
writing and rereading each stage's rows in the cluster's shared folder.

Defined cases, for every stage: a null text is an empty one and stays null where
the stage takes nothing from it; whole texts are read, however long; extra columns
are carried, whatever their names; an empty table gives an empty table. The stages
state what holds for null ids, ties and repeated rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.line_chunks import line_dedup
from textmill.llm.near_dedup import one_of_each_class
from textmill.llm.packing import pack
from textmill.llm.suffix_dedup import suffix_dedup
from textmill.llm.toxicity import fit_toxicity, score_toxicity
from textmill.session import shared_folder, ship


def _as_documents(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars counted again."""
    return frame.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained machine does not call toxic; rows are judged one by one, repeated or without an id alike.

    Without labels of both classes nothing is toxic.
    """
    ship(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that an earlier document (or an earlier place) has.

    Earlier is by doc_id (null first), then by place; no row goes, a text whose lines all go becomes empty.
    """
    ship(spark)
    return _as_documents(line_dedup(docs), docs)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicate texts: the one with the smallest doc_id.

    Rows go by their text: an id that stands in several rows keeps each of its texts that no other row of the class
    stands for, and exact repeats of a row become one. Rows without an id belong to no class and stay.
    """
    ship(spark)
    return one_of_each_class(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes under 50-byte strings that also start in a document with a smaller id.

    Rows of one id (and all without one) take nothing from each other; no row goes, a text may become empty. Bytes left
    of a character that was cut go too.
    """
    ship(spark)
    out = suffix_dedup(docs, as_text=True)
    return _as_documents(out.withColumn("text", F.col("kept")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 2048; every row gives at least its end token, repeated ones too."""
    import public_tokenizers

    ship(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each_class),
    ("suffix_array_dedup", drop_repeated_strings),
    ("packing", pack_sequences),
]

#: A trained model, signatures and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    folder = f"{shared_folder(spark)}/pipeline_{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
