"""Retrieval units of three grains, and the tables that extraction makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import ids
from textmill.functions import text as X

#: Confidence of an extraction rule by what it is limited to (type and section, section, type, neither).
SPECIFICITY = {(True, True): 1.0, (False, True): 0.95, (True, False): 0.9, (False, False): 0.85}
VERSION = "1.0.0"


def unit_id(unit_type: str, source_id: Column, version: str = VERSION) -> Column:
    """Identifier over the canonical JSON of version, source and type (sources are ASCII without quotes)."""
    canonical = F.concat(F.lit(f'{{"corpus_version":"{version}","source_id":"'), source_id.cast("string"), F.lit(f'","unit_type":"{unit_type}"}}'))
    return F.concat(F.lit("RU_"), F.substring(F.sha2(canonical, 256), 1, 24))


def units(documents: DataFrame, sections: DataFrame, sentences: DataFrame, key: str, grains: tuple[str, ...] = ("document", "section", "sentence")) -> DataFrame:
    """unit_id, key, unit_type, section_label, source_id and text of the asked grains, as one table.

    documents: key, text; sections: key, section_index, label, section_text; sentences: those of each section, with
    section_index, sentence_index and sentence. A section's label comes by a join on its key and place.
    """
    own = F.col(key).cast("string")
    section = F.concat_ws(":", own, F.col("section_index").cast("string"))
    sentence = F.concat_ws(":", section, F.col("sentence_index").cast("string"))
    none = F.lit(None).cast("string")
    made = {
        "document": documents.select(key, none.alias("section_label"), own.alias("source_id"), "text"),
        "section": sections.select(key, F.col("label").alias("section_label"), section.alias("source_id"), F.col("section_text").alias("text")),
        "sentence": sentences.join(sections.select(key, "section_index", "label"), [key, "section_index"]).select(key, F.col("label").alias("section_label"), sentence.alias("source_id"), F.col("sentence").alias("text")),
    }
    out = None
    for grain in grains:
        one = made[grain].select(unit_id(grain, F.col("source_id")).alias("unit_id"), key, F.lit(grain).alias("unit_type"), "section_label", "source_id", "text")
        out = one if out is None else out.unionByName(one)
    return out


def described(rows: DataFrame) -> DataFrame:
    """Units with token_count and checksum instead of their text."""
    return rows.withColumns({"token_count": F.size(X.tokens(F.col("text"))).cast("long"), "checksum": ids.checksum_text(F.col("text"))}).drop("text")


def unit_statistics(rows: DataFrame, key: str) -> DataFrame:
    """Units, documents, tokens and length extremes by grain and in all (grouping sets; the whole is 'all')."""
    counted = rows.select(key, "unit_type", F.size(X.tokens(F.col("text"))).cast("long").alias("n"))
    sets = counted.groupingSets([["unit_type"], []], "unit_type").agg(
        F.count("*").alias("units"), F.count_distinct(key).alias("documents"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("average"), F.min("n").alias("least"), F.max("n").alias("most"), F.grouping_id().alias("_g")
    )
    return sets.withColumn("unit_type", F.when(F.col("_g") == 0, F.col("unit_type")).otherwise("all")).drop("_g")


def confidence(has_types: Column, has_sections: Column) -> Column:
    """Confidence of a rule by its specificity."""
    out = F.lit(SPECIFICITY[False, False])
    for (types, sections), value in SPECIFICITY.items():
        out = F.when((has_types == F.lit(types)) & (has_sections == F.lit(sections)), F.lit(value)).otherwise(out)
    return out


def rules(vocabulary: DataFrame) -> DataFrame:
    """rule_id, label, entry_id, priority, confidence of vocabulary entries (entry_id, label, priority, types, sections)."""
    limited = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return vocabulary.select(
        F.concat(F.lit("RULE_"), F.regexp_replace("entry_id", "^VOC_", "")).alias("rule_id"), "label", "entry_id", "priority", confidence(limited(F.col("types")), limited(F.col("sections"))).alias("confidence")
    )


def predictions(accepted: DataFrame, key: str, run: str) -> DataFrame:
    """Accepted candidates (key, label, start, end, value) with prediction_id and the lower-cased value."""
    return accepted.select(ids.stable_id("PRED", F.lit(run), F.col(key), F.col("label"), F.col("start"), F.col("end")).alias("prediction_id"), key, "label", "start", "end", X.casefold(F.col("value")).alias("normalised_value"))


def section_labels(sections: DataFrame, key: str) -> DataFrame:
    """Each section's own label as its class, with confidence 1."""
    return sections.select(key, "section_index", F.col("label").alias("predicted"), F.lit(1.0).alias("confidence"))


def prohibited_columns(tables: dict[str, DataFrame], prohibited: tuple[str, ...]) -> DataFrame:
    """table, column and status of every column; one with a prohibited name fails."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, "failed" if c.lower() in prohibited else "passed") for t, df in tables.items() for c in df.columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, status string")


def contract_faults(df: DataFrame, contract: dict[str, str]) -> list[str]:
    """Columns of a contract (name to type) that a table lacks or has with another type."""
    have = dict(df.dtypes)
    return [f"{c}: {have.get(c, 'missing')} instead of {t}" for c, t in contract.items() if have.get(c) != t]


def vector_faults(vectors: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """key and fault of vectors with another dimension or an entry that is not finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fault = F.when(v.isNull() | (F.size(v) != dimension), "dimension").when(~finite, "not_finite")
    return vectors.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def test_encoder(text: Column, dimension: int = 8) -> Column:
    """Vector from the sum of a text's code points: ((sum + 17 i) mod 23 - 11), unit length, eight places."""
    total = F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.lit(0).cast("long"), lambda s, c: s + F.ascii(c))
    raw = lambda t: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (F.pmod(t + i * 17, F.lit(23)) - 11).cast("double"))

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(v, lambda x: F.round(x / F.when(norm > 0, norm).otherwise(1.0), 8))

    return X.let(X.let(total, raw), unit)


def encoded(texts: DataFrame, key: str, text: str, encoder, dimension: int) -> DataFrame:
    """key and vector by any encoder: a function that makes the function from texts to vectors, once in a worker.

    Texts go in Arrow batches; a vector of another dimension or with an entry that is not finite raises.
    """
    import math

    import pyarrow as pa

    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        encode = encoder()
        for batch in batches:
            vectors = [[float(x) for x in v] for v in encode([t or "" for t in batch.column(1).to_pylist()])]
            if any(len(v) != dimension or not all(map(math.isfinite, v)) for v in vectors):
                raise ValueError("an encoder gave a vector of another dimension or one that is not finite")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], [key, "vector"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, vector array<double>")
