"""Vocabulary phrases in texts: an Aho-Corasick automaton for each worker, built from a table of phrases.

One pass over a text finds the phrases of a vocabulary of any size, so the time does not grow with the vocabulary. The
phrases travel with the function in parts of a bounded size; a larger vocabulary is matched part by part, each text once
for a part, and the parts' rows are the whole result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of phrases in one part (the automaton takes some fifty times as many bytes of a worker's memory).
PART_CHARS = 4_000_000
_built: dict[str, object] = {}


def lowered(text: str) -> str:
    """Lower case with a character for each one of the text, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word(c: str) -> bool:
    return c == "_" or c.isalnum()


def automaton(name: str, phrases: list[str]):
    """The automaton of a part, made once in a worker process; the last part's is kept."""
    if name not in _built:
        import ahocorasick

        made = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            made.add_word(p, (i, len(p)))
        made.make_automaton()
        _built.clear()
        _built[name] = made
    return _built[name]


def found(made, text: str) -> Iterator[tuple[int, int, int]]:
    """(phrase, start, end) at word boundaries; one phrase's matches do not overlap each other, those of several may."""
    low, n = lowered(text), len(text)
    ends: dict[int, int] = {}
    for last, (i, size) in made.iter(low):
        start, end = last + 1 - size, last + 1
        if start < ends.get(i, 0) or (start and _word(low[start - 1])) or (end < n and _word(low[end])):
            continue
        ends[i] = end
        yield i, start, end


def vocabulary_parts(vocabulary: DataFrame, phrase: str, part_chars: int = PART_CHARS) -> Iterator[list[str]]:
    """The distinct lower-cased phrases in parts of about ``part_chars`` characters, dealt by hash; empty ones are no phrases."""
    words = vocabulary.select(F.lower(F.col(phrase)).alias("p")).where(F.length("p") > 0).distinct()
    total = words.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_chars))
    for i in range(parts):
        rows = words.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == i).collect()
        yield sorted({lowered(r["p"]) for r in rows})


def phrase_spans(df: DataFrame, key: str, text: str, vocabulary: DataFrame, phrase: str = "phrase", part_chars: int = PART_CHARS) -> DataFrame:
    """key, label (the lower-cased phrase), start, end of the phrases of ``vocabulary`` in the texts, compared without case.

    Offsets count code points. A phrase counts between characters that are not of a word, as ``vocabulary_pattern`` has
    it. Null texts and an empty vocabulary give no row.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, label string, start long, end long"
    names = [key, "label", "start", "end"]

    def matcher(phrases: list[str]):
        name = hashlib.sha256("\n".join(phrases).encode()).hexdigest()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = automaton(name, phrases)
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    rows, which, starts, ends = [], [], [], []
                    for row, t in enumerate(part.column(1).to_pylist()):
                        for i, a, b in found(made, t or ""):
                            rows.append(row)
                            which.append(i)
                            starts.append(a)
                            ends.append(b)
                    label = pa.array([phrases[i] for i in which], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), label, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names)

        return run

    out = None
    for phrases in vocabulary_parts(vocabulary, phrase, part_chars):
        if phrases:
            one = df.select(key, text).mapInArrow(matcher(phrases), schema)
            out = one if out is None else out.unionByName(one)
    return df.sparkSession.createDataFrame([], schema) if out is None else out
