from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def invented(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randint(3, 9))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, repeated lines, a null, empties, a very long text and non-ASCII text."""
    rng = random.Random(5)
    texts: list[str | None] = [invented(rng, rng.randint(30, 120)) for _ in range(30)]
    passage = invented(rng, 60)
    lines = [invented(rng, 6) for _ in range(12)]
    texts += [texts[0]] * 4
    for i in range(6):
        words = texts[1].split()
        words[i * 3 + 2] = "changed"
        texts.append(" ".join(words))
    texts += [f"{invented(rng, 20)} {passage} {invented(rng, 20)}" for _ in range(5)]
    texts += ["\n".join([invented(rng, 5), *lines, invented(rng, 5)]) for _ in range(4)]
    texts += ["\n".join(lines[3:9]), "x" * 200, "ab" * 300, "same line\n" * 40, "é" * 80 + passage[:70], "a\0b" * 40]
    texts += [None, "", " ", "\n\n", "word", "two words", invented(rng, 6000)]
    return [(i * 3 + 1, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
