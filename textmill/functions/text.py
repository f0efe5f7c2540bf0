"""Column functions for text: normalisation, tokens, grams, profiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The retrieval token pattern, the profile token pattern and the identifier pattern.
TOKEN = r"[a-z0-9]+(?:-[a-z0-9]+)+|[a-z]+[a-z0-9]*|\d+(?:\.\d+)?"
PROFILE_TOKEN = r"SYN-[A-Z]+-\d+|\d+(?:\.\d+)?|[A-Za-z]+(?:-[A-Za-z]+)?|[^\w\s]"
IDENTIFIER = r"^SYN-[A-Z]+-\d+$"
#: Dashes and quotes that fold to one form.
FOLD_FROM, FOLD_TO = "‐‑‒–—‘’“”", "-----''\"\""


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC, for which Spark has no function; Arrow batches."""
    return text.str.normalize("NFC")


#: Letters whose case folding is longer or other than their lower case, where it changes ASCII letters.
FOLDED = {"ß": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def casefold(text: Column) -> Column:
    """Lower case, with the letters that fold into ASCII ones."""
    out = F.lower(text)
    for a, b in FOLDED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def tokens(text: Column) -> Column:
    """Retrieval tokens of case-folded text, in order (text is taken as NFC; ``index.tokenised`` makes it so)."""
    return F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def profile_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PROFILE_TOKEN), F.lit(0))


def ngrams(items: Column, n: int) -> Column:
    """Space-joined runs of n items."""
    if n == 1:
        return items
    made = F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.array_join(F.slice(items, i, n), " "))
    return F.when(F.size(items) >= n, made).otherwise(F.array().cast("array<string>"))


def let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def char_ngrams(text: Column, least: int = 3, most: int = 5) -> Column:
    """Distinct character grams of the lower-cased text, white space folded, with a space at each end."""

    def grams(chars: Column, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) >= n, made).otherwise(F.array().cast("array<string>"))

    characters = F.regexp_extract_all(F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(" ")), F.lit("(?s)."), F.lit(0))
    return let(characters, lambda chars: F.array_distinct(F.concat(*[grams(chars, n) for n in range(least, most + 1)])))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common items of two arrays without repeats; 0 if both are empty."""

    def share_of(both: Column) -> Column:
        shared = F.size(F.array_intersect(both["a"], both["b"]))
        union = F.size(both["a"]) + F.size(both["b"]) - shared
        return F.when(union > 0, shared / union).otherwise(F.lit(0.0))

    return let(F.struct(a.alias("a"), b.alias("b")), share_of)


def normalise_steps(text: Column, tab_width: int = 4) -> list[tuple[str, Column]]:
    """The ordered steps of ``normalise``, each with the text that it leaves."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    untabbed = F.replace(lines, F.lit("\t"), F.lit(" " * tab_width))
    trimmed = F.regexp_replace(untabbed, r"[ ]+(\n|$)", "$1")
    return [("line_endings", lines), ("tabs", untabbed), ("trailing_spaces", trimmed), ("inner_spaces", F.regexp_replace(trimmed, r"(?<=\S) {2,}(?=\S)", " "))]


def normalise(text: Column, tab_width: int = 4) -> Column:
    """Line ends to LF, tabs to spaces, no spaces at line ends, one space between words, no final newline run."""
    return normalise_steps(text, tab_width)[-1][1]


def analytical(text: Column) -> Column:
    """Folded dashes and quotes, lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, FOLD_FROM, FOLD_TO)), r"\s+", " "))


def share(text: Column, characters: str) -> Column:
    """Share of a text's characters that a character class holds."""
    n = F.length(text)
    return F.when(n > 0, F.round((n - F.length(F.regexp_replace(text, characters, ""))) / n, 6)).otherwise(F.lit(0.0))


def snippet(text: Column, limit: int) -> Column:
    return F.substring(F.regexp_replace(text, "\n", " "), 1, limit)


def context(text: Column, start: Column, end: Column, window: int) -> Column:
    """The text from ``window`` characters before a span to as many behind it, line breaks as spaces; a note without a span."""
    first = F.greatest(F.lit(0), start - window)
    last = F.least(F.length(text), end + window)
    cut = F.regexp_replace(F.substring(text, (first + 1).cast("int"), (last - first).cast("int")), "\n", " ")
    return F.when(start.isNull() | end.isNull(), F.lit("document-level: no context")).otherwise(cut)


def lookup_key(text: Column) -> Column:
    """Lower case, white space folded and trimmed: equal keys are the same question."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def transformations(text: Column, steps: list[tuple[str, Column]]) -> Column:
    """Audit of ordered steps: array of struct(step, changed, before, after) with checksums; ``steps`` are (name, text so far)."""
    rows, before = [], text
    for name, after in steps:
        rows.append(F.struct(F.lit(name).alias("step"), (~before.eqNullSafe(after)).alias("changed"), F.sha2(before, 256).alias("before"), F.sha2(after, 256).alias("after")))
        before = after
    return F.array(*rows)


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole at six places; ``empty`` where the denominator is 0."""
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(empty))
