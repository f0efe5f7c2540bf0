"""Query features: expansion, negation scopes and numbers with units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import let, tokens

#: Controlled expansions of a query token, by kind.
SYNONYMS = {
    "heart": ["cardiac"],
    "scan": ["imaging"],
    "breathing": ["respiratory"],
    "blood": ["haematology"],
    "kidney": ["renal"],
    "liver": ["hepatic"],
    "summary": ["impression"],
    "background": ["history"],
    "observed": ["findings"],
    "review": ["assessment"],
}
#: Unambiguous abbreviations ("ms" is ambiguous and is not expanded).
ABBREVIATIONS = {"ct": ["computed tomography"], "mri": ["magnetic resonance imaging"], "bp": ["blood pressure"], "hr": ["heart rate"]}
#: Other names of sections.
ALIASES = {
    "history": ["relevant history", "background"],
    "impression": ["summary impression", "interpretive summary"],
    "findings": ["observed findings", "report findings"],
    "plan": ["administrative next step", "workflow note"],
}
#: Single-token negation markers, words that only phrase markers use, phrase markers, window.
MARKERS = ("no", "not", "without", "denies")
PHRASE_WORDS = ("negative", "for", "absence", "of")
PHRASES = ("negative for", "absence of")
WINDOW = 5
NUMBER = r"(\d+(?:\.\d+)?)(?:\s?(?i:mm|cm|kg|mg|ml|bpm|percent|%))?"
_UNIT = r"(?i)(mm|cm|kg|mg|ml|bpm|percent|%)$"


def expansions(text: Column, extra: dict[str, list[str]] | None = None) -> Column:
    """Array of struct(term, expanded, kind), by token order, then synonyms, abbreviations and aliases."""
    tables = {"synonym": SYNONYMS | (extra or {}), "abbreviation": ABBREVIATIONS, "section_alias": ALIASES}

    def rules(kind: str, table: dict[str, list[str]]) -> Column:
        return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])

    maps = {k: rules(k, t) for k, t in tables.items()}

    def of(kind: str, term: Column) -> Column:
        found = F.coalesce(F.try_element_at(maps[kind], term), F.array().cast("array<string>"))
        return F.transform(found, lambda e: F.struct(term.alias("term"), e.alias("expanded"), F.lit(kind).alias("kind")))

    return F.flatten(F.transform(tokens(text), lambda t: F.concat(*[of(k, t) for k in tables])))


def negation(text: Column) -> Column:
    """Distinct struct(term, polarity): terms in the window after a marker are negated, terms that mark nothing affirmed."""
    lowered = F.lower(text)
    after = [F.when(F.contains(lowered, F.lit(p)), F.slice(tokens(F.regexp_replace(lowered, rf"(?s)^.*?{p}", "")), 1, WINDOW)).otherwise(F.array().cast("array<string>")) for p in PHRASES]
    mark = lambda items, polarity: F.transform(items, lambda t: F.struct(t.alias("term"), F.lit(polarity).alias("polarity")))

    def marked(toks: Column) -> Column:
        negated = F.flatten(F.transform(toks, lambda t, i: F.when(t.isin(*MARKERS), F.slice(toks, i + 2, WINDOW)).otherwise(F.array().cast("array<string>"))))
        affirmed = F.filter(toks, lambda t: ~t.isin(*MARKERS, *PHRASE_WORDS))
        # strings are made distinct by hash, structs would be compared with each other
        return F.concat(mark(F.array_distinct(F.concat(negated, *after)), "negated"), mark(F.array_distinct(affirmed), "affirmed"))

    return let(tokens(text), marked)  # once for a text, not once for each of its markers


def numbers(text: Column) -> Column:
    """struct(value, unit) of each number; % is percent, and a number without a unit has the unit "number"."""
    raw = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    unit = lambda r: F.lower(F.regexp_extract(r, _UNIT, 1))
    return F.transform(raw, lambda r: F.struct(F.regexp_extract(r, r"^\d+(?:\.\d+)?", 0).cast("double").alias("value"), F.when(unit(r) == "%", "percent").when(unit(r) == "", "number").otherwise(unit(r)).alias("unit")))


def negation_compatibility(clashes: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.25 * clashes)


def negation_clashes(query: Column, candidate: Column) -> Column:
    """Features of the query whose opposite the candidate has."""
    flipped = F.transform(query, lambda f: F.struct(f["term"].alias("term"), F.when(f["polarity"] == "affirmed", "negated").otherwise("affirmed").alias("polarity")))
    return F.size(F.array_intersect(flipped, candidate))


def numeric_compatibility(query: Column, candidate: Column) -> Column:
    """Best pair: 1 for equal value and unit, 0.8 for the value, 0.4 for the unit; 1 without query numbers, 0.5 without candidate numbers."""
    values = lambda a, field: F.transform(a, lambda n: n[field])
    best = (
        F.when(F.arrays_overlap(query, candidate), 1.0)
        .when(F.arrays_overlap(values(query, "value"), values(candidate, "value")), 0.8)
        .when(F.arrays_overlap(values(query, "unit"), values(candidate, "unit")), 0.4)
        .otherwise(0.0)
    )
    return F.when(F.size(query) == 0, 1.0).when(F.size(candidate) == 0, 0.5).otherwise(best)


#: Neighbours of a term in the synonym graph.
GRAPH = {
    "ct": ["computed", "scan", "tomography"],
    "mri": ["imaging", "magnetic", "resonance"],
    "bp": ["blood", "pressure"],
    "hr": ["heart", "rate"],
    "summary": ["impression", "overview"],
    "findings": ["observations", "observed"],
    "renal": ["kidney"],
    "cardiac": ["heart"],
    "respiratory": ["breathing", "lung"],
}


def graph_terms(text: Column, graph: dict[str, list[str]] | None = None) -> Column:
    """Neighbours of each token, sorted per token, in token order."""
    edges = F.create_map(*[x for k, v in (graph or GRAPH).items() for x in (F.lit(k), F.array(*[F.lit(e) for e in sorted(v)]))])
    return F.flatten(F.transform(tokens(text), lambda t: F.coalesce(F.try_element_at(edges, t), F.array().cast("array<string>"))))


def has_cycle(graph: dict[str, list[str]]) -> bool:
    """Whether a rule graph has a cycle: nodes without incoming edges are taken away until none is left to take."""
    edges = {(a, b) for a, targets in graph.items() for b in targets}
    while True:
        free = {a for a, _ in edges} - {b for _, b in edges}
        if not free:
            return bool(edges)
        edges = {(a, b) for a, b in edges if a not in free}
