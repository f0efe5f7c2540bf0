"""Chat formatting with turn spans found by incremental black-box rendering.

A template is any function from turns to text. Successive prefixes of a
conversation are rendered and each output is compared with the one before: what
was added is the new turn's span, and an output that does not begin with the one
before shows a template that rewrites history (rewrites_history, without spans;
also where a turn's marks depend on its text). Where a turn's own text stands in
its span is found by rendering a probe text in its place, for every turn, so that
marks may number the turns or depend on the turn before. Conversations of
many turns are rendered in blocks that carry the turn before them, and the joined
blocks must equal one rendering of the whole; if not, whole prefixes are rendered.
That needs a template whose marks repeat from block to block; one that numbers its
turns costs a rendering of all turns for each.

Rows are dealt by conv_id and sorted, so a worker holds one conversation at a
time. Defined cases: null text and null role are empty; turns with equal numbers
are ordered by role, then text; repeated rows are turns of their own; rows with
a null conv_id are one conversation; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.frames import schema_of

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]
BLOCK = 64
PROBE = "\ue0f1"
END = " </turn>\n"
_CONTROL = re.compile(r"([\\#<])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:#<]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash before each backslash, # and <, so that no marker can arise inside a text."""
    return _CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def default_render(turns: list[Turn]) -> str:
    return "".join(f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)}{END}" for role, text in turns)


def default_parse(formatted: str) -> list[Turn]:
    """The turns of a default rendering; raises if anything else is between them."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class Located:
    def __init__(self, text: str, spans: list[tuple[int, int]], bodies: list[tuple[int, int]], rewrites: bool) -> None:
        self.text, self.spans, self.bodies, self.rewrites = text, spans, bodies, rewrites


def _frame(render: Render, before: list[Turn], role: str, base: int) -> tuple[str, str]:
    """What the template writes before and after the text of a turn that stands here."""
    probe = render([*before, (role, PROBE)])[base:]
    if probe.count(PROBE) == 1:
        head, _, tail = probe.partition(PROBE)
        return head, tail
    a, b = render([*before, (role, "A")])[base:], render([*before, (role, "B")])[base:]
    head = commonprefix([a, b])
    return head, a[len(head) + 1 :]


def _prefixes(render: Render, turns: list[Turn], context: int) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]] | None:
    """Spans of turns[context:] in what their prefixes add; None if an output does not extend the one before.

    Every turn is probed in its own place, so marks may number the turns or depend on those before. None also if a
    turn's output lacks the frame of its probe: marks then depend on the text, and where that begins cannot be told.
    """
    base = last = render(turns[:context])
    spans, bodies = [], []
    for i in range(context, len(turns)):
        now = render(turns[: i + 1])
        if not now.startswith(last):
            return None
        head, tail = _frame(render, turns[:i], turns[i][0], len(last))
        added = now[len(last) :]
        if len(added) < len(head) + len(tail) or not (added.startswith(head) and added.endswith(tail)):
            return None
        a, b = len(last) - len(base), len(now) - len(base)
        spans.append((a, b))
        bodies.append((a + len(head), b - len(tail)))
        last = now
    return last[len(base) :], spans, bodies


def locate(render: Render, turns: list[Turn], block: int = BLOCK) -> Located:
    """The rendering of all turns, with each turn's span and the span of its text."""
    whole = render(turns)
    spans: list[tuple[int, int]] = []
    bodies: list[tuple[int, int]] = []
    if len(turns) > block:
        at = 0
        for first in range(0, len(turns), block):
            context = min(first, 1)
            part = _prefixes(render, turns[first - context : first + block], context)
            if part is None or whole[at : at + len(part[0])] != part[0]:
                break
            spans += [(a + at, b + at) for a, b in part[1]]
            bodies += [(a + at, b + at) for a, b in part[2]]
            at += len(part[0])
        else:
            if at == len(whole):
                return Located(whole, spans, bodies, False)
    found = _prefixes(render, turns, 0) if not render([]) else _with_opening(render, turns)
    return Located(whole, [], [], True) if found is None else Located(whole, found[1], found[2], False)


def _with_opening(render: Render, turns: list[Turn]):
    """For templates that write something before the first turn: spans count from the start of the output."""
    found, opening = _prefixes(render, turns, 0), len(render([]))
    return found and (found[0], *[[(a + opening, b + opening) for a, b in x] for x in found[1:]])


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """Neighbouring rows with one conv_id, across batch borders."""
    key, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True):
            if begun and conv != key:
                yield key, turns
                turns = []
            key, begun = conv, True
            turns.append((role or "", text or ""))
    if begun:
        yield key, turns


def format_chats(conversations: DataFrame, render: Render = default_render, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, spans (each turn's), loss (spans of the loss role's texts) and rewrites_history."""
    from pyspark.sql.pandas.types import to_arrow_schema

    pair = "array<struct<start:long,end:long>>"
    schema = schema_of([conversations.schema["conv_id"]], [("formatted", "string"), ("spans", pair), ("loss", pair), ("rewrites_history", "boolean")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for key, turns in _conversations(batches):
            x = locate(render, turns)
            loss = [b for b, (role, _) in zip(x.bodies, turns, strict=True) if role == loss_role] if not x.rewrites else None
            rows.append((key, x.text, x.spans if not x.rewrites else None, loss, x.rewrites))
            size += len(x.text)
            if len(rows) >= 1000 or size > 4_000_000:
                yield build(rows)
                rows, size = [], 0
        if rows:
            yield build(rows)

    def build(rows: list[tuple]) -> pa.RecordBatch:
        structs = lambda spans: None if spans is None else [{"start": a, "end": b} for a, b in spans]
        cols = list(zip(*rows, strict=True))
        cols[2], cols[3] = [structs(s) for s in cols[2]], [structs(s) for s in cols[3]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    rows = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame, parse: Callable[[str], list[Turn]] = default_parse, plain: Callable[[str], str] = unescape) -> DataFrame:
    """Digests of what the formatted text and its loss mask say, from these alone."""
    schema = schema_of([formatted.schema["conv_id"]], [("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                under = "".join(plain(text[s["start"] : s["end"]]) for s in loss or [])
                for c, v in zip(out, (len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), _sha(under), len(text)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]], [f.name for f in schema])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
