"""SentencePiece encoding and decoding over a table of distinct chunks.

With an identity normaliser and no piece that has a whitespace marker after its
first other character, no merge crosses from a word into the marker after it. A
text is then a run of chunks (markers, then one word), each segmented on its
own, so a worker process segments each distinct chunk once, for all of its tasks,
and joins the ids by position. Its table has two halves: when the younger one
reaches half of ``table_size`` chunks it becomes the older one, and what the older
one held and no text has used since is forgotten. That bounds the memory, keeps
frequent chunks and changes no result. Both conditions are checked against the
model; a model that fails them is encoded text by text.

Defined cases: null is the empty text, whose ids are the begin and end ids only;
rows are independent, so ties and repeated rows need no rule; an empty table gives
no row; whole texts are encoded, very long ones too; a column named like an output
is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textmill.llm.frames import schema_of

MARK = "▁"
TABLE_SIZE = 100_000
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    def __init__(self, model: str, table_size: int = TABLE_SIZE) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.table_size = table_size
        n = self.sp.get_piece_size()
        names = [self.sp.id_to_piece(i) for i in range(n)]
        special = any(self.sp.is_unused(i) for i in range(n)) or any(MARK in x.lstrip(MARK) for x in names)
        probe = "\t A  ﬁ½  Ａé\n "
        self.split = not special and self.sp.normalize(probe) == MARK + probe.replace(" ", MARK)

    def _look_up(self, chunks: set[str]) -> None:
        """Bring these chunks into the younger table. A chunk begins with a marker, which the library adds as its prefix."""
        if len(self.young) * 2 > self.table_size:
            self.old, self.young = self.young, {}
        missing = []
        for c in chunks:
            if c not in self.young:
                ids = self.old.get(c)
                if ids is None:
                    missing.append(c)
                else:
                    self.young[c] = ids
        if missing:
            texts = [c[1:].replace(MARK, " ") for c in missing]
            for chunk, ids in zip(missing, self.sp.encode(texts, num_threads=1), strict=True):
                self.young[chunk] = ids if chunk != MARK else [self.sp.piece_to_id(MARK)]  # a lone marker at the end of a text

    def encode(self, texts: list[str]) -> list[list[int]]:
        """As ``encode(text, add_bos=True, add_eos=True)`` for each text."""
        bos, eos = self.sp.bos_id(), self.sp.eos_id()
        if not self.split:
            return self.sp.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        out: list[list[int]] = []
        for at in range(0, len(texts), 256):
            parts = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[at : at + 256]]
            self._look_up({c for p in parts for c in p})
            table = self.young
            for p in parts:
                ids = [bos]
                for c in p:
                    ids += table[c]
                ids.append(eos)
                out.append(ids)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1)


@lru_cache(maxsize=1)
def worker_pieces(model: str) -> Pieces:
    """The model and table of this process; Spark gives a process one task at a time."""
    return Pieces(model)


def encode_pieces(docs: DataFrame, model: str, decode: bool = True, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with ids (array<int>) and, if asked, decoded (string)."""
    keep = ["doc_id"] if keep is None else keep
    schema = schema_of([docs.schema[k] for k in keep], [("ids", "array<int>"), *[("decoded", "string")] * decode])

    def build(part: pa.RecordBatch, pieces: Pieces) -> list[pa.Array]:
        texts = [t or "" for t in part.column(len(keep)).to_pylist()]
        ids = pieces.encode(texts)
        out = [pa.array(ids, pa.list_(pa.int32()))]
        return [*out, pa.array(pieces.decode(ids), pa.string())] if decode else out

    return docs.select(*keep, text).mapInArrow(_mapper(model, len(keep), build, [f.name for f in schema]), schema)


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 from one pass of the operator."""
    schema = schema_of([docs.schema["doc_id"]], [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")])

    def build(part: pa.RecordBatch, pieces: Pieces) -> list[pa.Array]:
        ids = pieces.encode([t or "" for t in part.column(1).to_pylist()])
        text = pieces.decode(ids)
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text]),
        ]

    return docs.select("doc_id", "text").mapInArrow(_mapper(model, 1, build, [f.name for f in schema]), schema)


def _mapper(model: str, kept: int, build: Callable[[pa.RecordBatch, Pieces], list[pa.Array]], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *build(part, pieces)], names)

    return run
