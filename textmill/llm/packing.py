"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents become token ids with an end id. Each is cut into full windows and a
remainder in pieces of at most half a window; these are dealt into hash groups by
document and place, and each group is partitioned on its own: the largest
differencing method merges the two partial partitions with the largest spread, the
largest sum of one onto the smallest of the other, until one partition with
near-equal sums is left. If a window would hold more than the capacity, the window
count rises and the method runs again. The number of groups follows the stored
bytes, so neither many short documents nor few very long ones make a group grow;
only where Spark knows no size (a frame made from rows) are the rows counted, with
``per_group`` in each. Only piece lengths and checksums are shuffled.

Defined cases: null and empty texts are one end id; an added token's string in
a text is that token, as in the tokenizers file; rows with equal ids are
packed separately; an empty table gives no piece; a null doc_id is carried; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.frames import plan_bytes, shuffle_partitions

CAPACITY = 2048
END_ID = 1
PER_GROUP = 1000
GROUP_BYTES = 1 << 20
UNKNOWN = 1 << 60  # Catalyst's size of rows that no file holds is larger


@lru_cache(maxsize=2)
def byte_bpe(ranks_path: str, pattern: str):
    """The byte-level BPE with the given ranks and the added tokens of the tokenizers file (.json) beside them."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(Path(ranks_path).with_suffix(".json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def encoder(ranks_path: str, pattern: str):
    """Ids of a text, equal to those of the tokenizers file without its template: added tokens inside texts have their own ids."""
    return partial(byte_bpe(ranks_path, pattern).encode, allowed_special="all")


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0 .. k - 1) of each size; multiway largest differencing."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    kids: list[tuple[int, int]] = []  # inner nodes n, n + 1, ...: the two sets that were joined
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, size in enumerate(sizes.tolist()):
        sums, sets = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], sets[0] = size, i
        heap.append((-size, i, sums, sets))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, sums_a, sets_a = heapq.heappop(heap)
        _, _, sums_b, sets_b = heapq.heappop(heap)
        sums, other = sums_a + sums_b[::-1], sets_b[::-1]
        joined = np.flatnonzero((sets_a >= 0) & (other >= 0))
        sets = np.where(sets_a >= 0, sets_a, other)
        if len(joined):
            first = n + len(kids)
            kids.extend(zip(sets_a[joined].tolist(), other[joined].tolist(), strict=True))
            sets[joined] = np.arange(first, first + len(joined))
        order = np.argsort(-sums, kind="stable")
        sums, sets = sums[order], sets[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), turn, sums, sets))
        turn += 1
    window = np.zeros(n, dtype=np.int64)
    for w, root in enumerate(heap[0][3].tolist()):
        todo = [root] if root >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                window[x] = w
            else:
                todo.extend(kids[x - n])
    return window


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size, with no window above the capacity and as few windows as the method reaches."""
    if len(sizes) and sizes.max() > capacity:
        raise ValueError("a piece is longer than the capacity")
    k = max(1, -(-int(sizes.sum()) // capacity)) if len(sizes) else 1
    while True:
        window = differencing(sizes, k)
        over = np.bincount(window, weights=sizes, minlength=k).max() if len(sizes) else 0
        if over <= capacity:
            return window
        k += max(1, int(k * min(0.02, (over - capacity) / capacity / 4)))


def cuts(n: int, full: int, capacity: int) -> list[tuple[int, int]]:
    """Full windows up to ``full``, then pieces of half a window: pieces no longer than that level out closely."""
    half = max(1, capacity // 2)
    starts = [*range(0, full, capacity), *range(full, n, half)]
    return list(zip(starts, [*starts[1:], n], strict=True))


def _pieces(encode, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encode()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoding(text or "")
                    ids.append(end_id)
                    raw = np.array(ids, dtype="<u4")
                    full = len(raw) // capacity * capacity
                    for start, end in cuts(len(raw), full, capacity):
                        piece = raw[start:end]
                        cols["doc_id"].append(doc_id)
                        cols["start"].append(start)
                        cols["length"].append(len(piece))
                        cols["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                        cols["doc_tokens"].append(len(raw))
                        if with_ids:
                            cols["ids"].append(piece.astype(np.int32))
                kinds = {"doc_id": part.schema.field(0).type} | dict.fromkeys(("start", "length", "ids_crc32", "doc_tokens"), pa.int64())
                if with_ids:
                    kinds["ids"] = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in kinds.items()], list(kinds))

    return run


def _windows(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        group = table["_group"][0].as_py()
        table = table.drop_columns(["_group"]).sort_by([(k, "ascending") for k in ("length", "doc_id", "start", "ids_crc32")])
        length = table["length"].to_numpy()
        full = length == capacity
        window = np.empty(len(length), np.int64)
        window[~full] = pack_sizes(length[~full], capacity)
        used = int(window[~full].max()) + 1 if (~full).any() else 0
        window[full] = used + np.arange(int(full.sum()))
        order = np.argsort(window, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        new = np.ones(len(order), bool)
        new[1:] = window[order][1:] != window[order][:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        offset = np.empty(len(order), np.int64)
        offset[order] = before - before[first]
        return table.append_column("sequence_id", pa.array(group * (1 << 32) + window)).append_column("offset", pa.array(offset))

    return run


def group_and_task_count(docs: DataFrame, per_group: int = PER_GROUP, group_bytes: int = GROUP_BYTES) -> tuple[int, int]:
    """Groups by stored bytes, by rows where the size is not known, and the tasks that share them."""
    size = plan_bytes(docs)
    groups = max(1, -(-size // group_bytes) if size < UNKNOWN else -(-docs.count() // per_group))
    return groups, min(groups, max(shuffle_partitions(docs.sparkSession), groups // 16))


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, per_group: int = PER_GROUP, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, (ids), sequence_id, offset."""
    encode = lambda: encoder(ranks_path, pattern)
    groups, tasks = group_and_task_count(docs, per_group)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(encode, capacity, end_id, with_ids), ddl)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(groups)))
    # By a number of its own: the rows are small and the work is not, so Spark would join too many groups into one task.
    return dealt.repartition(tasks, "_group").groupBy("_group").applyInArrow(_windows(capacity), ddl + ", sequence_id long, offset long")
