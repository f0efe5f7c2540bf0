"""Exact removal of repeated byte strings by prefix-free parsing.

A byte goes when some ``length``-byte string that covers it also starts in a
document with a smaller doc_id. Strings are judged on the input.

1. Parse. A rolling hash over ``trigger`` bytes is taken at every position; the
   smallest one within each window of ``length`` bytes is its trigger, so equal
   strings have equal triggers wherever they stand. Neighbouring windows with
   one trigger make a phrase, which carries the ``length - 1`` bytes after it.
2. Dictionary. Documents are dealt into hash groups of a few MB. Each group
   sends its distinct trigger hashes; those that occur in one document only
   cannot belong to a repeated string, and their phrases are never sent. Of the
   others each group sends every distinct phrase once, with its smallest id.
3. Order. A bucket of triggers builds the suffix array of its dictionary by radix
   passes, cut at ``length`` bytes, and that of its parse: the occurrences of all
   phrases, by the phrase's place in the dictionary's order, then by document (a
   phrase has the bytes that follow it, so the next phrase decides nothing).
   Together they are the corpus order of the bucket's suffixes: each suffix of the
   dictionary stands for its phrase's run of the parse. Neighbours with ``length``
   equal bytes form a class, whose smallest document decides for all occurrences.
4. The parse brings decisions back to the documents, where they become spans.

A trigger that very many different phrases share (a common run of ``trigger``
bytes between other words) is hot: more than HOT_GROUPS groups have it, or one has
more than HOT_PHRASES phrases with it. Its windows are phrases of their own, each
distinct one once per group, and go to buckets by their own bytes; so a bucket holds
at most HOT_GROUPS x HOT_PHRASES phrases of one trigger, and of one window or phrase
as many as there are groups.

Hashes only route and pre-select: phrases are merged and suffixes compared by
their bytes. A hot passage costs one phrase per group, however often it occurs
inside the group. What a group sends to a bucket is one row, of which there are at
most as many as trigger hashes. Defined cases: null text is empty; a document shorter than
``length`` is kept; a null doc_id neither removes nor loses bytes; rows with one
doc_id do not remove each other's bytes; an empty table gives no row; a very long
text is one document of its group, whole; columns named like an output are
replaced. doc_id is an integer, or text that reads as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import bytesops as B
from textmill.llm.frames import drop_clashing, group_count, hash_group, with_fields

LENGTH = 50
TRIGGER = 16
GROUP_BYTES = 4 << 20
BUCKETS_PER_GROUP = 3
HOT_GROUPS, HOT_PHRASES = 256, 128
_MOST = 64  # windows of one phrase, so that a decision fits one 64-bit mask
_NEW = ["kept", "n_bytes", "n_removed", "spans"]


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, trigger hash, hash of the phrase's bytes) of every phrase."""
    parts = []
    for first, last, d, o in B.chunks(data, offsets):
        n, m = len(d) - length + 1, len(d) - trigger + 1
        if n <= 0:
            continue
        h = B.prefix_hash(d)
        g = B.mix((h[trigger:] - h[:-trigger]) * B._power(B._INVERSE, m))
        least = B.window_min(g, length - trigger + 1)[:n]
        at = np.flatnonzero(np.diff(o) >= length)
        row, pos = B.ragged(np.diff(o)[at] - length + 1)
        p, doc = o[at][row] + pos, at[row]
        least = least[p]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(p)))
        if len(count) and count.max() > _MOST:
            r, k = B.ragged(-(-count // _MOST))
            start, count = start[r] + k * _MOST, np.minimum(count[r] - k * _MOST, _MOST)
        lo = p[start]
        parts.append((doc[start] + first, lo + offsets[first], count, least[start], B.span_hash(h, lo, lo + count + length - 1)))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def merge_equal(data: np.ndarray, lo: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each span, representative of each class): equal bytes; the first span of a class represents it."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    heads = np.minimum.reduceat(order, np.flatnonzero(new)) if len(k) else order
    classes = np.empty(len(k), dtype=np.int64)
    classes[order] = np.cumsum(new) - 1
    rep = heads[classes]
    again = np.flatnonzero(rep != np.arange(len(k)))
    differ = size[again] != size[rep[again]]
    same = ~differ
    same[~differ] = B.same_bytes(data, lo[again[~differ]], lo[rep[again[~differ]]], size[again[~differ]])
    if not same.all():  # two strings with one 64-bit hash: each further one stands alone
        extra = again[~same]
        classes[extra] = len(heads) + np.arange(len(extra))
        heads = np.concatenate((heads, extra))
    return classes, heads


class _Docs:
    """One group's documents in an order that every pass repeats: by id, then by bytes."""

    def __init__(self, table: pa.Table) -> None:
        ids = table["doc_id"].cast(pa.int64())
        text = table["text"].cast(pa.large_binary()).combine_chunks() if table.num_rows else pa.array([], pa.large_binary())
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_binary())
        null = np.asarray(ids.is_null()) if table.num_rows else np.zeros(0, bool)
        key = (ids.fill_null(0) if null.any() else ids).to_numpy()
        order = np.lexsort((key, null))
        same = (np.diff(key[order]) == 0) & (np.diff(null[order].astype(np.int8)) == 0)
        if same.any():
            raw = text.fill_null(b"").to_pylist()
            order = np.array(sorted(range(len(key)), key=lambda i: (null[i], key[i], raw[i])), dtype=np.int64)
        self.table = table.take(pa.array(order))
        self.valid = ~null[order]
        self.ids = key[order].astype(np.int64)
        self.data, self.offsets = B.binary(text.take(pa.array(order)))

    def parse(self, length: int, trigger: int) -> tuple[np.ndarray, ...]:
        doc, lo, count, t, x = phrases(self.data, self.offsets, length, trigger)
        use = self.valid[doc] if len(doc) else np.zeros(0, bool)
        return doc[use], lo[use], count[use], t[use], x[use]


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), dtype=kind)


def _six(x: np.ndarray) -> np.ndarray:
    """48 bits of each hash, as bytes; they pre-select only."""
    return np.ascontiguousarray((x >> B.U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :6] = b
    return out.view("<u8").ravel()


_ROUTED = "_g int, _rows binary, _lo binary, _mask binary"


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(the suffixes at ``starts`` in the order of their first ``length`` bytes, whether each differs from the one before).

    Radix passes of eight bytes, from the first, each over what the passes before left tied.
    """
    def digit(at: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for i in range(size):
            out = (out << np.uint64(8)) | data[at + i]
        return out

    order = np.argsort(digit(starts, min(8, length)))
    key = digit(starts[order], min(8, length))
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    done = 8
    while done < length:
        # Places (of the order) that have an equal neighbour, and the run that each belongs to.
        tied = ~new
        tied[:-1] |= ~new[1:]
        place = np.flatnonzero(tied)
        if not len(place):
            break
        run = np.cumsum(new[place])
        key = digit(starts[order[place]] + done, min(8, length - done))
        within = np.lexsort((key, run))
        order[place] = order[place][within]
        key = key[within]
        new[place[1:]] |= (key[1:] != key[:-1]) & (run[1:] == run[:-1])
        done += 8
    return order, new


def _triggers(length: int, trigger: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        g = table["_g"][0].as_py()
        docs = _Docs(table)
        doc, _, _, t, x = docs.parse(length, trigger)
        order = np.lexsort((docs.ids[doc], t))
        t, ids = t[order], docs.ids[doc][order]
        first = np.ones(len(t), bool)
        first[1:] = t[1:] != t[:-1]
        at = np.flatnonzero(first)
        several = np.zeros(len(at), bool)
        if len(at):
            several = ids[at] != ids[np.append(at[1:], len(t)) - 1]
        key = t[at]
        many = np.isin(key, _with_many(t, x[order]))
        bucket = bucket_of(key, buckets)
        key = ((key >> B.U64(18)) << B.U64(18)) | (several.astype(B.U64) << B.U64(16)) | (many.astype(B.U64) << B.U64(17))
        order = np.lexsort((key, bucket))
        key, bucket = key[order], bucket[order].astype(np.int64)
        used, at = np.unique(bucket, return_index=True)
        cut = np.append(at, len(key))
        return pa.table({"_b": pa.array(used.astype(np.int32)), "_g": pa.array(np.full(len(used), g, np.int32)), "_keys": pa.array([_six(key[cut[i] : cut[i + 1]]).tobytes() for i in range(len(used))], pa.binary())})

    return run


def _with_many(t: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """The triggers of ``t`` (sorted) that stand in more than HOT_PHRASES different phrases."""
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    at = np.flatnonzero(new)
    often = np.diff(np.append(at, len(t))) > HOT_PHRASES
    use = np.repeat(often, np.diff(np.append(at, len(t))))
    pairs = np.unique(np.stack((t[use], phrase[use]), axis=1), axis=0)[:, 0] if use.any() else t[:0]
    key, count = np.unique(pairs, return_counts=True)
    return key[count > HOT_PHRASES]


def _bare(t: np.ndarray) -> np.ndarray:
    """The part of a trigger hash that is sent."""
    return t >> B.U64(18)


def bucket_of(t: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that decides on a trigger, from the part that is sent: triggers which share it are judged as one, by one bucket."""
    return _bare(t) % B.U64(buckets)


def _among(t: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which triggers have one of these sorted bare keys."""
    if not len(keys):
        return np.zeros(len(t), bool)
    return keys[np.minimum(np.searchsorted(keys, _bare(t)), len(keys) - 1)] == _bare(t)


_SHARED = "_g int, _keys binary, _hot binary"


def _shared(most_groups: int):
    def run(table: pa.Table) -> pa.Table:
        """The trigger hashes of a bucket that more than one document has, sent back to each group that has them."""
        keys = [_from_six(x) for x in table["_keys"].to_pylist()]
        cut = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        key = np.concatenate(keys)
        bare, several, many = key >> B.U64(2), (key & B.U64(1)).astype(np.int64), (key >> B.U64(1) & B.U64(1)).astype(np.int64)
        order = np.argsort(bare, kind="stable")
        b = bare[order]
        new = np.ones(len(b), bool)
        new[1:] = b[1:] != b[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(b)))
        keep, hot = np.zeros(len(b), bool), np.zeros(len(b), bool)
        shared = (size > 1) | (np.add.reduceat(several[order], at) > 0)
        keep[order] = np.repeat(shared, size)
        hot[order] = np.repeat(shared & ((size > most_groups) | (np.add.reduceat(many[order], at) > 0)), size)
        out: dict[str, list] = {"_g": [], "_keys": [], "_hot": []}
        for g, lo, hi in zip(table["_g"].to_pylist(), cut[:-1], cut[1:], strict=True):
            if keep[lo:hi].any():
                own = bare[lo:hi]
                out["_g"].append(g)
                out["_keys"].append(_six(own[keep[lo:hi] & ~hot[lo:hi]] << B.U64(18)).tobytes())
                out["_hot"].append(_six(own[hot[lo:hi]] << B.U64(18)).tobytes() if hot[lo:hi].any() else None)
        return pa.table([pa.array(out["_g"], pa.int32()), pa.array(out["_keys"], pa.binary()), pa.array(out["_hot"], pa.binary())], ["_g", "_keys", "_hot"])

    return run


def _routed_keys(column: pa.ChunkedArray) -> np.ndarray:
    """Sorted bare keys of routed rows."""
    parts = [_from_six(k) >> B.U64(2) for k in column.to_pylist() if k]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, B.U64)


def _windows_of(docs: _Docs, lo: np.ndarray, count: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start, class, first window of each class) of every window of these phrases, in the order of their places."""
    row, k = B.ragged(count)
    at, of = lo[row] + k, doc[row]
    classes, heads = merge_equal(docs.data, at, np.full(len(at), length), _hashes(docs, at, length))
    return of, at, classes, heads


def _hashes(docs: _Docs, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes at each of these places."""
    key, order, i = np.zeros(len(at), B.U64), np.argsort(at, kind="stable"), 0
    at = at[order]
    while i < len(at):  # the places of a part of the bytes at a time
        j = max(i + 1, int(np.searchsorted(at, at[i] + B.CHUNK_BYTES)))
        here = at[i:j] - at[i]
        key[order[i:j]] = B.span_hash(B.prefix_hash(docs.data[at[i] : at[j - 1] + length]), here, here + length)
        i = j
    return key


def _dictionary(length: int, trigger: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({k: pa.array([], t) for k, t in (("_b", pa.int32()), ("_g", pa.int32()), ("_ids", pa.binary()), ("_rows", pa.binary()), ("_lo", pa.binary()), ("_count", pa.binary()), ("_body", pa.binary()))})
        if not left.num_rows or not right.num_rows:
            return empty
        g = left["_g"][0].as_py()
        docs = _Docs(left)
        doc, lo, count, t, x = docs.parse(length, trigger)
        hot = _among(t, _routed_keys(right["_hot"]))
        of, window, _, first = _windows_of(docs, lo[hot], count[hot], doc[hot], length)
        use = _among(t, _routed_keys(right["_keys"])) & ~hot
        doc, lo, count, t, x = doc[use], lo[use], count[use], t[use], x[use]
        if not len(doc) and not len(first):
            return empty
        _, heads = merge_equal(docs.data, lo, count + length - 1, x)
        # A hot trigger's windows are phrases of one window that their own bytes route.
        doc, lo = np.concatenate((doc[heads], of[first])), np.concatenate((lo[heads], window[first]))
        t = np.concatenate((t[heads], _hashes(docs, window[first], length)))
        count = np.concatenate((count[heads], np.ones(len(first), np.int64)))
        bucket = ((t & B.U64(0xFFFF_FFFF)) % B.U64(buckets)).astype(np.int64)
        order = np.lexsort((lo, bucket))
        doc, lo, count, bucket = doc[order], lo[order], count[order], bucket[order]
        used, at = np.unique(bucket, return_index=True)
        cut = np.append(at, len(doc))
        cols: dict[str, list] = {k: [] for k in ("_ids", "_rows", "_lo", "_count", "_body")}
        for i in range(len(used)):
            s = slice(cut[i], cut[i + 1])
            row, k = B.ragged(count[s] + length - 1)
            cols["_ids"].append(_pack(docs.ids[doc[s]]))
            cols["_rows"].append(_pack(doc[s].astype(np.uint32)))
            cols["_lo"].append(_pack((lo[s] - docs.offsets[doc[s]]).astype(np.uint32)))
            cols["_count"].append(_pack(count[s].astype(np.uint8)))
            cols["_body"].append(_pack(docs.data[lo[s][row] + k]))
        return pa.table({"_b": pa.array(used.astype(np.int32)), "_g": pa.array(np.full(len(used), g, np.int32))} | {k: pa.array(v, pa.binary()) for k, v in cols.items()})

    return run


def _order(length: int):
    def run(table: pa.Table) -> pa.Table:
        ids = [_unpack(x, np.int64) for x in table["_ids"].to_pylist()]
        sizes = np.array([len(x) for x in ids])
        ids = np.concatenate(ids)
        rows = np.concatenate([_unpack(x, np.uint32) for x in table["_rows"].to_pylist()])
        at = np.concatenate([_unpack(x, np.uint32) for x in table["_lo"].to_pylist()])
        count = np.concatenate([_unpack(x, np.uint8) for x in table["_count"].to_pylist()]).astype(np.int64)
        body = np.concatenate([_unpack(x, np.uint8) for x in table["_body"].to_pylist()])
        size = count + length - 1
        lo = np.cumsum(size) - size
        key = np.concatenate([B.span_hash(B.prefix_hash(body[lo[i] : lo[j - 1] + size[j - 1]]), lo[i:j] - lo[i], lo[i:j] - lo[i] + size[i:j]) for i, j, *_ in B.chunks(body, np.append(lo, len(body)))])
        phrase, heads = merge_equal(body, lo, size, key)
        # The dictionary: its distinct phrases one after another, and their suffix array, cut at `length` bytes.
        count_of, size_of = count[heads], size[heads]
        row, k = B.ragged(size_of)
        dictionary = body[lo[heads][row] + k]
        begin = np.cumsum(size_of) - size_of
        row, k = B.ragged(count_of)
        order, new = suffix_order(dictionary, begin[row] + k, length)
        # The parse: occurrences by their phrase's place in that order, then by document; the first of a run is its smallest.
        place = np.empty(len(heads), np.int64)
        place[row[order[k[order] == 0]]] = np.arange(len(heads))
        parse = np.lexsort((ids, place[phrase]))
        runs = np.searchsorted(place[phrase][parse], np.arange(len(heads)))
        smallest = ids[parse[runs]][place]
        # Corpus order of the bucket: each suffix stands for its phrase's run of the parse. Equal neighbours are one class.
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        owner = smallest[row]
        least = np.minimum.reduceat(owner[order], np.flatnonzero(new))[group]
        # Decisions of each class, one bit a window; copies of a phrase differ by their id only.
        first = np.cumsum(count_of) - count_of
        bits = B.U64(1) << k.astype(B.U64)
        mine = np.add.reduceat(np.where(least < owner, bits, B.U64(0)), first)
        whole = np.where(count >= 64, ~B.U64(0), (B.U64(1) << np.minimum(count, 63).astype(B.U64)) - B.U64(1))
        mask = np.where(ids > smallest[phrase], whole, mine[phrase])
        groups = np.repeat(np.arange(len(sizes)), sizes)
        keep = mask != 0
        out: dict[str, list] = {"_g": [], "_rows": [], "_lo": [], "_mask": []}
        names = table["_g"].to_pylist()
        cut = np.searchsorted(groups[keep], np.arange(len(sizes) + 1))
        rows, at, mask = rows[keep], at[keep], mask[keep]
        for i in np.flatnonzero(np.diff(cut)):
            s = slice(cut[i], cut[i + 1])
            out["_g"].append(names[i])
            out["_rows"].append(_pack(rows[s]))
            out["_lo"].append(_pack(at[s]))
            out["_mask"].append(_pack(mask[s]))
        return pa.table({"_g": pa.array(out["_g"], pa.int32())} | {k: pa.array(out[k], pa.binary()) for k in ("_rows", "_lo", "_mask")})

    return run


def _apply(length: int, trigger: int, schema: pa.Schema, as_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        docs = _Docs(left)
        doc, lo, count, t, x = docs.parse(length, trigger)
        size = count + length - 1
        change = np.zeros(len(docs.data) + 1, np.int64)
        parts = [x for x in zip(right["_rows"].to_pylist(), right["_lo"].to_pylist(), right["_mask"].to_pylist(), strict=True) if x[0] is not None]
        none = np.zeros(0, np.int64)
        place = np.concatenate([none, *[docs.offsets[_unpack(r, np.uint32).astype(np.int64)] + _unpack(a, np.uint32) for r, a, _ in parts]])
        mask = np.concatenate([none.astype(B.U64), *[_unpack(m, np.uint64) for _, _, m in parts]])
        owner = np.searchsorted(lo, place, side="right") - 1
        hot = _among(t, _routed_keys(right["_hot"]))
        of_hot = hot[owner] if len(place) else np.zeros(0, bool)
        if hot.any():  # windows of hot triggers: an equal one in a smaller document of the group, or elsewhere
            of, at, classes, heads = _windows_of(docs, lo[hot], count[hot], doc[hot], length)
            late = np.zeros(len(heads), bool)
            late[classes[np.searchsorted(at, place[of_hot])]] = True
            p = at[late[classes] | (docs.ids[of] > docs.ids[of[heads]][classes])]
            np.add.at(change, p, 1)
            np.add.at(change, p + length, -1)
        if len(doc):
            classes, heads = merge_equal(docs.data, lo, size, x)
            gone = docs.ids[doc] > docs.ids[doc[heads]][classes]
            np.add.at(change, lo[gone], 1)
            np.add.at(change, lo[gone] + size[gone], -1)
            decided = np.zeros(len(heads), B.U64)
            decided[classes[owner[~of_hot]]] = mask[~of_hot]
            rest = np.flatnonzero(~gone & (decided[classes] != 0))  # a phrase may stand more than once in its first document
            mask, at = decided[classes[rest]], lo[rest]
            for bit in range(_MOST):
                p = at[((mask >> B.U64(bit)) & B.U64(1)).astype(bool)] + bit
                np.add.at(change, p, 1)
                np.add.at(change, p + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        raw, kept, removed, spans = docs.data, [], [], []
        for i in range(len(docs.ids)):
            a, b = docs.offsets[i], docs.offsets[i + 1]
            mask = gone[a:b]
            if mask.any():
                kept.append(raw[a:b][~mask].tobytes())
                s, e = B.runs(mask)
                spans.append([{"start": int(u), "end": int(v)} for u, v in zip(s, e, strict=True)])
                removed.append(int(mask.sum()))
            else:
                kept.append(raw[a:b].tobytes())
                spans.append([])
                removed.append(0)
        out = docs.table.drop_columns(["_g"])
        new = {"kept": [kept_text(x) for x in kept] if as_text else kept, "n_bytes": np.diff(docs.offsets).tolist(), "n_removed": removed, "spans": spans}
        for name in _NEW:
            out = out.append_column(schema.field(name), pa.array(new[name], schema.field(name).type))
        return out.cast(schema)

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, as_text: bool = False, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """All rows and columns of ``docs`` with kept, n_bytes, n_removed and spans (byte ranges removed).

    ``kept`` is what is left: binary, or with ``as_text`` a string without characters of which a part is gone.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if not 0 < trigger <= length:
        raise ValueError("trigger must lie in 1 .. length")
    groups = group_count(docs, GROUP_BYTES, 48)
    buckets = BUCKETS_PER_GROUP * groups
    docs = drop_clashing(docs, _NEW)
    names = docs.columns
    rest = [c for c in names if c.lower() not in ("doc_id", "text")]
    # The user's other columns travel in one struct, and only to the last step.
    base = docs.select("doc_id", "text", *[F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row")] * bool(rest))
    known = base.where("doc_id IS NOT NULL").withColumn("_g", hash_group(F.col("doc_id"), groups))
    new = [("kept", "string" if as_text else "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("spans", "array<struct<start:long,end:long>>")]
    result = with_fields(base, new)
    grouped = lambda *more: known.select("doc_id", "text", *more, "_g").groupBy("_g")
    routed = lambda df: df.groupBy("_g")
    triggers = grouped().applyInArrow(_triggers(length, trigger, buckets), "_b int, _g int, _keys binary")
    shared = triggers.groupBy("_b").applyInArrow(_shared(hot_groups), _SHARED)
    sent = grouped().cogroup(routed(shared)).applyInArrow(_dictionary(length, trigger, buckets), "_b int, _g int, _ids binary, _rows binary, _lo binary, _count binary, _body binary")
    decided = sent.groupBy("_b").applyInArrow(_order(length), _ROUTED).unionByName(shared.select("_g", "_hot").where("_hot IS NOT NULL"), allowMissingColumns=True)
    done = grouped(*base.columns[2:]).cogroup(routed(decided)).applyInArrow(_apply(length, trigger, to_arrow_schema(result), as_text), result)
    # Rows without an id neither give nor lose bytes, so they are not dealt at all.
    text = F.coalesce(F.col("text"), F.lit(""))
    values = {"kept": text if as_text else text.cast("binary"), "n_bytes": F.octet_length(text).cast("long"), "n_removed": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:long,end:long>>")}
    without = base.where("doc_id IS NULL").select(*base.columns, *[values[n].alias(n) for n, _ in new])
    given = lambda c: F.col("doc_id").alias(c) if c.lower() == "doc_id" else F.col("text").alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`").alias(c)
    return done.unionByName(without).select(*[given(c) for c in names], *[n for n, _ in new])


def kept_text(column: bytes | None) -> str:
    """Bytes left as text; a character of which a part is gone is dropped."""
    return (column or b"").decode("utf-8", "ignore")
