"""Near duplicates by DartMinHash signatures, banding and exact verification.

Each five-word shingle is an element with a weight. Darts fall on the plane of an
element's weight and a rank axis as a Poisson process that only hashes decide, so
equal regions catch equal darts in every document. A dart counts if it is below
the element's weight and its rank below theta = t / total weight, about
``t = k ln k + 2 k`` darts a document; each is hashed to one of k coordinates,
which keeps its earliest dart. Two documents agree in a coordinate with the
probability of their weighted Jaccard similarity. Theta doubles for a document
with an empty coordinate, which changes no coordinate that is filled.

Signatures are cut into bands. Exact copies are one vertex. Vertices that share a
band value are candidates; they are tied to the value's smallest vertex only, and
the components of these ties hold every pair that any band proposes. Inside a
component shingle sets are compared exactly (by an inverted index, neighbours of
a found class first), and links of the threshold or more make the classes. Sets hold
64-bit hashes of shingles, so "exactly" is up to two shingles with one hash.

A component of more than ``block`` vertices, or of more than a few MB of shingles,
is cut into blocks. In a first pass
each block is compared within itself and with a fixed number of leaders of the
whole component, which is linear in its size and joins most of it to one class.
A link that is still missing has an end outside the largest class, so in a second
pass only those vertices, in blocks, are compared with every block. No group
grows with the component, and a group of near copies that hang together costs
one pass; what stays outside its largest class is compared with all of it, which
no exact method avoids.

The threshold is on the Jaccard similarity of shingle sets, for which weights of
one are right (``weights="binary"``); ``weights="count"`` signs multisets.

Defined cases: words are runs without white space, compared as they stand; a text
of one to four words is one shingle of them all; a text without words links to its
exact copies only; null text is empty; an id that stands in several rows has a
class for each of its texts, and no text is lost or merged by it; a null doc_id has
a null class; an empty table gives no row; other columns, whatever
their names, are left out; very long texts are signed and compared whole. doc_id is
an integer, or text that reads as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import bytesops as B
from textmill.llm.components import components
from textmill.llm.frames import checkpoint
from textmill.llm.hashed import bucketed

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 22, 4
BLOCK = 1000
BLOCK_BYTES = 8 << 20
LEADERS = 64


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``words`` words, with repeats; fewer words make one shingle."""
    n = len(offsets) - 1
    s, e, doc = B.words(data, offsets)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = B.prefix_hash_of(B.span_hash(B.prefix_hash(data), s, e))
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    some = np.flatnonzero(count)
    row, k = B.ragged(np.maximum(count[some] - words + 1, 1))
    start = first[some][row] + k
    size = np.minimum(words, count[some])[row]
    return some[row], B.mix((h[start + size] - h[start]) * B.inverse_powers(len(h))[start] + size.astype(np.uint64))


def weighted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of distinct shingles."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    return d[at], k[at], np.diff(np.append(at, len(d))).astype(np.float64)


def dart_signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray | None, n: int, k: int) -> np.ndarray:
    """k coordinates (hash of the earliest dart) of each of n documents; documents without an element have zeros.

    ``weight`` is positive; None means one for every element. Repeats of an element of weight one change nothing.
    """
    out = np.zeros((n, k), np.uint64)
    if not len(doc):
        return out
    if weight is None:
        total, part = np.bincount(doc, minlength=n).astype(float), None
    else:  # an element of weight 2.5 covers two unit cells and half of a third
        total = np.bincount(doc, weights=weight, minlength=n)
        row, cell = B.ragged(np.ceil(weight).astype(np.int64))
        part = np.minimum(weight[row] - cell, 1.0)
        doc, key = doc[row], B.mix(key[row] ^ B.mix(cell.astype(np.uint64), 21))
    theta = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-12)
    todo = total > 0
    while todo.any():
        best = np.full(n * k, np.inf)
        sig = np.zeros(n * k, np.uint64)
        live = np.flatnonzero(todo[doc])
        rank = np.zeros(len(live))
        number = 0
        while len(live):
            dart = B.mix(key[live], 100 + number)
            rank = rank - np.log(((dart >> B.U64(11)).astype(np.float64) + 1) * 2.0**-53)
            use = rank < theta[doc[live]]
            live, rank, dart = live[use], rank[use], dart[use]
            hit = np.arange(len(live)) if part is None else np.flatnonzero((B.mix(dart, 8) >> B.U64(11)).astype(np.float64) * 2.0**-53 < part[live])
            slot = doc[live[hit]] * k + (B.mix(dart[hit], 9) % B.U64(k)).astype(np.int64)
            np.minimum.at(best, slot, rank[hit])
            first = rank[hit] == best[slot]
            sig[slot[first]] = dart[hit][first]
            number += 1
        full = np.isfinite(best.reshape(n, k)).all(axis=1)
        done = todo & full
        out[done] = sig.reshape(n, k)[done]
        todo &= ~full
        theta[todo] *= 2
    return out


def band_values(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value per band."""
    values = np.zeros((len(signatures), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signatures), B.U64(b + 1))
        for r in range(rows):
            h = B.mix(h ^ signatures[:, b * rows + r], 31)
        values[:, b] = h
    return values


def _signed(bands: int, rows: int, words: int, weights: str):
    def sign(data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        doc, key = shingles(data, offsets, words)
        count = np.bincount(doc, minlength=n)
        weight = None
        if weights == "count":
            doc, key, weight = weighted(doc, key)
        return count, band_values(dart_signatures(doc, key, weight, n, bands * rows), bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, (count, values) in bucketed(batch.column(2), sign):
                values = [v if c else [] for v, c in zip(values.view(np.int64), count, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, last - first) for i in (0, 1)], pa.array(count, pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["doc_id", "_text", "n_shingles", "_bands"])

    return run


def _sets(words: int):
    def distinct(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        doc, key, _ = weighted(*shingles(data, offsets, words))
        cut = np.searchsorted(doc, np.arange(len(offsets)))
        return [key[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets in bucketed(batch.column(2), distinct):
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, last - first) for i in (0, 1, 3)], pa.array(sets, pa.binary())], ["_node", "_label", "_text", "_set"])

    return run


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Class (index of its first member) of each shingle set: sets with a Jaccard similarity of the threshold or more are linked."""
    n = len(sets)
    label = np.arange(n)
    size = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        same = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, 0 if same and same >= threshold * (size.sum() - same) - 1e-9 else 1])
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(n), size)
    open_ = np.ones(n, bool)
    built, posting, head = -1, owner, np.zeros(0, np.int64)
    stack: list[int] = []
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed], stack = False, [seed]
        while stack:
            x = stack.pop()
            left = int(open_.sum())
            if not left:
                label[x] = seed
                continue
            if built < 0 or left * 2 <= built:  # an index of the sets that no class has yet
                use = np.flatnonzero(open_[owner])
                order = use[np.argsort(item[use], kind="stable")]
                posting, built = owner[order], left
                head = np.searchsorted(item[order], np.arange(item.max() + 2 if len(item) else 1))
            label[x] = seed
            mine = item[start[x] : start[x + 1]]
            row, k = B.ragged(head[mine + 1] - head[mine])
            shared = np.bincount(posting[head[mine][row] + k], minlength=n)
            hit = np.flatnonzero(open_ & (shared > 0) & (shared >= threshold * (size + size[x] - shared) - 1e-9))
            open_[hit] = False
            stack.extend(hit.tolist())
    return label


def linked_from(sets: list[np.ndarray], seeds: np.ndarray, threshold: float) -> np.ndarray:
    """Class of each set when only links with a seed at one end count."""
    n = len(sets)
    root = np.arange(n)
    size = np.array([len(s) for s in sets], np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(item, kind="stable")
    posting = np.repeat(np.arange(n), size)[order]
    head = np.searchsorted(item[order], np.arange(item.max() + 2 if len(item) else 1))
    for x in np.flatnonzero(seeds):
        mine = item[start[x] : start[x + 1]]
        row, k = B.ragged(head[mine + 1] - head[mine])
        shared = np.bincount(posting[head[mine][row] + k], minlength=n)
        hit = (shared > 0) & (shared >= threshold * (size + size[x] - shared) - 1e-9)
        found = np.unique(root[hit])
        if len(found) > 1:
            root[np.isin(root, found)] = found[0]
    return root


def _links(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([(k, "ascending") for k in ("_label", "_i", "_j", "_node")])
        node, seed = rows["_node"].to_numpy(), np.asarray(rows["_seed"])
        key = np.stack([rows[k].to_numpy().astype(np.int64) for k in ("_label", "_i", "_j")])
        sets = [np.frombuffer(x, np.uint64) for x in rows["_set"].to_pylist()]
        new = np.ones(len(node), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        cut = np.append(np.flatnonzero(new), len(node))
        a, b = [], []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi - lo > 1:
                label = linked(sets[lo:hi], threshold) if seed[lo:hi].all() else linked_from(sets[lo:hi], seed[lo:hi], threshold)
                other = np.flatnonzero(label != np.arange(hi - lo))
                a.append(node[lo:hi][other])
                b.append(node[lo:hi][label[other]])
        none = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate([*a, none]).astype(np.int64)), "b": pa.array(np.concatenate([*b, none]).astype(np.int64))})

    return run


def _grouped_links(rows: DataFrame, groups: int, threshold: float) -> DataFrame:
    """Links (a, b) of rows (_label, _i, _j, _node, _seed, _set), whose groups (_label, _i, _j) are dealt into tasks."""
    dealt = rows.select("_label", "_i", "_j", "_node", "_seed", "_set", F.pmod(F.xxhash64("_label", "_i", "_j"), F.lit(groups)).alias("_g"))
    return dealt.groupBy("_g").applyInArrow(_links(threshold), "a long, b long")


def _blocks(count: str, size: str, block: int, block_bytes: int):
    """Blocks for so many vertices and bytes of shingles."""
    return F.greatest(F.ceil(F.col(count) / block), F.ceil(F.col(size) / block_bytes), F.lit(1)).cast("int")


def verified_links(sets: DataFrame, threshold: float, block: int, leaders: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links that give the exact classes inside each candidate component; sets has _node, _label, _set."""
    sizes = sets.groupBy("_label").agg(F.count("*").alias("_n"), F.sum(F.octet_length("_set")).alias("_size"))
    sizes = checkpoint(sizes.withColumn("_blocks", _blocks("_n", "_size", block, block_bytes)))
    groups = max(16, -(-(sizes.agg(F.sum("_size")).first()[0] or 0) // (2 << 20)))
    own = sets.join(sizes, "_label").withColumn("_i", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
    last = F.col("_blocks") - 1
    shown = F.least(F.lit(leaders), F.ceil(F.col("_n") / F.col("_blocks") / 4))
    leads = (F.col("_blocks") > 1) & (F.pmod(F.xxhash64("_node", F.lit(1)), F.col("_n")) < shown)
    once = own.where(~leads)
    everywhere = own.where(leads).withColumn("_i", F.explode(F.sequence(F.lit(0), last)))
    first = _grouped_links(once.unionByName(everywhere).withColumns({"_j": F.lit(-1), "_seed": F.lit(True)}), groups, threshold)
    if sizes.where(F.col("_blocks") > 1).isEmpty():
        return first
    first = checkpoint(first)
    classes = components(first).withColumnRenamed("node", "_node").withColumnRenamed("label", "_class")
    slim = sets.select("_node", "_label", F.octet_length("_set").alias("_b")).join(sizes.where(F.col("_blocks") > 1), "_label")
    members = checkpoint(slim.join(classes, "_node", "left").withColumn("_class", F.coalesce("_class", "_node")))
    counted = members.groupBy("_label", "_class").agg(F.count("*").alias("_c"), F.sum("_b").alias("_s"))
    largest = checkpoint(counted.groupBy("_label").agg(F.max(F.struct("_c", "_class", "_s")).alias("_m")).select("_label", "_m.*").withColumnRenamed("_class", "_largest"))
    placed = members.join(largest, "_label").withColumns({"_c": F.col("_n") - F.col("_c"), "_s": F.col("_size") - F.col("_s"), "_out": F.col("_class") != F.col("_largest")}).where("_c > 0")
    placed = placed.withColumn("_ublocks", _blocks("_c", "_s", max(1, block // 2), block_bytes // 2)).select("_node", "_blocks", "_ublocks", "_out")
    rows = sets.join(placed, "_node").withColumn("_own", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int")).withColumn("_u", F.pmod(F.xxhash64("_node", F.lit(2)), F.col("_ublocks")).cast("int"))
    seeds = rows.where("_out").withColumn("_j", F.explode(F.sequence(F.lit(0), last))).select("_label", F.col("_u").alias("_i"), "_j", "_node", F.lit(True).alias("_seed"), "_set")
    others = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_ublocks") - 1))).where(~(F.col("_out") & (F.col("_u") == F.col("_i")))).select("_label", "_i", F.col("_own").alias("_j"), "_node", F.lit(False).alias("_seed"), "_set")
    return first.unionByName(_grouped_links(seeds.unionByName(others), groups, threshold))


def _classified(docs: DataFrame, threshold: float, words: int, bands: int, rows: int, weights: str, block: int, leaders: int) -> tuple[DataFrame, DataFrame]:
    """(signed rows, member): member has _text (digest), _doc (its smallest doc_id), _class (smallest doc_id of the class)
    and _keep, true for one text of each class: the one with the smallest doc_id, of several that with the smallest digest.

    A text is a vertex, named by its smallest doc_id. Where several texts have the same one (an id that stands in
    several rows), all but the one of smallest digest are named by a hash above 2^62, so no text merges with another.
    """
    if weights not in ("binary", "count"):
        raise ValueError("weights are binary or count")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("_text"), text.alias("text"))
    signed = checkpoint(keyed.mapInArrow(_signed(bands, rows, words, weights), "doc_id long, _text binary, n_shingles long, _bands array<long>"))
    vertices = signed.where("doc_id IS NOT NULL").groupBy("_text").agg(F.min(F.struct("doc_id", "_bands")).alias("_v")).select("_text", F.col("_v.doc_id").alias("_doc"), F.col("_v._bands").alias("_bands"))
    vertices = checkpoint(vertices.withColumn("_node", F.col("_doc")))
    shared = vertices.groupBy("_doc").agg(F.count("*").alias("_n"), F.min("_text").alias("_first")).where("_n > 1").select("_doc", "_first")
    repeated = not shared.isEmpty()
    if repeated:
        other = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("_doc", "_text"), 2)
        named = F.when(F.col("_first").isNull() | (F.col("_first") == F.col("_text")), F.col("_doc")).otherwise(other)
        vertices = checkpoint(vertices.drop("_node").join(shared, "_doc", "left").withColumn("_node", named).drop("_first"))
    banded = vertices.select("_node", F.explode("_bands").alias("_band"))
    tied = banded.groupBy("_band").agg(F.min("_node").alias("_least"), F.max("_node").alias("_most")).where("_least < _most").select("_band", "_least")
    ties = banded.join(tied, "_band").where("_node > _least").select(F.col("_node").alias("a"), F.col("_least").alias("b"))
    candidates = components(ties).withColumnRenamed("node", "_node").withColumnRenamed("label", "_label")
    texts = keyed.join(vertices.join(candidates, "_node").select("_text", "_doc", "_node", "_label"), "_text").where(F.col("doc_id") == F.col("_doc"))
    sets = texts.select("_node", "_label", "text", "_text").mapInArrow(_sets(words), "_node long, _label long, _text binary, _set binary")
    sets = checkpoint(sets.groupBy("_node", "_label", "_text").agg(F.first("_set").alias("_set")))  # repeated rows are one
    links = verified_links(sets, threshold, block, leaders)
    classes = components(links)
    member = vertices.select("_text", "_doc", "_node").join(classes.withColumnRenamed("node", "_node"), "_node", "left").select("_text", "_doc", "_node", F.coalesce("label", "_node").alias("_class"))
    if not repeated:  # a class is then named by its smallest doc_id
        return signed, member.withColumn("_keep", F.col("_node") == F.col("_class")).drop("_node")
    best = member.groupBy("_class").agg(F.min(F.struct("_doc", "_text")).alias("_b"))
    return signed, member.join(best, "_class").select("_text", "_doc", F.col("_b._doc").alias("_class"), (F.col("_text") == F.col("_b._text")).alias("_keep"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, weights: str = "binary", block: int = BLOCK, leaders: int = LEADERS) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), copy_of (smallest doc_id with the same text) and n_shingles of every row."""
    signed, member = _classified(docs, threshold, words, bands, rows, weights, block, leaders)
    known = F.col("doc_id").isNotNull()
    return signed.select("doc_id", "_text", "n_shingles").join(member, "_text", "left").select("doc_id", F.when(known, F.col("_class")).alias("class_id"), F.when(known, F.col("_doc")).alias("copy_of"), "n_shingles")


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, weights: str = "binary", block: int = BLOCK, leaders: int = LEADERS) -> DataFrame:
    """Whole rows of ``docs``, one of each class: of its texts the one with the smallest doc_id (ties: the smallest digest).

    Rows go by their text, never by their id alone, so an id that stands in several rows loses none of its other texts.
    Of rows with that id and text the one whose other columns are first as JSON stays; repeats are brought together
    in the tasks that hold them. Rows with a null doc_id belong to no class and all stay.
    """
    _, member = _classified(docs, threshold, words, bands, rows, weights, block, leaders)
    every = [F.col(f"`{c}`") for c in docs.columns]
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_doc"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("_text"), F.struct(*every).alias("_row"), F.to_json(F.struct(F.col("text").isNull().alias("_"), *[c for c, n in zip(every, docs.columns, strict=True) if n.lower() != "text"])).alias("_order"))
    single = known.groupBy("_doc", "_text").agg(F.min_by("_row", "_order").alias("_row"))
    kept = single.join(member.where("_keep").select("_doc", "_text"), ["_doc", "_text"], "left_semi")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))
