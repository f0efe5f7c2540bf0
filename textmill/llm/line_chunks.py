"""Line deduplication by content-defined chunks, in DataFrame functions only.

Lines are those with a word; blank ones belong to what stands around them. Each
line is hashed, and a polynomial hash rolls over the hashes of ``window`` lines.
Where it is smaller than at both neighbours a chunk ends, so boundaries depend on
a few lines around them alone and come back however far a passage has shifted.
No two such places touch, so every chunk of a text of several lines has two or
more.

1. Chunks are counted by hash in the whole corpus. The first occurrence of a
   repeated chunk, by doc_id and place, stays; the others are compared with its
   bytes and go.
2. A passage seldom begins and ends at boundaries. Around the chunks that went,
   and in chunks that are not repeated as a whole, the windows of the rolling hash
   extend the matches line by line: two neighbouring lines whose window stands
   earlier in the corpus go too, after the same comparison of bytes.

Together a line goes if some run of two or more lines that covers it stands
earlier, which is what the SQL says; the chunks carry the bulk of it, and only
the windows that no repeated chunk holds are sent. The first occurrence of each
line always stays.

Occurrences are counted with map-side partial aggregation of hashes and places,
so a chunk that a third of all documents share is one row per task; bytes move
only for what repeats, and texts twice.

Defined cases: null text stays null and has no line; a text of one line, and an
empty one, keeps it; blank lines between two lines of a run are part of the run;
a text whose lines all go becomes empty; rows with one doc_id are told apart by
their text, and exact repeats of a row share their decisions, so the first row
keeps its lines in all of them; a null doc_id comes first; an empty table gives
no row; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.frames import checkpoint

WINDOW = 2
_BASE, _PRIME = 65_599, 4_294_967_291
#: Fixed value: a line with a word.
WORD = r"[^\x20\x09-\x0D]"
_NEW = ("n_lines", "n_removed_lines", "n_removed_runs")


def _let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _indices(n: Column) -> Column:
    """0 .. n - 1, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def units(text: Column, window: int = WINDOW) -> Column:
    """Array of struct(whole, a, b, h): chunks (whole) and pairs of neighbouring lines, as lines a .. b with a hash."""

    def indexed(lines: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORD))
        return F.struct(F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"), filled.alias("at"))

    def rolled(x: Column) -> Column:
        bits = F.transform(x["at"], lambda i: F.pmod(F.get(x["hashes"], i), F.lit(_PRIME)))

        def roll(own: Column) -> Column:
            def one(_: Column, k: Column) -> Column:
                total = F.coalesce(F.get(own, k - (window - 1)), F.lit(0))
                for back in range(window - 2, -1, -1):
                    total = (total * _BASE + F.coalesce(F.get(own, k - back), F.lit(0))) % _PRIME
                return total

            return F.transform(own, one)

        return F.struct(x["hashes"].alias("hashes"), x["at"].alias("at"), _let(bits, roll).alias("r"))

    def bounded(x: Column) -> Column:
        n = F.size(x["at"])
        least = lambda k: (F.get(x["r"], k) < F.get(x["r"], k - 1)) & (F.get(x["r"], k) <= F.get(x["r"], k + 1))
        ends = F.filter(_indices(n), lambda k: (k == n - 1) | ((k >= 1) & (k <= n - 3) & least(k)))
        return F.struct(x["hashes"].alias("hashes"), x["at"].alias("at"), ends.alias("ends"))

    def cut(x: Column) -> Column:
        line = lambda k: F.get(x["at"], k)
        unit = lambda whole, a, b, h: F.struct(F.lit(whole).alias("whole"), a.alias("a"), b.alias("b"), h.alias("h"))
        run = lambda a, b: F.xxhash64(F.lit(1), F.slice(x["hashes"], a + 1, b - a + 1))
        chunks = F.transform(x["ends"], lambda end, c: _let(F.struct(line(F.coalesce(F.get(x["ends"], c - 1), F.lit(-1)) + 1).alias("a"), line(end).alias("b")), lambda s: unit(True, s["a"], s["b"], run(s["a"], s["b"]))))
        pairs = F.transform(_indices(F.size(x["at"]) - 1), lambda k: unit(False, line(k), line(k + 1), F.xxhash64(F.lit(2), F.get(x["hashes"], line(k)), F.get(x["hashes"], line(k + 1)), line(k + 1) - line(k))))
        return F.when(F.size(x["at"]) > 1, F.concat(chunks, pairs))

    return _let(_let(_let(_let(F.split(text, "\n", -1), indexed), rolled), bounded), cut)


def removed_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, _t (hash of the text) and _gone, the sorted lines (a, b) that go, of each text that loses some."""
    key = ["doc_id", "_t"]
    slim = docs.select("doc_id", F.xxhash64("text").alias("_t"), "text").where(F.instr("text", "\n") > 0)
    found = slim.select(*key, F.explode(units(F.col("text"), window)).alias("_u")).select(*key, "_u.*")  # numbers only; made twice
    place = F.struct("doc_id", "_t", "a", "b")
    # Checkpointed so that both sides of the join below are exchanged for it, and a hot hash's partition can be split.
    repeated = checkpoint(found.groupBy("h").agg(F.count("*").alias("_times"), F.min(place).alias("_first")).where("_times > 1").select("h", "_first"))
    later = found.join(repeated, "h").where(~place.eqNullSafe(F.col("_first")))
    # A pair inside a repeated chunk adds nothing to it.
    inside = F.max(F.when(F.col("whole"), F.col("b"))).over(Window.partitionBy(*key).orderBy("a", F.desc("whole")))
    later = checkpoint(later.withColumn("_in", inside).where("whole OR _in IS NULL OR _in < b").select("h", *key, "a", "b", "_first"))
    firsts = later.select("h", "_first.*").distinct().withColumn("_is_first", F.lit(True))
    needed = later.select("h", *key, "a", "b", F.lit(False).alias("_is_first")).unionByName(firsts)
    per_doc = needed.groupBy(*key).agg(F.collect_set(F.struct("h", "a", "b", "_is_first")).alias("_needs"))
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x._t") == F.col("y._t"))
    with_text = slim.alias("x").join(per_doc.alias("y"), same).select("x.doc_id", "x._t", "text", "_needs")
    bytes_of = lambda all_, n: F.array_join(F.slice(all_, n["a"] + 1, n["b"] - n["a"] + 1), "\n")
    cut = _let(F.split("text", "\n", -1), lambda all_: F.transform("_needs", lambda n: F.struct(*[n[c].alias(c) for c in ("h", "a", "b", "_is_first")], bytes_of(all_, n).alias("_bytes"))))
    sent = checkpoint(with_text.select("doc_id", "_t", F.explode(cut).alias("_s")).select("doc_id", "_t", "_s.*"))
    first_bytes = sent.where("_is_first").select("h", F.col("_bytes").alias("_same"))  # repeats of a row only repeat matches
    gone = sent.where("NOT _is_first").join(first_bytes, "h").where(F.col("_bytes") == F.col("_same"))
    return gone.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("_gone"))


def line_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` (text replaced by what is left) with n_lines, n_removed_lines and n_removed_runs."""
    names = [c for c in docs.columns if c.lower() not in _NEW]
    # The user's other columns travel in one struct, so no name of theirs meets one of this function's.
    rest = [c for c in names if c.lower() not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", *[F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row")] * bool(rest))
    per_doc = removed_runs(docs, window)
    keyed = docs.withColumn("_t", F.xxhash64("text"))
    marked = keyed.alias("a").join(per_doc.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._t") == F.col("b._t")), "left")
    gone = F.col("b._gone")

    def left_over(lines: Column) -> Column:
        """Lines before, between and after the runs; sorted by their start, runs are sorted by their end too."""
        after = lambda k: F.coalesce(F.get(gone, k - 1)["b"], F.lit(-1)) + 1
        between = F.transform(gone, lambda g, k: F.slice(lines, after(k) + 1, F.greatest(g["a"] - after(k), F.lit(0))))
        last = F.element_at(gone, -1)["b"]
        return F.array_append(between, F.slice(lines, last + 2, F.greatest(F.size(lines) - last - 1, F.lit(0))))

    kept = F.when(gone.isNotNull(), F.flatten(_let(F.split(F.col("a.text"), "\n", -1), left_over)))
    runs = F.size(F.filter(gone, lambda g, k: g["a"] > F.coalesce(F.get(gone, k - 1)["b"], F.lit(-2)) + 1))
    n = F.coalesce(F.length("a.text") - F.length(F.replace(F.col("a.text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    rows = marked.select(*[F.col(f"a.{c}") for c in docs.columns], n.alias("n_lines"), kept.alias("_kept"), F.when(gone.isNotNull(), runs).otherwise(0).cast("long").alias("n_removed_runs"))
    text = F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))
    removed = F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("_kept")).cast("long")
    given = lambda c: text.alias(c) if c.lower() == "text" else F.col("doc_id").alias(c) if c.lower() == "doc_id" else F.col(f"_row.`{c}`").alias(c)
    return rows.select(*[given(c) for c in names], "n_lines", removed.alias("n_removed_lines"), "n_removed_runs")


#: The same rows in DuckDB: a line goes if two neighbouring lines that cover it, and what is between them, stand earlier.
SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, ls, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM split),
paired AS (
  SELECT doc_id, ls, i AS a, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS b
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), pairs AS (
  SELECT doc_id, a, b, row_number() OVER (PARTITION BY array_to_string(ls[a + 1 : b + 1], chr(10)), b - a ORDER BY doc_id, a) > 1 AS again
  FROM paired WHERE b IS NOT NULL
), gone AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS i FROM pairs WHERE again),
marked AS (SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i),
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked),
done AS (
  SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_removed_lines, sum(begins::INT) AS n_removed_runs,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM edged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines,
       coalesce(n_removed_runs, 0)::BIGINT AS n_removed_runs, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""
