"""URL filters: fixed host and path rules, and association rules mined from labels.

Spark's FP-growth mines combinations of URL tokens (scheme, host labels, path
segments, extension, query keys, fragment) that go with a bad label. A rule
``tokens -> block`` stays if its support and confidence reach the thresholds and
no rule with some of its tokens is as confident; rules may have any number of
tokens. Tokens that always stand together on the labelled pages are one item: a
rule with two of them says no more than with one, so it could not stay, and any
of them may stand for the others. FP-growth still lists every frequent set of
items, 2^n for n items that often, but not always, stand together. Matching goes through an inverted
index: each rule is listed under its rarest token, each distinct set of tokens is
looked up by its tokens, and candidates are checked for all of theirs. Distinct
token sets are formed first, with partial aggregation, so a host that a third of
all pages share is looked up once.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits
no fixed rule and has no tokens; without labelled pages of either kind nothing
is mined and pages that no fixed rule fits are allowed; repeated pages are judged
alike; a page with several labels is bad if one of them is; an empty table gives no
row; a null page_id is judged and never labelled; very long URLs are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.frames import checkpoint

#: The rules of the production query, (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SUPPORT = 0.002
CONFIDENCE = 0.5
LEAST_PAGES = 5
BLOCK, ALLOW = "@block", "@allow"
#: Tasks that the rows of one token are dealt to where tokens meet their classes; a scheme stands in every URL.
SALTS = 32
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct, sorted tokens of a URL; numbers are one token."""
    tagged = lambda parts, tag: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), F.when(x.rlike(r"^\d+$"), F.lit("#")).otherwise(x)))
    path = path_of(url)
    last = F.regexp_extract(path, r"\.([A-Za-z][A-Za-z0-9]{0,5})$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.concat(
        tagged(F.array(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))), "s:"),
        tagged(F.split(host_of(url), r"\."), "h:"),
        tagged(F.split(F.regexp_replace(path, r"\.[A-Za-z][A-Za-z0-9]{0,5}$", ""), "/"), "p:"),
        tagged(F.array(last), "x:"),
        tagged(F.transform(F.split(query, "&"), lambda p: F.split(p, "=")[0]), "q:"),
        tagged(F.array(F.regexp_extract(url, r"#(.*)$", 1)), "f:"),
    )
    return F.array_sort(F.array_distinct(F.coalesce(F.when(F.contains(url, F.lit("://")), parts), F.array().cast("array<string>"))))


def _with_salts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def token_classes(baskets: DataFrame, least: float) -> DataFrame:
    """(token, rep) of tokens that stand in at least ``least`` baskets (rows with page_id and _tokens); tokens of one class stand in the same baskets.

    A sum of row hashes selects candidates, a count of the baskets that hold token and representative decides.
    """
    each = baskets.select("page_id", "_tokens", F.explode("_tokens").alias("token"))
    row = F.xxhash64("page_id", "_tokens").cast("decimal(38,0)")
    sums = checkpoint(each.groupBy("token").agg(F.count("*").alias("_n"), F.sum(row).alias("_sum")).where(F.col("_n") >= least))
    likely = sums.join(sums.groupBy("_n", "_sum").agg(F.min("token").alias("rep")), ["_n", "_sum"]).select("token", "rep", "_n")
    dealt = each.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    both = dealt.join(_with_salts(likely.where("token <> rep")), ["token", "_salt"]).where(F.array_contains("_tokens", F.col("rep"))).groupBy("token", "rep", "_n").agg(F.count("*").alias("_both"))
    same = both.where("_both = _n").select("token", "rep")
    return checkpoint(sums.select("token").join(same, "token", "left").select("token", F.coalesce("rep", "token").alias("rep")))


def _represented(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct ``_tokens`` of ``sets`` with ``_reps``, the representatives of those that have a class; sets without one are left out."""
    salt = F.pmod(F.xxhash64("_tokens"), F.lit(SALTS)).cast("int").alias("_salt")
    each = sets.select("_tokens").distinct().select("_tokens", salt, F.explode("_tokens").alias("token"))
    return each.join(_with_salts(classes), ["token", "_salt"]).groupBy("_tokens").agg(F.collect_set("rep").alias("_reps"))


def mine_class_rules(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least_pages: int = LEAST_PAGES, most_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, classes): rules as (tokens, confidence, support, anchor) over the representatives of ``token_classes``."""
    from pyspark.ml.fpm import FPGrowth

    spark = pages.sparkSession
    judged = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    baskets = pages.select("page_id", tokens_of(F.col("url")).alias("_tokens")).join(judged, "page_id")
    seen = baskets.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad")).first()
    if not seen["n"] or not seen["bad"]:
        return spark.createDataFrame([], "tokens array<string>, confidence double, support double, anchor string"), spark.createDataFrame([], "token string, rep string")
    least = min(1.0, max(support, least_pages / seen["n"]))
    classes = token_classes(baskets, least * seen["n"] - 1e-6)
    label = F.when(F.col("bad"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    items = baskets.join(checkpoint(_represented(baskets, classes)), "_tokens", "left").select(F.array_append(F.coalesce("_reps", F.array().cast("array<string>")), label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(items)
    mined = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK))
    if most_tokens is not None:
        mined = mined.where(F.size("antecedent") <= most_tokens)
    mined = mined.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    # A rule goes if one of its proper subsets is a rule that is at least as confident.
    shorter = mined.select(F.col("tokens").alias("_t"), F.col("confidence").alias("_c"))
    picks = F.explode(F.expr("sequence(1L, shiftleft(1L, size(tokens)) - 2)"))  # bit i: token i is in the subset
    subsets = mined.where(F.size("tokens") > 1).select("tokens", "confidence", picks.alias("_bits"))
    subsets = subsets.select("tokens", "confidence", F.expr("filter(tokens, (x, i) -> getbit(_bits, i) = 1)").alias("_t"))
    beaten = subsets.join(shorter, "_t").where(F.col("_c") >= F.col("confidence")).select("tokens").distinct()
    freq = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("anchor"), F.col("freq").alias("_freq"))
    rules = mined.join(beaten, "tokens", "left_anti")
    anchors = rules.select("tokens", F.explode("tokens").alias("anchor")).join(freq, "anchor").groupBy("tokens").agg(F.min(F.struct("_freq", "anchor")).alias("_a"))
    return rules.join(anchors, "tokens").select("tokens", "confidence", "support", F.col("_a.anchor").alias("anchor")), classes


def mine_rules(pages: DataFrame, labels: DataFrame, **mining: float | None) -> DataFrame:
    """Rules as (tokens, confidence, support, anchor); ``labels`` has page_id and bad (boolean); ``most_tokens`` may bound a rule's length (None: no bound).

    Every token of a class takes its representative's place, so this lists all rules; ``filter_urls`` matches those of the classes.
    """
    rules, classes = mine_class_rules(pages, labels, **mining)
    members = classes.groupBy("rep").agg(F.array_sort(F.collect_set("token")).alias("_members"))
    each = rules.withColumn("rep", F.explode("tokens")).join(members, "rep")
    choice = each.groupBy("tokens", "confidence", "support", "anchor").agg(F.collect_list("_members").alias("_of"))
    start = F.array(F.array().cast("array<string>"))
    taken = F.aggregate("_of", start, lambda done, of: F.flatten(F.transform(done, lambda d: F.transform(of, lambda m: F.array_append(d, m)))))
    return choice.select(F.explode(taken).alias("_taken"), "confidence", "support", "anchor").join(members, F.col("anchor") == members["rep"]).select(
        F.array_sort("_taken").alias("tokens"), "confidence", "support", F.array_intersect("_taken", "_members")[0].alias("anchor")
    )


def match_rules(pages: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct token sets (``_tokens``) that some mined rule fits, with the most confident one's confidence.

    A rule of classes fits if each of its classes has a token in the set.
    """
    sets = _represented(pages.select(tokens_of(F.col("url")).alias("_tokens")), classes)
    candidates = sets.select("_tokens", "_reps", F.explode("_reps").alias("anchor")).join(rules, "anchor")
    fit = candidates.where(F.size(F.array_except("tokens", "_reps")) == 0)
    return fit.groupBy("_tokens").agg(F.max("confidence").alias("_confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, **mining: float | None) -> DataFrame:
    """The columns of ``pages`` with host, path, rule, mined_confidence and verdict (columns of these names are replaced)."""
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "mined_confidence", "verdict")]
    # Checkpointed so that the join below exchanges both sides, and a token set of very many pages can be split.
    mined = checkpoint(match_rules(pages, *mine_class_rules(pages, labels, **mining)))
    url = F.col("url")
    # The user's columns travel in one struct, so no name of theirs meets one of this function's.
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("_tokens"))
    judged = rows.join(mined, "_tokens", "left").withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], "host", "path", F.col("_rule.rule").alias("rule"), F.col("_confidence").alias("mined_confidence"), F.coalesce("_rule.verdict", method).alias("verdict"))
