"""URL filters: given host and path rules, and rules mined from labelled URLs.

The given list decides where a rule fits; the longest one wins.  Every other URL is judged by
association rules: FP-growth finds the token combinations of labelled URLs that go with a
label, rules of too little support or confidence are pruned, and so are rules that a shorter
rule of at least the same confidence covers.  Of a labelled URL only the ``URL_TOKENS`` tokens
that tell the labels apart best are combined, to rules of at most ``RULE_TOKENS`` tokens, so sites
with long common paths cost no more than others: a combination of n tokens would otherwise
have 2^n parts, all as frequent as itself.  An inverted index holds each rule under its
rarest token, so a URL meets a rule only if it holds that token; the other tokens are then
checked.  A URL's surest rule decides, and without one it is allowed.

All of it is DataFrame work.  The index stays a plain table: Spark broadcasts it only while its
measured size allows, and otherwise joins by token with skewed tokens split.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import bounded_sample
from logweave.session import lookup_join, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Given list: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Labelled URLs that rules are mined from, at most.
SAMPLE_ROWS = 50_000
SUPPORT = 0.005
CONFIDENCE = 0.8
#: Tokens in more than this part of the labelled URLs tell nothing apart and are not combined.
COMMON = 0.9
#: Tokens of a labelled URL that are combined, and tokens of a rule, at most.
URL_TOKENS, RULE_TOKENS = 10, 4


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash sign or the end."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash sign or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule of the list that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, rule).otherwise(found)
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels with words in them, path parts, query words.  Digits count as one sign."""
    clean = lambda text: F.regexp_replace(lower_ascii(text), "[0-9]+", "0")
    marked = lambda mark, text, cut: F.transform(
        F.filter(F.split(clean(text), cut), lambda t: t != ""), lambda t: F.concat(F.lit(mark), t)
    )
    whole = F.coalesce(url, F.lit(""))
    scheme = F.regexp_extract(whole, r"(?s)^(.*?)://", 1)
    rest = F.regexp_extract(whole, r"(?s)^.*?://[^?#]*(.*)$", 1)
    return F.array_distinct(
        F.concat(
            marked("s:", scheme, "[^a-z]+"),
            marked("h:", host, "[.]"),
            marked("w:", F.regexp_extract(host, r"([^.]*-[^.]*)", 1), "-"),
            marked("p:", path, "[/.]"),
            marked("q:", rest, "[?#&=]"),
        )
    )


def mine_rules(
    labelled: DataFrame,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Pruned rules (rule_id, tokens, label, confidence, support, key) from rows of page_id, tokens, label.

    No labelled rows give no rules.
    """
    mark = "label="
    sample = materialize(bounded_sample(labelled.filter("label is not null"), "page_id", sample_rows), "url-sample")
    total = sample.count()
    empty = "tokens array<string>, label string, confidence double, support double, rule_id bigint, key string"
    if not total:
        return labelled.sparkSession.createDataFrame([], empty)
    # Tokens that most URLs hold are left out.
    counts = sample.select("label", F.explode("tokens").alias("key")).groupBy("key", "label").agg(F.count("*").alias("n"))
    shares = sample.groupBy("label").agg((F.count("*") / F.lit(max(1, total))).alias("share"))
    uses = materialize(
        counts.groupBy("key").agg(F.sum("n").alias("uses")).filter(F.col("uses") <= COMMON * total), "url-tokens"
    )
    # How far a token's labelled URLs are from those of a token that says nothing.
    gaps = counts.join(uses, "key").join(F.broadcast(shares), "label")
    clear = materialize(
        gaps.groupBy("key").agg(F.max(F.abs(F.col("n") - F.col("uses") * F.col("share"))).alias("clarity")), "url-clarity"
    )
    own = lookup_join(sample.select("page_id", "label", F.explode("tokens").alias("key")), clear, ["key"], "inner")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("clarity")).alias("order"), "key"))), 1, URL_TOKENS)
    baskets = own.groupBy("page_id").agg(
        F.array_union(F.transform(best, lambda t: t["key"]), F.array(F.concat(F.lit(mark), F.first("label")))).alias("items")
    )
    baskets = materialize(baskets, "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    head = F.col("consequent")[0]
    rules = materialize(
        model.associationRules.filter(head.startswith(mark) & ~F.exists("antecedent", lambda t: t.startswith(mark)))
        .filter(F.size("antecedent") <= RULE_TOKENS)
        .select(
            F.array_sort("antecedent").alias("tokens"),
            F.substring(head, len(mark) + 1, 1 << 20).alias("label"),
            "confidence",
            "support",
            F.xxhash64(F.array_sort("antecedent"), head).alias("rule_id"),
        ),
        "url-rules",
    )
    keyed = (
        rules.withColumn("key", F.explode("tokens"))
        .join(uses, "key")
        .groupBy("rule_id")
        .agg(F.min_by("key", F.struct("uses", "key")).alias("key"))
    )
    rules = materialize(rules.join(keyed, "rule_id"), "url-index")
    # A shorter rule that covers this one is one of its proper parts.
    parts = F.expr(
        "transform(sequence(1, shiftleft(1, size(tokens)) - 2), "
        "mask -> filter(tokens, (t, at) -> (mask & shiftleft(1, at)) <> 0))"
    )
    short = rules.select(F.col("tokens").alias("_part"), F.col("label").alias("_label"), F.col("confidence").alias("_confidence"))
    covered = (
        rules.filter("size(tokens) > 1")
        .select("rule_id", "label", "confidence", F.explode(parts).alias("_part"))
        .join(short, "_part")
        .filter("_label = label and _confidence >= confidence")
        .select("rule_id")
        .distinct()
    )
    return materialize(rules.join(covered, "rule_id", "left_anti"), "url-pruned").select(
        "tokens", "label", "confidence", "support", "rule_id", "key"
    )


def judge_urls(
    pages: DataFrame,
    mined: DataFrame,
    rules: list[tuple[str, str, str]] | None = None,
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    A null url, or one without ``://``, has an empty host and path and gets the default verdict
    unless a mined rule fits.  Repeated rows and null page_ids stay; other columns are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).select(
        "page_id",
        "host",
        "path",
        listed_rule(F.col("host"), F.col("path"), RULES if rules is None else rules).alias("listed"),
        tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"),
    )
    index = mined.select("key", F.col("tokens").alias("needs"), "label", "confidence", "support", "rule_id")
    undecided = F.when(F.col("listed").isNull(), F.col("tokens"))
    holds = F.size(F.array_except("needs", "tokens")) == 0
    hit = F.when(holds, F.struct("confidence", "support", "rule_id", "label"))
    return (
        rows.withColumn("row", F.monotonically_increasing_id())
        .withColumn("key", F.explode_outer(undecided))
        .join(index, "key", "left")
        .groupBy("row")
        .agg(
            F.first("page_id").alias("page_id"),
            F.first("host").alias("host"),
            F.first("path").alias("path"),
            F.first("listed").alias("listed"),
            F.max(hit).alias("hit"),
        )
        .select(
            "page_id",
            "host",
            "path",
            F.col("listed.rule").alias("rule"),
            F.coalesce("listed.verdict", "hit.label", F.lit(default)).alias("verdict"),
        )
    )


def document_number(path: Column) -> Column:
    """The number that a path ends with; null if it ends otherwise."""
    return F.nullif(F.regexp_extract(path, "/([0-9]+)/?$", 1), F.lit("")).try_cast("bigint")


def labelled_urls(pages: DataFrame, labels: DataFrame, document: Column | None = None) -> DataFrame:
    """Tokens of the pages whose documents have labels: ``block`` for low quality or toxic text, else ``allow``.

    ``document`` gives the document that a page carries; by default it is the number at the end of
    its path.  A page without such a document is left out; of several labels the worst counts.
    """
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    carried = document_number(path) if document is None else document
    return pages.select("page_id", "url", carried.cast("long").alias("doc_id")).join(known, "doc_id").select(
        "page_id",
        tokens_of(F.col("url"), host, path).alias("tokens"),
        F.when(bad, "block").otherwise("allow").alias("label"),
    )
