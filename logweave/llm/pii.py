"""Personal data in texts: fixed patterns, and identifiers that their contexts give away.

Four kinds are found by pattern: e-mail and IP addresses, card and phone numbers.  What was found
seeds the search for more.  Phrases of words with digits or an at sign are instances; the words
around them are lexical patterns.  A pattern that enough different seeds of a kind stand in is
induced, and patterns and instances make a graph:  a pattern is as sure as the share of its
instances that are of the kind, and an instance without a seed is as sure as its patterns make it
together (noisy or).  Both are scored in turn; a pattern that is sure enough passes its kind on to
its unseen instances, which in the next round make other patterns surer.  An instance that ends up
sure, and that could be of the kind by its form, is marked wherever it stands.

All of it is DataFrame and SQL work.  Patterns are possessive and start at the beginning of a run
of their signs, so time is linear in a text's length, also for long runs that do not match.
Positions are sums over the gaps between matches.  Edges of the graph are counted before they are
shuffled, and patterns that can never become sure are dropped before the first round, among them
all that stand beside instances of every sort; scores travel by size-checked joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.session import lookup_join, materialize

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
PHRASE = 4

BLANK = r"\x20\x09-\x0D"
#: A word with a digit or an at sign.
_MARKED = rf"[^{BLANK}0-9@]*+[0-9@][^{BLANK}]*+"
PATTERNS = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9]++(?:[\x20-][0-9]++)*+",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
    PHRASE: rf"(?<![^{BLANK}]){_MARKED}(?:\x20{_MARKED})*+",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: Forms that an unseen identifier of a kind may have.
FORMS = {
    EMAIL: r"^[^\s@]++@[^\s@]++$",
    IP: r"^(?:[0-9]{1,3}(?:[.,-][0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?:/[0-9]{1,3})?$",
    CARD: r"^(?:[0-9][\x20./-]?){12,19}$",
    PHONE: r"^[+(]{0,2}(?:[0-9][\x20()./-]{0,3}){7,15}$",
}

#: Characters of context on either side that words are taken from.
CONTEXT = 40
#: Different seeds that induce a pattern, how sure a pattern and an instance must be, and rounds.
SEEDS, SURE, ACCEPTED, ROUNDS = 4, 0.8, 0.8, 3


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    back = F.reverse(number)

    def value(place: Column) -> Column:
        digit = F.substring(back, place, F.lit(1))
        doubled = F.translate(digit, "0123456789", "0246813579")
        return F.when(place % 2 == 0, doubled).otherwise(digit).cast("int")

    places = F.sequence(F.lit(1), F.length(number))
    return F.aggregate(places, F.lit(0), lambda total, place: total + value(place)) % 10 == 0


def valid(kind: int, text: Column) -> Column:
    """Whether a match of a kind's pattern is one."""
    number = digits(text)
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return text.rlike(IP_PARTS)
    if kind == CARD:
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)
    return F.length(number).between(8, 15)


def _matches(text: Column, kind: int) -> Column:
    """Matches in order, each with the length of the gap before it and the words at the gap's ends.

    A last entry without text holds the gap after the last match.
    """
    entry = lambda gap, found: F.struct(
        F.lit(kind).alias("kind"),
        F.length(gap).alias("gap"),
        found.alias("text"),
        (F.right(gap, F.lit(CONTEXT)) if kind == PHRASE else F.lit(None).cast("string")).alias("before"),
        (F.left(gap, F.lit(CONTEXT)) if kind == PHRASE else F.lit(None).cast("string")).alias("behind"),
    )
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.split(text, pattern, -1), found, entry)


def matches(documents: DataFrame) -> DataFrame:
    """row, doc_id and all matches of all patterns per row, written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    text = F.col("text")
    mail, digit = F.contains(text, F.lit("@")), text.rlike("[0-9]")
    none = F.array().cast("array<struct<kind:int,gap:int,text:string,before:string,behind:string>>")
    needed = {EMAIL: mail, IP: digit & F.contains(text, F.lit(".")), CARD: digit, PHONE: digit & F.contains(text, F.lit("+"))}
    parts = [F.when(needed.get(kind, mail | digit), _matches(text, kind)).otherwise(none) for kind in PATTERNS]
    return materialize(rows.select("row", "doc_id", F.concat(*parts).alias("found")), "pii-matches")


def placed(found: DataFrame) -> DataFrame:
    """One row per match: row, kind, start, end (code points, end exclusive), text, before, behind, valid."""
    each = found.select("row", F.posexplode("found").alias("n", "match")).select("row", "n", "match.*")
    order = W.partitionBy("row", "kind").orderBy("n")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    size = F.length("text")
    start = F.sum("gap").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum(size).over(earlier), F.lit(0))
    rows = each.select(
        "row",
        "kind",
        start.alias("start"),
        (start + size).alias("end"),
        "text",
        "before",
        F.lead("behind").over(order).alias("behind"),
    ).filter("text is not null")
    text, kind = F.col("text"), F.col("kind")
    right = F.lit(False)
    for known in range(len(KINDS)):
        right = F.when(kind == known, valid(known, text)).otherwise(right)
    return materialize(rows.withColumn("valid", right), "pii-places")


def phrases(places: DataFrame) -> DataFrame:
    """Instances: row, start, end and core of each phrase, without the signs at its ends, and the words around it."""
    inner = places.filter(F.col("kind") == PHRASE)
    bare = F.regexp_replace("text", r"^[^A-Za-z0-9+(:]++", "")
    lead = F.length("text") - F.length(bare)
    core = F.regexp_extract(bare, r"(?s)^(.*[A-Za-z0-9])", 1)
    words = lambda text: F.filter(F.split(F.lower(text), rf"[{BLANK}]+"), lambda w: w != "")
    return (
        inner.select(
            "row",
            (F.col("start") + lead).alias("start"),
            core.alias("core"),
            words(F.col("before")).alias("left"),
            words(F.col("behind")).alias("right"),
        )
        .filter("core <> ''")
        .withColumn("end", F.col("start") + F.length("core"))
    )


def seed_kind(core: Column) -> Column:
    """The first kind that a phrase holds a valid match of; null for none."""
    found = F.lit(None).cast("int")
    for kind in reversed(range(len(KINDS))):
        holds = F.exists(F.regexp_extract_all(core, F.lit(PATTERNS[kind]), F.lit(0)), lambda t: valid(kind, t))
        found = F.when(holds, F.lit(kind)).otherwise(found)
    return found


def possible_kinds(core: Column) -> Column:
    """Kinds that an instance without a seed could be of, by its form."""
    return F.filter(F.array(*[F.when(core.rlike(form), F.lit(kind)) for kind, form in FORMS.items()]), F.isnotnull)


def lexical_patterns(left: Column, right: Column) -> Column:
    """The word before, the two words before, and the words on both sides; no word is the text's end."""
    word = lambda words, place: F.coalesce(F.try_element_at(words, F.lit(place)), F.lit(""))
    return F.array(
        F.concat(word(left, -1), F.lit(" _")),
        F.concat(word(left, -2), F.lit(" "), word(left, -1), F.lit(" _")),
        F.concat(word(left, -1), F.lit(" _ "), word(right, 1)),
    )


def graph(instances: DataFrame, seeds: int, sure: float) -> tuple[DataFrame, DataFrame]:
    """Induced patterns (pattern, kind, n, seeds) and edges (pattern, kind, core) to instances without a seed.

    ``n`` counts a pattern's different instances, ``seeds`` those of the kind.  Patterns that could
    not be sure even if all unseen instances that may be of the kind were, are left out.
    """
    edges = instances.select("core", F.explode(lexical_patterns(F.col("left"), F.col("right"))).alias("pattern")).distinct()
    edges = materialize(
        edges.select(
            "pattern", "core", seed_kind(F.col("core")).alias("seed"), possible_kinds(F.col("core")).alias("may")
        ),
        "pii-edges",
    )
    unseen = F.col("seed").isNull()
    counts = edges.groupBy("pattern").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("seed") == kind).alias(f"s{kind}") for kind in range(len(KINDS))],
        *[F.count_if(unseen & F.array_contains("may", kind)).alias(f"m{kind}") for kind in range(len(KINDS))],
    )
    per_kind = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"s{k}").alias("seeds"), F.col(f"m{k}").alias("may")) for k in range(len(KINDS))
    ])
    induced = counts.select("pattern", "n", F.explode(per_kind).alias("of")).select("pattern", "n", "of.*")
    induced = materialize(
        induced.filter((F.col("seeds") >= seeds) & (F.col("may") > 0) & ((F.col("seeds") + F.col("may")) / (F.col("n") + 1) >= sure)),
        "pii-induced",
    ).drop("may")
    open_edges = edges.filter(unseen & (F.size("may") > 0)).select("pattern", "core", F.explode("may").alias("kind"))
    kept = lookup_join(open_edges, induced.select("pattern", "kind"), ["pattern", "kind"], "left_semi")
    return induced, materialize(kept, "pii-unseen")


def score_graph(induced: DataFrame, edges: DataFrame, sure: float, rounds: int) -> DataFrame:
    """core, kind and score of instances without a seed that sure patterns hold."""
    gained = F.lit(0.0)
    for turn in range(rounds):
        patterns = induced.withColumn("score", (F.col("seeds") + gained) / (F.col("n") + 1))
        sure_ones = patterns.filter(F.col("score") >= sure).select("pattern", "kind", "score")
        held = lookup_join(edges, sure_ones, ["pattern", "kind"], "inner")
        scores = materialize(
            held.groupBy("core", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("score")), "pii-scores"
        )
        if turn + 1 < rounds:
            passed = lookup_join(edges, scores, ["core", "kind"], "inner")
            sums = passed.groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
            induced = materialize(induced.drop("gained").join(sums, ["pattern", "kind"], "left"), "pii-patterns")
            gained = F.coalesce("gained", F.lit(0.0))
    return scores


def added_spans(places: DataFrame, instances: DataFrame, accepted: DataFrame) -> DataFrame:
    """row, kind, start, end of accepted instances that no base span touches."""
    found = lookup_join(instances.select("row", "start", "end", "core"), accepted, ["core"], "inner")
    found = materialize(found.select("row", "kind", "start", "end", F.lit(True).alias("added")), "pii-added")
    near = lookup_join(places.filter("valid"), found.select("row").distinct(), ["row"], "left_semi")
    both = found.unionByName(near.select("row", "kind", "start", "end", F.lit(False).alias("added")))
    order = W.partitionBy("row").orderBy("start", "end", "kind", "added")
    base_end, base_start = F.when(~F.col("added"), F.col("end")), F.when(~F.col("added"), F.col("start"))
    earlier = F.max(base_end).over(order.rowsBetween(W.unboundedPreceding, -1))
    later = F.min(base_start).over(order.rowsBetween(1, W.unboundedFollowing))
    apart = both.withColumn("earlier", earlier).withColumn("later", later)
    free = (F.coalesce("earlier", F.col("start")) <= F.col("start")) & (F.coalesce("later", F.col("end")) >= F.col("end"))
    return apart.filter(F.col("added") & free).select("row", "kind", "start", "end")


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by kind, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    shown = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(shown, ",")


def find(
    documents: DataFrame,
    seeds: int = SEEDS,
    sure: float = SURE,
    accepted: float = ACCEPTED,
    rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row.

    The counts and ``base_sha256`` are of the spans that the fixed patterns find; ``spans`` lists
    these and the ones that contexts gave.  Starts and ends are code points from 0, ends exclusive.
    A null text is empty.  Repeated rows and null doc_ids stay, each row with its own spans; in the
    graph a repeated instance counts once per pattern, so copies add no evidence.  Texts are read
    whole, other columns are not read, and an empty table gives no rows.  Of an instance's kinds the
    surest counts, at a tie the first.
    """
    found = matches(documents)
    places = placed(found.filter(F.size("found") > 0))
    instances = materialize(phrases(places), "pii-phrases")
    induced, edges = graph(instances, seeds, sure)
    scores = score_graph(induced, edges, sure, rounds).filter(F.col("score") >= accepted)
    best = scores.groupBy("core").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    added = added_spans(places, instances, best)
    spans = places.filter("valid").select("row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(
        added.withColumn("base", F.lit(False))
    )
    span = F.struct("kind", "start", "end")
    of_row = spans.groupBy("row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == kind)).alias(f"n_{name}") for kind, name in enumerate(KINDS)],
        _listed(F.collect_list(F.when(F.col("base"), span))).alias("own"),
        _listed(F.collect_list(span)).alias("spans"),
    )
    whole = found.select("row", "doc_id").join(of_row, "row", "left")
    return whole.select(
        "doc_id",
        *[F.coalesce(f"n_{name}", F.lit(0).cast("long")).alias(f"n_{name}") for name in KINDS],
        F.sha2(F.coalesce("own", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
