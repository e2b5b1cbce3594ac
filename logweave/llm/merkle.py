"""Merkle manifest of a dataset: a tree per source, a tree over the sources, a proof per row.

Every row is a leaf.  The leaves of a source ascend by doc_id, and runs of ``ARITY`` nodes become
their parent until one node, the source's subroot, is left; the subroots ascend by source and
become the root in the same way.

A level is one self-join.  Each node offers its digest to its siblings: the run's places other
than its own are computed from its index (the lowest bit flipped in a binary tree, slots shifted
round the run otherwise), and nodes and offers meet by an equi-join on the index.  A node then
holds what lies left and right of it in its run; the nodes in slot zero emit the parents.  Offers
are combined before they are shuffled, so a level moves one row per node, and no key has more
rows than a run, however many rows a source has.

Proofs go the other way: a node's path is its own siblings before its parent's path, so each
parent's row meets at most ``ARITY`` children and the top of the tree is never a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.session import lookup_join, materialize

ARITY = 16
#: Columns that a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of sorted leaves per task.
TASK_ROWS = 1 << 18
#: One row in so many (by crc32 of its id) is tampered with in the audit.
TAMPERED = 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<left:binary,right:binary>"


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows of values read the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row; ``changed`` gives other values for some of its columns."""
    parts = [field(changed.get(name, F.col(f"`{name}`"))) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(*parts: Column) -> Column:
    """Digest of digests, which go in as lower-case hex text."""
    return F.unhex(F.sha2(as_text(F.concat(*parts)), 256))


def source_key(source: Column) -> Column:
    """Sorts like the source, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def number_rows(df: DataFrame, group: str, order: list[str], rows: int, label: str) -> DataFrame:
    """Add ``idx`` (0, 1, 2 ... per ``group`` in ``order``) and ``size``, the group's rows.

    Rows are sorted by ranges, so a group of any size is spread over as many tasks as it needs;
    a row's number is its place in its range plus the group's rows in earlier ranges.  ``order``
    must tell all rows apart.  Only one row per group and range is summed up.
    """
    parts = max(1, -(-rows // TASK_ROWS))
    placed = materialize(
        df.repartitionByRange(parts, group, *order)
        .sortWithinPartitions(group, *order)
        .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_place")),
        label,
    )
    spans = placed.groupBy(group, "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = spans.select(
        group,
        "_range",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(W.partitionBy(group)).alias("size"),
    )
    numbered = lookup_join(placed, shifts, [group, "_range"], "inner")
    return numbered.withColumn("idx", F.col("_place") + F.col("_shift")).drop("_range", "_place", "_shift")


def sibling_indices(idx: Column, size: Column, arity: int) -> Column:
    """Indices of the other nodes of a node's run."""
    if arity == 2:
        return F.filter(F.array(idx.bitwiseXOR(1)), lambda i: i < size)
    slot = F.pmod(idx, F.lit(arity))
    shifted = F.transform(
        F.sequence(F.lit(1), F.lit(arity - 1)), lambda shift: idx - slot + F.pmod(slot + shift, F.lit(arity))
    )
    return F.filter(shifted, lambda i: i < size)


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with ``left`` and ``right``: the digests before and after each in its run."""
    offers = nodes.select(
        "tree",
        F.explode(sibling_indices(F.col("idx"), F.col("size"), arity)).alias("idx"),
        F.struct(F.pmod("idx", F.lit(arity)).cast("int").alias("slot"), "digest").alias("offer"),
    )
    gathered = offers.groupBy("tree", "idx").agg(F.array_sort(F.collect_list("offer")).alias("run"))
    slot = F.pmod(F.col("idx"), F.lit(arity))
    run = F.coalesce("run", F.array().cast("array<struct<slot:int,digest:binary>>"))
    nothing = F.lit(b"")

    def joined(place) -> Column:
        return F.aggregate(F.filter(run, place), nothing, lambda made, offer: F.concat(made, offer["digest"]))

    return nodes.join(gathered, ["tree", "idx"], "left").select(
        *nodes.columns,
        joined(lambda offer: offer["slot"] < slot).alias("left"),
        joined(lambda offer: offer["slot"] > slot).alias("right"),
    )


def build_levels(leaves: DataFrame, largest: int, arity: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees at once, and one row (tree, digest, level) per top.

    ``leaves`` has tree, idx, size, digest; other columns stay with the lowest level.  ``largest``
    is the size of the largest tree.  Level ``n`` holds the nodes that have a parent.
    """
    levels, tops, nodes, level = [], [], leaves, 0
    while True:
        alone = nodes.filter("size = 1").select("tree", "digest", F.lit(level).alias("level"))
        tops.append(alone)
        if largest <= 1:
            break
        siblings = materialize(with_siblings(nodes.filter("size > 1"), arity), f"{label}-level")
        levels.append(siblings)
        nodes = siblings.filter(F.pmod("idx", F.lit(arity)) == 0).select(
            "tree",
            F.expr(f"idx div {arity}").alias("idx"),
            F.expr(f"(size + {arity - 1}) div {arity}").alias("size"),
            digest_of(F.col("digest"), F.col("left"), F.col("right")).alias("digest"),
        )
        largest = -(-largest // arity)
        level += 1
    whole = tops[0]
    for part in tops[1:]:
        whole = whole.unionByName(part)
    return levels, materialize(whole, f"{label}-tops")


def with_paths(levels: list[DataFrame], tops: DataFrame, leaves: DataFrame, arity: int) -> DataFrame:
    """The leaves with ``path``: what to hash with, level by level.

    ``tops`` has tree, level and the path above each tree's top.
    """

    def above(level: int) -> DataFrame:
        return tops.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), "path")

    known = above(len(levels))
    for level in range(len(levels) - 1, -1, -1):
        parents = known.select("tree", F.col("idx").alias("_parent"), F.col("path").alias("_above"))
        own = F.array(F.struct("left", "right"))
        joined = (
            levels[level]
            .withColumn("_parent", F.expr(f"idx div {arity}"))
            .join(parents, ["tree", "_parent"])
            .withColumn("path", F.concat(own, F.col("_above")))
        )
        if level:
            known = joined.select("tree", "idx", "path").unionByName(above(level))
        else:
            single = leaves.filter("size = 1").join(above(0), ["tree", "idx"])
            return joined.select(*leaves.columns, "path").unionByName(single.select(*leaves.columns, "path"))
    return leaves.join(known, ["tree", "idx"]).select(*leaves.columns, "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda made, step: digest_of(step["left"], made, step["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up, left to right."""
    whole = F.aggregate(path, F.lit(""), lambda made, step: F.concat(made, as_text(step["left"]), as_text(step["right"])))
    return F.sha2(whole, 256)


def tampered_text() -> tuple[Column, Column]:
    """Which rows the audit tampers with, and the text that they get."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return F.coalesce(chosen, F.lit(False)), F.translate("text", UPPER, LOWER)


def manifest(documents: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``folded_root`` is what the proof gives for the row's leaf after tampering: rows whose id's
    crc32 is divisible by five have the letters A-Z of their text lower-cased.  Of rows with equal
    doc_id in a source the smaller leaf comes first, and equal rows are leaves each on its own; a
    null doc_id comes first and is not tampered with.  A null value is its own mark in a leaf, so
    it differs from an empty text.  A null source is a source of its own, before all others.  Texts
    are read whole, other columns are not read, and an empty table gives no rows.
    """
    changed, text = tampered_text()
    leaves = materialize(
        documents.select(*[F.col(f"`{name}`") for name in FIELDS]).select(
            "doc_id",
            source_key(F.col("source")).alias("source"),
            leaf_digest().alias("digest"),
            F.when(changed, leaf_digest(text=text)).alias("forged"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "merkle-leaves",
    )
    rows = leaves.count()
    numbered = number_rows(leaves, "source", ["doc_id", "digest", "row"], rows, "merkle-sorted")
    sources = numbered.filter("idx = 0").select("source", "size")
    bounds = sources.agg(F.count("*"), F.max("size")).first()
    trees = materialize(
        number_rows(sources.withColumn("all", F.lit(0)).withColumnRenamed("size", "leaves"), "all", ["source"], bounds[0], "merkle-sources")
        .select("source", F.col("idx").alias("tree"), F.col("size").alias("sources")),
        "merkle-trees",
    )
    nodes = materialize(
        lookup_join(numbered, trees.select("source", "tree"), ["source"], "inner").drop("source", "row"), "merkle-nodes"
    )
    levels, tops = build_levels(nodes, bounds[1] or 1, arity, "merkle")
    # The sources' tree: its leaves are the subroots, in one tree.
    subroots = tops.join(trees, "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("sources").alias("size"), "digest", "level"
    )
    upper, roots = build_levels(subroots, bounds[0] or 1, arity, "merkle-upper")
    ends = roots.select("tree", "level", F.array().cast(f"array<{_STEP}>").alias("path"))
    ends = ends.join(roots.select("tree", F.col("digest").alias("root")), "tree")
    rooted = materialize(
        lookup_join(with_paths(upper, ends, subroots, arity), ends.select("tree", "root"), ["tree"], "inner").select(
            F.col("idx").alias("tree"), "level", "path", F.col("digest").alias("subroot"), "root"
        ),
        "merkle-subroots",
    )
    found = with_paths(levels, rooted.select("tree", "level", "path"), nodes, arity)
    found = lookup_join(found, rooted.select("tree", "subroot", "root"), ["tree"], "inner")
    folded = fold(F.coalesce("forged", "digest"), F.col("path"))
    return found.select(
        F.col("doc_id"),
        as_text(F.col("digest")).alias("leaf"),
        as_text(F.col("subroot")).alias("subroot"),
        as_text(F.col("root")).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        as_text(folded).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
