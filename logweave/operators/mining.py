"""Template mining over ordered lines, exact and in parallel.

A line joins the most similar template of its length, or starts a new one, and the
template then loses the tokens on which the two differ.  What happens to a line depends on
the templates the earlier lines left behind, so a log is a chain.  It is cut into blocks
of bounded size, and a block into units, one per number of tokens: lines of different lengths
never meet.  All units run at once from a guessed start state; what a unit leaves behind
corrects the guess of later ones, and only units whose start state changed run again.  When none
changes any more, each unit has run from exactly the state its predecessors leave behind, which
is the result of one pass in order.  The first unit of a length always starts right, so every
round settles at least one more; templates stabilise early in a log, so few rounds are needed in
practice.

State travels by leaf, which is a path of leading tokens with its templates.  A unit asks only for
the paths that its own lines can take, literal or wildcard, so a template reaches just the units
whose lines could meet it, not every later block.  Each asked path has a signature of what the
unit starts with there; after a round only the paths that some unit changed are looked at again.
How many branches a node has is part of the state only where the limit of branches can act.

A unit sees each distinct masked text once, with the numbers of the lines that carry it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.formats import MAX_CHILDREN, WILDCARD
from logweave.functions import text as T
from logweave.operators.templates import number_events
from logweave.session import lookup_join, materialize

# Lines per block: bounds what one task holds, also where one log has most of the lines.
BLOCK_LINES = 1 << 18

_OUTPUT = (
    "log_id string, block bigint, n_tokens int, kind string, template string, path array<string>, made boolean, "
    "cluster bigint, first_line bigint, last_line bigint, lines bigint"
)
_UNIT = ["log_id", "block", "n_tokens"]
_NODE = ["log_id", "n_tokens", "path"]
#: What a unit starts with: clusters of a leaf, nodes that exist, numbers of branches.
_START = "log_id string, block bigint, n_tokens int, path array<string>, kind string, cluster bigint, template string"


class _Leaf:
    """Templates that share their leading tokens, as rows of token codes; 0 is the wildcard."""

    def __init__(self, width: int):
        self.rows = np.empty((4, width), dtype=np.int64)
        self.ids: list[int] = []
        self.version = 0

    def add(self, cluster: int, row: np.ndarray | list[int]) -> None:
        if len(self.ids) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[len(self.ids)] = row
        self.ids.append(cluster)
        self.version += 1

    def closest(self, rows: np.ndarray, st: float) -> tuple[np.ndarray, np.ndarray]:
        """For each row its best template, -1 below ``st``, and whether that one covers it.

        Best means most equal literals, then most wildcards, then oldest.
        """
        if not self.ids:
            return np.full(len(rows), -1), np.zeros(len(rows), dtype=bool)
        known, width = self.rows[: len(self.ids)], rows.shape[1]
        wild = known == 0
        hits = np.zeros((len(rows), len(known)), dtype=np.int64)
        for place in range(width):
            hits += (rows[:, place, None] == known[None, :, place]) & ~wild[None, :, place]
        gaps = wild.sum(axis=1)
        best = np.argmax(hits * (width + 1) + gaps, axis=1)
        best_hits = hits[np.arange(len(rows)), best]
        return np.where(best_hits / width >= st, best, -1), best_hits + gaps[best] == width


class _Forest:
    """All templates of one token count, reached through their leading tokens."""

    def __init__(self, width: int, key_tokens: int):
        self.width, self.key_tokens = width, key_tokens
        self.children: dict[tuple[str, ...], set[str]] = {}
        self.leaves: dict[tuple[str, ...], _Leaf] = {}
        #: Branches of a node that are not listed because no line of the unit can take them.
        self.unlisted: dict[tuple[str, ...], int] = {}
        #: Nodes made by this unit's lines.
        self.made: list[tuple[str, ...]] = []
        self.version = 0

    def know(self, path: tuple[str, ...]) -> None:
        """Enter a node that earlier lines made."""
        if path:
            self.children.setdefault(path[:-1], set()).add(path[-1])
        if len(path) == self.key_tokens and path not in self.leaves:
            self.leaves[path] = _Leaf(self.width)

    def find(self, words: list[str]) -> _Leaf | None:
        path: tuple[str, ...] = ()
        for word in words[: self.key_tokens]:
            known = self.children.get(path, ())
            if word not in known:
                word = WILDCARD
                if word not in known:
                    return None
            path += (word,)
        return self.leaves.get(path)

    def path_for(self, words: list[str]) -> tuple[str, ...]:
        """Where a new template goes: words with digits and words beyond the limit share a branch."""
        path: tuple[str, ...] = ()
        for word in words[: self.key_tokens]:
            known = self.children.get(path, set())
            limit = MAX_CHILDREN if WILDCARD in known else MAX_CHILDREN - 1
            shared = any(c.isdigit() for c in word) or len(known) + self.unlisted.get(path, 0) >= limit
            path += (WILDCARD if word not in known and shared else word,)
        return path

    def open(self, path: tuple[str, ...]) -> tuple[_Leaf, bool]:
        """The leaf at a path, and whether it had to be made."""
        leaf = self.leaves.get(path)
        if leaf is not None:
            return leaf, False
        for depth in range(len(path)):
            branches = self.children.setdefault(path[:depth], set())
            if path[depth] not in branches:
                branches.add(path[depth])
                self.made.append(path[: depth + 1])
        leaf = self.leaves[path] = _Leaf(self.width)
        self.version += 1
        return leaf, True


def run_unit(texts: pd.DataFrame, start: pd.DataFrame, width: int, st: float, key_tokens: int) -> Iterator[tuple]:
    """Take the lines of one unit in order, starting from the given state."""
    codes: dict[str, int] = {WILDCARD: 0}
    words_of: list[str] = [WILDCARD]

    def encode(words: list[str]) -> list[int]:
        for word in words:
            if word not in codes:
                codes[word] = len(words_of)
                words_of.append(word)
        return [codes[word] for word in words]

    forest = _Forest(width, key_tokens)
    for path in start.loc[start["kind"] == "node", "path"]:
        forest.know(tuple(path))
    for path, count in start.loc[start["kind"] == "count", ["path", "cluster"]].itertuples(index=False):
        forest.unlisted[tuple(path)] = int(count) - len(forest.children.get(tuple(path), ()))
    known = start[start["kind"] == "cluster"].sort_values("cluster")
    for cluster, path, template in zip(known["cluster"], known["path"], known["template"]):
        forest.know(tuple(path))
        forest.leaves[tuple(path)].add(int(cluster), encode(template.split(" ")))

    words = [text.split(" ") for text in texts["template"]]
    rows = np.array([encode(w) for w in words], dtype=np.int64).reshape(len(words), width)
    fixed = ((rows != 0).sum(axis=1) / width < st).tolist()
    order = np.concatenate([np.asarray(p, dtype=np.int64) for p in texts["positions"]])
    owner = np.repeat(np.arange(len(words)), [len(p) for p in texts["positions"]])
    turn = np.argsort(order, kind="stable")
    lines, owners = order[turn].tolist(), owner[turn].tolist()

    # Per text: (template's place, leaf, forest version, leaf version) while nothing changes for it.
    settled: list[tuple | None] = [None] * len(words)
    runs: list[list] = [[] for _ in words]
    began: set[int] = set()
    changed: dict[int, tuple] = {}

    def is_settled(text: int) -> bool:
        known = settled[text]
        return known is not None and known[2] == forest.version and known[3] == known[1].version

    def settle(upcoming: list[int]) -> None:
        """Find the texts among the upcoming ones that change nothing, leaf by leaf."""
        by_leaf: dict[int, list[int]] = {}
        leaves = {}
        for text in dict.fromkeys(upcoming):
            if not fixed[text] and not is_settled(text):
                leaf = forest.find(words[text])
                if leaf is not None:
                    by_leaf.setdefault(id(leaf), []).append(text)
                    leaves[id(leaf)] = leaf
        for name, members in by_leaf.items():
            leaf = leaves[name]
            step = max(1, 2_000_000 // max(1, len(leaf.ids)))
            for start in range(0, len(members), step):
                part = members[start : start + step]
                places, covered = leaf.closest(rows[part], st)
                for text, place, same in zip(part, places.tolist(), covered.tolist()):
                    if place >= 0 and same:
                        settled[text] = (place, leaf, forest.version, leaf.version)

    ahead = 16
    for event, (line, text) in enumerate(zip(lines, owners)):
        if fixed[text]:
            # Too few literals to match anything, ever: only its branch matters.
            forest.open(forest.path_for(words[text]))
            continue
        if not is_settled(text):
            settle(owners[event : event + ahead])
            ahead = min(2 * ahead, 1 << 14)
        if is_settled(text):
            place, leaf = settled[text][:2]
        else:
            ahead = 16
            leaf = forest.find(words[text])
            place = int(leaf.closest(rows[text : text + 1], st)[0][0]) if leaf is not None else -1
            if place < 0:
                leaf, _ = forest.open(forest.path_for(words[text]))
                place = len(leaf.ids)
                leaf.add(line, rows[text])
                began.add(line)
            else:
                leaf.rows[place] = np.where(leaf.rows[place] == rows[text], rows[text], 0)
                leaf.version += 1
            changed[leaf.ids[place]] = (leaf, place)
        cluster = leaf.ids[place]
        mine = runs[text]
        if mine and mine[-1][0] == cluster:
            mine[-1][2] = line
            mine[-1][3] += 1
        else:
            mine.append([cluster, line, line, 1])

    for text, text_runs in zip(texts["template"], runs):
        for cluster, first, last, count in text_runs:
            yield "run", text, None, None, cluster, first, last, count
    where = {id(leaf): list(path) for path, leaf in forest.leaves.items()}
    for cluster, (leaf, place) in changed.items():
        template = " ".join(words_of[c] for c in leaf.rows[place])
        yield "state", template, where[id(leaf)], cluster in began, cluster, None, None, None
    for path in forest.made:
        yield "node", None, list(path), None, None, None, None, None


def _mine_round(units: DataFrame, start: DataFrame, st: float, key_tokens: int) -> DataFrame:
    def run(key: tuple, texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if texts.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in _OUTPUT.split(", ")])
        found = list(run_unit(texts, known, int(key[2]), st, key_tokens))
        frame = pd.DataFrame(
            found, columns=["kind", "template", "path", "made", "cluster", "first_line", "last_line", "lines"]
        )
        for column in ("cluster", "first_line", "last_line", "lines"):
            frame[column] = frame[column].astype("Int64")
        for place, name in enumerate(_UNIT):
            frame.insert(place, name, key[place])
        return frame

    return units.groupBy(*_UNIT).cogroup(start.groupBy(*_UNIT)).applyInPandas(run, _OUTPUT)


def _asked_paths(texts: DataFrame, key_tokens: int) -> DataFrame:
    """Per unit the nodes that its lines can pass: every leading token as it is or as the wildcard."""
    words = F.split("template", " ")
    paths = [F.array().cast("array<string>")] if key_tokens == 0 else [
        F.array(*[F.lit(WILDCARD) if choice >> at & 1 else words[at] for at in range(depth)])
        for depth in range(1, key_tokens + 1)
        for choice in range(1 << depth)
    ]
    return texts.select(*_UNIT, F.explode(F.array_distinct(F.array(*paths))).alias("path")).distinct()


def _parent(path: str = "path") -> Column:
    """The node above; what has none gets a mark that is no node."""
    return F.when(F.size(path) > 0, F.slice(path, 1, F.size(path) - 1)).otherwise(F.array(F.lit("\u0000")))


def _start_rows(outputs: DataFrame, asked: DataFrame) -> DataFrame:
    """What units find on the paths that they ask for (``_START``).

    A template holds from the unit after the one that left it to the one where it changes
    again.  A cluster that its unit no longer begins is an outdated guess, and left out.
    """
    history = W.partitionBy("log_id", "n_tokens", "cluster")
    spans = (
        outputs.filter("kind = 'state'")
        .withColumn("_until", F.lead("block").over(history.orderBy("block")))
        .withColumn("_began", F.max("made").over(history))
        .filter("_began")
        .select(*_NODE, "cluster", "template", F.col("block").alias("_from"), "_until")
    )
    within = (F.col("block") > F.col("_from")) & (F.col("_until").isNull() | (F.col("block") <= F.col("_until")))
    clusters = asked.join(spans, _NODE).filter(within)
    nodes = outputs.filter("kind = 'node'").groupBy(*_NODE).agg(F.min("block").alias("_from"))
    there = asked.join(nodes, _NODE).filter(F.col("block") > F.col("_from"))
    # Branches of a node: counted where the unit's own could reach the limit.
    own = asked.groupBy(*_UNIT, _parent().alias("path")).agg(F.count("*").alias("_own"))
    branches = nodes.select("log_id", "n_tokens", _parent().alias("path"), "_from")
    counts = (
        own.join(branches, _NODE)
        .filter(F.col("block") > F.col("_from"))
        .groupBy(*_UNIT, "path")
        .agg(F.count("*").alias("cluster"), F.max("_own").alias("_own"))
        .filter(F.col("cluster") + F.col("_own") >= MAX_CHILDREN - 1)
    )
    none = F.lit(None)
    return (
        clusters.select(*_UNIT, "path", F.lit("cluster").alias("kind"), "cluster", "template")
        .unionByName(there.select(*_UNIT, "path", F.lit("node").alias("kind"), none.cast("bigint").alias("cluster"), none.cast("string").alias("template")))
        .unionByName(counts.select(*_UNIT, "path", F.lit("count").alias("kind"), "cluster", none.cast("string").alias("template")))
    )


_MARKED = [*_UNIT, "path", "branches"]


def _signatures(start: DataFrame) -> DataFrame:
    """One mark per unit and path, and one for the number of the path's branches."""
    row = F.xxhash64("kind", "cluster", "template")
    return start.groupBy(*_UNIT, "path", (F.col("kind") == "count").alias("branches")).agg(
        F.bit_xor(row).alias("mark"), F.count("*").alias("total")
    )


def _changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes on which two outputs of the same units differ."""
    columns = [*_UNIT, "path", "kind", "cluster", "template", "made"]
    left = lambda outputs: outputs.filter("kind <> 'run'").select(*columns)
    moved = left(old).exceptAll(left(new)).unionByName(left(new).exceptAll(left(old))).select(*_NODE)
    return moved.distinct()


def _settle(texts: DataFrame, st: float, key_tokens: int) -> DataFrame:
    """Outputs of all units, each run from what the units before it leave behind."""
    spark = texts.sparkSession
    units = materialize(texts.select(*_UNIT).distinct(), "units")
    # First guess: every later unit of a length starts from what the first one leaves behind.
    heads = units.groupBy("log_id", "n_tokens").agg(F.min("block").alias("block"))
    nothing = spark.createDataFrame([], _START)
    outputs = materialize(_mine_round(texts.join(heads, _UNIT, "left_semi"), nothing, st, key_tokens), "round")
    todo = materialize(units.join(heads, _UNIT, "left_anti"), "todo")
    if todo.isEmpty():
        return outputs
    # Heads start from nothing, whatever the others leave behind.
    asked = materialize(_asked_paths(texts.join(todo, _UNIT, "left_semi"), key_tokens), "asked")
    start = materialize(_start_rows(outputs, asked), "start")
    marks = materialize(_signatures(start), "marks")
    while True:
        again = materialize(_mine_round(texts.join(todo, _UNIT, "left_semi"), start, st, key_tokens), "again")
        before = outputs.join(todo, _UNIT, "left_semi")
        changed = materialize(_changed_paths(before, again), "changed")
        outputs = materialize(outputs.join(todo, _UNIT, "left_anti").unionByName(again), "round")
        # Only units that ask for a changed path, or for one beside it, can start differently.
        beside = changed.select("log_id", "n_tokens", _parent().alias("_parent")).distinct()
        looked = materialize(
            asked.withColumn("_parent", _parent()).join(beside, ["log_id", "n_tokens", "_parent"], "left_semi"), "looked"
        )
        fresh = materialize(_signatures(_start_rows(outputs, looked.drop("_parent"))), "fresh")
        keys = looked.select(*_UNIT, "path", F.lit(False).alias("branches")).unionByName(
            looked.select(*_UNIT, F.col("_parent").alias("path"), F.lit(True).alias("branches"))
        )
        keys = materialize(keys.distinct(), "keys")
        differs = marks.join(keys, _MARKED, "left_semi")
        differs = differs.exceptAll(fresh).unionByName(fresh.exceptAll(differs))
        todo = materialize(differs.select(*_UNIT).distinct(), "todo")
        if todo.isEmpty():
            return outputs
        marks = materialize(marks.join(keys, _MARKED, "left_anti").unionByName(fresh), "marks")
        start = materialize(_start_rows(outputs, asked.join(todo, _UNIT, "left_semi")), "start")


def mine_assignments(
    masked: DataFrame, st: float, depth: int, block_lines: int = BLOCK_LINES
) -> DataFrame:
    """Mined template for each distinct masked text, block by block.

    ``masked`` has ``(log_id, line_no, template, n_tokens)``.  Gives ``(log_id, block,
    n_tokens, template, first_line, last_line, lines, mined)``: the lines of the block with
    that masked text, from ``first_line`` to ``last_line``, belong to template ``mined``.
    """
    texts = materialize(
        masked.withColumn("block", F.floor(F.col("line_no") / F.lit(block_lines)))
        .groupBy(*_UNIT, "template")
        .agg(F.sort_array(F.collect_list("line_no")).alias("positions")),
        "texts",
    )
    # Texts too short to reach a leaf never merge, and neither do texts with too few literals.
    grows = F.col("n_tokens") >= depth - 2
    literals = T.literal_count(F.split("template", " "))
    active = grows & (literals / F.col("n_tokens") >= F.lit(st))
    outputs = _settle(texts.filter(grows), st, max(depth - 3, 0))
    final = (
        outputs.filter("kind = 'state'")
        .groupBy("log_id", "n_tokens", "cluster")
        .agg(F.max_by("template", "block").alias("mined"))
    )
    runs = outputs.filter(F.col("kind") == "run").select(
        "log_id", "block", "n_tokens", "template", "cluster", "first_line", "last_line", "lines"
    )
    merged = lookup_join(
        runs, final, ["log_id", "n_tokens", "cluster"], "inner"
    ).drop("cluster")
    alone = texts.filter(~active).select(
        "log_id",
        "block",
        "n_tokens",
        "template",
        F.col("positions")[0].alias("first_line"),
        F.element_at("positions", -1).alias("last_line"),
        F.size("positions").cast("bigint").alias("lines"),
        F.col("template").alias("mined"),
    )
    return merged.unionByName(alone)


def mined_catalogue(assignments: DataFrame) -> DataFrame:
    """Catalogue of the mined templates; counts come from the assignments, not from the lines."""
    found = assignments.groupBy("log_id", F.col("mined").alias("_mined")).agg(
        F.sum("lines").alias("Occurrences"), F.min("first_line").alias("first_line")
    )
    return number_events(found.withColumnRenamed("_mined", "template"))


def attach_mined(masked: DataFrame, assignments: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Replace ``template`` of each line by its mined template."""
    rows = masked.withColumn("block", F.floor(F.col("line_no") / F.lit(block_lines)))
    spans = assignments.select(
        "log_id", "block", "template", F.struct("first_line", "last_line", "mined").alias("span")
    )
    joined = rows.join(spans, ["log_id", "block", "template"]).filter(
        F.col("line_no").between(F.col("span.first_line"), F.col("span.last_line"))
    )
    return joined.withColumn("template", F.col("span.mined")).drop("block", "span")
