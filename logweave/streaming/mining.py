"""Template mining over arriving lines: the miner's own way of working, kept in streaming state.

Lines are grouped by log and number of tokens, because lines of different lengths never meet.  A
group's state is its tree: one entry per node, with the node's number of branches and, at a leaf,
its templates.  A micro-batch reads only the entries that its lines can pass, takes its lines in
order, and writes the entries that changed.  The state outlives the query in its checkpoint, so a
restarted stream goes on as if it had never stopped, and the result equals that of the batch
miner over the same lines.

Lines must arrive in order: one that comes after later ones counts from its arrival on.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logweave.formats import WILDCARD
from logweave.operators.mining import run_unit
from logweave.operators.templates import number_events

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: ``line``: a line and its cluster, or its own text as template; ``template``: a cluster's template from now on.
_OUTPUT = "log_id string, n_tokens int, kind string, line_no bigint, cluster bigint, template string"
_LINE, _TEMPLATE = "line", "template"

#: Lines of a key that are taken at a time: bounds what the miner holds of a micro-batch as Python objects.
SLICE_LINES = 1 << 15
_LINES = pa.schema([("line_no", pa.int64()), ("template", pa.large_string())])


def _asked(words: list[str], key_tokens: int) -> Iterator[tuple[str, ...]]:
    """Nodes that a line can pass: every leading token as it is or as the wildcard."""
    level = {()}
    yield ()
    for word in words[:key_tokens]:
        level = {(*path, step) for path in level for step in (word, WILDCARD)}
        yield from level


class Miner(StatefulProcessor):
    """State per log and length: node path (as JSON) to branches, clusters and templates."""

    def __init__(self, st: float, depth: int):
        self.st, self.depth, self.key_tokens = st, depth, max(depth - 3, 0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState(
            "nodes", "path string", "branches bigint, clusters array<bigint>, templates array<string>"
        )

    def _entry(self, path: tuple[str, ...]) -> tuple[int, list, list] | None:
        key = (json.dumps(path),)
        if not self.nodes.containsKey(key):
            return None
        branches, clusters, templates = self.nodes.getValue(key)
        return branches, list(clusters), list(templates)

    def _start(self, texts: list[str], entries: dict) -> pd.DataFrame:
        """Entries that the texts can pass, as rows for the miner; those not in ``entries`` yet are read into it."""
        asked = dict.fromkeys(path for text in texts for path in _asked(text.split(" "), self.key_tokens))
        for path in asked:
            if path not in entries and (entry := self._entry(path)) is not None:
                entries[path] = entry
        rows = []
        for path in asked:
            if path not in entries:
                continue
            branches, clusters, templates = entries[path]
            if path or not self.key_tokens:
                rows.append((list(path), "node", None, None))
            if len(path) < self.key_tokens:
                rows.append((list(path), "count", branches, None))
            rows += [(list(path), "cluster", c, t) for c, t in zip(clusters, templates)]
        return pd.DataFrame(rows, columns=["path", "kind", "cluster", "template"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # Arrow holds a text in its bytes; only those of a slice become Python strings.
        lines = pa.concat_tables(pa.Table.from_pandas(part[["line_no", "template"]], _LINES, preserve_index=False) for part in rows)
        turn = np.argsort(lines.column("line_no").to_numpy(), kind="stable")
        entries, written, latest = {}, set(), {}
        for at in range(0, len(turn), SLICE_LINES):
            part = lines.take(pa.array(turn[at : at + SLICE_LINES])).to_pandas()
            yield self._frame(key, self._mine(part, int(key[1]), entries, written, latest))
        for path in written:
            self.nodes.updateValue((json.dumps(path),), entries[path])
        # A template that changed more than once is told once, as it is by now.
        yield self._frame(key, [(_TEMPLATE, None, cluster, text) for cluster, text in latest.items()])

    @staticmethod
    def _frame(key: tuple, found: Iterable[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(list(found), columns=["kind", "line_no", "cluster", "template"])
        frame["line_no"], frame["cluster"] = frame["line_no"].astype("Int64"), frame["cluster"].astype("Int64")
        frame.insert(0, "n_tokens", key[1])
        frame.insert(0, "log_id", key[0])
        return frame

    def _mine(self, lines: pd.DataFrame, width: int, entries: dict, written: set, latest: dict[int, str]) -> Iterator[tuple]:
        """Lines of one slice; what it changes is left in ``entries``, their paths in ``written``, templates in ``latest``."""
        texts = lines.groupby("template", sort=False)["line_no"].agg(list).rename("positions").reset_index()
        if width < self.depth - 2:
            # Too short to reach a leaf: never generalised.
            for line, text in zip(lines["line_no"], lines["template"]):
                yield _LINE, line, None, text
            return
        positions = dict(zip(texts["template"], texts["positions"]))
        start = self._start(list(positions), entries)
        clustered = set()
        for kind, text, path, made, cluster, first, last, _ in run_unit(texts, start, width, self.st, self.key_tokens):
            if kind == "run":
                for line in positions[text]:
                    if first <= line <= last:
                        clustered.add(line)
                        yield _LINE, line, cluster, None
            elif kind == "state":
                path = tuple(path)
                branches, clusters, templates = entries.setdefault(path, (0, [], []))
                if made:
                    clusters.append(cluster)
                    templates.append(text)
                else:
                    templates[clusters.index(cluster)] = text
                written.add(path)
                latest[cluster] = text
            else:
                path = tuple(path)
                entries.setdefault(path, (0, [], []))
                branches, clusters, templates = entries.get(path[:-1], (0, [], []))
                entries[path[:-1]] = branches + 1, clusters, templates
                written |= {path, path[:-1]}
        # Texts with too few literals are templates of their own.
        for line, text in zip(lines["line_no"], lines["template"]):
            if line not in clustered:
                yield _LINE, line, None, text

    def close(self) -> None:
        pass


def mine_stream(masked: DataFrame, st: float, depth: int) -> DataFrame:
    """Stream of lines with their clusters, and of templates that changed.

    ``masked`` is a stream of ``(log_id, line_no, template, n_tokens)``.  The session needs the
    RocksDB state store, which this kind of state is kept in.
    """
    if masked.sparkSession.conf.get(STATE_STORE, None) != ROCKS_DB:
        raise ValueError(f"set {STATE_STORE} to {ROCKS_DB}")
    return (
        masked.select("log_id", "n_tokens", "line_no", "template")
        .groupBy("log_id", "n_tokens")
        .transformWithStateInPandas(Miner(st, depth), _OUTPUT, "Append", "None")
    )


def write_mined(mined: DataFrame, folder: str, checkpoint: str, **trigger: object):
    """Start writing a mined stream below ``folder``, one folder per micro-batch.

    A micro-batch that is repeated after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/batch={number}")

    return mined.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _written(spark: SparkSession, folder: str) -> DataFrame:
    schema = f"{_OUTPUT}, batch bigint"
    return spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/batch=*")


def mined_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(log_id, line_no, n_tokens, template)``: every line with the template that its cluster has by now."""
    written = _written(spark, folder)
    keys = ["log_id", "n_tokens", "cluster"]
    latest = written.filter(F.col("kind") == _TEMPLATE).groupBy(*keys).agg(F.max_by("template", "batch").alias("latest"))
    lines = written.filter(F.col("kind") == _LINE)
    return lines.join(latest, keys, "left").select(
        "log_id", "line_no", "n_tokens", F.coalesce("latest", "template").alias("template")
    )


def mined_events(lines: DataFrame) -> DataFrame:
    """Event catalogue of mined lines."""
    found = lines.groupBy("log_id", "template").agg(
        F.count("*").alias("Occurrences"), F.min("line_no").alias("first_line")
    )
    return number_events(found)
