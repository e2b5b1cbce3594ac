"""Chunks of a log, weights of their words, nearest texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.text import strip, tokens
from logweave.session import lookup_join, materialize

# Tokens per chunk, and chunks returned for a question.
CHUNK_TOKENS = 1024
TOP_K = 2

# Lines that one task packs; the chunks do not depend on it.
CHUNK_BLOCK_LINES = 1 << 20

# Texts and queries of a cell that one task scores, and queries whose scores it holds at a time.
CELL_TEXTS, CELL_ASKED, CELL_QUERIES = 4096, 4096, 256

# Bytes of text in a block whose words one task weighs; the weights do not depend on it.
WORD_BLOCK_BYTES = 8 << 20


def _first_over(total: np.ndarray, used: np.ndarray, budget: int) -> np.ndarray:
    """Place of the first line that no longer fits after ``used`` tokens; ``total`` are running sums."""
    return np.where(used > budget, 0, np.searchsorted(total, budget - used, side="right"))


def _block_map(total: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fill that a block may be entered with, the fill it is left with, and the last chunk's first line.

    A fill is the number of tokens in the open chunk, ``budget + 1`` if nothing fits any more.
    The place -1 stands for the chunk that was open before.
    """
    count = len(total)
    before = np.concatenate([[0], total[:-1]])
    following = np.maximum(np.searchsorted(total, before + budget, side="right"), np.arange(count) + 1)
    last = np.arange(count)
    for start in range(count - 1, -1, -1):
        if following[start] < count:
            last[start] = last[following[start]]
    left = np.minimum(total[-1] - before[last], budget + 1)
    fills = np.arange(budget + 2)
    entry = _first_over(total, fills, budget)
    inside = entry < count
    safe = np.minimum(entry, count - 1)
    return np.where(inside, left[safe], np.minimum(fills + total[-1], budget + 1)), np.where(inside, last[safe], -1)


def chunk_ids(lines: DataFrame, budget: int = CHUNK_TOKENS, block_lines: int = CHUNK_BLOCK_LINES) -> DataFrame:
    """``(log_id, line_no, n_tokens, line_from)``: whole lines packed greedily through each log.

    A chunk takes lines in order while their tokens stay within the budget; a longer line is
    a chunk of its own.  ``line_from`` is the chunk's first line.  Only token counts travel to
    the packing steps, never the text.

    Blocks of lines are packed in parallel: a block first tells what it leaves open for each
    fill that it may be entered with (one row of ``budget`` numbers per block), these rows are
    followed from block to block, and then each block is packed from the fill it really meets.
    The first line of a log is entered like one after a full chunk.
    """
    sized = materialize(
        lines.select(
            "log_id",
            "line_no",
            F.size(tokens(F.col("line"))).cast("bigint").alias("n_tokens"),
            F.floor(F.col("line_no") / F.lit(block_lines)).alias("block"),
        ),
        "line_sizes",
    )

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        leaves, last = _block_map(pdf["n_tokens"].to_numpy().cumsum(), budget)
        numbers = pdf["line_no"].to_numpy()
        opened = np.where(last < 0, -1, numbers[np.maximum(last, 0)])
        return pd.DataFrame({"log_id": pdf["log_id"].iloc[:1], "block": pdf["block"].iloc[:1], "leaves": [leaves], "opened": [opened]})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        fill, opened, found = budget + 1, -1, []
        for leaves, firsts in zip(pdf["leaves"], pdf["opened"]):
            found.append((fill, opened))
            opened = opened if firsts[fill] < 0 else int(firsts[fill])
            fill = int(leaves[fill])
        return pd.DataFrame({
            "log_id": pdf["log_id"], "block": pdf["block"],
            "fill": [f for f, _ in found], "open_from": [o for _, o in found],
        })

    def pack(pdf: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        numbers, total = pdf["line_no"].to_numpy(), pdf["n_tokens"].to_numpy().cumsum()
        first = np.full(len(total), entered["open_from"].iloc[0])
        start = int(_first_over(total, np.array(entered["fill"].iloc[0]), budget))
        while start < len(total):
            used = int(total[start - 1]) if start else 0
            end = max(int(np.searchsorted(total, used + budget, side="right")), start + 1)
            first[start:end] = numbers[start]
            start = end
        return pdf[["log_id", "line_no", "n_tokens"]].assign(line_from=first)

    blocks = sized.groupBy("log_id", "block")
    told = blocks.applyInPandas(tell, "log_id string, block bigint, leaves array<bigint>, opened array<bigint>")
    entered = told.groupBy("log_id").applyInPandas(
        follow, "log_id string, block bigint, fill bigint, open_from bigint"
    )
    return blocks.cogroup(materialize(entered, "chunk_blocks").groupBy("log_id", "block")).applyInPandas(
        pack, "log_id string, line_no bigint, n_tokens bigint, line_from bigint"
    )


def chunk_spans(lines: DataFrame, budget: int = CHUNK_TOKENS, block_lines: int = CHUNK_BLOCK_LINES) -> DataFrame:
    """``(log_id, line_from, line_to, n_lines, n_tokens)`` per chunk."""
    return (
        chunk_ids(lines, budget, block_lines)
        .groupBy("log_id", "line_from")
        .agg(
            F.max("line_no").alias("line_to"),
            F.count("*").alias("n_lines"),
            F.sum("n_tokens").alias("n_tokens"),
        )
    )


def chunk_texts(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """``(log_id, line_from, text)``; a text is at most one chunk budget long."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", strip(F.col("line")).alias("line"))))
    return (
        lines.join(ids.select("log_id", "line_no", "line_from"), ["log_id", "line_no"])
        .groupBy("log_id", "line_from")
        .agg(F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("text"))
    )


def bucket_counts(texts: DataFrame, keys: list[str], buckets: int | None = 256, text: str = "text") -> DataFrame:
    """Words hashed into buckets: ``(*keys, bucket, n_words)``.  Without a number of buckets each word is its own."""
    word = F.explode(tokens(F.lower(text)))
    bucket = F.conv(F.substring(F.md5("_word"), 1, 6), 16, 10).cast("bigint") % buckets if buckets else F.col("_word")
    return (
        texts.select(*keys, word.alias("_word"))
        .groupBy(*keys, bucket.alias("bucket"))
        .agg(F.count("*").alias("n_words"))
    )


def bucket_idf(counts: DataFrame, texts: DataFrame) -> DataFrame:
    """Smoothed inverse document frequency: one row per bucket."""
    n_texts = texts.agg(F.count("*").alias("_n")).scalar()
    frequency = counts.groupBy("bucket").agg(F.count("*").alias("_df"))
    return frequency.select("bucket", (F.log((1 + n_texts) / (1 + F.col("_df"))) + 1).alias("idf"))


def unit_weights(counts: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """TF-IDF weights of length one: ``(*keys, bucket, weight)``."""
    weighted = lookup_join(counts, idf, ["bucket"], "inner").withColumn(
        "_w", F.col("n_words") * F.col("idf")
    )
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(*keys)))
    return weighted.select(*keys, "bucket", (F.col("_w") / length).alias("weight"))


def _counted(texts: pa.Table, key: str) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and words of some texts, and per id and word that meet: place of the id, place of the word, times."""
    listed = pc.split_pattern(texts.column("text").combine_chunks(), " ")
    words = listed.flatten().dictionary_encode()
    ids = texts.column(key).combine_chunks().dictionary_encode("encode")
    own = ids.indices.to_numpy()[pc.list_parent_indices(listed).to_numpy()].astype(np.int64)
    pair, times = np.unique(own * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
    return ids.dictionary, words.dictionary, *np.divmod(pair, len(words.dictionary)), times


def text_blocks(texts: DataFrame, key: str, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """``(_block, key, text)`` with lower-case words parted by single blanks, and the number of all texts.

    Rows with one id are in one block; texts without words are in none.
    """
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = -(-(size["bytes"] or 0) // (block_bytes or WORD_BLOCK_BYTES)) or 1
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block")
    words = F.array_join(tokens(F.lower("text")), " ").alias("text")
    # Blank texts go by their ends, else the filter would split every text once more.
    return texts.filter(strip(F.col("text")) != F.lit("")).select(block, key, words), size["n"]


def block_words(blocks: DataFrame, key: str) -> DataFrame:
    """``(_block, bucket, n_texts)``: the words of each block, with the number of ids that have them in any block."""

    def tell(texts: pa.Table) -> pa.Table:
        _, words, _, word, _ = _counted(texts, key)
        block = pa.array(np.full(len(words), texts.column("_block")[0].as_py(), np.int32))
        return pa.table({"_block": block, "bucket": words, "n": np.bincount(word)})

    told = blocks.groupBy("_block").applyInArrow(tell, "_block int, bucket string, n bigint")
    return told.select("_block", "bucket", F.sum("n").over(W.partitionBy("bucket")).alias("n_texts"))


def word_idf(words: DataFrame, n_texts: int) -> DataFrame:
    """Smoothed inverse document frequency: one row per word of ``block_words``."""
    frequency = words.groupBy("bucket").agg(F.any_value("n_texts").alias("_df"))
    return frequency.select("bucket", (F.log((1 + F.lit(n_texts)) / (1 + F.col("_df"))) + 1).alias("idf"))


def block_weights(blocks: DataFrame, words: DataFrame, key: str, n_texts: int) -> DataFrame:
    """TF-IDF weights of length one: ``(key, bucket, weight)``; each word is its own bucket.

    ``blocks`` and ``n_texts`` come from ``text_blocks``, ``words`` from ``block_words``.  What is shuffled are the
    texts and the words of blocks, no row per text and word.  A word that one id alone has is not sent to its block.
    """

    def weigh(texts: pa.Table, shared: pa.Table) -> pa.Table:
        ids, names, own, word, times = _counted(texts, key)
        place = pc.index_in(names, shared.column("bucket").combine_chunks())
        had = pc.fill_null(shared.column("n_texts").combine_chunks().take(place), 1).to_numpy()
        weight = times * (np.log((1 + n_texts) / (1 + had)) + 1)[word]
        weight /= np.sqrt(np.bincount(own, weight * weight))[own]
        return pa.table({key: ids.take(pa.array(own)), "bucket": names.take(pa.array(word)), "weight": weight})

    kind = dict(blocks.dtypes)[key]
    sides = blocks.groupBy("_block").cogroup(words.filter(F.col("n_texts") > 1).groupBy("_block"))
    return sides.applyInArrow(weigh, f"`{key}` {kind}, bucket string, weight double")


def dense_vectors(weights: DataFrame, keys: list[str], buckets: int = 256) -> DataFrame:
    """``(*keys, vector array<double>)`` from hashed weights."""
    entries = F.map_from_entries(F.collect_list(F.struct("bucket", "weight")))
    filled = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint")),
        lambda i: F.coalesce(F.element_at("_entries", i), F.lit(0.0)),
    )
    return weights.groupBy(*keys).agg(entries.alias("_entries")).select(*keys, filled.alias("vector"))


def _cell_best(texts: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The best ``k`` of some texts for each of some queries, from their weights; ties go to the smaller ``vec_id``."""
    words = pa.concat_arrays([a for t in (texts, asked) for a in t.column("bucket").chunks]).dictionary_encode()
    word = words.indices.to_numpy()
    own, other = word[: texts.num_rows], word[texts.num_rows :]
    names = texts.column("vec_id").combine_chunks().unique()
    names = names.take(pc.array_sort_indices(names, null_placement="at_start"))
    row = pc.index_in(texts.column("vec_id"), names).to_numpy()
    queries = asked.column("query_id").combine_chunks().dictionary_encode("encode")
    query = queries.indices.to_numpy()
    # Both sides by word, so that a word's rows lie together.
    turn, asked_turn = np.argsort(own, kind="stable"), np.argsort(other, kind="stable")
    own, row, weight = own[turn], row[turn], texts.column("weight").to_numpy()[turn]
    other, query, wanted = other[asked_turn], query[asked_turn], asked.column("weight").to_numpy()[asked_turn]
    found = []
    for first in range(0, len(queries.dictionary), CELL_QUERIES):
        inside = (query >= first) & (query < first + CELL_QUERIES)
        scores = np.zeros((min(CELL_QUERIES, len(queries.dictionary) - first), len(names)))
        met, begins = np.unique(other[inside], return_index=True)
        lows, highs = np.searchsorted(own, met), np.searchsorted(own, met, side="right")
        ends = np.append(begins[1:], inside.sum())
        part, value = query[inside] - first, wanted[inside]
        for low, high, begin, end in zip(lows, highs, begins, ends):
            scores[np.ix_(part[begin:end], row[low:high])] += np.outer(value[begin:end], weight[low:high])
        scores = scores.round(9)
        for _ in range(min(k, len(names))):
            # The first of the largest scores is the one with the smallest id.
            best = scores.argmax(axis=1)
            score = scores[np.arange(len(scores)), best]
            held = np.flatnonzero(score > 0)
            found.append((held + first, best[held], score[held]))
            scores[np.arange(len(scores)), best] = 0
    who, which, score = (np.concatenate(c) for c in zip(*found))
    return pa.table({"query_id": queries.dictionary.take(pa.array(who)), "vec_id": names.take(pa.array(which)), "score": score})


def _best_in_cells(weights: DataFrame, asked: DataFrame, n_texts: int, n_queries: int, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: per group of texts the best ``k`` for each query that shares a word with them.

    Texts and queries are dealt to the cells of a grid, and a cell multiplies its weights: no row is made for a
    pair, and what a cell holds does not grow with their number.
    """
    kind = dict(asked.dtypes)["query_id"], dict(weights.dtypes)["vec_id"]
    schema = f"query_id {kind[0]}, vec_id {kind[1]}, score double"
    rows, columns = -(-n_texts // CELL_TEXTS) or 1, -(-n_queries // CELL_ASKED) or 1

    def run(texts: pa.Table, queries: pa.Table) -> pa.Table:
        if texts.num_rows and queries.num_rows:
            return _cell_best(texts, queries, k)
        return pa.table({"query_id": queries.column("query_id").slice(0, 0), "vec_id": texts.column("vec_id").slice(0, 0), "score": pa.array([], pa.float64())})

    def dealt(side: DataFrame, key: str, own: str, number: int, other: str, others: int) -> DataFrame:
        group = F.pmod(F.xxhash64(key), F.lit(number)).cast("int")
        return side.withColumn(own, group).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("_r", "_c")

    cells = dealt(weights, "vec_id", "_r", rows, "_c", columns).cogroup(dealt(asked, "query_id", "_c", columns, "_r", rows))
    return cells.applyInArrow(run, schema)


def nearest_texts(texts: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """``(query_id, vec_id, score, place)``: the ``k`` texts most similar to each query by TF-IDF of their words.

    ``texts`` holds ``vec_id`` and ``text``, ``queries`` ``query_id`` and ``text``.  Words are not
    hashed, so a rare word is not lost among others.  Queries with the same known words are scored once
    (``_best_in_cells``); what is sent on are the best ``k`` of each group of texts.
    Where fewer texts share a word with a query, the first texts follow with score 0.
    """
    blocks, n_texts = text_blocks(texts, "vec_id")
    held = materialize(block_words(blocks, "vec_id"), "block_words")
    idf = materialize(word_idf(held, n_texts), "word_idf")
    known = lookup_join(bucket_counts(queries, ["query_id"], None), idf.select("bucket"), ["bucket"], "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("bucket", "n_words")))
    same = materialize(known.groupBy("query_id").agg(F.to_json(listed).alias("_words"), listed.alias("_list")), "known_words")
    # What stands for all queries with the same words is the list of them.
    words = same.groupBy("_words").agg(F.any_value("_list").alias("_list"))
    words = materialize(words.select(F.col("_words").alias("query_id"), F.explode("_list").alias("_word")), "distinct_words")
    asked = materialize(unit_weights(words.select("query_id", "_word.*"), idf, ["query_id"]), "asked_weights")
    weights = lookup_join(block_weights(blocks, held, "vec_id", n_texts), asked.select("bucket").distinct(), ["bucket"], "left_semi")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("bigint")
    n_asked = asked.select("query_id").distinct().count()
    cells = _best_in_cells(weights, asked, n_texts, n_asked, k)
    best = materialize(cells.withColumn("place", place).filter(F.col("place") <= k).drop("place"), "nearest")
    best = best.withColumnRenamed("query_id", "_words")
    shared = lookup_join(same.select("query_id", "_words"), best, ["_words"], "inner").drop("_words")
    first = texts.select("vec_id").orderBy("vec_id").limit(k)
    others = queries.select("query_id").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    found = shared.unionByName(others).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("place", place).filter(F.col("place") <= k)
