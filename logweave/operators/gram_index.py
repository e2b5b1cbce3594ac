"""A persisted index of character grams: which blocks of a log can hold a word.

A gram is what stands in ``GRAM`` signs of a lowered line from some place on, fewer at its end, so
any word of a line is a gram, holds a gram, or is the beginning of one.  The index lists each gram
with the blocks of lines that hold it.  A batch of words is answered from the rarest gram of each
word: only the blocks found there are read, and their lines are then searched.  The index is
written once and serves many batches; lines lie in parts of many blocks, and parts without a hit
are not opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import lookup_join, materialize

GRAM = 4
#: Lines of a block, and blocks of a part.
BLOCK_LINES, PART_BLOCKS = 1024, 64
#: Buckets of the postings by gram, and parts that a scan may name.
BUCKETS, PARTS_NAMED = 32, 10_000

_LINES = "log_id string, line_no bigint, line string, block bigint, part bigint"


def _grams(text: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, F.lit(GRAM))))


class GramIndex:
    """Below ``folder``: ``lines`` by part, ``postings`` (gram, log_id, block) by gram, ``grams`` with their numbers of blocks."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def build(self, lines: DataFrame) -> GramIndex:
        """Write the index of all lines (log_id, line_no, line); an earlier one is replaced."""
        block = F.floor(F.col("line_no") / F.lit(BLOCK_LINES))
        rows = lines.select("log_id", "line_no", "line", block.alias("block")).withColumn(
            "part", F.floor(F.col("block") / F.lit(PART_BLOCKS))
        )
        # Rows of a part come from many tasks; sorting by block keeps a block's rows in few row groups.
        rows.sortWithinPartitions("part", "log_id", "block").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/lines")
        rows = self.lines()
        # The one-row generator lowers a line once, not once per gram.
        lowered = rows.select("log_id", "block", F.explode(F.array(F.lower("line"))).alias("text"))
        postings = lowered.select("log_id", "block", F.explode(_grams(F.col("text"))).alias("gram")).distinct()
        bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).alias("bucket")
        (
            postings.select("gram", "log_id", "block", bucket)
            .repartition("bucket", "gram")
            .sortWithinPartitions("bucket", "gram", "log_id", "block")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{self.folder}/postings")
        )
        self.postings().groupBy("gram").agg(F.count("*").alias("n_blocks")).write.mode("overwrite").parquet(f"{self.folder}/grams")
        return self

    def lines(self) -> DataFrame:
        return self.spark.read.schema(_LINES).parquet(f"{self.folder}/lines")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, log_id string, block bigint, bucket bigint").parquet(f"{self.folder}/postings")

    def _looked_up(self, words: DataFrame) -> DataFrame:
        """``(word, gram)``: of a long word its rarest gram, of a short one all that begin with it."""
        known = self.spark.read.schema("gram string, n_blocks bigint").parquet(f"{self.folder}/grams")
        long = words.filter(F.length("word") >= GRAM)
        own = long.select("word", F.explode(F.filter(_grams(F.col("word")), lambda g: F.length(g) == GRAM)).alias("gram"))
        # A gram that the index does not know leaves its word without a line.
        held = own.join(known, "gram", "left")
        # Grams that all blocks hold are told apart by the number of words that share them.
        shared = own.groupBy("gram").agg(F.count("*").alias("n_words"))
        rarest = held.join(shared, "gram").groupBy("word").agg(
            F.min(F.struct(F.coalesce("n_blocks", F.lit(0)).alias("n"), "n_words", "gram"))["gram"].alias("gram")
        )
        lengths = F.sequence(F.lit(0), F.least(F.length("gram"), F.lit(GRAM - 1)))
        begun = known.select("gram", F.explode(F.transform(lengths, lambda n: F.left("gram", n))).alias("word"))
        short = lookup_join(begun, words.filter(F.length("word") < GRAM).select("word"), ["word"], "left_semi")
        return rarest.select("word", "gram").unionByName(short.select("word", "gram"))

    def _asked(self, words: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(word, gram, bucket)`` of the distinct lowered ``words(word)``, and the postings of their buckets."""
        asked = materialize(
            self._looked_up(words).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS))), "index-grams"
        )
        buckets = [row.bucket for row in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        return asked, self.postings().filter(F.col("bucket").isin(buckets))

    def blocks(self, words: DataFrame) -> DataFrame:
        """``(word, log_id, block)``: where the index sends each of the distinct lowered ``words(word)``."""
        asked, postings = self._asked(words)
        return lookup_join(postings, asked, ["bucket", "gram"], "inner").select("word", "log_id", "block").distinct()

    def line_words(self, words: DataFrame) -> DataFrame:
        """``(log_id, line_no, words)``: which of the distinct lowered ``words(word)`` each line holds; others left out.

        The lines of the blocks that hold any asked gram meet the words by their own grams, so a line is
        tested for the words of its grams only, however many words its block is asked for.
        """
        asked, postings = self._asked(words)
        grams = asked.select("bucket", "gram").distinct()
        hits = materialize(
            lookup_join(postings, grams, ["bucket", "gram"], "left_semi")
            .select("log_id", "block", F.floor(F.col("block") / F.lit(PART_BLOCKS)).alias("part"))
            .distinct(),
            "index-hits",
        )
        met = lookup_join(self.read_parts(hits), hits, ["part", "log_id", "block"], "left_semi")
        keyed = asked.groupBy("gram").agg(F.collect_list("word").alias("_candidates"))
        # Lines with equal numbers stay apart; the one-row generator lowers a line once, not once per gram.
        lowered = met.select(
            "log_id", "line_no", F.monotonically_increasing_id().alias("_row"), F.explode(F.array(F.lower("line"))).alias("_text")
        )
        rows = lowered.select("*", F.explode(_grams(F.col("_text"))).alias("gram"))
        held = F.filter("_candidates", lambda word: F.contains(F.col("_text"), word))
        return (
            lookup_join(rows, keyed, ["gram"], "inner")
            .select("log_id", "line_no", "_row", F.explode(held).alias("word"))
            .groupBy("log_id", "line_no", "_row")
            .agg(F.collect_set("word").alias("words"))
            .drop("_row")
        )

    def read_parts(self, hits: DataFrame) -> DataFrame:
        """Lines of the parts that hits name; beyond ``PARTS_NAMED`` of them all parts are opened."""
        parts = [row.part for row in hits.select("part").distinct().limit(PARTS_NAMED + 1).collect()]
        return self.lines() if len(parts) > PARTS_NAMED else self.lines().filter(F.col("part").isin(parts))
