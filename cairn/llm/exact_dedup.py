"""Exact dedup by a tree of merges over sorted digest runs.

Every input partition makes one run: a light row for each document (SHA-256 of the normalised text, its length and a second
hash, no text), sorted by digest. Rounds then merge the runs of WAYS neighbours, as the levels of a binomial tree: run r
goes into run r // WAYS, until one is left. A level keeps, for each digest of a run, how many rows it stands for and the row
that stays; rows meet only if digest, length and second hash agree, so each level verifies what it merges. Decisions walk
the same tree down again, each level joining the one above by (parent run, digest). Thus a text that a third of all rows
hold is one row per run at every level, and its copies are spread over as many join keys as there are runs. DataFrame
functions only; no text is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import BLANKS, read_table, unused, written

WAYS, MAX_RUNS = 16, 4096
_KEY = ["digest", "size", "check"]


def normalised(text: Column) -> Column:
    """The text without blanks (space, 0x09 to 0x0D); null counts as empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"), normalised(F.col("text")).alias("norm"), *more)
    keys = [F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"), F.octet_length("norm").alias("size"), F.xxhash64("norm").alias("check")]
    return rows.select("doc_id", "n_chars", *keys, *[c for c in rows.columns if c not in ("doc_id", "n_chars", "norm")])


def _merged(runs: DataFrame, name: str) -> DataFrame:
    """One row for each digest of a run: the best row and how many there are."""
    return written(runs.groupBy("run", *_KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n")), name)


def exact_duplicates(docs: DataFrame, ways: int = WAYS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chars) for every row of documents (doc_id, text).

    Of rows with equal normalised texts the one with the most code points in its text stays, then the one with the smallest
    doc_id; a null doc_id comes after all others, and of rows that agree in both, one stays. Null, empty and blank texts
    are equal to each other. An empty table gives an empty result; further columns are ignored, whatever their names.
    """
    # ids of partitions and rows are drawn once, with the written rows
    drawn = [F.pmod(F.spark_partition_id(), F.lit(MAX_RUNS)).alias("run"), F.monotonically_increasing_id().alias("row")]
    rows = written(_keyed(docs, *drawn).sortWithinPartitions("run", *_KEY), "runs")
    best = F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row").alias("best")
    levels = [_merged(rows.select("run", *_KEY, best, F.lit(1).cast("long").alias("n")), "level")]
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while n_runs > 1:
        levels.append(_merged(levels[-1].withColumn("run", F.floor(F.col("run") / ways)), "level"))
        n_runs = -(-n_runs // ways)
    decided = levels.pop()
    while levels:
        above = decided.withColumnRenamed("run", "parent")
        below = levels.pop().select("run", *_KEY, F.floor(F.col("run") / ways).alias("parent"))
        decided = below.join(above, ["parent", *_KEY]).select("run", *_KEY, "best", "n")
    out = rows.join(decided, ["run", *_KEY])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars")


def deduplicated(docs: DataFrame, ways: int = WAYS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that also share their doc_id and length become one."""
    kept = exact_duplicates(docs, ways).where("kept")
    sha, n = unused("sha", docs, kept), unused("n", docs, kept)
    keyed = docs.withColumns({sha: F.sha2(normalised(F.col("text")).cast("binary"), 256), n: F.coalesce(F.char_length("text"), F.lit(0))})
    same = keyed["doc_id"].eqNullSafe(kept["doc_id"]) & (keyed[sha] == kept["text_sha256"]) & (keyed[n] == kept["n_chars"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", sha]).select(*docs.columns)


SQL = r"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
k AS (SELECT t, arg_min(doc_id, (-chars, doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN k USING (t)
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents")).drop("n_chars")
