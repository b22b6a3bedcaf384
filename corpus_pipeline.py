"""From raw documents to mixed, encoded training data: toxicity, line dedup, near-dedup, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bpe import encode_documents
from cairn.llm.common import read_table, written
from cairn.llm.line_dedup import line_dedup
from cairn.llm.minhash import near_duplicates
from cairn.llm.mixing import mix
from cairn.llm.toxicity import score_toxicity, train

REJECT_FROM = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of REJECT_FROM or more go."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where(F.col("score") < REJECT_FROM).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; a document stays, even if nothing is left of its text."""
    out = line_dedup(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays. Documents without a doc_id stay, as nothing can name them."""
    kept = near_duplicates(docs).where(F.col("kept")).select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, repeats included."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, how many, and whether decoding gives the text back."""
    out = encode_documents(docs)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("MinHash near-dedup", near_dedup), ("mixing sources to target weights", mixture), ("BPE encoding and decoding", encoding)]
#: SQL expresses neither the factorization machine, nor the signatures, the draws or the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
