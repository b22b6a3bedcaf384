"""Helpers that the operators of this subpackage share: table access, written intermediates, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words and that are stripped from line keys: space and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset, in local mode only, a temporary one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/cairn-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df``, whose ``rows`` rows are counted, in no more tasks than one for ``each`` rows and one for each core: a small table needs few."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with Arrow batches of at most ``rows`` rows from here on unless the session says otherwise: texts are large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(rows))
    return df


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores added until no column of the tables is called so."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. For pure ASCII lower() does the same and is much faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where body uses it inside further lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` words of a text; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
