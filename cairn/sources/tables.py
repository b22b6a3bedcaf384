"""Table access, written intermediates and snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where that is unset, in local mode only, a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Options for rows of which each may be large: readers take a row group at most at once, of up to 4,096 rows otherwise.
WIDE = {"parquet.block.row.count.limit": "32", "compression": "zstd"}


def checkpointed(df: DataFrame, wide: bool = False) -> DataFrame:
    """The rows, written to the shared folder and read back; ``wide`` keeps few of them in memory at once."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.options(**(WIDE if wide else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_known: list[str] = (), append: list[str] = ()) -> DataFrame:
    """A snapshot after inserting or updating ``new``: its values win, but null in keep_known columns keeps the old value,
    and arrays in append columns are joined, each element once. Keys must be unique in both."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    is_new = F.col(f"n.{keys[0]}").isNotNull()

    def value(c: str):
        if c in keys:
            return F.coalesce(f"n.{c}", f"o.{c}").alias(c)
        if c in append:
            both = F.concat(F.coalesce(f"o.{c}", F.array().cast(old.schema[c].dataType)), F.coalesce(f"n.{c}", F.array().cast(old.schema[c].dataType)))
            return F.array_distinct(both).alias(c)
        if c in keep_known:
            return F.coalesce(f"n.{c}", f"o.{c}").alias(c)
        return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*[value(c) for c in old.columns])


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], root: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """Snapshots after deleting the rows of ``root`` whose key is in ``doomed``, and all rows below them.

    ``links`` are (parent, parent key, child, child key), parents first; doomed has the root's first column.
    """
    gone = {root: tables[root].join(doomed, doomed.columns, "left_semi")}
    for parent, parent_key, child, child_key in links:
        if parent in gone:
            keys = gone[parent].select(F.col(parent_key).alias(child_key)).distinct()
            gone[child] = tables[child].join(keys, child_key, "left_semi")
    out = {}
    for name, df in tables.items():
        if name == root:
            out[name] = df.join(doomed, doomed.columns, "left_anti")
        elif name in gone:
            _, parent_key, _, child_key = next(x for x in links if x[2] == name)
            parent = next(x[0] for x in links if x[2] == name)
            out[name] = df.join(gone[parent].select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
        else:
            out[name] = df
    return out


def with_columns_of(df: DataFrame, schema) -> DataFrame:
    """``df`` with every column of the schema, null where it had none, in its order: additive migration."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
