"""A stored trigram index: postings (gram, chunk_id, tf, dl) in parts by repository shard and gram bucket.

Texts are cut once, when they are indexed: counting a chunk's trigrams needs no shuffle, as they all stand in its row. A
search opens the buckets of the grams it asks for; a phrase is verified only in the texts of chunks that hold all its grams.
Replacing a repository rewrites its shard's parts. N, n and avgdl are those of all indexed chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.snapshots import Change, Snapshots

BUCKETS, SHARDS, ROWS = 64, 4, 400_000
_MASK = np.uint64((1 << 21) - 1)


def codes_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text, three code points of 21 bits each in a number, and how often each occurs."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return c[:0], np.zeros(0, np.int64)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:], return_counts=True)


def _grams(codes: np.ndarray) -> pa.Array:
    """The trigrams of codes as strings."""
    distinct, at = np.unique(codes, return_inverse=True)
    points = np.stack([distinct >> np.uint64(42), (distinct >> np.uint64(21)) & _MASK, distinct & _MASK], 1).astype("<u4")
    strings = np.ascontiguousarray(points).view("<U3")[:, 0].tolist() if len(points) else []
    for i in np.flatnonzero(points[:, 2] == 0) if len(points) else ():  # numpy drops NUL at the end
        strings[i] = "".join(map(chr, points[i]))
    return pa.array(strings, pa.string()).take(pa.array(at))


def gram_rows(chunks: DataFrame, *keep: str) -> DataFrame:
    """(chunk_id, keep..., gram, tf, dl): how often each chunk's lower-cased text holds each trigram, and its number of trigrams.

    chunk_id names a row; null and short texts give no rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, held, codes, tf, rows = batch.drop_columns(["low"]), [], [], [], []
            for i, text in enumerate(batch.column("low")):
                u, n = codes_of(text.as_py() or "")
                if not len(u):
                    continue
                rows.append(np.full(len(u), i))
                codes.append(u)
                tf.append(n)
                held.append(np.full(len(u), n.sum()))
                if sum(map(len, rows)) > ROWS or len(rows) % 512 == 0:
                    yield made(given, rows, codes, tf, held)
                    rows, codes, tf, held = [], [], [], []
            if rows:
                yield made(given, rows, codes, tf, held)

    def made(given: pa.RecordBatch, rows: list, codes: list, tf: list, held: list) -> pa.RecordBatch:
        out = given.take(pa.array(np.concatenate(rows)))
        return pa.RecordBatch.from_arrays([*out.columns, _grams(np.concatenate(codes)), pa.array(np.concatenate(tf)), pa.array(np.concatenate(held))], [*given.schema.names, "gram", "tf", "dl"])

    given = chunks.select("chunk_id", *keep, F.lower("text").alias("low"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "low")
    return given.mapInArrow(count, f"{kinds}, gram string, tf long, dl long")


class PostingIndex:
    """Postings, lengths and texts of chunks (chunk_id, repo_id, text) as tables of a snapshot store."""

    def __init__(self, store: Snapshots, buckets: int = BUCKETS, shards: int = SHARDS):
        self.store, self.buckets, self.shards = store, buckets, shards
        self._shard = F.pmod(F.xxhash64("repo_id"), F.lit(shards))

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets))

    def changes(self, chunks: DataFrame, only: tuple[str, ...] | None = None) -> dict[str, Change]:
        """What indexing ``chunks`` writes; the store's commit takes it together with other tables' changes."""
        rows = chunks.select("chunk_id", "repo_id", "text")
        cores = self.store.spark.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() < cores:  # few files: spread the cutting of texts
            rows = rows.repartition(cores)
        length = F.greatest(F.coalesce(F.char_length(F.lower("text")), F.lit(0)) - 2, F.lit(0)).cast("long")
        return {
            "postings": Change(gram_rows(rows, "repo_id"), {"shard": self._shard, "bucket": self._bucket(F.col("gram"))}, only, ("gram",)),
            "indexed": Change(rows.withColumn("dl", length), {"shard": self._shard}, only, ("chunk_id",)),
        }

    def build(self, chunks: DataFrame) -> int:
        return self.store.commit(self.changes(chunks))

    def replacing(self, repos: DataFrame, fresh: DataFrame) -> dict[str, Change]:
        """The changes that replace all chunks of ``repos`` (repo_id) by those that ``fresh`` has of them. Rewrites their shards only."""
        touched = tuple(str(r[0]) for r in repos.select(self._shard.alias("s")).distinct().collect())  # as many as shards, at most
        if not touched:
            return {}
        old = self.store.read("indexed", lambda v: v["shard"] in touched).drop("dl")
        same = lambda a, b: a.join(b.select(F.col("repo_id").alias("_r")).distinct(), F.col("repo_id").eqNullSafe(F.col("_r")), "left_anti")
        own = fresh.select(*old.columns).join(repos.select(F.col("repo_id").alias("_r")).distinct(), F.col("repo_id").eqNullSafe(F.col("_r")), "left_semi")
        # postings of the shard's other repositories are kept as they are
        kept = same(self.store.read("postings", lambda v: v["shard"] in touched), repos)
        out = self.changes(same(old, repos).unionByName(own), touched)
        posted = out["postings"]
        return out | {"postings": Change(kept.unionByName(gram_rows(own, "repo_id")), posted.by, touched, posted.order)}

    def replace(self, repos: DataFrame, fresh: DataFrame) -> int:
        return self.store.commit(self.replacing(repos, fresh))

    def chunks(self) -> DataFrame:
        return self.store.read("indexed")

    def statistics(self) -> DataFrame:
        """One row: number of indexed chunks and their mean length."""
        return self.chunks().agg(F.count("*").alias("total"), F.avg("dl").alias("mean"))

    def asked(self, grams: DataFrame) -> DataFrame:
        """The postings of the grams (gram); only their buckets are opened."""
        wanted = grams.select("gram").distinct()
        buckets = {str(r[0]) for r in wanted.select(self._bucket(F.col("gram")).alias("b")).distinct().collect()}  # as many as buckets, at most
        return self.store.read("postings", lambda v: v["bucket"] in buckets).join(wanted, "gram", "left_semi")

    def holding_all(self, grams: DataFrame) -> DataFrame:
        """Indexed chunks, with text and length, that hold every one of the grams (gram)."""
        n = grams.select("gram").distinct().count()
        held = self.asked(grams).groupBy("chunk_id").agg(F.count("*").alias("n")).where(F.col("n") == n).select("chunk_id")
        return self.chunks().join(held, "chunk_id", "left_semi")
