"""Catalogue queries: the latest analysis, counts and statistics, lineage, orphans, renames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import json_flag

#: Parts that the right rows of each key come in.
OVERLAP_PARTS = 12


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order, which should end with a unique column."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def newest_first(analyses: DataFrame) -> list[Column]:
    return [F.desc_nulls_last("finished_at"), F.desc_nulls_last("created_at"), F.asc("analysis_id")]


def latest_committed(analyses: DataFrame) -> DataFrame:
    return latest(analyses.where(F.col("status") == "committed"), "repo_id", *newest_first(analyses))


def lineage(repos: DataFrame, analyses: DataFrame, features: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards with their feature, analysis and, where it is known, repository."""
    return cards.join(features, "feature_id").join(analyses, "analysis_id").join(repos, "repo_id", "left")


def counts_per(parent: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """The parents with the number of rows each child table has for them, 0 where it has none."""
    for name, child in children.items():
        parent = parent.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").fillna(0, [name])
    return parent


def by_producer(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy(F.coalesce("producer", F.lit("unknown")).alias("producer")).agg(F.count("*").alias("analyses"))


def code_mismatches(analyses: DataFrame) -> DataFrame:
    """Sum of the mismatch counts in the quality JSON, and how many analyses have any."""
    n = F.coalesce(F.get_json_object("quality_json", "$.code_mismatch").try_cast("long"), F.lit(0))
    return analyses.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.count_if(n > 0).alias("non_zero_analyses"))


def card_statistics(cards: DataFrame) -> DataFrame:
    pending = json_flag(F.col("quality_json"), "$.pending")
    return cards.agg(F.count("*").alias("cards"), F.count_if("reusable").alias("reusable"), F.count_if(pending).alias("pending"))


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of every table given and, of ``cards``, how many are reusable and how many wait for a description.

    An empty table counts 0; each table is read once.
    """
    out = None
    for name, df in tables.items():
        figures = {name: F.count("*")}
        if name == "cards":
            figures |= {"reusable_cards": F.count_if("reusable"), "pending_mechanism": F.count_if(F.coalesce(json_flag(F.col("quality_json"), "$.pending"), F.lit(False)))}
        one = df.agg(F.map_from_arrays(F.array(*map(F.lit, figures)), F.array(*figures.values())).alias("m")).select(F.explode("m").alias("name", "n"))
        out = one if out is None else out.unionByName(one)
    return out


def missing(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return rows.join(known.select(key), key, "left_anti")


def renamed(repos: DataFrame) -> DataFrame:
    """(repo_id, other_id, identity_key): repositories that share an identity under another id, the smaller id first."""
    other = repos.select(F.col("repo_id").alias("other_id"), "identity_key")
    return repos.select("repo_id", "identity_key").join(other, "identity_key").where("repo_id < other_id")


def embedder_mismatch(vectors: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """Repositories with vectors of another embedder."""
    return vectors.where(F.col("embedder") != model).join(chunks.select("chunk_id", "repo_id"), "chunk_id").select("repo_id").distinct()


def key_overlap(left: DataFrame, right: DataFrame, left_keys: str, right_keys: str) -> DataFrame:
    """Pairs of rows whose key arrays share an element, each once.

    Rows that agree but for their keys are one. Each key's rows on the right come in parts, and the left's meet each of
    them, so that frequent keys go to many tasks; a pair comes from its least common key, so pairs are neither kept nor compared.
    """
    def sets(df: DataFrame, keys: str, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != keys]
        own = df.select(*rest, F.explode(keys).alias(name)).where(F.col(name).isNotNull())
        return own.groupBy(*rest).agg(F.array_sort(F.collect_set(name)).alias(name))

    a, b = sets(left, left_keys, "_l"), sets(right, right_keys, "_r")
    parts = F.lit(OVERLAP_PARTS)
    a = a.withColumn("_k", F.explode("_l")).withColumn("_p", F.explode(F.sequence(F.lit(0), parts - 1)))
    b = b.withColumn("_p", F.pmod(F.xxhash64(*[c for c in b.columns if c != "_r"]), parts).cast("int")).withColumn("_k", F.explode("_r"))
    # hashed joins keep one side of a key in memory; sorted ones would write and sort both
    met = a.hint("shuffle_hash").join(b, ["_k", "_p"])
    return met.where((F.size("_l") == 1) | (F.size("_r") == 1) | (F.array_min(F.array_intersect("_l", "_r")) == F.col("_k"))).drop("_k", "_p", "_l", "_r")


def matching_repos(repos: DataFrame, text: str | None = None, language: str | None = None, stale: bool | None = None) -> DataFrame:
    """Catalogue filter: text is a LIKE pattern body, matched without regard to ASCII case."""
    if text:
        repos = repos.where(F.col("repo_id").ilike(f"%{text}%") | F.col("full_name").ilike(f"%{text}%"))
    if language:
        repos = repos.where(F.col("language") == language)
    if stale is not None:
        repos = repos.where(F.col("is_stale") == stale)
    return repos


def matching_patterns(patterns: DataFrame, query: str) -> DataFrame:
    """Patterns whose title, key, a tag or an intent contains the query."""
    q = F.lit(query.lower())
    has = lambda c: F.contains(F.lower(c), q)
    return patterns.where(has(F.col("title")) | has(F.col("key")) | F.exists("tags", has) | F.exists("intents", has))


def keep_newest(files: DataFrame, most: int, max_bytes: int) -> DataFrame:
    """The newest ``most`` files of each group, and of these from the newest on as long as their sizes sum up to max_bytes at most."""
    order = Window.partitionBy("group").orderBy(F.desc("at"), F.desc("id"))
    rows = files.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return rows.withColumn("running", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("running") <= max_bytes)


def unique_keys(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Adds ``key``: the base for its first row in ``order``, then the first of base-2, base-3 and so on that no row before has.

    Bases that could meet, as they agree up to suffixes of digits, are settled together, one after the other, in one group;
    the others get their number from a window.
    """
    stem = F.regexp_replace(F.col(base), "(-[0-9]+)+$", "")
    plain = Window.partitionBy(base).orderBy(order)
    mixed = rows.select(stem.alias("stem"), base).where(F.col(base) != F.col("stem")).select("stem").distinct()
    rows = rows.withColumn("stem", stem)
    place = F.row_number().over(plain)
    alone = rows.join(mixed, "stem", "left_anti").withColumn("key", F.when(place == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), place.cast("string"))))

    def settle(t: pd.DataFrame) -> pd.DataFrame:
        used, following, keys = set(), {}, []
        t = t.sort_values(order, kind="stable")
        for name in t[base]:
            n, key = following.get(name, 2), name
            while key in used:
                key, n = f"{name}-{n}", n + 1
            following[name] = n
            used.add(key)
            keys.append(key)
        return t.assign(key=keys)

    met = rows.join(mixed, "stem", "left_semi")
    met = met.groupBy("stem").applyInPandas(settle, met.withColumn("key", F.lit("")).schema)
    return alone.unionByName(met).drop("stem")


def thirds(rows: DataFrame, key: str, order: str, parts: int = 3) -> DataFrame:
    """Adds ``part``: consecutive rows of each key in parts of ceil(n / parts)."""
    w = Window.partitionBy(key)
    return rows.withColumn("part", F.floor((F.row_number().over(w.orderBy(order)) - 1) / F.ceil(F.count("*").over(w) / parts)).cast("int"))
