"""Repository registration: host metadata as records, new and known repositories, renames merged, stale analyses marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_metadata(payload: Column) -> Column:
    """The record that a host's JSON answer gives; fields of another type than expected are null, and ``reason`` says why an identity is missing."""
    v = F.try_parse_json(payload)
    of = lambda path, kind: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == ("BIGINT" if kind == "bigint" else "STRING" if kind == "string" else "BOOLEAN"), F.try_variant_get(v, path, kind))
    fork, licence = of("$.fork", "boolean"), of("$.license.spdx_id", "string")
    number = of("$.id", "bigint")
    return F.struct(
        number.alias("numeric_id"), fork.alias("fork"), F.when(fork, of("$.parent.full_name", "string")).alias("fork_of"), of("$.stargazers_count", "bigint").alias("stars"),
        F.when(~licence.isin("", "NOASSERTION"), licence).alias("license"), F.nullif(F.trim(of("$.description", "string")), F.lit("")).alias("description"),
        of("$.default_branch", "string").alias("default_branch"), F.when(number.isNull(), "no id from the host").alias("reason"),
    )


def registered(repos: DataFrame, refs: DataFrame) -> DataFrame:
    """The repositories after registering ``refs`` (one row per repo_id), with the ``action`` taken: 'kept', 'new', 'refreshed' or 'merged'.

    Both tables are (repo_id, full_name, identity_key, head_sha, is_stale, aliases, stars). A ref whose identity another known
    repository has is a rename: that repository keeps its id, takes the new name and head, and its old name joins the aliases.
    Another head than before marks what was analysed as stale; a mark is never taken back here. Unknown stars stay known ones.
    So does a ref of a known id, if another repository has its identity. Of several refs of one identity the one with the greatest
    repo_id counts. A null identity is no identity, and one that ``refs`` calls ``degraded`` (made up from the name, as the host
    did not answer) never merges. Where both tables have them, url, host and language become those of the ref, and an unknown
    license or description stays the known one.
    """
    taken, kept = ([c for c in names if c in repos.columns and c in refs.columns] for names in (("url", "host", "language"), ("license", "description")))
    known = repos.select(F.col("repo_id").alias("owner_id"), F.col("identity_key").alias("owner_key"))
    sure = refs.where(~F.coalesce("degraded", F.lit(False))) if "degraded" in refs.columns else refs
    other = sure.join(known, (F.col("identity_key") == F.col("owner_key")) & (F.col("repo_id") != F.col("owner_id")))
    owner = other.groupBy(F.col("repo_id").alias("ref_id")).agg(F.min("owner_id").alias("owner"))
    met = refs.join(owner, F.col("repo_id") == F.col("ref_id"), "left")
    met = met.withColumn("target", F.coalesce("owner", "repo_id")).withColumn("merged", F.col("owner").isNotNull())
    latest = met.groupBy("target").agg(F.max_by(F.struct("full_name", "identity_key", "head_sha", "stars", "merged", *taken, *kept), "repo_id").alias("r"))
    both = repos.join(latest, repos["repo_id"] == latest["target"], "full")
    is_known, touched = repos["repo_id"].isNotNull(), F.col("r").isNotNull()
    moved = F.coalesce(F.col("head_sha") != F.col("r.head_sha"), F.lit(False))
    old_names = F.coalesce("aliases", F.array().cast("array<string>"))
    renamed = F.coalesce(F.col("r.merged") & (F.col("full_name") != F.col("r.full_name")), F.lit(False))
    return both.select(
        F.coalesce("repo_id", "target").alias("repo_id"),
        F.coalesce("r.full_name", "full_name").alias("full_name"),
        F.coalesce("identity_key", "r.identity_key").alias("identity_key"),
        F.coalesce("r.head_sha", "head_sha").alias("head_sha"),
        (F.coalesce("is_stale", F.lit(False)) | moved).alias("is_stale"),
        F.when(renamed, F.array_append(F.array_remove(old_names, F.col("full_name")), F.col("full_name"))).otherwise(old_names).alias("aliases"),
        F.coalesce("r.stars", "stars").alias("stars"),
        *[F.when(touched, F.col(f"r.{c}")).otherwise(F.col(c)).alias(c) for c in taken],
        *[F.coalesce(f"r.{c}", c).alias(c) for c in kept],
        F.when(~touched, "kept").when(~is_known, "new").when(F.col("r.merged"), "merged").otherwise("refreshed").alias("action"),
    )
