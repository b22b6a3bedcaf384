"""Catalogue export: one JSON document per repository and pattern, with unsafe ids left out and named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def exportable(repos: DataFrame) -> DataFrame:
    """Repositories whose id is a file name as it stands."""
    return repos.where((safe_name(F.col("repo_id")) == F.col("repo_id")) & ~F.col("repo_id").rlike(r"^\.*$"))


def repo_documents(repos: DataFrame, analyses: DataFrame) -> DataFrame:
    """(repo_id, document): each exportable repository with its analyses, newest first; repositories without any stay."""
    item = F.struct(F.coalesce(F.col("finished_at").cast("string"), F.lit("")).alias("at"), F.col("analysis_id").alias("id"), F.col("status").alias("status"))
    lists = analyses.groupBy("repo_id").agg(F.sort_array(F.collect_list(item), asc=False).alias("analyses"))
    rows = exportable(repos).join(lists, "repo_id", "left")
    fields = [c for c in sorted(repos.columns)]
    latest = F.get(F.col("analyses"), F.lit(0)).id
    return rows.select("repo_id", F.to_json(F.struct(*fields, F.col("analyses"), latest.alias("latest"))).alias("document"))


def skipped(repos: DataFrame) -> DataFrame:
    """(repo_id): what ``exportable`` leaves out."""
    return repos.select("repo_id").join(exportable(repos).select("repo_id"), "repo_id", "left_anti")


def pattern_documents(patterns: DataFrame) -> DataFrame:
    """(pattern_id, place, document): patterns, their ``place`` sorting those of most repositories and cards first, then by title."""
    place = F.struct((-F.col("repo_count")).alias("repos"), (-F.col("card_count")).alias("cards"), F.lower("title").alias("title"), "pattern_id")
    fields = F.struct("pattern_id", "key", "title", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "card_count", "repo_count")
    return patterns.select("pattern_id", place.alias("place"), F.to_json(fields).alias("document"))


def member_documents(members: DataFrame, cards: DataFrame, repos: DataFrame) -> DataFrame:
    """(pattern_id, card_id, score, document): a line for each member card that exists, as patterns may have any number.

    ``file`` is the page of the card's repository, null where that is not exported: no link rather than a dead one.
    """
    page = exportable(repos).select("repo_id", F.concat("repo_id", F.lit(".html")).alias("file"))
    rows = members.select("pattern_id", "card_id", "score").join(cards.select("card_id", "repo_id", "kind", "title", "summary", "symbol"), "card_id")
    rows = rows.join(repos.select("repo_id", F.col("full_name").alias("repo_full_name")), "repo_id", "left").join(page, "repo_id", "left")
    fields = F.struct("pattern_id", "card_id", "score", "kind", "title", "summary", "symbol", "repo_id", "repo_full_name", "file", F.concat(F.lit("card-"), safe_name(F.col("card_id"))).alias("anchor"))
    return rows.select("pattern_id", "card_id", "score", F.to_json(fields).alias("document"))


def catalogue(repos: DataFrame, analyses: DataFrame, cards: DataFrame, patterns: DataFrame, members: DataFrame, about: dict[str, Column]) -> DataFrame:
    """(part, id, document): the whole catalogue as lines. One 'header' holds ``about`` (schema name, time, embedder, threshold)
    and the numbers of exported repositories, analyses, cards and patterns; then each 'repo', 'pattern', 'member' and 'skipped' id."""
    counts = {"repos": exportable(repos), "analyses": analyses, "cards": cards, "patterns": patterns}
    sizes = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counts.items()]
    sizes = sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(sizes[3])
    stats = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("stats")  # four entries
    line = lambda df, part, id_, document: df.select(F.lit(part).alias("part"), id_.cast("string").alias("id"), document.alias("document"))
    header = sizes.agg(stats).select(F.to_json(F.struct(*[v.alias(k) for k, v in about.items()], "stats")).alias("document"))
    out = line(header, "header", F.lit(""), F.col("document"))
    out = out.unionByName(line(repo_documents(repos, analyses), "repo", F.col("repo_id"), F.col("document")))
    out = out.unionByName(line(pattern_documents(patterns), "pattern", F.col("pattern_id"), F.col("document")))
    out = out.unionByName(line(member_documents(members, cards, repos), "member", F.concat_ws("/", "pattern_id", "card_id"), F.col("document")))
    return out.unionByName(line(skipped(repos), "skipped", F.col("repo_id"), F.to_json(F.struct("repo_id"))))


def write_catalogue(documents: DataFrame, folder: str) -> None:
    """JSON lines, ordered by repository name without regard to case."""
    documents.orderBy(F.lower("repo_id"), "repo_id").select("document").write.mode("overwrite").text(folder)
