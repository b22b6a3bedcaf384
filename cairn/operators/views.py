"""What callers are shown: cards at three levels of detail, patterns with their members, repository summaries, notes.

All views are joins and aggregates over whole tables; a caller filters or limits what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import chunk_id

# Fixed values.
BRIEF = ("card_id", "kind", "title", "language", "producer", "repo_id")
NORMAL = (*BRIEF, "mechanism_desc", "tags", "source")
FULL = (*NORMAL, "evidence", "code_spans")
SUMMARY = (
    "repo_id", "repo_full_name", "url", "host", "language", "stars", "license", "head_sha", "analyzed_sha", "is_stale", "is_fork", "fork_of", "merged_into", "aliases", "subpath", "source", "cloned_at",
)
DETAIL = {"brief": BRIEF, "normal": NORMAL, "full": FULL}


def member_rows(members: DataFrame, cards: DataFrame, features: DataFrame, analyses: DataFrame, repos: DataFrame) -> DataFrame:
    """Members (pattern_id, card_id, score) with their card, feature, analysis and, where it is known, repository, and their ``place`` by score."""
    rows = members.join(cards, "card_id").join(features, "feature_id").join(analyses, "analysis_id").join(repos, "repo_id", "left")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("score"), "card_id")))


def patterns_of_cards(members: DataFrame, patterns: DataFrame) -> DataFrame:
    """(card_id, patterns): the keys of the patterns that a card is a member of, sorted."""
    return members.join(patterns.select("pattern_id", "key"), "pattern_id").groupBy("card_id").agg(F.array_sort(F.collect_set("key")).alias("patterns"))


def pattern_list(patterns: DataFrame, members: DataFrame, cards: DataFrame) -> DataFrame:
    """Patterns with the least score and the languages of their members, their place in the list and how many there are.

    The list goes by card_count and repo_count, both descending, then pattern_id. Cards without a language say nothing; a
    pattern without members has a null min_score and no languages.
    """
    known = members.join(cards.select("card_id", F.nullif("language", F.lit("")).alias("language")), "card_id", "left")
    facts = known.groupBy("pattern_id").agg(F.min("score").alias("min_score"), F.array_sort(F.collect_set("language")).alias("languages"))
    rows = patterns.join(facts, "pattern_id", "left").withColumn("languages", F.coalesce("languages", F.array().cast("array<string>")))
    order = [F.desc("card_count"), F.desc("repo_count"), F.asc("pattern_id")]
    total = patterns.agg(F.count("*").alias("total"))  # one row
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(total))


def report_tags(cards: DataFrame, features: DataFrame, reports: DataFrame) -> DataFrame:
    """(card_id, tags): the tags that the report gives the first card of that title under the feature's key."""
    body = F.from_json("report_json", "struct<features:array<struct<key:string,cards:array<struct<title:string,tags:array<string>>>>>>")
    found = reports.select("analysis_id", F.posexplode(body.getField("features")).alias("fi", "f")).select("analysis_id", "fi", F.col("f.key").alias("slug"), F.posexplode("f.cards").alias("ci", "c"))
    found = found.groupBy("analysis_id", "slug", F.col("c.title").alias("title")).agg(F.min_by("c.tags", F.struct("fi", "ci")).alias("tags"))
    own = cards.select("card_id", "feature_id", "title").join(features.select("feature_id", "analysis_id", "slug"), "feature_id")
    return own.join(found, ["analysis_id", "slug", "title"], "left").select("card_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def card_view(cards: DataFrame, evidence: DataFrame, tags: DataFrame, lineage: DataFrame, detail: str = "normal") -> DataFrame:
    """Cards at a level of detail: 'brief', 'normal' or 'full'. A producer that is not known is null, which to_json leaves out.

    ``lineage`` is (card_id, repo_id, producer); ``source`` is the first piece of evidence.
    """
    if detail not in DETAIL:
        raise ValueError(f"detail must be one of {', '.join(DETAIL)}")
    rows = cards.join(lineage, "card_id", "left")
    if detail != "brief":
        piece = F.struct("evidence_id", "path", "start_line", "end_line")
        proof = evidence.groupBy("card_id").agg(F.array_sort(F.collect_list(piece)).alias("evidence"))
        rows = rows.join(proof, "card_id", "left").join(tags, "card_id", "left").withColumn("source", F.get("evidence", F.lit(0)))
    return rows.select(*DETAIL[detail])


def reusable_cards(cards: DataFrame, vectors: DataFrame, features: DataFrame, analyses: DataFrame) -> DataFrame:
    """Reusable cards that have a vector and a known analysis, as clustering takes them: with repo_id, producer and vec."""
    own = cards.where("reusable").withColumn("chunk_id", chunk_id("card", F.col("card_id")))
    found = own.join(vectors.select("chunk_id", "vec"), "chunk_id").join(features.select("feature_id", "analysis_id"), "feature_id").join(analyses.select("analysis_id", "repo_id", "producer"), "analysis_id")
    return found.select("card_id", "feature_id", "repo_id", "producer", "title", F.coalesce("mechanism_desc", F.lit("")).alias("mechanism_desc"), "vec")


def repo_summary(repos: DataFrame, analyses: DataFrame) -> DataFrame:
    """The fixed 17 fields of each repository; analyzed_sha is that of the latest committed analysis."""
    done = analyses.where("status = 'committed'").groupBy("repo_id").agg(F.max_by("commit_sha", F.struct("finished_at", "analysis_id")).alias("analyzed_sha"))
    rows = repos.withColumnRenamed("full_name", "repo_full_name").join(done, "repo_id", "left")
    aliases = F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>"))
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_stale", "is_fork")}
    return rows.withColumns({**flags, "aliases": aliases}).select(*SUMMARY)


def search_note(hits: DataFrame, candidates: DataFrame, filtered: bool) -> DataFrame:
    """One row (count, note): why a search found nothing, null if it found something."""
    note = F.when(F.col("count") > 0, F.lit(None).cast("string")).otherwise("no hits after the filter" if filtered else "no match in the library")
    n = candidates.agg(F.count("*").alias("candidates"))
    return hits.agg(F.count("*").alias("count")).withColumn("note", note).join(F.broadcast(n))


def reindex_summary(analyses: DataFrame, chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """One row: how many analyses and chunks there are, the embedders in use, and the repositories with another one than ``model``."""
    other = vectors.where(F.col("embedder") != model).join(chunks.select("chunk_id", "repo_id"), "chunk_id")
    parts = [analyses.agg(F.count("*").alias("analyses")), chunks.agg(F.count("*").alias("chunks")), vectors.agg(F.array_sort(F.collect_set("embedder")).alias("embedders")), other.agg(F.array_sort(F.collect_set("repo_id")).alias("mismatched"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))  # one row each
    return out


def least_units(units: DataFrame) -> DataFrame:
    """(report_id, principle_units_min) of the units of each axis (report_id, axis, units)."""
    return units.groupBy("report_id").agg(F.min("units").alias("principle_units_min"))


def capped(value: Column, most: int) -> Column:
    return F.slice(value, 1, most)
