"""The derived layer of patterns: what clusters across repositories become, replaced as a whole in one version of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import clustering as C
from cairn.operators.postings import PostingIndex
from cairn.sources.snapshots import Change, Snapshots
from cairn.sources.tables import checkpointed

# Fixed value: the title of a pattern whose members have none.
UNTITLED = "跨仓复用模式"


def pattern_key(ids: Column) -> Column:
    """The key of a cluster by the sorted ids of its cards."""
    return F.concat(F.lit("cluster-"), F.substring(F.sha1(F.array_join(F.array_sort(ids), "|").cast("binary")), 1, 10))


def pattern_id(key: Column) -> Column:
    return F.concat(F.lit("pat_"), F.substring(F.sha1(key.cast("binary")), 1, 16))


def _in_order(rows: DataFrame, value: str) -> DataFrame:
    """(cluster, value, first): each value of a cluster once, with the place where it first stands."""
    return rows.groupBy("cluster", value).agg(F.min("first").alias("first"))


def pattern_rows(members: DataFrame) -> DataFrame:
    """(cluster, pattern_id, key, title, tags, card_count, repo_count) of members (cluster, card_id, repo_id, title, tags).

    The key hashes the ids of all cards, so those of one cluster meet in a row; nothing else of its members does.
    """
    base = members.groupBy("cluster").agg(pattern_key(F.collect_set(F.col("card_id").cast("string"))).alias("key"), F.count_distinct("card_id").alias("card_count"), F.count_distinct("repo_id").alias("repo_count"))
    tags = members.select("cluster", "card_id", F.posexplode("tags").alias("i", "tag")).select("cluster", "tag", F.struct("card_id", "i").alias("first"))
    tags = _in_order(tags, "tag").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))), lambda x: x.tag).alias("tags"))
    rows = base.join(C.shortest_title(members), "cluster", "left").join(tags, "cluster", "left")
    return rows.select("cluster", pattern_id(F.col("key")).alias("pattern_id"), "key", F.coalesce("title", F.lit(UNTITLED)).alias("title"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "card_count", "repo_count")


def pattern_layer(members: DataFrame, scores: DataFrame, budget: int = C.UNIT_BUDGET) -> dict[str, DataFrame]:
    """The tables patterns, pattern_members, pattern_intents and pattern_chunks.

    Members (cluster, card_id, repo_id, title, tags, text, intent, producer) are those of the clusters that are kept, scores
    (cluster, card_id, score) may hold more. Intents of a pattern stand once, in order of the first card that has them. A
    chunk's text joins its members' texts within ``budget`` units; a pattern without text has no chunk.
    """
    rows = checkpointed(pattern_rows(members))
    named = rows.select("cluster", "pattern_id")
    intents = members.where(F.coalesce("intent", F.lit("")) != "").select("cluster", F.col("intent").alias("text"), F.col("card_id").alias("first"))
    stripped = members.select("cluster", "card_id", F.btrim("text", F.lit(" \t\r\n\x0b\x0c")).alias("text"))
    text = C.within_budget(stripped, budget).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("card_id", "text"))), lambda x: x.text), "; ").alias("text"))
    named_producers = members.select("cluster", F.nullif(F.col("producer"), F.lit("")).alias("producer"))
    chunks = rows.join(text, "cluster").join(C.majority(named_producers, "cluster", "producer"), "cluster", "left")
    null = lambda c: F.lit(None).cast("string").alias(c)
    return {
        "patterns": rows.drop("cluster"),
        "pattern_members": named.join(members.select("cluster", "card_id"), "cluster").join(scores.select("card_id", "score"), "card_id").select("pattern_id", "card_id", "score"),
        "pattern_intents": _in_order(intents, "text").join(named, "cluster").select("pattern_id", "text", F.col("first").alias("card_id")),
        "pattern_chunks": chunks.select(F.concat(F.lit("pattern~"), "key").alias("chunk_id"), F.lit("pattern").alias("kind"), F.col("pattern_id").alias("ref_id"), null("card_id"), "text", null("repo_id"), null("language"), F.col("title").alias("heading"), "producer"),
    }


def layer_changes(store: Snapshots, layer: dict[str, DataFrame], base: int, by: dict[str, Column], index: PostingIndex | None = None) -> dict[str, Change]:
    """What replaces the whole layer: its three tables, and among the chunks those of patterns, the only ones without a repository."""
    out = {name: Change(layer[name]) for name in ("patterns", "pattern_members", "pattern_intents")}
    fresh = layer["pattern_chunks"]
    if "chunks" in store.manifest(base)["schemas"]:
        none = store.spark.range(1).select(F.lit(None).cast("string").alias("repo_id")).select(by["shard"].cast("string")).first()[0]
        old = store.read("chunks", lambda v: v["shard"] == none, base)
        extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema if f.name not in fresh.columns]
        out["chunks"] = Change(old.where("kind <> 'pattern'").unionByName(fresh.select("*", *extra).select(*old.columns)), by, (none,))
        if index:
            out |= index.replacing(store.spark.createDataFrame([(None,)], "repo_id string"), fresh)
    else:
        out["pattern_chunks"] = Change(fresh)
    return out


def ordered_ids(cards: DataFrame) -> DataFrame:
    """``cards`` with a number ``n`` that grows with card_id, for ids of any kind; drawn once, with the written rows."""
    return checkpointed(cards.repartitionByRange("card_id").sortWithinPartitions("card_id").withColumn("n", F.monotonically_increasing_id()))


def recluster(store: Snapshots, vectors: DataFrame, by: dict[str, Column], threshold: float = C.THRESHOLD, index: PostingIndex | None = None) -> dict[str, int]:
    """Derives the layer anew from the store's newest version and vectors (chunk_id, vec) of its card chunks, and replaces it.

    Reusable cards with a vector take part, in order of card_id; kept are clusters over at least two sources. The version
    that the layer was derived from is in the manifest's meta. Raises ``Conflict`` if another writer commits meanwhile.
    """
    base = store.version()
    read = lambda name: store.read(name, None, base)
    cards = read("cards").where("reusable").join(vectors.select("chunk_id", "vec"), F.concat(F.lit("card~"), "card_id") == F.col("chunk_id"))
    cards = cards.join(read("analyses").select("analysis_id", "producer"), "analysis_id").join(read("features").select("feature_id", "intent"), "feature_id", "left")
    repos = read("repos")
    known = [F.col(c) if c in repos.columns else F.lit(None).cast("string") for c in ("fork_of", "identity_key")]
    groups = repos.select("repo_id", C.source_group(*known, F.col("repo_id")).alias("g"))
    cards = cards.join(groups, "repo_id", "left").withColumn("source_group", F.coalesce("g", "repo_id"))
    cards = ordered_ids(cards.select("card_id", "vec", "repo_id", "source_group", "title", "tags", F.col("mechanism_desc").alias("text"), "intent", "producer"))
    flat = cards.select(F.col("n").alias("card_id"), "vec")
    found = checkpointed(C.block_clusters(flat, threshold))
    members = checkpointed(C.spanning(found.withColumnRenamed("card_id", "n").join(cards.drop("vec"), "n")))
    scores = C.scores_within(members.select("cluster", F.col("n").alias("card_id")), flat).withColumnRenamed("card_id", "n").select("n", "score")
    layer = pattern_layer(members, scores.join(cards.select("n", "card_id"), "n").drop("n"))
    store.commit(layer_changes(store, layer, base, by, index), base, {"patterns_of": base})
    seen = found.agg(F.count_distinct("cluster").alias("c"), F.count("*").alias("n")).first()
    return {"patterns": store.read("patterns").count(), "clusters_seen": seen.c, "cards_considered": seen.n}
