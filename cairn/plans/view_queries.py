"""Registered queries on views, registration, host metadata and imports, each with its SQL.

Repositories, analyses, features and cards stand in as nation, customer, orders and lineitem, patterns as part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import catalog as K
from cairn.operators import fulltext as X
from cairn.operators import importing as I
from cairn.operators import registration as R
from cairn.operators import views as V
from cairn.plans.search_queries import CHUNKS, _UNITS, chunks
from cairn.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_MEMBERS = "SELECT l_partkey AS pattern_id, l_orderkey AS card_id, max(round(1 - l_discount, 2)) AS score, min(l_suppkey % 5) AS source FROM lineitem GROUP BY 1, 2"


def _cards(spark: SparkSession, d: str) -> DataFrame:
    language = F.when(F.col("o_orderstatus") == "O", F.lower("o_orderpriority"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("card_id"), F.col("o_orderkey").alias("feature_id"), F.col("o_orderstatus").alias("kind"), F.concat(F.lit("card "), F.col("o_orderkey").cast("string")).alias("title"), language.alias("language"), (F.col("o_orderkey") % 2 == 0).alias("reusable"), F.col("o_orderpriority").alias("mechanism_desc"), F.lit("[]").alias("code_spans"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("pattern_id"), F.col("l_orderkey").alias("card_id")).agg(F.max(F.round(1 - F.col("l_discount"), 2)).alias("score"), F.min(F.col("l_suppkey") % 5).alias("source"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("feature_id"), F.col("o_custkey").alias("analysis_id"), F.col("o_orderpriority").alias("slug"))


def _analyses(spark: SparkSession, d: str) -> DataFrame:
    producer = F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("analysis_id"), F.col("c_nationkey").alias("repo_id"), producer.alias("producer"))


@query(f"""
WITH m AS ({_MEMBERS}), c AS (SELECT o_orderkey AS card_id, CASE WHEN o_orderstatus = 'O' THEN lower(o_orderpriority) END AS language FROM orders),
p AS (SELECT pattern_id, count(*) AS card_count, count(DISTINCT source) AS repo_count FROM m GROUP BY 1)
SELECT pattern_id, card_count, repo_count, min(score) AS min_score, coalesce(string_agg(DISTINCT language, ',' ORDER BY language), '') AS languages,
       CAST(row_number() OVER (ORDER BY card_count DESC, repo_count DESC, pattern_id) AS BIGINT) AS place, CAST((SELECT count(*) FROM p) AS BIGINT) AS total
FROM p JOIN m USING (pattern_id) LEFT JOIN c USING (card_id) GROUP BY pattern_id, card_count, repo_count""")
def pattern_list(spark, d):
    m = _members(spark, d)
    patterns = m.groupBy("pattern_id").agg(F.count("*").alias("card_count"), F.count_distinct("source").alias("repo_count"))
    return V.pattern_list(patterns, m, _cards(spark, d)).select("pattern_id", "card_count", "repo_count", "min_score", F.array_join("languages", ",").alias("languages"), F.col("place").cast("long").alias("place"), "total")


@query(f"""
SELECT pattern_id, card_id, score, o_custkey AS analysis_id, n_name, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY score DESC, card_id) AS BIGINT) AS place
FROM ({_MEMBERS}) JOIN orders ON o_orderkey = card_id JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON n_nationkey = c_nationkey""")
def pattern_members(spark, d):
    repos = table(spark, d, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("repo_id"), "n_name")
    rows = V.member_rows(_members(spark, d).drop("source"), _cards(spark, d), _features(spark, d), _analyses(spark, d), repos)
    return rows.select("pattern_id", "card_id", "score", "analysis_id", "n_name", F.col("place").cast("long").alias("place"))


@query("SELECT l_orderkey AS card_id, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS patterns FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def card_patterns(spark, d):
    members = table(spark, d, "lineitem").select(F.col("l_partkey").alias("pattern_id"), F.col("l_orderkey").alias("card_id"))
    patterns = table(spark, d, "part").select(F.col("p_partkey").alias("pattern_id"), F.col("p_brand").alias("key"))
    return V.patterns_of_cards(members, patterns).select("card_id", F.array_join("patterns", ",").alias("patterns"))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the conversations' turns: a conversation is a report, a role a feature, and equal turn numbers modulo 3 a title."""
    turns = table(spark, d, "conversations").withColumn("title", F.concat(F.lit("t"), (F.col("turn") % 3).cast("string")))
    card = F.struct("title", F.array(F.md5(F.col("text").cast("binary"))).alias("tags"))
    features = turns.groupBy("conv_id", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", card.alias("c")))), lambda x: x.c).alias("cards"))
    reports = features.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("role").alias("key"), "cards"))).alias("features"))).alias("report_json"))
    cards = turns.select(F.concat_ws("_", "conv_id", "turn").alias("card_id"), F.concat_ws("_", "conv_id", "role").alias("feature_id"), "title")
    own = turns.select(F.concat_ws("_", "conv_id", "role").alias("feature_id"), F.col("conv_id").alias("analysis_id"), F.col("role").alias("slug")).distinct()
    return V.report_tags(cards, own, reports.withColumnRenamed("conv_id", "analysis_id"))


@query("SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS card_id, first_value(md5(text)) OVER (PARTITION BY conv_id, role, turn % 3 ORDER BY turn) AS tags FROM conversations")
def card_tags(spark, d):
    return _tags(spark, d).select("card_id", F.array_join("tags", ",").alias("tags"))


@query("""
WITH e AS (SELECT doc_id AS card_id, lang AS path, n_chars AS a FROM documents UNION ALL SELECT doc_id, source, n_chars % 7 FROM documents WHERE doc_id % 2 = 0)
SELECT o_orderkey AS card_id, o_orderstatus AS kind, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS producer, c_nationkey AS repo_id, count(path) AS pieces, arg_min(path, (path, a)) AS first_path
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN e ON e.card_id = o_orderkey GROUP BY ALL""")
def card_views(spark, d):
    docs = table(spark, d, "documents").withColumn("card_id", F.col("doc_id"))
    piece = lambda df, path, a: df.select("card_id", F.col(path).alias("evidence_id"), F.col(path).alias("path"), a.cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    evidence = piece(docs, "lang", F.col("n_chars")).unionByName(piece(docs.where("doc_id % 2 = 0"), "source", F.col("n_chars") % 7))
    cards = _cards(spark, d)
    lineage = cards.select("card_id", "feature_id").join(_features(spark, d), "feature_id").join(_analyses(spark, d), "analysis_id").select("card_id", "repo_id", "producer")
    tags = cards.select("card_id", F.array("kind").alias("tags"))
    return V.card_view(cards, evidence, tags, lineage, "full").select("card_id", "kind", "producer", "repo_id", F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("pieces"), F.col("source.path").alias("first_path"))


@query("SELECT o_orderkey AS card_id, c_nationkey AS repo_id, embedding[1]::DOUBLE AS x FROM orders JOIN embeddings ON vec_id = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 0")
def reusable_cards(spark, d):
    vectors = table(spark, d, "embeddings").select(F.concat(F.lit("card~"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("embedding").alias("vec"))
    return V.reusable_cards(_cards(spark, d), vectors, _features(spark, d), _analyses(spark, d)).select("card_id", "repo_id", F.col("vec")[0].cast("double").alias("x"))


@query("SELECT c_custkey AS repo_id, c_name AS repo_full_name, c_acctbal < 0 AS is_stale, (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P') AS analyzed_sha, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS aliases FROM customer")
def repo_summaries(spark, d):
    null = lambda *names: {n: F.lit(None).cast("string") for n in names}
    aliases = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.array("c_name")))
    repos = table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("full_name"), (F.col("c_acctbal") < 0).alias("is_stale"), F.lit(None).cast("boolean").alias("is_fork"), aliases.alias("aliases_json"))
    repos = repos.withColumns(null("url", "host", "language", "stars", "license", "head_sha", "fork_of", "merged_into", "subpath", "source", "cloned_at"))
    status = F.when(F.col("o_orderstatus") == "P", "begun").otherwise("committed")
    analyses = table(spark, d, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("analysis_id"), F.col("o_orderkey").alias("commit_sha"), status.alias("status"), F.col("o_orderdate").alias("finished_at"))
    return V.repo_summary(repos, analyses).select("repo_id", "repo_full_name", "is_stale", "analyzed_sha", F.size("aliases").alias("aliases"))


@query("""
WITH old AS (SELECT c_custkey AS repo_id, c_name AS full_name, 'k' || CAST(c_custkey AS VARCHAR) AS k, c_mktsegment AS head FROM customer WHERE c_custkey % 3 > 0),
ref AS (
  SELECT c_custkey AS repo_id, c_name AS full_name, 'k' || CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'moved' END AS head FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey + 1000000, 'new ' || c_name, 'k' || CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 1),
t AS (SELECT ref.*, coalesce(s.repo_id, o.repo_id, ref.repo_id) AS target, s.repo_id IS NULL AND o.repo_id IS NOT NULL AS merged FROM ref LEFT JOIN old s ON s.repo_id = ref.repo_id LEFT JOIN old o ON o.k = ref.k AND s.repo_id IS NULL)
SELECT coalesce(old.repo_id, t.target) AS repo_id, coalesce(t.full_name, old.full_name) AS full_name, coalesce(old.head <> t.head, false) AS is_stale,
       CASE WHEN coalesce(merged AND old.full_name <> t.full_name, false) THEN old.full_name ELSE '' END AS aliases,
       CASE WHEN t.target IS NULL THEN 'kept' WHEN old.repo_id IS NULL THEN 'new' WHEN merged THEN 'merged' ELSE 'refreshed' END AS action
FROM old FULL JOIN t ON old.repo_id = t.target""")
def register_repos(spark, d):
    c = table(spark, d, "customer")
    row = lambda df, i, name, head: df.select(i.alias("repo_id"), name.alias("full_name"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("identity_key"), head.alias("head_sha"), F.lit(False).alias("is_stale"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("long").alias("stars"))
    key, name, head = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    refs = row(c.where("c_custkey % 2 = 0"), key, name, F.when(F.col("c_acctbal") > 0, head).otherwise("moved"))
    refs = refs.unionByName(row(c.where("c_custkey % 5 = 0 AND c_custkey % 2 = 1"), key + 1000000, F.concat(F.lit("new "), name), head))
    return R.registered(row(c.where("c_custkey % 3 > 0"), key, name, head), refs).select("repo_id", "full_name", "is_stale", F.array_join("aliases", ",").alias("aliases"), "action")


_PAYLOAD = """CASE event_id % 4 WHEN 0 THEN '{"id": ' || CAST(event_id AS VARCHAR) || ', "fork": true, "parent": {"full_name": "a/b"}, "stargazers_count": 7, "license": {"spdx_id": "NOASSERTION"}, "description": "  x "}'
 WHEN 1 THEN '{"id": "text", "fork": false, "parent": {"full_name": "a/b"}, "license": {"spdx_id": "MIT"}, "description": " ", "stargazers_count": "9"}' WHEN 2 THEN 'no json' ELSE props END"""


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id END AS numeric_id, CASE event_id % 4 WHEN 0 THEN 'a/b' END AS fork_of, CASE event_id % 4 WHEN 0 THEN 7 END::BIGINT AS stars,
 CASE event_id % 4 WHEN 1 THEN 'MIT' END AS license, CASE event_id % 4 WHEN 0 THEN 'x' END AS description, CASE WHEN event_id % 4 <> 0 THEN 'no id from the host' END AS reason FROM events""")
def host_metadata(spark, d):
    rows = table(spark, d, "events").select("event_id", R.host_metadata(F.expr(_PAYLOAD.replace("VARCHAR", "STRING"))).alias("m"))
    return rows.select("event_id", *[F.col(f"m.{c}").alias(c) for c in ("numeric_id", "fork_of", "stars", "license", "description", "reason")])


@query("SELECT l_orderkey AS card_id, CAST(least(count(*), 6) AS BIGINT) AS pieces, min(l_returnflag) AS first_path FROM lineitem GROUP BY 1")
def import_evidence(spark, d):
    evidence = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("card_id"), F.col("l_returnflag").alias("path"), F.col("l_linenumber").alias("start_line"), F.lit(0).alias("end_line"))
    return I.evidence_by_card(evidence, I.MOST_EVIDENCE).select("card_id", F.size("evidence").cast("long").alias("pieces"), F.col("evidence")[0].getField("path").alias("first_path"))


@query("SELECT source AS key FROM documents WHERE source <> '' UNION SELECT c_name FROM customer UNION SELECT lang FROM documents WHERE lang <> ''")
def import_keys(spark, d):
    docs = table(spark, d, "documents")
    return I.source_keys(docs.select(F.col("source").alias("key")), table(spark, d, "customer").select(F.col("c_name").alias("key")), docs.select(F.col("lang").alias("key")))


@query("""
WITH p AS (SELECT l_orderkey, l_returnflag || CAST(l_linenumber % 3 AS VARCHAR) AS p, min((l_linenumber, l_returnflag)) AS i FROM lineitem WHERE l_orderkey % 7 > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS r FROM p)
SELECT o.l_orderkey AS feature_id, coalesce(string_agg(p, ',' ORDER BY r), 'report.md') AS entry_points
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN r ON r.l_orderkey = o.l_orderkey AND r <= 8 GROUP BY 1""")
def import_entry_points(spark, d):
    path = F.when(F.col("l_orderkey") % 7 > 0, F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")))
    paths = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("feature_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", path.alias("p")))), lambda x: x.p).alias("paths"))
    return paths.select("feature_id", F.array_join(I.entry_points(F.col("paths"), F.lit("report.md")), ",").alias("entry_points"))


@query(f"""SELECT conv_id AS report_id, min(u) AS principle_units_min FROM (SELECT conv_id, {_UNITS.format('text')} AS u FROM conversations) GROUP BY conv_id""")
def principle_units(spark, d):
    from cairn.functions.text import units

    return V.least_units(table(spark, d, "conversations").select(F.col("conv_id").alias("report_id"), F.col("turn").alias("axis"), units(F.col("text")).cast("long").alias("units")))


@query("SELECT (SELECT count(*) FROM orders) AS analyses, (SELECT count(*) FROM documents) AS chunks, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM documents) AS embedders, (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM documents WHERE lang <> 'en') AS mismatched")
def reindex_report(spark, d):
    docs = table(spark, d, "documents")
    vectors = docs.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("embedder"))
    out = V.reindex_summary(table(spark, d, "orders").select("o_orderkey"), docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("repo_id")), vectors, "en")
    return out.select("analyses", "chunks", F.array_join("embedders", ",").alias("embedders"), F.array_join("mismatched", ",").alias("mismatched"))


@query(f"SELECT 0::BIGINT AS count, 'no hits after the filter' AS note, count(*) AS candidates FROM ({CHUNKS}) WHERE language = 'fr'")
def empty_result_note(spark, d):
    among = X.candidates(chunks(spark, d), language="fr")
    return V.search_note(among.where(F.contains("text", F.lit("zzqqxx never there"))), among, filtered=True)


@query("""
WITH b AS (SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN source || '-2' ELSE source END AS base FROM documents)
SELECT count(*) AS n, count(DISTINCT doc_id) AS keys, count(DISTINCT base) AS own FROM b""")
def unique_keys_colliding(spark, d):
    """Bases of which some end like the suffix of others; keys are distinct all the same, and each base keeps its name for one row."""
    base = F.when(F.col("doc_id") % 5 == 4, F.concat("source", F.lit("-2"))).otherwise(F.col("source"))
    rows = K.unique_keys(table(spark, d, "documents").select("doc_id", base.alias("base")), "base", "doc_id")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.count_distinct("base").alias("own"))
