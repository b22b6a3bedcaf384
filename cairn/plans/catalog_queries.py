"""Registered queries on catalogue, sessions, snapshots, reports, profiles and imports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import catalog as K
from cairn.operators import etl as E
from cairn.operators import importing as I
from cairn.operators import profiling as P
from cairn.operators import sessions as S
from cairn.operators import validation as V
from cairn.plans.search_queries import _UNITS
from cairn.sources import export as O
from cairn.sources import tables as W
from cairn.sources.tables import table
from cairn.streaming.activity import activity_windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _long(*cols: str):
    return [F.col(c).cast("long").alias(c) for c in cols]


# --- repositories, analyses, features, cards and evidence stand in as nation, customer, orders and lineitem


@query("SELECT o_custkey AS repo_id, o_orderkey AS analysis_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_per_repo(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("analysis_id"), F.lit("committed").alias("status"), F.col("o_orderdate").alias("finished_at"), F.col("o_orderdate").alias("created_at"))
    return K.latest_committed(rows).select("repo_id", "analysis_id")


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS features, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS cards FROM customer WHERE c_name ILIKE '%1%'")
def repo_catalog(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    repos = table(spark, d, "customer").select("c_custkey", "c_name")
    return K.counts_per(K.matching_repos(repos.withColumns({"repo_id": F.lit(""), "full_name": F.col("c_name")}), text="1").drop("repo_id", "full_name"), "c_custkey", features=orders, cards=lines)


@query("SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM orders) AS analyses, (SELECT count(*) FROM lineitem) AS evidence, (SELECT count(*) FILTER (quality = 1) FROM labels) AS reusable, (SELECT count(*) FILTER (toxic = 1) FROM labels) AS pending")
def kb_stats(spark, d):
    n = lambda name, alias: table(spark, d, name).agg(F.count("*").alias(alias))
    cards = table(spark, d, "labels").select((F.col("quality") == 1).alias("reusable"), F.to_json(F.struct((F.col("toxic") == 1).alias("pending"))).alias("quality_json"))
    out = n("documents", "chunks")
    for name, alias in (("embeddings", "vectors"), ("orders", "analyses"), ("lineitem", "evidence")):
        out = out.join(F.broadcast(n(name, alias)))  # one row each
    return out.join(F.broadcast(K.card_statistics(cards).select("reusable", "pending")))


@query("SELECT coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, 'unknown') AS producer, count(*) AS analyses FROM orders GROUP BY 1")
def producer_counts(spark, d):
    return K.by_producer(table(spark, d, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("producer")))


@query("SELECT coalesce(sum(k), 0)::BIGINT AS total, count(*) FILTER (k > 0) AS non_zero_analyses FROM (SELECT coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)")
def code_mismatch_sum(spark, d):
    return K.code_mismatches(table(spark, d, "events").select(F.regexp_replace("props", '"k"', '"code_mismatch"').alias("quality_json")))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, o_custkey, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON n_nationkey = c_nationkey")
def lineage_left(spark, d):
    repos = table(spark, d, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("repo_id"), "n_name")
    analyses = table(spark, d, "customer").select(F.col("c_custkey").alias("analysis_id"), F.col("c_nationkey").alias("repo_id"), "c_name")
    features = table(spark, d, "orders").select(F.col("o_orderkey").alias("feature_id"), F.col("o_custkey").alias("analysis_id"))
    cards = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("feature_id"), "l_linenumber")
    return K.lineage(repos, analyses, features, cards).select(F.col("feature_id").alias("l_orderkey"), *_long("l_linenumber"), F.col("analysis_id").alias("o_custkey"), "c_name", "n_name")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unknown(spark, d):
    return K.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT vec_id AS doc_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, d):
    return K.missing(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), table(spark, d, "labels"), "doc_id")


@query("SELECT a.c_custkey AS repo_id, b.c_custkey AS other_id FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND floor(a.c_acctbal / 100) = floor(b.c_acctbal / 100) AND a.c_custkey < b.c_custkey")
def rename_detect(spark, d):
    key = F.concat_ws("#", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100))
    return K.renamed(table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), key.alias("identity_key"))).select("repo_id", "other_id")


@query("SELECT DISTINCT p_partkey, s_suppkey FROM part JOIN supplier ON list_contains([p_size % 10, p_partkey % 10], s_nationkey % 10) AND p_brand = 'Brand#12'")
def key_overlap_join(spark, d):
    part = table(spark, d, "part").where("p_brand = 'Brand#12'").select("p_partkey", F.array(F.col("p_size") % 10, F.col("p_partkey") % 10).alias("keys"))
    return K.key_overlap(part, table(spark, d, "supplier").select("s_suppkey", F.array((F.col("s_nationkey") % 10).cast("long")).alias("own")), "keys", "own")


@query("SELECT event_id FROM (SELECT *, sum(bytes) OVER (PARTITION BY grp ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT event_id, event_type AS grp, ts, CAST(floor(abs(value)) AS BIGINT) + 1 AS bytes, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20) WHERE run <= 400")
def lru_keep(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("group"), F.col("ts").alias("at"), (F.floor(F.abs("value")) + 1).alias("bytes"))
    return K.keep_newest(rows, 20, 400).select(F.col("id").alias("event_id"))


@query("SELECT doc_id, CASE WHEN r = 1 THEN lang || '-' || source ELSE lang || '-' || source || '-' || CAST(r AS VARCHAR) END AS key FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents)")
def unique_keys(spark, d):
    return K.unique_keys(table(spark, d, "documents").select("doc_id", F.concat_ws("-", "lang", "source").alias("base")), "base", "doc_id").select("doc_id", "key")


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // CAST(ceil(count(*) OVER (PARTITION BY source) / 3.0) AS BIGINT) AS INTEGER) AS part FROM documents")
def thirds(spark, d):
    return K.thirds(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "part")


@query("SELECT DISTINCT source AS repo_id FROM documents WHERE lang <> 'en'")
def embedder_mismatch(spark, d):
    docs = table(spark, d, "documents")
    return K.embedder_mismatch(docs.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("embedder")), docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("repo_id")), "en")


@query("SELECT source AS key, count(*) AS cards FROM documents WHERE contains(lower(source), 'src1') OR len(list_filter([lang], lambda t: contains(lower(t), 'src1'))) > 0 GROUP BY source")
def pattern_text_filter(spark, d):
    p = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("cards"), F.collect_set("lang").alias("tags")).select(F.col("source").alias("key"), F.col("source").alias("title"), "tags", F.array("source").alias("intents"), "cards")
    return K.matching_patterns(p, "SRC1").select("key", "cards")


# --- texts


@query("SELECT doc_id, string_split(text, chr(10) || '## ')[1] = text AS whole, CAST(len(string_split('## ' || replace(text, chr(10), chr(10) || '## '), chr(10) || '## ')) AS BIGINT) AS n FROM documents")
def h2_sections(spark, d):
    md = F.concat(F.lit("## "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n## ")))
    return table(spark, d, "documents").select("doc_id", (F.size(T.h2_sections(F.col("text"))) == 0).alias("whole"), F.size(T.h2_sections(md)).cast("long").alias("n"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host, regexp_replace(regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', ''), '[.]git$', '') AS norm, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slug_url_host(spark, d):
    return table(spark, d, "pages").select("page_id", T.hostname(F.col("url")).alias("host"), T.normalised_url(F.col("url")).alias("norm"), T.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, substr(sha1(source || '|' || CAST(doc_id AS VARCHAR)), 1, 16) AS analysis_id, sha256(text) AS fingerprint, 'card~' || CAST(doc_id AS VARCHAR) || '~3' AS chunk_id FROM documents")
def ids_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.short_hash(F.col("source"), F.col("doc_id").cast("string")).alias("analysis_id"), F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"), T.chunk_id("card", F.col("doc_id"), F.lit(3)).alias("chunk_id"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k') IN ('1', 'true'), false) AS pending FROM events")
def json_pending(spark, d):
    return table(spark, d, "events").select("event_id", T.json_flag(F.col("props"), "$.k").alias("pending"))


@query("SELECT doc_id, CASE WHEN length(t) > 240 THEN substr(t, 1, 240) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)")
def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT page_id, replace(replace(url, '~', '~0'), '/', '~1') AS token FROM pages")
def pointer_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", T.pointer_token(F.col("url")).alias("token"))


@query("SELECT page_id, 'f' || regexp_extract(k, '_([0-9]+)_([0-9]+)$', 1) || '-c' || regexp_extract(k, '_([0-9]+)_([0-9]+)$', 2) AS anchor FROM (SELECT page_id, 'a_' || CAST(page_id % 5 AS VARCHAR) || '_' || CAST(page_id AS VARCHAR) AS k FROM pages)")
def card_anchors(spark, d):
    return table(spark, d, "pages").select("page_id", T.card_anchor(F.concat_ws("_", F.lit("a"), F.col("page_id") % 5, "page_id")).alias("anchor"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS i, gram FROM (SELECT doc_id, gram, min(i) AS r FROM (SELECT doc_id, i, substr(t, i, 3) AS gram FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents), LATERAL (SELECT unnest(range(1, greatest(length(t) - 1, 1))) AS i)) GROUP BY ALL)")
def trigrams_in_order(spark, d):
    out = table(spark, d, "documents").select("doc_id", F.posexplode(T.trigrams(F.col("text"))).alias("p", "gram"))
    return out.select("doc_id", (F.col("p") + 1).cast("long").alias("i"), "gram")


# --- sessions

_SESSIONS = """SELECT user_id AS session_id, user_id % 10 AS repo_id, CASE count(*) % 6 WHEN 0 THEN 'begun' WHEN 1 THEN 'evidence_taken' WHEN 2 THEN 'drafting' WHEN 3 THEN 'validated' WHEN 4 THEN 'committed' ELSE 'abandoned' END AS state,
 min(ts) AS created_at, max(ts) AS expires_at, CASE WHEN count(*) % 6 = 5 THEN max(ts) END AS abandoned_at, count(*) AS turns FROM events GROUP BY user_id"""
NOW = "TIMESTAMP '2024-01-30 12:00:00'"


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    state = F.get(F.array(*[F.lit(s) for s in S.STATES]), (n % 6).cast("int"))
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(state.alias("state"), F.min(ts).alias("created_at"), F.max(ts).alias("expires_at"), F.when(n % 6 == 5, F.max(ts)).alias("abandoned_at"), n.alias("turns"))
    return rows.withColumns({"repo_id": F.col("session_id") % 10, "tool_calls": F.lit(1).cast("long"), "tokens_est": F.col("turns") * 10, "commit_sha": F.concat(F.lit("c"), (F.col("session_id") % 2).cast("string"))})


@query(f"""
WITH s AS ({_SESSIONS}), x AS (SELECT *, state NOT IN ('abandoned', 'committed') AND expires_at <= {NOW} AS expired FROM s)
SELECT session_id, CASE WHEN NOT expired AND state = 'abandoned' AND epoch({NOW}) - epoch(coalesce(abandoned_at, expires_at)) >= 86400 THEN 'delete' WHEN expired THEN 'archive' ELSE 'keep' END AS action, CASE WHEN expired THEN state END AS outcome FROM x""")
def session_sweep(spark, d):
    return S.swept(_sessions(spark, d), F.expr(NOW), 86400).select("session_id", "action", "outcome")


@query(f"WITH s AS ({_SESSIONS}), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, session_id) AS k FROM s WHERE state NOT IN ('committed', 'abandoned')) SELECT repo_id, session_id FROM r WHERE k = 1 AND session_id % 2 = 1")
def session_resume(spark, d):
    return S.resumable(_sessions(spark, d), F.lit("c1")).select("repo_id", "session_id")


@query(f"WITH s AS ({_SESSIONS}), a AS (SELECT state AS outcome, turns, 1 AS tool_calls, turns * 10 AS tokens_est, greatest(0, CAST(floor(epoch({NOW})) - floor(epoch(created_at)) AS BIGINT)) AS wall_seconds FROM s) SELECT outcome, count(*) AS sessions, sum(turns)::BIGINT AS turns, sum(tool_calls)::BIGINT AS tool_calls, sum(tokens_est)::BIGINT AS tokens_est, sum(wall_seconds)::BIGINT AS wall_seconds FROM a GROUP BY ROLLUP (outcome)")
def session_totals(spark, d):
    return S.totals(S.archived(_sessions(spark, d), F.expr(NOW)))


@query("""
WITH s AS (SELECT conv_id, turn, CASE (conv_id + turn * (turn - 1) // 2) % 6 WHEN 0 THEN 'begun' WHEN 1 THEN 'evidence_taken' WHEN 2 THEN 'drafting' WHEN 3 THEN 'validated' WHEN 4 THEN 'committed' ELSE 'abandoned' END AS state FROM conversations),
b AS (SELECT *, lag(state) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM s)
SELECT conv_id, turn, before IS NULL OR before = state OR (before = 'begun' AND state IN ('evidence_taken', 'drafting', 'abandoned')) OR (before = 'evidence_taken' AND state IN ('drafting', 'abandoned'))
  OR (before = 'drafting' AND state IN ('validated', 'abandoned')) OR (before = 'validated' AND state IN ('committed', 'drafting', 'abandoned')) AS allowed FROM b""")
def session_transitions(spark, d):
    state = F.get(F.array(*[F.lit(s) for s in S.STATES]), F.expr("(conv_id + turn * (turn - 1) div 2) % 6").cast("int"))
    steps = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), state.alias("state"))
    return S.check_transitions(steps).select(F.col("session_id").alias("conv_id"), F.col("at").alias("turn"), "allowed")


@query("SELECT user_id AS session_id, count(*) AS turns, CAST(epoch(max(ts)) AS BIGINT) // 1 + 1800 AS expires FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id")
def session_activity(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"), F.lit(1).alias("turns"), F.lit(0).alias("tool_calls"), F.lit(0).alias("tokens"))
    return S.activity(t, 1800).select("session_id", "turns", F.unix_timestamp("expires_at").alias("expires"))


@query()
def token_bucket(spark, d):
    """Every event as a call of its user, one call per hour and three at once."""
    calls = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_id").alias("call_id"))
    return S.admitted(calls, 1 / 3600, 3.0).select("call_id", "key", "admitted")


@query("""
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS began, count(*) AS touches, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""")
def activity_sessions(spark, d):
    """The events as sessions with gaps of 30 minutes; the same operator runs on a stream."""
    out = activity_windows(table(spark, d, "events").select("user_id", "ts", "value"))
    return out.select("user_id", F.unix_micros("began").alias("began"), "touches", F.round("value", 4).alias("value"))


# --- snapshots


@query("SELECT coalesce(n.c_custkey, o.c_custkey) AS id, coalesce(n.seg, o.seg) AS seg, CASE WHEN n.c_custkey IS NOT NULL THEN n.bal ELSE o.bal END AS bal FROM (SELECT c_custkey, c_mktsegment AS seg, c_acctbal AS bal FROM customer WHERE c_nationkey < 15) o FULL JOIN (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) END AS seg, CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE END AS bal FROM customer WHERE c_nationkey > 10) n ON o.c_custkey = n.c_custkey")
def upsert_keep_known(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_nationkey < 15").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    new = c.where("c_nationkey > 10").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.lower("c_mktsegment")).alias("seg"), F.when(F.col("c_acctbal") > 0, 1.0).alias("bal"))
    return W.upsert(old, new, ["id"], keep_known=["seg"])


@query("SELECT 'customer' AS name, count(*) AS rows FROM customer WHERE c_nationkey NOT IN (3, 7) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7)) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7)))")
def cascade_delete_counts(spark, d):
    tables = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    out = W.cascade(tables, [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")], "customer", tables["customer"].where("c_nationkey IN (3, 7)").select("c_custkey"))
    rows = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in out.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT doc_id AS chunk_id, CASE WHEN source IN ('src1', 'src2') THEN md5('v2|' || text) ELSE md5(text) END AS body FROM documents")
def reindex_partition(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("repo_id"), F.md5(F.col("text").cast("binary")).alias("body"))
    fresh = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("repo_id"), F.md5(F.concat(F.lit("v2|"), "text").cast("binary")).alias("body"))
    scope = rows.select("repo_id").distinct().where("repo_id IN ('src1', 'src2')")
    return E.reindexed(rows, fresh, scope).select("chunk_id", "body")


@query("SELECT doc_id, text, NULL::VARCHAR AS heading FROM documents")
def migrate_columns(spark, d):
    from pyspark.sql.types import LongType, StringType, StructType

    return W.with_columns_of(table(spark, d, "documents"), StructType().add("doc_id", LongType()).add("text", StringType()).add("heading", StringType()))


@query("SELECT a.o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'insert' WHEN a.o_orderpriority = b.p THEN 'same' ELSE 'conflict' END AS action FROM orders a LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'changed' ELSE o_orderpriority END AS p FROM orders WHERE o_custkey % 2 = 0) b ON a.o_orderkey = b.o_orderkey")
def commit_actions(spark, d):
    o = table(spark, d, "orders")
    key = [F.col("o_orderkey").cast("string").alias("repo_id"), F.lit("c").alias("commit_sha"), F.lit("1").alias("version")]
    old = o.where("o_custkey % 2 = 0").select(*key, F.when(F.col("o_orderstatus") == "O", "changed").otherwise(F.col("o_orderpriority")).alias("report_json"))
    return E.committed(old, o.select(*key, F.col("o_orderpriority").alias("report_json"))).select(F.col("repo_id").cast("long").alias("o_orderkey"), "action")


# --- reports: every conversation is one, its turns the features

_EMPTY = "array<struct<path:string>>"


def _reports(spark: SparkSession, d: str) -> DataFrame:
    long = F.concat_ws(" ", "text", "text")
    axes = F.struct(F.col("text").alias(V.AXES[0]), F.col("text").alias(V.AXES[1]), long.alias(V.AXES[2]), F.when(F.col("turn") > 0, F.lower("text")).otherwise("TODO").alias(V.AXES[3]), F.reverse("text").alias(V.AXES[4]))
    card = F.struct(F.lit("gotcha").alias("kind"), F.substring("text", 1, 30).alias("title"), F.col("text").alias("summary"), (F.col("role") == "user").alias("reusable"), F.col("text").alias("mechanism_desc"), F.array("role").alias("tags"), F.lit("x").alias("code"), F.array(F.struct(F.lit("a.py").alias("path"), F.lit(3).alias("start_line"), F.lit(5).alias("end_line"))).alias("evidence"), F.array().cast("array<struct<path:string,start_line:int,end_line:int,symbol:string>>").alias("code_spans"))
    feature = F.struct("turn", F.struct(F.concat_ws("-", "role", F.col("turn") % 3).alias("key"), F.substring("text", 1, 12).alias("title"), F.substring("text", 1, 60).alias("summary"), F.substring("text", 1, 24).alias("intent"), axes.alias("principles"), F.array().cast(_EMPTY).alias("evidence"), F.array(card).alias("cards"), F.when(F.col("turn") == 2, "odd").alias("extra~1/x")).alias("f"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(feature)).alias("fs"))
    report = F.struct(F.when(F.col("conv_id") % 5 == 0, "other/1").otherwise("report/1").alias("schema_id"), F.lit("one").alias("one_liner"), F.array().cast(_EMPTY).alias("characteristics"), F.array().cast(_EMPTY).alias("entry_points"), F.array().cast(_EMPTY).alias("cross_feature_risks"), F.transform("fs", lambda x: x.f).alias("features"))
    return rows.select(F.col("conv_id").alias("report_id"), F.to_json(report).alias("report_json"))


_U = _UNITS
_SIG = "lower(translate(t, '" + T.AXIS_NOISE.replace("'", "''") + "', ''))"
_BLANK = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))) IN ('', 'n/a', 'na', '无', '未知', '待补充', 'todo', 'tbd', '???')"
_AX = "SELECT conv_id, turn, unnest([text, text, text || ' ' || text, CASE WHEN turn > 0 THEN lower(text) ELSE 'TODO' END, reverse(text)]) AS t, unnest([0, 1, 2, 3, 4]) AS axis FROM conversations"


@query(f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, turn % 3 ORDER BY turn) AS dup FROM conversations), ax AS ({_AX}),
p AS (
  SELECT conv_id, unnest(['missing_field', 'missing_field', 'missing_field']) AS code FROM (SELECT DISTINCT conv_id FROM c)
  UNION ALL SELECT conv_id, 'bad_enum' FROM (SELECT DISTINCT conv_id FROM c) WHERE conv_id % 5 = 0
  UNION ALL SELECT conv_id, 'too_few_features' FROM c GROUP BY conv_id HAVING count(*) < 3
  UNION ALL SELECT conv_id, 'unknown_field' FROM c WHERE turn = 2
  UNION ALL SELECT conv_id, 'duplicate_feature_key' FROM c WHERE dup > 1
  UNION ALL SELECT conv_id, 'principle_too_short' FROM c WHERE {_U.format('substr(text, 1, 12)')} < 3
  UNION ALL SELECT conv_id, 'principle_too_short' FROM c WHERE {_U.format('substr(text, 1, 60)')} < 12
  UNION ALL SELECT conv_id, 'principle_too_short' FROM c WHERE substr(text, 1, 24) <> '' AND {_U.format('substr(text, 1, 24)')} < 5
  UNION ALL SELECT conv_id, 'missing_field' FROM c
  UNION ALL SELECT conv_id, 'blank_principle' FROM ax WHERE {_BLANK.format('t')}
  UNION ALL SELECT conv_id, 'principle_too_short' FROM ax WHERE NOT {_BLANK.format('t')} AND {_U.format('t')} < 40
  UNION ALL SELECT conv_id, 'axis_reuse' FROM (SELECT conv_id, turn, count(DISTINCT {_SIG}) AS n FROM ax WHERE {_SIG} <> '' GROUP BY ALL) WHERE n < 4
  UNION ALL SELECT conv_id, 'principle_too_short' FROM c WHERE {_U.format('substr(text, 1, 30)')} < 3
  UNION ALL SELECT conv_id, 'principle_too_short' FROM c WHERE {_U.format('text')} < 12
  UNION ALL SELECT conv_id, 'principle_too_short' FROM c WHERE {_U.format('text')} < 20)
SELECT conv_id AS report_id, code, count(*) AS n FROM p GROUP BY conv_id, code""")
def validate_reports(spark, d):
    return V.problems(W.checkpointed(_reports(spark, d))).groupBy("report_id", "code").agg(F.count("*").alias("n"))


@query(f"""
WITH ax AS (SELECT * FROM ({_AX}) WHERE NOT {_BLANK.format('t')}),
a AS (SELECT conv_id, count(*) AS axes, count(DISTINCT {_SIG}) AS sigs FROM ax GROUP BY conv_id),
c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS re FROM conversations GROUP BY conv_id)
SELECT c.conv_id AS report_id, n AS features, n AS cards, n AS evidence, round(coalesce(axes, 0) / (n * 5.0), 4)::DOUBLE AS axis_completeness, 1.0::DOUBLE AS evidence_coverage, coalesce(round(sigs / axes::DOUBLE, 4), 0)::DOUBLE AS axis_diversity, round(re / n::DOUBLE, 4)::DOUBLE AS reusable_rate FROM c LEFT JOIN a ON a.conv_id = c.conv_id""")
def quality_ratios(spark, d):
    return V.ratios(W.checkpointed(_reports(spark, d)))


@query("SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS feature_id, turn AS position, role || '-' || CAST(turn % 3 AS VARCHAR) AS slug, CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) || '_0' AS card_id, substr(text, 1, 30) AS card_title, role = 'user' AS reusable, 5::INTEGER AS end_line FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, turn AS t FROM conversations)")
def flatten_reports(spark, d):
    rows = E.flattened(_reports(spark, d).select(F.col("report_id").cast("string").alias("analysis_id"), "report_json"))
    out = rows["features"].join(rows["cards"].select("card_id", "feature_id", F.col("title").alias("card_title"), "reusable"), "feature_id").join(rows["evidence"].select("card_id", "end_line"), "card_id")
    return out.select("feature_id", F.col("position").cast("long").alias("position"), "slug", "card_id", "card_title", "reusable", "end_line")


@query()
def report_chunks(spark, d):
    """Chunks of all conversation reports: features, cards and sections."""
    reports = W.checkpointed(_reports(spark, d).select(F.col("report_id").cast("string").alias("analysis_id"), "report_json"))
    rows = E.flattened(reports)
    analyses = E.rendered(reports).withColumns({"repo_id": F.col("analysis_id"), "producer": F.lit("agent")})
    return E.chunks(analyses, rows["features"], rows["cards"]).select("chunk_id", "kind", "ref_id", "text", "repo_id", "heading")


# --- profiles


@query("SELECT repo_id, language FROM (SELECT source AS repo_id, lang AS language, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM (SELECT source, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'go' WHEN 'de' THEN 'rust' ELSE 'javascript' END AS lang, count(*) AS n FROM documents GROUP BY ALL) WHERE true) WHERE r = 1")
def lang_share_main(spark, d):
    ext = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "py", "fr", "go", "de", "rs", "es", "mjs")]), F.col("lang"))
    files = table(spark, d, "documents").select(F.col("source").alias("repo_id"), F.concat(F.lit("src/f"), "doc_id", F.lit("."), ext).alias("path"))
    vendored = files.withColumn("path", F.concat(F.lit("x/node_modules/"), "path"))
    return P.main_language(files.unionByName(vendored))


_PATH = "regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


@query(f"SELECT string_split(p, '/')[1] AS top, count(*) AS files FROM (SELECT {_PATH} AS p FROM pages) GROUP BY 1 ORDER BY files DESC, top LIMIT 100")
def groups_top(spark, d):
    return P.directory_groups(table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path")))


@query(f"SELECT count(*) AS files, count(DISTINCT regexp_extract(p, '^(.*)/[^/]*$', 1)) AS dirs, sum(length(html))::BIGINT AS bytes FROM (SELECT {_PATH} AS p, html FROM pages)")
def pack_stats(spark, d):
    return P.pack_statistics(table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"), F.char_length("html").cast("long").alias("size")))


@query(f"""
WITH f AS (SELECT {_PATH} AS p FROM pages), d AS (SELECT DISTINCT array_to_string(string_split(p, '/')[1:i], '/') AS p FROM f, LATERAL (SELECT unnest(range(1, len(string_split(p, '/')))) AS i))
SELECT type, CAST(len(string_split(p, '/')) AS BIGINT) AS depth, count(*) AS n FROM (SELECT p, 'file' AS type FROM f UNION ALL SELECT p, 'dir' FROM d) GROUP BY 1, 2""")
def tree_levels(spark, d):
    files = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"), F.lit(1).cast("long").alias("size"))
    return P.tree(files).groupBy("type", F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


#: File names of every kind, dealt out over the pages.
_NAMES = "['main.py', '__main__.py', 'app.py', 'manage.py', 'main.go', 'main.rs', 'index.js', 'index.ts', 'server.py', 'server.js', 'server.ts', 'test_a.py', 'a_test.go', 'a.test.js', 'a.test.ts', 'setup.py', 'pyproject.toml', 'package.json', 'Cargo.toml', 'go.mod', 'requirements.txt', 'pom.xml', 'build.gradle', 'Dockerfile.dev', 'Makefile', 'docker-compose.yml', 'docker-compose.yaml', 'README.rst', 'a.md', 'Main.java', 'a.py']"


@query(rf"""
WITH f AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^[a-z]+://([^?#]*)', 1) ELSE CASE WHEN page_id % 3 = 0 THEN 'tests/' WHEN page_id % 5 = 0 THEN 'docs/' ELSE '' END || ({_NAMES})[1 + (page_id // 2) % 31] END AS p, lower(html) AS t FROM pages),
n AS (SELECT *, string_split(p, '/')[-1] AS name FROM f)
SELECT page_id, CASE WHEN name IN ('main.py', '__main__.py', 'app.py', 'manage.py', 'main.go', 'main.rs', 'index.js', 'index.ts') THEN 'main' WHEN name IN ('server.py', 'server.js', 'server.ts') THEN 'server'
  WHEN starts_with(name, 'test_') OR ends_with(name, '_test.go') OR ends_with(name, '.test.js') OR ends_with(name, '.test.ts') OR contains('/' || p, '/tests/') OR contains('/' || p, '/test/') THEN 'test'
  WHEN name IN ('setup.py', 'pyproject.toml', 'package.json', 'Cargo.toml', 'go.mod', 'requirements.txt', 'pom.xml', 'build.gradle') THEN 'config'
  WHEN starts_with(name, 'Dockerfile') OR name IN ('Makefile', 'docker-compose.yml', 'docker-compose.yaml') THEN 'build' WHEN starts_with(lower(p), 'docs/') OR lower(name) = 'readme.rst' OR ends_with(lower(p), '.md') THEN 'docs'
  WHEN regexp_matches(t, 'argparse|click\.command|typer|cobra\.command') THEN 'cli' WHEN regexp_matches(t, 'flask\(|fastapi\(|uvicorn\.run|http\.server|express\(\)|createserver\(|actix_web|axum::') THEN 'server'
  WHEN regexp_matches(t, 'celery|rq\.worker|worker\(|grpc\.server') THEN 'worker' END AS role FROM n""")
def entry_points(spark, d):
    """Every second page by its own path, the others by a file name of each kind, in the root, under tests or under docs."""
    name = F.get(F.expr(_NAMES.replace("[", "array(").replace("]", ")")), F.expr("page_id div 2 % 31").cast("int"))
    folder = F.when(F.col("page_id") % 3 == 0, "tests/").when(F.col("page_id") % 5 == 0, "docs/").otherwise("")
    path = F.when(F.col("page_id") % 2 == 0, F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)).otherwise(F.concat(folder, name))
    return table(spark, d, "pages").select("page_id", P.entry_point(path, F.col("html")).alias("role"))


_ADDRESS = "CASE page_id % 9 WHEN 0 THEN 'https://github.com/' || r || '.git' WHEN 1 THEN 'git@gitlab.com:' || r || '.git' WHEN 2 THEN ' https://GitHub.com/' || r || '/ ' WHEN 3 THEN 'http://github.com/' || r WHEN 4 THEN 'https://bitbucket.org/' || r WHEN 5 THEN 'gitee.com:' || r WHEN 6 THEN 'https://gitee.com/only-owner' WHEN 7 THEN '' ELSE url END"


@query(f"""
WITH p AS (SELECT page_id, url, 'Own.er-' || (page_id % 7) || '/Na_me' || page_id AS r FROM pages), a AS (SELECT page_id, trim({_ADDRESS}) AS u FROM p)
SELECT page_id, CASE WHEN page_id % 9 IN (0, 2) THEN 'github.com' WHEN page_id % 9 = 1 THEN 'gitlab.com' WHEN page_id % 9 = 5 THEN 'gitee.com' END || '__Own.er-' || (page_id % 7) || '__Na_me' || page_id AS repo_id FROM a""")
def repo_addresses(spark, d):
    """Addresses of both forms on allowed and other hosts, with other schemes and without a name."""
    rows = table(spark, d, "pages").selectExpr("page_id", "url", "'Own.er-' || (page_id % 7) || '/Na_me' || page_id AS r").selectExpr("page_id", f"{_ADDRESS} AS u")
    return rows.select("page_id", T.repo_id(T.repo_parts(F.col("u"))).alias("repo_id"))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), m AS (SELECT doc_id, a, CAST((len(a) + 1) // 2 AS BIGINT) AS line FROM l),
b AS (SELECT doc_id, a, line, greatest(line - 40, 1) AS lo, least(line + 40, len(a)) AS hi FROM m WHERE trim(a[line], ' ' || chr(9)) <> ''),
x AS (SELECT *, list_filter(range(lo, line), lambda i: trim(a[i], ' ' || chr(9)) = '') AS up, list_filter(range(line + 1, hi + 1), lambda i: trim(a[i], ' ' || chr(9)) = '') AS down FROM b)
SELECT doc_id, line, coalesce(list_max(up) + 1, lo)::BIGINT AS first, coalesce(list_min(down) - 1, hi)::BIGINT AS last FROM x""")
def blocks_around(spark, d):
    lines = F.split("text", "\n", -1)
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), lines.alias("lines"), F.floor((F.size(lines) + 1) / 2).cast("int").alias("line"))
    return P.block_around(files).select(F.col("path").alias("doc_id"), *_long("line", "first", "last"))


# every document as a source file of its source: a declaration before its text, behind it a comment and another declaration
_CODE = "concat('export class K', doc_id, ' {\n', regexp_replace(text, '(?m)^', '# '), '\n// fn no()\n  pub async fn f_', lang, '(x)')"
_FILE = "'d' || lpad(CAST(doc_id AS VARCHAR(20)), 9, '0') || CASE doc_id % 5 WHEN 0 THEN '/main.rs' WHEN 1 THEN '/x.unknown' ELSE '/a.rs' END"
_PACK = f"""
WITH f AS (SELECT source AS repo_id, doc_id, {_FILE} AS path, length(text) AS size, 4 + length(text) - length(replace(text, chr(10), '')) AS last, lang, row_number() OVER (PARTITION BY source ORDER BY {_FILE}) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
seen AS (SELECT * FROM f WHERE r <= 40),
s AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, line) AS place FROM (SELECT repo_id, path, 1 AS line, 'class' AS kind, 'K' || doc_id AS name FROM seen WHERE doc_id % 5 <> 1 UNION ALL SELECT repo_id, path, last, 'function', 'f_' || lang FROM seen WHERE doc_id % 5 <> 1)),
sym AS (SELECT * FROM s WHERE place <= 50)
"""


def _pack(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("source").alias("repo_id"), F.expr(_FILE).alias("path"), F.char_length("text").cast("long").alias("size"), F.expr("CASE WHEN doc_id % 5 = 1 THEN 'other' ELSE 'rust' END").alias("language"), F.expr(_CODE).alias("text"))
    return P.evidence_pack(rows, P.Profile(40, 50))


@query(_PACK + "SELECT repo_id, path, CAST(line AS BIGINT) AS line, kind, name FROM sym")
def symbols_capped(spark, d):
    """The first 50 symbols of the first 40 files of each source."""
    return _pack(spark, d)["symbols"].select("repo_id", "path", F.col("line").cast("long").alias("line"), "kind", "name")


@query(_PACK + """, k AS (SELECT repo_id, count(*) AS symbols FROM sym GROUP BY repo_id)
SELECT repo_id, count(*) AS files, count(DISTINCT path) AS dirs, sum(size)::BIGINT AS bytes, coalesce(any_value(symbols), 0) AS symbols, max(n) > 40 OR coalesce(any_value(symbols), 0) >= 50 AS truncated, CASE WHEN max(n) > 40 THEN 'max_files' WHEN coalesce(any_value(symbols), 0) >= 50 THEN 'symbol_cap' END AS truncation_reason
FROM seen LEFT JOIN k USING (repo_id) GROUP BY repo_id""")
def pack_stats_capped(spark, d):
    return _pack(spark, d)["stats"]


@query(_PACK + """, full_ AS (SELECT repo_id, path AS last FROM sym WHERE place = 50)
SELECT repo_id, path, 'main' AS role FROM seen LEFT JOIN full_ USING (repo_id) WHERE doc_id % 5 = 0 AND (full_.last IS NULL OR path <= full_.last)""")
def pack_entry_points(spark, d):
    return _pack(spark, d)["entry_points"].where("role = 'main'")


@query("SELECT doc_id, 1::BIGINT AS line, 'class' AS kind, 'K' || CAST(doc_id AS VARCHAR) AS name FROM documents UNION ALL SELECT doc_id, 4 + length(text) - length(replace(text, chr(10), '')), 'function', 'f_' || lang FROM documents")
def declarations(spark, d):
    """Every document as a source file: a declaration before its text, behind it a comment and another declaration."""
    code = F.concat(F.lit("export class K"), F.col("doc_id").cast("string"), F.lit(" {\n"), F.regexp_replace("text", "(?m)^", "# "), F.lit("\n// fn no()\n  pub async fn f_"), "lang", F.lit("(x)"))
    return P.declarations(table(spark, d, "documents").select(F.col("doc_id").alias("path"), code.alias("text"))).select(F.col("path").alias("doc_id"), *_long("line"), "kind", "name")


# --- import

_TYPE = "CASE doc_id % 4 WHEN 0 THEN 'feature_pattern' WHEN 1 THEN 'integration_note' WHEN 2 THEN 'project_characteristic' ELSE 'other' END"


_MARKS = ("", " 陷阱", " Pitfall", " caveat", " 注意")


def _imported(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", F.expr(_TYPE).alias("type"), F.concat("text", F.get(F.array(*map(F.lit, _MARKS)), (F.col("doc_id") % 5).cast("int"))).alias("text"), (F.col("n_chars") % 2 == 0).alias("code"))
    return rows.withColumn("k", I.card_kind(F.col("type"), F.col("text"), F.col("code"))).select("*", "k.kind", "k.rule")


_KIND = f"SELECT *, CASE WHEN type = 'feature_pattern' AND code THEN 'snippet' WHEN type = 'feature_pattern' THEN 'mechanism' WHEN type = 'integration_note' AND (doc_id % 5 IN (1, 2) OR regexp_matches(lower(text), 'gotcha|pitfall|陷阱|踩坑|坑')) THEN 'gotcha' WHEN type = 'integration_note' THEN 'decision' WHEN type = 'project_characteristic' THEN NULL WHEN code THEN 'snippet' ELSE 'mechanism' END AS kind FROM (SELECT doc_id, source, lang, text, {_TYPE} AS type, n_chars % 2 = 0 AS code FROM documents)"


@query(f"SELECT doc_id, kind FROM ({_KIND})")
def import_kinds(spark, d):
    return _imported(spark, d).select("doc_id", "kind")


_DROP = f"SELECT *, CASE WHEN att > 0 AND hit = 0 THEN 'code_mismatch' WHEN kind = 'snippet' AND NOT code THEN 'no_code_span' WHEN att = 0 AND kind IN ('mechanism', 'decision', 'gotcha') THEN 'evidence_missing' WHEN hit = 0 THEN 'evidence_missing' WHEN doc_id % 7 = 0 THEN 'schema_invalid' END AS reason FROM (SELECT *, doc_id % 4 AS att, CASE WHEN doc_id % 4 > 1 THEN doc_id % 3 ELSE 0 END AS hit FROM ({_KIND}) WHERE kind IS NOT NULL)"


def _drops(spark, d) -> DataFrame:
    rows = _imported(spark, d).where("kind IS NOT NULL").withColumns({"attempted": F.col("doc_id") % 4, "hit": F.when(F.col("doc_id") % 4 > 1, F.col("doc_id") % 3).otherwise(0)})
    return rows.withColumn("reason", I.drop_reason(F.col("kind"), F.col("attempted"), F.col("hit"), F.col("code"), F.col("hit"), F.col("doc_id") % 7 != 0))


@query(f"SELECT r.reason, count(x.doc_id) AS n FROM (VALUES ('code_mismatch'), ('no_code_span'), ('evidence_missing'), ('schema_invalid')) r(reason) LEFT JOIN ({_DROP}) x ON x.reason = r.reason GROUP BY r.reason")
def drop_reasons(spark, d):
    return I.reason_counts(_drops(spark, d))


@query(f"SELECT round(sum(hit) / sum(att)::DOUBLE, 4)::DOUBLE AS hit_rate FROM ({_DROP})")
def import_hit_rate(spark, d):
    return I.hit_rate(_drops(spark, d))


@query("SELECT conv_id, turn, CASE WHEN contains(t, 'state') THEN 'state_lifecycle' WHEN contains(t, 'failure') OR contains(t, 'recovery') THEN 'failure_recovery' WHEN contains(t, 'concurrency') THEN 'concurrency_timing' ELSE '' END AS axis FROM (SELECT conv_id, turn, lower(CASE turn % 4 WHEN 0 THEN 'State ' WHEN 1 THEN 'Recovery ' WHEN 2 THEN 'x' ELSE 'concurrency' END || text) AS t FROM conversations)")
def axis_inference(spark, d):
    head = F.get(F.array(*map(F.lit, ("State ", "Recovery ", "x", "concurrency"))), (F.col("turn") % 4).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", I.axis_of(F.concat(head, "text")).alias("axis"))


@query("SELECT source AS source_id, doc_id AS card_id, CASE WHEN (count(DISTINCT lang) OVER (PARTITION BY source)) >= 3 THEN lang ELSE 'part-' || CAST(1 + (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // CAST(ceil(count(*) OVER (PARTITION BY source) / 3.0) AS BIGINT) AS VARCHAR) END AS feature FROM documents")
def import_features(spark, d):
    return I.grouped(table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("card_id"), F.col("lang").alias("label"), F.lit("").alias("axis")))


# --- export


@query("SELECT c_name AS repo_id, count(o_orderkey) AS analyses, coalesce(CAST(arg_max(o_orderkey, (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderkey)) AS VARCHAR), '') AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name")
def export_documents(spark, d):
    repos = table(spark, d, "customer").select(F.regexp_replace("c_name", "[^A-Za-z0-9._-]", "-").alias("repo_id"), "c_custkey", "c_name")
    analyses = table(spark, d, "orders").join(repos.select("repo_id", "c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("repo_id", F.col("o_orderkey").alias("analysis_id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("finished_at"))
    doc = O.repo_documents(repos.select("repo_id", "c_name"), analyses)
    got = F.from_json("document", "struct<c_name:string,latest:long,analyses:array<struct<id:long>>>")
    return doc.select(got.alias("j")).select(F.col("j.c_name").alias("repo_id"), F.coalesce(F.size("j.analyses"), F.lit(0)).cast("long").alias("analyses"), F.coalesce(F.col("j.latest").cast("string"), F.lit("")).alias("latest"))


# --- the whole catalogue: sources are repositories, one of them with an id that is no file name; languages are patterns

_SITE = """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, CASE WHEN source = 'src3' THEN 'src/3' ELSE coalesce(source, 'none') END AS repo_id, coalesce(lang, 'none') AS lang, coalesce(text, '') AS text FROM documents)
"""


def _site(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.when(F.col("source") == "src3", "src/3").otherwise(F.coalesce("source", F.lit("none"))).alias("repo_id"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    repos = docs.select("repo_id").distinct().withColumn("full_name", F.upper("repo_id"))
    analyses = docs.select(F.col("id").alias("analysis_id"), "repo_id", F.lit("committed").alias("status"), F.lit(None).cast("string").alias("finished_at"))
    cards = docs.select(F.col("id").alias("card_id"), "repo_id", F.lit("mechanism").alias("kind"), F.concat(F.lit("card "), "id").alias("title"), F.col("text").alias("summary"), F.lit(None).cast("string").alias("symbol"), (F.col("doc_id") % 2 == 0).alias("reusable"), F.when(F.col("doc_id") % 3 == 0, '{"pending": true}').alias("quality_json"))
    members = docs.select(F.col("lang").alias("pattern_id"), F.col("id").alias("card_id"), ((F.col("doc_id") % 10) / 16).alias("score"))
    patterns = docs.groupBy(F.col("lang").alias("pattern_id")).agg(F.count("*").alias("card_count"), F.count_distinct("repo_id").alias("repo_count")).select("pattern_id", F.concat(F.lit("cluster-"), "pattern_id").alias("key"), F.upper("pattern_id").alias("title"), F.array("pattern_id").alias("tags"), "card_count", "repo_count")
    return repos, analyses, cards, patterns, members


@query(_SITE + """SELECT 'header' AS part, '' AS id, (SELECT count(DISTINCT repo_id) FROM d WHERE repo_id <> 'src/3') || ',' || (SELECT count(*) FROM d) || ',' || (SELECT count(*) FROM d) || ',' || (SELECT count(DISTINCT lang) FROM d) AS told
UNION ALL SELECT 'repo', repo_id, upper(repo_id) || ',' || count(*) FROM d WHERE repo_id <> 'src/3' GROUP BY repo_id
UNION ALL SELECT 'skipped', repo_id, repo_id FROM d WHERE repo_id = 'src/3' GROUP BY repo_id
UNION ALL SELECT 'pattern', lang, upper(lang) || ',' || count(*) || ',' || count(DISTINCT repo_id) FROM d GROUP BY lang
UNION ALL SELECT 'member', lang || '/' || id, CAST(doc_id % 10 AS VARCHAR) || ',' || CASE WHEN repo_id = 'src/3' THEN 'no page' ELSE repo_id || '.html' END || ',' || upper(repo_id) || ',' || md5(text) || ',card-' || id FROM d""")
def catalogue_lines(spark, d):
    """Every line of the exported catalogue, read back from its JSON."""
    lines = O.catalogue(*_site(spark, d), {"schema_id": F.lit("catalogue/1"), "embedder": F.lit("hash"), "cluster_threshold": F.lit(0.8)})
    kind = "stats map<string,long>, full_name string, analyses array<struct<id:string>>, repo_id string, title string, card_count long, repo_count long, score double, file string, repo_full_name string, summary string, anchor string"
    j = lines.select("part", "id", F.from_json("document", kind).alias("j"))
    stats = F.concat_ws(",", *[F.col("j.stats")[x].cast("string") for x in ("repos", "analyses", "cards", "patterns")])
    member = F.concat_ws(",", (F.col("j.score") * 16).cast("int").cast("string"), F.coalesce("j.file", F.lit("no page")), "j.repo_full_name", F.md5(F.col("j.summary").cast("binary")), "j.anchor")
    told = F.when(F.col("part") == "header", stats).when(F.col("part") == "repo", F.concat_ws(",", "j.full_name", F.size("j.analyses").cast("string"))).when(F.col("part") == "skipped", F.col("j.repo_id"))
    told = told.when(F.col("part") == "pattern", F.concat_ws(",", "j.title", F.col("j.card_count").cast("string"), F.col("j.repo_count").cast("string"))).otherwise(member)
    return j.select("part", "id", told.alias("told"))


@query(_SITE + """SELECT 'repos' AS name, count(DISTINCT repo_id) AS n FROM d UNION ALL SELECT 'analyses', count(*) FROM d UNION ALL SELECT 'cards', count(*) FROM d UNION ALL SELECT 'reusable_cards', count(*) FILTER (doc_id % 2 = 0) FROM d
UNION ALL SELECT 'pending_mechanism', count(*) FILTER (doc_id % 3 = 0) FROM d UNION ALL SELECT 'patterns', count(DISTINCT lang) FROM d UNION ALL SELECT 'pattern_members', count(*) FROM d""")
def table_statistics(spark, d):
    repos, analyses, cards, patterns, members = _site(spark, d)
    return K.statistics({"repos": repos, "analyses": analyses, "cards": cards, "patterns": patterns, "pattern_members": members})
