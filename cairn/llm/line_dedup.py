"""Line dedup: lines that many documents share are dropped everywhere but in the last document that holds them.

Built from DataFrame functions only. Keys are hashed once per distinct line of a document, counted with a map-side
partial aggregate, and the few shared keys are joined back; a shared key held by very many documents is an ordinary
skewed join, which adaptive execution splits. Only positions travel to the documents, not their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import BLANKS, bound, lower_ascii, read_table, unused, written

MIN_CHARS, MIN_DOCS = 20, 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column, min_chars: int) -> Column:
    """For each line its position and two independent 64-bit hashes of its key; short keys are left out."""
    def entry(line, i):
        return F.when(F.char_length(line) >= min_chars, bound(lower_ascii(F.btrim(line, F.lit(BLANKS))), lambda key: F.when(
            F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), i.alias("pos")))))

    return F.filter(F.transform(_lines(text), entry), lambda x: x.isNotNull())


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` added.

    Null and empty texts are one empty line and stay as such (kept_text ''); keys under
    ``min_chars`` code points never count. A line is compared by 128 hash bits of its key. Repeated rows with one
    doc_id count as one document; a null doc_id ranks below every other. Very long texts are handled in linear
    time. Further columns pass through; they may carry any name but the three added ones, which replace them.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    who = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = written(docs.select(who.alias("_d"), F.xxhash64("text").alias("_t"), _keys(F.col("text"), min_chars).alias("_k")).where(F.size("_k") > 0), "line_keys")
    one_each = F.explode(F.array_distinct(F.transform("_k", lambda x: F.struct(x.h1, x.h2)))).alias("_e")
    shared = (rows.select("_d", one_each).distinct().groupBy(F.col("_e.h1").alias("h1"), F.col("_e.h2").alias("h2"))
              .agg(F.count("*").alias("_n"), F.max("_d").alias("_last")).where(F.col("_n") >= min_docs))
    shared = written(shared.select("h1", "h2", "_last"), "shared_lines")
    found = rows.select("_d", "_t", F.explode("_k").alias("_e")).select("_d", "_t", "_e.h1", "_e.h2", "_e.pos")
    hits = found.join(shared, ["h1", "h2"]).where(F.col("_d") != F.col("_last"))
    drops = hits.groupBy("_d", "_t").agg(F.collect_set("pos").alias("_drop"))
    d, t, gone = (unused(c, docs) for c in ("d", "t", "gone"))
    drops = drops.select(F.col("_d").alias(d), F.col("_t").alias(t), F.col("_drop").alias(gone))
    joined = docs.withColumns({d: who, t: F.xxhash64("text")}).join(drops, [d, t], "left")
    text = F.coalesce("text", F.lit(""))
    n = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col(gone))
    kept = bound(_lines(text), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return joined.withColumns({
        "n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col(gone).isNull(), text).otherwise(kept),
    }).drop(d, t, gone)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.last_doc AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
