"""The snapshot store and the stored trigram index against plain reads."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.operators import fulltext as X
from cairn.operators.postings import PostingIndex, gram_rows
from cairn.sources.snapshots import Change, Conflict, Snapshots

KIND = "chunk_id long, repo_id string, text string"


def store(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/store")


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_become_visible_together_and_old_ones_stay(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.version() == 0
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(7,)], "n int")
    assert s.commit({"a": Change(a), "b": Change(b)}) == 1
    assert s.commit({"a": Change(a.withColumn("v", F.lit("y")))}, meta={"why": "test"}) == 2
    assert got(s.read("a")) == [(1, "y")] and got(s.read("b")) == [(7,)] and got(s.read("a", version=1)) == [(1, "x")]
    assert s.manifest()["meta"] == {"why": "test"}
    assert s.vacuum(keep=1) == 1 and got(s.read("b")) == [(7,)]  # of the first commit, table b is still in use
    s.commit({"b": Change(b)})
    assert s.vacuum(keep=1) == 1 and got(s.read("a")) == [(1, "y")] and got(s.read("b")) == [(7,)]


def test_a_commit_that_dies_leaves_the_old_version(spark, tmp_path):
    s = store(spark, tmp_path)
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    s.commit({"a": Change(rows), "b": Change(rows)})
    broken = rows.withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.lit(9)).cast("int"))
    with pytest.raises(Exception, match="lost"):
        s.commit({"a": Change(rows.where("id = 1")), "b": Change(broken)})
    assert s.version() == 1 and got(s.read("a")) == [(1,), (2,)] == got(s.read("b"))


def test_of_two_writers_on_one_version_the_second_conflicts(spark, tmp_path):
    s = store(spark, tmp_path)
    rows = spark.createDataFrame([(1,)], "id int")
    s.commit({"a": Change(rows)})
    s.commit({"a": Change(rows)}, base=1)
    with pytest.raises(Conflict):
        s.commit({"a": Change(rows.limit(0))}, base=1)
    assert s.version() == 2 and s.read("a").count() == 1


def test_parts_are_replaced_and_read_alone(spark, tmp_path):
    s = store(spark, tmp_path)
    rows = spark.range(100).withColumn("v", F.lit("old"))
    by = {"part": F.col("id") % 4}
    s.commit({"t": Change(rows, by)})
    s.commit({"t": Change(rows.where("id % 4 = 2 AND id > 50").withColumn("v", F.lit("new")), by, ("2", "3"))})
    assert s.read("t").count() == 50 + 12 and s.read("t").where("v = 'new'").count() == 12
    files = s.read("t", lambda v: v["part"] == "2").inputFiles()
    assert files and all("part=2" in f for f in files) and s.read("t", lambda v: v["part"] == "3").count() == 0
    with pytest.raises(ValueError, match="not replaced"):
        s.commit({"t": Change(rows, by, ("1",))})
    assert s.read("t").columns == ["id", "v"]


def brute(texts):
    return sorted((i, g, n, max(len(t) - 2, 0)) for i, t in texts for g, n in Counter(t[k : k + 3] for k in range(len(t) - 2)).items())


def test_gram_rows_match_brute_force(spark):
    rng = random.Random(4)
    texts = ["", "ab", "aaaa", "Ä𝔸中文 ß", "a\0\0", "\0\0\0x", " \n\t  ", "x" * 300_000, *["".join(rng.choice("abc 中😀") for _ in range(rng.randint(0, 60))) for _ in range(1200)]]
    rows = spark.createDataFrame([(i, "r", t) for i, t in enumerate(texts)] + [(9999, "r", None)], KIND)
    lowered = [(r.chunk_id, r.t) for r in rows.select("chunk_id", F.lower("text").alias("t")).collect() if r.t is not None]
    assert sorted(tuple(r) for r in gram_rows(rows).collect()) == brute(lowered)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    words = ["retry", "queue", "cache", "of", "the", "lease", "backoff", "状态机", "worker", "x_y"]
    rows = [(i, None if i % 17 == 0 else f"r{i % 5}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    return rows


@pytest.mark.parametrize("query", ["of the lease", "lease backoff zzqq 状态机", "x"])
def test_channels_find_the_same_with_and_without_the_index(spark, tmp_path, corpus, query):
    chunks = spark.createDataFrame(corpus, KIND)
    index = PostingIndex(store(spark, tmp_path), buckets=16, shards=3)
    index.build(chunks)
    among = chunks.where("repo_id = 'r1'")
    for args in ((chunks, query), (chunks, query, among)):
        assert got(X.keyword_channel(*args)) == got(X.keyword_channel(*args, index=index))
    for part in (chunks, among):
        assert got(X.substring_channel(part, query)) == got(X.substring_channel(part, query, index=index))
        assert got(X.substring_channel(part, query, False)) == got(X.substring_channel(part, query, False, index=index))


def test_only_asked_buckets_are_opened(spark, tmp_path, corpus):
    index = PostingIndex(store(spark, tmp_path), buckets=32, shards=2)
    index.build(spark.createDataFrame(corpus, KIND))
    asked = spark.createDataFrame([("lea",), ("ase",)], "gram string")
    opened = {f.split("bucket=")[1].split("/")[0] for f in index.asked(asked).inputFiles()}
    assert 1 <= len(opened) <= 2
    assert index.asked(asked).select("gram").distinct().count() == 2


def test_replacing_repositories_gives_what_a_new_index_would(spark, tmp_path, corpus):
    chunks = spark.createDataFrame(corpus, KIND)
    index = PostingIndex(store(spark, tmp_path), buckets=8, shards=4)
    index.build(chunks)
    repos = spark.createDataFrame([("r1",), (None,), ("unknown",)], "repo_id string")
    fresh = chunks.withColumn("text", F.upper("text")).where("chunk_id % 3 = 0")  # also of repositories that stay
    index.replace(repos, fresh)
    want = chunks.where("repo_id <> 'r1'").unionByName(fresh.where("repo_id = 'r1' OR repo_id IS NULL"))
    assert got(index.chunks().select("chunk_id", "repo_id", "text")) == got(want)
    assert got(index.store.read("postings").select("chunk_id", "repo_id", "gram", "tf", "dl")) == got(gram_rows(want, "repo_id"))
    before = index.store.manifest(1)["parts"]["postings"]
    shard = chunks.where("repo_id = 'r2'").select(F.pmod(F.xxhash64("repo_id"), F.lit(4)).cast("string")).first()[0]
    touched = {str(r[0]) for r in repos.select(F.pmod(F.xxhash64("repo_id"), F.lit(4))).collect()}
    if shard not in touched:
        assert {k: p for k, p in before.items() if f"shard={shard}/" in k}.items() <= index.store.manifest()["parts"]["postings"].items()
