"""Schema versions of a knowledge base: steps in order, the split of old stores, and refusals."""

import pytest
from pyspark.sql import functions as F

from cairn.sources.migrations import KNOWLEDGE, Added, KnowledgeBase, Outdated, Registry, Unsupported
from cairn.sources.snapshots import Change, Snapshots


@pytest.fixture
def base(spark, tmp_path):
    return KnowledgeBase(*(Snapshots(spark, f"file://{tmp_path}/{x}") for x in ("source", "index")))


def old_store(spark, kb, version="1"):
    """A store from before the division: all tables in one, chunks without columns that came later."""
    rows = {
        "repos": spark.createDataFrame([("r1", "a"), ("r2", "b")], "repo_id string, name string"),
        "analyses": spark.createDataFrame([(f"a{i}", f"r{i % 2 + 1}", "c", "committed", "{}") for i in range(6)], KNOWLEDGE.tables["analyses"]),
        "chunks": spark.createDataFrame([("c1", "card", "x", "old"), ("c2", "card", "y", None), ("c2", "card", "y", None)], "chunk_id string, kind string, text string, gone string"),
        "chunk_vectors": spark.createDataFrame([("c1", "hash", 2, [1.0, 0.5])], KNOWLEDGE.tables["chunk_vectors"]),
    }
    shard = {"shard": F.col("repo_id")}
    changes = {t: Change(df, by=shard if t == "analyses" else {}) for t, df in rows.items()}
    kb.source.commit(changes, meta={"schema_version": version, "embedder": "hash"})


def test_from_nothing(base):
    assert base.migrate(dry_run=True) == {"dry_run": True, "from": 0, "to": 2, "steps": ["create", "1->2"]}
    assert base.version() == 0 and base.source.version() == 0
    done = base.migrate()
    assert done["schema_version"] == 2 and done["moved_tables"] == []
    assert set(done["applied_columns"]) == {"analyses.reindex_state", "repos.merged_into", "chunks.producer"}
    assert base.read("chunks").schema.names[-1] == "producer" and base.read("chunks").isEmpty()
    before = (base.source.version(), base.index.version())
    assert base.migrate()["applied_columns"] == [] and base.opened() is base
    assert (base.source.version(), base.index.version()) == before


def test_old_rows_get_defaults_and_no_file_is_written(spark, base):
    old_store(spark, base)
    files = base.source.manifest()["parts"]["analyses"]
    done = base.migrate()
    assert done["steps"] == ["1->2"] and done["moved_tables"] == ["chunks", "chunk_vectors"]
    assert base.source.manifest()["parts"]["analyses"] == files
    assert "chunks" not in base.source.manifest()["schemas"] and base.source.manifest()["meta"]["embedder"] == "hash"
    assert {r.reindex_state for r in base.read("analyses").collect()} == {"indexed"}
    assert base.read("analyses").where("reindex_state = 'indexed'").count() == 6  # pushed down to files without the column
    assert sorted((r.repo_id, r.merged_into) for r in base.read("repos").collect()) == [("r1", None), ("r2", None)]
    assert sorted((r.chunk_id, r.text, r.heading, r.producer) for r in base.read("chunks").collect()) == [("c1", "x", None, None), ("c2", "y", None, None)]
    assert base.read("chunk_vectors").first().vec == [1.0, 0.5]


def test_parts_written_later_leave_defaults_of_the_others(spark, base):
    old_store(spark, base)
    base.migrate()
    fresh = spark.createDataFrame([("a9", "r1", "c", "committed", "{}", "pending")], KNOWLEDGE.tables["analyses"] + ", reindex_state string")
    base.source.commit({"analyses": Change(fresh, by={"shard": F.col("repo_id")}, only=("r1",))})
    got = {r.analysis_id: r.reindex_state for r in base.read("analyses").collect()}
    assert got == {"a9": "pending", "a1": "indexed", "a3": "indexed", "a5": "indexed"}


def test_a_killed_split_is_finished(spark, base, monkeypatch):
    old_store(spark, base)
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "amend", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            base.migrate()
    assert base.source.read("chunks").count() == 3 and base.version() == 1
    assert base.migrate()["moved_tables"] == ["chunks", "chunk_vectors"]
    assert base.read("chunks").count() == 2 and "chunks" not in base.source.manifest()["schemas"]


def test_refusals(spark, base):
    old_store(spark, base, "3")
    with pytest.raises(Unsupported, match="newer"):
        base.opened()
    with pytest.raises(Unsupported):
        base.migrate()
    hole = KnowledgeBase(base.source, base.index, Registry(KNOWLEDGE.tables, {5: (Added("repos", "x"),)}, KNOWLEDGE.derived))
    with pytest.raises(Outdated, match="3->4"):
        hole.opened()
    with pytest.raises(Unsupported, match="3->4"):
        hole.migrate(dry_run=True)


def test_right_number_but_columns_missing(spark, base):
    old_store(spark, base, "2")
    with pytest.raises(Outdated, match="analyses.reindex_state, repos.merged_into"):
        base.opened()
    assert base.migrate()["steps"] == [] and base.opened().version() == 2


def test_steps_run_in_order_with_typed_defaults(spark, base):
    steps = {**KNOWLEDGE.steps, 3: (Added("analyses", "tries", "int", "1"),), 4: (Added("analyses", "score", "double", "0.5D"),)}
    kb = KnowledgeBase(base.source, base.index, Registry(KNOWLEDGE.tables, steps, KNOWLEDGE.derived))
    old_store(spark, kb)
    assert kb.migrate(3)["steps"] == ["1->2", "2->3"] and "score" not in kb.read("analyses").columns
    assert kb.opened().version() == 4
    assert {(r.tries, r.score) for r in kb.read("analyses").collect()} == {(1, 0.5)}
