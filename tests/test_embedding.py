"""Injected models: loading, order, retries and failures row by row; and what a search says about itself."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import retrieval as R
from cairn.operators.embedding import HashEmbedder, embedded, one_embedder


def failing(folder):
    """A model that fails on some texts, on whole batches that hold them, and once at first."""
    class Model:
        model, dim = "test", 2

        def embed(self, texts):
            with open(f"{folder}/calls", "a") as f:
                f.write(f"{len(texts)}\n")
            if "bad" in texts:
                raise RuntimeError("cannot read bad")
            return [[float(len(t)), float("nan") if t == "nan" else 1.0] if t != "short" else [1.0] for t in texts]

    def factory():
        with open(f"{folder}/loads", "a") as f:
            f.write("x")
        return Model()

    return factory


def test_one_model_per_worker_and_failures_stay_in_their_row(spark, tmp_path):
    texts = ["a", "bad", None, "four", "nan", "short", "é中", *[f"t{i}" for i in range(40)]]
    rows = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "id int, text string, vec string").coalesce(1)
    got = embedded(rows, f"test-{tmp_path}", failing(tmp_path), batch=8, retries=1, wait=0.0).collect()
    assert [r.id for r in got] == list(range(len(texts)))
    errors = {r.text: r.error for r in got if r.error}
    assert errors.keys() == {"bad", None, "nan", "short"} and "cannot read bad" in errors["bad"] and errors[None] == "null text" and "finite" in errors["nan"]
    assert all((r.vec is None) == (r.error is not None) for r in got) and got[3].vec == [4.0, 1.0] and {(r.embedder, r.dim) for r in got} == {("test", 2)}
    assert (tmp_path / "loads").read_text() == "x"
    sizes = [int(x) for x in (tmp_path / "calls").read_text().split()]
    assert sizes[:2] == [7, 7] and max(sizes) == 8  # the first batch without its null, tried twice, then text by text


def test_a_model_that_cannot_be_made_fails_the_job(spark):
    with pytest.raises(Exception, match="no such model"):
        embedded(spark.createDataFrame([("a",)], "text string"), "none", lambda: (_ for _ in ()).throw(OSError("no such model"))).collect()


def test_vectors_of_another_model_are_refused(spark):
    rows = embedded(spark.createDataFrame([("a",), ("b",)], "text string"), "hash:8", lambda: HashEmbedder(8))
    assert one_embedder(rows, "hash:8").count() == 2 and one_embedder(rows.limit(0), "x").count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        one_embedder(rows, "hash:16")


def test_search_tells_totals_channels_and_notes(spark):
    rows = [(i, "card" if i % 2 else "feature", f"r{i % 3}", "en", f"worker {i} keeps the lease of a queue") for i in range(12)] + [(90, "pattern", "r9", "fr", "nothing of that")]
    chunks = spark.createDataFrame(rows, "chunk_id int, kind string, repo_id string, language string, text string")
    vectors = chunks.select("chunk_id", F.array(F.lit(1.0), F.col("chunk_id").cast("double")).alias("vec"))
    found = R.search(chunks, " the lease ", 5, vectors, [1.0, 0.0], kind="card")
    assert (found.total, found.channels, found.notes) == (6, {"vector": 6, "keyword": 6, "substr": 6}, []) and found.hits.count() == 5
    loose = R.search(chunks, "leases queued", 0)
    assert loose.total == loose.hits.count() == 12 and loose.channels["vector"] == 0 and "trigrams" in loose.notes[0]
    none = R.search(chunks, "the lease", kind="pattern")
    assert none.total == 0 and none.notes[-1] == "no hits after the filter (kind=pattern)"
    assert R.search(chunks, "zzqqzz").notes[-1] == "no match in the library"
    with pytest.raises(ValueError, match="empty"):
        R.search(chunks, "  ")
