"""The whole pipeline on a small corpus, each decision checked."""

import random

import pytest

import corpus_pipeline
from cairn.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(900)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(vocab) for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            words[7] = "moron"
        text = " ".join(words[:20]) + "\nThis footer stands under many documents\n" + " ".join(words[20:])
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(bad)))
    base = rows[7][1]
    rows += [(500 + k, base.replace("\n", " ") + f" end{k}", "en", "s1", len(base)) for k in range(6)] + [(600, None, "en", "s1", None), (601, "", "en", None, 0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return str(folder), rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"file://{folder}/documents.parquet")
    by_name = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, f"file://{folder}"), "stage")
        by_name.append({r.doc_id: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    clean, lined, single, mixed, coded = by_name
    assert {r[0] for r in rows} - set(clean) == {i for i in range(400) if i % 6 == 0}
    assert set(lined) == set(clean)
    footer = "This footer stands under many documents"
    with_line = lambda found: [i for i, r in found.items() if footer in (r.text or "").split("\n")]
    assert with_line(lined) == [max(with_line(clean))]
    assert set(lined) - set(single) <= set(range(500, 506)) and len({*range(500, 506)} & set(single)) == 1
    assert {600, 601} <= set(single)
    assert set(mixed) <= set(single) and mixed
    assert set(coded) == set(mixed) and all(r.round_trip and r.n_tokens == len(r.ids) for r in coded.values())


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, f"file://{corpus[0]}")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"] and out.count() > 50
