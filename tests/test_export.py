"""Lines of the exported catalogue: order of patterns, links only to pages there are, and a catalogue without rows."""

import json

import pytest
from pyspark.sql import functions as F

from cairn.operators import catalog
from cairn.sources import export

SCHEMAS = {
    "repos": "repo_id string, full_name string",
    "analyses": "analysis_id string, repo_id string, status string, finished_at timestamp",
    "cards": "card_id string, repo_id string, kind string, title string, summary string, symbol string, reusable boolean, quality_json string",
    "patterns": "pattern_id string, key string, title string, tags array<string>, card_count long, repo_count long",
    "members": "pattern_id string, card_id string, score double",
}


@pytest.fixture
def made(spark):
    return lambda **rows: {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()}


def lines(t):
    about = {"schema_id": F.lit("catalogue/1"), "embedder": F.lit(None).cast("string")}
    return [(r.part, r.id, json.loads(r.document)) for r in export.catalogue(*t.values(), about).collect()]


def test_empty_catalogue(made):
    assert lines(made()) == [("header", "", {"schema_id": "catalogue/1", "stats": {"analyses": 0, "cards": 0, "patterns": 0, "repos": 0}})]
    assert {r.name: r.n for r in catalog.statistics({k: v for k, v in made().items()}).collect()} == {"repos": 0, "analyses": 0, "cards": 0, "reusable_cards": 0, "pending_mechanism": 0, "patterns": 0, "members": 0}


def test_members_link_to_exported_pages_only(made):
    t = made(
        repos=[("good", "Good"), ("a/b", "Bad"), ("..", "Dots")],
        cards=[("c 1", "good", "decision", "t", "s", None, True, '{"pending": true}'), ("c2", "a/b", "gotcha", "t", "s", "f", None, "no json"), ("c3", "gone", "gotcha", None, None, None, False, None)],
        patterns=[("p", "k", "T", None, 3, 2)],
        members=[("p", "c 1", 0.5), ("p", "c2", 0.25), ("p", "c3", None), ("p", "missing", 1.0)],
    )
    got = lines(t)
    members = {d["card_id"]: (d.get("file"), d.get("repo_full_name"), d["anchor"]) for part, _, d in got if part == "member"}
    assert members == {"c 1": ("good.html", "Good", "card-c_1"), "c2": (None, "Bad", "card-c2"), "c3": (None, None, "card-c3")}
    assert sorted(i for part, i, _ in got if part == "skipped") == ["..", "a/b"]
    assert next(d for part, _, d in got if part == "header")["stats"] == {"repos": 1, "analyses": 0, "cards": 3, "patterns": 1}
    assert next(d for part, _, d in got if part == "pattern")["tags"] == []
    assert {r.name: r.n for r in catalog.statistics({"cards": t["cards"]}).collect()} == {"cards": 3, "reusable_cards": 1, "pending_mechanism": 1}


def test_patterns_of_most_repositories_first(made):
    rows = [("p1", "k", "beta", [], 9, 2), ("p2", "k", "Alpha", [], 9, 2), ("p3", "k", "z", [], 1, 3), ("p4", "k", "a", [], 10, 2)]
    t = made(patterns=rows)["patterns"]
    assert [r.pattern_id for r in export.pattern_documents(t).orderBy("place").collect()] == ["p3", "p4", "p2", "p1"]
