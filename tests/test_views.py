"""Views, registration, host metadata and import helpers on small tables with the odd rows each must bear."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import catalog, importing, profiling, registration, views


def test_unique_keys_resolve_collisions(spark):
    rows = [(1, "x"), (2, "x"), (3, "x-2"), (4, "x"), (5, "y"), (6, "y"), (7, "x-2"), (8, "z-2")]
    got = {r.id: r.key for r in catalog.unique_keys(spark.createDataFrame(rows, "id long, base string"), "base", "id").collect()}
    assert got == {1: "x", 2: "x-2", 3: "x-2-2", 4: "x-3", 5: "y", 6: "y-2", 7: "x-2-3", 8: "z-2"}


def test_registration_merges_renames_and_marks_stale(spark):
    schema = "repo_id string, full_name string, identity_key string, head_sha string, is_stale boolean, aliases array<string>, stars long"
    repos = [("a", "o/a", "k1", "h1", False, ["older"], 5), ("b", "o/b", "k2", "h1", True, None, None), ("c", "o/c", None, "h1", False, [], 1)]
    refs = [("n", "o/new", "k1", "h2", False, [], None), ("b", "o/b", "k2", "h1", False, [], 9), ("d", "o/d", None, "h9", False, [], 2)]
    got = {r.repo_id: (r.full_name, r.is_stale, r.aliases, r.stars, r.action) for r in registration.registered(spark.createDataFrame(repos, schema), spark.createDataFrame(refs, schema)).collect()}
    assert got == {"a": ("o/new", True, ["older", "o/a"], 5, "merged"), "b": ("o/b", True, [], 9, "refreshed"), "c": ("o/c", False, [], 1, "kept"), "d": ("o/d", False, [], 2, "new")}
    nothing = spark.createDataFrame([], schema)
    assert registration.registered(nothing, nothing).count() == 0


def test_host_metadata_never_fails(spark):
    rows = ['{"id": 3, "fork": true, "parent": {"full_name": "p/q"}, "license": {"spdx_id": "MIT"}, "stargazers_count": 4, "description": " d "}', '{"id": "3", "license": "MIT"}', "[]", "oops", None, ""]
    got = [tuple(r.m) for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(registration.host_metadata(F.col("x")).alias("m")).collect()]
    assert got[0] == (3, True, "p/q", 4, "MIT", "d", None, None)
    assert all(g == (None,) * 7 + ("no id from the host",) for g in got[1:])


def test_card_views_by_detail(spark):
    cards = spark.createDataFrame([(1, "gotcha", "t", None, "m", "[]"), (2, "snippet", "u", "go", "m", "[]")], "card_id long, kind string, title string, language string, mechanism_desc string, code_spans string")
    evidence = spark.createDataFrame([(1, "e2", "b", 1, 2), (1, "e1", "a", 3, 4)], "card_id long, evidence_id string, path string, start_line int, end_line int")
    tags, lineage = spark.createDataFrame([(1, ["x"])], "card_id long, tags array<string>"), spark.createDataFrame([(2, "r", None)], "card_id long, repo_id string, producer string")
    full = {r.card_id: r for r in views.card_view(cards, evidence, tags, lineage, "full").collect()}
    assert full[1].source.path == "a" and [e.path for e in full[1].evidence] == ["a", "b"] and full[2].evidence is None
    assert views.card_view(cards, evidence, tags, lineage, "brief").columns == list(views.BRIEF)
    assert "producer" not in views.card_view(cards, evidence, tags, lineage).where("card_id = 2").select(F.to_json(F.struct("*")).alias("j")).first().j
    with pytest.raises(ValueError):
        views.card_view(cards, evidence, tags, lineage, "all")


def test_import_caps_and_keys(spark):
    evidence = spark.createDataFrame([(1, f"p{i}", i, i) for i in range(9)] + [(None, "p", 1, 1)], "card_id long, path string, start_line int, end_line int")
    assert [(r.card_id, len(r.evidence)) for r in importing.evidence_by_card(evidence, importing.MOST_EVIDENCE).collect()] == [(1, 6)]
    keys = spark.createDataFrame([("a",), ("",), (None,), ("a",)], "key string")
    assert [r.key for r in importing.source_keys(keys, keys).collect()] == ["a"]
    paths = spark.createDataFrame([(["a", "a", "", None, *"bcdefghij"], "r"), ([], "r"), ([], None)], "p array<string>, r string")
    assert [r[0] for r in paths.select(importing.entry_points(F.col("p"), F.col("r"))).collect()] == [list("abcdefgh"), ["r"], []]


@pytest.mark.parametrize("line,kind,name", [
    ("export default async function go(x) {", "function", "go"), ("func (s *Server) Run(ctx)", "function", "Run"), ("    pub(crate) async fn f<T>(x)", "function", "f"), ("const add = async (a) => a", "function", "add"),
    ("public final class A extends B", "class", "A"), ("export interface I {", "interface", "I"), ("pub struct S;", "struct", "S"), ("trait T {}", "trait", "T"), ("enum E {", "enum", "E"), ("export type Q = 1", "type", "Q"),
    ("const MAX_N = 3", "constant", "MAX_N"), ("// class No", None, None), ("classy thing", None, None),
])
def test_declarations_by_language(spark, line, kind, name):
    got = [(r["kind"], r["name"]) for r in profiling.declarations(spark.createDataFrame([("x.ts", line)], "path string, text string")).collect()]
    assert got == ([(kind, name)] if kind else [])


def test_registration_keeps_details_and_merges_known_ids(spark):
    schema = "repo_id string, full_name string, identity_key string, head_sha string, is_stale boolean, aliases array<string>, stars long, url string, language string, license string, description string"
    repos = [("a", "o/a", "id:1", "h1", False, None, 5, "u1", "go", "MIT", "old"), ("b", "o/b", "id:2", "h2", False, [], None, "u2", "c", None, None), ("d", "o/d", "name:d", "h4", False, [], 1, "u4", "lua", "X", "y")]
    refs = [
        ("b", "o/b2", "id:1", "h1", None, None, 7, "u9", None, None, "new", False),  # known, but a has its identity
        ("e", "o/e", "name:d", "h9", None, None, None, "u5", "py", None, None, True),  # made up from a name: no rename
        ("f", "o/f", None, "h5", None, None, None, None, None, None, None, None),
    ]
    out = registration.registered(spark.createDataFrame(repos, schema), spark.createDataFrame(refs, schema + ", degraded boolean"))
    got = {r.repo_id: (r.full_name, r.aliases, r.stars, r.url, r.language, r.license, r.description, r.action) for r in out.collect()}
    assert got == {
        "a": ("o/b2", ["o/a"], 7, "u9", None, "MIT", "new", "merged"),
        "b": ("o/b", [], None, "u2", "c", None, None, "kept"),
        "d": ("o/d", [], 1, "u4", "lua", "X", "y", "kept"),
        "e": ("o/e", [], None, "u5", "py", None, None, "new"),
        "f": ("o/f", [], None, None, None, None, None, "new"),
    }
