"""Catalogue, snapshots, sessions, ETL, profiles and imports on small tables."""

import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairn.operators import catalog as K
from cairn.operators import etl as E
from cairn.operators import importing as I
from cairn.operators import profiling as P
from cairn.operators import sessions as S
from cairn.sources import export as O
from cairn.sources import files as L
from cairn.sources import tables as W
from cairn.sources import tree as T


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_latest_puts_nulls_last(spark):
    a = spark.createDataFrame([("r", "a1", "committed", None, "3"), ("r", "a2", "committed", "2", "1"), ("r", "a3", "drafting", "9", "9"), ("q", "b", "drafting", "1", "1")], "repo_id string, analysis_id string, status string, finished_at string, created_at string")
    assert rows(K.latest_committed(a), "repo_id", "analysis_id") == [("r", "a2")]


def test_counts_and_producers(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    child = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    assert rows(K.counts_per(parent, "k", n=child), "k", "n") == [(1, 2), (2, 0)]
    q = spark.createDataFrame([('{"code_mismatch": 2}', "agent"), ("{bad", None), (None, "agent")], "quality_json string, producer string")
    assert rows(K.code_mismatches(q), "total", "non_zero_analyses") == [(2, 1)]
    assert rows(K.by_producer(q), "producer", "analyses") == [("agent", 2), ("unknown", 1)]


def test_upsert_keeps_known_values(spark):
    old = spark.createDataFrame([("a", 5, "mit", ["x"]), ("b", 1, None, [])], "id string, stars int, license string, aliases array<string>")
    new = spark.createDataFrame([("a", 7, None, ["x", "y"]), ("c", 2, "bsd", ["z"])], old.schema)
    got = W.upsert(old, new, ["id"], keep_known=["license"], append=["aliases"])
    assert rows(got, "id", "stars", "license", "aliases") == [("a", 7, "mit", ["x", "y"]), ("b", 1, None, []), ("c", 2, "bsd", ["z"])]


def test_cascade(spark):
    t = {"a": spark.createDataFrame([(1,), (2,)], "a int"), "b": spark.createDataFrame([(10, 1), (20, 2)], "b int, a int"), "c": spark.createDataFrame([(100, 10), (200, 20)], "c int, b int"), "d": spark.createDataFrame([(9,)], "x int")}
    out = W.cascade(t, [("a", "a", "b", "a"), ("b", "b", "c", "b")], "a", spark.createDataFrame([(1,)], "a int"))
    assert [n.count() for n in out.values()] == [1, 1, 1, 1] and out["c"].first().c == 200


def test_sessions(spark):
    t = datetime.fromisoformat
    s = spark.createDataFrame([("a", "r", "validated", t("2024-01-01 00:00:00"), t("2024-01-02 00:00:00"), None, "c1"), ("b", "r", "committed", t("2024-01-03 00:00:00"), t("2024-01-03 00:00:00"), None, "c1"), ("c", "r", "abandoned", t("2024-01-01 00:00:00"), t("2024-01-01 00:00:00"), t("2024-01-01 00:00:00"), "c1"), ("d", "r", "begun", t("2024-01-02 00:00:00"), t("2024-02-01 00:00:00"), None, "c2")], "session_id string, repo_id string, state string, created_at timestamp, expires_at timestamp, abandoned_at timestamp, commit_sha string")
    now = F.expr("TIMESTAMP '2024-01-05 00:00:00'")
    assert rows(S.swept(s, now, 86400).fillna("-", ["outcome"]), "session_id", "action", "outcome") == [("a", "archive", "validated"), ("b", "keep", "-"), ("c", "delete", "-"), ("d", "keep", "-")]
    assert rows(S.resumable(s, F.lit("c2")), "session_id") == [("d",)]
    assert rows(S.resumable(s, F.lit("c1")), "session_id") == []  # the newest one is about another commit
    steps = spark.createDataFrame([("x", 1, "begun"), ("x", 2, "drafting"), ("x", 3, "committed"), ("y", 1, "validated")], "session_id string, at int, state string")
    assert [r.allowed for r in S.check_transitions(steps).orderBy("session_id", "at").collect()] == [True, True, False, True]
    more = [("drafting", "drafting", True), ("committed", "abandoned", False), ("committed", "committed", True), ("validated", "drafting", True), ("abandoned", "begun", False)]
    steps = spark.createDataFrame([(i, at, s) for i, (a, b, _) in enumerate(more) for at, s in enumerate((a, b))], "session_id int, at int, state string")
    assert [r.allowed for r in S.check_transitions(steps).where("at = 1").orderBy("session_id").collect()] == [x[2] for x in more]
    calls = spark.createDataFrame([("k", 0.0, 1), ("k", 0.1, 2), ("k", 0.2, 3), ("k", 10.0, 4), ("j", 0.0, 5)], "key string, at double, call_id long")
    assert rows(S.admitted(calls, 1.0, 2.0), "call_id", "admitted") == [(1, True), (2, True), (3, False), (4, True), (5, True)]


REPORT = '{"one_liner":"does things","features":[{"key":"retry-loop","title":"Retry","summary":"tries again","intent":"be robust","cards":[{"kind":"mechanism","title":"Backoff","summary":"waits","reusable":true,"mechanism_desc":"sleeps longer","symbol":"wait","tags":["Time Out","x"],"evidence":[{"path":"a.py","start_line":2,"end_line":9}]}]}]}'


def test_report_to_rows_to_chunks(spark):
    reports = spark.createDataFrame([("an1", REPORT), ("bad", "{")], "analysis_id string, report_json string")
    t = E.flattened(reports)
    assert rows(t["features"], "feature_id", "slug", "position") == [("an1_0", "retry-loop", 0)]
    assert rows(t["cards"], "card_id", "reusable", "tags") == [("an1_0_0", True, ["time-out", "x"])]
    files = spark.createDataFrame([("a.py", ["1", "2", "3"], "sha")], "path string, lines array<string>, sha256 string")
    assert rows(E.with_excerpts(t["evidence"], files), "excerpt", "sha256") == [("2\n3", "sha")]
    analyses = E.rendered(reports).withColumns({"repo_id": F.lit("r"), "producer": F.lit("agent")})
    c = E.chunks(analyses, t["features"], t["cards"].withColumn("quality_json", F.lit("{}")))
    got = {r.chunk_id: r for r in c.collect()}
    assert got["feature~an1_0"].text == "Retry tries again be robust Backoff"
    assert got["card~an1_0_0"].text == "Backoff waits sleeps longer wait time-out x"
    assert [got[f"report_section~an1~{i}"].heading for i in range(4)] == ["Summary", "Features", "Mechanisms", "Evidence"]
    pending = E.chunks(analyses, t["features"], t["cards"].withColumn("quality_json", F.lit('{"pending": true}')))
    assert pending.where("kind = 'card'").count() == 0
    filled = E.backfilled(c.withColumn("repo_id", F.lit(None).cast("string")), t["features"], t["cards"], analyses.select("analysis_id", "repo_id"))
    assert filled.where("repo_id = 'r'").count() == c.count()
    again = E.reindexed(c, c.withColumn("text", F.lit("new")), spark.createDataFrame([("other",)], "repo_id string"))
    assert again.where("text = 'new'").count() == 0
    assert rows(E.uncovered(spark.createDataFrame([("ok",), ("committed",), ("failed",)], "status string"), ("failed",)), "status", "n") == [("ok", 1)]


def test_commit_actions(spark):
    old = spark.createDataFrame([("r", "c", "1", "x")], "repo_id string, commit_sha string, version string, report_json string")
    new = spark.createDataFrame([("r", "c", "1", "x"), ("r", "d", "1", "x")], old.schema)
    assert rows(E.committed(old, new), "commit_sha", "action") == [("c", "same"), ("d", "insert")]
    changed = old.withColumn("report_json", F.lit("y"))
    assert E.committed(old, changed).first().action == "conflict" and E.committed(old, changed, force=True).first().action == "replace"


@pytest.mark.parametrize("paths,want", [(["a.rs"] * 3 + ["README.md"], "rust"), ([f"vendor/x{i}.go" for i in range(20)] + ["m.py"], "python"), (["a.md"], None), (["a.go", "b.py"], "go")])
def test_main_language(spark, paths, want):
    got = P.main_language(spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")).collect()
    assert [r.language for r in got] == ([want] if want else [])


def test_profiles(spark):
    files = spark.createDataFrame([("src/a.go", "func (*T) Run(x int) {\n// func no()\n", 10), ("src/b/c.py", "import argparse\nclass A:\n    def f(self): pass\nX = 1\n", 20), ("tests/t.py", "def (", 5), ("Dockerfile", "", 1)], "path string, text string, size long")
    assert rows(P.declarations(files.where("path like '%.go'")), "line", "kind", "name") == [(1, "function", "Run")]
    assert rows(P.python_symbols(files), "path", "name", "kind") == [("src/b/c.py", "A", "class"), ("src/b/c.py", "A.f", "method"), ("src/b/c.py", "X", "constant")]
    assert rows(files.select("path", P.entry_point(F.col("path"), F.col("text")).alias("e")).fillna("-", ["e"]), "path", "e") == [("Dockerfile", "build"), ("src/a.go", "-"), ("src/b/c.py", "cli"), ("tests/t.py", "test")]
    assert rows(P.tree(files), "path", "depth", "type")[:2] == [("Dockerfile", 1, "file"), ("src", 1, "dir")]
    assert rows(P.directory_groups(files), "top", "files") == [(".", 1), ("src", 2), ("tests", 1)]
    assert rows(P.pack_statistics(files), "files", "dirs", "bytes") == [(4, 4, 36)]
    around = spark.createDataFrame([("p", 3, ["x", "", "a", "b", " ", "c"]), ("q", 2, ["x", ""])], "path string, line int, lines array<string>")
    assert rows(P.block_around(around), "path", "first", "last") == [("p", 3, 4)]


def test_imports(spark):
    df = spark.createDataFrame([("feature_pattern", "m", True), ("feature_pattern", "m", False), ("integration_note", "a Pitfall", False), ("integration_note", "m", False), ("project_characteristic", "m", True), ("other", "m", True), (None, "m", False)], "t string, m string, c boolean")
    got = [(r.k.kind, r.k.rule.split("/")[1]) for r in df.select(I.card_kind(F.col("t"), F.col("m"), F.col("c")).alias("k")).collect()]
    assert got == [("snippet", "code-span"), ("mechanism", "mechanism"), ("gotcha", "gotcha"), ("decision", "decision"), (None, "skip"), ("snippet", "code-span"), ("mechanism", "mechanism")]
    texts = spark.createDataFrame([("DATA_FLOW state",), ("some 状态",), ("x",), (None,)], "t string")
    assert [r.a for r in texts.select(I.axis_of(F.col("t")).alias("a")).collect()] == ["data_flow", "state_lifecycle", "", ""]


def test_ignore_rules(spark):
    rules = ["# note", "*.log", "!keep.log", "build/", "/top.txt", "a/**/z", "d?t[0-9]"]
    paths = ["x.log", "s/x.log", "keep.log", "build/x", "s/build/y", "build", "top.txt", "s/top.txt", "a/z", "a/b/c/z", "dot1", "dotx"]
    got = {r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").where(L.ignored(F.col("p"), rules)).collect()}
    assert got == {"x.log", "s/x.log", "build/x", "s/build/y", "top.txt", "a/z", "a/b/c/z", "dot1"}


def test_files_and_slices(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.py").write_text("1\n2\n3\n")
    (tmp_path / "b.log").write_text("x")
    tree = L.file_tree(spark, str(tmp_path), ["*.log"])
    assert rows(tree, "path", "size") == [("s/a.py", 6)]
    got = L.line_slice(tree, F.lit(2), F.lit(99)).first()
    assert (got.text, got.total, got.truncated) == ("2\n3", 3, False)
    assert L.line_slice(tree, F.lit(1), F.lit(3), most=1).first().truncated


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "old.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE cards (id INTEGER PRIMARY KEY, title TEXT)")
        db.executemany("INSERT INTO cards VALUES (?, ?)", [(i, f"t{i}") for i in range(50)])
    got = L.read_sqlite(spark, path, ["knowledge_cards", "cards"])
    assert got.count() == 50 and got.select(L.first_of(got, "name", "title").alias("t")).where("t = 't7'").count() == 1
    (tmp_path / "no.db").write_text("plain text, no database")
    with pytest.raises(ValueError, match="no SQLite"):
        L.read_sqlite(spark, str(tmp_path / "no.db"), ["cards"])


def test_export(spark):
    repos = spark.createDataFrame([("ok", "Ok"), ("un/safe", "U"), ("none", "n")], "repo_id string, full_name string")
    analyses = spark.createDataFrame([("ok", "a1", "committed", "1"), ("ok", "a2", "committed", "2")], "repo_id string, analysis_id string, status string, finished_at string")
    docs = {r.repo_id: r.document for r in O.repo_documents(repos, analyses).collect()}
    assert set(docs) == {"ok", "none"} and '"latest":"a2"' in docs["ok"]


def test_small_rules(spark):
    files = spark.createDataFrame([("g", i, i, 10) for i in range(30)], "group string, id int, at int, bytes int")
    assert rows(K.keep_newest(files, 20, 55), "id") == [(i,) for i in range(25, 30)]
    base = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "base string, o int")
    assert rows(K.unique_keys(base, "base", "o"), "key") == [("x",), ("x-2",), ("y",)]
    seven = spark.createDataFrame([("k", i) for i in range(7)], "k string, o int")
    assert [r.part for r in K.thirds(seven, "k", "o").orderBy("o").collect()] == [0, 0, 0, 1, 1, 1, 2]
    left, right = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "l int, ks array<string>"), spark.createDataFrame([(9, ["b", "a"])], "r int, ms array<string>")
    assert rows(K.key_overlap(left, right, "ks", "ms"), "l", "r") == [(1, 9)]


def test_trigrams_in_order_reads_whole_texts(spark, tmp_path):
    from cairn.plans.catalog_queries import trigrams_in_order

    texts = ["abc" * 30 + " and the end behind sixty", "  ab ", None, " ".join(f"w{i}" for i in range(300))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.i, r.gram) for r in trigrams_in_order(spark, f"file://{tmp_path}").collect())
    want = [(d, i + 1, g) for d, t in enumerate(texts) for i, g in enumerate(dict.fromkeys(x[k : k + 3] for x in [(t or "").strip()] for k in range(len(x) - 2)))]
    assert got == want


def test_source_tree_prunes_before_it_lists(spark, tmp_path):
    made = {
        "src/a.py": "x = 1\n", "src/deep/er/b.RS": "fn b() {}", "Makefile": "all:", "noext": "?", ".hidden": "h", "README.md": "# r", ".gitignore": "*.log\n!keep.log\ngen/\n/only_root.txt\n", "x.log": "l", "keep.log": "k",
        "gen/c.py": "c", "src/gen/d.py": "d", "only_root.txt": "o", "src/only_root.txt": "o", "node_modules/m.js": "m", "src/build/n.js": "n", "go.sum": "g", "a.min.js": "m", "B.LOCK": "b", "pic.PNG": "p", "big.txt": "b" * 500,
    }
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "link.py").symlink_to(tmp_path / "src/a.py")
    (tmp_path / "loop").symlink_to(tmp_path)
    want = {".gitignore": "other", ".hidden": "other", "Makefile": "shell", "README.md": "markdown", "keep.log": "other", "noext": "other", "src/a.py": "python", "src/deep/er/b.RS": "rust", "src/only_root.txt": "text"}
    for parts in (1, 3, 100):
        got = T.source_tree(spark, str(tmp_path), max_file_bytes=400, partitions=parts).collect()
        assert {r.path: r.language for r in got} == want and len(got) == len(want)
    assert {r.path: bytes(r.content).decode() for r in got}["src/a.py"] == "x = 1\n" and {r.size for r in got if r.path == "src/a.py"} == {6}
    sub = T.source_tree(spark, str(tmp_path), subpath="src", rules="[]", content="false").collect()
    assert {r.path for r in sub} == {"a.py", "deep/er/b.RS", "gen/d.py", "only_root.txt"} and all(r.content is None for r in sub)
    assert T.source_tree(spark, str(tmp_path / "none")).count() == 0


def test_capped_takes_the_first_rows_of_each_group_in_order(spark):
    import random

    rng = random.Random(2)
    data = [(f"g{0 if i % 3 else i % 7}", rng.randrange(10_000), i) for i in range(900)]
    df = spark.createDataFrame(data, "g string, at int, i int").repartition(6)
    groups = {g: sorted((a, i) for h, a, i in data if h == g) for g, _, _ in data}
    got = P.capped(df, ["g"], ["at", "i"], 25).collect()
    assert {(r.g, r.at, r.i, r.place, r.total) for r in got} == {(g, a, i, k + 1, len(x)) for g, x in groups.items() for k, (a, i) in enumerate(x[:25])}


def test_evidence_pack_says_what_was_cut(spark):
    files = [("r", f"a{i}.py", 5, "python", f"def f{i}():\n    pass\nX = 1\n") for i in range(6)] + [("s", "main.go", 5, "go", "func Run() {"), ("s", "x", 1, "other", "func No() {")]
    df = spark.createDataFrame(files, "repo_id string, path string, size long, language string, text string")
    told = lambda *p: {r.repo_id: (r.files, r.symbols, r.truncated, r.truncation_reason) for r in P.evidence_pack(df, P.Profile(*p))["stats"].collect()}
    assert told(100, 100) == {"r": (6, 12, False, None), "s": (2, 1, False, None)}
    assert told(3, 100) == {"r": (3, 6, True, "max_files"), "s": (2, 1, False, None)}
    assert told(100, 12) == {"r": (6, 12, True, "symbol_cap"), "s": (2, 1, False, None)}
    pack = P.evidence_pack(df, P.Profile(100, 1))
    assert {(r.repo_id, r.name) for r in pack["symbols"].collect()} == {("r", "f0"), ("s", "Run")} and {(r.path, r.role) for r in pack["entry_points"].collect()} == {("main.go", "main")}


def test_pairs_with_several_keys_in_common_come_once_without_being_compared(spark):
    left = spark.createDataFrame([(i, [i % 3, 7, None]) for i in range(20)] + [(3, [8])], "l int, ks array<int>")
    right = spark.createDataFrame([(i, [i % 4, 7, 8]) for i in range(30)] + [(40, [None]), (40, [2])], "r int, ms array<int>")
    found = K.key_overlap(left, right, "ks", "ms")
    assert rows(found, "l", "r") == sorted([(i, j) for i in range(20) for j in range(30)] + [(i, 40) for i in range(20) if i % 3 == 2])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Join") < plan.index("Exchange")  # nothing is dealt after the join
