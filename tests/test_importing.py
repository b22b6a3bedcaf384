"""Imports: evidence cut anew against a plain loop, and what becomes of older cards."""

import hashlib
import random

from pyspark.sql import functions as F

from cairn.operators import importing as I

FILE = "repo_key string, path string, text string"
EVIDENCE = "repo_key string, card_id long, ord int, path string, line int"
CARD = "repo_key string, card_id long, card_type string, title string, summary string, mechanism string, tags array<string>, label string"


def plain(text, line):
    """The span around a line: (start, end, excerpt), or None."""
    lines = text.splitlines()
    if not 1 <= line <= len(lines) or not lines[line - 1].strip():
        return None
    a = b = line - 1
    while a > 0 and line - 1 - a < 40 and lines[a - 1].strip():
        a -= 1
    while b < len(lines) - 1 and b - line + 1 < 40 and lines[b + 1].strip():
        b += 1
    return a + 1, b + 1, "\n".join(lines[a : b + 1])


def test_recut_matches_a_plain_loop(spark):
    rng = random.Random(6)
    ends = ["\n", "\r\n", "\r", " ", "\x0c"]
    texts = {f"f{i}.py": "".join(rng.choice(["x = 1", "", "  ", "y", "　", "é"]) + rng.choice(ends[: 1 + i % 5]) for _ in range(rng.randint(0, 12))) for i in range(20)} | {"long.py": "a\n" * 200, "end.py": "a\nb", "big.py": "b\n" * 5000}
    asked = [(p, rng.randint(-1, 14)) for p in texts for _ in range(4)] + [("long.py", 100), ("end.py", 2), ("none.py", 1), ("big.py", 1)]
    rows = [("r", 1, i, rng.choice(["", "./", "/", "../"]) + p, line) for i, (p, line) in enumerate(asked)] + [("r", 1, 900, "f1.py", None), ("r", 1, 901, " ", 1), ("r", 1, 902, None, 1), ("other", 1, 903, "end.py", 1)]
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], FILE)
    got = {r.ord: r for r in I.recut(spark.createDataFrame(rows, EVIDENCE), files, max_chars=5000).collect()}
    assert len(got) == len(rows)
    for i, (p, line) in enumerate(asked):
        want = plain(texts[p], line) if p in texts and p != "big.py" else None
        r = got[i]
        assert r.attempted and r.hit == (want is not None) and (r.start_line, r.end_line, r.excerpt) == (want or (None, None, None)), (p, line)
        assert r.file_sha == (hashlib.sha256(texts[p].encode()).hexdigest()[:16] if want else None)
    assert [(got[o].attempted, got[o].hit) for o in (900, 901, 902, 903)] == [(False, False), (False, False), (False, False), (True, False)]


def test_what_becomes_of_older_cards(spark):
    words = " ".join(f"w{i}" for i in range(30))
    files = spark.createDataFrame([("r", "a.py", "def f():\n\n    return 1\n"), ("r", "b.py", "x")], FILE)
    cards = [
        (1, "Feature_Pattern", "t", words, words), (2, "integration_note", "", words, words + " 坑"), (3, "integration_note", None, None, words), (4, "project_characteristic", "t", words, words), (5, "feature_pattern", "t", words, words),
        (6, "feature_pattern", "t", words, words), (7, "feature_pattern", "t", "short", "too few words"), (8, "else", "t" * 300, "s" * 2000, words),
    ]
    table = spark.createDataFrame([("r", i, kind, t, s, m, ["Tag A", "tag-a", *[f"t{k}" for k in range(20)]], "") for i, kind, t, s, m in cards], CARD)
    evidence = spark.createDataFrame([("r", 1, 0, "a.py", 1), ("r", 1, 1, "a.py", 3), ("r", 2, 0, "b.py", 1), ("r", 3, 0, "b.py", 1), ("r", 4, 0, "b.py", 1), ("r", 5, 0, "a.py", 2), ("r", 7, 0, "b.py", 1), ("r", 8, 0, "b.py", 1)], EVIDENCE)
    got = {r.card_id: r for r in I.imported(table, I.recut(evidence, files)).collect()}
    assert {i: (r.status, r.reason, r.kind) for i, r in got.items()} == {
        1: ("import", None, "snippet"), 2: ("import", None, "gotcha"), 3: ("import", None, "decision"), 4: ("skip", None, None), 5: ("drop", "code_mismatch", "mechanism"), 6: ("drop", "evidence_missing", "mechanism"),
        7: ("drop", "schema_invalid", "snippet"), 8: ("import", None, "snippet"),
    }
    assert [r.pending for _, r in sorted(got.items())] == [False, True] + [False] * 6
    assert got[1].code == "def f():\nreturn 1" and got[2].code is None and [e.start_line for e in got[1].spans] == [1, 3]
    assert got[3].title == words[:60].strip() and got[3].summary == words[:200] and (len(got[8].title), len(got[8].summary)) == (200, 1000)
    assert len(got[1].tags) == I.MOST_TAGS and got[1].tags[:2] == ["tag-a", "t0"] and sorted(got[7].problems) == ["missing_field", "principle_too_short"]
    features = spark.createDataFrame([("r", i, "one") for i in range(9)], "repo_key string, card_id long, feature string")
    few = I.feature_evidence(I.imported(table, I.recut(evidence, files)), features).first()
    assert [(e.path, e.start_line) for e in few.evidence] == [("b.py", 1), ("a.py", 1), ("a.py", 3)]


def test_report_problems(spark):
    rows = spark.createDataFrame([(3, 1, 1, 1, "one two three four five six seven eight nine ten"), (2, 0, 0, 0, None)], "f int, c int, e int, r int, line string")
    got = rows.select(I.report_problems(F.col("f"), F.col("c"), F.col("e"), F.col("r"), F.col("line")).alias("p")).collect()
    assert [r.p for r in got] == [[], ["too_few_features", *["missing_field"] * 4]]
