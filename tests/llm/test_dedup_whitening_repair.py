"""Exact dedup, whitening and conversation repair against brute force, with the odd rows each must bear."""

import hashlib
import random
from collections import defaultdict
from functools import cache
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import conversation_repair as cr
from cairn.llm import exact_dedup, whitening

BLANKS = " \t\n\x0b\x0c\r"

# --- exact dedup


def brute_dedup(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate({ord(c): None for c in BLANKS})].append((-len(t or ""), d is None, d or 0, d))
    return sorted(((d, min(g)[3], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for *_, d in g), key=str)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_exact_dedup_matches_brute_force_over_any_number_of_runs(spark, parts):
    rng = random.Random(parts)
    pool = ["", " ", None, "a b", "ab", "a\tb\n", "A b", "é\xa0", "é", "x" * 200_000, "x " * 3, "xxx"] + [f"text {i}" for i in range(30)]
    rows = [(i, rng.choice(pool)) for i in range(300)] + [(1000 + i, "the copy\nof a third") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = exact_dedup.exact_duplicates(docs, ways=3).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_dedup(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_dedup_bears_nulls_repeats_clashing_names_and_no_rows(spark):
    rows = [(1, "a b", 5, "r", 0), (1, "a b", 5, "r", 0), (None, "ab ", 6, "s", 1), (None, "ab ", 6, "s", 1), (3, None, 7, "t", 2), (2, "", 7, "t", 2), (None, "lone", 1, "u", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run long, sha string, n int")
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted([(1, 1, 4), (1, 1, 4), (None, 1, 4), (None, 1, 4), (3, 2, 2), (2, 2, 2), (None, None, 1)], key=str)
    assert sum(r.kept for r in got) == 3
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[5], rows[6]], key=str)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0 == exact_dedup.deduplicated(docs.limit(0)).count()


# --- whitening


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) * 0.2 + rng.normal(size=6)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {r.vec_id: r for r in whitening.whitened(vectors, 4).collect()}
    assert sorted(got) == list(range(400))
    whole = np.floor(1024 * np.array([v for _, v in rows[:400]])) + 100_000
    e, v = np.linalg.eigh(np.cov(whole.T, bias=True))
    want = ((whole - whole.mean(0)) @ v)[:, ::-1][:, :4] / np.sqrt(e[::-1][:4])
    w = np.array([got[i].w for i in range(400)])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-9
    assert got[0].explained == pytest.approx(list(e[::-1][:4] / e.sum()), rel=1e-12) and got[0].identity_error < 1e-12
    ints = whole.astype(int).astype(object)
    assert [int(got[i].deviation) for i in range(400)] == list(((400 * ints - ints.sum(0)) ** 2).sum(1))


def test_polarised_sums_are_exact_where_longs_are_not(spark):
    rows = [(i, [float(2**40 * i), float(-(2**39) * (i % 3)), 1.0]) for i in range(50)]
    fit = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", whitening.integers(F.col("embedding"), 1, 5).alias("x"))
    n, sums = whitening.dimension_sums(fit)
    x = [[int(c) + 5 for c in v] for _, v in rows]
    assert (n, sums) == (50, [sum(c) for c in zip(*x)])
    for r in whitening.polarised(fit, n, sums).collect():
        one = [n * v[r.i] - sums[r.i] + (n * v[r.j] - sums[r.j] if r.i != r.j else 0) for v in x]
        assert int(r.q) == sum(y * y for y in one)
    cov = whitening.covariance([(r.i, r.j, int(r.q)) for r in whitening.polarised(fit, n, sums).collect()], n, 3)
    assert np.allclose(cov, np.cov(np.array(x, float).T, bias=True), rtol=1e-12)


def test_whitening_bears_equal_vectors_repeats_nulls_names_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>, x string, w string, n int"
    same = spark.createDataFrame([(i, [0.5, 0.25], "x", "w", 1) for i in range(3)], kind)
    assert [(r.w, r.deviation, r.n) for r in whitening.whitened(same).collect()] == [([], 0, 3)] * 3
    flat = spark.createDataFrame([(None, [0.5, 1.0], "", "", 0), (1, [0.5, 2.0], "", "", 0), (1, [0.5, 2.0], "", "", 0)], kind)
    got = whitening.whitened(flat).collect()
    assert sorted(len(r.w) for r in got) == [1, 1, 1] and got[0].explained == [1.0] and sum(r.w[0] for r in got) == pytest.approx(0)
    assert whitening.whitened(flat.limit(0)).count() == 0
    for bad in ([1e300, 0.0], [1.0, 2.0, 3.0]):
        with pytest.raises(Exception, match="too large|differ in length"):
            whitening.whitened(spark.createDataFrame([(1, bad), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()


# --- conversations


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def brute_repair(rows):
    """By trying every edit of every row, with up to four insertions: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)."""
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        due = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]
        moves = [(5, "I", due, name + ":", i, inserts - 1)] if inserts else []
        if i < len(rows):
            role, text, extra = rows[i][2], rows[i][3], 5 * (faults[i] == "truncated")
            moves.append((2, "D", state, None, i + 1, inserts))
            if faults[i] not in ("blank", "duplicate"):
                if (state, role[:1]) in step:
                    moves.append((extra, "K", role[:1], role + ":" + text, i + 1, inserts))
                moves.append((extra + 1, "R", due, name + ":" + text, i + 1, inserts))
        for cost, edit, to, line, at, left in moves:
            if rest := best(at, to, left):
                found.append((cost + rest[0], edit + rest[1], ((line,) if line is not None else ()) + rest[2]))
        return min(found, default=None)

    cost, audit, lines = best(0, "", 4)
    turns = [t for _, t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def solved(rows, min_block):
    stats, edits = cr.repairs(rows, min_block)
    out = stats.join(cr.audits(edits), stats["conv_id"].eqNullSafe(edits["conv_id"])).drop(edits["conv_id"])
    d = cr.digests(rows, edits).withColumnRenamed("conv_id", "d")
    found = out.join(d, out["conv_id"].eqNullSafe(d["d"])).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    whole = defaultdict(list)
    for r in cr.repaired(rows, edits).orderBy("part", "seq", "place").collect():
        whole[r.conv_id].append(f"{r.role}:{r.text}")
    for r in found:  # the rows hash to what was streamed
        assert hashlib.sha256("\n".join(whole[r.conv_id]).encode()).hexdigest() == r.repaired_sha256
    return {r.conv_id: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("min_block", [2, 64])
def test_repairs_match_brute_force(spark, min_block):
    rng = random.Random(min_block)
    texts = ["Yes.", "Yes. ", "no", "", " \t", "What?", "A!", "é…", None]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 9)):
            row = (conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts))
            rows += [row] * rng.choice([1, 1, 1, 2])
    # identical texts sort by hash: give every row of one turn and role one text
    first = {}
    rows = [(c, t, r, first.setdefault((c, t, " " if r is None else r), x)) for c, t, r, x in rows]
    table = spark.createDataFrame([(*r, 1, 2, "h") for r in rows], "conv_id long, turn long, role string, text string, part int, rows long, h1 string").repartition(3)
    want = {k: brute_repair(ordered_null(list(g))) for k, g in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0])}
    assert solved(table, min_block) == want


def ordered_null(rows):
    return ordered([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])


def test_long_conversations_are_cut_into_blocks_and_stay_right(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(3):
        rows += [(conv, t, rng.choice(["user", "assistant", "assistant", "system"]), f"text {rng.randrange(4000)}{rng.choice(['.', '.', ''])}") for t in range(900)]
    rows += [(3, t, "user" if t % 2 else "assistant", "the same." if t % 3 else f"text {t}.") for t in range(500)] + [(4, 7, "user", "again and again.")] * 700
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    stats, edits = cr.repairs(table, 8)
    assert {r.conv_id: r["count"] for r in edits.groupBy("conv_id").count().collect()}[0] > 25
    small, large = solved(table, 8), solved(table, 10_000)
    assert small == large
    assert small[4][1:] == (0, 699, 0, 699, 2 * 700, "D" * 700, cr._EMPTY)


def test_repairs_bear_no_rows_and_very_long_texts(spark):
    kind = "conv_id long, turn long, role string, text string"
    stats, edits = cr.repairs(spark.createDataFrame([], kind))
    assert stats.count() == edits.count() == 0
    rows = [(1, 0, "user", "word " * 400_000 + "?"), (1, 1, "assistant", "ok.")]
    assert solved(spark.createDataFrame(rows, kind), 64)[1] == brute_repair(rows)
