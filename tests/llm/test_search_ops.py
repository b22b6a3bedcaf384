"""Near-dedup, substring dedup, top-k, embedding dedup and toxicity against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import embedding_dedup, graph, minhash, substring_dedup, topk, toxicity


def grouped(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(5, 5)]
    df = spark.createDataFrame([(b, a) for a, b in links], "a long, b long").repartition(4)
    want = {i: c for i, c in enumerate(grouped(401, links)) if any(i in x and x[0] != x[1] for x in links)}
    assert {r.id: r.component for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


# --- MinHash


def sets_of(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_superminhash_estimates_with_less_spread_than_minhash():
    rng = np.random.default_rng(1)
    for n in (20, 100, 400):
        a = rng.integers(0, 2**63, (200, n)).astype("u8")
        b = a.copy()
        b[:, : n // 10] = rng.integers(0, 2**63, (200, n // 10)).astype("u8")
        owner = np.repeat(np.arange(200), n)
        same = (minhash.superminhash(a.ravel(), owner, 200, 125) == minhash.superminhash(b.ravel(), owner, 200, 125)).mean(1)
        j = (n - n // 10) / (n + n // 10)
        assert abs(same.mean() - j) < 0.012 and same.std() < (j * (1 - j) / 125) ** 0.5


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 5)
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(14):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 60, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    texts += [None, "", " \t\n", "One two", "ONE  two", "É x", "é x", " ".join(rng.choice(vocab) for _ in range(20_000))]
    n, sets = len(texts), [sets_of(t) for t in texts]
    links = [(i, j) for i in range(n) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = grouped(n, links)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in range(n)}


def test_a_family_of_one_template_is_not_confirmed_pair_by_pair(spark, monkeypatch):
    """512 texts of one template that differ in four or more of 16 slots, so that none links, and one pair that does."""
    rng = random.Random(3)
    words, slots = [f"t{i}" for i in range(180)], [5 + 11 * k for k in range(16)]
    code, texts = [], []
    while len(code) < 512:
        c = rng.getrandbits(16)
        if all((c ^ d).bit_count() >= 4 for d in code) or len(code) > 300 and c not in code and all((c ^ d).bit_count() >= 3 for d in code[:300]):
            code.append(c)
    for c in code:
        text = list(words)
        for k, at in enumerate(slots):
            text[at] = f"v{k}{c >> k & 1}"
        texts.append(" ".join(text))
    texts.append(texts[40] + " more words")
    sets = [sets_of(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    confirmed, seen = minhash._confirmed, []

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(minhash, "_confirmed", counted)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = grouped(len(texts), links)
    assert got == dict(enumerate(want)) and got[512] == got[40]
    assert sum(seen) <= 30 * len(texts) + len(links)


def test_parts_of_open_buckets_meet(spark, monkeypatch):
    """With parts of 8: buckets of a large component, smaller ones and single documents, each link found."""
    monkeypatch.setattr(minhash, "PART", 8)
    rng = random.Random(14)
    base, texts = [f"b{i}" for i in range(120)], []
    for family in range(4):
        for k in range((60, 25, 12, 3)[family]):
            text = list(base)
            for j in range(family):
                text[20 + 25 * j] = f"f{family}"
            text[-1 - k % 3] = f"c{k}" if rng.random() < 0.8 else f"c{k % 5}"
            texts.append(" ".join(text))
    sets = [sets_of(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(grouped(len(texts), links))) and len(set(got.values())) > 1


def test_parity_maps_differ_less_than_sets():
    rng = np.random.default_rng(2)
    for n in (3, 90, 700, 30_000):
        a = rng.integers(0, 2**63, n).astype("u8")
        b = np.concatenate([a[n // 8 :], rng.integers(0, 2**63, n // 10).astype("u8")])
        x, y = minhash.parity_map(a), minhash.parity_map(b)
        w = min(len(x), len(y))
        x, y = ((m if len(m) == w else m[:w] ^ m[w:]) for m in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_near_duplicates_bear_odd_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, "a b c d e f"), (None, "x"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (0, 4, False), (4, 4, True), (4, 4, True), (7, 4, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- substrings


def brute_windows(texts, size=50):
    words, seen, out = [(t or "").encode().split() for t in texts], {}, []
    for i, w in enumerate(words):
        gone, mine = set(), [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
        for k, x in enumerate(mine):
            if seen.get(x, i) < i:
                gone.update(range(k, k + size))
        for x in mine:
            seen.setdefault(x, i)
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("letters", [1, 2, 6, 1000])
def test_anchor_depends_on_the_window_alone(letters):
    rng = np.random.default_rng(letters)
    fill = lambda n: minhash._mix(rng.integers(0, letters, n).astype("u8"))
    window, ref = fill(60), None
    for _ in range(100):
        before = fill(rng.integers(0, 40))
        name, begin = substring_dedup.anchors(np.concatenate([before, window, fill(rng.integers(0, 40))]), np.arange(len(before), len(before) + 11))
        got = (name.tolist(), (begin - len(before)).tolist())
        ref = ref or got
        assert got == ref


def test_substring_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    passages = [[f"p{rng.randrange(40)}" for _ in range(n)] for n in (49, 50, 51, 75, 130, 400)] + [["la"] * 120, ["ab", "cd"] * 70]
    texts = []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [f"u{i}_{k}" for k in range(rng.randint(1, 80))]
        if i % 9 == 0 and texts:
            parts = texts[rng.randrange(len(texts))].split()
            parts[len(parts) // 2] = "edited"
        texts.append(" ".join(parts))
    texts += [texts[0], None, "", "few words", " ".join(passages[5] * 30)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.digest) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == brute_windows(texts)


def test_substring_dedup_bears_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(55))
    got = substring_dedup.substring_dedup(spark.createDataFrame([(None, text), (3, text), (3, text), (9, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 55), (3, 0), (3, 0), (9, 0)]
    assert substring_dedup.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- vectors


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    monkeypatch.setattr(topk, "QUERIES", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[50:80] = x[50]
    x[100] = 0
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    odd = [(1000, None, 0), (1020, [float("nan")] * 8, 0), (1040, [1.0] * 7 + [None], 0), (None, [1.0] * 8, 0), (1060, [float("inf")] * 8, 0), (1080, [], 0)]
    vectors = topk.quantised(spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>, rank int"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()}
    q = np.floor(64 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    want = {}
    for i in range(0, 400, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:20]
        want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    assert got == want
    few = vectors.where("vec_id < 3")
    assert few.count() and topk.top_k(few, few.where("vec_id = 0"), 20).count() == 2
    assert topk.top_k(vectors.limit(0), vectors.limit(0), 20).count() == 0


@pytest.mark.parametrize("rows", [[(0, [1e300, 1.0]), (1, [1.0, 2.0])], [(0, [1e9, 1.0]), (1, [1e9, 2.0])]])
def test_scores_that_do_not_fit_a_long_are_an_error(spark, rows):
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="too large for a long|exceed 64 bits"):
        topk.top_k(vectors, vectors.where("vec_id = 0"), 20).collect()


def test_sorted_lists_stop_early():
    rng = np.random.default_rng(0)
    x = rng.integers(-60, 60, (5000, 3))
    lists = topk.SortedLists(np.arange(5000), x)
    ids, score = lists.best(-1, np.array([50, -3, 0]), 10)
    best = sorted((-int(v), i) for i, v in enumerate(x @ np.array([50, -3, 0])))[:10]
    assert list(zip((-score).tolist(), ids.tolist())) == best


def links_of(x, label, cosine=0.93):
    x = np.asarray(x, np.float64)
    u = x / np.abs(x).max(1, keepdims=True)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= cosine) & (np.asarray(label)[:, None] == label)
    np.fill_diagonal(near, False)
    return near


def deduped(spark, x, label, kind="float"):
    rows = [(i, [float(c) for c in v], int(k), 0) for i, (v, k) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, n_links int")
    return {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df).collect()}


@pytest.mark.parametrize("block", [100])
def test_embedding_dedup_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "PART", 40)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(scale=0.15, size=(20, 16)), base[0] + rng.normal(scale=0.12, size=(150, 16)), base[5:8], 3 * base[30:33]]).astype(np.float32)
    label = rng.integers(0, 3, len(x))
    label[80:230] = 1
    near = links_of(x, label)
    want = grouped(len(x), np.argwhere(near).tolist())
    rows = [(i, v.tolist(), int(k), 0) for i, (v, k) in enumerate(zip(x, label))]
    odd = [(1000, None, 1, 0), (1001, [0.0] * 16, 1, 0), (1002, x[0].tolist(), None, 0), (1003, [float("nan")] * 16, 1, 0), (None, x[0].tolist(), 1, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df).collect()}
    for i in range(len(x)):
        assert got[i] == (near[i].sum(), want[i], want[i] == i)
    assert all(got[i] == (0, i, True) for i in (1000, 1001, 1002, 1003)) and got[None] == (0, None, True)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0
    assert embedding_dedup.embedding_dedup(df.where("vec_id = 3")).count() == 1


def test_embedding_dedup_finds_pairs_in_a_hot_label(spark, caplog):
    """One label of 12,000 vectors, half of which have one partner, beside 1,000 labels of one vector."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(9000, 32))
    x = np.concatenate([base, base[:3000] + rng.normal(scale=0.3, size=(3000, 32)), rng.normal(size=(1000, 32))]).astype(np.float32)
    label = np.where(np.arange(13000) < 12000, -1, np.arange(13000))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [i for i in range(3000) if u[i] @ u[9000 + i] >= 0.930001]
    with caplog.at_level("INFO", logger="cairn.llm.embedding_dedup"):
        got = deduped(spark, x, label)
    assert len(pairs) > 2000 and np.mean([got[9000 + i] == (1, i) for i in pairs]) >= 0.99
    assert "recall" in caplog.text


def test_embedding_dedup_is_in_double_precision(spark):
    """Pairs just above and just below the threshold, and vectors whose squares vanish in single or double precision."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(400, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(400, 24))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.93 + np.where(np.arange(400) < 200, 1e-9, -1e-9)[:, None]
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b, np.eye(24)[:1] * 1e-60, np.eye(24)[:1] * 1e-200])
    label = [*range(400), *range(400), 400, 400]
    got = deduped(spark, x, label, "double")
    assert [got[400 + i] for i in range(400)] == [(1, i) if i < 200 else (0, 400 + i) for i in range(400)]
    assert got[800] == (1, 800) and got[801] == (1, 800)


def test_all_parts_of_an_overfull_cell_meet(spark):
    rows = spark.range(100).selectExpr("1 k", "id")
    met = set()
    for t in embedding_dedup._dealt(rows, ["k"], 10).toPandas().groupby(["i", "j"]):
        met |= {(a, b) for a in t[1].id for b in t[1].id if a != b}
    assert len(met) == 100 * 99


def test_embedding_dedup_does_not_pass_with_small_groups_missed(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MAX_BATCHES", 2)
    found = embedding_dedup.components
    monkeypatch.setattr(embedding_dedup, "components", lambda links: found(links.where("a < 200 AND b < 200")))
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([rng.normal(size=24) + rng.normal(scale=0.05, size=(200, 24)), base, base + rng.normal(scale=0.05, size=(40, 24))])
    with pytest.raises(RuntimeError, match="recall"):
        deduped(spark, x, [1] * len(x))


def lone_pair():
    """3,000 vectors of one label with a single link, so that no sample is likely to hold one."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rng.normal(size=32)
    turn -= (turn @ x[17]) * x[17]
    x[2500] = 0.934 * x[17] + np.sqrt(1 - 0.934**2) * turn / np.linalg.norm(turn)
    return x


def test_embedding_dedup_measures_recall_without_sampled_links(spark, monkeypatch, caplog):
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 4)
    with caplog.at_level("INFO", logger="cairn.llm.embedding_dedup"):
        got = deduped(spark, lone_pair(), [1] * 3000)
    assert len(got) == 3000 and {i: v for i, v in got.items() if v != (0, i)} == {17: (1, 17), 2500: (1, 17)}
    shown = caplog.records[-1].args
    assert shown[0] is None and 0.995 <= shown[1] <= 1


def test_embedding_dedup_does_not_pass_unmeasured(spark, monkeypatch):
    for name, value in (("SAMPLE", 4), ("MAX_BATCHES", 1), ("MISS", 0.9)):
        monkeypatch.setattr(embedding_dedup, name, value)
    with pytest.raises(RuntimeError, match="recall is None of sampled links and 0"):
        deduped(spark, lone_pair(), [1] * 3000)


@pytest.mark.parametrize("block", [24])
def test_embedding_dedup_bridges_tight_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 1)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    turn = np.arccos(0.935)
    bridge = np.zeros((2, 24))
    bridge[0, 0], bridge[1, :2] = 1, (np.cos(turn), np.sin(turn))
    away = np.zeros((2, 24))
    away[0, :2], away[1, :2] = (np.cos(0.15), -np.sin(0.15)), (np.cos(turn + 0.15), np.sin(turn + 0.15))
    x = np.concatenate([bridge, *(c + rng.normal(scale=0.008, size=(40, 24)) for c in away)]).astype(np.float32)
    near = links_of(x, [1] * len(x))
    cut = near.copy()
    cut[0, 1] = cut[1, 0] = False
    assert len(set(grouped(len(x), np.argwhere(cut).tolist()))) == 2
    got = deduped(spark, x, [1] * len(x))
    assert {c for _, c in got.values()} == {0} and [got[i][0] for i in range(len(x))] == near.sum(1).tolist()


def test_embedding_dedup_twins_connect_nothing(spark, monkeypatch):
    """16 vectors on a circle, none linked; the twins of each, just above the threshold away, are next to its neighbours."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    turn = np.arange(16) * np.pi / 8
    assert deduped(spark, np.stack([np.cos(turn), np.sin(turn)], 1), [1] * 16) == {i: (0, i) for i in range(16)}


def test_embedding_dedup_rounds_grow_neither_plans_nor_groups(spark, monkeypatch):
    """300 near copies among 600 other vectors of their label: pairs found by all rounds, and what the plan of a round reads."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=16) + rng.normal(scale=0.05, size=(300, 16)), rng.normal(size=(600, 16))]).astype(np.float32)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    write, pairs, reads = embedding_dedup.written, [], []

    def seen(df, name):
        out = write(df, name)
        if name == "found":
            pairs.append(out.where("sim IS NULL").count())
            reads.append(df._jdf.queryExecution().analyzed().toString().count("Relation ["))
        return out

    monkeypatch.setattr(embedding_dedup, "written", seen)
    got = deduped(spark, x, [1] * len(x))
    near = links_of(x, [1] * len(x))
    want = grouped(len(x), np.argwhere(near).tolist())
    assert got == {i: (near[i].sum(), want[i]) for i in range(len(x))}
    assert len(reads) >= 4 and max(reads[3:]) <= reads[2] and max(pairs) <= 1.5 * pairs[0], (reads, pairs)


# --- toxicity


@pytest.mark.parametrize("label", [lambda a, b: a and b, lambda a, b: a != b])
def test_factorization_machine_learns_a_pair(label):
    """Also where each of the two terms alone says nothing, which weights alone cannot learn."""
    rng = random.Random(0)
    rows, labels = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"n{rng.randrange(200)}" for _ in range(12)] + ["insult"] * insult + ["group"] * group
        rows.append(toxicity.features(" ".join(words)))
        labels.append(float(label(insult, group)))
    labels = np.array(labels)
    right = lambda model: ((model.score(rows[2400:]) >= 0.5) == (labels[2400:] == 1)).mean()
    assert right(toxicity.fit(rows[:2400], labels[:2400])) > 0.97
    if label(True, False):
        assert right(toxicity.fit(rows[:2400], labels[:2400], epochs=(14, 0, 10))) < 0.85


def test_pair_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    size = 1 << toxicity.BITS
    weights, factors = np.zeros(size), np.zeros((size, toxicity.FACTORS))
    weights[:30], factors[20:50] = rng.normal(size=30), rng.normal(size=(30, toxicity.FACTORS))
    model = toxicity.FactorizationMachine(0.3, weights, factors)
    rows = [np.unique(rng.integers(0, 60, n)) for n in (0, 1, 2, 9, 40)]
    plain = [0.3 + sum(weights[i] for i in x) + sum(factors[i] @ factors[j] for i in x for j in x if i < j) for x in rows]
    assert np.allclose(model.raw(rows), plain)


def test_toxicity_is_learnt_from_the_other_rows_only(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.2
        docs.append((i, " ".join([rng.choice(words) for _ in range(20)] + (["Idiots,"] if bad else [])), "clash"))
        labels.append((i, int(bad)))
    docs += [(5000, None, "clash"), (5001, "", "clash"), (5002, "idiots " + "w1 " * 50_000, "clash"), (5002, "idiots " + "w1 " * 50_000, "clash")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(7777, 1), (5000, None)], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(d, lab)
    flipped = lab.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.train(d, flipped).weights, model.weights)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels]) > 0.99
    assert got[5002] >= 0.5 and got[5000] == got[5001] < 0.5
    repeated = toxicity.train(d.unionByName(d), lab.unionByName(lab))
    assert np.array_equal(repeated.weights, model.weights)
    assert toxicity.score_toxicity(d.limit(0), toxicity.train(d.limit(0), lab)).count() == 0
    empty = toxicity.train(d, lab.limit(0))
    assert {r.score for r in toxicity.score_toxicity(d.limit(3), empty).collect()} == {0.5}
