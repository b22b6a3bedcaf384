"""Line dedup, mixing, chat formatting, URL lists and BPE against brute force, with the odd rows each must bear."""

import hashlib
import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe, chat, line_dedup, mixing, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept_text string"


def documents(spark, texts, sources=None):
    sources = sources or ["a"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash") for i, (t, s) in enumerate(zip(texts, sources))], DOCS)


# --- lines


def brute_lines(texts):
    blanks = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[x.strip(blanks).translate(low) for x in (t or "").split("\n")] for t in texts]
    holders = defaultdict(set)
    for i, ks in enumerate(keys):
        for k in ks:
            holders[k].add(i)
    out = []
    for i, (t, ks) in enumerate(zip(texts, keys)):
        stay = [x for x, k in zip((t or "").split("\n"), ks) if not (len(k) >= 20 and len(holders[k]) >= 3 and max(holders[k]) != i)]
        out.append((i, len(ks), len(ks) - len(stay), "\n".join(stay)))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    pool = ["All rights reserved by the author", "  ALL RIGHTS reserved by the author\r", "short", "", "Ünïcode LINE of twenty code points É", "Ünïcode line of twenty code points É", "ünïcode line of twenty code points É"]
    texts = ["\n".join(rng.choice([*pool, f"line number {i} that is only here"]) for _ in range(rng.randint(0, 6))) for i in range(40)]
    texts += [None, "", "\n" * 5000 + pool[0], "\n".join([pool[0]] * 3000)]
    got = line_dedup.line_dedup(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got] == brute_lines(texts)
    assert {r.lang for r in got} == {"en"}


def test_line_dedup_bears_repeats_nulls_and_no_rows(spark):
    line = "the same line in all of them"
    rows = [(None, line), (1, line), (1, line), (2, line)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_dropped) for r in got) == [(-1, 1), (1, 1), (1, 1), (2, 0)]
    assert line_dedup.line_dedup(documents(spark, []).limit(0)).count() == 0


def test_line_dedup_and_mixing_take_any_column_name(spark):
    line = "the same line in all of them"
    rows = [(i, line, "s", 7, 8, 9, 10, 11, 12, 13) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, d int, t int, gone int, h int, size int, pieces int, _d int")
    for out in (line_dedup.line_dedup(docs), mixing.mix(docs)):
        got = out.collect()
        assert got and {(r.d, r.t, r.gone, r.h, r.size, r.pieces, r._d) for r in got} == {(7, 8, 9, 10, 11, 12, 13)}


def test_steps_permute(spark):
    sizes = spark.range(1, 1400).selectExpr("id n")
    got = sizes.select("n", *[mixing._step(F.col("n"), F.lit(5), F.lit(k)).alias(f"s{k}") for k in range(3)]).collect()
    for r in got:
        assert all(math.gcd(r.n, r[f"s{k}"]) == 1 or r.n == 1 for k in range(3))
        assert r.n < 5 or r.n == 6 or all(r[f"s{k}"] not in (1, r.n - 1) for k in range(3))
    assert len({r.s0 for r in got if r.n > 1000} | {r.s1 for r in got if r.n > 1000}) > 400


def test_line_dedup_counts_documents_not_rows(spark):
    line = "the same line in all of them"
    got = line_dedup.line_dedup(spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 0), (1, 0), (2, 0)]


# --- mixing


def brute_targets(size):
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * size[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * size[s]
            open_.discard(s)
        left = sum(size.values()) - sum(target.values())


def test_mixing_meets_targets_and_repeats_at_most_three_times(spark):
    rng = random.Random(1)
    names = ["src1", "src10", "src2", "tiny", None, "hot"]
    rows = [("w " * rng.randint(0, 60) + "é x", rng.choice(names[:3] + names[4:] + ["hot"] * 4)) for _ in range(2500)] + [("a b c", "tiny")] * 4 + [(None, "tiny"), ("", "hot"), ("v " * 30_000, "src1")]
    docs = documents(spark, [r[0] for r in rows], [r[1] for r in rows])
    size = Counter()
    for t, s in rows:
        size[s] += len((t or "").split())
    target = brute_targets(size)
    got = {r.doc_id: r for r in mixing.mix_counts(docs).collect()}
    taken = Counter()
    for i, (t, s) in enumerate(rows):
        r = got[i]
        assert r.size == len((t or "").split()) and r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= max(0.03 * target[s], 3 * mixing.BLOCK), s
    again = {r.doc_id: r.taken for r in mixing.mix_counts(docs.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert {i: len(r.text.split()) for i, r in mixed.items()} == {i: r.taken for i, r in got.items() if r.taken}
    assert all(r.n_chars == len(r.text) and r.kept_text == "clash" for r in mixed.values())


def test_mixing_bears_equal_rows_and_no_words(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, None, None)], "doc_id long, text string, source string")
    got = mixing.mix_counts(docs).collect()
    assert sorted((r.size, r.taken <= 3 * r.size) for r in got) == [(0, True), (3, True), (3, True)]
    assert mixing.mix_counts(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_counts(docs.where("doc_id is null")).collect()] == [0]


# --- chat


def brute_chat(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}


def test_chat_examples_read_back(spark):
    odd = ["\\### Assistant: </turn> ok", "<\\/turn>", "</turn", "</turn></turn>\n", "####", "#\\#\\", "\\", "", None, "a: b", "<\\\\/turn>##\\##", "é\n### user: x</turn>\n"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to:ol\\", None]), rng.choice(odd)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(99, t, ["user", "assistant"][t % 2], "long " * 200) for t in range(120)] + [(None, 0, "user", "x"), (98, None, "assistant", "y"), (97, 0, "assistant", "same"), (97, 0, "assistant", "same")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, target string")
    got = defaultdict(list)
    for r in chat.format_conversations(turns).withColumn("back", chat.read_back(F.col("text"))).orderBy("conv_id", "example").collect():
        got[r.conv_id].append(r)
    want = brute_chat(rows)
    assert set(got) == set(want)

    def plain(x):
        return x.replace("#\\#", "##").replace("<\\/turn>", "</turn>").replace("\\\\", "\\")

    for c, turns_ in want.items():
        targets = [i for i, (role, _) in enumerate(turns_) if role == "assistant"]
        examples = got[c]
        assert [e.target for e in examples if e.target is not None] == targets
        assert [(t.role, t.text) for t in examples[-1].back] == turns_
        for e in examples:
            upto = len(turns_) if e.target is None else e.target + 1
            assert [(t.role, t.text) for t in e.back] == turns_[:upto]
            masked = e.text[e.loss_start : e.loss_start + e.loss_length]
            assert plain(masked) == ("" if e.target is None else turns_[e.target][1])


def test_chat_without_rows(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- URL lists


def test_url_filter_as_of_the_fetch_day(spark):
    entries = spark.createDataFrame([("h:bad.example.com", 10, "block"), ("h:bad.example.com", 20, "drop"), ("h:bad.example.com", 20, "block2"), ("h:example.com", 0, "watch"), ("u:bad.example.com/ok", 12, "allow"), (None, 1, "block"), ("h:x.org", None, "block"), ("h:gone.org", 5, "block"), ("h:gone.org", 9, "drop")], "key string, day int, verdict string")
    captures = [(1, "http://bad.example.com/a", 9), (2, "https://u:p@BAD.example.com:80/a?q#f", 10), (3, "http://bad.example.com/a", 20), (4, "http://bad.example.com/ok/", 12), (5, "http://bad.example.com/ok", 11), (6, "nonsense", 12), (7, None, 12), (8, "http://gone.org/", 8), (8, "http://gone.org/", 8), (9, "http://gone.org/", 9), (10, "http://x.org", None), (11, "http://example.com", 0)]
    df = spark.createDataFrame([(*c, "clash") for c in captures], "page_id long, url string, day int, since string")
    got = sorted((r.page_id, r.verdict, r.key) for r in url_filter.url_filter(df, entries).fillna("-", ["verdict", "key"]).collect())
    assert got == [(1, "watch", "h:example.com"), (2, "block", "h:bad.example.com"), (3, "drop" if False else "watch", "h:example.com"), (4, "allow", "u:bad.example.com/ok"), (5, "block", "h:bad.example.com"), (6, "-", "-"), (7, "-", "-"), (8, "block", "h:gone.org"), (8, "block", "h:gone.org"), (9, "-", "-"), (10, "-", "-"), (11, "watch", "h:example.com")]
    assert url_filter.url_filter(df, entries.limit(0)).where("verdict is not null").count() == 0
    assert url_filter.url_filter(df.limit(0), entries).count() == 0


def test_url_filter_matches_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.x.org", "x.org", "b.x.org", "y.net"]
    log = [(f"h:{rng.choice(hosts)}", rng.randint(-40, 200), rng.choice(["block", "watch", "drop", "allow"])) for _ in range(300)]
    log += [(f"u:{rng.choice(hosts)}/p{rng.randrange(3)}", rng.randint(0, 90), rng.choice(["allow", "drop"])) for _ in range(60)]
    captures = [(i, f"http://{rng.choice(hosts)}/p{rng.randrange(4)}", rng.randint(-10, 260)) for i in range(400)] + [(900, "http://" + "l." * 60 + "x.org/" + "p" * 20_000, 50)]
    by_key = defaultdict(dict)
    for k, day, verdict in log:
        by_key[k][day] = max(verdict, by_key[k].get(day, ""))

    def brute(url, day):
        host = url[7:].split("/")[0]
        labels = host.split(".")
        for key in [f"u:{host}/{url[7:].split('/')[1]}", *("h:" + ".".join(labels[i:]) for i in range(len(labels) - 1))]:
            days = [x for x in by_key[key] if x <= day]
            if days and by_key[key][max(days)] != "drop":
                return by_key[key][max(days)], key, max(days)
        return None, None, None

    df = spark.createDataFrame([(*c, 1, 2) for c in captures], "page_id long, url string, day int, b int, best int")
    got = {r.page_id: (r.verdict, r.key, r.since) for r in url_filter.url_filter(df, spark.createDataFrame(log, "key string, day int, verdict string")).collect()}
    assert got == {i: brute(url, day) for i, url, day in captures}


# --- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.mark.parametrize("least,most,one_in", [(4, 40, 2), (8, 100, 4), (512, 8192, 64)])
def test_chunked_ids_equal_whole_ids(library, monkeypatch, least, most, one_in):
    for name, value in (("MIN_CHUNK", least), ("MAX_CHUNK", most), ("ONE_IN", one_in)):
        monkeypatch.setattr(bpe, name, value)
    coder, rng = bpe.ChunkCoder(bpe.default_tokenizer()), random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'re", "'", "<|endoftext|>", "<|endo", "é", "日本", "123", "!!", "\t", "🙂", " ", "x y z w "]
    for _ in range(300):
        text = "".join(rng.choice(parts) * rng.choice([1, 1, 2, 9]) for _ in range(rng.randint(0, 300)))
        want = library.encode(text, add_special_tokens=False).ids
        ids = coder.encode(text.encode())
        assert ids.tolist() == want
        assert coder.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("kind", ["numbers", "digits", "cyrillic", "ideographs", "commas"])
def test_repair_is_linear(kind):
    rng = random.Random(1)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    text = {
        "numbers": lambda: " ".join(word("0123456789", 6) for _ in range(60_000)),
        "digits": lambda: word("0123456789", 100_000),
        "cyrillic": lambda: " ".join(word("абвгдежзийклмноп", 7) for _ in range(30_000)),
        "ideographs": lambda: "，".join(word([chr(c) for c in range(0x4E00, 0x9FA5, 7)], 14) for _ in range(9_000)),
        "commas": lambda: ",".join(word("0123456789abc", 9) for _ in range(40_000)),
    }[kind]().encode()
    coder = bpe.ChunkCoder(bpe.default_tokenizer())
    began = time.perf_counter()
    whole = coder._run(text)
    between = time.perf_counter()
    assert coder.encode(text).tolist() == whole.tolist()
    assert time.perf_counter() - between < 4 * (between - began) + 0.3
    assert coder.repaired <= len(text)


def test_bpe_takes_any_column_name(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id long, text string, key long, key_ long")
    got = bpe.encode_documents(docs).first()
    assert (got.key, got.key_, got.decoded) == (7, 8, "a b")


def test_bpe_digests(spark, library):
    texts = [None, "", " ", "one passage that documents share " * 60, "x " + "one passage that documents share " * 60, "a" * 50_000, "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts + texts[3:4])], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode_digests(docs).collect()}
    full = {r.doc_id: r for r in bpe.encode_documents(docs).collect()}
    for i, t in enumerate(texts + texts[3:4]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert full[i].ids == ids and full[i].decoded == (t or "")
    assert bpe.encode_digests(docs.limit(0)).count() == 0
