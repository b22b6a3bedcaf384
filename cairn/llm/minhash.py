"""MinHash near-dedup with SuperMinHash signatures, banding, verification on full shingle sets, and grouping.

1. One pass over the texts gives each document the number of its distinct shingles, a 128-bit print of the set, a
   SuperMinHash signature and the band hashes. Documents with equal sets form a class at once; its smallest doc_id
   stands for it, so groups of exact copies cost nothing further.
2. Representatives that share a band are candidates. No bucket is expanded into all its pairs: members meet in blocks as
   parity maps of their sets. Two maps differ in at most as many bits as the sets differ in elements, so this filter loses
   no link. A block gives only as many of the pairs it leaves open as connect its components. In the first round every part
   of a bucket meets itself and the first part, which settles groups of copies in linear time; after that all parts of
   the buckets that still hold several components meet, but for those of a bucket's largest one, in rounds until no pair
   is open, each with pairs that connect a block's components four times as often as the round before, so that refuted
   pairs cost few rounds.
3. Candidates are confirmed on the full sets, rebuilt from the texts.
4. Confirmed links are grouped by union-find within tasks and rounds of joins between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import read_table, small_batches, tasks, written
from cairn.llm.graph import components

SHINGLE, SIMILAR, SLOTS, BANDS, PART, MAX_MAP = 5, 85, 125, 25, 256, 1 << 17
_U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of the whole sequence where it has fewer words."""
    found = (text or b"").lower().split()
    w = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _U(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(h))


def superminhash(values: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of n sets: values holds their elements' hashes, owner the set of each.

    Every element runs through its own random permutation of the m slots. In round j it offers j plus a random fraction
    to the slot that its permutation has at j; slots keep the least offer. A set is done as soon as all its slots hold
    less than the next round can offer, so large sets take two or three rounds.
    """
    sig = np.full(n * m, np.inf)
    state, at, past, perm = values.copy(), owner, [], None
    for j in range(m):
        state = state + _U(0x9E3779B97F4A7C15)
        r = _mix(state)
        k = j + (((r & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64)
        if j < 4:  # swaps so far, traced back
            slot = k
            for t in range(j - 1, -1, -1):
                slot = np.where(slot == past[t], t, slot)
            past.append(k)
        else:
            rows = np.arange(len(k))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.int16), (len(k), 1))
                for t, p in enumerate(past):
                    a, b = perm[rows, t].copy(), perm[rows, p].copy()
                    perm[rows, t], perm[rows, p] = b, a
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        np.minimum.at(sig, at * m + slot, j + (r >> _U(11)).astype(np.float64) * 2.0**-53)
        open_ = sig.reshape(n, m).max(1) >= j + 1
        stay = open_[at]
        if not stay.all():
            state, at, past = state[stay], at[stay], [p[stay] for p in past]
            perm = perm[stay] if perm is not None else None
        if not len(at):
            break
    return sig.reshape(n, m)


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, -1)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + bits[:, :, i])
    return h.view(np.int64)


def signatures(docs: DataFrame, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, print, bands) of each document; no bands for an empty set."""
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            i = 0
            while i < len(texts):
                sets, total, start = [], 0, i
                while i < len(texts) and total < 100_000:
                    sets.append(shingles(texts[i].as_py()))
                    total += len(sets[-1])
                    i += 1
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                hashes = [None] * len(sets)
                if len(full):
                    sig = superminhash(np.concatenate(sets), np.repeat(np.arange(len(full)), n[full]), len(full), slots)
                    for k, row in zip(full, band_hashes(sig, bands)):
                        hashes[k] = row
                prints = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(start, i - start), pa.array(n), prints, pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "print", "bands"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(out, "doc_id long, n_shingles long, print binary, bands array<long>")


def _confirmed(pairs: DataFrame, n: int, texts: DataFrame, similar: int) -> DataFrame:
    """Those of n pairs (a, b) whose full sets are similar enough. ``b`` may repeat very often: its text joins last, and sorted by it."""
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "ta", "tb"))
            ta, tb = ta.cast(pa.binary()), tb.cast(pa.binary())
            good = np.zeros(len(a), bool)
            for i, key in enumerate(b.to_pylist()):
                if key != last:
                    last, right = key, shingles(tb[i].as_py())
                left = shingles(ta[i].as_py())
                if 100 * min(len(left), len(right)) >= similar * max(len(left), len(right)):
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    good[i] = 100 * both >= similar * (len(left) + len(right) - both)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return tasks(both.select("a", "b", "ta", "tb"), n, 2000).mapInArrow(out, "a long, b long")


def _open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members, with their components, of buckets that hold more than one component, and how many are in the largest one there (main) and not (rest)."""
    who = members.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left")
    who = written(who.select("bucket", "rep", F.coalesce("component", "rep").alias("component")), "bucket_components")
    sizes = who.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket")
    mixed = sizes.agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("main"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    return written(who.join(written(mixed, "mixed"), "bucket").withColumn("largest", F.col("largest") == F.col("component")), "open_members")


def parity_map(items: np.ndarray) -> np.ndarray:
    """For each of 8 or more bits per element, MAX_MAP at most, whether an odd number of elements fall on it."""
    bits = 512
    while bits < min(8 * len(items), MAX_MAP):
        bits *= 2
    odd = np.bincount((items & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _open_pairs(t: pa.Table, similar: int, forests: int) -> pa.Table:
    """Of blocks (bucket, i, j): pairs (a, b) of different components that may link, no more than connect a block's components ``forests`` times."""
    bucket, i_, j_, ids, n, mine, component = (t.column(c).to_numpy() for c in ("bucket", "i", "j", "rep", "n", "mine", "component"))
    maps, tested, out = [np.frombuffer(m, np.uint64) for m in t.column("map").to_pylist()], [set(x or ()) for x in t.column("tested").to_pylist()], []
    width, by = np.array([len(m) for m in maps]), np.lexsort((j_, i_, bucket))
    edge = np.flatnonzero((np.diff(bucket[by]) != 0) | (np.diff(i_[by]) != 0) | (np.diff(j_[by]) != 0)) + 1
    for block in np.split(by, edge):
        groups = np.tile(np.unique(component[block], return_inverse=True)[1], (forests, 1))
        for w in np.unique(width[block]):  # sets that may link differ in size by less than twice, maps fold to half their size
            near = np.flatnonzero((width[block] == w) | (width[block] == 2 * w))
            rows = block[near]
            table, size, part = np.stack([maps[x] if width[x] == w else maps[x][:w] ^ maps[x][w:] for x in rows]), n[rows], mine[rows]
            for at in np.flatnonzero(width[rows] == w):
                fits = (groups[-1][near] != groups[-1][near[at]]) & (100 * np.minimum(size, size[at]) >= similar * np.maximum(size, size[at])) & ((width[rows] != w) | (near > near[at]))
                if i_[rows[0]] != j_[rows[0]]:
                    fits &= part != part[at]
                rest = np.flatnonzero(fits)
                most = (100 - similar) * (size[at] + size[rest]) // (100 + similar)
                for y in rest[np.bitwise_count(table[rest] ^ table[at]).sum(1) <= most]:
                    a, b = (rows[at], rows[y]) if ids[rows[at]] > ids[rows[y]] else (rows[y], rows[at])
                    apart = np.flatnonzero(groups[:, near[at]] != groups[:, near[y]])
                    if len(apart) and int(ids[b]) not in tested[a]:
                        out.append((ids[a], ids[b]))
                        group = groups[apart[0]]
                        group[group == group[near[y]]] = group[near[at]]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _parity_maps(texts: DataFrame) -> DataFrame:
    """(rep, n, map) of the texts."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity_map(s).tobytes() for s in sets], pa.binary())], ["rep", "n", "map"])

    return written(small_batches(texts).select("doc_id", "text").mapInArrow(draw, "rep long, n long, map binary").dropDuplicates(["rep"]), "maps")


def _block_pairs(members: DataFrame, n: int, maps: DataFrame, tested: DataFrame | None, similar: int, forests: int) -> DataFrame:
    """What ``_open_pairs`` gives for n members (bucket, rep, component) of open buckets, but for ``tested`` pairs.

    With nothing tested yet, parts of about PART members of a bucket of ``size`` meet themselves and the first. After that
    every two parts meet, but for two of the bucket's largest component, whose members are known to belong together: a
    bucket of copies and a few others takes as many rows as it has members. Small blocks share a task's group of rows.
    """
    groups, mine, dealt = max(1, n // 2000), F.col("mine"), F.xxhash64("rep")
    parts = lambda c: F.ceil(F.col(c) / PART).cast("int")
    if tested is None:
        rows = members.withColumn("mine", F.pmod(dealt, parts("size")).cast("int"))
        others = F.when(mine == 0, F.sequence(F.lit(0), parts("size") - 1)).otherwise(F.array_distinct(F.array(F.lit(0), mine)))
    else:
        one, rest, main = F.col("main") + F.col("rest") <= PART, F.pmod(dealt, parts("rest")), F.pmod(dealt, parts("main"))
        rows = members.withColumn("mine", F.when(one, 0).when(F.col("largest"), parts("rest") + main).otherwise(rest).cast("int"))
        others = F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), parts("rest") - 1 + F.when(F.col("largest"), 0).otherwise(parts("main"))))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "component")
    rows = rows.join(maps, "rep")
    if tested is None:
        rows = rows.withColumn("tested", F.lit(None).cast("array<long>"))
    else:
        rows = rows.join(tested.groupBy(F.col("a").alias("rep")).agg(F.collect_list("b").alias("tested")), "rep", "left")
    group = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups))
    return tasks(rows.groupBy(group.alias("group")).applyInArrow(lambda t: _open_pairs(t, similar, forests), "a long, b long").distinct(), n)


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of documents (doc_id, text).

    Two documents link where 100 * intersection >= similar * union of their shingle sets. A pair at the threshold of
    85 shares one of 25 bands of 5 slots with a probability above 0.999999. Null, empty and blank texts have no
    shingles and link with nothing; texts under five words have one shingle, their whole sequence. Rows that repeat a
    text link at once. doc_id names a document: rows with one doc_id but different texts are one node. Rows with a
    null doc_id get their class's component (null if it has none) and are kept where that is null. Further columns are
    ignored, whatever their names.
    """
    sigs = written(signatures(docs, slots, bands), "signatures")
    classes = sigs.where("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("rep")).where(F.col("rep").isNotNull())
    classes = written(classes, "classes")
    reps = classes.join(sigs.where("n_shingles > 0"), (sigs["print"] == classes["print"]) & (F.col("doc_id") == F.col("rep"))).select("rep", "bands")
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    who = [F.count("*").alias("size"), F.min("rep").alias("low"), F.max("rep").alias("top"), F.bit_xor(F.xxhash64("rep")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("h2")]
    shared = buckets.groupBy("bucket").agg(*who).where("low < top")
    shared = shared.groupBy("size", "low", "top", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket", "size")  # of buckets with equal members, one
    members = written(buckets.join(written(shared, "shared_buckets"), "bucket"), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct().hint("merge")  # they grow with the input: never broadcast
    texts = written(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), "candidate_texts")
    maps, tested, groups, forests = _parity_maps(texts), None, None, 1
    open_ = members.withColumn("component", F.col("rep"))
    while True:
        found = _block_pairs(open_, open_.count(), maps, tested, similar, forests)
        fresh = written(found if tested is None else found.join(tested, ["a", "b"], "left_anti"), "pairs")
        n = fresh.count()
        if tested is not None and not n:
            break
        links = written(_confirmed(fresh, n, texts, similar), "confirmed")
        done = tested is not None and links.count() == n  # all parts met, and what might link does
        both = links if groups is None else links.unionByName(groups.select(F.col("id").alias("a"), F.col("component").alias("b")))
        groups, tested, forests = written(components(both), "groups"), fresh if tested is None else tested.unionByName(fresh), forests * 4
        if done:
            break
        open_ = _open_members(members, groups)
    named = classes.join(groups, classes["rep"] == groups["id"], "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("print")).alias("print")).join(named, "print", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component) | component.isNull()).alias("kept"))


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE - 2}, 2)), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= {SIMILAR} * (p.n + q.n - shared)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c ON id = doc_id LEFT JOIN n USING (doc_id)
"""


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
