"""Embedding near-dedup by NN-descent within labels.

1. Equal vectors of a label form a class; one vector stands for it. Each gets a sketch: its unit vector in whole numbers of
   one byte with the length of the rounding error, which bounds the error of any cosine between sketches. The graph is
   searched on sketches; pairs whose cosine might reach the threshold are confirmed on the vectors in double precision.
2. Neighbour lists start from cells of vectors on the same side of random hyperplanes. How many planes, and how many
   tables of cells for a pair at the threshold to meet in one, follows from each label's own size; a label that fits one
   block is compared in full. So is an overfull cell, as near copies make, in parts; one of over WHOLE blocks is split first
   by planes through the middle between two of its vectors.
3. NN-descent: the neighbours of every vector, forward and backward, are compared with each other until few entries change.
4. Links are kept beside the lists: whatever a comparison connects takes no place in them, so a list is enlarged by as many
   places as its vector has links there, and a list full of links, which could hide others, does not occur. After every round
   links are merged into groups, and only links between what were different groups are passed on: no group grows denser, and
   the plan of a round does not depend on how many rounds there were.
5. A bounded sample, a new one each time, is audited against all vectors: while recall, the mean share of a vector's links
   that the graph connects, is under TARGET, more tables are added; if that does not help, an error is raised. Missed links
   that the audit finds join the result, but never the graph that the next sample measures. As a sample may hold no link at all,
   the search is measured on PLANTED twins as well: vectors of labels too large to be compared in full, turned away to a cosine
   just above the threshold, which take part in the search under ids of their own and in nothing else: a twin is tied to groups,
   but connects nothing.
6. Members of a group are compared with each other in blocks, which counts every link between them.
Groups, cells and neighbourhoods of any size are dealt out in parts of bounded size, and every two parts are compared.
"""

from __future__ import annotations

import logging
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import read_table, written
from cairn.llm.graph import components

COSINE, LIST, BLOCK, PART, SAMPLE, TARGET, MAX_BATCHES, SEED, DELTA, MISS, WHOLE, PLANTED = 0.93, 8, 1024, 128, 1024, 0.995, 4, 5, 0.001, 0.001, 32, 512
_FLOAT32 = 1e-5  # more than products in single precision lose
_SKETCH = "q binary, s double, e double"
log = logging.getLogger(__name__)


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny numbers would vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sketched(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers q, scale s and error e of unit vectors u, with |u - s q| = e."""
    u = _unit(column)
    s = np.abs(u).max(axis=1, keepdims=True) / 127
    q = np.rint(u / s)
    return q.astype(np.int8), s[:, 0], np.linalg.norm(u - s * q, axis=1)


def _drawn(t) -> np.ndarray:
    """The sketches of a table as vectors in single precision."""
    q = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int8).reshape(t.num_rows, -1)
    return q.astype(np.float32) * t.column("s").to_numpy()[:, None].astype(np.float32)


def _dealt(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``rows`` of each key in parts of about ``size``, so that every two parts, and each part with itself, meet in one block (keys, i, j)."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    rows = rows.join(parts, keys).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("parts", "other")


_FOUND = "src long, dst long, sim double, sure boolean, twin boolean, deep boolean"


def _compared(t: pa.Table, sets: list[np.ndarray], apart: list[bool], k: int, cosine: float) -> pa.Table:
    """Of sets of rows that meet: (src, dst, sim), up to k nearest of each vector above its floor; and (src, dst, null, sure, twin),
    what the links of a set connect and, not sure, what may be a link besides. Deep is what k > 0 searches.

    Vectors that a set's links connect do not count as near in it. In sets that are ``apart`` only rows of different parts meet.
    Twins connect nothing and do not meet each other: a set has one pair, twin first, for a twin and what the other links connect.
    """
    u, e, ids, floor, mine, twin = _drawn(t), *(t.column(c).to_numpy() for c in ("e", "id", "floor", "mine", "twin"))
    e, size, found, a_, b_, sure = e.astype(np.float32), np.array([len(x) for x in sets]), [], [], [], []

    def tie(rows, c, i, j, group, is_sure):
        """The first pair of each twin (c, i) and group."""
        once = np.unique((c * rows.shape[1] + i) * rows.shape[1] + group[c, j], return_index=True)[1]
        a_.append(rows[c, i][once])
        b_.append(rows[c, j][once])
        sure.append(np.full(len(once), is_sure))

    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        m = size[order[min(at + 63, len(order) - 1)]]
        some = order[at : at + max(1, min(64, 4_000_000 // max(m * m, 1)))]
        at, m = at + len(some), size[some[-1]]
        rows, real = np.zeros((len(some), m), int), np.arange(m) < size[some][:, None]
        rows[real] = np.concatenate([sets[x] for x in some])
        x, err = u[rows], e[rows]
        sim = x @ x.transpose(0, 2, 1)
        good = real[:, :, None] & real[:, None] & ~np.eye(m, dtype=bool)
        two = np.array([apart[x] for x in some])
        if two.any():
            good[two] &= mine[rows[two]][:, :, None] != mine[rows[two]][:, None]
        tc, ti = np.nonzero(twin[rows] & real)
        if len(tc):
            good[tc, ti] &= ~twin[rows[tc]]
        slack = err[:, :, None] + err[:, None] * (1 + err[:, :, None]) + np.float32(_FLOAT32)
        near = (sim - slack >= cosine) & good
        maybe = (sim + slack >= cosine) & good & ~near
        tied, doubtful = near[tc, ti], maybe[tc, ti]
        for x in (near, maybe):
            x[tc, ti] = x[tc, :, ti] = False
        group = np.broadcast_to(np.arange(m), rows.shape)
        linked = near.any((1, 2))
        if linked.any():
            group, low, before = group.copy(), None, None
            low = group[linked]
            while before is None or (low != before).any():
                before, low = low, np.minimum(low, np.where(near[linked], low[:, None], m).min(2))
            group[linked] = low
            key = (np.arange(len(some))[:, None] * m + group)[real]
            flat, by = rows[real], np.argsort(key, kind="stable")
            one = key[by][1:] == key[by][:-1]
            a_.append(flat[by][:-1][one])
            b_.append(flat[by][1:][one])
            sure.append(np.ones(one.sum(), bool))
        other = group[:, :, None] != group[:, None]
        if len(tc):
            of, hidden = group[tc], np.zeros(tied.shape, bool)
            x, j = np.nonzero(tied)
            tie(rows, tc[x], ti[x], j, group, True)
            hidden[x, of[x, j]] = True
            hidden = np.take_along_axis(hidden, of, 1)  # what a twin is tied to is not near it either
            other[tc, ti] &= ~hidden
            other[tc, :, ti] &= ~hidden
            x, j = np.nonzero(doubtful & ~hidden)
            by = np.argsort(-sim[tc[x], ti[x], j], kind="stable")
            tie(rows, tc[x][by], ti[x][by], j[by], group, False)
        c, i, j = np.nonzero(maybe & other)
        c, i, j = (v[i < j] for v in (c, i, j))
        a_.append(rows[c, i])
        b_.append(rows[c, j])
        sure.append(np.zeros(len(c), bool))
        if k > 0 and m > 1:
            sim[~(good & other)] = -2
            best = np.argpartition(-sim, min(k, m) - 1, axis=2)[:, :, :k]
            got = np.take_along_axis(sim, best, axis=2)
            c, i, j = np.nonzero(got > np.where(real, floor[rows], 2)[:, :, None])
            found.append((rows[c, i], rows[c, best[c, i, j]], got[c, i, j]))
    join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
    a, b, sure = join(a_, int), join(b_, int), join(sure, bool)
    out = [pa.table({"src": ids[a], "dst": ids[b], "sim": pa.nulls(len(a), pa.float64()), "sure": sure, "twin": twin[a], "deep": np.full(len(a), k > 0)})]
    if found:
        src, dst, sim = (join(x, kind) for x, kind in zip(zip(*found), (int, int, np.float32)))
        src, dst = ids[src], ids[dst]
        by = np.lexsort((dst, -sim, src))
        src, dst, sim = src[by], dst[by], sim[by]
        once = np.ones(len(src), bool)
        once[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
        src, dst, sim = src[once], dst[once], sim[once]
        first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, int)
        rank = np.arange(len(src)) - np.repeat(first, np.diff(np.r_[first, len(src)]))
        src, dst, sim = src[rank < k], dst[rank < k], sim[rank < k]
        out.append(pa.table({"src": src, "dst": dst, "sim": sim.astype(np.float64), "sure": (no := pa.nulls(len(src), pa.bool_())), "twin": no, "deep": no}))
    return pa.concat_tables(out)


def _sketches(vectors: DataFrame, cosine: float) -> DataFrame:
    """(id, label, twin, q, s, e, bits, tables) of (id, label, twin, v): how many planes and tables a label's size asks for; no planes where it is one block."""
    def sketch(batches):
        for part in batches:
            q, s, e = _sketched(part.column("v"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "label", "twin")), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(s), pa.array(e)], ["id", "label", "twin", "q", "s", "e"])

    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / BLOCK)).cast("int"))
    sizes = vectors.groupBy("label").agg(bits.alias("bits"))
    meet = F.pow(F.lit(1 - np.arccos(cosine) / np.pi), F.col("bits"))  # that a pair at the threshold falls into one cell
    tables = F.when(F.col("bits") == 0, 1).otherwise(F.ceil(np.log(MISS) / F.ln(1 - meet))).cast("int")
    sizes = sizes.select("label", "bits", tables.alias("tables"))
    return written(vectors.select("id", "label", "twin", "v").mapInArrow(sketch, f"id long, label long, twin boolean, {_SKETCH}").join(sizes, "label"), "sketches")


def _cells(rows: DataFrame, seed: int, k: int, cosine: float) -> DataFrame:
    """What comparing the vectors of every cell finds."""
    names = ["id", "label", "twin", "q", "s", "e", "floor", "bits"]
    types = f"id long, label long, twin boolean, {_SKETCH}, floor double, bits int, code long"

    def place(batches):
        for part in batches:
            u, bits, tables = _drawn(part), part.column("bits").to_numpy(), part.column("tables").to_numpy()
            at, codes = [np.zeros(0, int)], [np.zeros(0, int)]
            for t in range(tables.max(initial=0)):
                mine = np.flatnonzero(tables > t)
                b = bits[mine]
                planes = np.random.default_rng((seed, t)).normal(size=(b.max(initial=0), u.shape[1]))
                side = (u[mine] @ planes.T > 0) & (np.arange(len(planes)) < b[:, None])
                at.append(mine)
                codes.append((side << np.arange(len(planes))).sum(1) << 10 | t)
            at = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in names), pa.array(np.concatenate(codes))], [*names, "code"])

    def split(batches):
        for part in batches:
            u, more, table, sub = _drawn(part), part.column("more").to_numpy(), part.column("code").to_numpy() & 1023, np.zeros(part.num_rows, int)
            for one in ("low", "high"):
                end = part.column(one)
                u -= 0.5 * np.frombuffer(b"".join(end.field("q").to_pylist()), np.int8).reshape(u.shape).astype(np.float32) * end.field("s").to_numpy(zero_copy_only=False)[:, None].astype(np.float32)
            for t in np.unique(table):
                planes = np.random.default_rng((seed, t, 1)).normal(size=(more.max(), u.shape[1]))
                side = (u[table == t] @ planes.T > 0) & (np.arange(len(planes)) < more[table == t][:, None])
                sub[table == t] = (side << np.arange(len(planes))).sum(1)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [*names, "code"]), pa.array(sub)], [*names, "code", "sub"])

    def block(t: pa.Table) -> pa.Table:
        return _compared(t, [np.arange(t.num_rows)], [t.column("i")[0] != t.column("j")[0]], k if t.column("bits")[0].as_py() else 0, cosine)

    cell = ["label", "code"]
    placed = written(rows.mapInArrow(place, types), "placed")
    over = placed.groupBy(*cell).agg(F.count("*").alias("n"), F.min_by(F.struct("q", "s"), "id").alias("low"), F.max_by(F.struct("q", "s"), "id").alias("high")).where(F.col("n") > 2 * BLOCK)
    over = written(over.select(*cell, "low", "high", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / (WHOLE * BLOCK))) + 1).cast("int").alias("more")), "overfull")
    zero = F.lit(0)
    met = placed.join(over.select(*cell), cell, "left_anti").withColumns({"sub": zero.cast("long"), "mine": zero, "i": zero, "j": zero})
    if not over.isEmpty():
        parts = _dealt(placed.join(over, cell).mapInArrow(split, f"{types}, sub long"), [*cell, "sub"], 2 * BLOCK)
        met = met.unionByName(parts)
    return met.groupBy(*cell, "sub", "i", "j").applyInArrow(block, _FOUND)


def _best(found: DataFrame, old: DataFrame | None, k: int) -> DataFrame:
    """The k best entries (src, dst, sim, new) of each list; new are those that ``old`` has not."""
    rows = found.where("sim IS NOT NULL").select("src", "dst", "sim", F.lit(True).alias("new"))
    rows = rows if old is None else rows.unionByName(old.withColumn("new", F.lit(False)))
    rows = rows.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    best = rows.groupBy("src").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "dst", "new")), asc=False), 1, k).alias("l"))
    return written(best.select("src", F.explode("l").alias("x")).select("src", "x.dst", "x.sim", "x.new"), "lists")


def _descend(rows: DataFrame, lists: DataFrame, ties: DataFrame, n: int, k: int, cosine: float) -> DataFrame:
    """What comparing the neighbours of each of n vectors, by lists and by ties (a, b, new), with each other finds.

    Vectors without new neighbours are left out. Neighbourhoods go to n / 256 groups of rows, large ones in parts.
    """
    edges = lists.select("src", "dst", "new").unionByName(ties.select(F.col("a").alias("src"), F.col("b").alias("dst"), "new"))
    near = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "new"))
    near = near.groupBy("src", F.col("dst").alias("id")).agg(F.min("new").alias("new"))
    open_ = near.where("new").select("src").distinct()
    near = near.select("src", "id").join(open_, "src", "left_semi").unionByName(open_.select("src", F.col("src").alias("id")))
    worst = lists.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("worst"))
    full = rows.join(worst, "id", "left").select("id", "twin", "q", "s", "e", F.greatest("floor", "worst").alias("floor"))
    group = F.pmod(F.xxhash64("src", "i", "j"), F.lit(max(1, n // 256))).alias("group")
    near = _dealt(near, ["src"], PART).select(group, "src", "i", "j", "mine", "id").join(full, "id")

    def meet(t: pa.Table) -> pa.Table:
        src, i, j = (t.column(c).to_numpy() for c in ("src", "i", "j"))
        by = np.lexsort((j, i, src))
        edge = np.flatnonzero((np.diff(src[by]) != 0) | (np.diff(i[by]) != 0) | (np.diff(j[by]) != 0)) + 1
        sets = np.split(by, edge)
        return _compared(t, sets, [i[x[0]] != j[x[0]] for x in sets], k, cosine)

    return near.groupBy("group").applyInArrow(meet, _FOUND)


def _fresh(found: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The pairs (a, b, sure, twin, deep, a_of, b_of) that comparisons found between different groups, each once; a twin is a."""
    least, most = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = found.where("sim IS NULL").select(F.when(F.col("twin"), F.col("src")).otherwise(least).alias("a"), F.when(F.col("twin"), F.col("dst")).otherwise(most).alias("b"), "sure", "twin", "deep")
    pairs = pairs.groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("sure", "twin", "deep")))
    if groups is None:
        return written(pairs.withColumns({"a_of": F.col("a"), "b_of": F.col("b")}), "fresh")
    return written(_between(pairs, groups), "fresh")


def _between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different groups, with these as a_of and b_of."""
    of = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"{c}_of"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.withColumns({"a_of": F.coalesce("a_of", "a"), "b_of": F.coalesce("b_of", "b")}).where("a_of != b_of")


def _merged(groups: DataFrame | None, fresh: DataFrame) -> DataFrame | None:
    """``groups`` (id, component) after the sure ones of ``fresh``: links merge groups, a twin is only put into one of those it is tied to."""
    sure = fresh.where("sure")
    links, twins = sure.agg(F.count_if(~F.col("twin")), F.count_if("twin")).first()
    if not links + twins:
        return groups
    link = sure.where("NOT twin")
    ends = [link.select(F.col("a").alias("id"), F.col("a_of").alias("component")), link.select(F.col("b").alias("id"), F.col("b_of").alias("component")), sure.where("twin").select(F.col("a").alias("id"), F.col("b_of").alias("component"))]
    ends = reduce(DataFrame.unionByName, ends if groups is None else [groups, *ends])
    if links:
        into = components(link.select(F.col("a_of").alias("a"), F.col("b_of").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("into"))
        ends = ends.join(into, "component", "left").select("id", F.coalesce("into", "component").alias("component"))
    return written(ends.groupBy("id").agg(F.min("component").alias("component")), "groups")


class _Graph(NamedTuple):
    """What a search has found: lists, ties (a, b, twin, new) and groups (id, component), and pairs that may be links in ``doubtful``."""

    lists: DataFrame | None = None
    ties: DataFrame | None = None
    groups: DataFrame | None = None
    doubtful: tuple[DataFrame, ...] = ()


def _search(sketches: DataFrame, graph: _Graph, seed: int, k: int, cosine: float) -> _Graph:
    """``graph`` after one more NN-descent."""
    rows = sketches.withColumn("floor", F.lit(-2.0))
    lists, ties, groups, doubtful = graph
    n, found = sketches.where("bits > 0").count(), _cells(rows, seed, k, cosine)
    while True:
        found = written(found, "found")
        fresh = _fresh(found, groups)
        before, groups, doubtful = groups, _merged(groups, fresh), (*doubtful, fresh.where("NOT sure"))
        if not n:
            return _Graph(lists, ties, groups, doubtful)
        more, old = fresh.where("sure AND deep").select("a", "b", "twin", F.lit(True).alias("new")), ties and ties.withColumn("new", F.lit(False))
        ties = more if old is None else old if groups is before else written(more.unionByName(old), "ties")
        lists = _best(found, lists, k)
        if lists.where("new").count() <= DELTA * k * n:
            return _Graph(lists, ties, groups, doubtful)
        found = _descend(rows.where("bits > 0"), lists, ties, n, k, cosine)


def _confirmed(graph: _Graph, vectors: DataFrame, cosine: float) -> _Graph:
    """``graph`` with the links among its doubtful pairs, confirmed on the vectors."""
    def confirm(batches):
        for part in batches:
            good = pa.array((_unit(part.column("va")) * _unit(part.column("vb"))).sum(1) >= cosine)
            yield pa.RecordBatch.from_arrays([part.column(c).filter(good) for c in names], names)

    names = ["a", "b", "twin", "deep", "a_of", "b_of"]
    named = lambda c: vectors.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"))
    pairs = reduce(DataFrame.unionByName, graph.doubtful).select("a", "b", "twin", "deep").distinct()
    pairs = pairs.withColumns({"a_of": F.col("a"), "b_of": F.col("b")}) if graph.groups is None else _between(pairs, graph.groups)
    links = pairs.join(named("a"), "a").join(named("b"), "b").select(*names, "va", "vb").mapInArrow(confirm, "a long, b long, twin boolean, deep boolean, a_of long, b_of long")
    links = written(links.withColumn("sure", F.lit(True)), "confirmed")
    ties = graph.ties if graph.ties is None else graph.ties.unionByName(links.where("deep").select("a", "b", "twin", F.lit(True).alias("new")))
    return graph._replace(ties=ties, groups=_merged(graph.groups, links), doubtful=())


def audit(vectors: DataFrame, groups: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, seed: int = SEED) -> tuple[DataFrame, float | None]:
    """Brute force of a bounded sample, picked by hash, against all vectors: the links (a, b) whose ends are in different groups, and recall.

    Recall is the mean, over the sampled vectors that have links, of the share whose ends are in one group, so that a large
    group counts no more than its vectors; null where no sampled vector has a link, so that there is nothing to measure.
    """
    picked = vectors.select("id", "label", "v").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).toArrow()
    if not picked.num_rows:
        return vectors.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0), None
    shared = vectors.sparkSession.sparkContext.broadcast((picked.column("id").to_numpy(), picked.column("label").to_numpy(), _unit(picked.column("v"))))

    def check(batches):
        ids, labels, u = shared.value
        for part in batches:
            mine = part.column("id").to_numpy()
            near = (_unit(part.column("v")) @ u.T >= cosine) & (part.column("label").to_numpy()[:, None] == labels) & (mine[:, None] != ids)
            i, j = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([pa.array(mine[i]), pa.array(ids[j])], ["a", "b"])

    links = vectors.select("id", "label", "v").mapInArrow(check, "a long, b long")
    group = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"{c}_of"))
    named = links.join(group("a"), "a", "left").join(group("b"), "b", "left")
    named = written(named.select("a", "b", (F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).alias("missed")), "audited")
    recall = named.groupBy("b").agg(F.avg((~F.col("missed")).cast("int")).alias("share")).agg(F.avg("share")).first()[0]
    return named.where("missed").select("a", "b"), recall


def _planted(vectors: DataFrame, cosine: float, number: int, seed: int) -> tuple[DataFrame, int] | None:
    """(id, label, v, source) and their number: twins of up to ``number`` vectors, picked by hash, of labels that are not compared in
    full, at cosines from just above the threshold to a fifth of the way to 1; None where there is no such label."""
    large = vectors.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    picked = vectors.join(large, "label").select("id", "label", "v").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(number).toArrow()
    if not picked.num_rows or (u := _unit(picked.column("v"))).shape[1] < 2:
        return None
    rng = np.random.default_rng(seed)
    away = rng.normal(size=u.shape)
    away -= (away * u).sum(1, keepdims=True) * u
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = cosine + (1 - cosine) * rng.uniform(0.002, 0.2, (len(u), 1))
    drawn = [int(x) for x in dict.fromkeys(rng.integers(-(2**63), 2**63 - 1, 2 * len(u)).tolist())]
    taken = {r.id for r in vectors.where(F.col("id").isin(drawn)).select("id").collect()}
    ids = [x for x in drawn if x not in taken][: len(u)]
    label, source = picked.column("label").to_pylist(), picked.column("id").to_pylist()
    rows = [(*x, v) for *x, v in zip(ids, label, source, (c * u + np.sqrt(1 - c * c) * away).tolist())]
    twins = vectors.sparkSession.createDataFrame(rows, "id long, label long, source long, v array<double>")
    return written(twins.select("id", "label", F.col("v").cast(vectors.schema["v"].dataType).alias("v"), "source"), "twins"), len(ids)


def _found_twins(twins: DataFrame, number: int, ties: DataFrame, groups: DataFrame) -> float:
    """The share of twins that a tie (a, b, twin) binds to the group of the vector they were made from."""
    ties = ties.where("twin").select(F.col("a").alias("id"), F.col("b").alias("to"))
    of = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"{c}_of"))
    ties = ties.join(twins.select("id", "source"), "id").join(of("to"), "to", "left").join(of("source"), "source", "left")
    return ties.where(F.coalesce("to_of", "to") == F.coalesce("source_of", "source")).select("id").distinct().count() / number


def _links_within(vectors: DataFrame, groups: DataFrame, cosine: float) -> DataFrame:
    """(id, links): the sizes of the classes that a class links to, summed; all members of a group are compared, in blocks."""
    def block(t: pa.Table) -> pa.Table:
        u, ids, size, mine = _unit(t.column("v")), *(t.column(c).to_numpy() for c in ("id", "size", "mine"))
        near = u @ u.T >= cosine
        np.fill_diagonal(near, False)
        if t.column("i")[0] != t.column("j")[0]:
            near &= mine[:, None] != mine
        return pa.table({"id": ids, "links": (near * size).sum(1).astype(np.int64)})

    rows = _dealt(vectors.join(groups, "id").select("component", "id", "size", "v"), ["component"], PART)
    return rows.groupBy("component", "i", "j").applyInArrow(block, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def embedding_dedup(embeddings: DataFrame, cosine: float = COSINE, k: int = LIST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Vectors link within one label at a cosine of ``cosine`` or more, in double precision. A null label, and a vector that is
    null, empty, zero or holds null or non-finite components, links with nothing. All vectors must have one length. A vec_id
    names one vector: rows that repeat it count once in the links of others. A null vec_id stands alone and is kept. An empty
    table gives no rows. Other columns are ignored, whatever their names. The recall of each batch is logged,
    over sampled links and over planted twins; it is an error if either stays under TARGET.
    """
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("embedding", lambda e: e != 0)
    v = F.transform("embedding", lambda e: e + F.lit(0).cast("float"))  # -0 is 0
    key = ["label", "h1", "h2"]
    rows = embeddings.where(fine).select("vec_id", F.col("label").cast("long").alias("label"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(3), v).alias("h2"), v.alias("v"))
    ids = rows.groupBy(*key, F.col("vec_id").alias("id")).agg(F.first("v").alias("v"))  # equal hashes: equal vectors
    vectors = written(ids.groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("size"), F.min_by("v", "id").alias("v")), "vectors")
    twins, number = _planted(vectors, cosine, PLANTED, SEED) or (None, 0)
    searched = vectors.select("id", "label", "v", F.lit(False).alias("twin"))
    searched = searched if twins is None else searched.unionByName(twins.select("id", "label", "v", F.lit(True).alias("twin")))
    sketches, graph, extra = _sketches(searched, cosine), _Graph(), None
    for batch in range(MAX_BATCHES):
        graph = _confirmed(_search(sketches, graph, SEED + batch, k, cosine), searched, cosine)
        groups = graph.groups
        groups = vectors.select("id", F.col("id").alias("component")).limit(0) if groups is None else groups if twins is None else groups.join(twins.select("id"), "id", "left_anti")
        missed, recall = audit(vectors, groups, cosine, SAMPLE, SEED + batch)
        found = None if twins is None else _found_twins(twins, number, graph.ties, groups)
        log.info("embedding near-dedup: recall %s of sampled links, %s of planted twins after %d batches", recall, found, batch + 1)
        extra = missed if extra is None else extra.unionByName(missed)
        if min((x for x in (recall, found) if x is not None), default=1.0) >= TARGET:  # nothing measured: all labels were compared in full
            break
    else:
        raise RuntimeError(f"recall is {recall} of sampled links and {found} of planted twins, not {TARGET}, after {MAX_BATCHES} batches of tables")
    if not extra.isEmpty():
        groups = written(components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(extra)), "groups")
    by_class = vectors.drop("v").join(groups, "id", "left").join(_links_within(vectors, groups, cosine), "id", "left")
    by_class = by_class.select(*key, F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    linked = rows.select("vec_id", *key).join(by_class, key).select("vec_id", "n_links", "component_id")
    alone = embeddings.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read_table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
