"""Substring dedup by recompression: words of a 50-word window that an earlier document also has are removed.

Rounds of renaming shorten every text: a round names maximal runs of one symbol, or pairs of a left and a right symbol
(each symbol is one of the two by its hash), by a hash of what they stand for, so names agree over the whole corpus
without any exchange. Equal passages get equal symbols but for a few at their ends, and how many these can be is known
from the passage itself: the first symbol may have been joined to something before it only if it is a right one, the
last one to something behind it only if it is a left one. What is left inside a window after all rounds therefore depends
on the window alone; its longest symbol is the window's anchor, and windows with equal words have equal anchors.

Neighbouring windows share anchors, so a document has about one anchor per 20 words. Spark joins these: anchors of two
documents or more, then equal spans (all windows of an anchor at once), and only where the spans of an anchor differ
are its windows compared one by one, once for each distinct span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import read_table, written
from cairn.llm.minhash import _WORDS, _mix

WINDOW, RUN_ROUNDS, ROUNDS = 50, (0, 4), 8
_U = np.uint64
_P, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_OCCURRENCES = "array<struct<anchor:long,span:long,start:int,n:int>>"


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))


class Spans:
    """Hashes of any stretch of a sequence of word hashes."""

    def __init__(self, w: np.ndarray):
        up, down = np.full(len(w) + 1, _P, np.uint64), np.full(len(w) + 1, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * np.cumprod(up)[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64)).view(np.int64)


def _longest(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each range [a, b) the first index with the greatest key."""
    out, width = np.empty(len(a), np.int64), b - a
    table, h = np.arange(len(key)), 1
    while len(a):
        now = np.flatnonzero((width >= h) & (width < 2 * h))
        if len(now):
            x, y = table[a[now]], table[b[now] - h]
            out[now] = np.where(key[x] >= key[y], x, y)
        if len(table) <= h or width.max() < 2 * h:
            return out
        x, y = table[:-h], table[h:]
        table, h = np.where(key[x] >= key[y], x, y), 2 * h
    return out


def anchors(w: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of the word hashes w that begin at ``at``: the name of the anchor, and the word where it begins.

    w may be many texts end to end: what surrounds a window does not change its anchor.
    """
    name, begin = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    if not len(at):
        return name, begin
    alive, sym, start = np.arange(len(at)), _mix(w), np.arange(len(w))
    a, b = at.copy(), at + window

    def settle(which: np.ndarray, level: int) -> None:
        length = np.diff(np.append(start, len(w))).astype(np.uint64)
        got = _longest((np.minimum(length, _U(255)) << _U(56)) | (sym >> _U(8)), a[which], b[which])
        name[alive[which]] = _mix(sym[got] + _U(level))
        begin[alive[which]] = start[got]

    for k in range(ROUNDS):
        m = len(sym)
        head = np.ones(m + 1, bool)
        if k in RUN_ROUNDS:
            head[1:m] = sym[1:] != sym[:-1]
            first = np.flatnonzero(head)  # of each run, and m
            run = np.cumsum(head[:m]) - 1
            a2, b2 = first[run[a] + 1], first[run[b - 1]]
            length = np.diff(first)
            heads = first[:-1]
            new = np.where(length > 1, _mix(sym[heads] * _U(_P) + length.astype(np.uint64)), sym[heads])
        else:
            left = (_mix(sym + _U(k)) & _U(1)).astype(bool)
            head[1:m] = ~(left[:-1] & ~left[1:])
            a2, b2 = a + ~left[a], b - left[b - 1]
            heads = np.flatnonzero(head[:m])
            new = sym[heads]
            paired = np.flatnonzero(~head[heads + 1])
            i = heads[paired]
            new[paired] = _mix((sym[i] * _U(_P) + sym[i + 1]) * _U(_P) + _U(k))
        to = np.cumsum(head) - 1
        go = a2 < b2
        if not go.all():
            settle(np.flatnonzero(~go), k)
        alive, a, b = alive[go], to[a2[go]], to[b2[go]]
        sym, start = new, start[heads]
    settle(np.arange(len(alive)), ROUNDS)
    return name, begin


def occurrences(texts: list[np.ndarray], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Index of the text, anchor, hash of the span, first window and number of windows of each anchor's stretch of windows."""
    size = np.array([len(t) for t in texts], np.int64)
    n, base = np.maximum(size - window + 1, 0), np.cumsum(size) - size
    w, of = np.concatenate([np.zeros(0, np.uint64), *texts]), np.repeat(np.arange(len(texts)), n)
    at = base[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
    name, begin = anchors(w, at, window)
    edge = np.ones(len(of), bool)
    edge[1:] = (begin[1:] != begin[:-1]) | (name[1:] != name[:-1])
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, len(of)))
    return of[first], name[first].view(np.int64), Spans(w)(at[first], at[first] + count + window - 1), at[first] - base[of[first]], count


def _digest(found: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(found)).hexdigest()


def _marked(docs: DataFrame) -> DataFrame:
    def done(batch: pa.RecordBatch, i: int, found: list[list[bytes]]) -> pa.RecordBatch:
        of, *rows = occurrences([word_hashes(x) for x in found])
        items = pa.StructArray.from_arrays([pa.array(x.astype(kind)) for x, kind in zip(rows, ("i8", "i8", "i4", "i4"))], ["anchor", "span", "start", "n"])
        ends = np.searchsorted(of, np.arange(len(found) + 1)).astype(np.int32)
        part = batch.slice(i, len(found))
        return pa.RecordBatch.from_arrays([part.column("doc"), part.column("p"), pa.array([len(x) for x in found], pa.int64()), pa.array(list(map(_digest, found))), pa.ListArray.from_arrays(pa.array(ends), items)], ["doc", "p", "n_words", "digest", "occ"])

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, i, total = batch.column("text").cast(pa.binary()), [], 0, 0
            for k in range(len(texts)):
                found.append((texts[k].as_py() or b"").split())
                total += len(found[-1])
                if total > 60_000:
                    yield done(batch, i, found)
                    found, i, total = [], k + 1, 0
            if found:
                yield done(batch, i, found)

    return docs.select("doc", "p", "text").mapInArrow(out, f"doc long, p long, n_words long, digest string, occ {_OCCURRENCES}")


def _windows(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor, hash, doc, p, start) of every single window of the stretches (doc, p, anchor, start, n)."""
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].values
                w = word_hashes(batch.column("text")[i].as_buffer().to_pybytes().split())
                n = rows.field("n").to_numpy()
                start = np.repeat(rows.field("start").to_numpy(), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                got = Spans(w)(start, start + WINDOW)
                same = lambda c: pa.array(np.full(len(got), batch.column(c)[i].as_py(), np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows.field("anchor").to_numpy(), n)), pa.array(got), same("doc"), same("p"), pa.array(start.astype(np.int32))], ["anchor", "hash", "doc", "p", "start"])

    rows = found.groupBy("doc", "p").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("rows"))
    return docs.join(rows, ["doc", "p"]).select("doc", "p", "text", "rows").mapInArrow(out, "anchor long, hash long, doc long, p long, start int")


def _kept(flags: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, p, n_removed, kept_text) of the documents with windows to remove."""
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, rows in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("rows")):
                found = text.split()
                edge = np.zeros(len(found) + 1, np.int64)
                start, n = rows.values.field("start").to_numpy(), rows.values.field("n").to_numpy()
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n + WINDOW - 1, -1)
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                removed.append(len(found) - len(stay))
                kept.append(b" ".join([found[k] for k in stay]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("p"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc", "p", "n_removed", "kept_text"])

    rows = flags.groupBy("doc", "p").agg(F.collect_set(F.struct("start", "n")).alias("rows"))
    return docs.join(rows, ["doc", "p"]).select("doc", "p", "text", "rows").mapInArrow(out, "doc long, p long, n_removed long, kept_text string")


def repeated_windows(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Stretches (doc, p, start, n) of windows that a document with a smaller id has too."""
    found = marked.select("doc", "p", F.explode("occ").alias("o")).select("doc", "p", "o.*")
    shared = found.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor")
    found = written(found.join(written(shared, "shared_anchors"), "anchor"), "shared_occurrences")
    spans = written(found.groupBy("anchor", "span").agg(F.min("doc").alias("first")), "spans")
    split = written(spans.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "split_anchors")
    found = written(found.join(spans, ["anchor", "span"]), "found")
    whole = found.where("doc > first").select("doc", "p", "start", "n")
    windows = written(_windows(found.where("doc = first").join(split, "anchor", "left_semi"), docs), "windows")
    firsts = windows.groupBy("anchor", "hash").agg(F.min("doc").alias("first"), F.max("doc").alias("high")).where("first < high").select("anchor", "hash", "first")
    single = windows.join(written(firsts, "first_windows"), ["anchor", "hash"]).where("doc > first").select("doc", "p", "start", F.lit(1).alias("n"))
    return whole.unionByName(single)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, digest, kept_text) per row of documents (doc_id, text).

    kept_text is null where nothing is removed, the digest is that of the kept words joined by one space. Null, empty and
    blank texts have no words; texts under 50 words lose none. Exact copies lose all words but in the smallest doc_id;
    rows that repeat a doc_id do not count as earlier for each other. A null doc_id ranks last. Texts may be of any
    length. Other columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("p"), "text")
    marked = written(_marked(docs), "marked")
    flags = repeated_windows(docs, marked)
    kept = _kept(flags, docs.select("doc", "p", "text").where(F.col("text").isNotNull())).dropDuplicates(["doc", "p"])
    out = marked.select("doc", "p", "n_words", "digest").join(kept, ["doc", "p"], "left")
    digest = F.when(F.col("kept_text").isNull(), F.col("digest")).otherwise(F.sha2(F.col("kept_text").cast("binary"), 256))
    doc_id = F.when(F.col("doc") != 2**63 - 1, F.col("doc"))
    return out.select(doc_id.alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), digest.alias("digest"), "kept_text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.col("digest").alias("kept_sha256"))
