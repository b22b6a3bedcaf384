"""Toxicity: a second-order factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), x_i = 1 for every distinct term of
the whole text. The pair part learns what additive weights miss, such as an insult beside the mention of a group.
Terms enter by how many documents hold them, never by their labels.
It is fitted on a bounded sample of labelled rows, chosen by hash; the model's size is fixed by its parameters. Scoring
runs in Arrow batches over all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import read_table, small_batches, written

BITS, FACTORS, MAX_TRAIN, MIN_DOCS, EPOCHS, LEAST, SEED = 18, 6, 20_000, 4, (8, 6, 10), 0.1, 11
_TERM = re.compile(r"[^\W_]+(?:[*@$'][^\W_]+)*")
_NONE = np.zeros(0, np.int64)


class _Buckets(dict):
    """What stands between spaces to the hashed buckets of its terms, remembered; emptied when it grows large.

    Terms are the lower-cased words and their beginnings of 4 to 6 letters, which inflected forms share.
    """

    def __missing__(self, piece: str) -> bytes:
        if len(self) > 150_000:
            self.clear()
        terms = [t for w in _TERM.findall(piece.lower()) for t in (w, *("^" + w[:k] for k in (4, 5, 6) if len(w) > k))]
        self[piece] = got = b"".join([(zlib.crc32(t.encode()) & ((1 << BITS) - 1)).to_bytes(4, "little") for t in terms])
        return got


_BUCKETS = _Buckets()


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's terms."""
    if not text:
        return _NONE
    return np.unique(np.frombuffer(b"".join(map(_BUCKETS.__getitem__, set(text.split()))), "<i4")).astype(np.int64)


@dataclass
class FactorizationMachine:
    """bias, weights (2^BITS) and factors (2^BITS, FACTORS), and which buckets have either."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    live: np.ndarray | None = None

    def __post_init__(self):
        if self.live is None:
            self.live = (self.weights != 0) | self.factors.any(1)

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """The score before the sigmoid of each row of buckets."""
        out = np.full(len(rows), self.bias)
        live = [x[self.live[x]] for x in rows]
        n = np.array([len(x) for x in live], np.int64)
        if n.sum():
            flat, of = np.concatenate(live), np.repeat(np.arange(len(rows)), n)
            v = self.factors[flat]
            out += np.bincount(of, self.weights[flat], len(rows))
            for f in range(v.shape[1]):
                s = np.bincount(of, v[:, f], len(rows))
                out += 0.5 * (s * s - np.bincount(of, v[:, f] ** 2, len(rows)))
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -35, 35)))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: tuple[int, int, int] = EPOCHS, rate: float = 0.1, factor_rate: float = 0.03, l1: float = 0.01, l2: float = 1e-3, batch: int | None = None, seed: int = SEED) -> FactorizationMachine:
    """Minibatch AdaGrad on the log loss, in three phases: weights alone, weights and factors, weights beside the factors that grew.

    Weights pay an L1 penalty that is smaller the further a term's labels are from the mean, so that noise of long texts
    ends at zero; no term is left out for it. Factors start small and grow only where weights alone cannot explain the
    labels, as for two terms that are neutral alone; a term whose factors stay within LEAST has none in the last phase.
    With labels of one kind, or none, the score is their smoothed share.
    """
    rng, size = np.random.default_rng(seed), 1 << BITS
    batch = batch or min(512, max(16, len(rows) // 16))
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = FactorizationMachine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS)))
    if not len(rows) or labels.min() == labels.max():
        return model
    held = np.bincount(np.concatenate([_NONE, *rows]), minlength=size)
    terms = np.flatnonzero(held >= MIN_DOCS)
    place = np.full(size, -1)
    place[terms] = np.arange(len(terms))
    flat, count = place[np.concatenate([_NONE, *rows])], np.array([len(x) for x in rows])
    count = np.bincount(np.repeat(np.arange(len(rows)), count)[flat >= 0], minlength=len(rows))
    flat = flat[flat >= 0].astype(np.int32)
    begin, k, mean = np.cumsum(count) - count, len(terms), labels.mean()
    if not len(flat):
        return model
    with_one, n = np.bincount(flat, np.repeat(labels, count), k), held[terms]
    z = (with_one - n * mean) / np.sqrt(n * mean * (1 - mean))
    l1 = l1 * np.minimum(1, 1 / np.maximum(z * z, 1e-9))
    w, v = np.zeros(k), rng.normal(0, 0.01, (k, FACTORS)).astype(np.float32)
    gw, gv, gb, bias = np.full(k, 0.01), np.full((k, FACTORS), 100, np.float32), 0.01, model.bias
    for epoch in range(sum(epochs)):
        pairs, grow = epoch >= epochs[0], epochs[0] <= epoch < epochs[0] + epochs[1]
        if epoch == epochs[0] + epochs[1]:
            v[(v * v).sum(1) < LEAST * LEAST] = 0
            pairs = v.any()
        order = rng.permutation(np.flatnonzero(count))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            m = count[part]
            first, of = np.cumsum(m) - m, np.repeat(np.arange(len(part)), m)
            ids = flat[np.repeat(begin[part] - first, m) + np.arange(len(of))]
            raw = bias + np.add.reduceat(w[ids], first)
            if pairs:
                x = v[ids]
                s = np.add.reduceat(x, first, axis=0)
                raw += 0.5 * ((s * s).sum(1) - np.add.reduceat((x * x).sum(1), first))
            err = 1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[part]
            gb += err.mean() ** 2
            bias -= rate * err.mean() / np.sqrt(gb)
            dw = np.bincount(ids, err[of], k)
            gw += dw * dw
            step = rate / np.sqrt(gw)
            w -= step * dw
            w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1 * len(part))
            if grow:
                dx = err.astype(np.float32)[of, None] * (s[of] - x)
                for f in range(FACTORS):
                    d = np.bincount(ids, dx[:, f], k).astype(np.float32) + l2 * len(part) * v[:, f]
                    gv[:, f] += d * d
                    v[:, f] -= factor_rate * d / np.sqrt(gv[:, f])
    model.bias, model.weights[terms], model.factors[terms] = float(bias), w, v
    model.live = (model.weights != 0) | model.factors.any(1)
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> FactorizationMachine:
    """Fits on the labelled documents whose crc32(doc_id) mod 5 is not 0, at most ``max_train`` of them, picked by hash.

    The picked ids are max_train at most, so they are broadcast; their terms that MIN_DOCS of them hold come to the driver,
    one row per doc_id. Rows with a null label, or with a label for no document, are left out; of rows that repeat a doc_id
    the greatest label and the greatest list of terms count. Empty tables give a model that scores every text 0.5.
    """
    wanted = (labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), batch.column("toxic").cast(pa.int32())], ["doc_id", "x", "toxic"])

    found = small_batches(docs).select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "toxic").mapInArrow(read, "doc_id long, x array<int>, toxic int")
    rows = written(found.groupBy("doc_id").agg(F.max("x").alias("x"), F.max("toxic").alias("toxic")), "labelled_terms")
    counts = rows.select(F.explode("x").alias("x")).groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS).select("x").toArrow()
    kept = np.zeros(1 << BITS, bool)
    kept[counts.column("x").to_numpy()] = True

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x[kept[x]] for x in (batch.column("x")[i].values.to_numpy() for i in range(batch.num_rows))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), batch.column("toxic")], ["doc_id", "x", "toxic"])

    rows = rows.mapInArrow(thin, rows.schema).toArrow().sort_by("doc_id")
    lists = rows.column("x").combine_chunks()
    x = np.split(lists.flatten().to_numpy(), np.asarray(lists.offsets)[1:-1] - lists.offsets[0].as_py()) if len(lists) else []
    return fit(x, rows.column("toxic").to_numpy().astype(float))


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) added; every text is scored, null and empty ones by the bias alone.

    Whole texts count, however long. Repeated rows repeat. A column named score is replaced, others pass through.
    """
    docs = small_batches(docs.drop("score"))
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, np.flatnonzero(model.live), model.weights[model.live], model.factors[model.live]))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, ids, w, v = shared.value
        weights, factors = np.zeros(1 << BITS), np.zeros((1 << BITS, FACTORS))
        weights[ids], factors[ids] = w, v
        local = FactorizationMachine(bias, weights, factors)
        for batch in batches:
            got = local.score([features(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*names, "score"])

    return docs.mapInArrow(out, docs.withColumn("score", F.lit(0.0)).schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, read_table(spark, sf_dir, "labels")))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
