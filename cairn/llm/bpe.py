"""BPE encoding and decoding with content-defined chunk reuse.

A hash of the bytes in a sliding window picks chunk borders by content, so documents that share a passage share its
chunks. Documents are dealt out by their smallest border hash, which brings those with shared passages together (a
rebalance, whose large partitions adaptive execution splits); each task encodes a chunk once and keeps its ids within
a bounded store. Where two chunks meet, the ids around the join are repaired: the text from the last sure border before
it to the first sure border behind it is encoded anew, and the window widens until the ids of both chunks begin a token
at its ends, so all three encodings agree there. Windows that touch become one, so no byte is encoded more than twice.

A border is sure where the pre-tokenizer always cuts, whatever stands around: it reads from left to right without looking
back, a token holds no white space behind other characters, and letters, digits and other signs only in runs of one kind.
So ids before and behind a sure border do not depend on each other. Texts that hold a special token are encoded in one piece.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import read_table, small_batches, unused

SPAN, ONE_IN, MIN_CHUNK, MAX_CHUNK = 16, 64, 512, 8192
CACHE_BYTES = 48_000_000
#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _picked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Spaces, or beginnings of characters in texts with few of them, whose SPAN bytes before them hash to a picked value; and the hashes."""
    raw = np.frombuffer(data, np.uint8)
    spaces = np.flatnonzero(raw == 32)
    if len(spaces) * 64 < len(data):
        spaces = np.flatnonzero(raw & 0xC0 != 0x80)
    spaces = spaces[spaces >= SPAN]
    if not len(spaces):
        return spaces, np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = (eight[spaces - 16] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[spaces - 8] * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    hit = h % np.uint64(ONE_IN) == 0
    return spaces[hit], h[hit]


def chunk_borders(data: bytes) -> list[int]:
    """Where the chunks of a text end: at picked spaces at least MIN_CHUNK apart, or after MAX_CHUNK bytes."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    out, last = [], 0
    for p in [*_picked(data)[0].tolist(), n]:
        if p - last < MIN_CHUNK and p != n:
            continue
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            while data[last] & 0xC0 == 0x80:  # not inside a character
                last -= 1
            out.append(last)
        if p > last:
            out.append(p)
            last = p
    return out


def _kinds() -> np.ndarray:
    """For each byte what it says of its character: 1 letter, 2 digit, 3 other sign, 4 space or line break, 0 unknown."""
    kind = np.zeros(256, np.uint8)
    kind[33:127] = 3
    kind[[*range(65, 91), *range(97, 123)]], kind[48:58], kind[[10, 32]] = 1, 2, 4
    return kind


_KIND = _kinds()


def sure_borders(data: bytes) -> np.ndarray:
    """Where the pre-tokenizer cuts in any case: between ASCII characters of two kinds, and between a character beyond ASCII,
    unless it may be white space, and a space or line break; also before an ideographic comma or full stop behind an ideograph."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < 2:
        return np.zeros(0, np.int64)
    kind = _KIND[raw]
    left, right = kind[:-1], kind[1:]
    cut = (left != right) & (left > 0) & (left < 4) & (right > 0) & ((left != 3) | (right == 4))  # 's begins with a sign and crosses
    if (raw >= 128).any():
        tail = np.flatnonzero((raw[:-1] >= 128) & ((right == 4) | (raw[1:] == 0xE3) | (raw[1:] == 0xEF)))
        lead2, lead3, lead4 = (np.where(tail >= k, raw[np.maximum(tail - k, 0)], 0) for k in (1, 2, 3))
        two, three, four = (lead2 >= 0xC3) & (lead2 < 0xE0), (lead3 == 0xE0) | (lead3 >= 0xE4) & (lead3 < 0xEF), lead4 >= 0xF0
        ideograph = (lead3 >= 0xE5) & (lead3 <= 0xE8)  # U+5000 to U+8FFF
        comma = np.isin(raw[tail + 1].astype(np.int64) << 16 | raw[np.minimum(tail + 2, len(raw) - 1)].astype(np.int64) << 8 | raw[np.minimum(tail + 3, len(raw) - 1)], (0xE38081, 0xE38082, 0xEFBC8C))
        cut[tail] = np.where(right[tail] == 4, two | three | four, ideograph & comma)
    return np.flatnonzero(cut) + 1


class ChunkCoder:
    """Encodes and decodes whole texts through a bounded store of chunks that were encoded before."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if all(c in back for c in t)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {t: i for t, i in ranks.items() if i not in special.values()}
        self.engine = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = [t.encode() for t in special]
        by_id = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        self.bytes_of = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.width = np.array([len(b) for b in self.bytes_of], np.int64)
        self.store: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.held = self.encoded = self.reused = self.repaired = 0

    def _run(self, data: bytes) -> np.ndarray:
        return self.engine.encode_to_numpy(data.decode(), allowed_special="all", disallowed_special=()).astype("<u4", copy=False)

    def _chunk(self, data: bytes) -> np.ndarray:
        hit = self.store.get(data)
        if hit is not None:
            self.reused += 1
            self.store.move_to_end(data)
            return hit
        self.encoded += 1
        hit = self.store[data] = self._run(data)
        self.held += len(data) + hit.nbytes + 300
        while self.held > CACHE_BYTES:
            old, ids = self.store.popitem(last=False)
            self.held -= len(old) + ids.nbytes + 300
        return hit

    def encode(self, data: bytes) -> np.ndarray:
        """The ids of a whole text; the same as encoding it in one piece."""
        if not data:
            return np.zeros(0, "<u4")
        borders = chunk_borders(data)
        if len(borders) == 1 or any(x in data for x in self.special):
            return self._chunk(data) if len(borders) == 1 else self._run(data)
        edges = np.array([0, *borders])
        chunks = [self._chunk(data[a:b]) for a, b in zip(edges, edges[1:])]
        ids = np.concatenate(chunks)
        starts = np.cumsum(self.width[ids]) - self.width[ids]  # of every token of every chunk in the text
        fixed = sure_borders(data)
        fixed = np.concatenate([[0], fixed[np.isin(fixed, starts, assume_unique=True)], [len(data)]])  # where all encodings agree
        joins = edges[1:-1]
        low, high = fixed[np.searchsorted(fixed, joins, "right") - 1], fixed[np.searchsorted(fixed, joins)]
        low, high = low[low < joins], high[low < joins]
        if not len(low):
            return ids
        fresh = np.r_[True, low[1:] > high[:-1]]
        low, high = low[fresh], np.maximum.reduceat(high, np.flatnonzero(fresh))
        self.repaired += int((high - low).sum())
        parts, done = [], 0
        for a, b in zip(low, high):
            parts += [ids[done : np.searchsorted(starts, a)], self._run(data[a:b])]
            done = np.searchsorted(starts, b)
        return np.concatenate([*parts, ids[done:]])

    def decode(self, ids: np.ndarray) -> bytes:
        """What decode(ids, skip_special_tokens=False) gives, in UTF-8."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace").encode()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_CODERS: dict[str, ChunkCoder] = {}


def _coder(path: str) -> ChunkCoder:
    if path not in _CODERS:
        _CODERS[path] = ChunkCoder(path)
    return _CODERS[path]


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (string) added, ids as the tokenizers library gives for the whole text.

    Null and empty texts have no ids and decode to ''. Very long texts are never cut short. Repeated rows repeat.
    Columns named ids or decoded are replaced; the others pass through.
    """
    docs = docs.drop("ids", "decoded")
    names = docs.columns

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids = [coder.encode(t or b"") for t in texts]
            decoded = [coder.decode(x).decode() for x in ids]
            lists = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, pa.array(decoded, pa.string())], [*names, "ids", "decoded"])

    path = tokenizer or default_tokenizer()
    dealt = _brought_together(docs)
    return dealt.mapInArrow(out, docs.withColumns({"ids": F.array(F.lit(0)), "decoded": F.lit("")}).schema)


def encode_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, made inside the tasks so that ids need not leave them.

    Null and empty texts have no ids; their digests are those of nothing. Repeated rows repeat, no rows give none; other
    columns are ignored.
    """
    path = tokenizer or default_tokenizer()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                ids = coder.encode(t or b"")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _brought_together(docs.select("doc_id", "text")).mapInArrow(out, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _brought_together(docs: DataFrame) -> DataFrame:
    """``docs`` with rows of an equal smallest border hash side by side."""
    @F.pandas_udf("long")
    def smallest_border(data):
        def of(text):
            h = _picked(text)[1] if text and len(text) > SPAN else ()
            return int(h.min() >> np.uint64(1)) if len(h) else len(text or b"")

        return data.map(of, na_action="ignore").fillna(0).astype("int64")

    key = unused("key", docs)
    return small_batches(docs).withColumn(key, smallest_border(F.col("text").cast("binary"))).hint("rebalance", F.col(key)).drop(key)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"))
