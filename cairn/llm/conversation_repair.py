"""Conversation repair: the cheapest edits that give every conversation a legal order of roles, by checkpointed dynamic programming.

Rows are kept, deleted, given another role, or empty ones put between them, so that role initials read (s?(ua)+)?. The
states of a conversation so far are: nothing yet, after s, after u, after a. Of the cheapest edits the ASCII-least are taken.

1. Light rows (no text: two hashes of it, faults, first initial) are sorted over all tasks by conversation and turn, and cut
   into blocks of about the square root of a conversation's length. A conversation that fits one block is repaired there.
2. Of longer ones each block gives the cost from any state at its start to any at its end. From the last block back, these
   give the state-cost vector at every border: the checkpoints, all that is stored.
3. Each block is computed again from the checkpoint at its end, and walked forward along tight edits, D before I before K
   before R, from each of the four states; the ends are chained from the first block on, which picks one walk per block.
Blocks are independent tasks' rows, so a conversation of a third of all rows is spread; what meets per conversation is one
small row per block. Repeats of a row are one row with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import BLANKS, read_table, written

MIN_BLOCK, DELETE, REROLE, INSERT, TRUNCATED, NEVER = 64, 2, 1, 5, 5, 1 << 50
#: The state after the role that is due in a state (user, or after a user assistant), and after keeping a row by its initial.
_DUE = (2, 2, 3, 2)
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None, None, None, None)}
_NAME = {2: "user", 3: "assistant"}
_LEGAL = ("su", "ua", "au")
Vector = tuple[int, int, int, int]


def _inserts(b: list[int]) -> Vector:
    u, a = min(b[2], INSERT + b[3]), min(b[3], INSERT + b[2])
    return min(b[0], INSERT + u), min(b[1], INSERT + u), u, a


END: Vector = _inserts([0, NEVER, NEVER, 0])


def _before(code: str, v: Vector) -> Vector:
    """The cost vector before a row, of the one behind it. Codes: '-' must go; s, u, a, x by initial, as a capital if truncated."""
    if code == "-":
        return _inserts([x + DELETE for x in v])
    extra, keep = (TRUNCATED if code.isupper() else 0), _KEEP[code.lower()]
    return _inserts([min(DELETE + v[q], extra + REROLE + v[_DUE[q]], NEVER if keep[q] is None else extra + v[keep[q]]) for q in range(4)])


def _vectors(codes: str, end: Vector) -> list[Vector]:
    out = [end]
    for code in reversed(codes):
        out.append(_before(code, out[-1]))
    return out[::-1]


def _costs(codes: str) -> list[int]:
    """Row by row the 4 x 4 costs from a state before the block to one right behind its last row."""
    columns = []
    for q in range(4):
        v = tuple(0 if p == q else NEVER for p in range(4))
        for code in reversed(codes):
            v = _before(code, v)
        columns.append(v)
    return [columns[q][p] for p in range(4) for q in range(4)]


def _walk(codes: str, vectors: list[Vector], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least tight edits from a state, and the state they end in."""
    out, i = [], 0
    while i < len(codes) or last and state not in (0, 3):
        now, due = vectors[i][state], _DUE[state]
        if i < len(codes) and now == DELETE + vectors[i + 1][state]:
            edit, i = "D", i + 1
        elif now == INSERT + vectors[i][due]:
            edit, state = "I", due
        else:
            code, v, i = codes[i], vectors[i + 1], i + 1
            keep = None if code == "-" else _KEEP[code.lower()][state]
            if keep is not None and now == (TRUNCATED if code.isupper() else 0) + v[keep]:
                edit, state = "K", keep
            else:
                edit, state = "R", due
        out.append(edit)
    return "".join(out), state


def _edits(codes: str, entries: list[dict], audit: str, state: int) -> tuple[list[dict], list[str]]:
    """The rows that stay: their keys, roles and the roles inserted before them; and what is inserted behind the last.

    No insertion stands before a deletion, as the two swapped cost the same and come first: so only a conversation's end
    has insertions with no row behind them.
    """
    at, out, before, i = {e["at"]: e for e in entries}, [], [], 0
    for edit in audit:
        if edit == "I":
            state = _DUE[state]
            before.append(_NAME[state])
            continue
        if edit != "D":
            entry, due = at[i], _DUE[state]
            state = _KEEP[codes[i].lower()][state] if edit == "K" else due
            out.append({k: entry[k] for k in ("turn", "role", "h1", "h2")} | {"edit": edit, "new_role": entry["role"] if edit == "K" else _NAME[due], "before": before})
            before = []
        i += 1
    return out, before


_ENTRY = "struct<at:int,turn:long,role:string,h1:long,h2:long>"
_STAY = "struct<turn:long,role:string,h1:long,h2:long,edit:string,new_role:string,before:array<string>>"
_BLOCK = f"part int, seq int, codes string, entries array<{_ENTRY}>, whole boolean, illegal long, head string, tail string, costs array<long>"
_DONE = f"part int, seq int, illegal long, head string, tail string, cost long, audit string, stay array<{_STAY}>, behind array<string>"


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def light_rows(rows: DataFrame) -> DataFrame:
    """One row for each different (conv_id, turn, role, text): hashes of the text, its faults, how often it occurs and whether one of those is the first of its role and text."""
    text = F.coalesce("text", F.lit(" "))
    bare = F.btrim(text, F.lit(BLANKS))
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(11), text).alias("h2"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*".!?")).alias("cut"))
    one = base.groupBy("conv_id", "turn", "role", "h1", "h2").agg(F.count("*").alias("m"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut"))
    one = written(one, "light")
    first = one.groupBy("conv_id", "role", "h1", "h2").agg(F.bool_or(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("turn")).alias("f")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "h1", "h2")])
    is_first = F.when(F.col("f.untimed"), F.col("o.turn").isNull()).otherwise(F.col("o.turn") == F.col("f.turn"))
    return one.alias("o").join(first, same).select("o.*", is_first.alias("first"))


def statistics(light: DataFrame) -> DataFrame:
    """(conv_id, rows, gaps, blank, duplicate, truncated) of each conversation."""
    fresh = F.when(~F.col("blank") & F.col("first"), 1).otherwise(0)
    return light.groupBy("conv_id").agg(
        F.sum("m").alias("rows"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("m")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("m") - fresh).otherwise(0)).alias("duplicate"), F.sum(F.when(F.col("cut"), fresh).otherwise(0)).alias("truncated"))


def _blocks(light: DataFrame, sizes: DataFrame, min_block: int) -> DataFrame:
    kind = light.schema["conv_id"].dataType.simpleString()
    schema = _schema(f"conv_id {kind}, {_BLOCK}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, []
        conv, total, codes, roles, entries, none = None, 0, [], [], [], True

        def flush() -> None:
            nonlocal seq, codes, roles, entries
            if codes:
                text, whole = "".join(codes), len(codes) == total
                illegal = sum(a + b not in _LEGAL for a, b in zip(roles, roles[1:]))
                out.append({"conv_id": conv, "part": part, "seq": seq, "codes": text, "entries": entries, "whole": whole, "illegal": illegal, "head": roles[0], "tail": roles[-1], "costs": None if whole else _costs(text)})
                seq, codes, roles, entries = seq + 1, [], [], []

        for batch in batches:
            for r in batch.to_pylist():
                if none or r["conv_id"] != conv:
                    flush()
                    conv, total, none = r["conv_id"], r["rows"], False
                size = max(min_block, isqrt(total - 1) + 1)
                initial = r["role"][:1] if r["role"][:1] in ("s", "u", "a") else "x"
                left, stays = r["m"], not r["blank"] and r["first"]
                while left:
                    if stays:
                        entries.append({"at": len(codes), "turn": r["turn"], "role": r["role"], "h1": r["h1"], "h2": r["h2"]})
                        codes.append(initial.upper() if r["cut"] else initial)
                        n, stays = 1, False
                    else:
                        n = min(left, size - len(codes))
                        codes += ["-"] * n
                    roles += [initial] * n
                    left -= n
                    if len(codes) >= size:
                        flush()
                if len(out) >= 200:
                    yield _arrow(out, schema)
                    out = []
        flush()
        yield _arrow(out, schema)

    order = ["conv_id", "turn", "role", "h1", "h2"]
    rows = light.alias("l").join(sizes.select(F.col("conv_id").alias("c"), "rows"), F.col("l.conv_id").eqNullSafe(F.col("c"))).drop("c")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "role", "h1", "h2", "m", "blank", "cut", "first", "rows").mapInArrow(cut, f"conv_id {kind}, {_BLOCK}")


def _finished(row: dict, state: int, last: bool, audit: str) -> dict:
    stay, behind = _edits(row["codes"], row["entries"], audit, state)
    return {k: row[k] for k in ("conv_id", "part", "seq", "illegal", "head", "tail")} | {"audit": audit, "stay": stay, "behind": behind if last else []}


def _short(blocks: DataFrame) -> DataFrame:
    """Conversations of one block."""
    ddl = f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}, {_DONE}"
    schema = _schema(ddl)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                vectors = _vectors(row["codes"], END)
                audit, _ = _walk(row["codes"], vectors, 0, True)
                out.append(_finished(row, 0, True, audit) | {"cost": vectors[0][0]})
            yield _arrow(out, schema)

    return blocks.mapInArrow(solve, ddl)


def _long(blocks: DataFrame) -> DataFrame:
    """Conversations of several blocks: checkpoints from the last block back, walks of every block, and the walks' chain from the first block on."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    marks_ddl, walks_ddl, start_ddl = "part int, seq int, end array<long>, last boolean, cost long", "part int, seq int, ends array<int>, audits array<string>", "part int, seq int, start int"
    marks_schema, walks_schema, start_schema, done_schema = _schema(marks_ddl), _schema(walks_ddl), _schema(start_ddl), _schema(f"conv_id {kind}, {_DONE}")
    ordered = lambda t: sorted(t.to_pylist(), key=lambda r: (r["part"], r["seq"]))

    def back(t: pa.Table) -> pa.Table:
        v, out = END, []
        for row in reversed(ordered(t)):
            m, end = row["costs"], v
            v = tuple(min(NEVER, *(m[4 * p + q] + end[q] for q in range(4))) for p in range(4))
            out.append({"part": row["part"], "seq": row["seq"], "end": list(end), "last": not out, "cost": None})
        out[-1]["cost"] = v[0]
        return pa.Table.from_pylist(out, schema=marks_schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                vectors = _vectors(row["codes"], tuple(row["end"]))
                walks = [_walk(row["codes"], vectors, p, row["last"]) for p in range(4)]
                out.append({"part": row["part"], "seq": row["seq"], "ends": [s for _, s in walks], "audits": [a for a, _ in walks]})
            yield _arrow(out, walks_schema)

    def chain(t: pa.Table) -> pa.Table:
        state, out = 0, []
        for row in ordered(t):
            out.append({"part": row["part"], "seq": row["seq"], "start": state})
            state = row["ends"][state]
        return pa.Table.from_pylist(out, schema=start_schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _arrow([_finished(row, row["start"], row["last"], row["audit"]) | {"cost": row["cost"]} for row in batch.to_pylist()], done_schema)

    at = ["part", "seq"]
    marks = written(blocks.select("conv_id", *at, "costs").groupBy("conv_id").applyInArrow(back, marks_ddl), "checkpoints")
    walks = written(blocks.join(marks, at).select(*at, "codes", "end", "last").mapInArrow(walk, walks_ddl), "walks")
    starts = blocks.select("conv_id", *at).join(walks.select(*at, "ends"), at).groupBy("conv_id").applyInArrow(chain, start_ddl)
    chosen = walks.join(starts, at).select(*at, "start", F.get("audits", F.col("start")).alias("audit"))
    return blocks.join(marks.select(*at, "last", "cost"), at).join(chosen, at).mapInArrow(finish, f"conv_id {kind}, {_DONE}")


def repairs(rows: DataFrame, min_block: int = MIN_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Statistics of each conversation, and the edits of its blocks, of rows (conv_id, turn, role, text).

    Edits: (conv_id, part, seq, illegal, head, tail, cost, audit, stay, behind), a conversation's blocks in order of part and
    seq; cost stands on its first block. Rows are taken by turn, null turns first, ties by role and hashes of the text, so
    repeated rows stand together. Null roles and texts count as one space; rows with a null conv_id are one conversation.
    Texts of any length go in by their hashes only. An empty table gives two empty tables; further columns are ignored.
    """
    light = written(light_rows(rows.select("conv_id", "turn", "role", "text")), "faults")
    stats = written(statistics(light), "conversations")
    blocks = written(_blocks(light, stats, min_block), "blocks")
    done = _short(blocks.where("whole"))
    longer = blocks.where("NOT whole")
    return stats, written(done if longer.isEmpty() else done.unionByName(_long(longer)), "edits")


def audits(edits: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit): the blocks of each conversation put together."""
    parts = edits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "illegal", "head", "tail", "audit"))).alias("b"), F.max("cost").alias("cost"))
    borders = F.aggregate(F.sequence(F.lit(1), F.size("b")), F.lit(0).cast("long"), lambda n, i: n + F.when(i < F.size("b"), F.when(F.concat(F.get("b", i - 1).tail, F.get("b", i).head).isin(*_LEGAL), 0).otherwise(1)).otherwise(0))
    illegal = F.aggregate("b", F.lit(0).cast("long"), lambda n, x: n + x.illegal) + borders
    return parts.select("conv_id", illegal.alias("illegal"), "cost", F.array_join(F.transform("b", lambda x: x.audit), "").alias("audit"))


_KEYS = ["turn", "role", "h1", "h2"]


def _texts(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(11), text).alias("h2"), text.alias("text"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, part, seq, place, edit, role, text), a conversation's rows in order of part, seq and place."""
    blocks = edits.select("conv_id", "part", "seq", F.posexplode(F.concat("stay", F.array(F.struct(*[F.lit(None).alias(c) for c in (*_KEYS, "edit", "new_role")], F.col("behind").alias("before")).cast(_STAY)))).alias("i", "s"))
    flat = blocks.select("conv_id", "part", "seq", "i", "s.*")
    put = flat.select("conv_id", "part", "seq", F.col("i"), F.posexplode("before").alias("j", "role")).withColumns({"edit": F.lit("I"), "text": F.lit("")})
    stay = flat.where(F.col("edit").isNotNull()).withColumn("j", F.size("before")).alias("s")
    texts = _texts(rows).dropDuplicates(["conv_id", *_KEYS]).alias("t")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("conv_id", *_KEYS)])
    kept = stay.join(texts, same).select("s.conv_id", "part", "seq", "i", "j", F.col("new_role").alias("role"), "edit", "text")
    return kept.unionByName(put).select("conv_id", "part", "seq", F.struct("i", "j").alias("place"), "edit", "role", "text")


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of each repaired conversation, ``role:text`` joined by newlines.

    Texts and edits are sorted together by conversation and key and hashed as they stream by: a hash takes its input in one
    order, so the texts of one conversation pass through one task, but never stand in memory together.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    stay = edits.select("conv_id", F.explode("stay").alias("s")).select("conv_id", F.lit(0).alias("late"), "s.turn", "s.role", "s.h1", "s.h2", F.lit(0).alias("kind"), "s.new_role", "s.before", F.lit(None).cast("string").alias("text"))
    tail = edits.where(F.size("behind") > 0).select("conv_id", F.lit(1).alias("late"), F.lit(0).alias("kind"), F.col("behind").alias("before"))
    texts = _texts(rows).withColumns({"late": F.lit(0), "kind": F.lit(1)})
    union = stay.unionByName(tail, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    order = ["late", "turn", "role", "h1", "h2", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, wanted, started, none = None, None, None, False, True
        ids, out = [], []

        def add(role: str, text: str) -> None:
            nonlocal started
            sha.update((("\n" if started else "") + role + ":" + text).encode())
            started = True

        for batch in batches:
            for r in batch.to_pylist():
                if none or r["conv_id"] != conv:
                    if not none:
                        ids.append(conv)
                        out.append(sha.hexdigest())
                    conv, sha, wanted, started, none = r["conv_id"], hashlib.sha256(), None, False, False
                key = (r["turn"], r["role"], r["h1"], r["h2"])
                if r["kind"]:
                    if wanted and wanted[0] == key:
                        add(wanted[1], r["text"])
                        wanted = None
                    continue
                for role in r["before"]:
                    add(role, "")
                wanted = None if r["late"] else (key, r["new_role"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("conv_id").type), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])
            ids, out = [], []
        if not none:
            yield pa.RecordBatch.from_arrays([pa.array([conv], batch.column("conv_id").type), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    dealt = union.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return dealt.select("conv_id", *order, "new_role", "before", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with a fifth of them dropped, emptied, without their full stops, repeated or given to the user, by a checksum of conversation and turn."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(s("conv_id"), F.lit(":"), s("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate(s("text"), ".!?", "")).otherwise(s("text"))
    out = rows.withColumn("code", code).where("code <> 0")
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return out.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(s("role")).alias("role"), text.alias("text"), copies).drop("copy")


_EMPTY = hashlib.sha256(b"").hexdigest()


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(source)
    stats, edits = repairs(rows)
    parts = [source.select("conv_id").distinct(), stats.drop("rows"), audits(edits), digests(rows, edits)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    whole = {c: F.lit(0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(_EMPTY)}
    return both.groupBy("conv_id").agg(*[F.coalesce(F.max(c), v).alias(c) for c, v in whole.items()])


def _sql() -> str:
    def add(k: str, cost: str, edit: str, more: str = "r") -> str:
        return f"CASE WHEN {k} IS NOT NULL THEN {{'c': {k}.c + {cost}, 'a': {k}.a || '{edit}', 'r': {more.replace('@', k)}}} END"

    def insert(k: str, role: str) -> str:
        return add(k, "5", "I", f"list_append(@.r, '{role}:')")

    closed = lambda rows: f"""SELECT conv_id, pos, k0, k1, k2, least(k3, {insert('k2', 'assistant')}) AS k3 FROM (
      SELECT conv_id, pos, k0, k1, least(k2, {', '.join(insert(k, 'user') for k in ('k0', 'k1', 'k3'))}) AS k2, k3 FROM {rows})"""  # noqa: E731
    gone = {k: add(k, "2", "D", "@.r") for k in ("k0", "k1", "k2", "k3")}
    keep = lambda k, i: f"CASE WHEN i = '{i}' AND NOT must_go THEN {add(k, 'extra', 'K', chr(64) + '.r || [role || chr(58) || text]')} END"
    turn = lambda k, role: f"CASE WHEN NOT must_go THEN {add(k, 'extra + 1', 'R', f'list_append(@.r, {chr(39)}{role}:{chr(39)} || text)')} END"
    return f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) ORDER BY i) AS t FROM range(256) x(i)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
coded AS (SELECT src.*, xor(list_reduce(list_transform(string_split(id, ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS code FROM src, crc),
dam AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE code WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded WHERE code <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM dam),
bare AS (SELECT *, left(role, 1) AS i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen FROM num),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i NOT IN ('su', 'ua', 'au') AS illegal FROM bare),
e AS (SELECT *, fault IN ('blank', 'duplicate') AS must_go, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra FROM f),
dp(conv_id, pos, k0, k1, k2, k3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}}, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR[]), NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR[]), NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR[]) FROM e
  UNION ALL
  SELECT d.conv_id, e.pos, {gone['k0']}, least({gone['k1']}, {keep('k0', 's')}),
    least({gone['k2']}, {', '.join(f(k) for k in ('k0', 'k1', 'k3') for f in (lambda k: keep(k, 'u'), lambda k: turn(k, 'user')))}),
    least({gone['k3']}, {keep('k2', 'a')}, {turn('k2', 'assistant')})
  FROM ({closed('dp')}) d JOIN e ON e.conv_id = d.conv_id AND e.pos = d.pos + 1),
last AS (SELECT conv_id, least(k0, k3) AS k FROM ({closed('(SELECT * FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1)')})),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM e GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(k.c, 0)::BIGINT AS cost, coalesce(k.a, '') AS audit, sha256(coalesce(array_to_string(k.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id) LEFT JOIN last USING (conv_id)
"""


SQL = _sql()
