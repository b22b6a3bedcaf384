"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example is the text of all turns up to and including the target reply; only that reply is trainable. DataFrame
functions only: the turns of a conversation are gathered and rendered once, then its examples are exploded from them.

Template, one line break after each turn: ``### <role>: <text></turn>``. Inside texts and roles a backslash is doubled,
``</turn>`` becomes ``<\\/turn>`` and ``##`` becomes ``#\\#``, so neither control string can occur; inside roles ``:``
becomes ``<\\c>``. A single backslash stands only in these, so undoing them and then halving backslashes is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import bound, read_table

HEAD, TAIL, REPLY = "### ", "</turn>\n", "assistant"
#: What stands for what, in the order of escaping.
ESCAPES = (("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("##", "#\\#"))
ROLE_ESCAPES = (*ESCAPES, (":", "<\\c>"))


def _escape(text: Column, rules=ESCAPES) -> Column:
    for plain, safe in rules:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def _unescape(text: Column, rules=ESCAPES) -> Column:
    for plain, safe in reversed(rules):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """Examples ``(conv_id, example, target, text, loss_start, loss_length, last)`` of rows (conv_id, turn, role, text).

    ``example`` counts from 0 within a conversation, ``target`` is the index of the trainable turn and loss_start and
    loss_length its code points in ``text``. A conversation that does not end with an assistant turn also gets a final
    example of all its turns with nothing trainable (target null, length 0), so no turn is lost. Null texts and roles
    are empty; a null conv_id is a conversation of its own. Turns are ordered by turn, then role and text; repeated rows
    are turns of their own. Other columns are ignored, whatever their names. No rows give no examples.
    """
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    draw = lambda t: F.struct(F.concat(F.lit(HEAD), _escape(t.role, ROLE_ESCAPES), F.lit(": "), _escape(t.text), F.lit(TAIL)).alias("text"), F.when(t.role == REPLY, F.char_length(_escape(t.text))).alias("n"))
    convs = convs.select("conv_id", F.transform("turns", draw).alias("drawn"))
    n = F.size("drawn")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.get(F.col("drawn"), i - 1).n.isNotNull())
    out = convs.select("conv_id", "drawn", F.posexplode(ends).alias("example", "upto"))
    length = F.get(F.col("drawn"), F.col("upto") - 1).n
    out = out.select("conv_id", "example", (F.col("upto") == n).alias("last"), F.when(length.isNotNull(), F.col("upto") - 1).alias("target"), F.coalesce(length, F.lit(0)).alias("loss_length"),
                     F.array_join(F.transform(F.slice("drawn", F.lit(1), F.col("upto")), lambda t: t.text), "").alias("text"))
    return out.select("conv_id", "example", "target", "text", (F.char_length("text") - len(TAIL) - F.col("loss_length")).alias("loss_start"), "loss_length", "last")


def read_back(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    def turn(line: Column) -> Column:
        at = F.instr(line, ": ")
        role = _unescape(F.substring(line, F.lit(len(HEAD) + 1), at - len(HEAD) - 1), ROLE_ESCAPES)
        return F.struct(role.alias("role"), _unescape(F.substring(line, at + 2, F.char_length(line))).alias("text"))

    return bound(F.split(text, TAIL, -1), lambda lines: F.transform(F.slice(lines, 1, F.size(lines) - 1), turn))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(REPLY).alias("role"), F.lit(odd).alias("text"))
    examples = format_conversations(turns.unionByName(added))
    masked = _unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length")))
    seen = examples.select("conv_id", "example", F.char_length("text").cast("long").alias("chars"), masked.alias("masked"), F.when(F.col("last"), F.col("text")).alias("whole"))
    convs = seen.groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("example", "masked"))).alias("m"), F.max("whole").alias("whole"))
    convs = convs.select("conv_id", "formatted_chars", read_back(F.col("whole")).alias("turns"), F.array_join(F.transform("m", lambda x: x.masked), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(lines).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), "formatted_chars")


def _sql_escape(text: str, rules=ESCAPES) -> str:
    for plain, safe in rules:
        text = f"replace({text}, '{plain}', '{safe}')"
    return text


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
drawn AS (
  SELECT *, length('### ' || {_sql_escape('role', ROLE_ESCAPES)} || ': ' || {_sql_escape('text')} || '</turn>' || chr(10)) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS is_last
  FROM turns),
upto AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS chars FROM drawn)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) FILTER (WHERE role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM upto GROUP BY conv_id
"""
