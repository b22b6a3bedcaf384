"""Files as tables: a working tree, slices of lines, ignore rules and older SQLite databases."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def file_tree(spark: SparkSession, root: str, rules: list[str] = (), max_bytes: int = 1_000_000, max_files: int | None = None) -> DataFrame:
    """(path, size, content) of the files below ``root`` that no ignore rule matches, up to max_bytes each, the first max_files by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = re.sub(r"^file:/*", "/", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(plain)}/", "")
    rows = rows.where(F.col("length") <= max_bytes).select(path.alias("path"), F.col("length").alias("size"), "content").where(~ignored(F.col("path"), rules) & ~F.col("path").rlike("(^|/)[.]git/"))
    return rows.orderBy("path").limit(max_files) if max_files is not None else rows


def ignore_pattern(rule: str) -> tuple[str, bool] | None:
    """The regular expression of one ignore rule, and whether the rule takes paths back in; None for comments and blank lines."""
    rule = rule.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    back = rule.startswith("!")
    rule = rule[1:] if back else rule
    folder = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i + 2 :]:
            end = rule.index("]", i + 2)
            inner = rule[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), back


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches a path excludes it."""
    out = F.lit(False)
    for rule in filter(None, map(ignore_pattern, rules)):
        out = F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(out)
    return out


def line_slice(files: DataFrame, start: Column, end: Column, most: int = 2000) -> DataFrame:
    """(path, text, sha256, total, truncated): lines start..end of files (path, content), clamped and cut after ``most`` lines. Paths that leave the root are refused."""
    lines = F.split(F.decode("content", "UTF-8"), "\r\n|\r|\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    first, last = F.greatest(start, F.lit(1)), F.least(end, F.size(lines))
    n = F.greatest(last - first + 1, F.lit(0))
    safe = ~F.col("path").rlike(r"(^/)|(^|/)\.\.(/|$)")
    return files.where(safe).select("path", F.array_join(F.slice(lines, first, F.least(n, F.lit(most))), "\n").alias("text"), F.sha2("content", 256).alias("sha256"), F.size(lines).alias("total"), (n > most).alias("truncated"))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.table, self.names, self.parts = options["path"], options["table"], names, int(options.get("partitions", "8"))

    def partitions(self):
        with _opened(self.path) as db:
            low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)] or [_Range(0, 0)]

    def read(self, partition):
        with _opened(self.path) as db:
            columns = ", ".join(f'CAST("{n}" AS TEXT)' for n in self.names)
            yield from db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


def _opened(path: str) -> sqlite3.Connection:
    with open(path, "rb") as f:
        if f.read(16) != b"SQLite format 3\x00":
            raise ValueError(f"{path} is no SQLite database")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class SQLiteSource(DataSource):
    """Read-only rows of a SQLite table as strings, in ranges of rowid. Options: path (on a file system that all executors have), table, partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def _names(self) -> list[str]:
        with _opened(self.options["path"]) as db:
            names = [r[1] for r in db.execute(f'PRAGMA table_info("{self.options["table"]}")')]
        if not names:
            raise ValueError(f"no table {self.options['table']}")
        return names

    def schema(self) -> str:
        return ", ".join(f"`{n}` string" for n in self._names())

    def reader(self, schema):
        return _Reader(self.options, [f.name for f in schema.fields])


def read_sqlite(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    """The first of the named tables that the database has."""
    with _opened(path) as db:
        there = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    found = next((t for t in tables if t in there), None)
    if found is None:
        raise ValueError(f"none of {tables} in {path}")
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite_ro").option("path", path).option("table", found).load()


def first_of(df: DataFrame, *names: str) -> Column:
    """The first non-null of the columns that the table has, null if it has none."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")
