"""Repository profiles from a flat file table (path, size, content lines): languages, groups, entry points, symbols, statistics."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.tables import checkpointed

# Fixed values.
LANGUAGE = {
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "swift": "swift",
    "m": "objective-c", "mm": "objective-c", "sh": "shell", "bash": "shell", "lua": "lua", "pl": "perl", "r": "r", "ex": "elixir", "exs": "elixir", "dart": "dart", "hs": "haskell", "ml": "ocaml", "clj": "clojure",
    "zig": "zig", "nim": "nim", "vue": "vue", "svelte": "svelte",
}
VENDORED = (
    ".git", ".hg", ".svn", "node_modules", "target", "build", "dist", "out", ".next", ".nuxt", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".gradle", ".idea", ".vscode", "vendor",
    "third_party", "thirdparty", "Pods", "Carthage", "deps", "_build", "elm-stuff", ".terraform",
)
COMMENTS = ("//", "#", "*", "/*", "--", ";;", "%")


#: Words that may stand before a declaration, and the keywords that open one, with what must follow the name.
MODIFIERS = ("export", "default", "public", "private", "protected", "internal", "static", "final", "abstract", "async", "pub")
KEYWORDS = {
    "function": (("function", "func", "fn"), r"\s*[(<]"), "class": (("class",), ""), "interface": (("interface",), ""), "struct": (("struct",), ""), "trait": (("trait",), ""),
    "enum": (("enum",), ""), "type": (("type",), r"\s*="),
}


def declaration_rules() -> list[tuple[str, str]]:
    """(kind, pattern) for a line that declares something; the pattern's group is the name. Go's receivers stand before the name."""
    before = rf"^\s*(?:(?:{'|'.join(MODIFIERS)})(?:\([a-z]+\))?\s+)*"
    rules = [(kind, rf"{before}(?:{'|'.join(words)})\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*){after}") for kind, (words, after) in KEYWORDS.items()]
    bound = rf"{before}(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\()"
    return [*rules, ("function", bound), ("constant", rf"{before}const\s+([A-Z][A-Z0-9_]*)\s*=")]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv]), extension(path))


def vendored(path: Column) -> Column:
    """Whether a directory of the path is one that holds no sources of the project's own."""
    dirs = F.split(path, "/")
    return F.arrays_overlap(F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0))), F.array(*map(F.lit, VENDORED)))


def main_language(files: DataFrame, share: float = 0.01) -> DataFrame:
    """(repo_id, language): the language of most files, by name among equals, if it has the least share; files outside vendored folders count."""
    counts = files.where(~vendored(F.col("path"))).select("repo_id", language(F.col("path")).alias("language")).where("language IS NOT NULL").groupBy("repo_id", "language").agg(F.count("*").alias("n"))
    all_ = F.sum("n").over(Window.partitionBy("repo_id"))
    return counts.withColumn("all", all_).where(F.col("n") / F.col("all") >= share).groupBy("repo_id").agg(F.min_by("language", F.struct(-F.col("n"), "language")).alias("language"))


# File names and pieces of code that give a file a role.
ROLE_NAMES = {
    "main": ("main.py", "__main__.py", "app.py", "manage.py", "main.go", "main.rs", "index.js", "index.ts"),
    "server": ("server.py", "server.js", "server.ts"),
    "config": ("setup.py", "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "requirements.txt", "pom.xml", "build.gradle"),
    "build": ("Makefile", "docker-compose.yml", "docker-compose.yaml"),
}
ROLE_PATTERNS = {
    "test": r"(^|/)(test_[^/]*|[^/]*(_test\.go|\.test\.[jt]s))$|(^|/)tests?/",
    "build": r"(^|/)Dockerfile[^/]*$",
    "docs": r"(?i)^docs/|(^|/)readme\.(md|rst)$|\.md$",
}
ROLE_CODE = {
    "cli": ("argparse", "click.command", "typer", "cobra.command"),
    "server": ("flask(", "fastapi(", "uvicorn.run", "http.server", "express()", "createserver(", "actix_web", "axum::"),
    "worker": ("celery", "rq.worker", "worker(", "grpc.server"),
}
ROLES = ("main", "test", "config", "build", "docs", "cli", "server", "worker")


def entry_point(path: Column, text: Column) -> Column:
    """The first of ROLES that the file's name, its path or its content gives; null for none. A server by name is one wherever it stands."""
    name, low = F.element_at(F.split(path, "/"), -1), F.lower(F.coalesce(text, F.lit("")))
    given = [F.when(name.isin(*ROLE_NAMES["server"]), "server")]
    for role in ROLES:
        tests = [name.isin(*ROLE_NAMES[role])] if role in ROLE_NAMES else []
        tests += [path.rlike(ROLE_PATTERNS[role])] if role in ROLE_PATTERNS else []
        tests += [F.contains(low, F.lit(piece)) for piece in ROLE_CODE.get(role, ())]
        given.append(F.when(reduce(Column.__or__, tests), role))
    return F.coalesce(*given)


def capped(rows: DataFrame, within: list[str], order: list[str], cap: int | Column) -> DataFrame:
    """The first ``cap`` rows of each group ``within``, in order, with their ``place`` in it and the group's ``total``.

    Rows are sorted over all tasks; counts per task and group give the places, so no group meets in one task. Group columns
    must not be null.
    """
    dealt = rows.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    placed = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*within)
    counts = placed.groupBy(*within, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*within, "_part", before.alias("_before"), F.sum("_n").over(group).alias("total"))
    here = F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order))
    both = placed.withColumn("_here", here).join(counts, [*within, "_part"])
    return both.withColumn("place", F.col("_before") + F.col("_here")).where(F.col("place") <= cap).drop("_part", "_here", "_before")


def declarations(files: DataFrame, *keep: str) -> DataFrame:
    """(keep..., path, line, kind, name) of the first declaration pattern that each line outside comments fits."""
    rows = files.select(*keep, "path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("i", "code")).select(*keep, "path", (F.col("i") + 1).alias("line"), "code")
    bare = F.btrim("code", F.lit(" \t"))
    comment = F.greatest(*[bare.startswith(p).cast("int") for p in COMMENTS]) == 1
    hit = F.coalesce(*[F.when(F.col("code").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("code", p, 1).alias("name"))) for kind, p in declaration_rules()])
    return rows.where((bare != "") & ~comment).withColumn("hit", hit).where("hit IS NOT NULL").select(*keep, "path", "line", "hit.kind", "hit.name")


def python_symbols(files: DataFrame, *keep: str) -> DataFrame:
    """(keep..., path, name, kind, start_line, end_line, exported) of the functions, methods, classes and assignments of Python files (path, text); files that do not parse have none."""
    def rows(path: str, text: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return
        stack = [(n, "") for n in reversed(tree.body)]
        while stack:
            node, owner = stack.pop()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield path, owner + node.name, "method" if owner else "function", node.lineno, node.end_lineno, not node.name.startswith("_")
            elif isinstance(node, ast.ClassDef):
                yield path, owner + node.name, "class", node.lineno, node.end_lineno, not node.name.startswith("_")
                stack += [(n, f"{owner}{node.name}.") for n in reversed(node.body)]
            elif isinstance(node, (ast.Assign, ast.AnnAssign)) and not owner:
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name):
                        yield path, target.id, "constant" if target.id.isupper() else "variable", node.lineno, node.end_lineno, not target.id.startswith("_")

    def out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            more = zip(*(t[k] for k in keep)) if keep else [()] * len(t)
            yield pd.DataFrame([(*m, *r) for m, p, x in zip(more, t["path"], t["text"]) for r in rows(p, x or "")], columns=[*keep, "path", "name", "kind", "start_line", "end_line", "exported"])

    kinds = "".join(f"{k} {files.schema[k].dataType.simpleString()}, " for k in keep)
    return files.select(*keep, "path", "text").mapInPandas(out, f"{kinds}path string, name string, kind string, start_line int, end_line int, exported boolean")


def directory_groups(files: DataFrame, most: int = 100) -> DataFrame:
    """(top, files) per first path component, the fullest first; files at the root count under '.'."""
    top = F.when(F.contains("path", F.lit("/")), F.element_at(F.split("path", "/"), 1)).otherwise(".")
    return files.groupBy(top.alias("top")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "top").limit(most)


def pack_statistics(files: DataFrame) -> DataFrame:
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.agg(F.count("*").alias("files"), F.count_distinct(folder).alias("dirs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


class Profile(NamedTuple):
    max_files: int
    symbol_cap: int


# How much of a repository an analysis of each depth sees.
PROFILES = {"fast": Profile(400, 500), "standard": Profile(2000, 2000), "deep": Profile(4000, 8000)}


def evidence_pack(files: DataFrame, profile: Profile = PROFILES["standard"]) -> dict[str, DataFrame]:
    """Files, entry points, symbols and statistics of repositories (repo_id, path, size, language, text), cut by the profile.

    Of each repository the first files by path are seen, and of those the first symbols by path and line; files behind the
    one that fills the cap of symbols give no entry points. Statistics name the reason if anything was cut: max_files, or
    else symbol_cap, which holds as soon as the cap is reached.
    """
    seen = checkpointed(capped(files, ["repo_id"], ["path"], profile.max_files))
    code = seen.where("language <> 'other'").select("repo_id", "path", "text", "language")
    parsed = python_symbols(code.where("language = 'python'"), "repo_id").select("repo_id", "path", F.col("start_line").alias("line"), "kind", "name")
    found = declarations(code.where("language <> 'python'"), "repo_id").unionByName(parsed)
    symbols = checkpointed(capped(found, ["repo_id"], ["path", "line", "name"], profile.symbol_cap))
    full = symbols.where(F.col("place") == profile.symbol_cap).select("repo_id", F.col("path").alias("last"))
    entries = seen.withColumn("role", entry_point(F.col("path"), F.col("text"))).where("role IS NOT NULL").join(full, "repo_id", "left").where("last IS NULL OR path <= last")
    folder = F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit(""))
    stats = seen.groupBy("repo_id").agg(F.count("*").alias("files"), F.count_distinct(folder).alias("dirs"), F.sum("size").alias("bytes"), F.max("total").alias("all_files"))
    counted = symbols.groupBy("repo_id").agg(F.count("*").alias("symbols"))
    stats = stats.join(counted, "repo_id", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))
    reason = F.when(F.col("all_files") > profile.max_files, "max_files").when(F.col("symbols") >= profile.symbol_cap, "symbol_cap")
    return {"files": seen.drop("place", "total"), "entry_points": entries.select("repo_id", "path", "role"), "symbols": symbols.drop("place", "total"), "stats": stats.withColumns({"truncated": reason.isNotNull(), "truncation_reason": reason}).drop("all_files")}


def tree(files: DataFrame) -> DataFrame:
    """(path, parent, depth, type, size) of all files and the folders above them."""
    parts = F.split("path", "/")
    f = files.select("path", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("parent"), F.size(parts).alias("depth"), F.lit("file").alias("type"), "size")
    up = files.where(F.contains("path", F.lit("/"))).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    up = up.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent"), F.size(F.split("path", "/")).alias("depth"), F.lit("dir").alias("type"), F.lit(None).cast("long").alias("size"))
    return f.unionByName(up)


def block_around(files: DataFrame, reach: int = 40) -> DataFrame:
    """(path, line, first, last): the run of non-blank lines around a line, at most ``reach`` lines each way, of files (path, line, lines)."""
    blank = lambda i: F.btrim(F.get("lines", i), F.lit(" \t")) == ""
    at = F.col("line") - 1
    before = F.filter(F.sequence(F.greatest(at - reach, F.lit(0)), at), lambda i: blank(i))
    after = F.filter(F.sequence(at, F.least(at + reach, F.size("lines") - 1)), lambda i: blank(i))
    first = F.coalesce(F.array_max(before) + 1, F.greatest(at - reach, F.lit(0)))
    last = F.coalesce(F.array_min(after) - 1, F.least(at + reach, F.size("lines") - 1))
    return files.where((F.col("line") >= 1) & (F.col("line") <= F.size("lines")) & ~blank(at)).select("path", "line", (first + 1).alias("first"), (last + 1).alias("last"))
