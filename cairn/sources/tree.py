"""A working tree as a table: a data source whose partitions are directories, pruned before they are listed."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.sources.files import ignore_pattern

# What no walk enters or returns, and languages by extension.
IGNORED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "vendor", "third_party", "deps", "dist", "build", "target", "out", ".next", ".nuxt", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".idea", ".vscode",
    "coverage", ".cache", ".pytest_cache", ".ruff_cache", ".gradle", ".terraform",
)
IGNORED_NAMES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "composer.lock", "Cargo.lock", "go.sum", ".DS_Store")
IGNORED_SUFFIXES = (".min.js", ".min.css", ".lock")
BINARY = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".tif", ".tiff", ".svgz", ".pdf", ".zip", ".gz", ".tgz", ".bz2", ".xz", ".7z", ".rar", ".jar", ".war", ".class", ".pyc", ".pyo", ".so", ".dylib",
    ".dll", ".a", ".o", ".obj", ".bin", ".exe", ".wasm", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp3", ".mp4", ".mov", ".avi", ".webm", ".ogg", ".wav", ".flac", ".psd", ".ai", ".sketch", ".db", ".sqlite",
    ".sqlite3", ".pack", ".idx",
)
TREE_LANGUAGE = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java",
    "kt": "kotlin", "scala": "scala", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "swift": "swift", "m": "objc", "mm": "objc",
    "sh": "shell", "bash": "shell", "zsh": "shell", "fish": "shell", "lua": "lua", "pl": "perl", "r": "r", "dart": "dart", "ex": "elixir", "exs": "elixir", "erl": "erlang", "clj": "clojure", "hs": "haskell",
    "sql": "sql", "html": "html", "htm": "html", "css": "css", "scss": "scss", "less": "less", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "md": "markdown", "rst": "markdown",
    "txt": "text", "xml": "xml", "proto": "proto",
}
SHELL_NAMES = ("Makefile", "Dockerfile", "makefile")


def tree_language(path: str) -> str:
    """The language of a file by its name; 'other' for unknown ones."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, end = name.rpartition(".")
    return "shell" if name in SHELL_NAMES else TREE_LANGUAGE.get(end.lower(), "other") if dot and stem else "other"


class _Rules:
    """Ignore rules; the last that matches decides."""

    def __init__(self, rules: list[str]):
        self.rules = [(re.compile(p), back) for p, back in filter(None, map(ignore_pattern, rules))]

    def match(self, path: str) -> bool:
        return next((not back for pattern, back in reversed(self.rules) if pattern.search(path)), False)


class _Walk(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base = os.path.join(options["path"], options.get("subpath", ""))
        self.content, self.parts = options.get("content", "true") == "true", int(options.get("partitions", "32"))
        self.most = int(options["max_file_bytes"]) if "max_file_bytes" in options else None
        given = json.loads(options["rules"]) if "rules" in options else self._own_rules()
        self.rules = _Rules(given)

    def _own_rules(self) -> list[str]:
        try:
            with open(os.path.join(self.base, ".gitignore"), encoding="utf-8", errors="replace") as f:
                return f.read().splitlines()
        except OSError:
            return []

    def _listed(self, folder: str) -> tuple[list[str], list[tuple[str, os.DirEntry]]]:
        """The folders and files of a folder that nothing leaves out; links are left out, as is what cannot be read."""
        folders, files = [], []
        try:
            entries = sorted(os.scandir(os.path.join(self.base, folder)), key=lambda e: e.name)
        except OSError:
            return folders, files
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in IGNORED_DIRS and not self.rules.match(path + "/"):
                    folders.append(path)
            elif e.is_file(follow_symlinks=False):
                low, dot = e.name.lower(), os.path.splitext(e.name)[1].lower()
                if not (e.name in IGNORED_NAMES or e.name in IGNORED_DIRS or low.endswith(IGNORED_SUFFIXES) or dot in BINARY or self.rules.match(path)):
                    files.append((path, e))
        return folders, files

    def partitions(self) -> list[_Walk]:
        """Folders opened from the top, breadth first, until there are enough to walk; no more are listed here."""
        shallow, waiting, at = [], [""] if os.path.isdir(self.base) else [], 0
        while at < len(waiting) and len(waiting) - at + len(shallow) < self.parts:
            shallow.append(_Walk(waiting[at], False))
            waiting += self._listed(waiting[at])[0]
            at += 1
        return shallow + [_Walk(f, True) for f in waiting[at:]] or [_Walk("", False)]

    def read(self, partition: _Walk) -> Iterator[tuple]:
        waiting = [partition.folder]
        while waiting:
            folders, files = self._listed(waiting.pop())
            if partition.deep:
                waiting += folders
            for path, e in files:
                try:
                    size = e.stat(follow_symlinks=False).st_size
                    if self.most is not None and size > self.most:
                        continue
                    data = open(e.path, "rb").read() if self.content else None
                except OSError:
                    continue
                yield path, size, tree_language(path), data


class TreeSource(DataSource):
    """Files (path, size, language, content) below a folder on a file system that all executors have.

    Options: path, subpath, rules (a JSON list; the folder's own .gitignore by default), max_file_bytes, content (false leaves
    it null), partitions. Names, folders, suffixes and kinds of files in the fixed lists, links, and what the rules match are
    left out; folders so left out are never listed.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, size long, language string, content binary"

    def reader(self, schema) -> _TreeReader:
        return _TreeReader(self.options)


def source_tree(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """The files of a working tree; cut it by ``profiling.capped`` in order of path where there may be too many."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("source_tree").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
