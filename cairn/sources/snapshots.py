"""Snapshots of many tables that become visible together: Parquet parts, and one small manifest per version that names them.

A commit writes its parts to a folder of their own, then moves a finished manifest to the name of the next version. The move
is atomic and fails if that version exists, so readers see all of a commit or nothing, a writer that dies leaves the old
version in place, and of two writers on one version the second gets a ``Conflict``. Tables may be cut into parts by
expressions; a commit then replaces the parts it names, and a reader opens the parts it needs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made the next version first."""


@dataclass(frozen=True)
class Change:
    """New rows of a table. ``by`` names the expressions that cut it into parts; ``only`` holds the values of the first of them
    whose parts are replaced (all rows must belong to those), None replaces the whole table. ``order`` sorts within files."""

    rows: DataFrame
    by: dict[str, Column] = field(default_factory=dict)
    only: tuple[str, ...] | None = None
    order: tuple[str, ...] = ()


def _values(key: str) -> dict[str, str]:
    return dict(x.split("=", 1) for x in key.split("/") if x)


class Snapshots:
    """The tables under ``root``, a folder that driver and executors share, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._jvm, self._conf = jvm, conf

    def _listed(self, pattern: str) -> list[str]:
        found = self._fs.globStatus(self._path(f"{self.root}/{pattern}"))
        return [x.getPath().toString() for x in found or []]

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max([0, *(int(p.rsplit("/", 1)[1].removesuffix(".json")) for p in self._listed("manifests/*.json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schemas": {}, "parts": {}, "meta": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, where: Callable[[dict[str, str]], bool] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a table; only of the parts whose values pass ``where``, if given: other parts are never listed or opened."""
        m = self.manifest(version)
        schema = StructType.fromJson(m["schemas"][table])
        paths = [f"{self.root}/{p}" for key, p in sorted(m["parts"][table].items()) if where is None or where(_values(key))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _written(self, name: str, change: Change, folder: str) -> dict[str, str]:
        rows, at = change.rows, f"{folder}/{name}"
        if change.by:
            # parts of any size: large ones go to several tasks, small ones share one
            rows = rows.withColumns(change.by).hint("rebalance", *change.by)
        if change.by or change.order:
            rows = rows.sortWithinPartitions(*change.by, *change.order)
        writer = rows.write.partitionBy(*change.by) if change.by else rows.write
        writer.parquet(f"{self.root}/{at}")
        if not change.by:
            return {"": at}
        skip = len(self._fs.makeQualified(self._path(f"{self.root}/{at}")).toString()) + 1
        return {p[skip:]: f"{at}/{p[skip:]}" for p in self._listed(f"{at}/" + "/".join(f"{c}=*" for c in change.by))}

    def commit(self, changes: dict[str, Change], base: int | None = None, meta: dict | None = None) -> int:
        """The number of the version that holds the changes on top of version ``base`` (the newest, if not given)."""
        old = self.manifest(base)
        base, parts, schemas, folder = old["version"], dict(old["parts"]), dict(old["schemas"]), f"data/{uuid.uuid4().hex}"
        for name, change in changes.items():
            made, kept = self._written(name, change, folder), {}
            if change.only is not None:
                first, only = next(iter(change.by)), set(map(str, change.only))
                kept = {k: p for k, p in parts.get(name, {}).items() if _values(k)[first] not in only}
                if stray := {_values(k)[first] for k in made} - only:
                    raise ValueError(f"{name}: rows of parts that are not replaced: {sorted(stray)[:5]}")
            parts[name] = kept | made
            known = {f["name"]: f["metadata"] for f in schemas.get(name, {"fields": []})["fields"]} if kept else {}
            schemas[name] = change.rows.schema.jsonValue()
            for f in schemas[name]["fields"]:  # parts that stay may hold files from before a column
                f["metadata"] = {k: v for k, v in known.get(f["name"], {}).items() if k == "EXISTS_DEFAULT"} | f["metadata"]
        self._publish(base + 1, {"version": base + 1, "schemas": schemas, "parts": parts, "meta": old["meta"] | (meta or {})})
        return base + 1

    def amend(self, schemas: dict[str, StructType] | None = None, drop: Iterable[str] = (), base: int | None = None, meta: dict | None = None) -> int:
        """The number of a version on top of ``base`` that writes no rows: other schemas for tables (files without a column read
        as its EXISTS_DEFAULT, or null), new tables without rows, and tables that are gone."""
        old, gone = self.manifest(base), set(drop)
        told = {t: s.jsonValue() for t, s in (schemas or {}).items()}
        schemas = {t: s for t, s in (old["schemas"] | told).items() if t not in gone}
        parts = {t: old["parts"].get(t, {}) for t in schemas}
        self._publish(old["version"] + 1, {"version": old["version"] + 1, "schemas": schemas, "parts": parts, "meta": old["meta"] | (meta or {})})
        return old["version"] + 1

    def _publish(self, version: int, manifest: dict) -> None:
        draft, name = (self._path(f"{self.root}/manifests/{x}") for x in (f".{uuid.uuid4().hex}", f"{version}.json"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        rename = getattr(fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        try:
            fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(draft), self._fs.makeQualified(name), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} exists already") from e

    def vacuum(self, keep: int = 2) -> int:
        """Drops all versions but the newest ``keep`` and the parts that only those name; how many folders went. What commits in progress write stays."""
        numbers = sorted(int(p.rsplit("/", 1)[1].removesuffix(".json")) for p in self._listed("manifests/*.json"))
        folders = lambda ns: {"/".join(p.split("/")[:3]) for n in ns for t in self.manifest(n)["parts"].values() for p in t.values()}
        old, live = numbers[:-keep], folders(numbers[-keep:])
        gone = folders(old) - live
        for path in (*gone, *(f"manifests/{n}.json" for n in old)):
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
        return len(gone)
