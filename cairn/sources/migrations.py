"""Numbered migrations of a knowledge base that is kept in snapshot stores.

A ``Registry`` names the tables of version 1 and, for every later version, the columns that it adds. The version of a store
stands in its manifest. Added columns rewrite no rows: the manifest gets a new schema, and files from before read as the
column's default. Derived tables, which can be built anew, live in a store of their own; a store from before that division is
split first. Every step is safe to run again, so a run that was killed is mended by the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cairn.sources.snapshots import Change, Snapshots


class Unsupported(RuntimeError):
    """The store is newer than this code, or no step leads from its version to the one asked for."""


class Outdated(RuntimeError):
    """The store is older than this code and no steps lead up, or columns are missing: it must be migrated."""


@dataclass(frozen=True)
class Added:
    """A column of a table; ``default`` is a SQL literal that rows from before hold, null if not given."""

    table: str
    name: str
    type: str = "string"
    default: str | None = None

    def field(self) -> StructField:
        kind = StructType.fromDDL(f"c {self.type}")[0].dataType
        return StructField(self.name, kind, True, {"EXISTS_DEFAULT": self.default} if self.default else {})


@dataclass(frozen=True)
class Registry:
    """``tables``: DDL of every table in version 1; ``steps``: what each later version adds; ``derived``: tables of the index store."""

    tables: dict[str, str]
    steps: dict[int, tuple[Added, ...]]
    derived: tuple[str, ...] = ()
    latest: int | None = None

    def newest(self) -> int:
        return self.latest or max([1, *self.steps])

    def columns(self, version: int | None = None) -> list[Added]:
        """All columns added up to a version, in order."""
        last = self.newest() if version is None else version
        return [c for n in sorted(self.steps) if n <= last for c in self.steps[n]]

    def schema(self, table: str, version: int | None = None) -> StructType:
        """A table's columns as of a version."""
        out = StructType.fromDDL(self.tables[table])
        for c in self.columns(version):
            if c.table == table and c.name not in out.names:
                out = out.add(c.field())
        return out


#: The columns that version 2 of the knowledge base added (fixed values).
STEPS = {2: (Added("analyses", "reindex_state", default="'indexed'"), Added("repos", "merged_into"), Added("chunks", "producer"))}
#: Tables that can be built anew (fixed values).
DERIVED = ("chunks", "chunk_vectors")
KNOWLEDGE = Registry(
    {
        "repos": "repo_id string, host string, owner string, name string, url string, default_branch string, head_sha string, is_stale boolean",
        "analyses": "analysis_id string, repo_id string, commit_sha string, status string, report_json string",
        "chunks": "chunk_id string, kind string, ref_id string, card_id string, text string, repo_id string, language string, heading string",
        "chunk_vectors": "chunk_id string, embedder string, dim int, vec array<float>",
    },
    STEPS,
    DERIVED,
)


class KnowledgeBase:
    """The stores of source and of derived tables, under one registry."""

    def __init__(self, source: Snapshots, index: Snapshots, registry: Registry = KNOWLEDGE):
        self.source, self.index, self.registry = source, index, registry

    def _home(self, table: str) -> Snapshots:
        return self.index if table in self.registry.derived else self.source

    def version(self) -> int:
        """The version of the schema; 0 where nothing was created yet. Anything but a number is an error."""
        return int(self.source.manifest()["meta"].get("schema_version", 0))

    def read(self, table: str) -> DataFrame:
        return self._home(table).read(table)

    def _plan(self, to: int) -> list[int]:
        """The numbers of the steps from the store's version to ``to``; the first that is missing ends it with an error."""
        numbers = list(range(max(self.version(), 1) + 1, to + 1))
        for n in numbers:
            if n not in self.registry.steps:
                raise Unsupported(f"no step {n - 1}->{n} on the way from version {self.version()} to {to}")
        return numbers

    def split(self) -> list[str]:
        """The derived tables that moved from the source store to the index store.

        Tables of the source store move if the index store has none of that name: all in one version of the index store, with the
        columns that both know, one row a key (the least by its text), and leave the source store in its next version. If a
        run dies between these two, the next one finds whence the index store was split and only drops the old tables.
        """
        old, new = self.source.manifest(), self.index.manifest()
        here = [t for t in self.registry.derived if t in old["schemas"]]
        if here and new["meta"].get("split_from") == old["version"]:
            self.source.amend(drop=here, base=old["version"])
            return here
        moving = [t for t in here if t not in new["schemas"]]
        if not moving:
            return []
        changes = {}
        for t in moving:
            rows, target = self.source.read(t, version=old["version"]), self.registry.schema(t)
            shared = [c for c in target.names if c in rows.columns]
            key, *rest = target.names
            if rest and key in shared:
                rows = rows.groupBy(key).agg(F.min_by(F.struct(*shared), F.to_json(F.struct(*shared))).alias("row")).select("row.*")
            lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in target if f.name not in shared]
            changes[t] = Change(rows.select(*[F.col(f.name).cast(f.dataType) for f in target if f.name in shared], *lacking).select(*target.names))
        self.index.commit(changes, base=new["version"], meta={"split_from": old["version"]})
        self.source.amend(drop=moving, base=old["version"])
        return moving

    def _create(self) -> None:
        """Tables of version 1 that neither store has yet, without rows."""
        for home in (self.index, self.source):
            m = home.manifest()
            lacking = {t: StructType.fromDDL(ddl) for t, ddl in self.registry.tables.items() if self._home(t) is home and t not in m["schemas"]}
            if lacking:
                home.amend(lacking, base=m["version"])

    def _add(self, columns: list[Added], version: int | None = None) -> list[str]:
        """Gives tables the columns they lack, the source store and its version number last."""
        added = []
        for home in (self.index, self.source):
            m = home.manifest()
            schemas = {t: StructType.fromJson(s) for t, s in m["schemas"].items()}
            wider = {}
            for c in columns:
                if self._home(c.table) is home and c.table in schemas and c.name not in schemas[c.table].names:
                    schemas[c.table] = wider[c.table] = StructType([*schemas[c.table].fields, c.field()])
                    added.append(f"{c.table}.{c.name}")
            number = {"schema_version": str(version)} if home is self.source and version else {}
            if wider or any(m["meta"].get(k) != v for k, v in number.items()):
                home.amend(wider, base=m["version"], meta=number)
        return added

    def missing(self) -> list[str]:
        """Columns of this code's version that tables lack, as table.column."""
        out = []
        for c in self.registry.columns():
            schema = self._home(c.table).manifest()["schemas"].get(c.table)
            if schema is not None and c.name not in StructType.fromJson(schema).names:
                out.append(f"{c.table}.{c.name}")
        return sorted(out)

    def migrate(self, to: int | None = None, dry_run: bool = False) -> dict:
        """Brings the stores to version ``to`` (the newest): what was or, in a dry run, would be done."""
        to, was = to or self.registry.newest(), self.version()
        if was > to:
            raise Unsupported(f"the store has version {was}, newer than {to}")
        numbers = self._plan(to)
        plan = {"from": was, "to": to, "steps": (["create"] if was == 0 else []) + [f"{n - 1}->{n}" for n in numbers]}
        if dry_run:
            return {"dry_run": True, **plan}
        moved = self.split()
        self._create()
        applied = []
        for n in [*([1] if was == 0 else []), *numbers]:
            applied += self._add(list(self.registry.steps.get(n, ())), n)
        applied += self._add(self.registry.columns(to))
        return {"dry_run": False, **plan, "moved_tables": moved, "applied_columns": applied, "schema_version": self.version()}

    def opened(self) -> KnowledgeBase:
        """The knowledge base, fit for this code: a newer store is refused, an older one goes up by the steps there are, and a
        right number with columns missing is an error too, as numbers are kept by hand and columns are facts."""
        newest = self.registry.newest()
        if self.version() > newest:
            raise Unsupported(f"the store has version {self.version()}, this code {newest}: use newer code")
        if self.version() < newest:
            try:
                self.migrate()
            except Unsupported as e:
                raise Outdated(f"the store must be migrated: {e}") from e
        if lacking := self.missing():
            raise Outdated(f"columns are missing, the store must be migrated: {', '.join(lacking)}")
        return self
