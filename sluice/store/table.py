"""A table with a schema: immutable Parquet commits and a manifest that names the live ones.

A commit is a directory that Spark writes once. The manifest holds the live commits and all schema versions; each
change writes the next numbered manifest, and the write fails if another writer has done so, so readers always see one
whole state. Columns have stable ids and files store columns by id, so adding, dropping and renaming columns touch the
manifest alone. UPDATE and DELETE rewrite only the commits that hold matching rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from sluice.errors import ColumnExists, ColumnNotFound, ManifestConflict, TableExists, TableNotFound, VersionNotFound
from sluice.sources.files import Files


#: Columns beside a table's own while it is rewritten.
_WHOLE, _HIT = "__stored_row", "__hit"


class Table:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name = spark, name
        self.files = Files(spark, f"{root.rstrip('/')}/{name}")
        newest = self._versions()
        if not newest:
            raise TableNotFound(name)
        self.state = json.loads(self.files.read(f"manifest/{newest[-1]:020d}.json"))

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, schema: StructType) -> Table:
        files = Files(spark, f"{root.rstrip('/')}/{name}")
        columns = [{"id": i, "name": f.name, "type": f.dataType.simpleString()} for i, f in enumerate(schema.fields)]
        names = [c["name"].lower() for c in columns]
        if len(set(names)) != len(names):
            raise ColumnExists(name)
        state = {
            "version": 1, "next_id": len(columns), "commits": [], "current": 1, "indexes": {},
            "schemas": [{"version": 1, "description": "created", "columns": columns}],
        }
        if not files.write(f"manifest/{1:020d}.json", json.dumps(state), overwrite=False):
            raise TableExists(name)
        return cls(spark, root, name)

    def _versions(self) -> list[int]:
        return sorted(int(f[:20]) for f in self.files.list("manifest") if f.endswith(".json") and f[:20].isdigit())

    def _save(self, state: dict) -> None:
        state = state | {"version": self.state["version"] + 1}
        if not self.files.write(f"manifest/{state['version']:020d}.json", json.dumps(state), overwrite=False):
            raise ManifestConflict(self.name)
        self.state = state

    # -- schema ---------------------------------------------------------------------------------------------------

    def columns(self, version: int | None = None) -> list[dict]:
        wanted = self.state["current"] if version is None else version
        for s in self.state["schemas"]:
            if s["version"] == wanted:
                return s["columns"]
        raise VersionNotFound(f"{self.name} version {wanted}")

    def schema(self, version: int | None = None) -> StructType:
        return StructType([StructField(c["name"], _parse_datatype_string(c["type"]), True) for c in self.columns(version)])

    def history(self) -> list[dict]:
        return [{"version": s["version"], "description": s["description"], "columns": [c["name"] for c in s["columns"]]} for s in self.state["schemas"]]

    def _find(self, name: str) -> dict:
        for c in self.columns():
            if c["name"].lower() == name.lower():
                return c
        raise ColumnNotFound(f"{self.name}.{name}")

    def _evolve(self, columns: list[dict], description: str, next_id: int | None = None) -> int:
        version = max(s["version"] for s in self.state["schemas"]) + 1
        self._save(self.state | {
            "schemas": [*self.state["schemas"], {"version": version, "description": description, "columns": columns}],
            "current": version, "next_id": next_id if next_id is not None else self.state["next_id"],
        })
        return version

    def add_column(self, name: str, kind: str) -> int:
        if any(c["name"].lower() == name.lower() for c in self.columns()):
            raise ColumnExists(f"{self.name}.{name}")
        column = {"id": self.state["next_id"], "name": name, "type": kind}
        return self._evolve([*self.columns(), column], f"add column {name}", self.state["next_id"] + 1)

    def drop_column(self, name: str) -> int:
        gone = self._find(name)["id"]
        return self._evolve([c for c in self.columns() if c["id"] != gone], f"drop column {name}")

    def rename_column(self, old: str, new: str) -> int:
        found = self._find(old)
        if any(c["name"].lower() == new.lower() and c["id"] != found["id"] for c in self.columns()):
            raise ColumnExists(f"{self.name}.{new}")
        return self._evolve([c | {"name": new} if c["id"] == found["id"] else c for c in self.columns()], f"rename column {old} to {new}")

    def rollback_schema(self, version: int) -> None:
        """Makes an earlier schema version current; rows keep every column's values by id."""
        self.columns(version)
        self._save(self.state | {"current": version})

    # -- rows -----------------------------------------------------------------------------------------------------

    def _stored(self) -> StructType:
        kinds = {c["id"]: c["type"] for s in self.state["schemas"] for c in s["columns"]}
        return StructType([StructField(f"c{i}", _parse_datatype_string(k), True) for i, k in sorted(kinds.items())])

    def _scan(self, commits: list[dict]) -> DataFrame:
        paths = [self.files.path(c["path"]) for c in commits]
        if not paths:
            return self.spark.createDataFrame([], self._stored())
        return self.spark.read.schema(self._stored()).parquet(*paths)

    def _named(self, stored: DataFrame, version: int | None = None) -> DataFrame:
        return stored.select(*[F.col(f"c{c['id']}").alias(c["name"]) for c in self.columns(version)])

    def df(self, version: int | None = None) -> DataFrame:
        """The rows under the current schema version, or under another."""
        return self._named(self._scan(self.state["commits"]), version)

    def count(self) -> int:
        """Rows, from the manifest alone."""
        return sum(c["rows"] for c in self.state["commits"])

    def _write(self, stored: DataFrame) -> dict:
        path = f"data/{self.state['version'] + 1:012d}-{uuid.uuid4().hex}"
        stored.write.parquet(self.files.path(path))
        return {"path": path, "rows": self.spark.read.schema(stored.schema).parquet(self.files.path(path)).count()}

    def append(self, rows: DataFrame) -> int:
        """Adds rows whose columns are named as the table's; missing ones are null. Returns how many."""
        given = {c.lower(): c for c in rows.columns}
        unknown = set(given) - {c["name"].lower() for c in self.columns()}
        if unknown:
            raise ColumnNotFound(f"{self.name}: {sorted(unknown)}")
        cols = [(F.col(f"`{given[c['name'].lower()]}`") if c["name"].lower() in given else F.lit(None)).cast(c["type"]).alias(f"c{c['id']}") for c in self.columns()]
        commit = self._write(rows.select(*cols))
        if commit["rows"]:
            self._save(self.state | {"commits": [*self.state["commits"], commit]})
        return commit["rows"]

    def _touched(self, predicate: Column) -> list[dict]:
        """The commits with a matching row: one narrow scan and a set of at most as many names as there are commits."""
        if not self.state["commits"]:
            return []
        names = [f"c{c['id']}" for c in self.columns()]
        scan = self._scan(self.state["commits"]).withColumn("_file", F.input_file_name())
        hit = scan.select(*[F.col(n).alias(c["name"]) for n, c in zip(names, self.columns())], "_file").where(predicate)
        folders = {r["f"] for r in hit.select(F.regexp_extract("_file", r"/(data/[^/]+)/[^/]*$", 1).alias("f")).distinct().collect()}
        return [c for c in self.state["commits"] if c["path"] in folders]

    def update(self, assignments: Mapping[str, Column], predicate: Column) -> int:
        """Sets columns of the matching rows; returns how many."""
        fresh = {self._find(n)["id"]: (e, self._find(n)["type"]) for n, e in assignments.items()}
        touched = self._touched(predicate)
        if not touched:
            return 0
        rows = self._marked(touched, predicate)
        n = rows.where(F.col(_HIT)).count()
        cols = []
        for f in self._stored().fields:
            kept, change = F.col(f"{_WHOLE}.{f.name}"), fresh.get(int(f.name[1:]))
            cols.append((kept if change is None else F.when(F.col(_HIT), change[0].cast(change[1])).otherwise(kept)).alias(f.name))
        self._replace(touched, rows.select(*cols))
        return n

    def delete(self, predicate: Column) -> int:
        """Drops the matching rows; returns how many."""
        touched = self._touched(predicate)
        if not touched:
            return 0
        rows = self._marked(touched, predicate)
        n = rows.where(F.col(_HIT)).count()
        self._replace(touched, rows.where(~F.col(_HIT)).select(f"{_WHOLE}.*"))
        return n

    def _marked(self, commits: list[dict], predicate: Column) -> DataFrame:
        """The commits' rows under their current names, beside all that is stored of them, dropped columns too."""
        named = [F.col(f"c{c['id']}").alias(c["name"]) for c in self.columns()]
        return self._scan(commits).select(F.struct("*").alias(_WHOLE), *named).withColumn(_HIT, F.coalesce(predicate, F.lit(False)))

    def _replace(self, old: list[dict], stored: DataFrame) -> None:
        commit = self._write(stored)
        rest = [c for c in self.state["commits"] if c not in old]
        self._save(self.state | {"commits": [*rest, commit] if commit["rows"] else rest})

    def truncate(self) -> int:
        n = self.count()
        self._save(self.state | {"commits": []})
        return n

    def overwrite(self, rows: DataFrame) -> None:
        """Replaces all rows by ``rows``, which has the table's columns."""
        self._replace(self.state["commits"], rows.select(*[F.col(f"`{c['name']}`").cast(c["type"]).alias(f"c{c['id']}") for c in self.columns()]))

    def compact(self, files: int | None = None) -> int:
        """Rewrites the live commits as one; returns how many there were."""
        old = self.state["commits"]
        if len(old) > 1:
            scan = self._scan(old)
            self._replace(old, scan.coalesce(files) if files else scan)
        return len(old)

    def vacuum(self, keep_manifests: int = 1) -> int:
        """Deletes commits that none of the newest manifests names, and older manifests; returns deleted commits."""
        versions = self._versions()
        live = set()
        for v in versions[-keep_manifests:]:
            live |= {c["path"] for c in json.loads(self.files.read(f"manifest/{v:020d}.json"))["commits"]}
        gone = [f"data/{d}" for d in self.files.list("data") if f"data/{d}" not in live]
        for d in gone:
            self.files.delete(d)
        for v in versions[:-keep_manifests]:
            self.files.delete(f"manifest/{v:020d}.json")
        return len(gone)

    def at_manifest(self, version: int) -> DataFrame:
        """The rows as some manifest had them."""
        if version not in self._versions():
            raise VersionNotFound(f"{self.name} manifest {version}")
        state = json.loads(self.files.read(f"manifest/{version:020d}.json"))
        columns = next(s["columns"] for s in state["schemas"] if s["version"] == state["current"])
        return self._scan(state["commits"]).select(*[F.col(f"c{c['id']}").alias(c["name"]) for c in columns])

    # -- index metadata: parquet statistics prune; an index names columns to sort and filter by ---------------------

    def set_indexes(self, indexes: dict) -> None:
        self._save(self.state | {"indexes": indexes})
