"""Histories of schemas and indexes, named checkpoints, and feature flags: descriptions only, no data."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql.types import StructType

from sluice.errors import IndexExists, IndexNotFound, TableNotFound, VersionNotFound


@dataclass
class SchemaVersion:
    version: int
    schema: StructType
    description: str


class SchemaVersions:
    def __init__(self):
        self._all: dict[str, list[SchemaVersion]] = {}
        self._current: dict[str, int] = {}

    def register(self, table: str, schema: StructType) -> int:
        self._all[table] = [SchemaVersion(1, schema, "registered")]
        self._current[table] = 1
        return 1

    def history(self, table: str) -> list[SchemaVersion]:
        if table not in self._all:
            raise TableNotFound(table)
        return list(self._all[table])

    def alter(self, table: str, schema: StructType, description: str = "") -> int:
        version = max(v.version for v in self.history(table)) + 1
        self._all[table].append(SchemaVersion(version, schema, description))
        self._current[table] = version
        return version

    def at(self, table: str, version: int) -> StructType:
        for v in self.history(table):
            if v.version == version:
                return v.schema
        raise VersionNotFound(f"{table} version {version}")

    def current(self, table: str) -> StructType:
        self.history(table)
        return self.at(table, self._current[table])

    def current_version(self, table: str) -> int:
        self.history(table)
        return self._current[table]

    def rollback(self, table: str, version: int) -> None:
        self.at(table, version)
        self._current[table] = version


@dataclass
class IndexVersion:
    version: int
    columns: list[str]
    kind: str
    status: str = "building"


@dataclass
class IndexHistory:
    name: str
    table: str
    versions: list[IndexVersion] = field(default_factory=list)


class IndexVersions:
    """building -> active; the version that was active before is disabled."""

    def __init__(self):
        self._all: dict[str, IndexHistory] = {}

    def _get(self, name: str) -> IndexHistory:
        if name not in self._all:
            raise IndexNotFound(name)
        return self._all[name]

    def create(self, name: str, table: str, columns: list[str], kind: str = "hash") -> int:
        if name in self._all:
            raise IndexExists(name)
        self._all[name] = IndexHistory(name, table, [IndexVersion(1, list(columns), kind, "active")])
        return 1

    def start_reindex(self, name: str, columns: list[str], kind: str = "hash") -> int:
        h = self._get(name)
        h.versions.append(IndexVersion(len(h.versions) + 1, list(columns), kind))
        return len(h.versions)

    def complete_reindex(self, name: str, version: int) -> None:
        h = self._get(name)
        if not 1 <= version <= len(h.versions):
            raise VersionNotFound(f"{name} version {version}")
        for v in h.versions:
            if v.status == "active":
                v.status = "disabled"
        h.versions[version - 1].status = "active"

    def active(self, name: str) -> IndexVersion:
        for v in self._get(name).versions:
            if v.status == "active":
                return v
        raise VersionNotFound(name)

    def list(self, table: str) -> list[str]:
        return sorted(h.name for h in self._all.values() if h.table == table)

    def history(self, name: str) -> list[dict]:
        return [asdict(v) for v in self._get(name).versions]


class Checkpoints:
    """Named copies of a JSON description, newest last; kept in memory or in a ``Files`` folder."""

    def __init__(self, files=None):
        self._files, self._all = files, {}
        if files is not None and files.exists("checkpoints.json"):
            self._all = json.loads(files.read("checkpoints.json"))

    def create(self, name: str, state: Any, description: str = "") -> None:
        self._all.pop(name, None)
        self._all[name] = {"state": json.loads(json.dumps(state)), "description": description}
        if self._files is not None:
            self._files.write("checkpoints.json", json.dumps(self._all))

    def list(self) -> list[str]:
        return list(self._all)

    def rollback(self, name: str) -> Any:
        if name not in self._all:
            raise VersionNotFound(name)
        return json.loads(json.dumps(self._all[name]["state"]))

    def rollback_newest(self) -> Any:
        if not self._all:
            raise VersionNotFound("no checkpoint")
        return self.rollback(list(self._all)[-1])


class Features:
    """Switches by name: a default, then a file, then the environment, then what was set."""

    def __init__(self, defaults: dict[str, bool] | None = None, file: str | None = None, prefix: str = "SLUICE_FEATURE_"):
        self._values = dict(defaults or {})
        if file and os.path.exists(file):
            with open(file) as f:
                self._values |= {k: bool(v) for k, v in json.load(f).items()}
        for k, v in os.environ.items():
            if k.startswith(prefix):
                self._values[k.removeprefix(prefix).lower()] = v.strip().lower() in ("1", "true", "on", "yes")

    def enabled(self, name: str) -> bool:
        return self._values.get(name, False)

    def set(self, name: str, on: bool) -> None:
        self._values[name] = on

    def save(self, file: str) -> None:
        with open(file, "w") as f:
            json.dump(self._values, f, indent=1, sort_keys=True)

    def all(self) -> dict[str, bool]:
        return dict(self._values)
