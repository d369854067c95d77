"""The facade: statements, key-value tables, transactions, parameters, versions."""

import dataclasses

import pytest

from sluice.engine import Engine, literal
from sluice.errors import (
    ColumnExists,
    ColumnNotFound,
    IndexNotFound,
    ManifestConflict,
    NoRows,
    ParameterError,
    SqlSyntax,
    TableExists,
    TableNotFound,
    TooManyRows,
    TransactionClosed,
    TypeMismatch,
    VersionNotFound,
)
from sluice.store import Table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def users(engine):
    engine.sql("CREATE TABLE users (id INT PRIMARY KEY, name VARCHAR(20) NOT NULL, age INT, score FLOAT)")
    assert engine.execute("INSERT INTO users VALUES (1, 'Alice', 30, 1.5), (2, 'Bob', 25, NULL), (3, 'Eve', NULL, 2.5)").run() == 3
    return engine


def test_insert_is_selectable(users):
    assert rows(users.sql("SELECT id, name FROM users WHERE age > 26")) == [(1, "Alice")]
    assert users.sql("INSERT INTO users (name, id) VALUES ('Zoe', 4)").first()[0] == 1
    assert users.sql("SELECT age FROM users WHERE id = 4").first()[0] is None
    assert dict(users.table("users").dtypes) == {"id": "bigint", "name": "string", "age": "bigint", "score": "double"}


def test_update_and_delete(users):
    assert users.execute("UPDATE users SET age = age + 1, name = 'it''s, = ok' WHERE id <= 2").run() == 2
    assert rows(users.sql("SELECT id, age, name FROM users")) == [(1, 31, "it's, = ok"), (2, 26, "it's, = ok"), (3, None, "Eve")]
    assert users.execute("UPDATE users SET age = 1 WHERE id = 99").run() == 0
    assert users.execute("DELETE FROM users WHERE age > 30").run() == 1  # null ages do not match
    assert users.count("users") == 2
    assert users.execute("DELETE FROM users").run() == 2
    assert users.sql("SELECT * FROM users").count() == 0


def test_only_touched_commits_are_rewritten(users):
    users.sql("INSERT INTO users VALUES (9, 'Late', 1, 1.0)")
    before = [c["path"] for c in users._sql_table("users").state["commits"]]
    users.sql("UPDATE users SET score = 0 WHERE id = 9")
    after = [c["path"] for c in users._sql_table("users").state["commits"]]
    assert before[0] in after and before[1] not in after


def test_alter(users):
    users.sql("ALTER TABLE users ADD COLUMN email TEXT")
    users.sql("ALTER TABLE users RENAME COLUMN name TO title")
    users.sql("ALTER TABLE users DROP COLUMN age")
    assert users.table("users").columns == ["id", "title", "score", "email"]
    assert rows(users.sql("SELECT id, title, email FROM users WHERE id = 1")) == [(1, "Alice", None)]
    users.sql("ALTER TABLE users ADD COLUMN age TEXT")  # a new column: old values of that name do not return
    assert users.sql("SELECT age FROM users WHERE id = 1").first()[0] is None
    with pytest.raises(ColumnExists):
        users.sql("ALTER TABLE users ADD COLUMN title TEXT")
    with pytest.raises(ColumnNotFound):
        users.sql("ALTER TABLE users DROP COLUMN nothing")
    t = users._sql_table("users")
    assert [h["version"] for h in t.history()] == [1, 2, 3, 4, 5]
    assert t.df(1).columns == ["id", "name", "age", "score"]
    t.rollback_schema(1)
    assert rows(t.df().select("name", "age").where("id = 1")) == [("Alice", 30)]
    with pytest.raises(VersionNotFound):
        t.df(77)


def test_create_and_drop(engine):
    engine.sql("CREATE TABLE a (x INT)")
    with pytest.raises(TableExists):
        engine.sql("CREATE TABLE a (x INT)")
    engine.sql("CREATE TABLE IF NOT EXISTS a (x INT)")
    engine.sql("CREATE TABLE b AS SELECT 1 AS x, 'y' AS z")
    assert rows(engine.sql("SELECT * FROM b")) == [(1, "y")]
    engine.sql("DROP TABLE a")
    assert engine.table_names() == ["b"]
    with pytest.raises(TableNotFound):
        engine.sql("DROP TABLE a")
    engine.sql("DROP TABLE IF EXISTS a")


def test_indexes(users):
    users.sql("CREATE INDEX i ON users (name, age)")
    assert users.indexes("users") == {"i": ["name", "age"]}
    assert rows(users.index_lookup("users", "name", "Bob").select("id")) == [(2,)]
    users.sql("DROP INDEX users.i")
    with pytest.raises(IndexNotFound):
        users.sql("DROP INDEX i")
    users.sql("DROP INDEX IF EXISTS i")
    with pytest.raises(ColumnNotFound):
        users.sql("CREATE INDEX j ON users (nothing)")


def test_bad_statements(users):
    with pytest.raises(SqlSyntax):
        users.sql("UPDATE users age = 1")
    with pytest.raises(ColumnNotFound):
        users.sql("INSERT INTO users (id, nothing) VALUES (1, 2)")
    with pytest.raises(SqlSyntax):
        users.sql("INSERT INTO users (id, name) VALUES (1)")


def test_alias_in_where(users):
    assert rows(users.sql("SELECT id, age * 2 AS double_age FROM users WHERE double_age > 55 AND 'double_age' <> ''")) == [(1, 60)]
    # a column of that name wins
    assert rows(users.sql("SELECT id AS age FROM users WHERE age = 25")) == [(2,)]


def test_parameters(users):
    q = users.query("SELECT name FROM users WHERE id = $2 OR name = $1").bind("Alice").bind(2)
    assert sorted(q.fetch_all()) == [("Alice",), ("Bob",)]
    assert users.query("SELECT name FROM users WHERE id = :i").param("i", 3).fetch_first()[0] == "Eve"
    assert users.prepare("SELECT name FROM users WHERE id = ?").execute([1]).first()[0] == "Alice"
    users.prepare("SELECT name FROM users WHERE id = ?")
    assert users.plans.stats() == {"entries": 1, "hits": 1, "misses": 1}
    with pytest.raises(ParameterError):
        users.query("SELECT $1, :a").bind(1).param("a", 2).fetch_all()
    with pytest.raises(ParameterError):
        users.query("SELECT $1, $2").bind(1).fetch_all()
    # values never become SQL
    evil = "x' OR '1'='1"
    assert users.execute("DELETE FROM users WHERE name = $1").bind(evil).run() == 0
    assert users.execute("UPDATE users SET name = $1 WHERE id = 1").bind("back\\slash 'q'").run() == 1
    assert users.sql("SELECT name FROM users WHERE id = 1").first()[0] == "back\\slash 'q'"


def test_row_kinds(users):
    @dataclasses.dataclass
    class User:
        id: int
        name: str
        extra: int = 7

    assert users.query("SELECT id, name FROM users ORDER BY id", User).fetch_first() == User(1, "Alice")
    assert users.query_one("SELECT name FROM users WHERE id = 1", str).fetch() == "Alice"
    with pytest.raises(TooManyRows):
        users.query_one("SELECT name FROM users").fetch()
    with pytest.raises(NoRows):
        users.query_one("SELECT name FROM users WHERE id = 0").fetch()
    assert users.query_optional("SELECT name FROM users WHERE id = 0").fetch() is None
    assert users.query_scalar("SELECT count(*) FROM users", int).fetch() == 3
    with pytest.raises(TypeMismatch):
        users.query_scalar("SELECT name FROM users", int).fetch()


def test_parse_batch(engine):
    good, bad = engine.parse_batch(["SELECT 1", "SELEC 1 FRM"], partial=True)
    assert not isinstance(good, Exception) and isinstance(bad, Exception)
    with pytest.raises(Exception):
        engine.parse_batch(["SELEC 1 FRM"])
    seen = []
    engine.parse_batch(["SELECT 1", "SELECT 2"], each=lambda i, s: seen.append(i))
    assert seen == [0, 1]


def test_literal():
    assert [literal(x) for x in (None, True, 3, "a'b", b"\x01")] == ["NULL", "TRUE", "3", "'a''b'", "X'01'"]


def test_concurrent_writers_conflict(users):
    other = Table(users.spark, f"{users.root}/tables", "users")
    users.sql("INSERT INTO users VALUES (5, 'E', 1, 1.0)")
    with pytest.raises(ManifestConflict):
        other.truncate()


def test_compact_vacuum_and_time_travel(users):
    users.sql("INSERT INTO users VALUES (5, 'E', 1, 1.0)")
    t = users._sql_table("users")
    version = t.state["version"]
    users.sql("DELETE FROM users WHERE id = 1")
    assert t.at_manifest(version).count() == 4 and t.count() == 3
    assert t.compact() == 2 and len(t.state["commits"]) == 1
    assert t.vacuum() >= 2 and t.df().count() == 3


def test_reopen(engine):
    engine.sql("CREATE TABLE a (x INT)")
    engine.sql("INSERT INTO a VALUES (1), (2)")
    engine.insert("kv", b"k", b"v")
    engine.close()
    again = Engine.open(engine.root, engine.spark)
    assert rows(again.sql("SELECT x FROM a")) == [(1,), (2,)]
    assert again.get("kv", b"k") == b"v" and again.current_timestamp() == engine.current_timestamp()


def test_key_value(engine):
    engine.insert_batch("t", [(b"a", b"1"), (b"b", b"2"), (b"longer-than-eight", b"3")])
    before = engine.current_timestamp()
    engine.flush("t")
    engine.insert("t", b"a", b"")  # an empty value is a value
    assert engine.delete("t", b"b") and not engine.delete("t", b"missing")
    assert engine.get("t", b"a") == b"" and engine.get("t", b"b") is None
    assert engine.get_snapshot("t", b"b", before) == b"2"
    assert [bytes(r["key"]) for r in engine.scan("t").collect()] == [b"a", b"longer-than-eight"]
    assert [bytes(r["key"]) for r in engine.range("t", b"a", b"b").collect()] == [b"a"]
    assert engine.physical_count("t") == 6 and engine.count("t") == 2
    engine.insert_versioned("t", b"a", b"old", 1)
    assert engine.get("t", b"a") == b""


def test_gc(engine):
    for ts, v in ((1, b"v1"), (3, b"v2"), (5, None)):
        engine.insert_versioned("t", b"a", v, ts)
    engine.insert_versioned("t", b"b", b"x", 2)
    assert engine.get("t", b"a", 4) == b"v2"
    assert engine.gc_estimate(4) == 1 and engine.gc(4) == 1
    assert engine.get("t", b"a", 4) == b"v2" and engine.get("t", b"b") == b"x"
    assert engine.gc(5) == 2 and engine.get("t", b"a") is None  # the tombstone goes with what it hides


def test_transaction(engine):
    engine.insert("t", b"a", b"1")
    tx = engine.begin()
    tx.insert("t", b"b", b"2")
    engine.insert("t", b"c", b"3")  # after the snapshot
    assert tx.get("t", b"b") == b"2" and tx.get("t", b"c") is None and engine.get("t", b"b") is None
    assert [bytes(r["key"]) for r in tx.scan("t").collect()] == [b"a", b"b"]
    assert tx.sql("SELECT count(*) FROM t").first()[0] == 2 and engine.sql("SELECT count(*) FROM t").first()[0] == 2
    tx.delete("t", b"a")
    assert tx.get("t", b"a") is None
    ts = tx.commit()
    assert engine.current_timestamp() == ts and engine.get("t", b"a") is None and engine.get("t", b"b") == b"2"
    with pytest.raises(TransactionClosed):
        tx.get("t", b"a")
    with pytest.raises(ZeroDivisionError), engine.begin() as t:
        t.insert("t", b"z", b"9")
        1 / 0
    assert engine.get("t", b"z") is None


def test_triggers(users):
    seen = []
    from sluice.automation import Event, EventType, Trigger

    users.triggers.register(Trigger("bad", EventType.AFTER_UPDATE, "users", lambda e: 1 / 0))
    users.triggers.register(Trigger("n", EventType.AFTER_UPDATE, "users", lambda e: seen.append(e.data["rows"])))
    users.triggers.register(Trigger("r", EventType.AFTER_DELETE, "users", lambda e: seen.append(e.data["name"]), condition=lambda e: e.data["id"] == 2, for_each_row=True))
    users.sql("UPDATE users SET age = 1 WHERE id < 3")
    users.sql("DELETE FROM users WHERE id < 3")
    assert seen == [2, "Bob"]
    assert users.triggers.fire(Event(EventType.AFTER_UPDATE, "USERS", {"rows": 1})) == ["n"]
    users.sql("DROP TRIGGER n")
    assert users.triggers.list() == ["bad", "r"]
