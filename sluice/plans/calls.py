"""Registered queries that go through the engine's calls rather than its SQL: key-value calls, fetches, prepared statements,
automation, versions, durability. Each has SQL for DuckDB over the same tables.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from sluice import operators as op
from sluice.automation import Cron, Daily, Event, EventType, Interval, Job, Once, Scheduler, Trigger, Weekly
from sluice.benchmark import Benchmarks
from sluice.engine import Engine
from sluice.errors import DuplicateName, EngineError, NoRows, TooManyRows, TypeMismatch
from sluice.plans.catalogue import _nation, _plain, engine, query, scratch, table
from sluice.sources import load_cache, persist_cache, read_encrypted, read_parquet, rekey, write_encrypted, write_parquet
from sluice.store.keyvalue import valid_at
from sluice.udf import truthy
from sluice.versions import Checkpoints, Features, IndexVersions


def facts(spark, **values):
    """One row a fact: name and value as text."""
    return spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in values.items()], "name string, value string")


def told(**values) -> str:
    """The same rows as SQL; a value is SQL text."""
    return " UNION ALL ".join(f"SELECT '{k}' AS name, CAST({v} AS VARCHAR) AS value" for k, v in values.items())


def raised(kind, f) -> bool:
    try:
        f()
    except kind:
        return True
    return False


def _customers(spark, folder) -> Engine:
    """Customers' names by key, as a key-value table."""
    e = engine(spark, folder)
    e.insert_batch("kv", [(str(r[0]).encode(), r[1].encode()) for r in table(spark, folder, "nation").select("n_nationkey", "n_name").collect()])
    return e


@query("SELECT n_name, n_regionkey FROM nation")
def scan_columns(spark, folder):  # SRC-02
    return op.project(table(spark, folder, "nation"), [("n_name", "n_name"), ("n_regionkey", "n_regionkey")])


@query(told(stored="(SELECT n_name FROM nation WHERE n_nationkey = 7)", missing="'None'", deleted="'None'", kept="(SELECT n_name FROM nation WHERE n_nationkey = 3)"))
def kv_get(spark, folder):  # SRC-07, SNK-08
    e = _customers(spark, folder)
    before = e.current_timestamp()
    e.flush()
    e.delete("kv", b"3")
    text = lambda v: None if v is None else v.decode()
    return facts(spark, stored=text(e.get("kv", b"7")), missing=text(e.get("kv", b"none")), deleted=text(e.get("kv", b"3")), kept=text(e.get_snapshot("kv", b"3", before)))


@query(told(live="(SELECT count(*) FROM nation)", physical="(SELECT count(*) FROM nation) + 2", table_="(SELECT count(*) FROM nation)", names="'kv,n2,nation'"))
def row_counts(spark, folder):  # SRC-10, SRC-11
    e = _nation(spark, folder)
    e.insert_batch("kv", [(str(r[0]).encode(), b"x") for r in table(spark, folder, "nation").select("n_nationkey").collect()])
    e.insert("kv", b"1", b"y")
    e.insert_versioned("kv", b"1", b"z", e.current_timestamp() + 5)
    return facts(spark, live=e.count("kv"), physical=e.physical_count("kv"), table_=e.count("n2"), names=",".join(e.table_names()))


@query("SELECT key, value FROM (VALUES ('a', 'late'), ('b', 'v1')) AS t(key, value)")
def kv_versioned(spark, folder):  # SNK-08
    e = engine(spark, folder)
    e.insert_versioned("kv", b"a", b"late", 9)
    e.insert_versioned("kv", b"a", b"early", 3)
    e.insert_versioned("kv", b"b", b"v1", 4)
    e.insert_versioned("kv", b"c", None, 5)
    return e.scan("kv").select(*[F.col(c).cast("string").alias(c) for c in ("key", "value")])


@query("SELECT n_nationkey, n_name FROM nation")
def cache_restored(spark, folder):  # SRC-16
    path = scratch(spark, "cache")
    persist_cache(table(spark, folder, "nation").select("n_nationkey", "n_name"), path).unpersist()
    return load_cache(spark, path)


@query("SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)")
def membership_filter(spark, folder):  # SRC-20
    orders, path = table(spark, folder, "orders"), scratch(spark, "bloom")
    write_parquet(orders.select("o_orderkey", "o_custkey"), path, "zstd", bloom=("o_custkey",))
    wanted = orders.agg(F.max("o_custkey")).first()[0]
    return read_parquet(spark, path).where(F.col("o_custkey") == wanted).select("o_orderkey")


@query(told(flushed="(SELECT count(*) FROM nation)", commits="2", compacted="1", live="(SELECT count(*) FROM nation) + 1"))
def flush_and_compact(spark, folder):  # SNK-13, SNK-14
    e = _customers(spark, folder)
    flushed = e.flush("kv")
    e.insert("kv", b"new", b"x")
    e.flush("kv")
    commits = e.compact("kv")
    return facts(spark, flushed=flushed, commits=commits, compacted=len(e.kv("kv").table.state["commits"]), live=e.count("kv"))


@query(told(there="'false'", again="'true'", quiet="0"))
def drop_table(spark, folder):  # DDL-02
    e = _nation(spark, folder)
    e.sql("DROP TABLE n2")
    return facts(spark, there="n2" in e.table_names(), again=raised(EngineError, lambda: e.sql("DROP TABLE n2")), quiet=e.execute_statement("DROP TABLE IF EXISTS n2"))


@query(told(jobs="'nightly'", due="'2024-03-01 02:30'", after="''", triggers="''", functions="''"))
def create_and_drop_job(spark, folder):  # DDL-10, DDL-11, SCH-03
    e = Engine(spark, scratch(spark, "engine"), clock=lambda: datetime(2024, 2, 29, 12, 0, tzinfo=UTC))
    e.sql("CREATE TABLE watched (k INT)")
    e.functions.register(_plain("sweep", lambda *a: True))
    e.sql("CREATE JOB nightly SCHEDULE '30 2 * * *' EXECUTE FUNCTION sweep")
    e.sql("CREATE TRIGGER t1 AFTER INSERT ON watched EXECUTE FUNCTION sweep")
    jobs, due = ",".join(e.scheduler.list()), e.scheduler.next_due("nightly").strftime("%Y-%m-%d %H:%M")
    for what in ("JOB nightly", "TRIGGER t1", "FUNCTION sweep"):
        e.sql(f"DROP {what}")
    return facts(spark, jobs=jobs, due=due, after=",".join(e.scheduler.list()), triggers=",".join(e.triggers.list()), functions=",".join(e.functions.list()))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_by_all(spark, folder):  # AGG-12
    return engine(spark, folder, "orders").sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")


@query("SELECT n_nationkey AS key, n_regionkey AS value FROM nation ORDER BY key")
def sorted_pairs(spark, folder):  # SRT-05
    return op.sort_key_value(table(spark, folder, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value")))


@query(told(arrived="(SELECT count(*) FROM region)"))
def stream_triggers(spark, folder):  # STR-04
    from sluice.streaming import changes, fire_on_arrival

    e, seen, path = engine(spark, folder), [], scratch(spark, "arrivals")
    table(spark, folder, "region").write.parquet(path)
    e.triggers.register(Trigger("t", EventType.AFTER_INSERT, "region", lambda event: seen.append(event.data.get("rows", 1))))
    fire_on_arrival(changes(spark, path, table(spark, folder, "region").schema), "region", e.triggers, scratch(spark, "progress")).awaitTermination()
    return facts(spark, arrived=sum(seen))


@query(told(called="'XY'", calls="2", errors="1", duplicate="'true'", names="'upper_of'", after="''"))
def function_registry(spark, folder):  # UDF-04, UDF-06
    e = engine(spark, folder)
    e.functions.register(_plain("upper_of", lambda s: s.upper()))
    called = e.functions.call("upper_of", "xy")
    raised(Exception, lambda: e.functions.call("upper_of", 5))
    m, names = e.functions.metrics("upper_of"), ",".join(e.functions.list())
    duplicate = raised(DuplicateName, lambda: e.functions.register(_plain("upper_of", str)))
    e.functions.unregister("upper_of")
    return facts(spark, called=called, calls=m.calls, errors=m.errors, duplicate=duplicate, names=names, after=",".join(e.functions.list()))


@query(told(always="3", by_name="1", by_closure="2", failing="0", truths="'true,true,false,false,false,true'"))
def trigger_conditions(spark, folder):  # AUT-03, AUT-06
    e, seen = engine(spark, folder), []
    e.functions.register(_plain("is_two", lambda k: k == 2))
    for name, condition in (("always", None), ("by_name", "is_two"), ("by_closure", lambda event: event.data["k"] > 1), ("failing", lambda event: 1 / 0)):
        e.triggers.register(Trigger(name, EventType.AFTER_INSERT, "w", lambda event, n=name: seen.append(n), condition))
    for k in (1, 2, 3):
        e.triggers.fire(Event(EventType.AFTER_INSERT, "w", {"k": k}))
    truths = ",".join(str(truthy(v)).lower() for v in (1, "x", 0, "", None, True))
    return facts(spark, truths=truths, **{n: seen.count(n) for n in ("always", "by_name", "by_closure", "failing")})


@query(told(once="'2024-02-29 13:00'", over="'None'", interval="'2024-02-29 12:10'", daily="'2024-03-01 06:00'", weekly="'2024-03-04 09:15'", steps="'2024-02-29 12:15'", range_="'2024-03-01 08:00'"))
def schedules(spark, folder):  # SCH-01, SCH-02, SCH-04
    t = datetime(2024, 2, 29, 12, 0, tzinfo=UTC)  # a Thursday
    say = lambda s, at=t: (lambda d: None if d is None else d.strftime("%Y-%m-%d %H:%M"))(s.after(at))
    return facts(
        spark, once=say(Once(t + timedelta(hours=1))), over=say(Once(t), t), interval=say(Interval(timedelta(minutes=10))), daily=say(Daily(6)),
        weekly=say(Weekly(0, 9, 15)), steps=say(Cron("*/15 * * * *")), range_=say(Cron("0 8 1-5 * *")),
    )


@query(told(ran="'a;a,b;'", duplicate="'true'"))
def scheduler_ticks(spark, folder):  # SCH-03
    at = [datetime(2024, 1, 1, tzinfo=UTC)]
    s = Scheduler(engine(spark, folder).functions, lambda: at[0])
    s.register(Job("a", Interval(timedelta(minutes=1)), lambda: None))
    s.register(Job("b", Interval(timedelta(minutes=2)), lambda: None))
    duplicate, ran = raised(DuplicateName, lambda: s.register(Job("a", Daily(1), lambda: None))), []
    for _ in range(2):
        at[0] += timedelta(minutes=1)
        ran.append(",".join(s.tick()))
    s.unregister("a")
    ran.append(",".join(s.tick()))
    return facts(spark, ran=";".join(ran), duplicate=duplicate)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey = 3 THEN 'own' ELSE n_name END AS value FROM nation WHERE n_nationkey <> 4")
def transaction_sql(spark, folder):  # TXN-03
    e = _customers(spark, folder)
    with e.begin() as t:
        t.insert("kv", b"3", b"own")
        t.delete("kv", b"4")
        out = t.sql("SELECT CAST(key AS STRING) AS key, CAST(value AS STRING) AS value FROM kv")
        t.rollback()
    return out


@query(told(rolled_back="'None'", committed="'1,2'", snapshot="'None'"))
def transaction_over_tables(spark, folder):  # TXN-02, rollback
    e = engine(spark, folder)
    t = e.begin()
    t.insert("one", b"k", b"0")
    t.rollback()
    gone, reader = e.get("one", b"k"), e.begin()
    with e.begin() as t:
        t.insert("one", b"k", b"1")
        t.insert("two", b"k", b"2")
    again = Engine.open(e.root, spark)
    return facts(spark, rolled_back=gone, committed=",".join(again.get(n, b"k").decode() for n in ("one", "two")), snapshot=reader.get("one", b"k"))


@query(told(estimate="(SELECT count(*) FROM nation)", dropped="(SELECT count(*) FROM nation)", left_="(SELECT count(*) FROM nation)"))
def gc_estimated(spark, folder):  # TXN-07, TXN-08
    e = _customers(spark, folder)
    e.insert_batch("kv", [(str(r[0]).encode(), b"newer") for r in table(spark, folder, "nation").select("n_nationkey").collect()])
    estimate = e.gc_estimate()
    return facts(spark, estimate=estimate, dropped=e.gc(), left_=e.physical_count("kv"))


@query("SELECT event_id FROM (SELECT event_id, event_id AS begin_ts, CASE WHEN event_id % 3 = 0 THEN event_id + 50 END AS end_ts FROM events) WHERE begin_ts <= 400 AND (end_ts IS NULL OR end_ts > 400)")
def batches_at_ts(spark, folder):  # TXN-10
    ev = table(spark, folder, "events").select("event_id", F.col("event_id").alias("begin_ts"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 50).alias("end_ts"))
    return valid_at(ev, 400).select("event_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation UNION ALL SELECT 'late', 'single'")
def log_replayed(spark, folder):  # SNK-16, PLT-01, PLT-06: an engine that is lost before it flushes
    e = Engine(spark, scratch(spark, "engine"), durability="full")
    e.insert_batch("kv", [(str(r[0]).encode(), r[1].encode()) for r in table(spark, folder, "nation").select("n_nationkey", "n_name").collect()])
    e.insert("kv", b"late", b"single")
    again = Engine.open(e.root, spark)
    return again.scan("kv").select(*[F.col(c).cast("string").alias(c) for c in ("key", "value")])


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey < 5 THEN 'low' ELSE n_name END AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_nationkey <> 9")
def schema_after_changes(spark, folder):  # SV-01, SNK-03, SNK-04: a dropped column outlives UPDATE and DELETE
    e = _nation(spark, folder)
    e.sql("ALTER TABLE n2 DROP COLUMN region")
    e.sql("UPDATE n2 SET name = 'low' WHERE k < 5")
    e.sql("DELETE FROM n2 WHERE k = 9")
    return e._sql_table("n2").df(1)


@query(told(building="'active,building'", done="'disabled,active'", columns="'b'"))
def index_versions(spark, folder):  # SV-02
    v = IndexVersions()
    v.create("i", "t", ["a"])
    v.start_reindex("i", ["b"])
    building = ",".join(x["status"] for x in v.history("i"))
    v.complete_reindex("i", 2)
    return facts(spark, building=building, done=",".join(x["status"] for x in v.history("i")), columns=",".join(v.active("i").columns))


@query(told(names="'one,two'", newest="2", first="1"))
def named_checkpoints(spark, folder):  # SV-03
    files = engine(spark, folder).files
    c = Checkpoints(files)
    c.create("one", {"n": 1})
    c.create("two", {"n": 2})
    again = Checkpoints(files)
    return facts(spark, names=",".join(again.list()), newest=again.rollback_newest()["n"], first=again.rollback("one")["n"])


@query(told(one="(SELECT r_name FROM region WHERE r_regionkey = 1)", none="'true'", several="'true'", optional="'None'", first="(SELECT min(n_name) FROM nation)", scalar="(SELECT count(*) FROM nation)", strict="'true'", decoded="(SELECT r_name FROM region WHERE r_regionkey = 2)"))
def fetches(spark, folder):  # QRY-02, QRY-03, QRY-04, QRY-07
    e = engine(spark, folder, "region", "nation")
    return facts(
        spark, one=e.query_one("SELECT r_name FROM region WHERE r_regionkey = 1", str).fetch(), none=raised(NoRows, e.query_one("SELECT 1 FROM region WHERE r_regionkey < 0").fetch),
        several=raised(TooManyRows, e.query_one("SELECT r_name FROM region").fetch), optional=e.query_optional("SELECT r_name FROM region WHERE r_regionkey < 0").fetch(),
        first=e.query_optional("SELECT n_name FROM nation ORDER BY n_name", str).fetch(), scalar=e.query_scalar("SELECT count(*) FROM nation", int).fetch(),
        strict=raised(TypeMismatch, e.query_scalar("SELECT n_name FROM nation", int).fetch), decoded=e.query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 2", tuple).fetch_all()[0][1],
    )


@query("SELECT n_name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 3")
def prepared_statement(spark, folder):  # QRY-08, QRY-09
    e = engine(spark, folder, "nation")
    sql = "SELECT n_name FROM nation WHERE n_regionkey = ?"
    out = e.prepare(sql).execute([2]).unionAll(e.prepare(sql).execute([3]))
    if e.plans.stats() != {"entries": 1, "hits": 1, "misses": 1}:
        raise EngineError(str(e.plans.stats()))
    return out


@query(told(parsed="2", failed="1", seen="'0,1,2'"))
def parsed_in_batch(spark, folder):  # QRY-10
    seen = []
    out = engine(spark, folder).parse_batch(["SELECT 1", "SELECT (1", "DROP TABLE IF EXISTS x"], partial=True, each=lambda i, _: seen.append(str(i)))
    failed = sum(isinstance(x, Exception) for x in out)
    return facts(spark, parsed=len(out) - failed, failed=failed, seen=",".join(seen))


@query("SELECT event_id, ts FROM events")
def sealed_timestamps(spark, folder):  # SRC-14, SNK-11, PLT-04, PLT-05: microseconds survive, also a change of keys
    first, second = scratch(spark, "sealed"), scratch(spark, "sealed")
    write_encrypted(table(spark, folder, "events").select("event_id", "ts"), first, b"0" * 32, "events")
    rekey(spark, first, second, b"0" * 32, b"1" * 32, "events")
    return read_encrypted(spark, second, b"1" * 32, "events")


@query(told(default="'false'", on="'true'", saved="'true'"))
def feature_switches(spark, folder):  # PLT-07
    import tempfile

    f = Features({"fast": False})
    default = f.enabled("fast")
    f.set("fast", True)
    with tempfile.NamedTemporaryFile(suffix=".json") as held:  # the driver's own file
        f.save(held.name)
        return facts(spark, default=default, on=f.enabled("fast"), saved=Features(file=held.name).enabled("fast"))


@query(told(runs="3", slower="'true'"))
def benchmark_runner(spark, folder):  # PLT-10
    import tempfile
    import time

    b, times = Benchmarks(0.5), []
    b.run("job", lambda: times.append(1) or time.sleep(0.001), 3, 0)
    with tempfile.NamedTemporaryFile(suffix=".json") as held:
        b.save(held.name)
        slow = Benchmarks(0.5)
        slow.run("job", lambda: time.sleep(0.1), 2, 0)
        return facts(spark, runs=len(times), slower="job" in slow.regressions(held.name))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def sharded_counts(spark, folder):  # PLT-11
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    parts = [op.shard(orders, 4, kind="round_robin"), op.shard(orders, 4, ["o_orderkey"], "hash"), op.shard(orders, 4, ["o_orderkey"], "range")]
    all_ = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return all_.groupBy("o_orderstatus").agg((F.count("*") / 3).cast("bigint").alias("n"))


@query(told(closed="'true'", missing="'true'", duplicate="'true'", unknown="'true'"))
def error_kinds(spark, folder):  # PLT-15
    from sluice.errors import ColumnNotFound, TableExists, TableNotFound, TransactionClosed

    e = _nation(spark, folder)
    t = e.begin()
    t.commit()
    return facts(
        spark, closed=raised(TransactionClosed, t.commit), missing=raised(TableNotFound, lambda: e.table("nowhere")), duplicate=raised(TableExists, lambda: e.sql("CREATE TABLE n2 (k INT)")),
        unknown=raised(ColumnNotFound, lambda: e.sql("INSERT INTO n2 (nothing) VALUES (1)")),
    )
