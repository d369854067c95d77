"""Parsing, schedules, functions, versions, sources, plans."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice import functions as own
from sluice import operators as op
from sluice.automation import Cron, Daily, Interval, Job, Once, Scheduler, Weekly
from sluice.errors import ArgumentError, DuplicateName, EngineError, IndexExists, NotRegistered, VersionNotFound
from sluice.plans import statements as st
from sluice.plans.text import split_commas, with_alias_expanded
from sluice.udf import Aggregate, AggregateUDF, Registry, ScalarUDF, Signature, TableUDF
from sluice.versions import Checkpoints, Features, IndexVersions, SchemaVersions

T = datetime(2024, 1, 31, 10, 30, 15, tzinfo=UTC)  # a Wednesday


@pytest.mark.parametrize(
    ("schedule", "due"),
    [
        (Cron("*/15 * * * *"), datetime(2024, 1, 31, 10, 45, tzinfo=UTC)),
        (Cron("0 0 1 * *"), datetime(2024, 2, 1, tzinfo=UTC)),
        (Cron("5 9-11 * * 4"), datetime(2024, 2, 1, 9, 5, tzinfo=UTC)),
        (Cron("0 0 29 2 *"), datetime(2024, 2, 29, tzinfo=UTC)),
        (Cron("30 10 * * 0,7"), datetime(2024, 2, 4, 10, 30, tzinfo=UTC)),
        (Cron("0 0 31 2 *"), None),
        (Daily(10, 30), datetime(2024, 2, 1, 10, 30, tzinfo=UTC)),
        (Weekly(2, 11), datetime(2024, 1, 31, 11, tzinfo=UTC)),
        (Weekly(2, 10), datetime(2024, 2, 7, 10, tzinfo=UTC)),
        (Interval(timedelta(seconds=5)), T + timedelta(seconds=5)),
        (Once(T), None),
    ],
)
def test_schedules(schedule, due):
    assert schedule.after(T) == due


@pytest.mark.parametrize("spec", ["* * * *", "60 * * * *", "a * * * *", "*/0 * * * *", "5-1 * * * *"])
def test_bad_cron(spec):
    with pytest.raises(EngineError):
        Cron(spec)


def test_scheduler():
    clock, ran, functions = [T], [], Registry()
    s = Scheduler(functions, lambda: clock[0])
    s.register(Job("often", Interval(timedelta(minutes=1)), lambda x: ran.append(x), ("often",)))
    s.register(Job("once", Once(T + timedelta(minutes=2)), lambda: ran.append("once")))
    s.register(Job("bad", Interval(timedelta(minutes=1)), lambda: 1 / 0))
    assert s.tick() == []
    clock[0] += timedelta(minutes=2)
    assert s.tick() == ["often", "once"]
    clock[0] += timedelta(minutes=2)
    assert s.tick() == ["often"] and ran == ["often", "once", "often"]
    with pytest.raises(DuplicateName):
        s.register(Job("often", Once(T), print))
    s.unregister("often")
    assert s.list() == ["bad", "once"]


def test_parse():
    assert st.parse(" insert into T (a, b) values (1, 'x;y'); ") == st.Insert("T", ("a", "b"), "values (1, 'x;y')")
    u = st.parse("UPDATE t SET a = f(1, 2), b = 'where x' WHERE c IN (SELECT d FROM e WHERE f = 1)")
    assert u.assignments == {"a": "f(1, 2)", "b": "'where x'"} and u.where == "c IN (SELECT d FROM e WHERE f = 1)"
    assert st.parse("DELETE FROM t") == st.Delete("t", None)
    assert st.parse("-- note\nSELECT 1") == st.Query("SELECT 1")
    assert st.parse("CREATE TABLE t (a INT, b DECIMAL(10, 2), PRIMARY KEY (a))").columns == (("a", "INT"), ("b", "DECIMAL(10, 2)"))
    assert st.parse("CREATE FUNCTION f(x INT) RETURNS INT LANGUAGE SQL AS 'x || ''q'''").body == "x || 'q'"
    assert st.parse("CREATE TRIGGER g BEFORE DELETE ON t FOR EACH ROW EXECUTE FUNCTION f()") == st.CreateTrigger("g", "before", "delete", "t", True, "f")
    assert st.parse("CREATE JOB j SCHEDULE '0 * * * *' EXECUTE FUNCTION f") == st.CreateJob("j", "0 * * * *", "f")
    assert st.parse("DROP JOB IF EXISTS j") == st.Drop("job", "j", True)


def test_text():
    assert split_commas("a, f(b, c), 'd,e', [1, 2]") == ["a", "f(b, c)", "'d,e'", "[1, 2]"]
    assert with_alias_expanded("SELECT a + 1 AS b FROM t WHERE b > 'b' AND t.b > 0", "b") == "SELECT a + 1 AS b FROM t WHERE (a + 1) > 'b' AND t.b > 0"
    assert with_alias_expanded("SELECT a FROM t WHERE x > 1", "x") is None


def test_registry():
    r = Registry()
    r.register(ScalarUDF("add", Signature(("int", "int"), "int"), lambda a, b: a + b))
    r.register(ScalarUDF("many", Signature(("int",), "int", True), lambda *a: len(a)))
    r.register(TableUDF("series", Signature(("int",), "table"), "i int", lambda n: [(i,) for i in range(n)]))

    class Sum(Aggregate):
        def __init__(self):
            self.s = 0

        def accumulate(self, x):
            self.s += x

        def finalize(self):
            return self.s

    r.register(AggregateUDF("total", Signature(("int",), "int"), Sum))
    assert r.call("add", 1, 2) == 3 and r.call("many", 1, 2, 3) == 3 and r.call("series", 2) == [(0,), (1,)] and r.call("total", [(1,), (2,)]) == 3
    for args in ((1,), (1, "x"), (True, 1)):
        with pytest.raises(ArgumentError):
            r.call("add", *args)
    with pytest.raises(ArgumentError):
        r.call("many")
    with pytest.raises(TypeError):
        r.call("add", None, 1)  # None passes the signature
    m = r.metrics("add")
    assert (m.calls, m.errors, m.success_rate) == (5, 4, 0.2) and m.mean_seconds >= 0
    with pytest.raises(DuplicateName):
        r.register(ScalarUDF("add", Signature(()), print))
    r.unregister("add")
    with pytest.raises(NotRegistered):
        r.call("add", 1, 2)


def test_histories(tmp_path):
    from pyspark.sql.types import LongType, StringType, StructType

    v = SchemaVersions()
    one, two = StructType().add("id", LongType()), StructType().add("id", LongType()).add("email", StringType())
    v.register("t", one)
    assert v.alter("t", two, "email") == 2 and v.current("t") == two and v.at("t", 1) == one
    v.rollback("t", 1)
    assert v.current_version("t") == 1 and [h.description for h in v.history("t")] == ["registered", "email"]
    with pytest.raises(VersionNotFound):
        v.at("t", 9)
    i = IndexVersions()
    i.create("a", "t", ["x"])
    assert i.start_reindex("a", ["x", "y"], "btree") == 2 and i.active("a").version == 1
    i.complete_reindex("a", 2)
    assert i.active("a").columns == ["x", "y"] and [h["status"] for h in i.history("a")] == ["disabled", "active"] and i.list("t") == ["a"]
    with pytest.raises(IndexExists):
        i.create("a", "t", [])
    c = Checkpoints()
    c.create("one", {"a": 1})
    c.create("two", {"a": 2})
    assert c.rollback("one") == {"a": 1} and c.rollback_newest() == {"a": 2}
    f = Features({"x": True}, str(tmp_path / "f.json"))
    f.set("y", True)
    f.save(str(tmp_path / "f.json"))
    assert Features(file=str(tmp_path / "f.json")).all() == {"x": True, "y": True} and not f.enabled("z")


def test_functions(spark):
    df = spark.createDataFrame([(" \t é　", 7, -2), (None, -7, 2)], "s string, a int, b int")
    got = df.select(own.trim_space("s"), own.byte_length("s"), own.concat_skip_null("s", F.lit("x")), own.int_div("a", "b")).collect()
    assert [tuple(r) for r in got] == [("é", 8, " \t é　x", -3), (None, None, "x", -3)]


def test_sql_functions(engine):
    assert tuple(engine.sql("SELECT byte_length('é'), concat_skip_null('a', NULL), trim_space(' 　b '), int_div(-7, 2), epoch_now() > 0").first()) == (2, "a", "b", -3, True)


def test_operators(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (3, 1)], "id int, a int")
    assert [r["id"] for r in op.sort(df, [("a", True)]).collect()] == [2, 3, 1]
    assert [r["id"] for r in op.sort(df, [("a", False, False)]).collect()] == [1, 3, 2]
    assert op.filter_mask(df, "a", 1).orderBy("id").select("mask").collect() == [(True,), (False,), (False,)]
    assert op.select_where(df, {"id": "id + 100", "b": "a * 2"}, "b > 1 AND id < 3").collect() == [(101, 4)]
    assert op.global_aggregate(df.where("1 = 0"), {"n": "count(*)", "s": "sum(a)"}).collect() == [(0, None)]
    assert op.limit_offset(df.orderBy("id"), None, 2).collect() == [(3, 1)]


def test_plans_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 7 AS k", "repeat('x', 50) AS pad").write.parquet(path)
    plan = op.hash_aggregate(spark.read.parquet(path).where("id > 10"), ["k"], {"n": "count(*)"})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,10)" in plan and "pad" not in plan


def test_broadcast_is_checked(spark, tmp_path):
    big, small = spark.range(10_000).withColumn("v", F.repeat(F.lit("x"), 100)), spark.range(10)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(op.adaptive_join(big, small, ["id"])) and not hinted(op.adaptive_join(small, big, ["id"], limit_bytes=1000))


def test_sources(spark, tmp_path):
    from sluice.sources import ipc_bytes, ipc_frame, load_cache, persist_cache, read_encrypted, rekey, write_encrypted, write_parquet

    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "id int, s string, d double")
    for codec in ("none", "snappy", "lz4", "zstd", "brotli"):
        write_parquet(df, f"{tmp_path}/{codec}", codec)
        assert spark.read.parquet(f"{tmp_path}/{codec}").count() == 2
    with pytest.raises(EngineError):
        write_parquet(df, f"{tmp_path}/x", "odd")
    assert sorted(ipc_frame(spark, ipc_bytes(df)).collect()) == sorted(df.collect())
    write_encrypted(df, f"{tmp_path}/sealed", b"k" * 32, "ctx")
    rekey(spark, f"{tmp_path}/sealed", f"{tmp_path}/again", b"k" * 32, b"n" * 32, "ctx")
    assert sorted(read_encrypted(spark, f"{tmp_path}/again", b"n" * 32, "ctx").collect()) == sorted(df.collect())
    with pytest.raises(Exception):
        read_encrypted(spark, f"{tmp_path}/again", b"k" * 32, "ctx").collect()
    with pytest.raises(EngineError):
        write_encrypted(df, f"{tmp_path}/y", b"short")
    persist_cache(df, f"{tmp_path}/cache")
    assert load_cache(spark, f"{tmp_path}/cache").count() == 2


def test_sharding_and_salting(spark):
    df = spark.range(1000).selectExpr("id", "if(id < 700, 0, id) AS k")
    assert op.shard(df, 5).rdd.getNumPartitions() == op.shard(df, 5, ["k"], "hash").rdd.getNumPartitions() == 5
    assert op.shard(df, 4, ["id"], "range").rdd.getNumPartitions() <= 4
    right = spark.range(0, 900, 3).selectExpr("id AS k", "id * 2 AS v")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(op.salted_join(df, right, ["k"], 8, how).collect(), key=str) == sorted(df.join(right, ["k"], how).collect(), key=str)
    with pytest.raises(ValueError):
        op.salted_join(df, right, ["k"], 8, "right")


def test_bloom_filter_is_written(spark, tmp_path):
    from sluice.sources import write_parquet

    write_parquet(spark.range(1000).selectExpr("cast(id * 7 AS string) AS s"), f"{tmp_path}/b", bloom=("s",))
    assert spark.read.parquet(f"{tmp_path}/b").where("s = '21'").count() == 1


def test_benchmarks(tmp_path):
    from sluice.benchmark import Benchmarks, Timing

    b = Benchmarks()
    assert b.run("nothing", lambda: None, 3).runs == 3
    b.timings = {"a": Timing("a", 1, 1, 1.0, 1), "b": Timing("b", 1, 1, 1.0, 1)}
    b.save(str(tmp_path / "x.json"))
    b.timings = {"a": Timing("a", 1, 1, 1.3, 1), "b": Timing("b", 1, 1, 1.1, 1)}
    assert list(b.regressions(str(tmp_path / "x.json"))) == ["a"]
