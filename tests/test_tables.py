import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.asof import parse_instant
from tidemark.cli import main
from tidemark.errors import MetadataError, SchemaError, TimeError, VersionClauseError
from tidemark.lakehouse import Lakehouse
from tidemark.metadata import Snapshot
from tidemark.schema import ColumnDef, TableSchema
from tidemark.sql import Context, rewrite
from tidemark.writer import compact, create, csv_rows, generate, latest_first, upsert, write_file


def at(day):
    return datetime.fromisoformat(day).replace(tzinfo=UTC)


def snapshot(segments, columns=()):
    return Snapshot.from_json(json.dumps({"schema": {"columns": [{"name": n, "data_type": t, "nullable": False} for n, t in columns]}, "segments": segments}))


def seg(id_, start, end=None, **more):
    return {"id": str(id_), "start": f"{start}T00:00:00.000Z", **({"end": f"{end}T00:00:00.000Z"} if end else {}), **more}


def delta(name, start, end="2099-01-01"):
    return {"file": name, "start": f"{start}T00:00:00Z", "end": f"{end}T00:00:00Z"}


def nested(open_ended):
    end = (lambda x: None) if open_ended else (lambda x: x)
    inner = [seg(121, "2018-03-01", "2018-06-01", file="base121"), seg(122, "2018-07-01", end("2019-01-01"), file="base122")]
    return snapshot([seg(10, "2010-01-01", end("2020-01-01"), file="base10", segments=[seg(11, "2013-01-01", "2016-01-01", file="base11"), seg(12, "2018-01-01", end("2019-01-01"), file="base12", segments=inner)])])


@pytest.mark.parametrize(("open_ended", "day", "want"), [(False, "2018-04-01", ["base121", "base12", "base10"]), (False, "2011-04-01", ["base10"]), (False, "2017-04-01", ["base10"]), (False, "2022-04-01", []), (False, None, []), (True, "2018-04-01", ["base121", "base12", "base10"]), (True, "2022-04-01", ["base122", "base12", "base10"]), (True, None, ["base122", "base12", "base10"])])
def test_nested_files(open_ended, day, want):
    assert nested(open_ended).data_files(day and at(day)) == want


def test_delta_order():
    s = snapshot([seg(10, "2024-01-01", file="base10", delta=[delta("d100", "2024-02-01"), delta("d101", "2024-10-01"), delta("d102", "2024-07-01")], segments=[seg(211, "2024-11-01", file="base211")])])
    assert s.data_files(None) == ["base211", "d101", "d102", "d100", "base10"]
    assert s.data_files(at("2024-08-01")) == s.data_files(at("2024-07-01")) == ["d102", "d100", "base10"]
    assert s.data_files(at("2024-06-01")) == ["d100", "base10"]
    ties = snapshot([seg(1, "2024-01-01", delta=[delta("a", "2024-02-01"), delta("b", "2024-02-01")])])
    assert ties.data_files(None) == ["a", "b"]
    closed = snapshot([seg(1, "2024-01-01", "2024-06-01", file="old", delta=[delta("d", "2024-02-01")]), seg(2, "2024-06-01", file="new")])
    assert closed.data_files(None) == ["d", "new"]
    assert closed.data_files(at("2024-06-01")) == ["d", "old", "new"]


def test_metadata_text():
    s = nested(True)
    assert Snapshot.from_json(s.to_json()) == s
    for bad in ("{", '{"segments": []}', '{"schema": {"columns": []}, "segments": [{"id": "1"}]}'):
        with pytest.raises((MetadataError, SchemaError)):
            Snapshot.from_json(bad)
    with pytest.raises(SchemaError):
        snapshot([], [("a", "Float")])
    assert snapshot([seg(1, "2024-02-01", "2024-01-01")], [("key", "Int"), ("x", "Int"), ("x", "Int")]).validate()
    assert parse_instant("2024-01-01T02:00:00.5+02:00") == datetime(2024, 1, 1, 0, 0, 0, 500000, UTC)
    for bad in ("2024-01-01T00:00:00", "2024-13-01T00:00:00Z", "not_a_date"):
        with pytest.raises(TimeError):
            parse_instant(bad)


def day(d):
    return f"2024-{d}T00:00:00.000Z"


TYPED = [("value1", "String"), ("value2", "Int"), ("is_active", "Boolean"), ("created", "DateTime")]
TABLES = {
    "t0": ([("value", "String")], [seg(10, "2024-01-01", file="base.parquet", delta=[delta("delta1.parquet", "2024-02-01", "2024-04-01")])], {"base": [("1", day("01-01"), "abc"), ("2", day("01-01"), "xyz")], "delta1": [("3", day("03-10"), "www2"), ("2", day("02-20"), "xyz2"), ("1", day("02-01"), "abc2")]}),
    "t1": ([("value", "String")], [seg(10, "2024-01-01", delta=[delta("delta1.parquet", "2024-02-01", "2024-04-01"), delta("delta2.parquet", "2024-05-01", "2024-07-01")])], {"delta1": [("2", day("02-20"), "xyz2"), ("2", day("02-15"), "xyz1"), ("1", day("02-01"), "abc2")], "delta2": [("1", day("06-29"), "abc4"), ("2", day("06-20"), "xyz3"), ("1", day("06-01"), "abc3"), ("2", day("06-01"), "xyz2")]}),
    "t2": (TYPED, [seg(10, "2024-01-01", file="base.parquet", delta=[delta("delta1.parquet", "2024-02-01", "2024-04-01")])], {"base": [("1", day("01-01"), "abc", "100", "true", day("01-01")), ("2", day("01-01"), "xyz", "200", "false", day("01-01"))], "delta1": [("3", day("03-10"), "www2", "300", "false", day("03-01")), ("2", day("02-20"), "xyz2", "222", "false", day("01-01")), ("1", day("02-01"), "abc2", "100", "true", day("01-01"))]}),
    # the later-starting delta wins although its row is older; within a file the first row does
    "t3": ([("value", "String")], [seg(10, "2024-01-01", delta=[delta("a.parquet", "2024-02-01"), delta("b.parquet", "2024-03-01")])], {"a": [("1", day("06-01"), "newer"), ("2", "2999-01-01T00:00:00Z", "future")], "b": [("1", day("03-02"), "older"), ("3", day("03-03"), "first"), ("3", day("05-01"), "second")]}),
}


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    lake = Lakehouse(spark, str(root))
    for name, (columns, segments, files) in TABLES.items():
        (root / name).mkdir()
        (root / name / "version.txt").write_text("1\n")
        (root / name / "s1.json").write_text(snapshot(segments, columns).to_json())
        for file, rows in files.items():
            (root / name / f"{file}.csv").write_text("\n".join(map(",".join, rows)) + "\n\n")
            generate(lake, name, str(root / name / f"{file}.csv"), f"{file}.parquet")
    return lake


def values(df):
    return sorted((r[0], *r[2:]) for r in df.collect())


def test_golden_scans(lake):
    assert values(lake.scan("t0")) == [("1", "abc2"), ("2", "xyz2"), ("3", "www2")]
    assert values(lake.scan("t0", "2024-02-17T00:00:00Z")) == [("1", "abc2"), ("2", "xyz")]
    assert values(lake.scan("t1")) == [("1", "abc4"), ("2", "xyz3")]
    assert values(lake.scan("t1", "2024-06-01T00:00:00Z")) == [("1", "abc3"), ("2", "xyz2")]
    assert values(lake.scan("t1", "2024-02-01T00:00:00Z")) == [("1", "abc2")]
    assert values(lake.scan("t3")) == [("1", "older"), ("2", "future"), ("3", "first")]
    assert values(lake.scan("t3", "2024-04-01T00:00:00Z")) == [("1", "older"), ("3", "first")]
    assert lake.scan("t0", "2000-01-01T00:00:00Z").count() == 0
    assert [(r.key, r.value1, r.value2, r.is_active, int(r.created.timestamp())) for r in lake.scan("t2").orderBy("key").collect()] == [("1", "abc2", 100, True, 1704067200), ("2", "xyz2", 222, False, 1704067200), ("3", "www2", 300, False, 1709251200)]


def test_projections(lake):
    assert lake.scan("t2", columns={"value1", "event_time", "key"}).columns == ["key", "event_time", "value1"]
    assert [r[0] for r in lake.scan("t2", columns=["value1"]).orderBy("value1").collect()] == ["abc2", "www2", "xyz2"]
    assert lake.scan("t2", columns=[]).count() == 3
    with pytest.raises(SchemaError):
        lake.scan("t2", columns=["nope"])
    assert lake.scan("t2", columns=["nope", "key"], strict=False).columns == ["key"]
    plan = lake.scan("t2", "2024-02-17T00:00:00Z", ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "value1" not in plan and "PushedFilters: [IsNotNull(event_time), LessThanOrEqual(event_time" in plan and "WindowGroupLimit" in plan


def test_sql(lake, spark):
    sql = Context(spark, lake.store.root).sql
    assert values(sql("select * from t0 AT('2024-02-17T00:00:00Z') order by key desc limit 5")) == [("1", "abc2"), ("2", "xyz")]
    assert sql("select count(*) from t0 at(timestamp => '2024-02-17T00:00:00Z')").first()[0] == 2
    both = sql("select a.key, a.value, t0.value from t0 join t0 for system_time as of '2024-02-17T00:00:00Z' a on a.key = t0.key where t0.value <> a.value -- AT('x')\n")
    assert [tuple(r) for r in both.collect()] == [("2", "xyz", "xyz2")]
    assert sql("with x as (select key from t1), y as (select 1) select (select max(value) from t1 at('2024-02-01T00:00:00Z')) m, 'from t0 AT(1)' s from x, y, t0 AS z where exists (select 1 from t2 q where q.key = x.key) and z.key = x.key").count() == 2
    assert sql("select * from t0 where value = 'xyz'").count() == 0  # no stale row comes back
    assert sql("select extract(year from event_time) y from t0 where value is distinct from key").count() == 3
    assert sql("select at.key from t0 at where at.key = '1'").count() == 1
    for bad in ("select * from t0 at(current_timestamp())", "select * from t0 before('2024-02-17T00:00:00Z')", "select * from t0 for system_time as of current_timestamp"):
        with pytest.raises(VersionClauseError):
            sql(bad)
    for bad in ("select * from t0 at('not_a_date')", "select * from t0 for system_time as of '2024-02-17'"):
        with pytest.raises(TimeError):
            sql(bad)


@pytest.mark.parametrize("clause", ["FOR SYSTEM_TIME AS OF '2019-01-17T00:00:00.000Z'", "AT('2019-01-17T00:00:00.000Z')", "AT(TIMESTAMP => '2019-01-17T00:00:00.000Z')"])
def test_rewrite(clause):
    text, refs = rewrite(f"SELECT * FROM tbl {clause} WHERE a = 1", lambda n: n == "tbl")
    assert text == "SELECT * FROM `tbl__1547683200000` AS `tbl` WHERE a = 1" and refs[0].view == "tbl__1547683200000"


def test_versions_nulls_and_columns(lake, spark):
    schema = TableSchema((ColumnDef("value", "String", True), ColumnDef("n", "Double", True)))
    create(lake, "own", schema, at("2024-01-01"), spark.sql("select '1' key, timestamp'2024-01-01 00:00:00Z' event_time, cast(null as string) value, 1.5D n"))
    assert upsert(lake, "own", spark.sql("select 2.5D n, 'x' value, timestamp'2024-03-01 00:00:00Z' event_time, '1' key"), at("2024-03-01"), at("2024-03-01")) == "2"
    assert values(lake.scan("own")) == [("1", "x", 2.5)]
    assert values(lake.scan("own", version="1")) == values(lake.scan("own", at("2024-02-01"))) == [("1", None, 1.5)]
    history = {d: values(lake.scan("own", at(d))) for d in ("2024-01-15", "2024-02-15", "2024-03-15")}
    assert compact(lake, "own", at("2024-02-01")) == "3"
    assert {d: values(lake.scan("own", at(d))) for d in history} == history and values(lake.scan("own")) == [("1", "x", 2.5)]
    assert "own" in lake.tables()


def test_against_plain_reading(lake, spark):
    r = random.Random(4)
    files = {}
    segments = []
    for s in range(3):
        deltas = []
        for d in range(3):
            start = f"2024-{r.randint(1, 9):02d}-{r.randint(1, 28):02d}"
            deltas.append(delta(f"f{s}{d}.parquet", start))
            files[f"f{s}{d}.parquet"] = [(str(r.randint(1, 12)), day(f"{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"), f"{s}{d}{k}") for k in range(12)]
        segments.append(seg(s, "2024-01-01", r.choice([None, "2024-07-01"]), delta=deltas))
    s = snapshot(segments, [("value", "String")])
    (root := __import__("pathlib").Path(lake.store.root) / "rnd").mkdir()
    (root / "version.txt").write_text("1")
    (root / "s1.json").write_text(s.to_json())
    for name, rows in files.items():
        (root / "x.csv").write_text("\n".join(map(",".join, rows)))
        write_file(lake, "rnd", csv_rows(spark, str(root / "x.csv"), s.schema), s.schema, name)
    for instant in (None, at("2024-03-01"), at("2024-07-01"), at("2024-11-11")):
        want = {}
        for f in s.data_files(instant):
            for key, when, value in files[f]:
                if instant is None or parse_instant(when) <= instant:
                    want.setdefault(key, value)
        assert values(lake.scan("rnd", instant)) == sorted(want.items())


def test_cli(lake, spark, capsys):
    assert main(["scan", "--path", lake.store.root, "--table", "t0", "--as-of", "2024-02-17T00:00:00"], spark) == 0
    assert "xyz" in capsys.readouterr().out
    with pytest.raises(TimeError):
        main(["scan", "--path", lake.store.root, "--table", "t0", "--as-of", "2024-02-17"], spark)


def test_stream(lake, spark, tmp_path):
    from tidemark.streaming.ingest import ingest

    schema = TableSchema((ColumnDef("value", "String"),))
    create(lake, "live", schema, at("2024-01-01"))
    (tmp_path / "in").mkdir()
    rows = spark.sql("select key, event_time, value from values ('1', timestamp'2024-01-02 00:00:00Z', 'a'), ('1', timestamp'2024-01-03 00:00:00Z', 'b'), ('1', timestamp'2024-01-03 00:00:00Z', 'b') t(key, event_time, value)")
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest(lake, "live", source, str(tmp_path / "cp")).awaitTermination(60)
    assert values(lake.scan("live")) == [("1", "b")]
    assert latest_first(lake.scan("live")).count() == 1


def test_names_of_with_clauses(lake, spark):
    """A WITH clause hides a table of its name, where it is in force and nowhere else."""
    sql = Context(spark, lake.store.root).sql
    n = sql("select count(*) from t0").first()[0]
    assert n == 3
    assert sql("with t0 as (select 1 as x) select count(*) from t0").first()[0] == 1
    assert sql("WITH T0 AS (select * from t0 where key < '3') SELECT count(*) FROM t0").first()[0] == 2  # its own query reads the table
    assert sql("with a as (select * from t0), t0 as (select * from a limit 1) select (select count(*) from t0) + (select count(*) from a)").first()[0] == n + 1
    assert sql("select (select count(*) from (with t0 as (select 1) select * from t0)) + (select count(*) from t0)").first()[0] == n + 1
    assert sql("with x as (with t0 as (select 1) select * from t0) select (select count(*) from x) + count(*) from t0").first()[0] == n + 1
    assert sql("with t0 as (select 1) select * from t0 where exists (select 1 from t0 q)").count() == 1
    assert sql("with recursive t0(k) as (select 1 union all select k + 1 from t0 where k < 4) select count(*) from t0").first()[0] == 4
    assert sql("with `t0` (x, y) as (select 1, 2), z as (select 1) select x + y from t0, z").first()[0] == 3
    assert sql("with t0 as (select 1) select count(*) from t1, t0").first()[0] == 2
    with pytest.raises(VersionClauseError):
        sql("with t0 as (select 1) select * from t0 at('2024-02-17T00:00:00Z')")


def test_table_statement_files_and_foreign_views(lake, spark):
    context = Context(spark, lake.store.root)
    assert context.sql("table t0 at('2024-02-17T00:00:00Z')").count() == 2
    assert context.sql("table t1 union all table t1").count() == 4
    shown = {(r.table_name, r.as_of, r.rank, r.file, r.pruned) for r in context.files("select * from t0 at('2024-01-17T00:00:00Z') join t1 using (key)").collect()}
    assert shown == {("t0", "2024-01-17T00:00:00.000Z", 0, "base.parquet", False), ("t0", "2024-01-17T00:00:00.000Z", None, "delta1.parquet", True), ("t1", None, 0, "delta2.parquet", False), ("t1", None, 1, "delta1.parquet", False)}
    spark.range(1).createOrReplaceTempView("t3__current")
    with pytest.raises(VersionClauseError):
        context.sql("select * from t3")
    spark.catalog.dropTempView("t3__current")
    assert context.sql("select * from t3").count() == 3 and context.sql("explain select * from t3").count() == 1


def test_many_files(lake, spark):
    """Base and deltas in many files of different keys, read with a broadcast list, against a plain reading."""
    schema = TableSchema((ColumnDef("value", "String"),))
    rows = spark.range(400).selectExpr("cast(id % 150 as string) key", "timestamp'2024-01-01 00:00:00Z' + make_interval(0, 0, 0, int(id)) event_time", "cast(id as string) value")
    create(lake, "wide", schema, at("2024-01-01"), rows.filter("event_time <= '2024-02-01'").groupBy("key").agg({"event_time": "max", "value": "max"}).selectExpr("key", "`max(event_time)` event_time", "`max(value)` value"), files=5)
    for month in range(2, 12):
        a, b = at(f"2024-{month:02d}-01"), at(f"2024-{month + 1:02d}-01")
        upsert(lake, "wide", rows.filter(f"event_time > '2024-{month:02d}-01' and event_time <= '2024-{month + 1:02d}-01'"), a, b, files=4)
    assert len(lake.files("wide")) > 40
    state = {d: values(lake.scan("wide", at(d))) for d in ("2024-01-20", "2024-05-05", "2024-12-01")}
    for d, got in state.items():
        newest = rows.filter(f"event_time <= '{d}'").groupBy("key").agg({"event_time": "max"})
        assert [k for k, _ in got] == sorted(r.key for r in newest.collect()) if d > "2024-02" else got
    plan = lake.scan("wide")._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    version = compact(lake, "wide", at("2024-06-01"), files=6)
    assert {d: values(lake.scan("wide", at(d))) for d in state} == state
    assert sum(f.startswith("base-") for f in lake.files("wide")) == 6 and lake.table("wide").version() == version
    upsert(lake, "wide", spark.sql("select '7' key, timestamp'2024-12-05 00:00:00Z' event_time, 'last' value"), at("2024-12-05"), at("2024-12-05"))
    assert dict(values(lake.scan("wide")))["7"] == "last" and dict(values(lake.scan("wide")))["8"] == dict(state["2024-12-01"])["8"]


def test_upserts_that_start_at_one_instant(lake, spark):
    """The last one wins, before and after a compaction, also where a later start ends before it."""
    schema = TableSchema((ColumnDef("value", "String"),))
    row = lambda key, when, value: spark.sql(f"select '{key}' key, timestamp'{when} 00:00:00Z' event_time, '{value}' value")
    create(lake, "again", schema, at("2024-01-01"))
    upsert(lake, "again", row("1", "2024-01-01", "first").union(row("2", "2024-01-01", "only")), at("2024-01-01"), at("2024-01-01"), files=2)
    upsert(lake, "again", row("1", "2024-01-09", "second"), at("2024-01-01"), at("2024-01-09"))
    assert values(lake.scan("again")) == [("1", "second"), ("2", "only")]
    upsert(lake, "again", row("1", "2024-01-08", "reaches").union(row("2", "2024-02-20", "reaches")), at("2024-01-05"), at("2024-03-01"))
    upsert(lake, "again", row("1", "2024-01-07", "later start"), at("2024-01-06"), at("2024-01-07"))
    state = {d: values(lake.scan("again", at(d))) for d in ("2024-01-02", "2024-01-20", "2024-02-25")}
    assert state == {"2024-01-02": [("1", "first"), ("2", "only")], "2024-01-20": [("1", "later start"), ("2", "only")], "2024-02-25": [("1", "later start"), ("2", "reaches")]}
    compact(lake, "again", at("2024-01-15"), files=2)
    assert {d: values(lake.scan("again", at(d))) for d in state} == state


def test_folder_of_csv_files(lake, spark):
    """Each file becomes a part of its own, with its rows in their order, by as many tasks; settings are as before."""
    import pathlib

    root = pathlib.Path(lake.store.root) / "parted"
    (root / "x.csv").mkdir(parents=True)
    (root / "version.txt").write_text("1")
    (root / "s1.json").write_text(snapshot([seg(1, "2024-01-01", file="x.parquet")], [("value", "String")]).to_json())
    for k in range(20):
        (root / "x.csv" / f"{k}.csv").write_text("\n".join(f"{k},{day(f'02-{d:02d}')},{k}-{d}" for d in (5, 9, 1) for _ in range(k + 1)))
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    assert main(["gen", "--path", lake.store.root, "--table", "parted", "--file", str(root / "x.csv")], spark) == 0
    assert spark.conf.get(name) == old and len([*(root / "x.parquet").glob("*.parquet")]) == 20
    assert values(lake.scan("parted")) == sorted((str(k), f"{k}-5") for k in range(20))


def test_equal_names_in_different_folders(lake, spark):
    import pathlib

    root = pathlib.Path(lake.store.root) / "deep"
    (root / "a" / "b").mkdir(parents=True)
    s = snapshot([seg(1, "2024-01-01", file="f.parquet", delta=[delta("b/f.parquet", "2024-02-01"), delta("a/b/f.parquet", "2024-03-01")])], [("value", "String")])
    (root / "version.txt").write_text("1")
    (root / "s1.json").write_text(s.to_json())
    for k, name in enumerate(("f.parquet", "b/f.parquet", "a/b/f.parquet")):
        rows = spark.createDataFrame([(str(i), f"{k}") for i in range(k, 3)][: 4 - k], "key string, value string").selectExpr("key", "timestamp'2024-01-02 00:00:00Z' event_time", "value")
        write_file(lake, "deep", rows, s.schema, "x.parquet")
        (root / name).parent.mkdir(exist_ok=True)
        (root / "x.parquet").rename(root / name)
        (root / ".x.parquet.crc").unlink(missing_ok=True)
    assert values(lake.scan("deep")) == [("0", "0"), ("1", "1"), ("2", "2")]


def test_writers_beside_each_other(lake, spark, monkeypatch):
    from tidemark import writer
    from tidemark.errors import ConflictError

    schema = TableSchema((ColumnDef("value", "String"),))
    row = lambda k: spark.sql(f"select '{k}' key, timestamp'2024-03-01 00:00:00Z' event_time, 'v{k}' value")
    create(lake, "both", schema, at("2024-01-01"))
    with pytest.raises(ConflictError):
        create(lake, "both", schema, at("2024-01-01"))
    real, calls = writer.publish, []

    def raced(lake_, table, snap, version):
        """Another writer publishes the same version just before."""
        calls.append(version)
        if len(calls) == 1:
            write_file(lake_, table, row("other"), schema, "other.parquet")
            s = lake_.table(table).snapshot()
            first = s.segments[0]
            from tidemark.metadata import Delta, Segment

            # and is lost before it points to it
            lake_.store.put_text(Snapshot(s.schema, (Segment(first.id, first.start, None, None, (), (Delta("other.parquet", at("2024-03-01"), at("2024-03-01")),)),)).to_json(), table, f"s{version}.json")
        real(lake_, table, snap, version)

    monkeypatch.setattr(writer, "publish", raced)
    assert upsert(lake, "both", row("mine"), at("2024-03-01"), at("2024-03-01"), stem="mine") == "3" and calls == ["2", "3"]
    assert values(lake.scan("both")) == [("mine", "vmine"), ("other", "vother")]
    assert upsert(lake, "both", row("mine"), at("2024-03-01"), at("2024-03-01"), stem="mine") == "3"  # it is there already
    assert [writer.following(v) for v in ("9", "v9", "abc")] == ["10", "v10", "abc1"]


def test_streams_into_one_table_and_after_a_crash(lake, spark, tmp_path, monkeypatch):
    from tidemark.streaming import ingest as module

    schema = TableSchema((ColumnDef("value", "String"),))
    create(lake, "two", schema, at("2024-01-01"))
    columns = spark.sql("select '' key, timestamp'2024-01-02 00:00:00Z' event_time, '' value").schema

    def stream(name):
        return spark.readStream.schema(columns).parquet(str(tmp_path / name))

    def put(name, key, value):
        spark.sql(f"select '{key}' key, timestamp'2024-01-02 00:00:00Z' event_time, '{value}' value").write.mode("append").parquet(str(tmp_path / name))

    put("a", "1", "a")
    put("b", "2", "b")
    for name in ("a", "b"):
        module.ingest(lake, "two", stream(name), str(tmp_path / f"cp_{name}")).awaitTermination(60)
    assert values(lake.scan("two")) == [("1", "a"), ("2", "b")]
    # a crash after the batch was published and marked, before the stream committed it
    real = lake.store.write_text
    put("a", "3", "c")

    def crash(text, *names):
        real(text, *names)
        if names[-1].startswith("_batch_"):
            raise RuntimeError("lost")

    monkeypatch.setattr(lake.store, "write_text", crash)
    with pytest.raises(Exception):  # noqa: B017
        module.ingest(lake, "two", stream("a"), str(tmp_path / "cp_a")).awaitTermination(60)
    monkeypatch.undo()
    version = lake.table("two").version()
    put("a", "4", "d")
    module.ingest(lake, "two", stream("a"), str(tmp_path / "cp_a")).awaitTermination(60)
    assert values(lake.scan("two")) == [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")]
    assert int(lake.table("two").version()) == int(version) + 1


def test_functions(spark):
    from tidemark import functions as f

    row = spark.range(1).select(
        f.lcm(F.lit(9007199254740993), F.lit(1)), f.lcm(F.lit(6_000_000_000), F.lit(9_000_000_000)), f.lcm(F.lit(0), F.lit(5)), f.lcm(F.lit(-4), F.lit(6)), f.gcd(F.lit(12), F.lit(-18)), f.gcd(F.lit(0), F.lit(0)),
        f.iszero(F.lit(0.0)), f.trunc(F.lit(-3.789), 1), f.trunc(F.lit(3.789)), f.split_part_or_empty(F.lit("a-b"), "-", 3), f.concat_skipping_nulls(F.lit("a"), F.lit(None).cast("string"), F.lit("b")),
        f.regexp_replace_first(F.lit("xa1 b2\n"), "([a-z])([0-9])", "$1"), f.regexp_replace_first(F.lit("abc"), "z", "y"), f.regexp_replace_first(F.lit("a\nb"), "b", ""),
    ).first()
    assert tuple(row) == (9007199254740993, 18_000_000_000, 0, 12, 6, 0, True, pytest.approx(-3.7), 3.0, "", "ab", "x$1 b2\n", "abc", "a\n")


def test_random_rows(spark):
    from tidemark.writer import random_rows

    rows = random_rows(spark, 200, at("2024-01-01"), at("2024-02-01"), 20).collect()
    assert 0 < len(rows) <= 200 and len({(r.key, r.event_time) for r in rows}) == len(rows) and len({r.key for r in rows}) <= 20
    assert rows == sorted(rows, key=lambda r: (-r.event_time.timestamp(), r.key))
