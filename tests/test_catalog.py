import duckdb
import pytest

from tidemark.errors import TidemarkError
from tidemark.plans.catalog import ORACLES, QUERIES, shared_folder

DIR = "/root/testdata/sf0.001"


def canonical(rows):
    def one(v):
        if isinstance(v, list):
            return tuple(map(one, v))
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    want = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = canonical(df.select(*columns).collect())
    assert got == canonical(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})").fetchall())


def test_full_join_is_over_whole_tables(spark):
    rows = QUERIES["j1_outer"](spark, DIR).collect()
    for column, table in (("c_custkey", "customer"), ("s_suppkey", "supplier")):
        whole = spark.read.parquet(f"{DIR}/{table}.parquet").select(column).collect()
        assert sorted(r[column] for r in rows if r[column] is not None) == sorted(r[0] for r in whole)


def test_history_holds_late_events_and_those_without_instant(spark, tmp_path):
    rows = [(1, 1, "2024-01-05 00:00:00"), (2, 1, None), (3, 2, None), (4, 3, "2024-01-25 00:00:00"), (5, 3, "2025-06-01 00:00:00")]
    df = spark.createDataFrame([(e, u, t, "view", 1.0) for e, u, t in rows], "event_id long, user_id long, t string, event_type string, value double")
    df.selectExpr("event_id", "user_id", "CAST(t AS timestamp_ntz) AS ts", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("r8_scan_current", "r8_scan_as_of"):
        want = con.sql(f"SELECT key, event_id FROM ({ORACLES[name]})").fetchall()
        assert canonical(QUERIES[name](spark, str(tmp_path)).select("key", "event_id").collect()) == canonical(want)


def test_compacted_state_of_users_without_late_events(spark, tmp_path):
    """Of two upserts that start at one instant the second has the newer rows."""
    rows = [(1, 1, "2024-01-05"), (2, 1, "2024-01-10"), (3, 2, "2024-01-06"), (4, 3, "2024-01-11"), (5, 3, "2024-01-17")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string").selectExpr("event_id", "user_id", "CAST(t AS timestamp_ntz) AS ts", "'view' AS event_type", "1.0D AS value")
    df.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT key, event_id FROM ({ORACLES['c4_many_files_compacted']})").fetchall()
    assert canonical(QUERIES["c4_many_files_compacted"](spark, str(tmp_path)).select("key", "event_id").collect()) == canonical(want)


def test_large_files_are_folders_of_parts(spark, tmp_path, monkeypatch):
    """No task sorts a whole file; precedence and place within it are the same."""
    from pathlib import Path

    from tidemark import writer
    from tidemark.operators import scan
    from tidemark.plans import catalog

    monkeypatch.setattr(writer, "ROWS_A_FILE", 200, raising=False)
    (tmp_path / "events.parquet").symlink_to(f"{DIR}/events.parquet")
    root = Path(catalog.lakehouse(spark, str(tmp_path)).removeprefix("file:"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    for table, file in (("history", "delta2"), ("layers", "closed")):
        assert len([*(root / table / f"{file}.parquet").glob("*.parquet")]) > 1
    for cases in (scan.CASES, 1):  # by CASE, and by a join with the list
        monkeypatch.setattr(scan, "CASES", cases)
        for name in ("r8_scan_current", "r8_scan_as_of", "r3_before_history", "r5_layers_at_both_ends", "r7_not_the_latest", "q5_own_query", "x3_explain", "r5_file_list"):
            df = QUERIES[name](spark, str(tmp_path))
            columns = ", ".join(df.columns)
            assert canonical(df.collect()) == canonical(con.sql(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()), name


def test_one_sketch_and_not_one_for_each_key(spark, tmp_path):
    spark.sql("select * from values (1L), (1L), (2L), (null) t(l_partkey)").write.parquet(f"{tmp_path}/some/lineitem.parquet")
    spark.sql("select 1L l_partkey where false").write.parquet(f"{tmp_path}/none/lineitem.parquet")
    for name, want in (("some", (4, True)), ("none", (0, True))):
        assert tuple(QUERIES["a3_approximate"](spark, f"{tmp_path}/{name}").select("n", "near").first()) == want
    plan = QUERIES["a3_approximate"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    by_key = [x for x in plan.split("\n") if "Aggregate(key" in x and "keys=[l_partkey" in x]
    assert by_key and not any("approx" in x for x in by_key)


def test_precedence_is_told_from_the_latest(spark):
    """The table ``layers`` has many keys whose winner isn't their latest event."""
    row = QUERIES["r7_not_the_latest"](spark, DIR).first()
    assert row.older > row.n / 2 > 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(TidemarkError):
        shared_folder(Session())
