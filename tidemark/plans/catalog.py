"""Queries over event-time tables and the relational surface, with SQL for comparison.

A table of the format is made once for each input folder and session, in the
checkpoint folder, from ``events``: key is the user, event_time the instant.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.asof import format_instant
from tidemark.errors import TidemarkError
from tidemark.functions import concat_skipping_nulls, date_bin, gcd, iszero, lcm, regexp_replace_first, split_part_or_empty, trunc
from tidemark.lakehouse import Lakehouse
from tidemark.metadata import Delta, Segment, Snapshot
from tidemark.operators.scan import ROW, merge_ordered
from tidemark.schema import ColumnDef, TableSchema
from tidemark.sql import Context
from tidemark.writer import compact, create, files_for, latest, publish, random_rows, upsert, write_parts

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
T0, T1, T2 = (datetime(2024, 1, d, tzinfo=UTC) for d in (8, 15, 22))
SCHEMA = TableSchema((ColumnDef("event_type", "String"), ColumnDef("value", "Double"), ColumnDef("event_id", "Int")))
#: Files of the table ``layers``, whose rows overlap and aren't in the order of time: which events, in which order.
LAYERS = {
    "base": ("event_time <= TIMESTAMP '2024-01-15 00:00:00'", "event_id"),
    "early": ("event_time > TIMESTAMP '2024-01-08 00:00:00' AND event_id % 2 = 0", "-event_id"),
    "late": ("event_time <= TIMESTAMP '2024-01-22 00:00:00' AND event_id % 3 = 0", "event_id"),
    "child": ("event_id % 5 = 0", "event_id"),
    "closed": ("event_id % 7 <> 0", "-event_id"),
}
_made: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; one of this machine only where all of Spark runs on it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise TidemarkError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    # milliseconds are the format's unit
    at = F.timestamp_millis(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))
    return rows.select(F.col("user_id").cast("string").alias("key"), at.alias("event_time"), "event_type", "value", "event_id")


def lakehouse(spark: SparkSession, sf_dir: str) -> str:
    """Root of a lakehouse whose table ``history`` holds the events: a base at T0 and a delta for each week.

    A large file is a folder of parts.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    made = (spark.sparkContext.applicationId, sf_dir)
    if made not in _made:
        root = f"{shared_folder(spark)}/lake-{hashlib.md5(repr(made).encode()).hexdigest()}"
        lake, rows = Lakehouse(spark, root), event_rows(spark, sf_dir)
        # rows without an instant come last of their key, so they are in the base
        weeks = {"base": (F.col("event_time") <= F.lit(T0)) | F.col("event_time").isNull()}
        weeks |= {f"delta{k}": (F.col("event_time") > F.lit(a)) & (F.lit(True) if b is None else F.col("event_time") <= F.lit(b)) for k, (a, b) in enumerate(((T0, T1), (T1, T2), (T2, None)))}
        which = weeks | {name: F.expr(where) for name, (where, _) in LAYERS.items() if name != "base"} | {"layers_base": F.expr(LAYERS["base"][0])}
        last, *sizes = rows.agg(F.unix_millis(F.max("event_time")), *[F.count_if(c) for c in which.values()]).first()
        parts = dict(zip(which, map(files_for, sizes), strict=True))
        base = rows.filter(weeks["base"]).withColumn(ROW, F.coalesce(-F.unix_millis("event_time"), F.lit(2**63 - 1)))
        write_parts(lake, "history", merge_ordered([base], None), SCHEMA, "base.parquet", latest(), parts["base"])
        last = T2 if last is None else max(T2, datetime.fromtimestamp(last / 1000, UTC))
        deltas = []
        for k, (a, b) in enumerate(((T0, T1), (T1, T2), (T2, last))):
            write_parts(lake, "history", rows.filter(weeks[f"delta{k}"]), SCHEMA, f"delta{k}.parquet", latest(), parts[f"delta{k}"])
            deltas.append(Delta(f"delta{k}.parquet", a, b))
        publish(lake, "history", Snapshot(SCHEMA, (Segment("1", T0, None, "base.parquet"),)), "1")
        publish(lake, "history", Snapshot(SCHEMA, (Segment("1", T0, None, "base.parquet", (), tuple(deltas)),)), "2")
        for name, (where, order) in LAYERS.items():
            write_parts(lake, "layers", rows.filter(where), SCHEMA, f"{name}.parquet", [F.expr(order)], parts["layers_base" if name == "base" else name])
        child = Segment("12", T1, T2, "child.parquet")
        root_ = Segment("1", T0, None, "base.parquet", (child,), (Delta("early.parquet", T0, T2), Delta("late.parquet", T1, T2)))
        publish(lake, "layers", Snapshot(SCHEMA, (root_, Segment("0", T0, T1, "closed.parquet"))), "1")
        _made[made] = root
    return _made[made]


def _naive(df: DataFrame) -> DataFrame:
    """Instants without a zone, as the other engine has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def _state(at: datetime | None, columns: str = "key, event_time, event_type, value, event_id") -> str:
    where = "" if at is None else f"WHERE ts <= TIMESTAMP '{at:%Y-%m-%d %H:%M:%S}'"
    return f"(SELECT {columns} FROM (SELECT CAST(user_id AS VARCHAR) AS key, date_trunc('milliseconds', ts) AS event_time, event_type, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events {where}) WHERE n = 1)"


def _layers(files: str, at: datetime | None) -> str:
    """The first row of each key of these files, in this order of precedence, by its place in the file."""
    rows = "(SELECT CAST(user_id AS VARCHAR) AS key, date_trunc('milliseconds', ts) AS event_time, event_type, value, event_id FROM events)"
    parts = [f"SELECT *, {k} AS r, {order} AS i FROM {rows} WHERE {where}" for k, (where, order) in enumerate(LAYERS[f] for f in files.split())]
    when = "" if at is None else f"WHERE event_time <= TIMESTAMP '{at:%Y-%m-%d %H:%M:%S}'"
    return f"(SELECT key, event_time, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r, i) AS n FROM ({' UNION ALL '.join(parts)}) {when}) WHERE n = 1)"


def _layer_scan(at: datetime | None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _naive(Lakehouse(spark, lakehouse(spark, d)).scan("layers", at))


def _scan(at: datetime | None, columns: list[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _naive(Lakehouse(spark, lakehouse(spark, d)).scan("history", at, columns))


def _versioned(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _naive(Context(spark, lakehouse(spark, d)).sql(text))


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        for t in TABLES:
            if t in text:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return query


AT1, AT2 = format_instant(T1), format_instant(T2)
FLAGSHIP = f"SELECT key, event_type, value FROM history AT('{AT1}') WHERE event_type IN ('click', 'purchase', 'view') AND value > 10 ORDER BY value DESC, key LIMIT 20"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(FLAGSHIP)(spark, sf_dir)


def _df(build: Callable[[DataFrame], DataFrame], name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: build(spark.read.parquet(f"{d}/{name}.parquet"))


def _approximate(lineitem: DataFrame) -> DataFrame:
    """Beside count(DISTINCT) Spark keeps a sketch for each key; here keys are counted first, and one sketch takes the different ones."""
    keys = lineitem.groupBy("l_partkey").agg(F.count("*").alias("rows"))
    exact = F.count("l_partkey")
    return keys.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), (F.abs(F.approx_count_distinct("l_partkey") - exact) <= 0.2 * exact).alias("near"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str) -> None:
    QUERIES[name], ORACLES[name] = query, oracle


def _both(name: str, text: str, oracle: str | None = None) -> None:
    """SQL that says the same in both dialects, or nearly."""
    _add(name, _sql(text), oracle or text)


# 2.1: merge-on-read
_add("r8_scan_current", _scan(None), f"SELECT * FROM {_state(None)}")
_add("r8_scan_as_of", _scan(T1), f"SELECT * FROM {_state(T1)}")
_add("r6_scan_base_only", _scan(T0), f"SELECT * FROM {_state(T0)}")
_add("r9_projection", _scan(T2, ["value", "key"]), f"SELECT key, value FROM {_state(T2)}")
_add("r13_empty_projection_count", lambda s, d: Lakehouse(s, lakehouse(s, d)).scan("history", T2, []).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM {_state(T2)}")
_add("r3_before_history", _scan(datetime(2020, 1, 1, tzinfo=UTC)), f"SELECT * FROM {_state(datetime(2020, 1, 1, tzinfo=UTC))}")
# nested and closed segments, deltas that overlap, rows that aren't in the order of time: precedence by file, then by place
BETWEEN = datetime(2024, 1, 18, tzinfo=UTC)
_add("r5_layers_current", _layer_scan(None), f"SELECT * FROM {_layers('late early base', None)}")
_add("r5_layers_child_in_range", _layer_scan(BETWEEN), f"SELECT * FROM {_layers('child late early base', BETWEEN)}")
_add("r5_layers_at_both_ends", _layer_scan(T1), f"SELECT * FROM {_layers('child late early base closed', T1)}")
_add("r5_layers_start", _layer_scan(T0), f"SELECT * FROM {_layers('early base closed', T0)}")
_add("r7_not_the_latest", lambda s, d: Lakehouse(s, lakehouse(s, d)).scan("layers").join(Lakehouse(s, lakehouse(s, d)).scan("history").withColumnRenamed("event_id", "newest"), "key").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") != F.col("newest")).alias("older")), f"SELECT count(*) AS n, count(*) FILTER (WHERE a.event_id <> b.event_id) AS older FROM {_layers('late early base', None)} a JOIN {_state(None)} b USING (key)")
_add("r2_snapshot_by_id", lambda s, d: _naive(Lakehouse(s, lakehouse(s, d)).scan("history", version="1")), f"SELECT * FROM {_state(T0)}")
_add("r5_file_list", lambda s, d: s.createDataFrame([(k, f) for k, f in enumerate(Lakehouse(s, lakehouse(s, d)).files("layers", T1))], "place long, file string"), "SELECT CAST(k AS BIGINT) AS place, f AS file FROM (VALUES (0, 'child.parquet'), (1, 'late.parquet'), (2, 'early.parquet'), (3, 'base.parquet'), (4, 'closed.parquet')) v(k, f)")
_add("r11_get_schema", lambda s, d: s.createDataFrame([(c.name, c.data_type, c.nullable) for c in Lakehouse(s, lakehouse(s, d)).get_schema("layers").columns], "name string, data_type string, nullable boolean"), "SELECT * FROM (VALUES ('event_type', 'String', false), ('value', 'Double', false), ('event_id', 'Int', false)) v(name, data_type, nullable)")


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at BETWEEN of a table that was upserted in several files and compacted at T1 into several."""
    lake, rows, name = Lakehouse(spark, lakehouse(spark, sf_dir)), event_rows(spark, sf_dir), f"compacted_{uuid.uuid4().hex[:8]}"
    create(lake, name, SCHEMA, T0)
    for a, b in ((None, T0), (T0, T1), (T1, T2)):
        part = rows.filter(F.col("event_time") <= F.lit(b)) if a is None else rows.filter((F.col("event_time") > F.lit(a)) & (F.col("event_time") <= F.lit(b)))
        upsert(lake, name, part, a or T0, b, files=3)
    compact(lake, name, T1, files=3)
    return _naive(lake.scan(name, BETWEEN))


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as CSV, made a data file by the command line, and scanned."""
    from tidemark.cli import main

    root = lakehouse(spark, sf_dir)
    lake, name = Lakehouse(spark, root), f"csv_{uuid.uuid4().hex[:8]}"
    rows = event_rows(spark, sf_dir).filter(F.col("event_time").isNotNull() & F.col("value").isNotNull() & F.col("event_type").isNotNull())
    text = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    # a key's rows are all in one file of the folder
    rows.select("key", text, "event_type", "value", "event_id").repartition(files_for(rows.count()), "key").sortWithinPartitions(F.col("event_time").desc(), F.col("event_id")).write.csv(f"{root}/{name}.csv", quote="")
    publish(lake, name, Snapshot(SCHEMA, (Segment("1", T0, None, f"{name}.parquet"),)), "1")
    main(["gen", "--path", root, "--table", name, "--file", f"{root}/{name}.csv"], spark)
    return _naive(lake.scan(name, T2))


_add("c4_many_files_compacted", _compacted, f"SELECT * FROM {_state(BETWEEN)}")
_add("c3_csv_to_table", _csv, f"SELECT * FROM {_state(T2)}")
_add("c6_random_rows", lambda s, d: random_rows(s, 1000, T0, T1, 50).agg((F.count("*") <= 1000).alias("few"), (F.count("*") == F.count_distinct("key", "event_time")).alias("distinct_pairs"), (F.count_distinct("key") <= 50).alias("keys")), "SELECT true AS few, true AS distinct_pairs, true AS keys")
# 2.2: SQL with version clauses
_add("q5_shadowed", _versioned(f"WITH layers AS (SELECT key, value FROM history AT('{AT1}')), history AS (SELECT * FROM layers WHERE value > 50) SELECT (SELECT count(*) FROM history) AS n, (SELECT count(*) FROM (WITH layers AS (SELECT 1) SELECT * FROM layers)) AS one, count(*) AS m FROM layers"), f"SELECT (SELECT count(*) FROM {_state(T1)} WHERE value > 50) AS n, 1 AS one, (SELECT count(*) FROM {_state(T1)}) AS m")
_add("q5_own_query", _versioned("WITH history AS (SELECT key FROM history WHERE value > 50) SELECT count(*) AS n FROM history"), f"SELECT count(*) AS n FROM {_state(None)} WHERE value > 50")
_add("q5_table_statement", _versioned(f"TABLE history AT('{AT2}')"), f"SELECT * FROM {_state(T2)}")
_add("q14_files", lambda s, d: Context(s, lakehouse(s, d)).files(f"SELECT * FROM layers AT('{AT1}') JOIN history AT('{format_instant(T0)}') USING (key)").select("table_name", "file", "pruned"), "SELECT * FROM (VALUES ('layers', 'child.parquet', false), ('layers', 'late.parquet', false), ('layers', 'early.parquet', false), ('layers', 'base.parquet', false), ('layers', 'closed.parquet', false), ('history', 'base.parquet', false), ('history', 'delta0.parquet', false), ('history', 'delta1.parquet', true), ('history', 'delta2.parquet', true)) v(table_name, file, pruned)")
_add("x3_explain", lambda s, d: Context(s, lakehouse(s, d)).sql(f"EXPLAIN SELECT * FROM history AT('{AT1}')").select(F.contains("plan", F.lit("WindowGroupLimit")).alias("limited"), F.contains("plan", F.lit("PushedFilters: [IsNotNull(event_time), LessThanOrEqual(event_time")).alias("pushed")), "SELECT true AS limited, true AS pushed")


def _created(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = Context(spark, lakehouse(spark, sf_dir))
    context.sql(f"CREATE OR REPLACE TEMPORARY VIEW tm_created AS SELECT key, value FROM history AT('{AT1}') WHERE value > 20")
    return context.sql("SELECT count(*) AS n, round(sum(value), 4) AS total FROM tm_created")


_add("x2_create_view", _created, f"SELECT count(*) AS n, round(sum(value), 4) AS total FROM {_state(T1)} WHERE value > 20")
_add("q7_flagship", flagship, f"SELECT key, event_type, value FROM {_state(T1)} WHERE event_type IN ('click', 'purchase', 'view') AND value > 10 ORDER BY value DESC, key LIMIT 20")
_add("q6_system_time", _versioned(f"SELECT event_type, count(*) AS n, max(value) AS most FROM history FOR SYSTEM_TIME AS OF '{AT2}' GROUP BY event_type"), f"SELECT event_type, count(*) AS n, max(value) AS most FROM {_state(T2)} GROUP BY event_type")
_add("q8_named_argument", _versioned(f"SELECT key FROM history AT(TIMESTAMP => '{AT1}') WHERE value > 50"), f"SELECT key FROM {_state(T1)} WHERE value > 50")
_add("q15_two_versions", _versioned(f"SELECT a.key, a.value AS old_value, b.value AS new_value FROM history AT('{AT1}') a JOIN history b ON a.key = b.key WHERE a.event_id <> b.event_id"), f"SELECT a.key, a.value AS old_value, b.value AS new_value FROM {_state(T1)} a JOIN {_state(None)} b ON a.key = b.key WHERE a.event_id <> b.event_id")
_add("q5_nested", _versioned(f"WITH c AS (SELECT * FROM history) SELECT count(*) AS n FROM c WHERE value > (SELECT avg(value) FROM history AT('{AT1}'))"), f"SELECT count(*) AS n FROM {_state(None)} WHERE value > (SELECT avg(value) FROM {_state(T1)})")
_add("x1_changed_between", _versioned(f"SELECT key, event_id FROM history AT('{AT2}') EXCEPT SELECT key, event_id FROM history AT('{AT1}')"), f"SELECT key, event_id FROM {_state(T2)} EXCEPT SELECT key, event_id FROM {_state(T1)}")
# 2.4: the relational surface
_both("p1_projection", "SELECT o_orderkey, o_totalprice * 2 AS doubled, upper(o_orderpriority) AS priority FROM orders")
_both("p2_filter", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_name LIKE '%1%' AND c_mktsegment IS NOT NULL AND c_nationkey IN (1, 2, 3) AND c_acctbal IS DISTINCT FROM 7")
_both("p3_conditional", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, coalesce(nullif(p_size, 1), -1) AS c, greatest(p_size, 25) AS g, least(p_size, 25) AS l FROM part")
_both("p4_cast", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS s, try_cast(o_orderpriority AS INT) AS t, CAST(o_orderdate AS DATE) AS d FROM orders")
_both("j1_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_both("j1_outer", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 20")
_both("j1_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_both("j2_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS big FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_both("j3_theta_cross", "SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey")
_both("j4_using", "SELECT n_regionkey, count(*) AS n FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r USING (n_regionkey) GROUP BY n_regionkey")
_both("j5_interval", "SELECT p_partkey, band FROM part JOIN (VALUES (1, 0, 950), (2, 950, 1200), (3, 1200, 9999)) AS b(band, low, high) ON p_retailprice >= low AND p_retailprice < high")
_both("j7_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
_both("a1_general", "SELECT l_returnflag, count(*) AS n, sum(l_linenumber) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, median(l_quantity) AS med, bool_and(l_discount < 0.05) AS every, bool_or(l_discount < 0.05) AS some, bit_xor(l_orderkey) AS x FROM lineitem GROUP BY l_returnflag")
_both("a2_statistical", "SELECT l_linestatus, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_discount), 8) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS rs FROM lineitem GROUP BY l_linestatus")
_add("a3_approximate", _df(_approximate, "lineitem"), "SELECT count(*) AS n, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.2 * count(DISTINCT l_partkey) AS near FROM lineitem")
_both("a4_distinct_filtered", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS d, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_orderpriority HAVING count(*) > 1")
_both("a4_ordered", "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(n_nationkey, n_name))), x -> x.n_name), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
_both("a5_grouping", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS TINYINT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_both("a5_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_both("a5_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_both("w1_ranking", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(3) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_both("w2_analytic", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after2, first_value(value) OVER w AS f, nth_value(value, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
_both("w3_rows_range", "SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rows4, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM events")
_both("w3_groups", "SELECT p_partkey, sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS g FROM part)", "SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part")
_both("s1_sort_nulls", "SELECT n_name, x, row_number() OVER (ORDER BY x DESC NULLS LAST, n_name) AS place FROM (SELECT n_name, nullif(n_regionkey, 2) AS x FROM nation)")
_both("s2_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_both("s3_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
_both("s3_distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
_both("u1_set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
_both("u1_all_variants", "SELECT k, count(*) AS n FROM ((SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)) GROUP BY k")
_both("f1_strings", "SELECT c_custkey, concat_ws('-', c_mktsegment, NULL, c_name) AS j, lpad(substr(c_name, 1, 4), 6, '*') AS lp, replace(c_name, '0', '') AS re, reverse(c_mktsegment) AS rv, split_part(c_name, '#', 2) AS sp, length(c_name) AS n, trim('  a ') AS t, translate(c_mktsegment, 'AB', 'ab') AS tr, left(c_name, 3) AS le, ascii(c_name) AS asc_, levenshtein(c_name, 'Customer') AS lv, repeat('ab', 2) AS rp FROM customer")
_both("f2_regex", "SELECT c_custkey, regexp_replace(c_name, '0+', '#') AS r, c_name RLIKE '9$' AS m, hex(encode(c_mktsegment, 'utf-8')) AS h FROM customer", "SELECT c_custkey, regexp_replace(c_name, '0+', '#', 'g') AS r, regexp_matches(c_name, '9$') AS m, hex(encode(c_mktsegment)) AS h FROM customer")
_both("f3_dates", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(date_part('doy', o_orderdate) AS INT) AS doy, CAST(o_orderdate AS DATE) - INTERVAL '1' DAY AS prior FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(date_part('doy', o_orderdate) AS INT) AS doy, CAST(CAST(o_orderdate AS DATE) - INTERVAL '1' DAY AS DATE) AS prior FROM orders")
_add("f3_date_bin", _df(lambda df: df.select("event_id", date_bin(900, F.col("ts")).cast("timestamp_ntz").alias("bin")), "events"), "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS bin FROM events")
_both("f4_math", "SELECT p_partkey, abs(p_size - 25) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(sqrt(p_size), 6) AS sq, round(ln(p_size), 6) AS ln_, power(p_size, 2) AS pw, sign(p_size - 25) AS sg, round(atan2(p_size, 3), 6) AS at_, p_size % 7 AS md FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(sqrt(p_size), 6) AS sq, round(ln(p_size), 6) AS ln_, power(p_size, 2) AS pw, CAST(sign(p_size - 25) AS DOUBLE) AS sg, round(atan2(p_size, 3), 6) AS at_, p_size % 7 AS md FROM part")
_add("f4_gcd_lcm", _df(lambda df: df.select("p_partkey", gcd(F.col("p_partkey"), F.col("p_size")).alias("g"), lcm(F.col("p_partkey"), F.col("p_size")).alias("l")), "part"), "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l FROM part")
_both("f5_arrays", "SELECT n_nationkey, size(array_distinct(array(n_regionkey, n_regionkey, n_nationkey))) AS d, array_contains(array(1, 2, 3), n_regionkey) AS has, array_join(slice(array('a', 'b', 'c'), 2, 2), '+') AS sl, element_at(sequence(1, 5), 3) AS e, size(flatten(array(array(1, 2), array(3)))) AS fl FROM nation", "SELECT n_nationkey, CAST(len(list_distinct([n_regionkey, n_regionkey, n_nationkey])) AS INT) AS d, list_contains([1, 2, 3], n_regionkey) AS has, array_to_string(['b', 'c'], '+') AS sl, 3 AS e, 3 AS fl FROM nation")
_both("f6_maps_structs", "SELECT r_regionkey, element_at(map('a', r_regionkey, 'b', 7), 'a') AS m, named_struct('x', r_name, 'y', 1).x AS s, size(map_keys(map('a', 1, 'b', 2))) AS k FROM region", "SELECT r_regionkey, r_regionkey AS m, r_name AS s, 2 AS k FROM region")
_both("f7_json", "SELECT event_id, get_json_object(props, '$.page') AS page FROM events", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
_both("f8_hashes", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
_both("f9_unnest_series", "SELECT n_nationkey, explode(sequence(1, n_regionkey + 1)) AS k FROM nation", "SELECT n_nationkey, CAST(unnest(range(1, n_regionkey + 2)) AS INT) AS k FROM nation")
_both("x1_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")
_both("p1_star_except", "SELECT * EXCEPT (o_comment_) FROM (SELECT o_orderkey, o_custkey, 'x' AS o_comment_ FROM orders)", "SELECT o_orderkey, o_custkey FROM orders")
_both("p2_patterns", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%CUSTOMER%2' OR c_mktsegment RLIKE '^(AUTO|BUILD)' OR NOT (c_acctbal <=> 1)", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%CUSTOMER%2' OR regexp_matches(c_mktsegment, '^(AUTO|BUILD)') OR c_acctbal IS DISTINCT FROM 1")
_both("p3_null_functions", "SELECT p_partkey, nvl(nullif(p_size, 5), 0) AS a, ifnull(nullif(p_size, 6), 1) AS b, nvl2(nullif(p_size, 7), 'some', 'none') AS c FROM part", "SELECT p_partkey, coalesce(nullif(p_size, 5), 0) AS a, ifnull(nullif(p_size, 6), 1) AS b, CASE WHEN p_size = 7 THEN 'none' ELSE 'some' END AS c FROM part")
_both("j1_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 200000")
_both("j3_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
_both("j4_natural", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS r_regionkey FROM nation) NATURAL JOIN region")
_both("a1_bits_and_arrays", "SELECT l_linenumber, bit_and(l_orderkey) AS ba, bit_or(l_orderkey) AS bo, size(array_agg(l_partkey)) AS n, max_by(l_partkey, l_orderkey * 1000000 + l_partkey) AS last_part, count_if(l_quantity > 25) AS many, avg(l_quantity) AS a FROM lineitem GROUP BY l_linenumber", "SELECT l_linenumber, bit_and(l_orderkey) AS ba, bit_or(l_orderkey) AS bo, CAST(len(array_agg(l_partkey)) AS INT) AS n, max_by(l_partkey, l_orderkey * 1000000 + l_partkey) AS last_part, count(*) FILTER (WHERE l_quantity > 25) AS many, avg(l_quantity) AS a FROM lineitem GROUP BY l_linenumber")
_both("a2_regression", "SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 4) AS vs, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax FROM lineitem GROUP BY l_returnflag")
_both("a3_percentiles", "SELECT l_returnflag, abs(percentile_approx(l_quantity, 0.5) - median(l_quantity)) <= 1 AS near, percentile(l_linenumber, 0.25) AS q, percentile(l_linenumber, 0.5, l_linenumber) > 0 AS weighted FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, true AS near, quantile_cont(l_linenumber, 0.25) AS q, true AS weighted FROM lineitem GROUP BY l_returnflag")
_both("w1_distribution", "SELECT o_orderkey, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
_both("w2_last_value", "SELECT event_id, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events")
_both("s4_qualify", "SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place FROM orders) WHERE place <= 2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) <= 2")
_both("f1_more_strings", "SELECT c_custkey, bit_length(c_name) AS bl, octet_length(c_name) AS ol, char_length(c_name) AS cl, btrim(concat(' ', c_name, ' ')) AS bt, ltrim(concat(' ', c_name)) AS lt, rtrim(concat(c_name, ' ')) AS rt, chr(65 + c_custkey % 20) AS ch, contains(c_name, '1') AS co, startswith(c_name, 'Cust') AS st, endswith(c_name, '1') AS en, find_in_set(c_mktsegment, 'AUTOMOBILE,BUILDING') AS fs, initcap(c_mktsegment) AS ic, instr(c_name, '#') AS ins, position('#' IN c_name) AS po, right(c_name, 2) AS ri, lower(c_name) AS lo, rpad(c_mktsegment, 12, '.') AS rp, overlay(c_name PLACING '##' FROM 3 FOR 2) AS ov, substring_index(c_name, '#', 1) AS si, lower(hex(c_custkey)) AS hx, length(uuid()) AS uu FROM customer", "SELECT c_custkey, CAST(bit_length(c_name) AS INT) AS bl, CAST(octet_length(encode(c_name)) AS INT) AS ol, CAST(length(c_name) AS INT) AS cl, c_name AS bt, c_name AS lt, c_name AS rt, chr(CAST(65 + c_custkey % 20 AS INT)) AS ch, contains(c_name, '1') AS co, starts_with(c_name, 'Cust') AS st, ends_with(c_name, '1') AS en, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 0 END AS fs, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS ic, CAST(instr(c_name, '#') AS INT) AS ins, CAST(instr(c_name, '#') AS INT) AS po, right(c_name, 2) AS ri, lower(c_name) AS lo, rpad(c_mktsegment, 12, '.') AS rp, left(c_name, 2) || '##' || substr(c_name, 5) AS ov, split_part(c_name, '#', 1) AS si, lower(to_hex(c_custkey)) AS hx, 36 AS uu FROM customer")
_add("f1_own_strings", _df(lambda df: df.select("c_custkey", concat_skipping_nulls(F.col("c_name"), F.lit(None).cast("string"), F.col("c_mktsegment")).alias("j"), split_part_or_empty(F.col("c_name"), "#", 9).alias("e"), regexp_replace_first(F.col("c_name"), "(0)(0)", "$").alias("r")), "customer"), "SELECT c_custkey, concat(c_name, NULL, c_mktsegment) AS j, '' AS e, regexp_replace(c_name, '(0)(0)', '$') AS r FROM customer")
_both("f2_more_regex", "SELECT c_custkey, regexp_like(c_name, '[0-9]+') AS l, regexp_count(c_name, '0') AS n, regexp_extract_all(c_name, '([1-9])', 1) AS a, base64(encode(c_mktsegment, 'utf-8')) AS b, decode(unhex(hex(c_mktsegment)), 'utf-8') AS d FROM customer", "SELECT c_custkey, regexp_matches(c_name, '[0-9]+') AS l, CAST(len(regexp_extract_all(c_name, '0')) AS INT) AS n, regexp_extract_all(c_name, '[1-9]') AS a, base64(encode(c_mktsegment)) AS b, c_mktsegment AS d FROM customer")
_both("f3_more_dates", "SELECT event_id, make_date(2024, 2, 29) AS md, to_date('2024-03-01') AS td, date_format(ts, 'yyyy-MM-dd HH:mm') AS df, unix_timestamp(to_timestamp('2024-01-01 00:00:00')) AS u, CAST(timestamp_millis(1500) AS timestamp_ntz) AS tm, CAST(timestamp_micros(1500) AS timestamp_ntz) AS tu, CAST(timestamp_seconds(15) AS timestamp_ntz) AS ts_, from_unixtime(86400) AS fu, CAST(hour(ts) AS INT) AS h, quarter(ts) AS q, dayofweek(ts) AS dw, last_day(ts) AS ld, datediff(DATE'2024-03-01', DATE'2024-02-01') AS dd, CAST(from_utc_timestamp(ts, 'Asia/Tokyo') AS timestamp_ntz) AS jp, current_date() >= DATE'2024-01-01' AS now_ FROM events", "SELECT event_id, DATE '2024-02-29' AS md, DATE '2024-03-01' AS td, strftime(ts, '%Y-%m-%d %H:%M') AS df, 1704067200 AS u, TIMESTAMP '1970-01-01 00:00:01.5' AS tm, TIMESTAMP '1970-01-01 00:00:00.0015' AS tu, TIMESTAMP '1970-01-01 00:00:15' AS ts_, '1970-01-02 00:00:00' AS fu, CAST(hour(ts) AS INT) AS h, CAST(quarter(ts) AS INT) AS q, CAST(dayofweek(ts) + 1 AS INT) AS dw, last_day(ts) AS ld, 29 AS dd, ts + INTERVAL 9 HOURS AS jp, true AS now_ FROM events")
_both("f4_more_math", "SELECT p_partkey, round(acos(1 / p_size), 6) AS ac, round(acosh(p_size), 6) AS ah, round(asin(1 / p_size), 6) AS as_, round(asinh(p_size), 6) AS sh, round(atan(p_size), 6) AS at_, round(atanh(1 / (p_size + 1)), 6) AS th, round(cbrt(p_size), 6) AS cb, round(cos(p_size), 6) AS co, round(cosh(1 / p_size), 6) AS ch, round(cot(p_size), 4) AS ct, round(degrees(p_size), 5) AS de, round(exp(1 / p_size), 6) AS ex, factorial(p_size % 20) AS fa, round(log2(p_size), 6) AS l2, round(log10(p_size), 6) AS l10, round(log(3, p_size), 6) AS l3, round(pi(), 6) AS pi_, round(radians(p_size), 6) AS ra, round(sin(p_size), 6) AS si, round(sinh(1 / p_size), 6) AS sih, round(tan(p_size), 4) AS ta, round(tanh(p_size), 6) AS tah, isnan(sqrt(-1)) AS nan_, nanvl(sqrt(-1), 2.0D) AS nv, p_size div 7 AS dv, rand() < 1 AS rn FROM part WHERE p_size > 0", "SELECT p_partkey, round(acos(1 / p_size), 6) AS ac, round(acosh(p_size), 6) AS ah, round(asin(1 / p_size), 6) AS as_, round(asinh(p_size), 6) AS sh, round(atan(p_size), 6) AS at_, round(atanh(1 / (p_size + 1)), 6) AS th, round(cbrt(p_size), 6) AS cb, round(cos(p_size), 6) AS co, round(cosh(1 / p_size), 6) AS ch, round(cot(p_size), 4) AS ct, round(degrees(p_size), 5) AS de, round(exp(1 / p_size), 6) AS ex, CAST(factorial(CAST(p_size % 20 AS INT)) AS BIGINT) AS fa, round(log2(p_size), 6) AS l2, round(log10(p_size), 6) AS l10, round(ln(p_size) / ln(3), 6) AS l3, round(pi(), 6) AS pi_, round(radians(p_size), 6) AS ra, round(sin(p_size), 6) AS si, round(sinh(1 / p_size), 6) AS sih, round(tan(p_size), 4) AS ta, round(tanh(p_size), 6) AS tah, true AS nan_, 2.0::DOUBLE AS nv, CAST(p_size // 7 AS BIGINT) AS dv, true AS rn FROM part WHERE p_size > 0")
_add("f4_large_lcm", _df(lambda df: df.select("p_partkey", lcm(F.col("p_partkey") + F.lit(9007199254740992), F.lit(1)).alias("l"), lcm(F.lit(6_000_000_000), F.lit(9_000_000_000)).alias("m"), iszero(F.col("p_size") - 1).alias("z"), trunc(F.col("p_retailprice"), 1).alias("t")), "part"), "SELECT p_partkey, CAST(p_partkey AS BIGINT) + 9007199254740992 AS l, 18000000000 AS m, p_size - 1 = 0 AS z, trunc(p_retailprice * 10) / 10 AS t FROM part")
_both("f5_more_arrays", "SELECT n_nationkey, array_append(a, 9L) AS ap, array_prepend(a, 8L) AS pp, concat(a, a) AS cc, arrays_overlap(a, array(1L, 2L)) AS ov, array_sort(array_except(a, array(1L))) AS ex, array_intersect(a, array(1L, 2L)) AS it, array_sort(array_union(a, array(1L, 2L))) AS un, array_position(a, 3L) AS po, array_remove(a, 3L) AS rm, array_repeat(n_nationkey, 2) AS rp, transform(a, x -> if(x = 3, 0L, x)) AS rep, reverse(a) AS rv, slice(a, 1, size(a) - 1) AS pb, slice(a, 2, size(a)) AS pf, cardinality(a) AS ca, split('a,b', ',') AS st, sequence(1, 5, 2) AS sq, size(array()) = 0 AS em, round(sqrt(aggregate(zip_with(a, reverse(a), (x, y) -> CAST((x - y) * (x - y) AS DOUBLE)), 0.0D, (s, x) -> s + x)), 6) AS di, array_insert(a, 2, 7L) AS ai, array_compact(array(1, NULL, 2)) AS cp FROM (SELECT n_nationkey, array(n_nationkey, 3L, n_regionkey + 10) AS a FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation))", "SELECT n_nationkey, list_append(a, 9) AS ap, list_prepend(8, a) AS pp, a || a AS cc, list_has_any(a, [1, 2]) AS ov, list_sort(list_filter(list_distinct(a), lambda x: x <> 1)) AS ex, CASE WHEN n_nationkey IN (1, 2) THEN [n_nationkey] ELSE [] END AS it, list_sort(list_distinct(a || [1, 2])) AS un, CAST(list_position(a, 3) AS BIGINT) AS po, list_filter(a, lambda x: x <> 3) AS rm, [n_nationkey, n_nationkey] AS rp, list_transform(a, lambda x: CASE WHEN x = 3 THEN 0 ELSE x END) AS rep, list_reverse(a) AS rv, a[1:2] AS pb, a[2:3] AS pf, 3 AS ca, ['a', 'b'] AS st, [1, 3, 5] AS sq, true AS em, round(sqrt(2 * pow(CAST(a[1] - a[3] AS DOUBLE), 2)), 6) AS di, [a[1], 7, a[2], a[3]] AS ai, [1, 2] AS cp FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, [CAST(n_nationkey AS BIGINT), 3, CAST(n_regionkey AS BIGINT) + 10] AS a FROM nation)")
_both("f6_more_maps", "SELECT r_regionkey, map_from_arrays(array('a', 'b'), array(r_name, 'z'))['a'] AS a, map_values(map('k', r_regionkey))[0] AS v, map_contains_key(map('k', 1), 'k') AS c, struct(r_name AS x).x AS s FROM region", "SELECT r_regionkey, r_name AS a, r_regionkey AS v, true AS c, r_name AS s FROM region")
_both("f8_more_hashes", "SELECT c_custkey, sha2(c_name, 224) = sha2(c_name, 224) AS a, sha2(c_name, 384) <> sha2(c_name, 512) AS b, sha1(c_name) AS s1, typeof(c_custkey) IN ('bigint', 'int') AS t, length(version()) > 0 AS v FROM customer", "SELECT c_custkey, true AS a, true AS b, sha1(c_name) AS s1, true AS t, true AS v FROM customer")
_both("f9_generate_series", "SELECT id AS k, posexploded.pos AS p, posexploded.col AS c FROM range(5) LATERAL VIEW posexplode(array('a', 'b')) posexploded AS pos, col", "SELECT r.k, p.p, CASE p.p WHEN 0 THEN 'a' ELSE 'b' END AS c FROM (SELECT CAST(unnest(range(5)) AS BIGINT) AS k) r, (VALUES (0), (1)) p(p)")
