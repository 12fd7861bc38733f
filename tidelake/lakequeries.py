"""Queries over Delta tables made from the driver's files, and over footers and logs.

Each builds a small Delta directory in the shared folder, queries it through a
session, and has the same SQL on the plain view as its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.contract import CapabilityKey, QueryError, QueryOptions, QueryRequest, ResultPage, RuntimeLimits, Target
from tidelake.operators.control import RuntimeConfig, same_snapshot
from tidelake.operators.session import LakeSession, bootstrap_table, execute_query, measured
from tidelake.plans.lowering import lowered
from tidelake.sources import deltalog
from tidelake.sources.fixture import DeltaFixture, scratch
from tidelake.sources.inspect import inspect_parquet
from tidelake.sources.ranges import plan_requests

PART = ("p_partkey", "p_brand", "p_size")
SEGMENTS = "SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(c_nationkey) AS BIGINT) AS keys FROM {t} GROUP BY c_mktsegment"
STATUS = "SELECT o_orderkey, o_custkey FROM {t} WHERE o_orderstatus = 'F'"
STATUSES = "SELECT o_orderstatus, COUNT(*) AS n FROM {t} WHERE o_orderstatus IN ('F', 'P') AND o_orderkey > 100 GROUP BY o_orderstatus"
#: An alias that has a column's name is not that column.
HIDDEN = "SELECT COUNT(*) AS n FROM (SELECT CAST(rand(1) * 0 + 1 AS INT) AS p_size FROM {t}) t WHERE p_size < 5"
SWAPPED = "SELECT COUNT(*) AS n FROM (SELECT p_size AS p_partkey, CAST(rand(1) * 0 AS INT) AS z FROM {t}) t WHERE p_partkey >= 40 AND z = 0"
DATED = "SELECT o_orderkey, o_orderdate FROM {t} WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1997-01-01' AND o_orderpriority <= '3'"
PARTS = "SELECT p_partkey, p_size FROM {t} WHERE p_partkey >= 150 AND p_size < 40"


def _customers(spark: SparkSession, sf_dir: str) -> DeltaFixture:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    table = DeltaFixture(spark, scratch(spark, "delta-customer"), rows.schema.json())
    table.commit()
    table.commit(*table.add(rows.where("c_custkey % 2 = 0")))
    table.commit(*table.add(rows.where("c_custkey % 2 = 1")))
    return table


def _orders(spark: SparkSession, sf_dir: str) -> DeltaFixture:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    table = DeltaFixture(spark, scratch(spark, "delta-orders"), rows.schema.json(), ("o_orderstatus",))
    files = []
    for status in ("F", "O", "P"):
        files += table.add(rows.where(F.col("o_orderstatus") == status), {"o_orderstatus": status})
    table.commit(*files)
    return table


def _parts(spark: SparkSession, sf_dir: str) -> DeltaFixture:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(*PART)
    table = DeltaFixture(spark, scratch(spark, "delta-part"), rows.schema.json())
    files = []
    for low, high in ((0, 100), (100, 200), (200, 1000), (1000, 1 << 60)):
        files += table.add(rows.where((F.col("p_partkey") >= low) & (F.col("p_partkey") < high)))
    table.commit(*files)
    return table


def _over(spark: SparkSession, table: DeltaFixture, sql: str, version: int | None = None) -> DataFrame:
    session = LakeSession(spark)
    session.open_delta(table.root, version)
    return session.execute(sql.format(t="lake_table")).frame


def delta_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, _customers(spark, sf_dir), SEGMENTS)


def delta_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, _customers(spark, sf_dir), SEGMENTS, version=1)


def delta_partition_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, _orders(spark, sf_dir), STATUS)


def delta_partition_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, _orders(spark, sf_dir), STATUSES)


def delta_stats_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, _parts(spark, sf_dir), PARTS)


def executed_scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pruned query read, by its executed plan."""
    session = LakeSession(spark)
    session.open_delta(_parts(spark, sf_dir).root)
    result = session.execute(PARTS.format(t="lake_table"))
    kept = len(result.frame.collect())
    run = measured(result.frame)
    return spark.createDataFrame([(run.files_touched, run.rows_emitted, result.metrics.files_skipped, kept)], "files int, scanned int, skipped int, kept int")


#: Wanted byte ranges by file, and the requests that read them.
WANTED = {
    "touching": [(0, 100), (100, 250), (50, 120)],
    "gap in bounds": [(0, 65_536), (81_920, 200_000)],
    "gap too wide": [(0, 65_536), (81_921, 200_000)],
    "too much waste": [(0, 1_000), (2_000, 3_000)],
    "many gaps": [(k * 100_000, k * 100_000 + 86_000) for k in range(6)],
    "request too long": [(0, 300_000), (310_000, 524_288), (524_300, 600_000)],
    "past the end": [(0, 10), (20, 2_000_000)],
}
REQUESTS = [
    ("touching", 0, 250, 250, 3), ("gap in bounds", 0, 200_000, 183_616, 2), ("gap too wide", 0, 65_536, 65_536, 1), ("gap too wide", 81_921, 200_000, 118_079, 1),
    ("too much waste", 0, 1_000, 1_000, 1), ("too much waste", 2_000, 3_000, 1_000, 1), ("many gaps", 0, 486_000, 430_000, 5), ("many gaps", 500_000, 586_000, 86_000, 1),
    ("request too long", 0, 524_288, 514_288, 2), ("request too long", 524_300, 600_000, 75_700, 1), ("past the end", 0, 10, 10, 1), ("past the end", 20, 2_000_000, 1_999_980, 1),
]


def range_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(file, a, b, 1_000_000) for file, own in WANTED.items() for a, b in own]
    return plan_requests(spark.createDataFrame(rows, "file string, start long, end long, size long"))


def delta_hidden_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, _parts(spark, sf_dir), HIDDEN)


def delta_swapped_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, _parts(spark, sf_dir), SWAPPED)


def _dated(spark: SparkSession, sf_dir: str) -> DeltaFixture:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")
    table = DeltaFixture(spark, scratch(spark, "delta-dated"), rows.schema.json())
    files = []
    for low, high in (("0001-01-01", "1995-01-01"), ("1995-01-01", "1996-06-01"), ("1996-06-01", "9999-12-31")):
        part = rows.where((F.col("o_orderdate") >= F.lit(low).cast("date")) & (F.col("o_orderdate") < F.lit(high).cast("date")))
        for own in (part.where("o_orderpriority < '3'"), part.where("o_orderpriority >= '3'")):
            files += table.add(own, kinds=("date", "string"))
    table.commit(*files)
    return table


def delta_date_and_text_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, _dated(spark, sf_dir), DATED)


def delta_checkpoint_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _customers(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    table.checkpoint(parts=2)
    first = next(iter(table.active))
    table.commit({"remove": {"path": first, "dataChange": True}}, *table.add(rows.where("c_custkey % 2 = 0")))
    return _over(spark, table, SEGMENTS)


def delta_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT a.o_custkey, COUNT(*) AS pairs FROM {t} a JOIN {t} b ON a.o_custkey = b.o_custkey WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'P' GROUP BY a.o_custkey"
    return _over(spark, _orders(spark, sf_dir), sql)


def delta_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltalog.history(spark, _customers(spark, sf_dir).root).select("version", "operation", "added", "removed")


def result_page_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = LakeSession(spark)
    session.open_parquet("lake_table", f"{sf_dir}/orders.parquet")
    return session.execute("SELECT o_orderkey FROM lake_table ORDER BY o_orderkey DESC LIMIT 80;", options=QueryOptions(page=ResultPage(30, 60))).frame


def parquet_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect_parquet(spark, f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet").drop("logical_type")


#: ``nation`` and ``region`` are the same files at every scale; each has one row group.
INSPECTED = """
SELECT regexp_extract(file_name, '[^/]+$') AS file, CAST(row_group_id AS INT) AS row_group, path_in_schema AS column_path, type AS physical_type, compression,
       num_values, total_compressed_size AS compressed_bytes, total_uncompressed_size AS uncompressed_bytes, stats_null_count AS null_count,
       stats_min_value AS min_value, stats_max_value AS max_value, row_group_num_rows AS row_group_rows, row_group_num_rows AS file_rows
FROM parquet_metadata(['/root/testdata/sf0.01/nation.parquet', '/root/testdata/sf0.01/region.parquet'])
"""


def table_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = LakeSession(spark)
    for name in ("nation", "region"):
        session.open_parquet(name, f"{sf_dir}/{name}.parquet")
    return session.catalog().select("table_name", "column_name", "position")


#: Texts for the targets' gates: each is judged by all three.
JUDGED = {
    "plain": "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 5",
    "grouped": "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC",
    "average": "SELECT AVG(c_acctbal) AS mean FROM customer",
    "integral average": "SELECT AVG(c_nationkey) AS mean FROM customer",
    "collection": "SELECT ARRAY_AGG(c_custkey) AS keys FROM customer",
    "null order": "SELECT c_custkey FROM customer ORDER BY c_custkey NULLS FIRST",
    "null literal": "SELECT c_custkey FROM customer WHERE c_name = NULL",
    "disjunction": "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_nationkey = 4",
    "computed": "SELECT c_custkey + 1 AS next FROM customer",
    "hidden key": "SELECT c_custkey FROM customer ORDER BY c_name",
    "two of a name": "SELECT c_custkey AS k, c_nationkey AS k FROM customer",
    "interval": "SELECT c_custkey FROM customer WHERE CURRENT_DATE - INTERVAL 1 DAY > DATE '2020-01-01'",
    "distinct": "SELECT DISTINCT c_nationkey FROM customer",
    "having": "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 1",
    "offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 3 OFFSET 2",
    "window": "SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey) AS n FROM customer",
    "named window": "SELECT c_custkey, ROW_NUMBER() OVER w AS n FROM customer WINDOW w AS (ORDER BY c_custkey)",
    "renaming subquery": "SELECT q.k FROM (SELECT c_custkey AS k FROM customer) q ORDER BY q.k",
    "column list": "SELECT q.k FROM (SELECT c_custkey FROM customer) AS q(k)",
    "with": "WITH q AS (SELECT c_custkey AS k FROM customer) SELECT k FROM q",
    "recursion": "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT r.n FROM r, customer",
    "join": "SELECT a.c_custkey FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey",
    "union": "SELECT c_custkey FROM customer UNION SELECT c_nationkey FROM customer",
    "other table": "SELECT n_name FROM nation",
    "values": "VALUES (1)",
    "no table": "SELECT 1 AS one",
    "insert": "INSERT INTO customer SELECT * FROM customer",
    "table function": "SELECT id FROM range(3)",
    "unknown column": "SELECT missing FROM customer",
    "two statements": "SELECT c_custkey FROM customer; SELECT 1",
}
OK, BAD, NATIVE = "ok", "invalid_request", "fallback_required: native_required"
#: What native, session and narrow answer.
VERDICTS = {
    "plain": (OK, OK, OK), "grouped": (OK, OK, OK), "average": (OK, OK, NATIVE), "integral average": (OK, OK, OK), "collection": (OK, OK, NATIVE),
    "null order": (OK, OK, BAD), "null literal": (OK, OK, BAD), "disjunction": (OK, OK, BAD), "computed": (OK, OK, BAD), "hidden key": (OK, OK, BAD),
    "two of a name": (OK, OK, BAD), "interval": (OK, OK, BAD), "distinct": (OK, OK, NATIVE), "having": (OK, OK, NATIVE), "offset": (OK, OK, NATIVE),
    "window": (OK, OK, NATIVE), "named window": (OK, BAD, BAD), "renaming subquery": (OK, OK, OK), "column list": (OK, BAD, BAD), "with": (OK, NATIVE, OK),
    "recursion": (BAD, BAD, BAD), "join": (OK, NATIVE, NATIVE), "union": (OK, NATIVE, NATIVE), "other table": (BAD, BAD, BAD), "values": (BAD, BAD, BAD),
    "no table": (BAD, BAD, BAD), "insert": (BAD, BAD, BAD), "table function": (BAD, BAD, BAD), "unknown column": (BAD, BAD, BAD), "two statements": (BAD, BAD, BAD),
}


def _answer(run) -> str:
    try:
        run()
    except QueryError as error:
        return error.code.value + (f": {error.fallback.value}" if error.fallback else "")
    return OK


def target_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every target says to every text of ``JUDGED``."""
    session = LakeSession(spark)
    session.open_parquet("customer", f"{sf_dir}/customer.parquet")
    rows = [(name, t.value, _answer(lambda sql=sql, t=t: session.execute(sql, "customer", target=t))) for name, sql in JUDGED.items() for t in (Target.NATIVE, Target.SESSION, Target.NARROW)]
    return spark.createDataFrame(rows, "query string, target string, answer string")


LOWERED = {
    "filter and limit": "SELECT p_partkey, p_size FROM part WHERE 10 < p_size LIMIT 2",
    "conjunction": "SELECT p_partkey FROM part WHERE p_size >= 3 AND (p_brand = 'x' AND p_name IS NOT NULL) AND p_size IN (3, -4)",
    "alias order": "SELECT p_size AS v FROM part ORDER BY v DESC LIMIT 3",
    "with": "WITH f AS (SELECT p_size AS total FROM part) SELECT total FROM f ORDER BY total",
    "count": "SELECT COUNT(*) FROM part",
    "grouped": "SELECT p_brand, SUM(p_size), MIN(p_size) AS lo, MAX(p_size) AS hi FROM part GROUP BY p_brand ORDER BY p_brand",
}


def narrow_lowering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowering summary of the texts of ``LOWERED``, one row each."""
    rows = []
    for name, sql in LOWERED.items():
        plan = lowered(spark, sql, "part", named=False)
        filters = [f"{f.source} {f.comparison or f.kind} {','.join(map(str, f.literals))}".strip() for f in plan.filters]
        measures = [f"{m.function}({m.source or '*'})" for m in plan.measures]
        order = [f"{n} {'desc' if down else 'asc'}" for n, down in plan.order_by]
        rows.append((name, *(";".join(x) for x in (plan.required, filters, plan.group_by, measures, order)), plan.limit))
    return spark.createDataFrame(rows, "query string, required string, filters string, grouped string, measures string, sorted string, most int")


def guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies, identity, features, capabilities, budgets and addresses on one table."""
    table = _customers(spark, sf_dir)
    uri = table.root
    session = LakeSession(spark)
    snapshot = session.open_delta(uri)
    feature = DeltaFixture(spark, scratch(spark, "delta-feature"), table.schema, protocol={"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["deletionVectors"], "writerFeatures": ["deletionVectors"]}, properties={"delta.enableDeletionVectors": "true"})
    feature.commit()
    count = "SELECT COUNT(*) AS n FROM lake_table"
    small = LakeSession(spark, config=RuntimeConfig(narrow_rows=1))
    small.open_delta(uri)

    def limited(**most):
        return lambda: session.execute("SELECT c_custkey FROM lake_table", options=QueryOptions(limits=RuntimeLimits(**most)))

    checks = {
        "open": lambda: bootstrap_table(spark, uri),
        "open with blanks and a slash": lambda: deltalog.resolve(spark, f"  {uri}/ "),
        "no such table": lambda: deltalog.resolve(spark, f"{uri}-none"),
        "no such version": lambda: deltalog.resolve(spark, uri, 9),
        "negative version": lambda: deltalog.resolve(spark, uri, -1),
        "blank address": lambda: deltalog.resolve(spark, " "),
        "allowed": lambda: deltalog.resolve(spark, uri, allow={uri}),
        "not allowed": lambda: deltalog.resolve(spark, uri, allow={f"{uri}-other"}),
        "denied and allowed": lambda: deltalog.resolve(spark, uri, allow={uri}, deny={uri}),
        "unsupported feature": lambda: deltalog.resolve(spark, feature.root),
        "other table": lambda: same_snapshot(snapshot, f"{uri}-other", None),
        "other version": lambda: same_snapshot(snapshot, uri, 1),
        "same snapshot": lambda: same_snapshot(snapshot, uri, 2),
        "time travel needed": lambda: session.execute(count, options=QueryOptions(needs=frozenset({CapabilityKey.TIME_TRAVEL})), target=Target.SESSION),
        "signed addresses needed": lambda: session.execute(count, options=QueryOptions(needs=frozenset({CapabilityKey.CHANGE_DATA_FEED})), target=Target.SESSION),
        "scan too large": limited(max_scan_bytes=1),
        "result too large": limited(max_result_rows=2),
        "within limits": limited(max_scan_bytes=1 << 40),
        "narrow budget": lambda: small.execute(count, target=Target.NARROW),
        "no timeout": lambda: RuntimeConfig(execution_timeout=0),
        "page too long": lambda: ResultPage(502),
        "limits on native": lambda: execute_query(spark, QueryRequest(uri, count, options=QueryOptions(limits=RuntimeLimits(max_result_rows=1)))),
    }
    return spark.createDataFrame([(name, _answer(run)) for name, run in checks.items()], "check string, answer string")


GUARDS = {
    "open": OK, "open with blanks and a slash": OK, "no such table": "object_not_found", "no such version": "object_not_found", "negative version": BAD, "blank address": BAD,
    "allowed": OK, "not allowed": "access_denied", "denied and allowed": "access_denied", "unsupported feature": "unsupported_feature", "other table": BAD, "other version": BAD,
    "same snapshot": OK, "time travel needed": OK, "signed addresses needed": "unsupported_feature", "scan too large": "resource_exhausted", "result too large": "resource_exhausted",
    "within limits": OK, "narrow budget": "fallback_required: browser_runtime_constraint", "no timeout": BAD, "page too long": BAD, "limits on native": BAD,
}


def registered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An in-memory table, queried, its Arrow result registered and queried again."""
    session = LakeSession(spark)
    session.register("lake_table", spark.read.parquet(f"{sf_dir}/nation.parquet").toArrow())
    result = session.execute("SELECT n_regionkey, COUNT(*) AS n FROM lake_table GROUP BY n_regionkey").frame.toArrow()
    session.register("lake_table", result)
    return session.execute("SELECT n, COUNT(*) AS regions FROM lake_table GROUP BY n").frame


def cursor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through the IPC cursor and back."""
    import pyarrow as pa

    from tidelake.streaming.cursor import ArrowCursor

    session = LakeSession(spark)
    session.open_parquet("lake_table", f"{sf_dir}/supplier.parquet")
    found = session.execute("SELECT s_suppkey, s_nationkey FROM lake_table WHERE s_nationkey < 12").frame
    data = b"".join(c.data for c in ArrowCursor(found, chunk_bytes=4096))
    return spark.createDataFrame(pa.ipc.open_stream(data).read_all())


def _values(rows, names: str) -> str:
    def literal(v) -> str:
        return "NULL" if v is None else f"CAST({v} AS INT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"


def queries() -> dict:
    found = (target_verdicts, narrow_lowering, guard_verdicts, registered_rows, cursor_round_trip, delta_latest_snapshot, delta_time_travel, delta_partition_prune, delta_partition_in, delta_stats_skip, executed_scan_metrics, range_requests, delta_hidden_alias, delta_swapped_alias, delta_date_and_text_skip, delta_checkpoint_replay, delta_self_join, delta_history, result_page_wrap, parquet_inspection, table_catalog)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "delta_latest_snapshot": SEGMENTS.format(t="customer"),
        "delta_time_travel": SEGMENTS.format(t="customer WHERE c_custkey % 2 = 0"),
        "delta_partition_prune": STATUS.format(t="orders"),
        "delta_partition_in": STATUSES.format(t="orders"),
        "delta_stats_skip": PARTS.format(t="part"),
        "range_requests": _values(REQUESTS, 'file, "start", "end", wanted_bytes, ranges').replace(" AS INT)", " AS BIGINT)"),
        "executed_scan_metrics": "SELECT 3 AS files, CAST(COUNT(*) FILTER (WHERE p_partkey >= 100) AS INT) AS scanned, 1 AS skipped, CAST(COUNT(*) FILTER (WHERE p_partkey >= 150 AND p_size < 40) AS INT) AS kept FROM part",
        "delta_hidden_alias": "SELECT COUNT(*) AS n FROM part",
        "delta_swapped_alias": "SELECT COUNT(*) AS n FROM part WHERE p_size >= 40",
        "delta_date_and_text_skip": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-03-01' AND CAST(o_orderdate AS DATE) < DATE '1997-01-01' AND o_orderpriority <= '3'",
        "delta_checkpoint_replay": SEGMENTS.format(t="customer"),
        "delta_self_join": "SELECT a.o_custkey, COUNT(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'P' GROUP BY a.o_custkey",
        "delta_history": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'WRITE', CAST(0 AS BIGINT), CAST(0 AS BIGINT)), (1, 'WRITE', 1, 0), (2, 'WRITE', 1, 0)) t(version, operation, added, removed)",
        "target_verdicts": _values([(q, t, v) for q, own in VERDICTS.items() for t, v in zip(("native", "session", "narrow"), own)], "query, target, answer"),
        "guard_verdicts": _values(GUARDS.items(), "check, answer").replace("t(check,", 't("check",'),
        "narrow_lowering": _values(
            [
                ("filter and limit", "p_partkey;p_size", "p_size gt 10", "", "", "", 2),
                ("conjunction", "p_brand;p_name;p_partkey;p_size", "p_size gte 3;p_brand eq x;p_name is_not_null;p_size in_list 3,-4", "", "", "", None),
                ("alias order", "p_size", "", "", "", "v desc", 3),
                ("with", "p_size", "", "", "", "total asc", None),
                ("count", "", "", "", "count_star(*)", "", None),
                ("grouped", "p_brand;p_size", "", "p_brand", "sum(p_size);min(p_size);max(p_size)", "p_brand asc", None),
            ],
            "query, required, filters, grouped, measures, sorted, most",
        ),
        "registered_rows": "SELECT n, COUNT(*) AS regions FROM (SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey) t GROUP BY n",
        "cursor_round_trip": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey < 12",
        "parquet_inspection": INSPECTED,
        "result_page_wrap": "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 80) t LIMIT 30 OFFSET 60",
        "table_catalog": "SELECT * FROM (VALUES ('nation', 'n_nationkey', 0), ('nation', 'n_name', 1), ('nation', 'n_regionkey', 2), ('region', 'r_regionkey', 0), ('region', 'r_name', 1)) t(table_name, column_name, position)",
    }
