"""Snapshots, skipping, gates, budgets and delivery."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelake.contract import CapabilityKey, ErrorCode, FallbackReason, QueryError, QueryOptions, QueryRequest, ResultPage, RuntimeLimits, Target
from tidelake.operators.router import first_route, reroute, run
from tidelake.operators.session import LakeSession, bootstrap_table, execute_query
from tidelake.plans.errors import redacted
from tidelake.plans.sqltext import similar_pattern, to_spark, with_null_order
from tidelake.sources import deltalog
from tidelake.sources.fixture import DeltaFixture, put_text, scratch

# The sample table, and the queries, rows and file counts that are expected of it below.
ROWS = [(1, "A", 10), (2, "B", 20), (3, "A", 30), (4, "B", 40), (5, "B", 50), (6, "C", 60)]
COLUMNS = "id int, category string, value int"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def two_commits(spark):
    t = DeltaFixture(spark, scratch(spark, "a1"), frame(spark, ROWS).schema.json())
    t.commit()
    t.commit(*t.add(frame(spark, ROWS[:3])))
    t.commit(*t.add(frame(spark, ROWS[3:])))
    return t


@pytest.fixture(scope="module")
def partitioned(spark):
    t = DeltaFixture(spark, scratch(spark, "a2"), frame(spark, ROWS).schema.json(), ("category",))
    t.commit(*[a for c in "ABC" for a in t.add(frame(spark, [r for r in ROWS if r[1] == c]), {"category": c})])
    return t


def ask(spark, table, sql, version=None, **options):
    result = execute_query(spark, QueryRequest(table.root, sql, version, options=QueryOptions(**options)))
    return [tuple(r) for r in result.frame.collect()], result


@pytest.mark.parametrize(
    "sql, rows, touched, skipped",
    [
        ("SELECT id, value FROM lake_table WHERE category = 'B' ORDER BY id", [(2, 20), (4, 40), (5, 50)], 2, 0),
        ("SELECT SUM(value) AS total FROM lake_table", [(210,)], 2, 0),
        ("SELECT category, COUNT(*) AS n FROM lake_table GROUP BY category ORDER BY category", [("A", 2), ("B", 3), ("C", 1)], 2, 0),
        ("SELECT id FROM lake_table ORDER BY value DESC LIMIT 2", [(6,), (5,)], 2, 0),
        ("SELECT MIN(value) AS lo, MAX(value) AS hi FROM lake_table", [(10, 60)], 2, 0),
        ("WITH b AS (SELECT category, value FROM lake_table) SELECT category, SUM(value) AS t FROM b GROUP BY category ORDER BY category", [("A", 40), ("B", 110), ("C", 60)], 2, 0),
        ("SELECT COUNT(*) AS n FROM (SELECT id, value FROM lake_table WHERE value >= 20) f", [(5,)], 2, 0),
        ("SELECT category, SUM(value) AS t FROM lake_table GROUP BY category HAVING SUM(value) >= 60 ORDER BY category", [("B", 110), ("C", 60)], 2, 0),
        ("SELECT a.id FROM lake_table a JOIN lake_table b ON a.id = b.id + 1 WHERE b.value > 40 ORDER BY a.id", [(6,)], 2, 0),
        ("SELECT id FROM lake_table UNION ALL SELECT id FROM lake_table WHERE id = 1 ORDER BY id LIMIT 3", [(1,), (1,), (2,)], 2, 0),
    ],
)
def test_latest_snapshot(spark, two_commits, sql, rows, touched, skipped):
    got, result = ask(spark, two_commits, sql)
    assert got == rows
    assert (result.metrics.files_touched, result.metrics.files_skipped) == (touched, skipped)


@pytest.mark.parametrize(
    "sql, rows, touched, skipped",
    [
        ("SELECT id, value FROM lake_table WHERE category = 'C' ORDER BY id", [(6, 60)], 1, 2),
        ("SELECT category, COUNT(*) AS n FROM lake_table WHERE category IN ('A', 'B') GROUP BY category ORDER BY category", [("A", 2), ("B", 3)], 2, 1),
        ("SELECT id FROM lake_table WHERE category = 'Z' ORDER BY id", [], 0, 3),
        ("SELECT SUM(value) AS t FROM lake_table", [(210,)], 3, 0),
        ("SELECT id FROM lake_table WHERE value >= 40 ORDER BY id", [(4,), (5,), (6,)], 2, 1),
        ("SELECT COUNT(*) AS n FROM lake_table WHERE category = 'Z'", [(0,)], 0, 3),
        ("SELECT id FROM lake_table WHERE category = 'A' OR category = 'C' ORDER BY id", [(1,), (3,), (6,)], 2, 1),
        ("SELECT id FROM lake_table WHERE category IS NULL", [], 0, 3),
        ("SELECT id FROM lake_table WHERE NOT (category = 'B') AND value < 20", [(1,)], 1, 2),
        ("SELECT id FROM lake_table WHERE value = 30 OR value IN (60, 61) ORDER BY id", [(3,), (6,)], 3, 0),
    ],
)
def test_partitions_and_statistics(spark, partitioned, sql, rows, touched, skipped):
    got, result = ask(spark, partitioned, sql)
    assert got == rows
    assert (result.metrics.files_touched, result.metrics.files_skipped) == (touched, skipped)


@pytest.mark.parametrize("sql, rows", [("SELECT COUNT(*) AS n FROM lake_table", [(3,)]), ("SELECT SUM(value) AS t FROM lake_table", [(60,)]), ("WITH f AS (SELECT id FROM lake_table WHERE category = 'A') SELECT COUNT(*) AS n FROM f", [(2,)])])
def test_history(spark, two_commits, sql, rows):
    assert ask(spark, two_commits, sql, version=1)[0] == rows


def test_null_order_default(spark):
    session = LakeSession(spark)
    session.register("lake_table", [(1, 20), (2, None), (3, 10), (4, None)], "id int, value int")
    ids = lambda sql: [r.id for r in session.execute(sql).frame.collect()]
    assert ids("SELECT id FROM lake_table ORDER BY value, id") == [3, 1, 2, 4]
    assert ids("SELECT id FROM lake_table ORDER BY value DESC, id") == [2, 4, 1, 3]
    assert with_null_order("SELECT f(ORDER_BY) FROM t ORDER BY g(a, 'x, ORDER BY') DESC, b NULLS FIRST LIMIT 1").count("NULLS") == 2


def test_array_agg_keeps_nulls(spark):
    session = LakeSession(spark)
    session.register("lake_table", [(1, None), (1, 2)], "k int, v int")
    assert sorted(session.execute("SELECT ARRAY_AGG(v) AS a FROM lake_table GROUP BY k").frame.first().a, key=str) == [2, None]


@pytest.mark.parametrize(
    "sql",
    [
        "", "SELECT 1", "DROP TABLE lake_table", "SELECT * FROM other", "SELECT * FROM range(3)", "VALUES (1)", "SELECT id FROM lake_table; SELECT id FROM lake_table", "SELECT * FROM lake_table TABLESAMPLE (5 ROWS)",
        "SELECT * FROM lake_table VERSION AS OF 1", "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT r.n FROM r, lake_table", "SELECT * FROM parquet.`/tmp/x`", "SELECT e FROM lake_table LATERAL VIEW explode(array(1)) t AS e",
        "SELECT id FROM lake_table WHERE id IN (SELECT n_nationkey FROM nation)", "INSERT INTO lake_table VALUES (1, 'a', 2)", "CREATE VIEW v AS SELECT * FROM lake_table", "SELECT id FRM lake_table", "SELECT missing FROM lake_table", "SELECT /*+ BROADCAST(lake_table) */ id FROM lake_table",
    ],
)
def test_gate_rejects(spark, two_commits, sql):
    with pytest.raises(QueryError) as error:
        ask(spark, two_commits, sql)
    assert error.value.code is ErrorCode.INVALID_REQUEST


@pytest.mark.parametrize("sql", ["SELECT a.id FROM lake_table a JOIN lake_table b ON a.id = b.id", "SELECT id FROM lake_table UNION SELECT id FROM lake_table", "WITH c AS (SELECT id FROM lake_table) SELECT id FROM c"])
def test_restricted_targets_fall_back(spark, two_commits, sql):
    request = QueryRequest(two_commits.root, sql, preferred_target=Target.SESSION)
    with pytest.raises(QueryError) as error:
        execute_query(spark, request)
    assert error.value.fallback is FallbackReason.NATIVE_REQUIRED
    assert reroute(request, error.value).target is Target.NATIVE
    assert run(spark, request).frame.count() > 0
    assert first_route(request).target is Target.SESSION


@pytest.mark.parametrize("sql", ["SELECT DISTINCT id FROM lake_table", "SELECT id FROM lake_table LIMIT 1 OFFSET 1", "SELECT category FROM lake_table GROUP BY category HAVING COUNT(*) > 1"])
def test_narrow_target(spark, two_commits, sql):
    with pytest.raises(QueryError) as error:
        execute_query(spark, QueryRequest(two_commits.root, sql, preferred_target=Target.NARROW))
    assert error.value.requires_fallback


def test_checkpoints(spark):
    for parts in (1, 2):
        t = DeltaFixture(spark, scratch(spark, "cp"), frame(spark, ROWS).schema.json())
        t.commit()
        t.commit(*t.add(frame(spark, ROWS[:3])))
        t.checkpoint(parts)
        first = next(iter(t.active))
        t.commit({"remove": {"path": first}}, *t.add(frame(spark, ROWS[3:])))
        os.remove(f"{t.root.removeprefix('file://')}/_delta_log/{0:020d}.json")
        assert ask(spark, t, "SELECT COUNT(*) AS n, MIN(id) AS lo FROM lake_table")[0] == [(3, 4)]
        with pytest.raises(QueryError):
            deltalog.resolve(spark, t.root, 0)


def test_incomplete_checkpoints_are_passed_over():
    names = [f"{5:020d}.checkpoint.{1:010d}.{2:010d}.parquet", f"{3:020d}.checkpoint.parquet", f"{4:020d}.checkpoint.80a083e8-7026-4e79-81be-64bd76c43a11.json", "x.checkpoint.parquet"]
    assert sorted(deltalog.checkpoints(names)) == [3, 4]


def test_sidecars_stay_inside(spark):
    t = DeltaFixture(spark, scratch(spark, "side"), frame(spark, ROWS).schema.json())
    t.commit(*t.add(frame(spark, ROWS)))
    adds = spark.createDataFrame([(__import__("json").dumps({"add": a}),) for a in t.active.values()], "value string")
    t.parquet(adds.select(F.from_json("value", deltalog.ACTIONS).alias("a")).select("a.*"), "_delta_log/_sidecars/one.parquet")
    lines = lambda path: "".join(__import__("json").dumps(x) + "\n" for x in [{"protocol": t.protocol}, {"metaData": t.metadata()}, {"sidecar": {"path": path, "sizeInBytes": 1, "modificationTime": 0}}])
    name = f"{t.root}/_delta_log/{0:020d}.checkpoint.80a083e8-7026-4e79-81be-64bd76c43a11.json"
    put_text(spark, name, lines("one.parquet"))
    assert ask(spark, t, "SELECT COUNT(*) AS n FROM lake_table")[0] == [(6,)]
    for bad in ("../../x.parquet", "/etc/x.parquet", "%2e%2e/x.parquet"):
        put_text(spark, name, lines(bad))
        with pytest.raises(QueryError) as error:
            deltalog.resolve(spark, t.root)
        assert error.value.code is ErrorCode.SECURITY_POLICY_VIOLATION


@pytest.mark.parametrize(
    "properties, protocol, key",
    [
        ({"delta.enableChangeDataFeed": "true"}, {"minReaderVersion": 1, "minWriterVersion": 4}, CapabilityKey.CHANGE_DATA_FEED),
        ({"delta.columnMapping.mode": "name"}, {"minReaderVersion": 2, "minWriterVersion": 5}, CapabilityKey.COLUMN_MAPPING),
        ({"delta.enableDeletionVectors": "true"}, {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["deletionVectors"], "writerFeatures": ["deletionVectors"]}, CapabilityKey.DELETION_VECTORS),
        ({}, {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["fromTheFuture"], "writerFeatures": ["fromTheFuture"]}, CapabilityKey.UNKNOWN_PROTOCOL_FEATURES),
        ({"delta.appendOnly": "true"}, {"minReaderVersion": 1, "minWriterVersion": 2}, None),
    ],
)
def test_unsupported_features(spark, properties, protocol, key):
    t = DeltaFixture(spark, scratch(spark, "feat"), frame(spark, ROWS).schema.json(), properties=properties, protocol=protocol)
    t.commit(*t.add(frame(spark, ROWS)))
    with pytest.raises(QueryError) as error:
        deltalog.resolve(spark, t.root)
    assert error.value.code is ErrorCode.UNSUPPORTED_FEATURE and error.value.capability is key


def test_properties_without_protocol_don_t_count(spark):
    t = DeltaFixture(spark, scratch(spark, "prop"), frame(spark, ROWS).schema.json(), properties={"delta.enableChangeDataFeed": "true"})
    t.commit(*t.add(frame(spark, ROWS)))
    assert deltalog.resolve(spark, t.root).version == 0


def test_resolution_errors_and_policy(spark, two_commits, tmp_path):
    for uri, version, code in ((str(tmp_path), None, ErrorCode.OBJECT_NOT_FOUND), (two_commits.root, 9, ErrorCode.OBJECT_NOT_FOUND), (two_commits.root, -1, ErrorCode.INVALID_REQUEST), (" ", None, ErrorCode.INVALID_REQUEST)):
        with pytest.raises(QueryError) as error:
            deltalog.resolve(spark, uri, version)
        assert error.value.code is code
    with pytest.raises(QueryError) as error:
        deltalog.resolve(spark, two_commits.root, allow={two_commits.root}, deny={two_commits.root})
    assert error.value.code is ErrorCode.ACCESS_DENIED
    assert bootstrap_table(spark, two_commits.root) == {"uri": two_commits.root, "version": 2, "active_files": 2}


def test_unsafe_partition_values_keep_their_files(spark):
    rows = spark.createDataFrame([(1, 2024), (2, 2025)], "id int, Year int")
    t = DeltaFixture(spark, scratch(spark, "a3"), rows.schema.json(), ("Year",))
    t.commit(*t.add(rows.where("id = 1"), {"Year": "02024"}), *t.add(rows.where("id = 2"), {"Year": "2025"}))
    got, result = ask(spark, t, "SELECT id FROM lake_table WHERE year = 2024")
    assert got == [(1,)] and result.metrics.files_touched == 1
    assert ask(spark, t, 'SELECT COUNT(*) AS n FROM lake_table WHERE "Year" >= 2025')[1].metrics.files_touched == 2


def test_trace(spark, partitioned):
    session = LakeSession(spark)
    session.open_delta(partitioned.root)
    kinds = dict((k, v) for k, v in session.trace("SELECT id FROM lake_table WHERE category = 'A' AND value > 3 AND length(category) = 1"))
    assert set(kinds.values()) <= {"exact", "inexact", "unsupported"} and kinds


def test_pages_limits_and_explain(spark, two_commits):
    got, result = ask(spark, two_commits, "SELECT id FROM lake_table ORDER BY id DESC LIMIT 5", page=ResultPage(2, 1), include_explain=True)
    assert got == [(5,), (4,)] and any("Physical Plan" in line for line in result.explain)
    for bad in ((0, 0), (502, 0), (1, -1)):
        with pytest.raises(QueryError):
            ResultPage(*bad)
    session = LakeSession(spark)
    session.open_delta(two_commits.root)
    for limits in (RuntimeLimits(max_scan_bytes=1), RuntimeLimits(max_result_rows=2)):
        with pytest.raises(QueryError) as error:
            session.execute("SELECT id FROM lake_table", options=QueryOptions(limits=limits))
        assert error.value.code is ErrorCode.RESOURCE_EXHAUSTED
    assert session.dispose("lake_table") and not session.dispose("lake_table")


def test_cache_evicts_the_least_recent(spark, two_commits, partitioned):
    session = LakeSession(spark, cache_bytes=1)
    session.open_delta(two_commits.root, name="a")
    session.open_delta(partitioned.root, name="b")
    assert list(session.tables) == ["b"]


def test_cursor_preview_and_pages(spark):
    from tidelake.streaming.cursor import ArrowCursor, arrow_bytes, pages, preview

    df = spark.range(10_000).select("id", F.concat(F.lit("row "), "id").alias("name"))
    chunks = list(ArrowCursor(df, chunk_bytes=16_384))
    assert [c.phase for c in (chunks[0], chunks[-1])] == ["schema", "end"] and len(chunks) > 5
    assert pa.ipc.open_stream(b"".join(c.data for c in chunks)).read_all().num_rows == 10_000
    assert pa.ipc.open_stream(arrow_bytes(df.limit(0))).read_all().num_rows == 0
    with pytest.raises(QueryError):
        arrow_bytes(df, RuntimeLimits(max_result_rows=10))
    cursor = ArrowCursor(df)
    it = iter(cursor)
    next(it)
    cursor.cancel()
    with pytest.raises(QueryError):
        list(it)
    assert preview(df, 3).truncated and preview(df.limit(2), 3).rows == [["0", "row 0"], ["1", "row 1"]]
    assert [(len(r), more) for r, more in pages(df.limit(7), 3)] == [(3, True), (3, True), (1, False)]


def test_history_and_text(spark, two_commits):
    assert [(r.version, r.added) for r in deltalog.history(spark, two_commits.root).orderBy("version").collect()] == [(0, 0), (1, 1), (2, 1)]
    assert "secret" not in redacted("https://user:secret@x/y?X-Amz-Signature=secret&sig=secret")
    assert similar_pattern("a%_.") == r"(?s)^(?:a.*.\.)$"
    assert to_spark("SELECT a FROM t WHERE b SIMILAR TO 'x%' ;").endswith("RLIKE  r'(?s)^(?:x.*)$'")


def test_many_partitions_read_with_one_reader(spark):
    import tidelake.operators.session as module

    rows = spark.createDataFrame([(k, k % 5) for k in range(20)], "id int, part int")
    t = DeltaFixture(spark, scratch(spark, "many"), rows.schema.json(), ("part",))
    t.commit(*[a for p in range(5) for a in t.add(rows.where(F.col("part") == p), {"part": str(p)})])
    old, module.LITERAL_TUPLES = module.LITERAL_TUPLES, 2
    try:
        assert ask(spark, t, "SELECT part, COUNT(*) AS n FROM lake_table WHERE part > 1 GROUP BY part ORDER BY part")[0] == [(2, 4), (3, 4), (4, 4)]
    finally:
        module.LITERAL_TUPLES = old


@pytest.mark.parametrize(
    "sql, n",
    [
        ("SELECT COUNT(*) AS n FROM (SELECT CAST(rand(1) * 0 + 1 AS INT) AS value FROM lake_table) t WHERE value < 5", 6),
        ("SELECT COUNT(*) AS n FROM (SELECT value AS id, CAST(rand(1) * 0 AS INT) AS z FROM lake_table) t WHERE id >= 40 AND z = 0", 3),
        ("SELECT COUNT(*) AS n FROM (SELECT id AS value, value AS id FROM lake_table) t WHERE value >= 5", 2),
        ("SELECT COUNT(*) AS n FROM (SELECT 1 AS category, id FROM lake_table) t WHERE category = 1 AND id > 2", 4),
    ],
)
def test_aliases_are_not_the_columns_that_they_hide(spark, two_commits, partitioned, sql, n):
    for table in (two_commits, partitioned):
        assert ask(spark, table, sql)[0] == [(n,)]


def test_dates_and_strings_skip_files(spark):
    rows = spark.sql("SELECT id, date_add(DATE '2024-01-01', CAST(id AS INT)) AS day, concat('n', lpad(id, 3, '0')) AS name FROM range(40)").selectExpr("CAST(id AS INT) AS id", "day", "name")
    t = DeltaFixture(spark, scratch(spark, "dates"), rows.schema.json())
    t.commit(*[a for k in range(4) for a in t.add(rows.where(f"id DIV 10 = {k}"), kinds=("date", "string"))])
    for sql, n, touched in (("day >= DATE '2024-01-25'", 16, 2), ("day = DATE '2024-01-05'", 1, 1), ("name < 'n005'", 5, 1), ("name IN ('n011', 'n039')", 2, 2), ("DATE '2023-01-01' > day", 0, 0), ("upper(name) < 'A'", 0, 4)):
        got, result = ask(spark, t, f"SELECT id FROM lake_table WHERE {sql}")
        assert (len(got), result.metrics.files_touched) == (n, touched), sql


def test_similar_to_patterns(spark):
    session = LakeSession(spark)
    values = ["O'Neil", "OxNeil", "a%b", "axb", "line\nbreak", "50%", "501", "[x]", "a.c"]
    session.register("lake_table", [(v,) for v in values], "v string")
    for pattern, wanted in (("'O''Neil'", {"O'Neil"}), ("'a[%]b'", {"a%b"}), ("'line%break'", {"line\nbreak"}), ("'50!%' ESCAPE '!'", {"50%"}), ("'50_'", {"50%", "501"}), ("'(a.c|axb)'", {"a.c", "axb"}), ("'![x!]' ESCAPE '!'", {"[x]"}), ("'[^a-z]x]'", {"[x]"})):
        assert {r.v for r in session.execute(f"SELECT v FROM lake_table WHERE v SIMILAR TO {pattern}").frame.collect()} == wanted, pattern


def test_narrow_filters_and_names(spark):
    from tidelake.plans.lowering import Condition, lowered

    plan = lowered(spark, "SELECT t.a AS x, b FROM t WHERE 5 >= a AND t.b IN ('u', 'v') AND c IS NOT NULL AND d = FALSE ORDER BY x DESC, b LIMIT 7", "t")
    assert plan.filters == (Condition("compare", "a", "lte", (5,)), Condition("in_list", "b", None, ("u", "v")), Condition("is_not_null", "c"), Condition("compare", "d", "eq", (False,)))
    assert plan.order_by == (("x", True), ("b", False)) and plan.limit == 7 and plan.required == ("a", "b", "c", "d")
    for sql in ("SELECT a FROM t WHERE a NOT IN (1)", "SELECT a FROM t WHERE a BETWEEN 1 AND 2", "SELECT a FROM t WHERE a = 1.5", "SELECT * FROM t", "SELECT COUNT(DISTINCT a) AS n FROM t", "SELECT SUM(a) FROM t", "SELECT a, SUM(b) AS s FROM t", "SELECT q.n FROM (SELECT COUNT(*) AS n FROM t) q", "SELECT a FROM t LIMIT 1 + 1"):
        with pytest.raises(QueryError):
            lowered(spark, sql, "t")


def test_sessions_reuse_and_release_snapshots(spark):
    t = DeltaFixture(spark, scratch(spark, "reuse"), frame(spark, ROWS).schema.json())
    t.commit(*t.add(frame(spark, ROWS[:3])))
    session = LakeSession(spark)
    first = session.open_delta(t.root)
    assert session.open_delta(t.root) is first and session.open_delta(t.root, 0) is first
    t.commit(*t.add(frame(spark, ROWS[3:])))
    second = session.open_delta(t.root)
    assert second.version == 1 and session.execute("SELECT COUNT(*) AS n FROM lake_table").frame.first().n == 6
    assert second.cached.storageLevel.useMemory and session.dispose("lake_table") and not second.cached.storageLevel.useMemory
