from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelake.contract import CapabilityKey, CapabilityState, ErrorCode, QueryError, RuntimeLimits
from tidelake.functions import columns as C
from tidelake.operators.control import RuntimeConfig, collect_within, same_snapshot, within_narrow_budget
from tidelake.operators.session import require
from tidelake.sources import deltalog
from tidelake.sources.fixture import DeltaFixture, scratch


@pytest.fixture(scope="module")
def snapshot(spark):
    rows = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    t = DeltaFixture(spark, scratch(spark, "control"), rows.schema.json())
    t.commit(*t.add(rows))
    return deltalog.resolve(spark, t.root)


def test_configuration():
    assert RuntimeConfig().target_partitions == 1
    for bad in ({"target_partitions": 0}, {"request_timeout": 0}, {"execution_timeout": -1}, {"cache_bytes": -1}):
        with pytest.raises(QueryError):
            RuntimeConfig(**bad)
    assert RuntimeLimits(5, None, 3).within(RuntimeLimits(4, 7)) == RuntimeLimits(4, 7, 3)


def test_identity_and_budget(snapshot):
    same_snapshot(snapshot, snapshot.uri + "/", 0)
    for uri, version in (("/elsewhere", 0), (snapshot.uri, 3)):
        with pytest.raises(QueryError):
            same_snapshot(snapshot, uri, version)
    within_narrow_budget(snapshot.files, 2, 1 << 20)
    for limits in ((1, 1 << 20), (10, 1)):
        with pytest.raises(QueryError) as error:
            within_narrow_budget(snapshot.files, *limits)
        assert error.value.code is ErrorCode.FALLBACK_REQUIRED


def test_capabilities(snapshot):
    require(snapshot.capabilities, {CapabilityKey.TIME_TRAVEL})
    with pytest.raises(QueryError) as error:
        require(snapshot.capabilities, {CapabilityKey.SIGNED_URL_ACCESS})
    assert not error.value.requires_fallback
    with pytest.raises(QueryError) as error:
        require({CapabilityKey.COLUMN_MAPPING: CapabilityState.NATIVE_ONLY}, {CapabilityKey.COLUMN_MAPPING})
    assert error.value.requires_fallback


def test_urls_match_one_to_one(spark, snapshot):
    path = snapshot.files.first().path
    urls = lambda *rows: spark.createDataFrame(list(rows), "path string, url string")
    assert deltalog.attach_urls(snapshot.files, urls((path, "http://x"))).first().url == "http://x"
    for rows in ([(path, "a"), (path, "b")], [("other", "a")], [(path, "a"), ("other", "b")]):
        with pytest.raises(QueryError):
            deltalog.attach_urls(snapshot.files, urls(*rows))


def test_deadline(spark):
    assert len(collect_within(spark.range(3))) == 3

    def sleep(batches):
        import time

        for batch in batches:
            time.sleep(2)
            yield batch

    slow = spark.range(0, 40, numPartitions=40).mapInPandas(sleep, "id long")
    with pytest.raises(QueryError) as error:
        collect_within(slow, 1.0)
    assert "longer" in error.value.message


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (1, 7), (1, -7)], "k int, v int")
    assert [r.v for r in df.orderBy(C.ascending("v")).collect()] == [-7, 7, None]
    assert [r.v for r in df.orderBy(C.descending("v")).collect()] == [None, 7, -7]
    assert sorted(df.groupBy("k").agg(C.array_agg("v").alias("a")).first().a, key=str) == [-7, 7, None]
    got = df.select(C.integer_divide(F.col("v"), F.lit(2)).alias("d"), C.distinct_from(F.col("v"), F.lit(7)).alias("x")).collect()
    assert [(r.d, r.x) for r in got] == [(None, True), (3, False), (-3, True)]
    assert spark.createDataFrame([("ab",), ("b",)], "s string").where(C.similar_to("s", "a_")).count() == 1


def test_overfetch_and_preview_limits(spark):
    from tidelake.contract import RuntimeLimits
    from tidelake.sources.ranges import requests, within_overfetch
    from tidelake.streaming.cursor import preview

    plan = requests([(0, 65_536), (81_920, 200_000)])
    assert within_overfetch(plan, RuntimeLimits()) == 16_384
    with pytest.raises(QueryError):
        within_overfetch(plan, RuntimeLimits(max_scan_overfetch_bytes=16_383))
    with pytest.raises(QueryError):
        requests([(5, 4)])
    frame = spark.range(5)
    assert len(preview(frame, limits=RuntimeLimits(max_preview_string_bytes=2)).rows) == 2
