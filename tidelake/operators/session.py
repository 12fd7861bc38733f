"""The lake session: open tables, run gated SQL on them, page, explain and measure.

A session has Spark state of its own, so its views and settings don't touch the
caller's. Open Delta tables are pinned snapshots; a query on one is planned
twice: first over a probe that has the table's schema, to learn which filters
reach the scan, then over the files that those filters leave.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.contract import (
    CapabilityKey,
    CapabilityState,
    ErrorCode,
    FallbackReason,
    QueryError,
    QueryOptions,
    QueryRequest,
    QueryResult,
    Resource,
    ResultPage,
    RuntimeLimits,
    ScanMetrics,
    Target,
    invalid,
)
from tidelake.operators import control
from tidelake.operators.control import RuntimeConfig
from tidelake.plans import gate, jvm
from tidelake.plans.errors import mapped
from tidelake.plans.lowering import lowered, run_by_native
from tidelake.plans.pruning import kept_files, pushdown_trace, scan_filters
from tidelake.plans.sqltext import to_spark
from tidelake.sources import deltalog

DEFAULT_TABLE = "lake_table"
#: Partition tuples up to which each gets a reader of its own with literal values.
LITERAL_TUPLES = 200


@dataclass
class OpenTable:
    name: str
    uri: str
    snapshot: deltalog.Snapshot | None
    frame: DataFrame | None
    bytes: int


class LakeSession:
    def __init__(self, spark: SparkSession, limits: RuntimeLimits | None = None, cache_bytes: int | None = None, config: RuntimeConfig | None = None):
        self.spark = spark.newSession()
        self.config = config or RuntimeConfig(cache_bytes=cache_bytes)
        cache_bytes = self.config.cache_bytes if cache_bytes is None else cache_bytes
        for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold"):
            self.spark.conf.set(key, spark.conf.get(key))
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        self.limits, self.cache_bytes = limits, cache_bytes
        self.tables: OrderedDict[str, OpenTable] = OrderedDict()
        #: The files that the last query's scans of a table can need.
        self.kept: dict[str, DataFrame] = {}

    # ------------------------------------------------------------ tables

    def open_delta(self, uri: str, version: int | None = None, name: str = DEFAULT_TABLE, allow: set[str] | None = None, deny: set[str] | None = None) -> deltalog.Snapshot:
        """Pin a snapshot under ``name``; an equal one that is open already is reused."""
        clean = deltalog.normal_uri(uri)
        held = self.tables.get(name)
        if held and held.snapshot and held.snapshot.uri == clean and not allow and not deny:
            with mapped():
                wanted = deltalog.latest_version(clean, deltalog.log_listing(self.spark, clean)) if version is None else version
            if held.snapshot.version == wanted:
                self.tables.move_to_end(name)
                return held.snapshot
        with mapped():
            snapshot = deltalog.resolve(self.spark, clean, version, allow, deny)
            size = snapshot.files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        self._hold(OpenTable(name, clean, snapshot, None, size))
        return snapshot

    def open_parquet(self, name: str, *paths: str) -> DataFrame:
        """A Parquet dataset under ``name``; it has no log, and version 0."""
        with mapped():
            frame = self.spark.read.parquet(*paths)
        self._hold(OpenTable(name, ",".join(paths), None, frame, 0))
        return frame

    def register(self, name: str, data, schema: T.StructType | None = None) -> DataFrame:
        """An in-memory table (Arrow table, pandas frame or rows)."""
        frame = self.spark.createDataFrame(data, schema) if schema is not None else self.spark.createDataFrame(data)
        self._hold(OpenTable(name, f"memory:{name}", None, frame, 0))
        return frame

    def _hold(self, table: OpenTable) -> None:
        self.dispose(table.name)
        self.tables[table.name] = table
        if table.frame is not None:
            table.frame.createOrReplaceTempView(table.name)
        while self.cache_bytes is not None and len(self.tables) > 1 and sum(t.bytes for t in self.tables.values()) > self.cache_bytes:
            self.dispose(next(iter(self.tables)))

    def dispose(self, name: str) -> bool:
        table = self.tables.pop(name, None)
        if table is None:
            return False
        self.spark.catalog.dropTempView(name)
        if table.snapshot is not None:
            table.snapshot.release()
        return True

    def catalog(self) -> DataFrame:
        """table_name, column_name, data_type, nullable, position of the open tables."""
        rows = []
        for name, t in self.tables.items():
            fields = (t.snapshot.schema if t.snapshot else t.frame.schema).fields
            rows += [(name, f.name, f.dataType.simpleString(), f.nullable, k) for k, f in enumerate(fields)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean, position int")

    # ------------------------------------------------------------ scans

    def _scan(self, snapshot: deltalog.Snapshot, files: list) -> DataFrame:
        """The rows of ``files``, partition columns from the log."""
        keys = snapshot.partition_columns
        data = T.StructType([f for f in snapshot.schema if f.name not in keys])
        if not files:
            return self.spark.createDataFrame([], snapshot.schema)

        def full(path: str) -> str:
            return path if "://" in path else f"{snapshot.uri}/{unquote(path)}"

        def typed(value, name: str):
            return F.lit(value).cast(snapshot.schema[name].dataType).alias(name)

        groups: dict[tuple, list[str]] = {}
        for f in files:
            groups.setdefault(tuple((f["partitionValues"] or {}).get(k) for k in keys), []).append(full(f["path"]))
        names = [F.col(f"`{f.name}`") for f in snapshot.schema]
        if len(groups) <= LITERAL_TUPLES:
            out = None
            for values, paths in groups.items():
                own = self.spark.read.schema(data).parquet(*paths).select("*", *[typed(v, k) for v, k in zip(values, keys)]).select(names)
                out = own if out is None else out.unionAll(own)
            return out
        rows = [(full(f["path"]), *[(f["partitionValues"] or {}).get(k) for k in keys]) for f in files]
        marks = self.spark.createDataFrame(rows, T.StructType([T.StructField("_file", T.StringType()), *[T.StructField(f"_p{i}", T.StringType()) for i in range(len(keys))]]))
        place = F.regexp_replace("_metadata.file_path", "^file:/+", "file:///")
        whole = self.spark.read.schema(data).parquet(*[p for own in groups.values() for p in own]).withColumn("_file", place)
        values = [F.col(f"_p{i}").cast(snapshot.schema[k].dataType).alias(k) for i, k in enumerate(keys)]
        return whole.join(marks, "_file").select("*", *values).select(names)

    def _plan(self, sql: str) -> tuple[DataFrame, ScanMetrics, list]:
        """The query over pruned scans, what the scans read, and the filters' trace."""
        text = to_spark(sql)
        touched = skipped = size = 0
        traces = []
        for table in self.tables.values():
            if table.snapshot is None:
                continue
            snapshot = table.snapshot
            one = snapshot.files.limit(1).collect()
            if not one:
                self._scan(snapshot, []).createOrReplaceTempView(table.name)
                continue
            # A scan of one file with the whole schema, partition columns included, for planning only.
            path = one[0]["path"]
            probe = self.spark.read.schema(snapshot.schema).parquet(path if "://" in path else f"{snapshot.uri}/{unquote(path)}")
            probe.createOrReplaceTempView(table.name)
        if any(t.snapshot for t in self.tables.values()):
            planned = self.spark.sql(text)
            for table in self.tables.values():
                if table.snapshot is None:
                    continue
                scans = scan_filters(planned, {f.name.lower() for f in table.snapshot.schema})
                self.kept[table.name] = kept_files(table.snapshot, scans)
                kept = self.kept[table.name].collect()
                traces += pushdown_trace(table.snapshot, scans)
                touched += len(kept)
                size += sum(f["size"] or 0 for f in kept)
                skipped += table.snapshot.files.count() - len(kept)
                self._scan(table.snapshot, kept).createOrReplaceTempView(table.name)
        return self.spark.sql(text), ScanMetrics(touched, skipped, size), traces

    # ------------------------------------------------------------ queries

    def frame(self, sql: str) -> DataFrame:
        """A query over any of the session's tables, without the one-table gate."""
        with mapped():
            return self._plan(sql)[0]

    def execute(self, sql: str, table: str = DEFAULT_TABLE, options: QueryOptions = QueryOptions(), target: Target = Target.NATIVE) -> QueryResult:
        """A gated query over one open table."""
        if table not in self.tables:
            raise QueryError(ErrorCode.INVALID_REQUEST, f"{table} isn't open", target)
        gate.check(self.spark, sql, {table}, target)
        self.tables.move_to_end(table)
        limits = (self.limits or RuntimeLimits()).within(options.limits)
        with mapped(target):
            df, metrics, _ = self._plan(sql)
            opened = self.tables[table].snapshot
            if target is Target.NARROW:
                fields = opened.schema if opened else self.tables[table].frame.schema
                run_by_native(lowered(self.spark, sql, table), {f.name.lower(): f.dataType.simpleString() for f in fields})
                if opened:
                    control.within_narrow_budget(self.kept[table], self.config.narrow_rows, self.config.narrow_bytes)
            if opened and target is not Target.NATIVE:
                require(opened.capabilities, options.needs, target)
            if limits.max_scan_bytes is not None and metrics.bytes_planned > limits.max_scan_bytes:
                raise QueryError(ErrorCode.RESOURCE_EXHAUSTED, f"the scan needs {metrics.bytes_planned} bytes; the limit is {limits.max_scan_bytes}", target, resource=Resource.SCAN_BYTES)
            if options.page:
                df = page(df, options.page)
            if limits.max_result_rows is not None and len(df.limit(limits.max_result_rows + 1).select(F.lit(1)).collect()) > limits.max_result_rows:
                raise QueryError(ErrorCode.RESOURCE_EXHAUSTED, f"the result has more than {limits.max_result_rows} rows", target, resource=Resource.RESULT_OUTPUT)
            explain = jvm.explained(df) if options.include_explain else []
        names = [c.lower() for c in df.columns]
        if target is Target.NARROW and len(set(names)) < len(names):
            raise invalid("two outputs have the same name", target)
        snapshot = self.tables[table].snapshot
        return QueryResult(df, metrics if options.collect_metrics else None, explain, dict(snapshot.capabilities) if snapshot else {})

    def explain(self, sql: str) -> list[str]:
        return jvm.explained(self.frame(sql))

    def trace(self, sql: str) -> list[tuple[str, str]]:
        """How each filter over a scan can be judged from the log."""
        with mapped():
            return self._plan(sql)[2]


def page(df: DataFrame, wanted: ResultPage) -> DataFrame:
    """One page of a result, after the query's own limit and offset."""
    return df.offset(wanted.offset).limit(wanted.limit) if wanted.offset else df.limit(wanted.limit)


def execute_query(spark: SparkSession, request: QueryRequest, config: RuntimeConfig | None = None) -> QueryResult:
    """One query on one table: open the snapshot, gate, prune, plan."""
    if request.options.limits is not None and request.preferred_target is Target.NATIVE:
        raise invalid("the native target takes no runtime limits")
    session = LakeSession(spark, config=config)
    snapshot = session.open_delta(request.table_uri, request.snapshot_version)
    control.same_snapshot(snapshot, request.table_uri, request.snapshot_version)
    try:
        return session.execute(request.sql, options=request.options, target=request.preferred_target)
    finally:
        snapshot.release()  # the query's scans hold the files that they need


def collect_query(spark: SparkSession, request: QueryRequest, config: RuntimeConfig | None = None) -> list:
    """The rows of ``execute_query``, within the configured execution time."""
    config = config or RuntimeConfig()
    return control.collect_within(execute_query(spark, request, config).frame, config.execution_timeout)


def bootstrap_table(spark: SparkSession, uri: str) -> dict:
    snapshot = deltalog.resolve(spark, uri)
    try:
        return {"uri": snapshot.uri, "version": snapshot.version, "active_files": snapshot.files.count()}
    finally:
        snapshot.release()


def measured(frame: DataFrame) -> ScanMetrics:
    """What the scans of a query that has run did read, and the rows that they gave, from its executed plan."""
    files = size = rows = 0
    for metrics in jvm.scans_run(frame):
        files += metrics.get("numFiles", 0)
        size += metrics.get("filesSize", 0)
        rows += metrics.get("numOutputRows", 0)
    return ScanMetrics(files, 0, size, rows)


def require(capabilities: dict[CapabilityKey, CapabilityState], needed: set[CapabilityKey], target: Target = Target.SESSION) -> None:
    """Raise for a needed capability that isn't supported: an error, or a fallback where another target may have it."""
    for key in sorted(needed, key=lambda k: k.value):
        state = capabilities.get(key, CapabilityState.UNSUPPORTED)
        if state is CapabilityState.UNSUPPORTED:
            raise QueryError(ErrorCode.UNSUPPORTED_FEATURE, f"{key.value} isn't supported", target, capability=key)
        if state is not CapabilityState.SUPPORTED:
            raise QueryError(ErrorCode.FALLBACK_REQUIRED, f"{key.value} is {state.value}", target, FallbackReason.CAPABILITY_GATE, key)

