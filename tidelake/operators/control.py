"""Checks around a query: configuration, snapshot identity, the narrow target's budget, deadlines."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.contract import ErrorCode, FallbackReason, QueryError, Target, invalid
from tidelake.plans.errors import as_query_error
from tidelake.sources.deltalog import Snapshot, normal_uri

#: Seconds that a query may run where nothing else is said.
DEADLINE = 120.0


@dataclass(frozen=True)
class RuntimeConfig:
    target_partitions: int = 1
    batch_rows: int = 4096
    request_timeout: float = 30.0
    execution_timeout: float = DEADLINE
    cache_bytes: int | None = None
    #: What a scan of the narrow target may hold; more goes to the native one.
    narrow_rows: int = 1_000_000
    narrow_bytes: int = 256 << 20

    def __post_init__(self):
        if self.target_partitions < 1 or self.batch_rows < 1:
            raise invalid("partitions and batch rows must be 1 or more")
        if self.request_timeout <= 0 or self.execution_timeout <= 0:
            raise invalid("timeouts must be above 0")
        if self.cache_bytes is not None and self.cache_bytes < 0:
            raise invalid("the cache can't be negative")
        if self.narrow_rows < 0 or self.narrow_bytes < 0:
            raise invalid("the narrow target's budget can't be negative")


def same_snapshot(snapshot: Snapshot, uri: str, version: int | None) -> None:
    """Raise unless ``snapshot`` is the one that a request names."""
    if snapshot.uri != normal_uri(uri):
        raise invalid(f"the snapshot is of {snapshot.uri}, not of {normal_uri(uri)}")
    if version is not None and snapshot.version != version:
        raise invalid(f"the snapshot has version {snapshot.version}, not {version}")


def within_narrow_budget(files: DataFrame, max_rows: int, max_bytes: int) -> None:
    """Ask for the native target if the files hold more rows (where the log counts them) or bytes."""
    rows = F.get_json_object("stats", "$.numRecords").try_cast("long")
    sums = files.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    for used, most, what in ((sums["rows"], max_rows, "rows"), (sums["bytes"], max_bytes, "bytes")):
        if used > most:
            raise QueryError(ErrorCode.FALLBACK_REQUIRED, f"the scan holds {used} {what}; the narrow target takes {most}", Target.NARROW, FallbackReason.BROWSER_RUNTIME_CONSTRAINT)


def collect_within(df: DataFrame, seconds: float = DEADLINE) -> list:
    """``df.collect()``, stopped after ``seconds``; then an error that names the deadline."""
    context, tag, late, done = df.sparkSession.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        # Again and again: at the deadline the query's next job may not have begun.
        if not done.wait(seconds):
            late.set()
            while not done.wait(0.2):
                context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    threading.Thread(target=stop, daemon=True).start()
    try:
        rows = df.collect()
    except Exception as error:
        if late.is_set():
            raise QueryError(ErrorCode.EXECUTION_FAILED, f"the query ran longer than {seconds:g} s") from error
        raise as_query_error(error) if isinstance(error, PySparkException) else error
    finally:
        done.set()
        context.removeJobTag(tag)
    return rows
