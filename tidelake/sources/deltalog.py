"""Delta snapshots by replaying the transaction log with DataFrames.

The newest complete checkpoint at or below the version and the commits after it
are read with one explicit schema; the last action on a path decides whether
the file is active. Only the log's folder listing and the table's protocol and
schema come to the driver, files stay in a DataFrame.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.contract import CapabilityKey, CapabilityState, ErrorCode, QueryError, invalid
from tidelake.plans import jvm
from tidelake.sources.features import Protocol, capabilities

TEXTS = T.MapType(T.StringType(), T.StringType())
ACTIONS = T.StructType([
    T.StructField("add", T.StructType([T.StructField("path", T.StringType()), T.StructField("partitionValues", TEXTS), T.StructField("size", T.LongType()), T.StructField("stats", T.StringType()), T.StructField("deletionVector", T.StructType([T.StructField("storageType", T.StringType()), T.StructField("pathOrInlineDv", T.StringType())]))])),
    T.StructField("remove", T.StructType([T.StructField("path", T.StringType())])),
    T.StructField("protocol", T.StructType([T.StructField("minReaderVersion", T.IntegerType()), T.StructField("minWriterVersion", T.IntegerType()), T.StructField("readerFeatures", T.ArrayType(T.StringType())), T.StructField("writerFeatures", T.ArrayType(T.StringType()))])),
    T.StructField("metaData", T.StructType([T.StructField("schemaString", T.StringType()), T.StructField("partitionColumns", T.ArrayType(T.StringType())), T.StructField("configuration", TEXTS)])),
    T.StructField("sidecar", T.StructType([T.StructField("path", T.StringType())])),
])
COMMIT = re.compile(r"(\d{20})\.json")
CHECKPOINT = re.compile(r"(\d{20})\.checkpoint\.(?:(parquet)|(\d{10})\.(\d{10})\.parquet|([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\.(?:parquet|json))")


@dataclass(frozen=True)
class Snapshot:
    uri: str
    version: int
    schema: T.StructType
    partition_columns: tuple[str, ...]
    files: DataFrame  # path, size, partitionValues, stats; stored in Spark's cache
    capabilities: dict[CapabilityKey, CapabilityState]
    configuration: dict[str, str]
    cached: DataFrame | None = None  # what ``files`` reads

    def release(self) -> None:
        """Drop the file rows from Spark's cache; they are read from the log again where they are needed."""
        if self.cached is not None:
            self.cached.unpersist()

    @property
    def partition_types(self) -> dict[str, str]:
        """string, int64 or boolean; every other type is ``unsupported``."""
        kinds = {"string": "string", "boolean": "boolean", "byte": "int64", "short": "int64", "integer": "int64", "long": "int64"}
        return {c: kinds.get(self.schema[c].dataType.typeName(), "unsupported") for c in self.partition_columns}


def normal_uri(uri: str) -> str:
    clean = uri.strip().rstrip("/")
    if not clean:
        raise invalid("the table URI is empty")
    return clean if "://" in clean else "file://" + os.path.abspath(clean.removeprefix("file:"))


def checkpoints(names: list[str]) -> dict[int, list[str]]:
    """version -> the files of its complete checkpoint: single before UUID-named before multi-part."""
    single, named, parts = {}, {}, defaultdict(dict)
    for name in sorted(names):
        if m := CHECKPOINT.fullmatch(name):
            version = int(m[1])
            if m[2]:
                single[version] = [name]
            elif m[3]:
                parts[version, int(m[4])][int(m[3])] = name
            else:
                named[version] = [name]
    whole = {v: [own[k] for k in sorted(own)] for (v, n), own in sorted(parts.items()) if sorted(own) == list(range(1, n + 1))}
    return whole | named | single


def _choose(spark: SparkSession, log: dict[str, tuple[str, int]], target: int) -> tuple[int, list[str]] | None:
    """The checkpoint that the hint names, if it is there and fits, else the newest."""
    complete = {v: names for v, names in checkpoints(list(log)).items() if v <= target}
    if "_last_checkpoint" in log:
        try:
            hint = json.loads(jvm.read_text(spark, log["_last_checkpoint"][0]))
        except ValueError as error:
            raise QueryError(ErrorCode.EXECUTION_FAILED, "the _last_checkpoint hint can't be read") from error
        version = hint.get("version")
        if version in complete and hint.get("parts") in (None, len(complete[version])):
            return version, complete[version]
    return max(complete.items(), default=None)


def _sidecar(log_folder: str, path: str) -> str:
    """The sidecar's full path; it must stay in the log's sidecar folder, links included."""
    clean = unquote(path)
    if "://" in clean or clean.startswith("/") or ".." in clean.split("/") or "\\" in clean:
        raise QueryError(ErrorCode.SECURITY_POLICY_VIOLATION, f"the sidecar path {path!r} leaves the table")
    full = f"{log_folder}/_sidecars/{clean}"
    if full.startswith("file://"):
        local = full.removeprefix("file://")
        root = os.path.realpath(log_folder.removeprefix("file://")) + "/"
        if os.path.islink(local) or not os.path.realpath(local).startswith(root):
            raise QueryError(ErrorCode.SECURITY_POLICY_VIOLATION, f"the sidecar path {path!r} leaves the table")
    return full


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    reader = spark.read.schema(ACTIONS)
    return reader.json(paths) if paths[0].endswith(".json") else reader.parquet(*paths)


def _actions(spark: SparkSession, uri: str, log: dict[str, tuple[str, int]], target: int) -> DataFrame:
    folder = f"{uri}/_delta_log"
    chosen = _choose(spark, log, target)
    start, frames = 0, []
    if chosen:
        start = chosen[0] + 1
        base = _read(spark, [log[n][0] for n in chosen[1]])
        side = [r["path"] for r in base.where("sidecar is not null").select("sidecar.path").collect()]
        if side:
            base = base.unionByName(_read(spark, [_sidecar(folder, p) for p in side]))
        frames.append(base.select("*", F.lit(chosen[0]).cast("long").alias("version"), F.lit(0).cast("long").alias("line")))
    commits = {int(m[1]): log[n][0] for n in log if (m := COMMIT.fullmatch(n))}
    missing = [v for v in range(start, target + 1) if v not in commits]
    if missing:
        raise QueryError(ErrorCode.OBJECT_NOT_FOUND, f"the log lacks the commit of version {missing[0]}")
    if start <= target:
        paths = [commits[v] for v in range(start, target + 1)]
        version = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{20})", 1).cast("long")
        # Lines of a file keep their order, and so do the row numbers given to them.
        frames.append(spark.read.schema(ACTIONS).option("mode", "FAILFAST").json(paths).select("*", version.alias("version"), F.monotonically_increasing_id().alias("line")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def latest_version(uri: str, log: dict[str, tuple[str, int]] | None) -> int:
    """The newest version that a log's listing holds."""
    if not log:
        raise QueryError(ErrorCode.OBJECT_NOT_FOUND, f"{uri} isn't a Delta table")
    versions = [int(m[1]) for n in log if (m := COMMIT.fullmatch(n))] + list(checkpoints(list(log)))
    if not versions:
        raise QueryError(ErrorCode.OBJECT_NOT_FOUND, f"{uri} has no version 0")
    return max(versions)


def log_listing(spark: SparkSession, uri: str) -> dict[str, tuple[str, int]] | None:
    return jvm.listing(spark, f"{uri}/_delta_log")


def resolve(spark: SparkSession, uri: str, version: int | None = None, allow: set[str] | None = None, deny: set[str] | None = None) -> Snapshot:
    """The table at ``version`` (the latest, if None). Deny lists win over allow lists, before any read."""
    uri = normal_uri(uri)
    if version is not None and version < 0:
        raise invalid("a snapshot version can't be negative")
    if (deny and uri in {normal_uri(u) for u in deny}) or (allow is not None and uri not in {normal_uri(u) for u in allow}):
        raise QueryError(ErrorCode.ACCESS_DENIED, f"policy doesn't allow {uri}")
    log = log_listing(spark, uri)
    latest = latest_version(uri, log)
    if version is not None and version > latest:
        raise QueryError(ErrorCode.OBJECT_NOT_FOUND, f"{uri} has no version {version}")
    target = latest if version is None else version
    actions = _actions(spark, uri, log, target)
    place = F.struct("version", "line")
    heads = actions.agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in ("protocol", "metaData")]).first()
    if heads["protocol"] is None or heads["metaData"] is None:
        raise QueryError(ErrorCode.EXECUTION_FAILED, "the log has no protocol or no table metadata")
    path = F.coalesce("add.path", "remove.path")
    state = actions.where(F.col("add").isNotNull() | F.col("remove").isNotNull()).groupBy(path.alias("path")).agg(F.max_by("add", place).alias("add"))
    files = state.where("add is not null").select("path", "add.size", "add.partitionValues", "add.stats", F.col("add.deletionVector").isNotNull().alias("dv")).cache()
    p, meta = heads["protocol"], heads["metaData"]
    protocol = Protocol(p["minReaderVersion"] or 0, p["minWriterVersion"] or 0, frozenset(p["readerFeatures"] or ()), frozenset(p["writerFeatures"] or ()))
    properties = meta["configuration"] or {}
    report = capabilities(protocol, meta["schemaString"], properties, not files.where("dv").isEmpty())
    return Snapshot(uri, target, T.StructType.fromJson(json.loads(meta["schemaString"])), tuple(meta["partitionColumns"] or ()), files.drop("dv"), report, properties, files)


def attach_urls(files: DataFrame, urls: DataFrame) -> DataFrame:
    """``files`` with a ``url`` each; every path needs exactly one url and every url a path."""
    both = files.join(urls.groupBy("path").agg(F.count("*").alias("n"), F.first("url").alias("url")), "path", "full")
    if not both.where("size is null or url is null or n <> 1").isEmpty():
        raise invalid("paths and URLs don't match one to one")
    return both.drop("n")


def history(spark: SparkSession, uri: str) -> DataFrame:
    """version, timestamp, operation, added, removed of every commit in the log."""
    uri = normal_uri(uri)
    log = jvm.listing(spark, f"{uri}/_delta_log") or {}
    paths = [full for n, (full, _) in sorted(log.items()) if COMMIT.fullmatch(n)]
    if not paths:
        raise QueryError(ErrorCode.OBJECT_NOT_FOUND, f"{uri} has no commits")
    info = T.StructField("commitInfo", T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("operation", T.StringType())]))
    rows = spark.read.schema(T.StructType([*ACTIONS.fields, info])).json(paths).select("*", F.regexp_extract("_metadata.file_name", r"^(\d{20})", 1).cast("long").alias("version"))
    return rows.groupBy("version").agg(F.max("commitInfo.timestamp").alias("timestamp"), F.max("commitInfo.operation").alias("operation"), F.count("add").alias("added"), F.count("remove").alias("removed"), F.coalesce(F.sum("add.size"), F.lit(0)).alias("added_bytes"))
