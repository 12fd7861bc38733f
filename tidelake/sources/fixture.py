"""Small Delta tables for tests and examples. The engine itself writes no tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.plans import jvm

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder path in the shared folder; local sessions without one use a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidelake-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


@dataclass
class DeltaFixture:
    """A table under construction: each ``commit`` is one version."""

    spark: SparkSession
    root: str
    schema: str
    partition_columns: tuple[str, ...] = ()
    properties: dict = field(default_factory=dict)
    protocol: dict = field(default_factory=lambda: {"minReaderVersion": 1, "minWriterVersion": 1})
    version: int = -1
    active: dict = field(default_factory=dict)

    def metadata(self) -> dict:
        return {"id": "fixture", "format": {"provider": "parquet", "options": {}}, "schemaString": self.schema, "partitionColumns": list(self.partition_columns), "configuration": self.properties}

    def add(self, df: DataFrame, partition: dict[str, str | None] | None = None, with_stats: bool = True, kinds: tuple[str, ...] = INTEGERS) -> list[dict]:
        """Write one file and return its action, with bounds of the columns of ``kinds``."""
        folder = f"data-{uuid.uuid4().hex}"
        rows = df.drop(*self.partition_columns)
        rows.coalesce(1).write.parquet(f"{self.root}/{folder}")
        found = {n: size for n, (_, size) in jvm.listing(self.spark, f"{self.root}/{folder}").items() if n.endswith(".parquet")}
        stats = None
        if with_stats:
            numbers = [c for c, kind in rows.dtypes if kind in kinds]
            s = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in numbers for k, f in (("min", F.min), ("max", F.max))]).first()
            stats = json.dumps({"numRecords": s["n"], "minValues": {c: s[f"min_{c}"] for c in numbers}, "maxValues": {c: s[f"max_{c}"] for c in numbers}}, default=str)
        return [{"add": {"path": f"{folder}/{n}", "partitionValues": partition or {}, "size": size, "modificationTime": 0, "dataChange": True, "stats": stats}} for n, size in found.items()]

    def commit(self, *actions: dict, operation: str = "WRITE") -> int:
        self.version += 1
        head = [{"commitInfo": {"timestamp": 1_700_000_000_000 + self.version, "operation": operation}}]
        if self.version == 0:
            head += [{"protocol": self.protocol}, {"metaData": self.metadata()}]
        put_text(self.spark, f"{self.root}/_delta_log/{self.version:020d}.json", "".join(json.dumps(a) + "\n" for a in [*head, *actions]))
        for a in actions:
            if "add" in a:
                self.active[a["add"]["path"]] = a["add"]
            if "remove" in a:
                self.active.pop(a["remove"]["path"], None)
        return self.version

    def state(self) -> list[dict]:
        return [{"protocol": self.protocol}, {"metaData": self.metadata()}, *[{"add": a} for a in self.active.values()]]

    def checkpoint(self, parts: int = 1, hint: bool = True) -> None:
        """A checkpoint of the current state in one or several Parquet parts."""
        from tidelake.sources.deltalog import ACTIONS

        names = [f"{self.version:020d}.checkpoint.parquet"] if parts == 1 else [f"{self.version:020d}.checkpoint.{k:010d}.{parts:010d}.parquet" for k in range(1, parts + 1)]
        lines = [json.dumps(a) for a in self.state()]
        for k, name in enumerate(names):
            own = self.spark.createDataFrame([(x,) for x in lines[k::parts]], "value string")
            self.parquet(own.select(F.from_json("value", ACTIONS).alias("a")).select("a.*"), f"_delta_log/{name}")
        if hint:
            put_text(self.spark, f"{self.root}/_delta_log/_last_checkpoint", json.dumps({"version": self.version, "size": len(lines)} | ({"parts": parts} if parts > 1 else {})))

    def parquet(self, df: DataFrame, name: str) -> None:
        """One Parquet file of that name below the root."""
        folder = f"{self.root}/tmp-{uuid.uuid4().hex}"
        df.coalesce(1).write.parquet(folder)
        file = next(full for n, (full, _) in jvm.listing(self.spark, folder).items() if n.endswith(".parquet"))
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(file).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        store.mkdirs(path(f"{self.root}/{name}").getParent())
        store.rename(path(file), path(f"{self.root}/{name}"))
        store.delete(path(folder), True)
