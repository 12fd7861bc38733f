"""Helpers that the corpus operators share: shared tables, hashing, skew-safe joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LOCAL_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: ``[^\x20\x09-\x0D]+``: a word, wherever words are counted or shingled.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Words in a shingle, and the least Jaccard similarity of near copies.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (tests) gets a temporary
    folder; a cluster session raises, as no machine-local folder would do.
    """
    conf = spark.sparkContext.getConf()
    configured = conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="tidelake-")
    return _LOCAL_FALLBACK[app]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def ship() -> None:
    """Make the session fit for this package's Python functions.

    Its executors get the package, once. Arrow batches are bound to a few megabytes where the session
    has Spark's default: a batch is held in the JVM and in the worker, several times over.
    """
    spark = SparkSession.active()
    context = spark.sparkContext
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "4m")
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tidelake-")) / f"{root.name}-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def trim() -> None:
    """Give a Python worker's freed memory back to the system: workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def as_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row (a SQL ``let``)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of ``text``; none for null or blank text."""
    spaced = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, GAP, -1))


def shingles_of(words: Column) -> Column:
    """64-bit hashes of the five-word shingles of an array of words; a shorter one is one shingle."""
    last = F.greatest(F.size(words) - F.lit(SHINGLE_WORDS), F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(SHINGLE_WORDS)]),
    )


def shingle_hashes(text: Column) -> Column:
    return bind(words_of(text), shingles_of)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` so that adaptive execution can split a hot key.

    The join also compares a hash of the keys. The hash makes both sides pass
    through an exchange of the join's own, even where one side is an aggregate
    that is already dealt by ``keys``; only such joins can be split at run time.
    """
    extra = "_deal"
    a = left.withColumn(extra, F.xxhash64(*keys, F.lit(1)))
    b = right.withColumn(extra, F.xxhash64(*keys, F.lit(1)))
    return a.join(b, [*keys, extra], how).drop(extra)


def whole_row(df: DataFrame) -> Column:
    """The row as one struct, so that working columns can't clash with the input's names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def starts(counts: DataFrame, within: list[str], group: str, first: str, order: tuple[Column, ...] = (), block: int = 1000) -> DataFrame:
    """``counts`` (keys, ``group``, n) with ``first``: the rows in groups before each one.

    Groups of one ``within[0]`` are ordered by ``order`` (the other keys), then by their number.
    Groups are summed in blocks first, so that one task orders blocks, not groups.
    """
    blocked = counts.withColumn("_block", F.floor(F.col(group) / F.lit(block)))
    before = Window.partitionBy(*within, "_block").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    inner = blocked.withColumn("_inner", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = blocked.groupBy(*within, "_block").agg(F.sum("n").alias("_sum"))
    ahead = Window.partitionBy(within[0]).orderBy(*order, "_block").rowsBetween(Window.unboundedPreceding, -1)
    outer = sums.select(*within, "_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_outer"))
    return inner.join(outer, [*within, "_block"]).withColumn(first, F.col("_outer") + F.col("_inner")).drop("_block", "_inner", "_outer")


def fold_of(doc_id: Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def hash_share(key: Column, salt: str) -> Column:
    """A number in [0, 1) fixed by ``key`` and ``salt``."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
