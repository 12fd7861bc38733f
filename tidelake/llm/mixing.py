"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. The
expected copies are summed along the documents of the source; one offset per
source is added; a document is emitted once for every whole number that the sum
passes within it. Documents are ordered by size, so that the copies follow the
source's size distribution and the words taken come near the target.

The running sum is distributed: documents are numbered within groups of one
source, one size class and one salt, and the groups' first numbers come from a
running sum over their counts, blocks of groups first. Big groups get more salts.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; sources without words get target 0. Documents without words are
never part of a mix. Repeated rows are sampled one by one. An empty table gives
an empty mix. Only the three named columns are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.common import WORD, as_table, skew_join, starts


@dataclass(frozen=True)
class MixConfig:
    #: Weights of the sources in code point order, repeating.
    weights: tuple[int, ...] = (5, 2, 1)
    #: Size of the mix in relation to all sizes, and the most that a source may be repeated.
    share: float = 1.5
    most: float = 2.0
    #: Documents of one source and size class that are numbered together.
    group_rows: int = 250


def source_targets(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """source_key, source_size, target: shares by weight, excess over the caps shared out again.

    One row per source passes through one task here; documents don't.
    """
    totals = sizes.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(config.weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(config.weights))) + 1).cast("int")).cast("double")
    everyone = Window.partitionBy()
    t = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(config.most))
    t = t.withColumn("fill", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    free = F.sum("source_size").over(everyone).cast("double") * F.lit(config.share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = free / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", level)
    t = t.withColumn("water", F.max(F.when(F.col("fill") >= F.col("level"), F.col("level"))).over(everyone))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return t.select("source_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", config: MixConfig = MixConfig()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every document."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words.alias("size"))
    power = F.length(F.bin("size")) - 1
    step = F.when(F.col("size") == 0, F.lit(-1)).otherwise(power * 4 + F.floor(F.col("size") * 4 / F.pow(F.lit(2.0), power)).cast("int") - 4)
    rows = rows.select("*", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("source_key"), step.cast("int").alias("class"))
    rows = as_table(rows, "mix-sizes")
    sources = as_table(source_targets(rows, config), "mix-sources")

    classes = rows.groupBy("source_key", "class").agg(F.ceil(F.count("*") / F.lit(config.group_rows)).alias("salts"))
    share = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 7), 16, 10).cast("long")
    salted = skew_join(rows, classes, ["source_key", "class"]).withColumn("salt", F.pmod(share, F.col("salts")).cast("int")).drop("salts")
    salted = as_table(salted, "mix-salted")
    counts = salted.groupBy("source_key", "class", "salt").agg(F.count("*").alias("n"))
    counts = starts(counts, ["source_key", "class"], "salt", "first", (F.col("class").desc(),))
    offset = F.conv(F.substring(F.md5("source_key"), 1, 3), 16, 10).cast("double") / 4096
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    firsts = counts.join(sources, "source_key").select("source_key", "class", "salt", "first", "source_size", "target", ratio.alias("ratio"), offset.alias("offset"))

    within = Window.partitionBy("source_key", "class", "salt").orderBy(F.col("size").desc(), "doc_id")
    numbered = salted.withColumn("n", F.row_number().over(within))
    placed = skew_join(numbered, firsts, ["source_key", "class", "salt"]).withColumn("rank", F.col("first") + F.col("n"))
    crossed = F.floor(F.col("offset") + F.col("rank") * F.col("ratio")) - F.floor(F.col("offset") + (F.col("rank") - 1) * F.col("ratio"))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(crossed).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_sql(config: MixConfig = MixConfig(), docs: str = "documents") -> str:
    """The same rows in DuckDB's SQL."""
    weights = ", ".join(map(str, config.weights))
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS source_key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM {docs}),
classed AS (
  SELECT *, CASE WHEN size = 0 THEN -1
    ELSE (length(bin(size)) - 1) * 4 + CAST(floor(size * 4 / pow(2.0, length(bin(size)) - 1)) AS INT) - 4 END AS class
  FROM sized),
totals AS (
  SELECT source, source_key, CAST(sum(size) AS BIGINT) AS source_size FROM classed GROUP BY source, source_key),
weighed AS (
  SELECT *, CAST(([{weights}])[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(config.weights)} + 1 AS INT)] AS DOUBLE) AS weight,
         source_size * CAST({config.most} AS DOUBLE) AS cap
  FROM totals),
levels AS (
  SELECT *, cap / weight AS fill,
    (CAST(sum(source_size) OVER () AS DOUBLE) * {config.share}
       - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER ()
       - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
water AS (SELECT *, max(CASE WHEN fill >= level THEN level END) OVER () AS water FROM levels),
targets AS (
  SELECT source_key, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM water),
classes AS (
  SELECT source_key, class, CAST(ceil(count(*) / CAST({config.group_rows} AS DOUBLE)) AS BIGINT) AS salts FROM classed GROUP BY ALL),
salted AS (
  SELECT c.*, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7)) AS BIGINT) % salts AS salt
  FROM classed c JOIN classes USING (source_key, class)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY class DESC, salt, size DESC, doc_id) AS rank FROM salted),
placed AS (
  SELECT doc_id, size, source_size, target, rank,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio,
    CAST(('0x' || substr(md5(source_key), 1, 3)) AS BIGINT) / CAST(4096 AS DOUBLE) AS shift
  FROM ranked JOIN targets USING (source_key)),
counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0
    ELSE CAST(floor(shift + rank * ratio) - floor(shift + (rank - 1) * ratio) AS BIGINT) END AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM counted
"""
