"""A training corpus from raw documents, stage by stage.

``run`` writes each stage's rows as Parquet in the shared folder and hands them
to the next. All stages but the last return the columns of ``documents``, and
any others that they are given: working columns never take an input's name.

Defined results, for every stage: an empty table gives an empty one. A null id
is an id like any other, but for near duplicates, which keep all its rows. A
null text has no letter, so the first stage drops it; later stages take it as
empty. Repeated rows stay repeated until near duplicates keep one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import as_table, fold_of, load, whole_row
from tidelake.llm.langid import fit_languages
from tidelake.llm.mixing import mix
from tidelake.llm.neardup import drop_near_duplicates
from tidelake.llm.packing import PackingConfig, pack_documents
from tidelake.llm.queries import tokenizer_file
from tidelake.llm.secrets import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: texts without a letter go, and those that no codeword decodes."""
    model = fit_languages(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    return docs.where(~model.column(F.col("text"))["rejected"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets masked in their texts."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that repeat an id and its text are one document."""
    name = F.concat(F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")), F.lit("t"), F.md5(F.coalesce("text", F.lit(""))))
    keyed = docs.select(name.alias("key"), F.col("text"), F.col("source"), whole_row(docs).alias("row"))
    taken = mix(keyed, key="key").groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
    taken = as_table(taken.where("copies > 0"), "stage-copies")
    keyed = keyed.select("key", "row")
    drawn = keyed.join(taken.where("rows = 1"), "key")
    repeated = taken.where("rows > 1")
    if not repeated.isEmpty():
        drawn = drawn.unionByName(keyed.join(repeated, "key").dropDuplicates(["key"]))
    each = drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences. Its workers have run the other stages too, so they remember fewer words."""
    return pack_documents(docs, tokenizer_file(), config=PackingConfig(cached_words=100_000))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Tokens and signatures have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = as_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
