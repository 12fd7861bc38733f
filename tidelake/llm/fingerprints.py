"""Document fingerprints: one-permutation MinHash in SQL functions only.

The 64-bit hashes of a text's five-word shingles are thrown into ``bins`` bins
by their top bits, and each bin keeps its least hash. Empty bins borrow: bin
``i`` takes the value of the first filled bin in a probe sequence that depends
on ``i`` alone (optimal densification). Only the low ``bits`` bits of each bin
are stored; the share of equal bins is corrected for chance agreement.

Defined results: a null text counts as empty; empty and blank texts share one
fingerprint; texts of fewer than five words are one shingle. Rows with a null
id come last in document order, and rows that share an id are ordered by text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.common import bind, shingle_hashes

LONG_MAX = (1 << 63) - 1


@dataclass(frozen=True)
class FingerprintConfig:
    #: A power of two.
    bins: int = 256
    bits: int = 4
    #: Probes before the rest of the probe sequence is searched in one step.
    probes: int = 8


def bin_minima(text: Column, config: FingerprintConfig) -> Column:
    """The least hash of each bin in bin order; an empty bin holds all ones below its number."""
    shift = 64 - (config.bins.bit_length() - 1)
    low, half = (1 << shift) - 1, config.bins // 2
    blanks = F.lit([((b - half) << shift) | low for b in range(config.bins)])

    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(ordered, i - 1), shift)))

    # With a blank in every bin, the sorted hashes show each bin's least value or its blank.
    return bind(F.sort_array(F.concat(shingle_hashes(text), blanks)), firsts)


def densified(minima: Column, config: FingerprintConfig) -> Column:
    shift = 64 - (config.bins.bit_length() - 1)
    low = F.lit((1 << shift) - 1)

    def blank(x: Column) -> Column:
        return x.bitwiseAND(low) == low

    def probe(filled: Column, turn: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            return F.when(blank(x), F.get(minima, F.pmod(F.xxhash64(i, turn), F.lit(config.bins)).cast("int"))).otherwise(x)

        return F.when(F.exists(filled, blank), F.transform(filled, at)).otherwise(filled)

    def rest(filled: Column) -> Column:
        def search(known: Column) -> Column:
            def nearest(i: Column) -> Column:
                return F.array_min(F.transform(known, lambda v: F.struct(F.xxhash64(i, F.shiftright(v, shift)).alias("o"), v.alias("v"))))["v"]

            return F.transform(filled, lambda x, i: F.when(blank(x), F.coalesce(nearest(i), F.lit(0))).otherwise(x))

        return F.when(F.exists(filled, blank), bind(F.filter(minima, lambda x: ~blank(x)), search)).otherwise(filled)

    return bind(F.aggregate(F.sequence(F.lit(1), F.lit(config.probes)), minima, probe), rest)


def sketch(text: Column, config: FingerprintConfig = FingerprintConfig()) -> Column:
    """The fingerprint as an array of small numbers, ``bits`` bits each.

    Values are hashed with their bin's number first: bins that borrowed one
    value would else agree by chance all at once.
    """
    mask = F.lit((1 << config.bits) - 1)
    return bind(bin_minima(text, config), lambda m: F.transform(densified(m, config), lambda x, i: F.xxhash64(x, i).bitwiseAND(mask).cast("tinyint")))


def packed(values: Column) -> Column:
    """The fingerprint as text: one lower-case hexadecimal digit per bin."""
    return F.lower(F.array_join(F.transform(values, lambda x: F.hex(x.cast("long"))), ""))


def likeness(a: Column, b: Column, config: FingerprintConfig = FingerprintConfig()) -> Column:
    """Estimated Jaccard similarity, from the share of equal bins less chance agreement."""
    chance = 2.0**-config.bits
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    raw = (same / F.lit(float(config.bins)) - chance) / (1 - chance)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def with_next(docs: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the row after it by ``order``, in a circle.

    Rows go to ranges of ``order`` of about equal size; the first row of a range
    is also sent, marked, to the range before it. So every range finds its
    successors alone, and no range grows beyond its share.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce(F.col(order).cast("long"), F.lit(LONG_MAX))
    marks = [k / ranges for k in range(ranges)]
    cuts = docs.agg(F.percentile_approx(place, marks, max(10_000, 20 * ranges)).alias("c"), F.min(place).alias("m")).first()
    bounds = sorted({cuts["m"], *cuts["c"]}) if cuts["m"] is not None else [0]
    found = F.lit(bounds)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    search = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(found, at + step) <= F.col("_place"), at + step).otherwise(at))
    last = len(bounds) - 1
    dealt = docs.withColumn("_place", place).withColumn("_range", search)
    copies = F.when(F.get(found, F.col("_range")) == F.col("_place"), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy")), F.struct(F.when(F.col("_range") == 0, F.lit(last)).otherwise(F.col("_range") - 1).alias("r"), F.lit(1).alias("copy"))))
    copies = copies.otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy"))))
    sent = dealt.withColumn("_to", F.explode(copies))
    window = Window.partitionBy(F.col("_to.r")).orderBy(F.col("_to.copy"), "_place", *columns[:1])
    out = sent.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return out.where(F.col("_to.copy") == 0).drop("_place", "_range", "_to")


def fingerprint_edits(docs: DataFrame, text: str = "text", key: str = "doc_id", config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose end is the next document's start."""
    whole = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = with_next(whole.withColumn("sketch", sketch(F.col("text"), config)), "doc_id", ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = own.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    both = edited.withColumn("edited_sketch", sketch(F.col("edited"), config))
    return both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("sketch")).alias("fingerprint"),
        packed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), config).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), config).alias("near_next"),
    )
