"""Near-duplicate classes by DartMinHash signatures and banded joining.

Every element of a document's weighted set (its five-word shingles) has a region
of the weight axis. Hashed darts fall on it as a Poisson process over rank; of
the darts that hit the region, each coordinate keeps the earliest. Two sets
agree in a coordinate with the probability of their weighted Jaccard similarity.

1. Documents of equal words collapse to their least id.
2. Bands of coordinates are joined: every document of a bucket is paired with
   the bucket's hub, the document that shares its buckets with most others, and
   the pair is checked on the exact shingle sets. A group of near copies has one
   hub in nearly all its buckets, so a document gets few pairs, not one a band.
   Checked pairs form components.
3. Where a bucket still spans several components, a link between two of its
   documents may have been missed. Their documents go through an exact prefix
   join on their rarest shingles, which finds every pair at the similarity, and
   only pairs across components are checked. What two documents can still share
   behind a common shingle bounds the partner's size, so of a passage that many
   documents hold only the few rows that could still make a pair are joined.

Links are Jaccard similarities of shingle sets, so every shingle weighs 1 here;
``dart_signatures`` takes any positive weights.

Defined results: a null text counts as empty; all empty texts are copies of each
other; a document with a null id belongs to no class. Repeated rows share a
class. Ties go to the least id. Other columns of the input are never looked at,
whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.common import SIMILARITY, as_table, bind, shingle_hashes, shingles_of, ship, skew_join, trim, whole_row, words_of
from tidelake.llm.components import components


@dataclass(frozen=True)
class NearDupConfig:
    similarity: float = SIMILARITY
    bands: int = 30
    rows: int = 6
    #: Darts that are thrown in one go, about: a set takes its size and some ``coordinates * ln(coordinates)``.
    chunk: int = 500_000

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


# ---------------------------------------------------------------- signatures


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _regions(sets: np.ndarray, elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells [0,1), [1,2), [2,4), ... of the weight axis that each element reaches: set, seed, start, width, weight."""
    parts = []
    start, width, cell = 0.0, 1.0, 0
    while (reach := weights > start).any():
        n = int(reach.sum())
        seed = _mixed(elements[reach] + np.uint64(cell * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        parts.append((sets[reach], seed, np.full(n, start), np.full(n, width), weights[reach]))
        start, width, cell = start + width, max(1.0, start + width), cell + 1
    return tuple(np.concatenate(x) for x in zip(*parts))


def dart_signatures(sets: np.ndarray, elements: np.ndarray, weights: np.ndarray, count: int, coordinates: int) -> np.ndarray:
    """(count, coordinates) ids of the earliest darts of ``count`` weighted sets.

    ``sets`` numbers the set of each element, every set has elements. Elements
    (uint64) are distinct within a set, weights positive.
    """
    out, todo = np.zeros((count, coordinates), np.uint64), np.ones(count, bool)
    bound = coordinates * (np.log(coordinates) + 2) / np.bincount(sets, weights, count)
    while todo.any():
        own = todo[sets]
        at_set, seed, start, width, top = _regions(sets[own], elements[own], weights[own])
        rank, turn, found = np.zeros(len(seed)), 1, []
        while len(seed):
            dart = _mixed(seed + np.uint64(turn * 0xD1342543DE82EF95 & (1 << 64) - 1))
            rank = rank - np.log(_unit(dart)) / width
            early = rank < bound[at_set]
            at_set, seed, start, width, top, rank, dart = (x[early] for x in (at_set, seed, start, width, top, rank, dart))
            fall = _mixed(dart ^ np.uint64(0xA0761D6478BD642F))
            hits = start + width * _unit(fall) < top
            place = at_set[hits] * coordinates + (_mixed(fall[hits]) % np.uint64(coordinates)).astype(np.int64)
            found.append((place, rank[hits], fall[hits]))
            turn += 1
        place, ranks, ids = (np.concatenate(x) for x in zip(*found))
        best = np.full(count * coordinates, np.inf)
        np.minimum.at(best, place, ranks)
        first = ranks == best[place]
        out.reshape(-1)[place[first]] = ids[first]
        # Where a coordinate stayed empty, darts of later ranks are thrown as well.
        todo &= np.isinf(best).reshape(count, coordinates).any(1)
        bound = np.where(todo, bound * 2, bound)
    return out


def band_keys(batch: list[np.ndarray], config: NearDupConfig) -> list[np.ndarray]:
    """The 64-bit band keys of each set of distinct shingle hashes (int64); every shingle has weight 1."""
    keys: list[np.ndarray] = []
    at, darts = 0, int(config.coordinates * (np.log(config.coordinates) + 2))
    while at < len(batch):
        own, size = [], 0
        while at < len(batch) and (not own or size + len(batch[at]) + darts <= config.chunk):
            own.append(batch[at].view(np.uint64))
            size += len(batch[at]) + darts
            at += 1
        sets = np.repeat(np.arange(len(own)), [len(x) for x in own])
        rows = dart_signatures(sets, np.concatenate(own), np.ones(len(sets)), len(own), config.coordinates).reshape(-1, config.bands, config.rows)
        key = np.broadcast_to(np.arange(1, config.bands + 1, dtype=np.uint64), rows.shape[:2])
        for r in range(config.rows):
            key = _mixed(key * np.uint64(0x2545F4914F6CDD1D) + rows[:, :, r])
        keys += list(key.view(np.int64))
    return keys


def with_bands(shingled: DataFrame, config: NearDupConfig) -> DataFrame:
    """(doc_id, content, size, bands) of (doc_id, content, shingles); ``size`` counts distinct shingles."""
    ship()

    def sign(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = [np.unique(np.asarray(x, np.int64)) for x in batch["shingles"]]
                yield pd.DataFrame({"doc_id": batch["doc_id"], "content": batch["content"], "size": [len(x) for x in sets], "bands": band_keys(sets, config)})
        trim()

    return shingled.mapInPandas(sign, "doc_id long, content string, size int, bands array<bigint>")


# ---------------------------------------------------------------- joining


def verified(pairs: DataFrame, texts: DataFrame, config: NearDupConfig) -> DataFrame:
    """The pairs (a, b) whose distinct shingle sets reach the similarity."""
    first = skew_join(pairs, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), ["a"])
    both = skew_join(first, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), ["b"])

    def jaccard(sides: Column) -> Column:
        return bind(F.size(F.array_intersect(sides["a"], sides["b"])), lambda n: n / (F.size(sides["a"]) + F.size(sides["b"]) - n))

    sets = F.struct(*[F.array_distinct(shingle_hashes(F.col(f"text_{s}"))).alias(s) for s in "ab"])
    return both.where(bind(sets, jaccard) >= F.lit(config.similarity)).select("a", "b")


def _missed_links(texts: DataFrame, parts: DataFrame, config: NearDupConfig) -> DataFrame:
    """Links (a, b) across components, by an exact join on the rarest shingles.

    A document of n shingles must share one of its n - ceil(s n) + 1 rarest with
    any partner at similarity s or more. At the first one that they share, of
    rank r, at most n - r + 1 are left to be shared, which bounds the partner's
    size (``most``). The shorter document of a pair (by size, then id) is the
    left side of the join, and only rows that admit a partner of their own size
    can be that. Partners are at most 1 / s times as long, so they lie in the same class of sizes
    or the next. The sets are made once per document, as a document can be in
    many pairs here.
    """
    similar = config.similarity
    sets = skew_join(texts, parts, ["doc_id"]).select("doc_id", "component", F.array_distinct(shingle_hashes(F.col("text"))).alias("set"))
    sets = as_table(sets, "dup-sets")
    rows = sets.select("doc_id", "component", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("df", F.lit(1)), "shingle")
    ranked = skew_join(rows, counts, ["shingle"], "left").withColumn("r", F.row_number().over(order))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1).where("df > 1")
    most = (F.col("n") - F.col("r") + 1) * F.lit((1 + similar) / similar) - F.col("n") + F.lit(1e-6)
    band = F.floor(F.log(F.col("n").cast("double")) * F.lit(0.999 / -math.log(similar))).cast("int")
    prefix = as_table(prefix.select("doc_id", "component", "n", "shingle", most.alias("most"), band.alias("band")), "dup-prefixes")
    mixed = prefix.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle")
    open_rows = as_table(skew_join(prefix, mixed, ["shingle"]), "dup-open")
    a, b = (open_rows.select("shingle", "band", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "component", "n", "most")]) for s in "ab")
    a = a.where("most_a >= n_a").withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    shorter = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("doc_id_a") < F.col("doc_id_b")))
    open_pair = shorter & (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b")) & (F.col("component_a") != F.col("component_b"))
    pairs = skew_join(a, b, ["shingle", "band"]).where(open_pair)
    pairs = pairs.groupBy(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).agg(F.lit(1).alias("one")).select("a", "b")
    first = skew_join(pairs, sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), ["a"])
    both = skew_join(first, sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), ["b"])
    jaccard = bind(F.size(F.array_intersect("set_a", "set_b")), lambda n: n / (F.size("set_a") + F.size("set_b") - n))
    return both.where(jaccard >= F.lit(similar)).select("a", "b")


def _content(words: Column) -> Column:
    return F.md5(F.concat_ws(" ", words))


def _classes(docs: DataFrame, text: str, key: str, config: NearDupConfig) -> DataFrame:
    """doc_id, content, class_id, keep: one row per document, without those that lack an id.

    A document is known by its id or, where some id holds more than one text, by id and text.
    """
    whole = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    worded = whole.where("doc_id is not null").select(F.col("doc_id").cast("long"), words_of(F.col("text")).alias("words"))
    shingled = worded.select("doc_id", _content(F.col("words")).alias("content"), shingles_of(F.col("words")).alias("shingles"))
    signed = as_table(with_bands(shingled, config), "dup-bands")
    texts_of = signed.groupBy("doc_id").agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
    several = not texts_of.where("lo < hi").isEmpty()
    if several:
        signed = signed.withColumn("doc_id", F.struct("doc_id", "content"))
        whole = whole.where("doc_id is not null").withColumn("doc_id", F.struct(F.col("doc_id").cast("long").alias("doc_id"), _content(words_of(F.col("text"))).alias("content")))
    firsts = as_table(signed.groupBy("content").agg(F.min("doc_id").alias("doc_id")), "dup-firsts")

    single = signed.join(firsts, ["content", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    banded = single.select("doc_id", "size", F.explode("bands").alias("band"))
    filled = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = as_table(skew_join(banded, filled, ["band"]), "dup-buckets")
    company = shared.groupBy("doc_id").agg((-F.sum("n")).alias("rank"))
    hubs = skew_join(shared, company, ["doc_id"]).groupBy("band").agg(F.min(F.struct("rank", "size", "doc_id")).alias("hub"))
    texts = as_table(skew_join(whole, company.select("doc_id"), ["doc_id"]).dropDuplicates(["doc_id"]), "dup-texts")

    met = skew_join(shared, hubs, ["band"]).where("doc_id <> hub.doc_id")
    alike = F.least("size", "hub.size") >= F.greatest("size", "hub.size") * F.lit(config.similarity) - F.lit(1e-9)
    pairs = met.where(alike).groupBy(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).agg(F.lit(1).alias("one")).select("a", "b")
    links = as_table(verified(pairs, texts, config), "dup-links")
    labels = components(links)

    parts = skew_join(shared.select("band", "doc_id"), labels.withColumnRenamed("node", "doc_id"), ["doc_id"], "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    parts = as_table(parts, "dup-parts")
    mixed = parts.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    doubt = as_table(skew_join(parts, mixed, ["band"]).groupBy("doc_id", "component").agg(F.lit(1).alias("one")).select("doc_id", "component"), "dup-doubt")
    if not doubt.isEmpty():
        more = as_table(_missed_links(texts, doubt, config), "dup-more")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    named = skew_join(signed.select("doc_id", "content"), firsts.withColumnRenamed("doc_id", "first"), ["content"]).select("doc_id", "content", "first")
    classed = skew_join(named, labels.withColumnRenamed("node", "first"), ["first"], "left").select("doc_id", "content", F.coalesce("component", "first").alias("class_id"))
    classed = classed.withColumn("keep", F.col("doc_id") == F.col("class_id"))
    return classed.withColumns({c: F.col(f"{c}.doc_id") for c in ("doc_id", "class_id")}) if several else classed


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """doc_id, class_id (the least id of the class), keep: one row per document."""
    classed = _classes(docs, text, key, config).select("doc_id", "class_id", "keep")
    none = docs.where(F.col(key).isNull()).select(F.col(key).alias("doc_id"), F.col(key).alias("class_id"), F.lit(True).alias("keep"))
    return classed.unionByName(none)


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """``docs`` with one document of each class; rows that repeat a kept id and its text stay once."""
    found = as_table(_classes(docs, text, key, config).withColumnRenamed("doc_id", "_id"), "dup-classes")
    # Most ids are on one row; only rows of the others, and of what goes, are looked at by text.
    touched = as_table(found.groupBy(F.col("_id").alias(key)).agg(F.min("keep").alias("keep"), F.count("*").alias("n")).where("n > 1 or not keep"), "dup-touched")
    kept = docs.join(touched, key, "left_anti").select(docs.columns)
    repeated = touched.where("n > 1")
    if repeated.isEmpty():
        return kept
    rows = docs.join(repeated, key, "left_semi")
    content = rows.select(F.col(key).alias("id"), _content(words_of(F.coalesce(F.col(text), F.lit("")))).alias("content"), whole_row(docs).alias("row"))
    stay = found.where("keep").select(F.col("_id").alias("id"), "content").distinct()
    once = skew_join(content, stay, ["id", "content"]).dropDuplicates(["id", "content"])
    return kept.unionByName(once.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
