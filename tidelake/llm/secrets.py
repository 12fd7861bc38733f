"""Secret scanning with corpus-wide ownership, in SQL functions only.

Patterns find candidates in every whole text. The candidates' hashes are then
counted over the corpus: a value that many owners hold, or many repositories of
one, is a widely copied example; a value in few repositories of one or two
owners looks like a live credential. Bare
high-entropy strings, which no pattern names, are reported only where their
ownership is that narrow.

Defined results: a null text counts as empty and has no spans; a null source is
an owner of its own; rows that repeat an id and text share their findings and
count once. An empty table has no findings. Positions are code points, the end
exclusive. ``find_secrets`` reads the three named columns only; ``redact`` keeps
all others as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import as_table, bind, skew_join, whole_row

KINDS = ("assign", "access", "hex", "generic")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whole runs, so that a shorter run can't be found inside a longer one.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
GENERIC = r"[A-Za-z0-9+/_=-]{24,}"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


@dataclass(frozen=True)
class SecretConfig:
    assigned_chars: int = 8
    #: A value that more owners hold, or more repositories for each owner, is a copied example.
    live_owners: int = 2
    owner_repositories: int = 10
    #: A live-looking value has this many different characters.
    distinct_chars: int = 6
    mask: str = "[SECRET]"


def _spans(text: Column, gate: Column, pattern: str, kind: int, value, keep) -> Column:
    """The pattern's leftmost non-overlapping matches that ``keep`` accepts."""
    none = F.array().cast(SPANS)

    def placed(both: Column) -> Column:
        parts, hits = both["parts"], both["hits"]

        def step(at: Column, i: Column) -> Column:
            hit, start = F.get(hits, i), at["pos"] + F.length(F.get(parts, i))
            end = start + F.length(hit)
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value(hit).alias("value"))
            return F.struct(end.alias("pos"), F.concat(at["out"], F.when(keep(hit), F.array(span)).otherwise(none)).alias("out"))

        start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
        folded = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step)["out"]
        return F.when(F.size(hits) > 0, folded).otherwise(none)

    both = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(gate, bind(both, placed)).otherwise(none)


def candidate_spans(text: Column, config: SecretConfig = SecretConfig()) -> Column:
    """All candidates of a text that isn't null: base patterns, and bare strings outside them."""

    def assigned(hit: Column) -> Column:
        return F.regexp_extract(hit, ASSIGN, 2)

    lowered = F.lower(text)
    named = lowered.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        named = named | lowered.contains(word)
    base = F.concat(
        _spans(text, named, ASSIGN, 0, assigned, lambda h: F.length(assigned(h)) >= config.assigned_chars),
        _spans(text, text.contains("AKIA"), ACCESS, 1, lambda h: h, lambda h: F.lit(True)),
        _spans(text, F.rlike(text, F.lit(HEX)), HEX, 2, lambda h: h, lambda h: F.lit(True)),
    )

    def mixed(hit: Column) -> Column:
        return F.rlike(hit, F.lit("[0-9]")) & F.rlike(hit, F.lit("[a-z]")) & F.rlike(hit, F.lit("[A-Z]"))

    bare = _spans(text, F.rlike(text, F.lit(GENERIC)), GENERIC, 3, lambda h: h, mixed)

    def outside(known: Column) -> Column:
        return F.concat(known, F.filter(bare, lambda g: ~F.exists(known, lambda b: (g["start"] < b["end"]) & (b["start"] < g["end"]))))

    return bind(base, outside)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of candidates (hash, repository, owner); copies within a repository count once."""
    once = found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = once.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def _scanned(docs: DataFrame, text: str, owner: str, key: str, config: SecretConfig, *more: Column) -> DataFrame:
    """The candidates of every document, found once and stored: doc_id, id, hash, owner, found and ``more``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    ident, name = F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("s"), F.col(owner)), F.lit("n"))
    rows = docs.select(F.col(key).alias("doc_id"), ident.alias("id"), F.xxhash64(whole).alias("hash"), name.alias("owner"), candidate_spans(whole, config).alias("found"), *more)
    return as_table(rows.withColumn("has", F.size("found") > 0), "secret-candidates")


def _judged(scanned: DataFrame, config: SecretConfig) -> DataFrame:
    """id, hash and the spans that stand, of every document that has any: ownership is counted over all documents."""
    each = scanned.where("has").select("id", "hash", "owner", F.explode("found").alias("f"))
    each = each.select("id", "hash", "owner", F.md5("f.value").alias("value"), "f.kind", "f.start", "f.end", F.size(F.array_distinct(F.split("f.value", ""))).alias("chars"))
    known = ownership(each.select(F.col("value").alias("hash"), "owner", F.concat_ws(":", "id", "hash").alias("repository"))).withColumnRenamed("hash", "value")
    live = (F.col("owners") <= config.live_owners) & (F.col("repositories") <= F.col("owners") * config.owner_repositories) & (F.col("chars") >= config.distinct_chars)
    judged = skew_join(each, known, ["value"]).withColumn("live", live).where(F.col("live") | (F.col("kind") < 3))
    return judged.groupBy("id", "hash").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end", "live", "repositories", "owners"))).alias("spans"))


def find_secrets(docs: DataFrame, text: str = "text", owner: str = "source", key: str = "doc_id", config: SecretConfig = SecretConfig()) -> DataFrame:
    """One row per document: doc_id, text_hash and ``spans`` (kind, start, end, live, repositories, owners) by start and kind.

    A document is a repository here, its source the owner. Bare strings are
    among the spans only where they look live.
    """
    scanned = _scanned(docs, text, owner, key, config)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,repositories:bigint,owners:bigint>>")
    bare = scanned.where("not has").select("doc_id", F.col("hash").alias("text_hash"), none.alias("spans"))
    held = scanned.where("has").select("doc_id", "id", "hash").join(_judged(scanned, config), ["id", "hash"], "left")
    return bare.unionByName(held.select("doc_id", F.col("hash").alias("text_hash"), F.coalesce("spans", none).alias("spans")))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", owner: str = "source", key: str = "doc_id", config: SecretConfig = SecretConfig()) -> DataFrame:
    """``docs`` with live-looking secrets masked and ``n_chars`` (where present) recounted.

    Rows travel as one struct beside their candidates, so every text is scanned
    once, and only rows with candidates are joined with the verdicts.
    """
    scanned = _scanned(docs, text, owner, key, config, whole_row(docs).alias("row"))
    live = _judged(scanned, config).select("id", "hash", F.filter("spans", lambda s: s["live"]).alias("live")).where(F.size("live") > 0)
    held = scanned.where("has").select("id", "hash", "row").join(live, ["id", "hash"], "left")
    written = F.col("row")[text]

    def cut(at: Column, s: Column) -> Column:
        piece = F.concat(at["out"], F.substring(written, at["pos"] + 1, s["start"] - at["pos"]), F.lit(config.mask))
        inside = s["start"] < at["pos"]
        return F.struct(F.greatest(at["pos"], s["end"]).alias("pos"), F.when(inside, at["out"]).otherwise(piece).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    masked = bind(F.aggregate(F.col("live"), start, cut), lambda a: F.concat(a["out"], F.substring(written, a["pos"] + 1, F.length(written))))
    value = F.when(F.col("live").isNull(), written).otherwise(masked)

    def column(name: str) -> Column:
        kind = docs.schema[name].dataType
        new = value if name == text else F.length(value).cast(kind) if name == "n_chars" else F.col("row")[name]
        return new.alias(name)

    def untouched(name: str) -> Column:
        return (F.length(written).cast(docs.schema[name].dataType) if name == "n_chars" else F.col("row")[name]).alias(name)

    clean = scanned.where("not has").select(*[untouched(c) for c in docs.columns])
    return clean.unionByName(held.select(*[column(c) for c in docs.columns]))
