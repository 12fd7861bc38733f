"""The registered queries over the corpus tables: one per operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import fold_of, load


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(load(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm.toxicity import fit_toxicity

    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    fold = fold_of(F.col("doc_id"), 5)
    model = fit_toxicity(docs, labels.where(fold != 0))
    scored = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), model.column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm.mixing import mix

    return mix(load(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm.neardup import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm.urlfilter import Rule, UrlFilterConfig, judge_urls

    rules = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
    return judge_urls(load(spark, sf_dir, "pages"), config=UrlFilterConfig(rules=rules))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm.packing import pack_documents

    return pack_documents(load(spark, sf_dir, "documents"), tokenizer_file())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm.warc import archive_folder, read_records, write_archives

    index = write_archives(load(spark, sf_dir, "pages"), archive_folder(spark))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm.secrets import KINDS, find_secrets, span_text

    found = find_secrets(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def number(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select("doc_id", *map(number, range(3)), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), live)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm.ann import nearest

    vectors = load(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm.langid import fit_languages

    docs = load(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"), 4)
    model = fit_languages(docs.where(fold != 2))
    found = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), model.column(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.ambiguous").alias("ambiguous"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of ``op1_fingerprints``: the edited texts."""
    return op1_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of ``op5_url_filter``: addresses, rules and the verdicts that rules give."""
    found = op5_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of ``op8_secrets``: the numbers of base matches."""
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def neighbour_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_neighbours`` without the distances, whose last digits differ between engines."""
    return op9_neighbours(spark, sf_dir).select("query_id", "rank", "vec_id")


EDITS = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS after
  FROM documents)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
       sha256(substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2)) AS edited_sha256
FROM t
"""
RULES = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, h, p)),
fits AS (
  SELECT page_id, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(verdict, length(h || r.p)) AS ruled
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT page_id, host, path, rule, ruled FROM p LEFT JOIN fits USING (page_id)
"""
SECRETS = r"""
SELECT doc_id,
       CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access,
       CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex
FROM documents
"""
RECORDS = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
d AS (SELECT *, sha1(payload) AS hex FROM p),
digits AS (
  SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(hex, CAST(1 + 5 * g AS BIGINT), 5) AS BIGINT)) AS fives, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a FROM d)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(fives, lambda v: a[(v >> 15) + 1] || a[((v >> 10) & 31) + 1] || a[((v >> 5) & 31) + 1] || a[(v & 31) + 1]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM digits
"""
RANKS = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, c.x), c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id FROM pairs WHERE rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_fingerprints, op2_toxicity, op3_mixing, op4_near_duplicates, op5_url_filter, op6_packing, op7_warc, op8_secrets, op9_neighbours, op10_language, pipeline]
    found += [fingerprint_edits, url_rules, secret_counts, neighbour_ranks]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from tidelake.llm.mixing import mix_sql

    return {"op3_mixing": mix_sql(), "op7_warc": RECORDS, "fingerprint_edits": EDITS, "url_rules": RULES, "secret_counts": SECRETS, "neighbour_ranks": RANKS}
