"""Queries that SQL can't state, against plain Python on whole small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import classes
from tidelake.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chained(*parts: bytes | None) -> int:
    """Spark's ``xxhash64`` of several columns: each one's hash seeds the next, nulls are passed over."""
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p, seed & ((1 << 64) - 1))
    return signed(seed)


def int32(x: int) -> bytes:
    return x.to_bytes(4, "little", signed=True)


def int64(x: int) -> bytes:
    return x.to_bytes(8, "little", signed=True)


# ---------------------------------------------------------------- 1 fingerprints


def plain_fingerprint(text: str, bins: int = 256, bits: int = 4, probes: int = 8) -> list[int]:
    words = WORD.findall(text)
    hashes = {chained(*[w.encode() for w in words[i : i + 5]]) for i in range(max(1, len(words) - 4))}
    shift = 64 - int(math.log2(bins))
    least: dict[int, int] = {}
    for h in hashes:
        least[h >> shift] = min(h, least.get(h >> shift, h))
    low = (1 << shift) - 1
    known = {b + bins // 2: v for b, v in least.items() if v & low != low}
    out = []
    for i in range(bins):
        value = known.get(i)
        for turn in range(1, probes + 1):
            if value is None:
                value = known.get(chained(int32(i), int32(turn)) % bins)
        if value is None:
            value = min(known.values(), key=lambda v: (chained(int32(i), int64(v >> shift)), v), default=0)
        out.append(chained(int64(value), int32(i)) & ((1 << bits) - 1))
    return out


def plain_likeness(a: list[int], b: list[int]) -> float:
    same = sum(x == y for x, y in zip(a, b)) / len(a)
    return min(1.0, max(0.0, (same - 1 / 16) / (1 - 1 / 16)))


def test_fingerprints_equal_plain_python(spark, sf, tables):
    docs = tables["documents"].sort_values("doc_id")
    texts = docs.text.fillna("").tolist()
    got = q.op1_fingerprints(spark, sf).toPandas().sort_values("doc_id")
    sketches = [plain_fingerprint(t) for t in texts]
    assert got.fingerprint.tolist() == ["".join(f"{x:x}" for x in s) for s in sketches]
    after = sketches[1:] + sketches[:1]
    assert np.allclose(got.near_next, [plain_likeness(a, b) for a, b in zip(sketches, after)])
    edited = [plain_fingerprint(t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2]) for i, t in enumerate(texts)]
    assert got.edited_fingerprint.tolist() == ["".join(f"{x:x}" for x in s) for s in edited]
    assert np.allclose(got.near_edited, [plain_likeness(a, b) for a, b in zip(sketches, edited)])


# ---------------------------------------------------------------- 2 toxicity, 10 languages


def test_toxicity_query_scores_every_document(spark, sf, tables):
    from tidelake.llm.toxicity import fit_toxicity

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels.where("pmod(crc32(cast(doc_id as string)), 5) <> 0"))
    seen = {t for t, i in zip(tables["documents"].text, tables["documents"].doc_id) if zlib.crc32(str(i).encode()) % 5}
    assert model.coefficients is not None and len(seen) > 100
    got = q.op2_toxicity(spark, sf).toPandas().set_index("doc_id")
    wanted = {i: model.score(t) for i, t in zip(tables["documents"].doc_id, tables["documents"].text)}
    assert got.score.to_dict() == pytest.approx(wanted, abs=1e-12)
    assert (got.predicted == (got.score >= 0.5).astype(int)).all()


def test_languages_equal_plain_decoding(spark, sf, tables):
    """Byte grams counted one by one, every bit's margin, and the loss of every codeword."""
    from tidelake.llm.langid import fit_languages

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit_languages(docs.where("pmod(crc32(cast(doc_id as string)), 4) <> 2"))
    shift = 32 - int(math.log2(model.config.bins))
    got = q.op10_language(spark, sf).toPandas().set_index("doc_id")
    for i, text in zip(tables["documents"].doc_id, tables["documents"].text):
        if not any(c.isalpha() for c in text or ""):
            assert got.lang_pred[i] == "und"
            continue
        raw = f" {' '.join(text.lower().split())} ".encode()
        bins = Counter(((raw[k] << 8 | raw[k + 1]) + 0x51ED27) * 0x9E3779B1 % (1 << 32) >> shift for k in range(len(raw) - 1))
        bins.update((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 0x85EBCA6B % (1 << 32) >> shift for k in range(len(raw) - 2))
        total = sum(bins.values())
        margins = [sum(n * float(model.weights[b, bit]) for b, n in bins.items()) / math.sqrt(total) for bit in range(model.code.shape[1])]
        losses = [sum(w * np.logaddexp(0, -c * m * model.scale) for w, c, m in zip(model.bit_weights[k], model.code[k], margins)) for k in range(len(model.languages))]
        worth = np.exp(-(np.array(losses) - min(losses)) * model.code.shape[1])
        best = int(np.argmin(losses))
        assert got.lang_pred[i] == model.languages[best] and got.score[i] == pytest.approx(worth[best] / worth.sum(), abs=1e-4)


# ---------------------------------------------------------------- 8 secrets


BASE = [
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: m[2], lambda v: len(v) >= 8),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: m[0], lambda v: len(v) >= 16),
    (re.compile("[0-9a-f]+"), lambda m: m[0], lambda v: len(v) >= 32),
]
BARE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")


def plain_candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of base matches and of bare mixed strings outside them."""
    found = [(m.start(), kind, m.end(), value(m)) for kind, (pattern, value, keep) in enumerate(BASE) for m in pattern.finditer(text) if keep(value(m))]
    bare = [(m.start(), 3, m.end(), m[0]) for m in BARE.finditer(text) if all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
    return found + [b for b in bare if not any(b[0] < f[2] and f[0] < b[2] for f in found)]


def plain_secrets(docs: pd.DataFrame) -> dict[int, list[tuple[int, int, int, bool]]]:
    """Spans of each document by start and kind, bare ones only where they look live."""
    found = {i: plain_candidates(t or "") for i, t in zip(docs.doc_id, docs.text)}
    held = defaultdict(set)
    for i, t, source in zip(docs.doc_id, docs.text, docs.source):
        for *_, value in found[i]:
            held[value].add((source, i, t))

    def live(value: str) -> bool:
        owners = {source for source, *_ in held[value]}
        return len(owners) <= 2 and len(held[value]) <= 10 * len(owners) and len(set(value)) >= 6

    return {i: sorted({(a, k, b, live(v)) for a, k, b, v in own if k < 3 or live(v)}) for i, own in found.items()}


def test_secrets_equal_plain_python(spark):
    from tidelake.llm.secrets import find_secrets, span_text

    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "text", "source"]]
    bare = ["Zx81kQ93bnM2Zx81kQ93bnM2aa", "Common0example0Value0of0many", "Hot0source0copied0often0here"]
    more = [(10_000 + k, f"see {bare[0]} or {bare[1]} now", f"src{k}") for k in range(2)] + [(10_010 + k, f"{bare[1]} x{k}", f"src{k}") for k in range(5)] + [(10_020 + k, f"{bare[2]} y{k}", "src0") for k in range(30)]
    docs = pd.concat([docs, pd.DataFrame(more, columns=docs.columns)], ignore_index=True)
    names = ("assign", "access", "hex", "generic")
    found = find_secrets(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    got = {r.doc_id: r.s for r in found.select("doc_id", span_text(F.col("spans")).alias("s")).collect()}
    wanted = {i: ",".join(f"{names[k]}:{a}:{b}" for a, k, b, _ in own) for i, own in plain_secrets(docs).items()}
    assert got == wanted and got[10_000] == "generic:4:30" and got[10_010] == got[10_020] == "" and any("assign" in w for w in wanted.values())


# ---------------------------------------------------------------- the pipeline


def test_pipeline_equals_plain_python(spark, sf, tables):
    """Every stage by hand on the whole smallest table, to the checksum of every piece."""
    import corpus_pipeline
    from tidelake.llm.langid import fit_languages
    from tidelake.llm.mixing import mix_sql
    from tidelake.llm.packing import ByteBpe

    docs = tables["documents"]
    model = fit_languages(spark.read.parquet(f"{sf}/documents.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
    docs = docs[[not model.predict(t)[4] for t in docs.text]]
    named = classes(dict(zip(docs.doc_id, docs.text)))
    docs = docs[[named[i] == i for i in docs.doc_id]]
    spans, masked = plain_secrets(docs), []
    for i, text in zip(docs.doc_id, docs.text):
        out, at = "", 0
        for a, _, b, live in spans[i]:
            if live:
                out, at = (out, max(at, b)) if a < at else (out + text[at:a] + "[SECRET]", b)
        masked.append(out + text[at:])
    docs = docs.assign(text=masked)
    keyed = pd.DataFrame({"doc_id": [f"i{i}t{__import__('hashlib').md5(t.encode()).hexdigest()}" for i, t in zip(docs.doc_id, docs.text)], "text": docs.text, "source": docs.source})
    con = duckdb.connect()
    con.register("documents", keyed)
    copies = {int(k[1 : k.index("t")]): n for k, n in con.execute(f"SELECT doc_id, copies FROM ({mix_sql()})").fetchall()}
    bpe, wanted = ByteBpe(q.tokenizer_file(), 1000), Counter()
    for i, text in zip(docs.doc_id, docs.text):
        ids = np.frombuffer(bpe.exact(text) + np.array([2], "<u4").tobytes(), "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += copies[i]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == +wanted
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)])]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024
