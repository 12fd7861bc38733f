"""Toxicity by compression distance.

Separate zstandard dictionaries are trained on the windows of toxic and of
ordinary text. Behind either, a compressor holds one base dictionary trained on
other ordinary texts, so that common text compresses alike with both and only
what the two trained dictionaries differ in shows. What a pair of dictionaries
happens to hold of common text is noise: ``pairs`` of them are trained on
different shares of the texts, and their savings averaged. A text is cut into
windows at word gaps; the bytes that the toxic dictionaries save over the
ordinary ones, window by window, feed a calibrated threshold model.

The calibration is cross-fitted: savings of a labelled text come from
dictionaries that other texts trained, and the model that scores has
dictionaries of all of them. Short segments (``segment``) keep a dictionary from
filling up with the words around the telling ones.

Defined results: a null or empty text is one empty window, whose score is that
of no savings. Without toxic or without ordinary labels every score is 0.
Labels that are null or have no document are ignored; a document with two
labels counts as toxic if any says so; of an id with several texts one is
learned from, the least by hash. Repeated rows get equal scores. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import ship


@dataclass(frozen=True)
class ToxicityConfig:
    #: Bounds of the labelled sample that is fitted on the driver: the least ids by hash, for either label.
    max_toxic: int = 1500
    max_ordinary: int = 3000
    #: Bytes of a window.
    window: int = 128
    level: int = 9
    base_bytes: int = 98304
    class_bytes: int = 8192
    #: Length of the segments that a class's dictionary is made of, and of the strings that they are chosen by.
    segment: int = 16
    gram: int = 8
    pairs: int = 3
    folds: int = 3
    #: Share of the ordinary texts that trains the base dictionary.
    base_share: float = 2 / 3


def windows(text: str | None, width: int) -> list[bytes]:
    """The whole lower-cased text in pieces of at most ``width`` bytes, cut at spaces where it can be."""
    raw, out, at = (text or "").lower().encode("utf-8", "replace"), [], 0
    while at < len(raw):
        end = min(len(raw), at + width)
        if end < len(raw):
            gap = raw.rfind(b" ", at + width // 2, end)
            end = gap if gap > 0 else end
        out.append(raw[at:end])
        at = end
    return out or [b""]


def _trained(samples: list[bytes], size: int, **how) -> bytes:
    """A dictionary of ``size`` bytes at most; too few samples are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _cut(texts: list[str], width: int) -> list[bytes]:
    return [w for t in texts for w in windows(t, width)]


def _dictionaries(toxic: list[str], plain: list[str], base: bytes, config: ToxicityConfig) -> list[tuple[bytes, bytes]]:
    """(ordinary, toxic) dictionary contents, the base at the end of each; every pair leaves out another share of the texts."""

    def share(texts: list[str], j: int) -> list[str]:
        return [t for i, t in enumerate(texts) if i % config.pairs != j] or texts

    def own(texts: list[str], j: int) -> bytes:
        return _trained(_cut(share(texts, j), config.window), config.class_bytes, k=config.segment, d=config.gram)

    return [(own(plain, j) + base, own(toxic, j) + base) for j in range(config.pairs)]


class ToxicityModel:
    def __init__(self, pairs: list[tuple[bytes, bytes]], coefficients: np.ndarray | None, config: ToxicityConfig):
        self.pairs, self.coefficients, self.config = pairs, coefficients, config
        self._made = None

    def __getstate__(self):
        return {"pairs": self.pairs, "coefficients": self.coefficients, "config": self.config, "_made": None}

    @staticmethod
    def fit(texts: list[str], labels: list[int], weights: list[float], config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
        toxic = list(dict.fromkeys(t for t, y in zip(texts, labels) if y))
        plain = [t for t in dict.fromkeys(t for t, y in zip(texts, labels) if not y) if t not in set(toxic)]
        if not toxic or not plain:
            return ToxicityModel([], None, config)
        weight = dict(zip(texts, weights))
        most = int(len(plain) * config.base_share)
        base = _trained(_cut(plain[:most], config.window), config.base_bytes)
        plain = plain[most:]
        folds = max(1, min(config.folds, len(toxic), len(plain)))
        x, y, w = [], [], []
        for fold in range(folds):
            others = [[t for i, t in enumerate(own) if folds == 1 or i % folds != fold] for own in (toxic, plain)]
            model = ToxicityModel(_dictionaries(*others, base, config), None, config)
            for label, own in ((1, toxic), (0, plain)):
                for t in own[fold::folds]:
                    x.append(model.features(t))
                    y.append(label)
                    w.append(weight[t] / (1 if label else 1 - config.base_share))
        coefficients = _logistic(np.array(x), np.array(y, float), np.array(w, float))
        return ToxicityModel(_dictionaries(toxic, plain, base, config), coefficients, config)

    def compressors(self):
        if self._made is None:
            made = []
            for pair in self.pairs:
                both = []
                for content in pair:
                    book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    book.precompute_compress(level=self.config.level)
                    both.append(zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_dict_id=False, write_checksum=False).compress)
                made.append(tuple(both))
            self._made = made
        return self._made

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionaries save over the ordinary ones on average, per window."""
        pairs = self.compressors()
        return np.array([sum(len(plain(w)) - len(toxic(w)) for plain, toxic in pairs) for w in windows(text, self.config.window)], float) / max(len(pairs), 1)

    def features(self, text: str | None) -> np.ndarray:
        d = self.savings(text)
        total, root = np.clip(d, 0, None).sum(), np.sqrt(len(d))
        return np.array([1.0, d.mean(), min(d.max(), 12.0), (d >= 1).mean(), (d >= 2).mean(), (d >= 3).mean(), np.log1p(total), np.log1p(len(d)), np.clip(d.sum() / root, -20, 20)])

    def score(self, text: str | None) -> float:
        if self.coefficients is None:
            return 0.0
        z = float(np.clip(self.features(text) @ self.coefficients, -35, 35))
        return 1.0 / (1.0 + float(np.exp(-z)))

    def column(self, text: Column) -> Column:
        model = self
        ship()

        @F.pandas_udf("double")
        def toxicity(texts: pd.Series) -> pd.Series:
            return pd.Series([model.score(t) for t in texts], dtype="float64")

        return toxicity(text)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weighted ridge-regularised logistic regression by Newton steps."""
    mean, spread = x.mean(0), x.std(0)
    mean[0], spread[0] = 0.0, 1.0
    spread[spread == 0] = 1.0
    z, b = (x - mean) / spread, np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
        gradient = z.T @ (weight * (y - p)) - penalty @ b
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, gradient)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    out = b / spread
    out[0] = b[0] - (b[1:] * mean[1:] / spread[1:]).sum()
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fit on a hash-fixed sample of the labelled documents, bounded for either label."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    marked = marked.groupBy("k").agg(F.max((F.col("y") != 0).cast("int")).alias("y"))
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    bounds = {1: config.max_toxic, 0: config.max_ordinary}
    first = [marked.where(F.col("y") == y).orderBy(F.xxhash64("k", F.lit("toxicity")), "k").limit(n) for y, n in bounds.items()]
    # The chosen ids are at most max_toxic + max_ordinary rows of two numbers.
    chosen = F.broadcast(first[0].unionByName(first[1]))
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(chosen, "k")
    sample = texts.groupBy("k", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")).toPandas().sort_values("k")
    weights = [max(1.0, sizes[y] / bounds[y]) for y in sample["y"]]
    return ToxicityModel.fit(sample["t"].tolist(), sample["y"].tolist(), weights, config)
