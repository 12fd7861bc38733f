"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary n-gram classifier predicts each bit
of it; decoding weighs each bit's loss and takes the nearest codeword. A text
whose bits differ from that codeword in more places than the code corrects is
rejected: it looks like none of the languages.

Defined results: a null text, an empty one or one without any letter is
``und`` with score 0. Repeated rows get equal answers. Without labelled rows
every text is ``und``. With one language only, every text with a letter gets it.
An empty table gives an empty result. Only the named columns are read, so others
may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import hash_share, ship

UNDETERMINED = "und"
RESULT = "lang string, score double, ambiguous boolean, margin double, rejected boolean"


@dataclass(frozen=True)
class LangIdConfig:
    #: Bound of the labelled sample that is fitted on the driver, over all languages.
    max_docs: int = 4000
    #: Hashed bins of byte 2- and 3-grams.
    bins: int = 1 << 15
    smoothing: float = 0.5
    #: Codewords closer than this share of the mean bit loss are ambiguous.
    ambiguous_below: float = 0.05
    #: Bits of a codeword where the exhaustive code would be too long.
    long_code_bits: int = 63


def codewords(classes: int, bits: int) -> np.ndarray:
    """One row of +1/-1 per class: the exhaustive code, or a spread random one."""
    if classes <= 1:
        return np.ones((classes, 1), np.float32)
    if classes <= 6:
        columns = np.arange(1, 2 ** (classes - 1))
        rows = [np.ones(len(columns))]
        rows += [np.where(columns >> k & 1, -1, 1) for k in range(classes - 1)]
        return np.array(rows, np.float32)
    rng, best, best_gap = np.random.RandomState(7), None, -1
    for _ in range(40):
        code = rng.choice([-1.0, 1.0], (classes, bits)).astype(np.float32)
        agree = code @ code.T
        gap = (bits - agree[~np.eye(classes, dtype=bool)].max()) / 2
        split = np.abs(code.sum(0)).max() < classes
        if split and gap > best_gap:
            best, best_gap = code, gap
    return best


def gram_counts(text: str, bins: int) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams of the whole, lower-cased text."""
    spaced = f" {' '.join(text.lower().split())} "
    raw = np.frombuffer(spaced.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = (raw[:-1] << np.uint32(8)) | raw[1:]
    three = (two[:-1] << np.uint32(8)) | raw[2:]
    shift = np.uint32(32 - (bins.bit_length() - 1))
    mixed = np.concatenate([(two + np.uint32(0x51ED27)) * np.uint32(0x9E3779B1), three * np.uint32(0x85EBCA6B)])
    return np.bincount(mixed >> shift, minlength=bins)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class LanguageModel:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bit_weights: np.ndarray, scale: float, config: LangIdConfig):
        self.languages, self.code, self.weights = languages, code, weights
        self.bit_weights, self.scale, self.config = bit_weights, scale, config

    @staticmethod
    def fit(texts: list[str], langs: list[str], config: LangIdConfig = LangIdConfig()) -> LanguageModel:
        languages = sorted(set(langs))
        code = codewords(len(languages), config.long_code_bits)
        place = {name: k for k, name in enumerate(languages)}
        y = np.array([place[x] for x in langs], int)
        counts = np.zeros((len(languages), config.bins))
        for text, k in zip(texts, y):
            one = gram_counts(text, config.bins)
            counts[k] += one / max(1.0, np.sqrt(one.sum()))
        share = counts + config.smoothing * max(counts.sum(), 1.0) / max(counts.size, 1)
        share /= np.maximum(share.sum(1, keepdims=True), 1e-12)
        weights = np.zeros((config.bins, code.shape[1]), np.float32)
        for bit in range(code.shape[1]):
            plus, minus = code[:, bit] > 0, code[:, bit] < 0
            if plus.any() and minus.any():
                weights[:, bit] = np.log(share[plus].mean(0)) - np.log(share[minus].mean(0))
        model = LanguageModel(languages, code, weights, np.ones_like(code), 1.0, config)
        if len(languages) > 1 and len(texts):
            margins = np.array([model.margins(t) for t in texts])
            right = margins[:, None, :] * code[None, :, :] > 0
            hit = np.array([[right[y == k, k, b].mean() for b in range(code.shape[1])] for k in range(len(languages))])
            model.bit_weights = hit / np.maximum(hit.sum(1, keepdims=True), 1e-9)
            best, best_loss = 1.0, np.inf
            for scale in 2.0 ** np.arange(-4, 6):
                model.scale = scale
                p = np.array([model.posterior(m)[0] for m in margins])
                loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-6)).mean()
                if loss < best_loss:
                    best, best_loss = scale, loss
            model.scale = best
        return model

    def margins(self, text: str) -> np.ndarray:
        counts = gram_counts(text, self.config.bins)
        filled = np.flatnonzero(counts)
        total = max(int(counts.sum()), 1)
        return (counts[filled] @ self.weights[filled]) / np.sqrt(total)

    def posterior(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class probabilities, and the weighted loss of each codeword."""
        loss = (np.logaddexp(0.0, -self.code * margins[None, :] * self.scale) * self.bit_weights).sum(1)
        p = np.exp(-(loss - loss.min()) * self.code.shape[1])
        return p / p.sum(), loss

    @property
    def radius(self) -> int:
        """Wrong bits that the code corrects: less than half the least distance of two codewords."""
        differ = (self.code[:, None, :] != self.code[None, :, :]).sum(2)
        return (int(differ[~np.eye(len(differ), dtype=bool)].min()) - 1) // 2

    def predict(self, text: str | None) -> tuple[str, float, bool, float, bool]:
        """Language, score, ambiguous, margin, and rejected: no letter, or more wrong bits than the code corrects."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, False, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False, 1.0, False
        margins = self.margins(text)
        p, loss = self.posterior(margins)
        first, second = np.argsort(loss, kind="stable")[:2]
        gap = float((loss[second] - loss[first]) / max(loss[second], 1e-9))
        wrong = int((margins * self.code[first] < 0).sum())
        return self.languages[first], float(p[first]), gap < self.config.ambiguous_below, gap, wrong > self.radius

    def column(self, text: Column) -> Column:
        """struct<lang, score, ambiguous, margin, rejected> of a text column."""
        model = self
        ship()

        @F.pandas_udf(RESULT)
        def identify(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "ambiguous", "margin", "rejected"])

        return identify(text)


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", config: LangIdConfig = LangIdConfig()) -> LanguageModel:
    """Fit on a sample of ``labelled`` that is fixed by the key's hash.

    The sample holds about ``max_docs`` rows, an equal share of each language;
    languages with fewer rows give all they have. Rows that repeat another count once.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null and k is not null")
    sizes = rows.groupBy("l").count().collect()  # a row per language
    if not sizes:
        return LanguageModel.fit([], [], config)
    each = config.max_docs / len(sizes)
    shares = F.create_map(*[x for r in sizes for x in (F.lit(r["l"]), F.lit(min(1.0, each / r["count"])))])
    chosen = rows.where(hash_share(F.col("k"), "langid") < shares[F.col("l")])
    sample = chosen.dropDuplicates(["k", "l", "t"]).toPandas().sort_values(["k", "l", "t"])
    return LanguageModel.fit(sample["t"].tolist(), sample["l"].tolist(), config)


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", name: str = "_langid") -> DataFrame:
    """``docs`` with a struct column ``name``, which must be new."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"a column {name} is there already")
    return docs.withColumn(name, model.column(F.col(text)))
