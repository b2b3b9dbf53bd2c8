"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; every other text is unlabelled. With the class prior p, the risk of a
linear classifier g under the logistic loss l is  p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]):  what the
unlabelled rows cost as negatives, less the positives among them, which can't be less than nothing. Where an
estimate of the bracket turns negative the step goes back on it, so that the model can't fit the positives by heart.
Features are the words that a text has (once each, whatever their number), of those words that the positives
have markedly more often than the unlabelled texts.

The fit runs on the driver on a bounded sample (`most_positive` and `most_unlabelled` whole texts, by hash
order, none of over `most_chars`); the class prior is a count over all training labels. Scoring runs in Spark tasks over whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, forget, stored

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    bias: float
    weight: dict[str, float]

    def g(self, words: set[str]) -> float:
        return self.bias + sum(map(self.weight.__getitem__, self.weight.keys() & words))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.g(words_of(text))))))


class Rows:
    """Word numbers of each text, laid end to end."""

    def __init__(self, texts: list[set[str]], number: dict[str, int]):
        ids = [[number[w] for w in t if w in number] for t in texts]
        self.n, self.width = len(texts), len(number)
        self.words = np.array([w for row in ids for w in row], dtype=np.int64)
        self.row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.words], self.n)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.words, x[self.row], self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def risk_slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the non-negative risk by each positive's and each unlabelled row's g; those back where the bracket is negative."""
    bracket = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    like = -prior * sigmoid(-gp) / len(gp)  # slope of p E_P[l(g)]
    less, more = -prior * sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)  # slopes of the bracket
    return (like + less, more) if bracket >= 0 else (-less, -more)


def descend(pos: Rows, unl: Rows, prior: float, l2: float = 1e-5, rounds: int = 400, rate: float = 0.1) -> tuple[float, np.ndarray]:
    """Adam on the non-negative risk."""
    w, b = np.zeros(pos.width), 0.0
    m, v = np.zeros(pos.width + 1), np.zeros(pos.width + 1)
    for t in range(1, rounds + 1):
        dp, du = risk_slopes(pos.times(w) + b, unl.times(w) + b, prior)
        grad = np.r_[pos.sums(dp) + unl.sums(du) + l2 * w, dp.sum() + du.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return b, w


def without_copies(texts: list[set[str]], alike: float = 0.6) -> list[set[str]]:
    """One text of each group of near copies: candidates share one of their 5 words of least hash with a text kept
    before, copies the share `alike` of all their words."""
    owners, out = defaultdict(list), []
    for t in texts:
        least = sorted(crc32(w.encode("utf-8", "replace")) for w in t)[:5]
        if any(len(t & out[k]) >= alike * len(t | out[k]) for k in {k for h in least for k in owners[h]}):
            continue
        for h in least:
            owners[h].append(len(out))
        out.append(t)
    return out


def fit(positive: list[str], unlabelled: list[str], prior: float, least: int = 4, share: float = 0.006, lift: float = 4.0) -> Model:
    """Weights of the words that mark the positives: at least `share` of them (and `least` texts) have the word,
    `lift` times the share of the unlabelled texts that do, and more often than the commonest of as many words
    would by chance (a Poisson tail).
    Copies count once, so that a text that is repeated can't make its words marks. Weights and bias are those of the
    risk, nothing is adjusted after. Without positives every score is the prior's.
    """
    pos, unl = (without_copies([words_of(t) for t in sorted(set(x))]) for x in (positive, unlabelled))
    prior = min(max(prior, 1e-3), 0.9)
    bias = math.log(prior / (1 - prior))
    if not pos or not unl:
        return Model(bias, {})
    seen, there = Counter(w for t in pos for w in t), Counter(w for t in unl for w in t)
    chance = {w: len(pos) * (there[w] + 0.5) / len(unl) for w in seen}
    tried = sum(n >= least for n in seen.values())
    unlikely = lambda n, c: n * math.log(n / c) - (n - c) >= math.log(tried)
    marks = sorted(w for w, n in seen.items() if n >= max(least, share * len(pos), lift * chance[w]) and unlikely(n, chance[w]))
    if not marks:
        return Model(bias, {})
    number = {x: i for i, x in enumerate(marks)}
    b, w = descend(Rows(pos, number), Rows(unl, number), prior)
    return Model(float(b), dict(zip(marks, w.tolist(), strict=True)))


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 1200, most_unlabelled: int = 4000, most_chars: int = 30_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit to rows whose crc32 of the id isn't 1 mod 3. A doc_id with several labels is positive if one is 1.

    The sample is what the driver holds: of the texts of at most most_chars, at most most_positive confirmed ones and
    most_unlabelled of all, those of least hash. A row that is repeated counts once.
    """
    told = labels.where(F.col(label_col).isNotNull() & (crc32_of_id(id_col) % 3 != 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    told = stored(told, "labels")
    n, positive = told.agg(F.count(F.lit(1)), F.sum(F.when(F.col("label") == 1, 1).otherwise(0))).first()
    text = F.col(text_col).cast("string")
    may = docs.where(text.isNotNull() & (F.length(text) <= most_chars) & (crc32_of_id(id_col) % 3 != 1))
    named = may.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), text).alias("hash"), text.alias("text"))
    rows = stored(named.select("id", "hash").distinct(), "hashes")
    pos = least_hashes(rows.join(told.where("label = 1").select("id"), "id", "left_semi"), most_positive)
    # the unlabelled texts are a sample of all, the confirmed ones among them, so that the prior is theirs
    unl = least_hashes(rows, most_unlabelled)
    chosen = F.broadcast(pos.withColumn("kind", F.lit(1)).unionByName(unl.withColumn("kind", F.lit(0))))  # no more than the two limits
    sample = named.join(chosen, ["id", "hash"]).dropDuplicates(["id", "hash", "kind"]).select("kind", "text").collect()
    forget(told, rows)
    return fit([r.text for r in sample if r.kind == 1], [r.text for r in sample if r.kind == 0], (positive or 0) / n if n else 0.0)


def least_hashes(rows: DataFrame, most: int) -> DataFrame:
    """The `most` rows of least hash. A bar that leaves about twice as many comes first, so that tasks send few rows each."""
    bar = min(1.0, 2 * (most + 100) / max(1, rows.count()))
    some = rows.where(F.col("hash") <= F.lit(int(-(1 << 63) + bar * ((1 << 64) - 2048))))
    return (some if bar < 1 and some.count() >= most else rows).orderBy("hash", "id").limit(most)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted added. A null or empty text has the score of no words. Only the text decides."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        for texts in parts:
            yield pd.Series([m.score(t) for t in texts.tolist()], dtype="float64")

    return docs.withColumn("score", scored(F.col(text_col).cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, by a model trained on rows that aren't held out.

    held_out: crc32 of the id's text is 1 mod 3; false for a null id. Repeated rows get a row each. Without a
    positive every text has one score, under the threshold. An empty table gives an empty result.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc32_of_id(id_col) % 3 == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return score(rows, model).drop("text")
