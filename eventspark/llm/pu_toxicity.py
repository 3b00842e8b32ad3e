"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier learns from confirmed toxic texts and from unlabelled texts: a sample of all
documents whatever their label, some of them toxic. With the class prior p, the risk of the unknown clean
texts is the risk of the unlabelled ones less p times that of the toxic ones. Estimated from finite samples
it can turn negative, which is overfitting; the step then goes back up instead (the non-negative estimator).

Features are the distinct words of a text and the first four and five letters of each, lower case. They
are chosen by how much more often they occur in toxic than in unlabelled texts. Labels that say a text is
clean are used for the prior alone; without any, it is estimated from the features.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm import common

_WORD = re.compile(r"[^\W\d_]+")
MAX_FEATURES, CLEAR = 300, 4.0
MEMO_TOKENS = 150_000     # of a task, with the features they hold
UNLABELLED = 2             # unlabelled texts of the sample for each toxic one that it may have
LEAST_RATE = 0.05          # of a feature in toxic texts that the prior is estimated from


def token_features(token: str) -> set[str]:
    """Words of a lower-case token and their first letters (marked, so that they differ from words)."""
    words = _WORD.findall(token)
    return {*words, *("<" + w[:k] for w in words for k in (4, 5) if len(w) > k)}


def text_features(text: str) -> set[str]:
    out: set[str] = set()
    for token in set(text.lower().split()):
        out |= token_features(token)
    return out


@dataclass
class PuModel:
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -1.0

    def score(self, text: str | None, memo: dict) -> float:
        """Probability of toxicity, 0 to 1; empty and null texts get the score of a text without features."""
        found: set[int] = set()
        for token in set((text or "").lower().split()):
            ids = memo.get(token)
            if ids is None:
                ids = tuple(self.index[f] for f in token_features(token) if f in self.index)
                if len(token) < 64:
                    if len(memo) >= MEMO_TOKENS:
                        memo.clear()
                    memo[token] = ids
            if ids:
                found.update(ids)
        z = self.bias + float(self.weights[sorted(found)].sum()) if found else self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def choose_features(toxic: list[str], rest: list[str], most: int = MAX_FEATURES) -> list[str]:
    """Features whose rates differ by at least ``CLEAR`` standard errors, the clearest first.

    Only what occurs twice or more in toxic texts is counted in the others, so memory follows the former.
    """
    in_p, in_u = Counter(f for t in toxic for f in text_features(t)), Counter()
    in_p = {f: k for f, k in in_p.items() if k >= 2}
    for t in rest:
        in_u.update(f for f in text_features(t) if f in in_p)
    n_p, n_u, clear = len(toxic), len(rest), []
    for f, k in in_p.items():
        both = (k + in_u[f]) / (n_p + n_u)
        gap = k / n_p - in_u[f] / n_u
        z = gap / np.sqrt(max(both * (1 - both), 1e-12) * (1 / n_p + 1 / n_u))
        if z >= CLEAR:
            clear.append((-z, f))
    return [f for _, f in sorted(clear)[:most]]


@dataclass
class Rows:
    """Sparse binary rows: the features that each row has."""

    row: np.ndarray
    feature: np.ndarray
    n: int

    @classmethod
    def of(cls, texts: list[str], index: dict[str, int]) -> Rows:
        ids = [[index[f] for f in text_features(t) if f in index] for t in texts]
        return cls(np.repeat(np.arange(len(ids)), [len(i) for i in ids]),
                   np.array([k for i in ids for k in i], dtype=np.int64), len(ids))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.feature], minlength=self.n) if self.n else np.zeros(0)

    def summed(self, d: np.ndarray, features: int) -> np.ndarray:
        return np.bincount(self.feature, d[self.row], minlength=features)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def scores(w: np.ndarray, p: Rows, u: Rows) -> tuple[np.ndarray, np.ndarray]:
    return tuple(sigmoid(x.times(w[:-1]) + w[-1]) for x in (p, u))


def risks(s_p: np.ndarray, s_u: np.ndarray, prior: float) -> tuple[float, float]:
    """Risk of the toxic texts and estimated risk of the clean ones from the scores, with the sigmoid loss: a toxic text
    costs 1 - s, a clean one s."""
    return prior * float((1 - s_p).mean()), float(s_u.mean()) - prior * float(s_p.mean())


def gradients(s_p: np.ndarray, s_u: np.ndarray, p: Rows, u: Rows, features: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Of both risks, for the weights and the bias behind them."""
    d_p, d_u = s_p * (1 - s_p) / p.n, s_u * (1 - s_u) / u.n
    of_p = np.r_[p.summed(d_p, features), d_p.sum()]
    of_u = np.r_[u.summed(d_u, features), d_u.sum()]
    return -prior * of_p, of_u - prior * of_p


def train_nnpu(p: Rows, u: Rows, features: int, prior: float, steps: int = 800, rate: float = 0.05,
               decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over all rows."""
    w = np.r_[np.zeros(features), -1.0]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        s_p, s_u = scores(w, p, u)
        of_toxic, of_clean = gradients(s_p, s_u, p, u, features, prior)
        grad = of_toxic + of_clean if risks(s_p, s_u, prior)[1] >= 0 else -of_clean
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def estimated_prior(p: Rows, u: Rows, features: int) -> float:
    """Share of toxic texts among the unlabelled ones, from above: a feature is in unlabelled texts at least as often
    as the toxic ones among them bring it there, so no ratio of its rates is below the share."""
    in_p, in_u = (x.summed(np.ones(x.n), features) / max(x.n, 1) for x in (p, u))
    some = in_p >= LEAST_RATE
    above = in_u[some] + 2 * np.sqrt(in_u[some] * (1 - in_u[some]) / max(u.n, 1))
    return float((above / in_p[some]).min()) if some.any() else 0.5


def fit(docs: DataFrame, labels: DataFrame, rows: int = common.SAMPLE_ROWS,
        max_bytes: int = common.SAMPLE_BYTES) -> PuModel:
    """Learn from bounded samples of ``docs(doc_id, text)``, fold 0 of crc32 modulo 5 left out.

    Confirmed toxic texts are those with ``toxic = 1`` in ``labels``, at most ``rows`` of them; unlabelled ones are
    at most ``UNLABELLED * rows`` documents by a hash of their id, whatever their label. The class prior is the toxic
    share of all labels outside that fold; where none says clean, it is estimated.
    """
    learn = ~common.is_held_out(5, 0) & F.col("doc_id").isNotNull()
    known = labels.filter(learn & F.col("toxic").isNotNull())
    count = known.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") != 1).alias("clean")).first()
    if not count["toxic"]:
        return PuModel()
    toxic = known.filter(F.col("toxic") == 1).select("doc_id").distinct().select(
        "doc_id", F.xxhash64("doc_id").alias("__order"), F.lit(1).alias("__label")).orderBy("__order", "doc_id").limit(rows)
    anyone = docs.filter(learn).select("doc_id").distinct().select(
        "doc_id", F.xxhash64(F.lit(UNLABELLED), "doc_id").alias("__order"), F.lit(0).alias("__label")).orderBy("__order", "doc_id").limit(UNLABELLED * rows)
    prior = count["toxic"] / (count["toxic"] + count["clean"]) if count["clean"] else None
    return fit_sample(common.sample_texts(docs, toxic.unionByName(anyone), max_bytes), prior)


def fit_sample(sample: list[tuple[str, int]], prior: float | None) -> PuModel:
    """Model from (text, confirmed toxic) pairs; 0 only means that a text is not confirmed. Without a prior it is estimated."""
    toxic, unlabelled = [t for t, y in sample if y], [t for t, y in sample if not y]
    if not toxic or not unlabelled:
        return PuModel()
    index = {f: k for k, f in enumerate(choose_features(toxic, unlabelled))}
    p, u = Rows.of(toxic, index), Rows.of(unlabelled, index)
    share = estimated_prior(p, u, len(index)) if prior is None else prior
    return PuModel(index, *train_nnpu(p, u, len(index), min(max(share, 0.01), 0.9)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; repeated rows score alike.

    Null and empty texts score as texts without any known word. Without any toxic label every score is the
    same and below 0.5. Rows without an id are scored and never learned from. No shuffle of texts.
    """
    model = fit(docs, labels)

    def worker():
        memo: dict = {}
        return lambda rows, texts: pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array([model.score(t, memo) for t in texts], pa.float64())], names=["doc_id", "score"])

    scored = common.map_texts(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", worker)
    return scored.select("doc_id", common.is_held_out(5, 0).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score as toxic. All columns pass unchanged, whatever their names; null and empty
    texts stay, repeated rows stay or go together, an empty table stays empty."""
    model = fit(docs, labels)

    def worker():
        memo: dict = {}
        return lambda rows, texts: rows.filter(pa.array([model.score(t, memo) < threshold for t in texts], pa.bool_()))

    return common.map_texts(docs, docs.schema, worker)
