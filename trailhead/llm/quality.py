"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator (Kiryo et al. 2017).

Trusted positives are labelled rows of quality 1, unlabelled rows are web text whatever its label. The class prior is estimated from these two
alone, by the best bin of a classifier of positive against unlabelled (Garg et al. 2021); negative labels aren't read. A linear model over
whole-text statistics and hashed words and word pairs is fitted on bounded samples (``bound`` rows of each kind), and every row is scored in one narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhead.llm.common import named, small_batches
from trailhead.llm.textops import parts, release, runs, tidy, word_hashes

_KINDS = np.zeros(256, np.int64)
for _b in range(256):
    _KINDS[_b] = 1 if 97 <= _b < 123 else 2 if 65 <= _b < 91 else 3 if 48 <= _b < 58 else 4 if _b in (9, 10, 11, 12, 13, 32) else 5 if _b >= 128 else 0
#: Bytes with a share of their own: ASCII that is neither letter nor digit.
_MARKS = [b for b in range(32, 127) if not chr(b).isalnum()]
#: Buckets of hashed words, and as many of hashed word pairs.
BUCKETS = 128
N_FEATURES = 6 + 14 + len(_MARKS) + 2 * BUCKETS
#: Hashed features count by this factor beside the statistics, each of which says more.
HASHED = 0.25
#: Added to a text's number of words in these shares: a few words say little of a text's vocabulary.
FEW = 20


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text and the shares of its hashed words and pairs; finite for any text, empty and null texts included."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    hist = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    kinds = np.bincount(_KINDS, weights=hist, minlength=6)
    words = word_hashes(text)
    m = len(words)
    hashed = np.zeros(2 * BUCKETS)
    if m:
        _, counts = np.unique(words, return_counts=True)
        distinct, top = len(counts) / m, counts.max() / m
        again = (words[1:] == words[:-1]).mean() if m > 1 else 0.0
        pairs = runs(words, 2)
        pair_distinct = len(np.unique(pairs)) / len(pairs)
        for i, x in enumerate((words, pairs)):
            hashed[i * BUCKETS : (i + 1) * BUCKETS] = np.bincount((x >> np.uint64(32)).astype(np.int64) % BUCKETS, minlength=BUCKETS) / (len(x) + FEW)
    else:
        distinct = top = again = pair_distinct = 0.0
    space = kinds[4]
    letters = max(1.0, kinds[1] + kinds[2] + kinds[5])
    more = [np.log1p(m) / 10, np.log1p(n) / 10, float(m == 0), distinct, top, again, pair_distinct, distinct * (m < 50), min(20.0, (n - space) / max(1, m)) / 10, hist[10] / max(1, m), kinds[2] / letters, kinds[0] / max(1, m), kinds[3] / n, np.sqrt(kinds[0] / n)]
    return np.concatenate([kinds / n, more, np.sqrt(hist[_MARKS] / max(1, m)), np.sqrt(hashed)]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = _standard(x, self.mean, self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    if x.shape[1] == N_FEATURES:
        scale[-2 * BUCKETS :] /= HASHED
    return mean, scale


def _descend(gradient, size: int, rounds: int, rate: float) -> np.ndarray:
    """Full-batch Adam from zero."""
    w, m, v = np.zeros((3, size))
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip((x @ w[:-1].astype(x.dtype)).astype(np.float64) + w[-1], -35, 35)


def _mean_of(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The mean over rows of by * (row, 1)."""
    return np.r_[(by.astype(x.dtype) @ x).astype(np.float64), by.sum()] / len(x)


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The parts of the positive-unlabelled risk for weights and bias w: prior * E_p[l(z)] and E_u[l(-z)] - prior * E_p[l(-z)], with the logistic loss l."""
    zp, zu = _logits(p, w), _logits(u, w)
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk, the first part of ``risk`` plus the second where that is positive; where it is negative, its
    gradient is followed upwards. No positives or no unlabelled rows: every score is 0.5."""
    if not len(positive) or not len(unlabelled):
        d = positive.shape[1]
        return Model(np.zeros(d), 0.0, np.zeros(d), np.ones(d))
    mean, scale = _scale(unlabelled)
    p, u = _standard(positive, mean, scale), _standard(unlabelled, mean, scale)

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = _logits(p, w), _logits(u, w)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_neg = _mean_of(u, su) - prior * _mean_of(p, sp)
        g = prior * _mean_of(p, sp - 1) + g_neg if negative >= 0 else -g_neg
        return g + decay * np.r_[w[:-1], 0]

    w = _descend(gradient, p.shape[1] + 1, rounds, rate)
    return Model(w[:-1], float(w[-1]), mean, scale)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled, from scores of both: in the top bin of scores that is nearly all positive, unlabelled rows
    are as frequent as positive ones times that share. Of all bins the one whose upper confidence bound is least."""
    p, u = np.sort(positive), np.sort(unlabelled)
    qp = 1 - np.searchsorted(p, p, "left") / len(p)
    qu = 1 - np.searchsorted(u, p, "left") / len(u)
    slack = sum(np.sqrt(np.log(4 / sure) / (2 * len(x))) for x in (p, u))
    at = int(np.argmin((qu + (1 + gamma) * slack) / qp))
    return float(qu[at] / qp[at])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 100) -> float:
    """The class prior from positives and unlabelled rows alone: each half is scored by a classifier that the other half has taught to tell the two apart."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    mean, scale = _scale(unlabelled)
    found = []
    for half in (0, 1):
        p, u = (_standard(x[half::2], mean, scale) for x in (positive, unlabelled))
        w = _descend(lambda w, p=p, u=u: _mean_of(p, 1 / (1 + np.exp(-_logits(p, w))) - 1) + _mean_of(u, 1 / (1 + np.exp(-_logits(u, w)))) + 1e-3 * np.r_[w[:-1], 0], p.shape[1] + 1, rounds, 0.05)
        found.append(best_bin(*(_logits(_standard(x[1 - half :: 2], mean, scale), w) for x in (positive, unlabelled))))
    return min(0.99, max(0.01, sum(found) / 2))


def held_out(key: str) -> Column:
    """True where crc32 of the key as text leaves 0 modulo 5; rows without a key are held out too."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sample(df: DataFrame, rows: int, bound: int, key: str) -> DataFrame:
    """About bound rows of df at most, chosen by a hash of the key."""
    rate = min(1.0, bound / max(1, rows))
    return df.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) < int(rate * (1 << 30))).limit(2 * bound)


def _matrix(df: DataFrame, text: str) -> np.ndarray:
    def run(batches):
        for _, texts in parts(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([features(t).tobytes() for t in texts], pa.binary())], ["x"])

    with small_batches(df.sparkSession):
        got = df.select(named(text)).mapInArrow(tidy(run), "x binary").toArrow().column(0).to_pylist()
    return np.frombuffer(b"".join(got), np.float32).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = 12000, prior: float | None = None) -> Model:
    """Fit on at most about ``bound`` trusted positives and ``bound`` unlabelled rows; held-out rows' labels aren't read, nor are labels other than 1.

    prior: the class prior; None estimates it from the two samples. Null labels and keys are left out.
    """
    mine = labels.where(~held_out(key) & (named(label) == 1)).select(named(key).alias("k"))
    ids = _sample(mine, mine.count(), bound, "k").distinct()
    rows = docs.select(named(key).alias("k"), named(text).alias("t"))
    trusted = rows.join(F.broadcast(ids), "k", "left_semi")  # bounded by limit()
    plain = _sample(rows.where("k is not null"), docs.count(), bound, "k")
    positive, unlabelled = _matrix(trusted.limit(2 * bound), "t"), _matrix(plain, "t")
    model = fit_nnpu(positive, unlabelled, estimate_prior(positive, unlabelled) if prior is None else prior)
    del positive, unlabelled
    release()
    return model


def score(text: Column, model: Model) -> Column:
    """The score column of whole texts: from 0 to 1, higher where quality 1 is likelier; nulls score as empty texts."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        found = [model.score(np.stack([features(t.as_py()) for t in texts.slice(lo, 256)])) for lo in range(0, len(texts), 256)]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, **how) -> DataFrame:
    """One row per row of docs: key, held_out, score, predicted (1 if score >= threshold, else 0). Empty tables give no rows;
    without trusted positives every score is 0.5. Null and empty texts are scored, rows that repeat a key each; extra columns aren't read."""
    model = fit(docs, labels, key, text, **how)
    s = docs.select(named(key), held_out(key).alias("held_out"), score(named(text), model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, **how) -> DataFrame:
    """docs without the rows that score below threshold; rows of one text go or stay alike."""
    return docs.where(score(named(text), fit(docs, labels, key, text, **how)) >= threshold)
