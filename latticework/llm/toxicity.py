"""[2] Toxicity by non-negative positive-unlabelled learning.

A linear classifier over character n-grams is trained from confirmed toxic texts and unlabelled ones. The unlabelled texts hold toxic ones too;
the risk of calling them clean is therefore corrected by the class prior, and where the corrected part falls below zero, which only
overfitting does, its gradient is turned round (the non-negative estimator). Labels of clean texts serve for the prior alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bucket_crc, crc_mod

#: Training texts: about this many, chosen by a hash of the id, however large the table is. The classifier is fitted on the driver.
MAX_POSITIVE, MAX_UNLABELLED = 1500, 3000
#: n-grams in the model.
MAX_FEATURES = 1500
#: A text shares at most this part of its sampled word triples with an earlier positive one; else it is a copy and teaches nothing new.
COPY = 0.4
#: A feature's log-likelihood ratio against 'as frequent in either set' is at least this, as very many n-grams are tried.
SURE = 15.0
BUCKETS = 1 << 22
FOLDS, HELD_OUT = 4, 2
PREDICT_FROM = 0.3

_LETTERS = re.compile(r"[^\W\d_]+")


def prepared(text: str) -> str:
    """Lower-case runs of letters, each between < and >."""
    return "<" + "><".join(_LETTERS.findall(text.lower())) + ">"


def grams(line: str) -> set[str]:
    """Whole words, and all runs of 4 and 5 characters of a word with its marks."""
    out: set[str] = set()
    for word in set(line[1:-1].split("><")):
        marked = f"<{word}>"
        out.add(marked)
        for n in (4, 5):
            out.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return out


def without_copies(lines: list[str], most: float = COPY, size: int = 64) -> list[str]:
    """Texts unlike all earlier ones, by the overlap of their word triples with the smallest hashes."""
    kept: list[tuple[set[int], str]] = []
    for line in lines:
        words = line[1:-1].split("><")
        low = set(sorted({zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))})[:size])
        if all(len(low & other) <= most * len(low) for other, _ in kept):
            kept.append((low, line))
    return [line for _, line in kept]


def hashed(line: str) -> list[int]:
    """A bucket for each n-gram of a text."""
    return list({zlib.crc32(g.encode()) % BUCKETS for g in grams(line)})


def evidence(a: np.ndarray, b: np.ndarray, n_pos: int, n_unl: int) -> np.ndarray:
    """Log-likelihood ratio of 'more frequent in the a of n_pos positives than in the b of n_unl others' against 'as frequent'; 0 where it's less than 2.5 times as frequent."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    both = (a + b) / (n_pos + n_unl)

    def part(k: np.ndarray, n: int, rate: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / n / rate), 0.0)

    total = part(a, n_pos, both) + part(b, n_unl, both) + part(n_pos - a, n_pos, 1 - both) + part(n_unl - b, n_unl, 1 - both)
    return np.where((a >= 3) & (a / n_pos > 2.5 * b / n_unl), total, 0.0)


def pick_features(positive: list[str], unlabelled: list[str], most: int = MAX_FEATURES) -> list[str]:
    """n-grams that are clearly more frequent among the positives. They are counted in buckets first, so that memory doesn't grow with the texts."""
    positive = without_copies(positive)
    n_pos, n_unl = len(positive), len(unlabelled)
    counts = np.zeros((2, BUCKETS), np.int32)
    for row, lines in zip(counts, (positive, unlabelled), strict=True):
        for line in lines:
            row[hashed(line)] += 1
    often = np.flatnonzero(counts[0] >= 3)
    sure = np.zeros(BUCKETS, bool)
    sure[often] = evidence(*counts[:, often], n_pos, n_unl) >= SURE
    p = Counter(g for x in positive for g in grams(x) if sure[zlib.crc32(g.encode()) % BUCKETS])
    names = sorted(p)
    u: Counter[str] = Counter()
    for x in unlabelled:
        u.update(p.keys() & grams(x))
    score = evidence(np.array([p[g] for g in names]), np.array([u[g] for g in names]), n_pos, n_unl)
    return [names[i] for i in np.argsort(-score, kind="stable")[:most] if score[i] >= SURE]


def fit_nnpu(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, penalty: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights by full-batch Adam on the non-negative risk with the logistic loss; the bias is then moved some way to where
    the mean probability over the unlabelled texts is the prior: with few positives the risk's own is too high, as it can't tell noise from signs."""
    w, b = np.zeros(x_pos.shape[1]), float(np.log(prior / (1 - prior)))
    m = v = np.zeros(len(w) + 1)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, rounds + 1):
        w32 = w.astype(np.float32)
        zp, zu = x_pos @ w32 + np.float64(b), x_unl @ w32 + np.float64(b)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = sigma(zp) / len(zp), sigma(zu) / len(zu)  # of log(1 + e^z)
        if negative >= 0:
            dp, du = prior * (sigma(zp) - 1) / len(zp) - prior * gp, gu
        else:
            dp, du = prior * gp, -gu
        grad = np.append(dp.astype(np.float32) @ x_pos + du.astype(np.float32) @ x_unl + penalty * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    low, high, own = -40.0, 40.0, b
    z = x_unl @ w.astype(np.float32)
    for _ in range(60):
        b = (low + high) / 2
        low, high = (b, high) if sigma(z + b).mean() < prior else (low, b)
    return w, 0.7 * own + 0.3 * b


class Model:
    """Features with weights. ``score`` is the logistic of their sum over the distinct features that a text has."""

    def __init__(self, features: list[str], weights: list[float], bias: float):
        self.features, self.weights, self.bias = tuple(features), tuple(weights), bias

    def score(self, text: str) -> float:
        z, found = self.bias, set()
        if self.features and text:
            machine = _machine(self.features)
            for _, i in machine.iter(prepared(text)):
                found.add(i)
            z += sum(self.weights[i] for i in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


@lru_cache(maxsize=2)
def _machine(features: tuple[str, ...]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, g in enumerate(features):
        machine.add_word(g, i)
    machine.make_automaton()
    return machine


def train(positive: list[str], unlabelled: list[str], prior: float) -> Model:
    """Without positive or unlabelled texts the model is the prior alone."""
    prior = min(max(prior, 1e-3), 0.9)
    p, u = [prepared(x) for x in positive], [prepared(x) for x in unlabelled]
    features = pick_features(p, u) if p and u else []
    if not features:
        return Model([], [], float(np.log(prior / (1 - prior))))
    at = {g: i for i, g in enumerate(features)}

    def matrix(lines: list[str]) -> np.ndarray:
        out = np.zeros((len(lines), len(features)), np.float32)
        for i, line in enumerate(lines):
            out[i, [at[g] for g in at.keys() & grams(line)]] = 1
        return out

    w, b = fit_nnpu(matrix(p), matrix(u), prior)
    return Model(features, w.tolist(), b)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """A model from the rows that aren't held out. Where labels of an id differ, toxic wins; null labels don't count."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (bucket_crc(key, FOLDS) != HELD_OUT)).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_y"))
    counts = {r["_y"]: r["count"] for r in marked.groupBy("_y").count().collect()}
    n_pos, n_all = counts.get(1, 0), sum(counts.values())
    prior = n_pos / n_all if n_all else 0.0
    draw = lambda k: F.crc32(F.concat(F.col(k).cast("string"), F.lit(":sample")).cast("binary")) / F.lit(4294967296.0)
    free = docs.where(F.col(key).isNotNull() & (bucket_crc(key, FOLDS) != HELD_OUT)).select(F.col(key).alias("_d"), F.col(text).alias("_t"))
    n_free = free.select("_d").count()
    chosen = marked.where((F.col("_y") == 1) & (draw("_k") < min(1.0, max_positive / max(1, n_pos)))).select("_k")
    positive = [r["_t"] or "" for r in free.join(F.broadcast(chosen), F.col("_d") == F.col("_k"), "left_semi").orderBy("_d", "_t").collect()]
    unlabelled = [r["_t"] or "" for r in free.where(draw("_d") < min(1.0, max_unlabelled / max(1, n_free))).orderBy("_d", "_t").collect()]
    return train(positive, unlabelled, prior)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", predict_from: float = PREDICT_FROM) -> DataFrame:
    """(key, held_out, score, predicted) for every row. A null text scores as an empty one. Repeated rows score alike; other columns aren't read."""
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [model.score(x or "") for x in batch.column(1).to_pylist()]
            held = [crc_mod(k, FOLDS) == HELD_OUT for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(s, pa.float64()), pa.array([int(x >= predict_from) for x in s], pa.int32())], schema=schema)

    return docs.select(key, text).mapInArrow(scored, f"`{key}` {kind.simpleString()}, held_out boolean, score double, predicted int")
