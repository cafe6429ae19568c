"""Toxicity scores by non-negative positive-unlabelled learning.

Known are some toxic documents (positives) and many of which nothing is known (unlabelled, of which a share ``prior`` is toxic).
With l the logistic loss the risk of a linear score g is estimated as

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

The second part estimates the risk on clean text; where it falls below zero the model has begun to memorise the positives, and the step
ascends it instead. Only words that are surely commoner among the positives take part, as most say nothing.

Features: which of 2**18 hashed words (letters and digits, A-Z folded) and word beginnings a text has. Training uses at most ``max_positive`` positives and
``max_unlabelled`` other rows, and ``max_bytes`` of the features of either, for each of ``members`` classifiers, chosen by hash; each is trained in a task of its own, and
their mean log-odds is the score. Scoring is a map over all whole texts. Null and empty texts get the score of no words. Without a positive
the score of all is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .common import keep, text_of

BITS = 18
#: Bytes of the word beginnings that are features beside whole words: inflected insults share only these.
STEMS = (4, 5, 6)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of every distinct word and stem of each text, sorted by text."""
    starts, ends, rows = vec.words(buf, offs, vec.IS_BREAK)
    keys = []
    for k in (0, *STEMS):
        long = slice(None) if not k else ends - starts > k
        h = vec.word_hashes(buf, starts[long], ends[long] if not k else starts[long] + k)
        keys.append((rows[long].astype(np.uint64) << np.uint64(BITS)) | (vec.mix(h + np.uint64(k)) >> np.uint64(64 - BITS)))
    key = np.unique(np.concatenate(keys))
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, offs in vec.chunks(batch, "text"):
            rows, feats = features(buf, offs)
            at = np.searchsorted(rows, np.arange(len(offs)))
            feats = feats.astype("<i4")
            packed = pa.array([feats[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], packed], ["member", "positive", "k", "features"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sparse:
    """Rows of feature numbers, with the two products that training needs."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def mean(self, c: np.ndarray) -> np.ndarray:
        """Mean over rows of c[row] * features."""
        return np.bincount(self.col, c[self.row], self.width) / max(self.n, 1)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.5, share: float = 0.9, sure: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, weights and bias. A feature takes part if two positives or more have it, and surely ``share / prior`` times as often as the unlabelled."""
    seen, times = np.unique(np.concatenate([*positive, np.zeros(0, np.int64)]), return_counts=True)
    other = np.bincount(np.concatenate([*unlabelled, np.zeros(0, np.int64)]), minlength=1 << BITS)[seen]
    # a word that only toxic texts have is 1 / prior times commoner among the positives; chance is allowed for on both sides
    n, m = max(len(positive), 1), max(len(unlabelled), 1)
    least = times / n - sure * np.sqrt(times) / n
    most = (other + sure * np.sqrt(other + 1)) / m
    feats = seen[(times >= 2) & (least > 0) & (least >= share / prior * most)]

    def narrowed(rows):
        return Sparse([np.searchsorted(feats, r[np.isin(r, feats, assume_unique=True)]) for r in rows], len(feats))

    w, bias = _descend(narrowed(positive), narrowed(unlabelled), prior, steps, rate)
    return feats, w, bias


def _descend(p: Sparse, u: Sparse, prior: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adagrad, whose own rate for each feature lets rare, telling words move as fast as common ones."""
    w, bias, seen, seen_b = np.zeros(p.width), float(np.log(prior / (1 - prior))), np.full(p.width, 1e-8), 1e-8
    for _ in range(steps):
        gp, gu = p.times(w) + bias, u.times(w) + bias
        clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        cu, cp = _sigmoid(gu), -prior * _sigmoid(gp)
        pull = -prior * _sigmoid(-gp)
        if clean >= 0:
            grad, grad_b = p.mean(pull + cp) + u.mean(cu), (pull + cp).mean() + cu.mean()
        else:
            grad, grad_b = -p.mean(cp) - u.mean(cu), -cp.mean() - cu.mean()
        seen += grad**2
        seen_b += grad_b**2
        step = rate / np.sqrt(seen)
        w -= step * grad
        bias -= 0.3 * rate * grad_b / np.sqrt(seen_b)
    return w, bias


def _train(prior: float):
    def run(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, "<i4").astype(np.int64) for x in table.column("features").to_pylist()]
        positive = table.column("positive").to_pylist()
        feats, w, bias = fit([r for r, y in zip(rows, positive, strict=True) if y], [r for r, y in zip(rows, positive, strict=True) if not y], prior)
        member = table.column("member")[0].as_py()
        return pa.table({"member": pa.array([member] * (len(feats) + 1), pa.int32()), "feature": pa.array([-1, *feats.tolist()], pa.int64()), "weight": pa.array([bias, *w.tolist()], pa.float64())})

    return run


def training_rows(keys: DataFrame, texts: DataFrame, members: int = 3, max_positive: int = 6000, max_unlabelled: int = 12000, max_bytes: int = 64 << 20, seed: int = 3) -> DataFrame:
    """(member, positive, k, features) of the rows that each member trains on.

    ``keys``: key, positive (true: known toxic, else unlabelled); ``texts``: key, text. Each member takes the keys that hash least under
    its own seed, up to the two limits, and of those the first that hold ``max_bytes`` of features (of positives, and of others; the last one may
    exceed it), so that very long texts cannot fill a task. At most ``members * (max_positive + max_unlabelled)`` keys are thus broadcast to the scan of the
    texts, which do not move; only the features of the chosen ones do.
    """
    parts = None
    for m in range(members):
        mine = keys.withColumn("__k", F.xxhash64("key", F.lit(seed + m)))
        for flag, most in ((True, max_positive), (False, max_unlabelled)):
            x = mine.where(F.col("positive") == flag).orderBy("__k").limit(most).select(F.lit(m).alias("member"), "positive", F.col("__k").alias("k"), "key")
            parts = x if parts is None else parts.unionByName(x)
    chosen = texts.join(F.broadcast(keep(parts.distinct(), "toxic-chosen")), "key").select("member", "positive", "k", text_of("text").alias("text"))
    feats = chosen.mapInArrow(_featurise, "member int, positive boolean, k long, features binary")
    size = F.sum(F.octet_length("features")).over(Window.partitionBy("member", "positive").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    return feats.withColumn("before", F.coalesce(size, F.lit(0))).where(F.col("before") < max_bytes).drop("before")


def train(keys: DataFrame, texts: DataFrame, prior: float, members: int = 3, **limits: int) -> np.ndarray | None:
    """Mean weights of the members, the bias last; None without a positive. ``keys``, ``texts`` and ``limits`` are those of ``training_rows``."""
    feats = training_rows(keys, texts, members, **limits)
    weights = feats.groupBy("member").applyInArrow(_train(prior), "member int, feature long, weight double").groupBy("feature").agg(F.sum("weight").alias("w")).collect()
    if not any(r["feature"] >= 0 for r in weights):
        return None
    out = np.zeros((1 << BITS) + 1)
    for r in weights:
        out[r["feature"]] = r["w"] / members
    return out


def _score(weights: np.ndarray | None, text: str, out: str):
    at = np.flatnonzero(weights[:-1]) if weights is not None else None
    value, bias = (weights[at], weights[-1]) if weights is not None else (None, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        if at is not None:
            w[at] = value
        for batch in batches:
            for part, buf, offs in vec.chunks(batch, text):
                n = len(offs) - 1
                if at is None:
                    score = np.zeros(n)
                else:
                    rows, feats = features(buf, offs)
                    score = _sigmoid(np.bincount(rows, w[feats], n) + bias)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, out])

    return run


def score(docs: DataFrame, weights: np.ndarray | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score, 0 to 1; a column of that name is replaced."""
    from pyspark.sql import types as T

    docs = docs.drop(out) if out in docs.columns else docs
    return docs.mapInArrow(_score(weights, text, out), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), False)]))
