"""Toxicity by classifier chains: linear models in sequence, each fed the probabilities of the ones before.

The chain's models see presence counts of words and word beginnings. A later model learns from out-of-fold
predictions of the earlier ones, so that what it is fed in training is as uncertain as what it is fed in use.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
#: (name, column of labels, value that counts as yes), in the order of the chain; the last is the verdict.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
#: About so many labelled rows, taken by a hash of the id, are learned from.
TRAINING_ROWS = 12_000
BUCKETS = 1 << 20
BEGINNINGS = (4, 5)
#: Features of a fit: the strongest by chi-square, of those beyond chance among so many (but at least a few).
FEATURES, CHANCE, A_FEW = 3_000, 25.0, 20
LEAST_TEXTS = 4
FOLDS = 3
CACHED_WORDS = 200_000


def _features(word: str) -> list[int]:
    b = word.encode()
    return [zlib.crc32(b) % BUCKETS, *(zlib.crc32(b"^" + word[:n].encode()) % BUCKETS for n in BEGINNINGS if len(word) > n)]


def bag(text: str | None, cache: dict[str, list[int]]) -> np.ndarray:
    """Feature numbers of the distinct words of a text."""
    out: list[int] = []
    for w in set(LETTERS.findall((text or "").lower())):
        f = cache.get(w)
        if f is None:
            if len(cache) >= CACHED_WORDS:
                cache.clear()
            f = cache[w] = _features(w)
        out += f
    return np.array(out, dtype=np.int32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Linear:
    """Logistic regression with an L2 penalty, by L-BFGS, on the FEATURES features that tell most."""

    def __init__(self, at: np.ndarray, row: np.ndarray, n: int, y: np.ndarray, fed: np.ndarray, penalty: float = 1.0) -> None:
        pos, all_ = np.bincount(at, weights=y[row], minlength=BUCKETS), np.bincount(at, minlength=BUCKETS).astype(float)
        rate = y.mean()
        expect = all_ * rate
        chi = np.where(all_ >= LEAST_TEXTS, (pos - expect) ** 2 / np.maximum(expect * (1 - rate), 1e-9), 0.0)
        top = np.argsort(-chi, kind="stable")[:FEATURES]
        self.top = np.sort(top[: max(A_FEW, int((chi[top] > CHANCE).sum()))])
        self.top = self.top[chi[self.top] > 0]
        where = np.full(BUCKETS, -1, dtype=np.int32)
        where[self.top] = np.arange(len(self.top))
        use = where[at] >= 0
        a, r = where[at][use], row[use]
        k, m = len(self.top), fed.shape[1]

        def grad(w: np.ndarray) -> tuple[float, np.ndarray]:
            z = np.bincount(r, weights=w[a], minlength=n) + fed @ w[k : k + m] + w[-1]
            p = sigmoid(z)
            loss = np.logaddexp(0, z).sum() - (y * z).sum() + penalty / 2 * (w[:-1] ** 2).sum()
            e = p - y
            g = np.concatenate([np.bincount(a, weights=e[r], minlength=k) + penalty * w[:k], fed.T @ e + penalty * w[k : k + m], [e.sum()]])
            return loss, g

        start = np.zeros(k + m + 1)
        start[-1] = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
        self.w = lbfgs(grad, start)
        self.k = k

    def logits(self, at: np.ndarray, row: np.ndarray, n: int, fed: np.ndarray) -> np.ndarray:
        dense = np.zeros(BUCKETS)
        dense[self.top] = self.w[: self.k]
        return np.bincount(row, weights=dense[at], minlength=n) + fed @ self.w[self.k : -1] + self.w[-1]


def lbfgs(grad, w: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    loss, g = grad(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y in reversed(pairs):
            alphas.append(s @ d / (s @ y))
            d = d - alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, np.abs(g).max())
        for (s, y), alpha in zip(pairs, reversed(alphas), strict=True):
            d = d + (alpha - y @ d / (s @ y)) * s
        step, slope = 1.0, g @ d
        while True:
            new, new_g = grad(w + step * d)
            if new <= loss + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        if step < 1e-8 or loss - new < 1e-7 * max(1.0, abs(loss)):
            return w + step * d if new < loss else w
        if (s := step * d) @ (y := new_g - g) > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y)] if len(pairs) >= memory else [*pairs, (s, y)]
        w, loss, g = w + step * d, new, new_g
    return w


class Chain:
    """Models of the chain and the threshold of its last category; fitted on rows given as bags and labels."""

    def __init__(self, bags: Sequence[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> None:
        n = len(bags)
        row = np.repeat(np.arange(n, dtype=np.int32), [len(b) for b in bags])
        at = np.concatenate(bags) if n else np.zeros(0, dtype=np.int32)
        often = np.bincount(at, minlength=BUCKETS) >= LEAST_TEXTS  # what is rarer can't be chosen by any fit
        use = often[at]
        at, row = at[use], row[use]
        fed, self.models = np.zeros((n, 0)), []
        for j in range(labels.shape[1]):
            y = labels[:, j].astype(float)
            oof = np.zeros(n)
            for f in range(FOLDS):
                train = fold != f
                if not train.any() or train.all():
                    continue
                into = np.cumsum(train) - 1
                use = train[row]
                m = Linear(at[use], into[row[use]], int(train.sum()), y[train], fed[train])
                oof[~train] = sigmoid(m.logits(at, row, n, fed))[~train]
            self.models.append(Linear(at, row, n, y, fed))
            fed = np.column_stack([fed, oof])
        self.threshold = best_threshold(fed[:, -1], labels[:, -1]) if n else 1.0

    def probabilities(self, bags: Sequence[np.ndarray]) -> np.ndarray:
        n = len(bags)
        row = np.repeat(np.arange(n, dtype=np.int32), [len(b) for b in bags])
        at = np.concatenate(bags) if n else np.zeros(0, dtype=np.int32)
        fed = np.zeros((n, 0))
        for m in self.models:
            fed = np.column_stack([fed, sigmoid(m.logits(at, row, n, fed))])
        return fed


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability, halfway to the next lower one, from which on F1 is highest."""
    o = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[o])
    f1 = 2 * hit / (np.arange(1, len(o) + 1) + max(1, y.sum()))
    k = int(np.argmax(f1))
    return float((p[o[k]] + (p[o[k + 1]] if k + 1 < len(o) else 0.0)) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: Sequence[tuple[str, str, int]] = CHAIN, rows: int = TRAINING_ROWS) -> Chain | None:
    """The chain, from about ``rows`` labelled documents with all labels; None if there are none.

    The labels taken, a bounded number, are broadcast to the documents; only feature numbers come to the driver.
    """
    cols = [c for _, c, _ in chain]
    known = labels.where(F.col(id_col).isNotNull()).dropna(subset=cols).select(F.col(id_col).alias("_label_id"), *[(F.col(c) == v).cast("int").alias(f"_y{i}") for i, (_, c, v) in enumerate(chain)])
    share = min(1.0, rows / max(1, known.count()))
    pick = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "_label_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).join(F.broadcast(pick), F.col("_id") == F.col("_label_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, list[int]] = {}
        for b in batches:
            out = b.drop(columns="t")
            out["bag"] = [bag(t, cache).tobytes() for t in b["t"]]
            yield out

    ys = [f"_y{i}" for i in range(len(chain))]
    d = d.select("_id", "t", *ys, F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(FOLDS)).cast("int").alias("_fold"))
    got = d.mapInPandas(run, f"_id {dict(d.dtypes)['_id']}, {', '.join(f'{y} int' for y in ys)}, _fold int, bag binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["_id", "bag"], kind="stable")  # sums in one order: reruns agree
    return Chain([np.frombuffer(b, dtype=np.int32) for b in got["bag"]], got[ys].to_numpy(), got["_fold"].to_numpy())


def predict(docs: DataFrame, model: Chain | None, id_col: str = "doc_id", text_col: str = "text", chain: Sequence[tuple[str, str, int]] = CHAIN) -> DataFrame:
    """Per row: id, p_<category> for each of the chain, and the last category as boolean: its probability is at least the
    threshold.

    Null texts and texts without words are false with probability 0, as is every row without a model. Repeated rows are
    scored alike; long texts are scored whole, by their distinct words; other columns play no part. An empty table gives
    an empty result.
    """
    names = [name for name, _, _ in chain]
    if model is None:
        return docs.select(F.col(id_col), *[F.lit(0.0).alias(f"p_{x}") for x in names], F.lit(False).alias(names[-1]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cache = shared.value, {}
        for b in batches:
            bags = [bag(t, cache) for t in b["t"]]
            p = m.probabilities(bags) * np.array([[len(x) > 0] for x in bags])
            out = pd.DataFrame({"_id": b["_id"]})
            for i, x in enumerate(names):
                out[f"p_{x}"] = p[:, i]
            out[names[-1]] = p[:, -1] >= m.threshold
            yield out

    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t"))
    schema = f"_id {dict(d.dtypes)['_id']}, {', '.join(f'p_{x} double' for x in names)}, {names[-1]} boolean"
    return d.mapInPandas(run, schema).withColumnRenamed("_id", id_col)
