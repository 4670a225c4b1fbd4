"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: words and word pairs, shapes of words (letters as a or A, digits as 9,
runs shortened) and pairs of them, and words that follow themselves once or twice. Each indicator is scaled by the log ratio of its smoothed shares in the two
classes, a text's scaled vector is brought to length 1, and a linear hinge-loss model is fitted by dual coordinate
descent. A logistic curve, fitted to margins of held-back folds, turns margins into probabilities.

The fit takes a bounded sample of labelled documents (``per_class`` of each class, by a hash of the id) to the driver as
feature numbers; every document is scored in Spark.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.llm.common import held_out, mix64, slices, words

BITS = 18
PER_CLASS = 2500
THRESHOLD = 0.7
CACHE = 300_000
FEATURE_BYTES = 2 << 20  # text whose features a worker lists at once; they take some 20 times its bytes
SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "9"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))


def shape(token: str) -> str:
    for pattern, to in SHAPES:
        token = pattern.sub(to, token)
    return token


def features(text: pa.Array, cache: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of the texts, in order of row and feature."""
    offsets, codes, names = words(text, lower=False)
    rows = len(offsets) - 1
    of_name = np.empty((2, len(names)), np.uint64)
    for k, token in enumerate(names.to_pylist()):
        known = cache.get(token)
        if known is None:
            known = xxhash.xxh64_intdigest(token.lower()), xxhash.xxh64_intdigest(shape(token), 1)
            if len(cache) >= CACHE:
                cache.clear()
            cache[token] = known
        of_name[0, k], of_name[1, k] = known
    doc = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    pair = doc[1:] == doc[:-1]
    found = []
    for kind in (0, 1):
        h = of_name[kind][codes]
        found.append((doc << BITS) | (mix64(h) >> np.uint64(64 - BITS)).astype(np.int64))
        two = mix64(h[:-1] * np.uint64(0x2545F4914F6CDD1D) + h[1:])
        found.append(((doc[1:] << BITS) | (two >> np.uint64(64 - BITS)).astype(np.int64))[pair])
    same = (codes[1:] == codes[:-1]) & pair
    found += [doc[1:][same] << BITS, (doc[2:][same[1:] & same[:-1]] << BITS) | 1]
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def descend(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, dims: int, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for the hinge loss: min |w|^2 / 2 + sum cost_i max(0, 1 - y_i w x_i)."""
    w, alpha = np.zeros(dims), np.zeros(len(x))
    square = np.array([float(v @ v) for _, v in x])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            at, v = x[i]
            if square[i] == 0:
                continue
            new = min(max(alpha[i] - (y[i] * float(w[at] @ v) - 1) / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[at] += step * y[i] * v
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed targets."""
    pos, neg = weight[y > 0].sum(), weight[y < 0].sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g, s = weight * (p - goal), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * margin).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class Model:
    ratio: np.ndarray   # log-count ratio per feature
    weight: np.ndarray  # linear weight per feature, then the bias
    a: float
    b: float

    def margins(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        r = self.ratio[feature].astype(np.float64)
        norm = np.sqrt(np.bincount(row, r * r, minlength=rows))
        return np.bincount(row, r * self.weight[feature], minlength=rows) / np.where(norm > 0, norm, 1) + self.weight[-1]

    def scores(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(row, feature, rows) + self.b, -35, 35)))


def train(sets: list[np.ndarray], y: np.ndarray, weight: np.ndarray, folds: int = 3) -> Model:
    """sets: the distinct features of each text; y: 1 or -1; weight: rows of the corpus that a row stands for."""
    dims = 1 << BITS
    if len(set(y.tolist())) < 2:  # nothing to tell apart
        share = float(np.clip((weight * (y > 0)).sum() / max(weight.sum(), 1), 0.01, 0.99)) if len(y) else 0.5
        return Model(np.zeros(dims, np.float32), np.zeros(dims + 1), 0.0, float(np.log(share / (1 - share))))

    def ratios(rows: np.ndarray) -> np.ndarray:
        p, q = (1 + np.bincount(np.concatenate([sets[i] for i in rows if y[i] == c] or [np.zeros(0, np.int64)]), minlength=dims) for c in (1, -1))
        return np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)

    def fitted(rows: np.ndarray) -> Model:
        r = ratios(rows)
        x = []
        for i in rows:
            v = r[sets[i]].astype(np.float64)
            n = np.sqrt(v @ v)
            x.append((np.append(sets[i], dims), np.append(v / n if n > 0 else v, 1.0)))
        own = y[rows]
        cost = np.where(own > 0, len(own) / 2 / max(1, (own > 0).sum()), len(own) / 2 / max(1, (own < 0).sum()))
        return Model(r, descend(x, own, cost, dims + 1), 1.0, 0.0)

    def margins(m: Model, rows: np.ndarray) -> np.ndarray:
        return m.margins(np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows]), np.concatenate([sets[i] for i in rows]), len(rows)) if len(rows) else np.zeros(0)

    fold, out = np.random.default_rng(11).permutation(len(y)) % folds, np.zeros(len(y))
    for f in range(folds):
        rest = np.flatnonzero(fold != f)
        if len(set(y[rest].tolist())) == 2:
            out[fold == f] = margins(fitted(rest), np.flatnonzero(fold == f))
    model = fitted(np.arange(len(y)))
    model.a, model.b = logistic(out, y, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learns from about ``per_class`` labelled documents of each class that aren't held out. A document with several labels counts as the highest."""
    marked = (labels.filter(~held_out(id_col, modulus)).filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")))
    sizes = dict(marked.groupBy("y").count().collect())
    share = F.when(F.col("y") == 1, min(1.0, per_class / sizes.get(1, 1))).otherwise(min(1.0, per_class / sizes.get(0, 1)))
    picked = marked.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("y", "text")  # the sample is bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in slices(batches, limit=FEATURE_BYTES):
            row, feature = features(batch.column(1), cache)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(feature.astype(np.int32)))], ["y", "f"])

    found = rows.mapInArrow(run, "y int, f array<int>").toPandas()
    lists = [np.asarray(f, np.int64) for f in found["f"]]
    # order by content, so that the fit doesn't depend on the order of partitions
    order = sorted(range(len(found)), key=lambda i: (found["y"][i], len(lists[i]), lists[i].tobytes()))
    sets = [lists[i] for i in order]
    y = np.where(found["y"].to_numpy(int)[order] > 0, 1, -1) if order else np.zeros(0, int)
    weight = np.where(y > 0, max(1, sizes.get(1, 1)) / max(1, (y > 0).sum()), max(1, sizes.get(0, 1)) / max(1, (y < 0).sum()))
    return train(sets, y, weight / max(weight.mean(), 1e-9) if len(weight) else weight)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, modulus: int = 4) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have no feature and get the score of the bias alone. A model without both classes scores
    every text alike. Null ids are never held out. Repeated rows are scored each; an empty table gives no
    rows. Reads the id and the text only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in slices(batches, limit=FEATURE_BYTES):
            p = shared.value.scores(*features(batch.column(2), cache), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, modulus).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4) -> DataFrame:
    """Learns from labelled documents that aren't held out and scores every document; see ``fit`` and ``score``."""
    return score(docs, fit(docs, labels, modulus), modulus=modulus)


def passing(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, modulus: int = 4) -> DataFrame:
    """The documents with a score of ``threshold`` or more, with all their columns and in one pass; rows without an id are scored like others."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulus, text_col=text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in slices(batches, at, FEATURE_BYTES):
            yield batch.filter(pa.array(shared.value.scores(*features(batch.column(at), cache), batch.num_rows) >= threshold))

    return docs.mapInArrow(run, docs.schema)
