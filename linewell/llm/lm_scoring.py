"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, beside exact unigrams.

A token is a word or the end of a text. Its probability is that of its class times that within the class. The most frequent
tokens, in order of count, fill all classes but the last, which holds every other token and spreads by smoothed counts.
Both factors are log-linear in hashed features of the history: the word before, the two before, and the second
and third before alone (skips). Biases start from the counts.

Training reads every training document once, in rounds over disjoint parts. In a round each partition makes minibatch
steps from the shared weights and returns its change; changes are averaged per weight row by how often the row was
used. What a task returns and what the driver holds is bounded by the table size.

Counts are exact at any vocabulary size: tokens with more than 1 / ``HOT`` of all occurrences, fewer than ``HOT`` by that, are
broadcast; the others of each document meet their counts in a shuffle join.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions.joins import materialise
from linewell.llm.common import held_out, mix64, slices, words

END = "\n"       # no word has white space
HOT = 1 << 20
CLASSES = 32     # the last one holds the tokens outside the model's vocabulary
WIDTH = CLASSES
BITS = 15
ROUNDS = 2
RATE = 0.15
BATCH = 1 << 14
BLOCK = 512      # weight rows that travel together
FEATURES = 4
CACHE = 300_000
LARGEST = 15.0    # of a weight
MASK = (1 << BITS) - 1


@dataclass
class Sequence:
    """Tokens of a slice of texts: for each its name, and where texts begin; names end with the end of text."""
    offsets: np.ndarray
    code: np.ndarray
    names: list[str]

    @staticmethod
    def of(text: pa.Array) -> Sequence:
        offsets, codes, names = words(text)
        names = names.to_pylist() + [END]
        return Sequence(offsets + np.arange(len(offsets)), np.insert(codes, offsets[1:], len(names) - 1), names)


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all texts of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = Sequence.of(batch.column(0))
            n = np.bincount(s.code, minlength=len(s.names))
            keep = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(s.names, pa.string()).filter(pa.array(keep)), pa.array(n[keep])], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent tokens with their counts, ``END`` first; N and V are those of all training tokens."""
    tokens: list[str]
    counts: np.ndarray
    total: int
    distinct: int

    def __post_init__(self):
        self.rank = {t: k for k, t in enumerate(self.tokens)}
        self.size = min(len(self.tokens), (CLASSES - 1) * WIDTH)  # of the model
        own = self.counts[:self.size]
        self.rare_total, self.rare_distinct = self.total - int(own.sum()), self.distinct - int((own > 0).sum())
        self.logs = np.log10((self.counts + 1) / (self.total + self.distinct + 1))
        # a rare token's share within its class, over its share of all
        self.rare_shift = math.log10((self.total + self.distinct + 1) / (self.rare_total + self.rare_distinct + 1))
        table = np.full(CLASSES * WIDTH, -1.0)
        table[:self.size] = own
        table = table.reshape(CLASSES, WIDTH)
        present = table >= 0
        sums = np.where(present, table + 0.5, 0).sum(axis=1)
        sums[-1] = self.rare_total + 1
        share = np.where(present, table + 0.5, 1) / np.maximum(sums, 1)[:, None]
        self.class_bias = np.where(sums > 0, np.log(np.maximum(sums, 1e-9) / sums.sum()), -1e4).astype(np.float32)
        self.slot_bias = np.where(present, np.log(share), -1e4).astype(np.float32)

    def known(self, s: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """Rank of every name, -1 outside the table; and its number in the model, the last class standing for all others."""
        rank = np.fromiter((self.rank.get(t, -1) for t in s.names), np.int64, len(s.names))
        return rank, np.where((rank >= 0) & (rank < self.size), rank, (CLASSES - 1) * WIDTH)


def history(s: Sequence, cache: dict[str, int]) -> np.ndarray:
    """Weight rows (tokens x features) of every token's history; histories start anew with each text."""
    of_name = np.empty(len(s.names), np.uint64)
    for k, t in enumerate(s.names):
        h = cache.get(t)
        if h is None:
            if len(cache) >= CACHE:
                cache.clear()
            h = cache[t] = xxhash.xxh64_intdigest(t)
        of_name[k] = h
    h = of_name[s.code]
    place = np.arange(len(h)) - np.repeat(s.offsets[:-1], np.diff(s.offsets))
    back = []
    for k in (1, 2, 3):
        b = np.zeros(len(h), np.uint64)
        b[k:] = h[:-k]
        b[place < k] = np.uint64(k)
        back.append(b)
    odd = np.uint64(0x9E3779B97F4A7C15)
    keys = (back[0], back[0] * odd + back[1] + np.uint64(1), back[1] + np.uint64(2), back[2] + np.uint64(3))
    return np.stack([(mix64(k) >> np.uint64(64 - BITS)).astype(np.uint16) for k in keys], axis=1)


def within(rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Weight rows for the factor inside a class."""
    return rows ^ ((cls * 1013) & MASK).astype(np.uint16)[:, None]


ONES = np.ones(CLASSES, np.float32)  # as wide as a class


def exponents(table: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Sums of the weight rows of every history and the bias. Biases are at most 0 and rows within ``LARGEST``, so exp() stays in range."""
    x = np.take(table, rows[:, 0], axis=0, mode="clip")
    x += bias
    for k in range(1, FEATURES):
        x += np.take(table, rows[:, k], axis=0, mode="clip")
    return x


def log_at(x: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Log softmax of one column of each row; uses up x."""
    at = x[np.arange(len(column)), column]
    np.exp(x, out=x)
    return at - np.log(x @ ONES)


def residual(x: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Gradient of the loss: softmax less one in the given column of each row; in place of x."""
    np.exp(x, out=x)
    x /= (x @ ONES)[:, None]
    x[np.arange(len(column)), column] -= 1
    return x


@dataclass
class Weights:
    classes: np.ndarray  # (2 ** BITS, CLASSES)
    slots: np.ndarray    # (2 ** BITS, WIDTH)

    @staticmethod
    def zero() -> Weights:
        return Weights(np.zeros((1 << BITS, CLASSES), np.float32), np.zeros((1 << BITS, WIDTH), np.float32))


def log_probabilities(v: Vocabulary, w: Weights, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of class and place within the class; of the class alone for rare tokens."""
    out = np.empty(len(y))
    cls, slot = y // WIDTH, y % WIDTH
    for a in range(0, len(y), BATCH):
        b = slice(a, a + BATCH)
        out[b] = log_at(exponents(w.classes, rows[b], v.class_bias), cls[b])
        some = a + np.flatnonzero(cls[b] < CLASSES - 1)
        out[some] += log_at(exponents(w.slots, within(rows[some], cls[some]), v.slot_bias[cls[some]]), slot[some])
    return out


class Trainer:
    """Minibatch steps with a step size per weight row that falls with the row's squared gradients."""

    def __init__(self, v: Vocabulary, start: Weights):
        self.v, self.w = v, Weights(start.classes.copy(), start.slots.copy())
        self.square = np.full((2, 1 << BITS), 1e-2, np.float32)
        self.used = np.zeros((2, 1 << BITS), np.int64)

    def _step(self, kind: int, table: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        flat = rows.reshape(-1)
        order = np.argsort(flat, kind="stable")  # 16-bit keys: a radix sort
        sorted_rows = flat[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
        touched, n = sorted_rows[first], np.diff(np.append(first, len(order)))
        total = np.add.reduceat(np.take(grad, order // FEATURES, axis=0), first, axis=0)
        self.square[kind, touched] += np.einsum("ij,ij->i", total, total) / (n * total.shape[1])
        total *= (RATE / np.sqrt(n * self.square[kind, touched])).astype(np.float32)[:, None]
        table[touched] -= total
        self.used[kind, touched] += n

    def learn(self, rows: np.ndarray, y: np.ndarray) -> None:
        cls, slot = y // WIDTH, y % WIDTH
        for a in range(0, len(y), BATCH):
            b = slice(a, a + BATCH)
            r, c = rows[b], cls[b]
            self._step(0, self.w.classes, r, residual(exponents(self.w.classes, r, self.v.class_bias), c))
            some = np.flatnonzero(c < CLASSES - 1)
            if len(some):
                r2 = within(r[some], c[some])
                self._step(1, self.w.slots, r2, residual(exponents(self.w.slots, r2, self.v.slot_bias[c[some]]), slot[b][some]))

    def changes(self, start: Weights) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, uses per row, change per row) of the blocks that were used."""
        for kind, (now, then) in enumerate(((self.w.classes, start.classes), (self.w.slots, start.slots))):
            for k in range((1 << BITS) // BLOCK):
                b = slice(k * BLOCK, (k + 1) * BLOCK)
                if self.used[kind, b].any():
                    yield kind * (1 << BITS) // BLOCK + k, self.used[kind, b].tobytes(), (now[b] - then[b]).astype(np.float16).tobytes()


def trained(docs: DataFrame, v: Vocabulary, part: Column) -> Weights:
    """One pass over all of ``docs``; round r takes the rows where ``part`` modulo ``ROUNDS`` is r."""
    sc = docs.sparkSession.sparkContext
    w, vocabulary = Weights.zero(), sc.broadcast(v)
    for r in range(ROUNDS):
        shared = sc.broadcast(w)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache: dict[str, int] = {}
            t = Trainer(vocabulary.value, shared.value)
            for batch in slices(batches):
                s = Sequence.of(batch.column(0))
                t.learn(history(s, cache), vocabulary.value.known(s)[1][s.code])
            for change in t.changes(shared.value):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in change], ["block", "used", "change"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for block, used, change in zip(*(c.to_pylist() for c in batch.columns)):
                    n, d = np.frombuffer(used, np.int64), np.frombuffer(change, np.float16).reshape(BLOCK, -1).astype(np.float64)
                    held = sums.setdefault(block, [np.zeros(BLOCK, np.int64), np.zeros(d.shape)])
                    held[0] += n
                    held[1] += d * n[:, None]
            for block, (n, d) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([(d / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()])], ["block", "change"])

        changes = docs.filter(F.pmod(part, F.lit(ROUNDS)) == r).select("text").mapInArrow(learn, "block long, used binary, change binary")
        for block, change in changes.repartition("block").mapInArrow(average, "block long, change binary").collect():  # a row per block of the table
            kind, k = divmod(block, (1 << BITS) // BLOCK)
            table = (w.classes, w.slots)[kind]
            own = table[k * BLOCK:(k + 1) * BLOCK]
            np.clip(own + np.frombuffer(change, np.float32).reshape(BLOCK, -1), -LARGEST, LARGEST, out=own)
    return w


def score(docs: DataFrame, usable: Column, mark: Column, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, held_out (``mark``), n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``usable`` holds. Null and empty texts are one token, the end. Repeated rows count and are
    scored each; rows may share an id. Without training rows all counts are 0. An empty table gives no rows.
    Only the two named columns are read.
    """
    text, row_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    # what tells rows apart: the id, and a checksum of the text in case rows share it
    check = F.when(row_id.isNull(), F.xxhash64(text)).otherwise(F.crc32(text.cast("binary")))
    rows = docs.select(row_id.alias("doc_id"), mark.alias("held_out"), usable.alias("usable"), check.alias("check"), text.alias("text"))
    training = rows.filter("usable")
    counts = materialise(token_counts(training), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.filter((F.col("token") == END) | (F.col("c") * F.lit(hot) > F.lit(int(total)))).toPandas()
    top = top.assign(later=top["token"] != END, less=-top["c"]).sort_values(["later", "less", "token"])
    v = Vocabulary(top["token"].tolist() or [END], top["c"].to_numpy(np.int64) if len(top) else np.zeros(1, np.int64), int(total), int(distinct))
    sc = docs.sparkSession.sparkContext
    vocabulary, weights = sc.broadcast(v), sc.broadcast(trained(training, v, F.xxhash64("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w, cache = vocabulary.value, weights.value, {}
        names = ["doc_id", "check", "held_out", "n_tokens", "known", "base", "score", "token"]
        for batch in slices(batches):
            s = Sequence.of(batch.column(3))
            rank, y = v.known(s)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(s.offsets))
            of_token = rank[s.code]
            rare = (of_token >= 0) & (y[s.code] // WIDTH == CLASSES - 1)  # rare tokens beyond the table get their share in the join below
            base = np.where(of_token >= 0, v.logs[of_token], 0.0)
            model = log_probabilities(v, w, history(s, cache), y[s.code]) / math.log(10) + np.where(rare, base + v.rare_shift, 0.0)
            seen = (of_token >= 0) & (v.counts[of_token] > 0)
            total = [np.bincount(doc, x, minlength=batch.num_rows) for x in (seen, base, model)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(s.offsets)), pa.array(total[0].astype(np.int64)), pa.array(total[1]), pa.array(total[2]), pa.nulls(batch.num_rows, pa.string())], names)
            cold = of_token < 0
            pair, n = np.unique(doc[cold] * len(s.names) + s.code[cold], return_counts=True)
            at = pa.array(pair // len(s.names))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.nulls(len(pair), pa.bool_()), pa.array(n), pa.nulls(len(pair), pa.int64()), pa.nulls(len(pair), pa.float64()), pa.nulls(len(pair), pa.float64()),
                                              pa.array(s.names, pa.string()).take(pa.array(pair % len(s.names)))], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    both = materialise(rows.select("doc_id", "check", "held_out", "text").mapInArrow(run, f"doc_id {kind}, check long, held_out boolean, n_tokens long, known long, base double, score double, token string"), "scores")
    of_doc = both.filter("token IS NULL").groupBy("doc_id", "check").agg(F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("held_out", "n_tokens", "known", "base", "score")])
    cold = (both.filter("token IS NOT NULL").select("doc_id", "check", "token", "n_tokens").join(counts, "token", "left")
            .select("doc_id", "check", (F.col("n_tokens") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total + distinct + 1)))).alias("cold_base"), F.when(F.col("c") > 0, F.col("n_tokens")).otherwise(0).alias("cold_known"), F.col("n_tokens").alias("cold_n"))
            .groupBy(F.col("doc_id").alias("i"), F.col("check").alias("k")).agg(F.sum("cold_base").alias("cold_base"), F.sum("cold_known").alias("cold_known"), F.sum("cold_n").alias("cold_n")))
    joined = of_doc.join(cold, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("check") == F.col("k")), "left").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    share = [F.coalesce(F.col(c) / F.col("times"), F.lit(0.0)) for c in ("cold_base", "cold_known", "cold_n")]
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + share[1].cast("long")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + share[0]).alias("base_score"), (F.col("score") + share[0] + share[2] * F.lit(v.rare_shift)).alias("score"))


def lm_scores(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """Scores every document with a model of those that aren't held out; see ``score``."""
    out = held_out("doc_id", modulus)
    return score(docs, ~out, out)
