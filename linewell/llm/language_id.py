"""Language identification with word-first backoff.

A word that the model knows scores by its log frequency per language. An unseen word falls back to character
4-grams, then 3-, 2- and 1-grams: the longest length of which at least half of its n-grams are known decides, by
their mean log frequency. A text's score per language is the sum over its words.

The tables come from a sample of labelled documents that is bounded per language, and are cut at a number
of entries: the model that goes to the executors is bounded by parameters.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.llm.common import held_out, slices, words

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4
CACHE = 300_000
CELLS = 80_000_000  # weights of a table: 200 languages with 400,000 entries
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between blanks (single letters without them)."""
    padded = word if n == 1 else f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    tables: list[dict[str, int]]  # of words, then of n-grams of length 1 to LONGEST: rows of ``logs``
    logs: np.ndarray              # log frequency per language

    @staticmethod
    def of(langs: list[str], tables: list[dict[str, np.ndarray]]) -> Model:
        rows = [v for t in tables for v in t.values()]
        starts = np.cumsum([0, *map(len, tables)])
        return Model(langs, [dict(zip(t, range(a, a + len(t)))) for t, a in zip(tables, starts.tolist())], np.array(rows, np.float64).reshape(len(rows), max(1, len(langs))))

    def rows(self, word: str) -> list[int]:
        """Rows whose mean is the word's score."""
        known = self.tables[0].get(word)
        if known is not None:
            return [known]
        for n in range(LONGEST, 0, -1):
            parts = grams(word, n)
            found = [r for r in map(self.tables[n].get, parts) if r is not None]
            if parts and 2 * len(found) >= len(parts):
                return found
        return []

    def of_token(self, token: str) -> tuple[bool, list[int], list[float]]:
        """Whether the token has a letter; rows of all its words and their weights."""
        found = [w for w in LETTERS.findall(token.lower()) if w.isalpha() or any(map(str.isalpha, w))]
        if len(found) == 1:
            rows = self.rows(found[0])
            return True, rows, [1 / len(rows)] * len(rows) if rows else rows
        each = [self.rows(w) for w in found]
        return bool(found), [r for x in each for r in x], [1 / len(x) for x in each for _ in x]


def counted(sample: DataFrame) -> DataFrame:
    """(lang, n, gram, count) of words (n = 0) and n-grams, added up per slice before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs = batch.column(0).to_pylist()
            offsets, codes, names = words(batch.column(1), lower=False)
            names = names.to_pylist()
            for lang in sorted(set(langs)):
                own = np.repeat([x == lang for x in langs], np.diff(offsets))
                of_token = np.bincount(codes[own], minlength=len(names))
                totals: list[Counter] = [Counter() for _ in range(LONGEST + 1)]
                for k in np.flatnonzero(of_token):
                    for w in LETTERS.findall(names[k].lower()):
                        totals[0][w] += int(of_token[k])
                for w, c in totals[0].items():
                    for n in range(1, LONGEST + 1):
                        for g in grams(w, n):
                            totals[n][g] += c
                for n, t in enumerate(totals):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t), pa.string()), pa.array([n] * len(t), pa.int32()), pa.array(list(t), pa.string()), pa.array(list(t.values()), pa.int64())], ["lang", "n", "gram", "count"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 2000, max_entries: int = 20_000, all_entries: int = 400_000) -> Model:
    """Learns from whole texts of about ``per_lang`` usable labelled documents of each language, picked by a hash of the id.

    Each language keeps ``max_entries`` words and as many n-grams of each length, less if all would exceed ``all_entries`` a length
    or the table of a length ``CELLS`` weights. Every language of the labels is learned, however rare.
    """
    labelled = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model.of([], [{} for _ in range(LONGEST + 1)])
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))]), F.col("lang"))
    sample = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    entries = max(1, min(max_entries, all_entries // len(langs), CELLS // len(langs) ** 2))
    best = Window.partitionBy("lang", "n").orderBy(F.desc("count"), "gram")
    kept = counted(sample).filter((F.col("n") > 0) | (F.col("count") > 1)).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= entries)
    found = kept.select("lang", "n", "gram", "count").toPandas()
    tables = []
    for n in range(LONGEST + 1):
        wide = found[found["n"] == n].pivot_table(index="gram", columns="lang", values="count", fill_value=0).reindex(columns=langs, fill_value=0)
        counts = wide.to_numpy(np.float64) + 0.5
        logs = np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32) if len(counts) else counts
        tables.append(dict(zip(wide.index, logs)))
    return Model.of(langs, tables)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    score is the posterior of lang_pred under equal priors, over all words of the text. Ties go to the first language
    in order. Null texts, texts without a letter and an empty model give ``und`` and 0. Null ids are never held
    out. Repeated rows are scored each; an empty table gives no rows. Reads the id and the text only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache: dict[str, tuple[bool, list[int], list[float]]] = {}
        for batch in slices(batches):
            offsets, codes, names = words(batch.column(2), lower=False)
            has, rows, weights, counts = [], [], [], []
            for token in names.to_pylist():
                known = cache.get(token)
                if known is None:
                    known = m.of_token(token)
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[token] = known
                has.append(known[0] and bool(m.langs))
                rows += known[1]
                weights += known[2]
                counts.append(len(known[1]))
            letters = np.array(has, bool)[codes]
            part, weight, token_of = m.logs[np.array(rows, np.int64)], np.array(weights, np.float64), np.repeat(np.arange(len(counts)), counts)
            vectors = np.stack([np.bincount(token_of, part[:, k] * weight, minlength=len(counts)) for k in range(m.logs.shape[1])], axis=1)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            sums = np.stack([np.bincount(doc, vectors[codes, k], minlength=len(offsets) - 1) for k in range(m.logs.shape[1])], axis=1)
            some = np.bincount(doc, letters, minlength=len(offsets) - 1) > 0
            best = sums.argmax(axis=1)
            score = np.where(some, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
            names_out = [m.langs[b] if s else UNKNOWN for b, s in zip(best, some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names_out, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, modulus).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, modulus: int = 4) -> DataFrame:
    """Learns from labelled documents that aren't held out and predicts every document; see ``fit`` and ``predict``."""
    return predict(docs, fit(docs, ~held_out("doc_id", modulus)), modulus=modulus)


def accuracy(predicted: DataFrame, docs: DataFrame) -> float:
    """Share of held-out labelled documents that are predicted right."""
    joined = predicted.filter("held_out").join(docs.select("doc_id", "lang").filter("lang IS NOT NULL"), "doc_id")
    return joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] or math.nan
