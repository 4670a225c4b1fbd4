"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words, folded to letters and digits. Five-word seeds that a document shares
with an item name the candidates. For each, running Karp-Rabin finds matches from long to short; the longest
ones that overlap no earlier tile are marked until none of five words is left. The share of the item's words under tiles
is its coverage, whatever the order of the passages in the document.

A benchmark is read in blocks of a bounded number of words; a block is broadcast and all documents are scanned against
it, so any benchmark size works. A pair goes to tiling only if its seeds cover enough of the item to reach the threshold,
which tiles, being made of seeds, cannot exceed.
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

from linewell.functions.joins import materialise
from linewell.llm.common import mix64, slices, without, words

SEED_WORDS = 5
COVERAGE = 0.8
BLOCK_WORDS = 1_000_000
CACHE = 300_000
DROPPED = re.compile(r"[\W_]+")
STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: pa.Array, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of each text's folded words; tokens without a letter or digit are left out."""
    offsets, codes, names = words(text, lower=False)
    of_name = np.zeros(len(names), np.uint64)
    for k, token in enumerate(names.to_pylist()):
        known = cache.get(token)
        if known is None:
            plain = DROPPED.sub("", token.lower())
            known = (xxhash.xxh64_intdigest(plain) or 1) if plain else 0
            if len(cache) >= CACHE:
                cache.clear()
            cache[token] = known
        of_name[k] = known
    h = of_name[codes]
    counts = np.bincount(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[h != 0], minlength=len(offsets) - 1)
    return np.concatenate(([0], np.cumsum(counts))), h[h != 0]


def seeds(offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every five-word window inside a text; a shorter text is one window."""
    length = np.diff(offsets)
    doc = np.repeat(np.arange(len(length)), length)
    at = np.flatnonzero(np.arange(len(h)) + SEED_WORDS <= offsets[doc + 1]) if len(h) else np.zeros(0, np.int64)
    value = np.zeros(len(at), np.uint64)
    for k in range(SEED_WORDS):
        value = mix64(value * STEP + h[at + k])
    short = np.flatnonzero((length > 0) & (length < SEED_WORDS))
    extra = np.zeros(len(short), np.uint64)
    for k, d in enumerate(short):
        v = np.uint64(length[d]) * np.ones(1, np.uint64)
        for x in h[offsets[d]:offsets[d + 1]]:
            v = mix64(v * STEP + x)
        extra[k] = v[0]
    starts = np.concatenate([at, offsets[short]])
    order = np.argsort(starts, kind="stable")
    return starts[order], np.concatenate([value, extra])[order]


def tile(item: list[int], doc: list[int], least: int) -> np.ndarray:
    """Marks of the item's words under greedy tiles of ``least`` words or more; words of 0 in ``doc`` match nothing."""
    in_item, in_doc = [False] * len(item), [w == 0 for w in doc]

    def windows(seq: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
        """(rolling hash, start) of every window without a marked word."""
        mask, base, top = (1 << 61) - 1, 1_000_003, pow(1_000_003, size - 1, (1 << 61) - 1)
        run, value = 0, 0
        for k, w in enumerate(seq):
            if marked[k]:
                run, value = 0, 0
                continue
            if run >= size:
                value = (value - seq[k - size] * top) % mask
            value = (value * base + w) % mask
            run += 1
            if run >= size:
                yield value, k - size + 1

    size = max(least, min(len(item), len(doc)))
    while True:
        table: dict[int, list[int]] = {}
        for value, i in windows(item, in_item, size):
            table.setdefault(value, []).append(i)
        found = []
        for value, j in windows(doc, in_doc, size):
            for i in table.get(value, ()):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not in_item[i + n] and not in_doc[j + n]:
                    n += 1
                if n >= size:
                    found.append((-n, i, j))
        longest = min(found)[0] if found else 0
        for n, i, j in sorted(found):
            if n == longest and not any(in_item[i:i - n]) and not any(in_doc[j:j - n]):
                in_item[i:i - n] = [True] * -n
                in_doc[j:j - n] = [True] * -n
        if found:  # what is left of blocked matches counts with its own length
            continue
        if size == least:
            return np.array(in_item, bool)
        size = max(least, size // 2)


@dataclass
class Block:
    """Benchmark items: words, and where each seed stands."""
    ids: list
    offsets: np.ndarray
    words: np.ndarray
    seeds: np.ndarray    # sorted, distinct
    first: np.ndarray    # entries of seed k are first[k] .. first[k + 1]
    item: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(ids: list, texts: list) -> Block:
        offsets, h = word_hashes(pa.array(texts, pa.string()), {})
        at, value = seeds(offsets, h)
        item = np.searchsorted(offsets, at, side="right") - 1
        order = np.argsort(value, kind="stable")
        distinct, first = np.unique(value[order], return_index=True)
        return Block(ids, offsets, h, distinct, np.append(first, len(order)), item[order], (at - offsets[item])[order])

    def covered(self, offsets: np.ndarray, h: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(row, item number, coverage) of every document and item with a coverage of ``threshold`` or more."""
        if not len(self.seeds):
            return
        at, value = seeds(offsets, h)
        k = np.minimum(np.searchsorted(self.seeds, value), len(self.seeds) - 1)
        hit = self.seeds[k] == value
        at, k = at[hit], k[hit]
        n = self.first[k + 1] - self.first[k]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k], n)
        spot, item, place = np.repeat(at, n), self.item[entry], self.place[entry]
        row = np.searchsorted(offsets, spot, side="right") - 1
        size = np.diff(self.offsets)
        pair = row * len(size) + item
        # distinct words of the item under its seeds, an upper bound of the coverage
        reach = np.minimum(SEED_WORDS, size[item])
        under = np.unique(np.repeat(pair, reach) * (1 + size.max()) + np.repeat(place, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach))
        pairs, counts = np.unique(under // (1 + size.max()), return_counts=True)
        likely = pairs[counts >= threshold * size[pairs % len(size)] - 1e-9]
        order = np.argsort(pair, kind="stable")
        begin, end = np.searchsorted(pair[order], likely), np.searchsorted(pair[order], likely, side="right")
        for p, a, b in zip(likely, begin, end):
            r, i = divmod(int(p), len(size))
            own = self.words[self.offsets[i]:self.offsets[i + 1]].tolist()
            least = min(SEED_WORDS, len(own))
            spots = np.unique(spot[order[a:b], None] + np.arange(least))
            gaps = np.flatnonzero(np.diff(spots) > 1) + 1
            near = np.insert(h[spots], gaps, 0).tolist()
            share = float(tile(own, near, least).mean())
            if share >= threshold - 1e-9:
                yield r, i, share


def blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[Block]:
    ids, texts, n = [], [], 0
    for r in benchmark.select(item_col, text_col).filter(F.col(text_col).isNotNull()).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        n += r[1].count(" ") + 1
        if n >= limit:
            yield Block.of(ids, texts)
            ids, texts, n = [], [], 0
    if ids:
        yield Block.of(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          threshold: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage) of every document and item with a coverage of ``threshold`` or more.

    Items or documents under five words match only as a whole. Null texts, and texts without letters and digits, match
    nothing. Repeated rows give repeated pairs; empty tables give no rows. Other columns aren't read.
    """
    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, coverage double"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], kinds)
    for block in blocks(benchmark, item_col, item_text_col, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b, cache = shared.value, {}
            kind = pa.array(b.ids).type
            for batch in slices(batches):
                found = list(b.covered(*word_hashes(batch.column(1), cache), threshold))
                if found:
                    r, i, c = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array([b.ids[k] for k in i], kind), pa.array(c)], ["doc_id", "item_id", "coverage"])

        out = out.unionByName(rows.mapInArrow(run, kinds))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, contaminated, item_id and coverage of the best covered item (ties: the smallest), n_items.

    Documents without a leak have null, 0 and 0. Rows that repeat an id share one answer; rows without an id are
    never contaminated. See ``leaks``.
    """
    found = materialise(leaks(docs, benchmark, **options), "leaks")
    best = found.filter("doc_id IS NOT NULL").dropDuplicates().groupBy("doc_id").agg(F.min(F.struct((-F.col("coverage")).alias("c"), "item_id")).alias("best"), F.countDistinct("item_id").alias("n_items"))
    ids = docs.select(F.col(options.get("id_col", "doc_id")).alias("doc_id"))
    return ids.join(best, "doc_id", "left").select(
        "doc_id", F.col("best").isNotNull().alias("contaminated"), F.col("best.item_id").alias("item_id"), F.coalesce(-F.col("best.c"), F.lit(0.0)).alias("coverage"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns; documents without an id stay."""
    return without(docs, materialise(leaks(docs, benchmark).select("doc_id").distinct(), "leaks"))
