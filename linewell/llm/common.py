"""Pieces that the operators share: split rule, word batches from Arrow, dropping documents."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewell.functions.joins import configure, lookup

SLICE_BYTES = 8 << 20  # text that a Python worker handles at a time; a longer document is a slice of its own


def session(spark: SparkSession) -> SparkSession:
    """The library's session settings, and Arrow batches whose bytes are bounded however long the texts are."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))
    return spark


def bucket_of(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(modulus)


def held_out(id_col: str, modulus: int, remainder: int = 2) -> Column:
    """Rows that nothing may be learned from. A row without an id isn't held out."""
    return F.coalesce(bucket_of(id_col, modulus) == remainder, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text_at: int = -1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``limit`` bytes of the column ``text_at`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def words(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between white space (space, tab to carriage return) of every text, null texts having none.

    Returns offsets of each text's words, dictionary codes of the words in order, and the dictionary.
    ``lower`` maps A-Z only.
    """
    text = pc.fill_null(text, "")
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(names, pa.scalar("", names.type)).as_py()
    if empty >= 0:  # before leading and after trailing white space
        keep = codes != empty
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
        codes = codes[keep]
    return np.concatenate(([0], np.cumsum(counts))), codes, names


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id isn't among ``dropped``; all columns stay. Rows without an id can't be named, so they stay."""
    return lookup(docs, dropped.select(id_col).distinct(), [id_col], "left_anti")
