"""License scans with a positional rare-token index.

Templates are word sequences of licence texts with key phrases that must stand in full. Every template is indexed under its
anchor, the word of its key phrases with the highest inverse document frequency, with that word's place. A file's own licence words
with an entry in the index are looked up; each occurrence proposes one relative position of file and template. The postings of the
template's other key words, rarest first, are intersected with the file's words at that relative position, and what is left has
its key phrases verified whole; then all aligned words are counted. As no accepted place lacks its anchor, the index loses none, whatever
the frequencies are.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.llm.common import slices

LEAST = 80  # percent of a template's words that have to be aligned


@dataclass(frozen=True)
class Template:
    """A licence text. Words between asterisks are key phrases; without any, all words are one."""
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.replace("*", " ").split()

    @property
    def keys(self) -> list[int]:
        """Places of the words of key phrases."""
        parts, at, found = self.text.split("*"), 0, []
        for k, part in enumerate(parts):
            n = len(part.split())
            if k % 2 == 1 or len(parts) == 1:
                found += range(at, at + n)
            at += n
        return found


# The phrases and labels of the task, then sentences of well-known licences.
BASE = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
TEMPLATES = BASE + (
    Template("mit", "*permission is hereby granted free of charge* to any person obtaining a copy of this software and associated documentation files the software to *deal in the software without restriction*"),
    Template("apache", "*licensed under the apache license* version 2 0 the license you may not use this file *except in compliance with the license*"),
    Template("gpl", "this program is free software you can *redistribute it and or modify* it under the terms of the *gnu general public license* as published by the free software foundation"),
    Template("lgpl", "redistribute it and or modify it *under the terms of the gnu lesser general public license* as published by the free software foundation"),
    Template("agpl", "redistribute it and or modify it *under the terms of the gnu affero general public license* as published by the free software foundation"),
    Template("bsd", "*redistribution and use in source and binary forms* with or without modification are permitted provided that the following *conditions are met*"),
    Template("mpl", "this source code form is subject to the terms of the *mozilla public license* v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose *with or without fee is hereby granted* provided that the above copyright notice and this permission notice appear in all copies"),
    Template("zlib", "this software is provided as is without any express or implied warranty *in no event will the authors be held liable* for any damages arising from the use of this software"),
    Template("unlicense", "this is *free and unencumbered software* released into the *public domain*"),
    Template("cc0", "*cc0 1 0 universal* public domain dedication"),
    Template("cc-by", "licensed under *cc by 4 0*"),
    Template("cc-by-sa", "licensed under *cc by sa* 4 0"),
    Template("cc-by-nc", "licensed under *cc by nc* 4 0"),
    Template("cc-by-nd", "licensed under *cc by nd* 4 0"),
    Template("cc-by-nc-sa", "licensed under *cc by nc sa* 4 0"),
    Template("cc-by-nc-nd", "licensed under *cc by nc nd* 4 0"),
    Template("epl", "*eclipse public license* v 2 0"),
    Template("bsl", "*boost software license* version 1 0"),
)

# A-Z in lower case; every other ASCII byte but digits and a-z is a blank
PLAIN = np.array([32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def plain(text: pa.Array) -> pa.Array:
    """The texts with their words in lower case and single bytes between them blanked; null texts are empty."""
    text = pa.concat_arrays([pc.fill_null(text, "").cast(pa.large_string())])
    _, ends, data = text.buffers()
    if data is None or not len(data):
        return text
    return pa.Array.from_buffers(pa.large_string(), len(text), [None, ends, pa.py_buffer(PLAIN[np.frombuffer(data, np.uint8)])], 0, text.offset)


def coded_words(text: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's words, and per word its number in the vocabulary, -1 outside it."""
    lists = pc.ascii_split_whitespace(plain(text))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    codes = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    solid = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # before leading and after trailing blanks there are empty pieces
    if not solid.all():
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[solid], minlength=len(counts))
        codes = codes[solid]
    return np.concatenate(([0], np.cumsum(counts))), codes


@dataclass
class Posting:
    template: Template
    codes: np.ndarray      # the template's words
    keys: list[int]        # places of its key words, rarest first: the first is the anchor
    least: int             # words that have to be aligned


class Index:
    """Templates by anchor, from the number of documents that hold each licence word (absent: none)."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[str, int]):
        self.words = sorted({w for t in templates for w in t.words})
        code = {w: k for k, w in enumerate(self.words)}
        self.postings: dict[int, list[Posting]] = {}
        for t in templates:
            rare = sorted(t.keys, key=lambda at: (frequency.get(t.words[at], 0), t.words[at], at))
            one = Posting(t, np.array([code[w] for w in t.words], np.int32), rare, -(-LEAST * len(t.words) // 100))
            self.postings.setdefault(int(one.codes[rare[0]]), []).append(one)

    def places(self, offsets: np.ndarray, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, Posting]]:
        """Per posting with accepted places: their texts, first words (negative if the text starts inside the template) and aligned words."""
        at = np.flatnonzero(codes >= 0)
        own = codes[at]
        by = np.argsort(own, kind="stable")
        at, own = at[by], own[by]
        found = []
        for anchor, postings in self.postings.items():
            a, b = np.searchsorted(own, [anchor, anchor + 1])
            if a == b:
                continue
            doc = np.searchsorted(offsets, at[a:b], "right") - 1
            for p in postings:
                low, high, start = offsets[doc], offsets[doc + 1], at[a:b] - p.keys[0]
                text = doc

                def same(k: int) -> np.ndarray:
                    place = start + k
                    inside = (place >= low) & (place < high)
                    return inside & (codes[np.where(inside, place, 0)] == p.codes[k])

                for k in p.keys[1:]:
                    keep = same(k)
                    text, low, high, start = text[keep], low[keep], high[keep], start[keep]
                    if not len(start):
                        break
                if len(start):
                    aligned = sum(same(k).astype(np.int64) for k in range(len(p.codes)))
                    keep = aligned >= p.least
                    if keep.any():
                        found.append((text[keep], (start - low)[keep], aligned[keep], p))
        return found


def word_frequencies(docs: DataFrame, text_col: str, words: list[str]) -> dict[str, int]:
    """Documents that hold each of the words, over all documents. As many rows as words come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = pa.array(words, pa.large_string()), np.zeros(len(words), np.int64)
        for batch in slices(batches):
            offsets, codes = coded_words(batch.column(0), vocabulary)
            doc = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(offsets))[codes >= 0]
            pairs = np.unique(doc * len(words) + codes[codes >= 0])
            total += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(total)], ["word", "n"])

    return dict(docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n")).collect())


MATCH = "struct<label:string,base:boolean,start:bigint,words:int,aligned:int>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, matches (label, base, start, words of the template, aligned words).

    A place is accepted where every key phrase stands in full and 80 % of the template's words are aligned; a text may start or
    end inside a template. Null and empty texts have no words and no matches; a very long text is a slice of its own. Repeated rows are
    scanned each, and count each in the frequencies, which only order the lookups; ties among them go by word and place. Empty
    table: no rows. Only the two columns are read.
    """
    index = Index(templates, word_frequencies(docs, text_col, Index(templates, {}).words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(index.words, pa.large_string())
        for batch in slices(batches):
            offsets, codes = coded_words(batch.column(1), vocabulary)
            matches: dict[int, list[dict]] = {}
            for text, start, aligned, p in index.places(offsets, codes):
                for d, s, n in zip(text.tolist(), start.tolist(), aligned.tolist()):
                    matches.setdefault(d, []).append({"label": p.template.label, "base": p.template.base, "start": s, "words": len(p.codes), "aligned": n})
            kinds = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int32()), ("aligned", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array([matches.get(k, []) for k in range(batch.num_rows)], kinds)],
                                             ["doc_id", "n_words", "matches"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, matches array<{MATCH}>")


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` in columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base columns tell of the places of the base phrases (no place: 0, nulls and an empty list of labels); score is the largest share
    of aligned words among all accepted places, 0 without any.
    """
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")

    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["aligned"].cast("double") / m["words"])), F.lit(0.0))
    return scan(docs, id_col, text_col).select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                                               labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), score.alias("score"))


_ROWS = ", ".join(f"({k}, {at}, '{w}', {at in t.keys})" for k, t in enumerate(TEMPLATES) for at, w in enumerate(t.words))
_HEADS = ", ".join(f"({k}, '{t.label}', {t.base}, {len(t.words)}, {len(t.keys)}, {-(-LEAST * len(t.words) // 100)})" for k, t in enumerate(TEMPLATES))

ORACLE_SQL = rf"""
WITH postings(template, place, word, is_key) AS (VALUES {_ROWS}),
heads(template, label, base, words, keys, least) AS (VALUES {_HEADS}),
lists AS (SELECT row_number() OVER () AS row_id, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
flat AS (SELECT row_id, unnest(w) AS word, unnest(range(len(w))) AS nth FROM lists),
places AS (SELECT row_id, template, f.nth - p.place AS start, count(*) AS aligned FROM flat f JOIN postings p USING (word) GROUP BY row_id, template, f.nth - p.place
  HAVING count(*) FILTER (is_key) = (SELECT keys FROM heads h WHERE h.template = p.template) AND count(*) >= (SELECT least FROM heads h WHERE h.template = p.template)),
found AS (SELECT row_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(aligned::DOUBLE / words) AS score
  FROM places JOIN heads USING (template) GROUP BY row_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM lists LEFT JOIN found USING (row_id)
"""
