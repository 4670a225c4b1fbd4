"""Removal of repeated 50-byte strings with suffix arrays.

1. Every 50-byte string has an anchor, the least hash of its 16-byte parts, so equal strings have equal anchors. Anchors that
   only one document has cannot be part of a match. Which are shared is found per slice first and then by a shuffle of
   the slices' distinct anchors, so a frequent anchor is sent once per slice.
2. The runs of strings under shared anchors are cut out and sent to the shard of their anchor. Equal runs of a slice are sent
   once, from the smallest document. Strings of anchors that very many documents share go by their own hash.
3. Each shard is taken in parts by tag, builds suffix arrays of a bounded number of bytes, as deep as the strings are long, finds groups of equal strings, and, if
   it needs several arrays, merges their sorted strings by binary search. A string is removed where a smaller
   document has it; the byte ranges go back to their documents.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.functions.joins import materialise
from linewell.llm.common import mix64, slices
from linewell.llm.suffix_array import string_groups

LENGTH = 50
PART = 16
ARRAY_BYTES = 3 << 20        # of one suffix array
BUCKET_BYTES = 64 << 20      # of text for each bucket of anchors
SHARD_BYTES = 6 << 20        # of text for each shard; runs under shared anchors are about as large
PART_BYTES = 3 << 20         # of a shard's runs that are compared at a time
TEXT_BYTES = 2 << 20         # of text that is hashed at a time
BLOCK = 1 << 14              # strings whose hashes are computed at a time
HOT_SHARE, HOT_LEAST = 200_000, 2000  # an anchor is hot above this share of all anchors: the list is bounded
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
NOBODY = np.uint32(0xFFFFFFFF)


def buffer_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another and where each begins; null is empty."""
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


class Runs:
    """Runs of neighbouring 50-byte strings with one anchor: document (number in the slice), first and last string, anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        n = len(data) - LENGTH + 1
        if n <= 0:
            self.doc = self.first = self.last = np.zeros(0, np.int64)
            self.anchor, self.part = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        self.part = np.empty(len(data) - PART + 1, np.uint64)  # of the 16 bytes from each position
        low = np.empty(n, np.uint64)
        for a in range(0, n, BLOCK):  # of so many strings, that stay in a processor's cache
            h = data[a:a + BLOCK + LENGTH - 1].astype(np.uint64)
            h += np.uint64(1)
            for k, step in enumerate((1, 2, 4, 8)):
                ahead = h[step:]
                h = h[:-step] * ODD[k]
                h += ahead
            part = mix64(h)
            self.part[a:a + len(part)] = part
            for step in (1, 2, 4, 8, 16):
                part = np.minimum(part[:-step], part[step:])
            np.minimum(part[:-(LENGTH - PART + 1 - 32)], part[LENGTH - PART + 1 - 32:], out=low[a:a + BLOCK])
        short = (offsets[1:, None] - np.arange(1, LENGTH)).ravel()  # a string from here goes beyond its text
        valid, new = np.ones(n, bool), np.ones(n, bool)
        valid[short[(short >= 0) & (short < n)]] = False
        np.not_equal(low[1:], low[:-1], out=new[1:])
        new[offsets[offsets < n]] = True
        self.first = np.flatnonzero(new & valid)
        self.last = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid)
        self.doc, self.anchor = np.searchsorted(offsets, self.first, side="right") - 1, mix64(low[self.first] ^ ODD[4])

    def string_hash(self, at: np.ndarray) -> np.ndarray:
        h = self.part[at]
        for k, step in enumerate((16, 32, 34)):
            h = h * ODD[k] + self.part[at + step]
        return mix64(h)


def anchor_ids(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """bucket * 2^32 + tag; a clash makes a candidate too many, never one too few."""
    return (((anchor >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (anchor & np.uint64(0xFFFFFFFF))


def buckets_of(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each bucket; they come in order of bucket."""
    now, held = None, []
    for batch in rows:
        for r in batch.to_pylist():
            if r["bucket"] != now:
                if held:
                    yield now, held
                now, held = r["bucket"], []
            held.append(r)
    if held:
        yield now, held


def shared_anchors(rows: DataFrame, buckets: int, hot: int) -> DataFrame:
    """(doc_id, anchor) of anchors that other documents have as well, and (null, anchor) of hot ones."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "base", "own", "tag", "doc", "n"]
        for turn, batch in enumerate(slices(batches, limit=TEXT_BYTES)):
            ids = batch.column(0).to_numpy()
            runs = Runs(*buffer_of(batch.column(1)))
            anchor, doc = anchor_ids(runs.anchor, buckets), ids[runs.doc]
            base = int(ids.min())
            wide = np.uint64 if int(ids.max()) - base >= int(NOBODY) else np.uint32
            nobody = np.iinfo(wide).max
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            keep = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))[:len(anchor)]
            anchor, doc = anchor[keep], doc[keep]
            start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))[:len(anchor)])
            n = np.diff(np.append(start, len(anchor)))
            ref = np.where(n > 1, nobody, (doc[start] - base).astype(wide)).astype(wide)
            bucket, tag = (anchor[start] >> np.uint64(32)).astype(np.int64), (anchor[start] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            some, cut = np.unique(bucket, return_index=True)
            spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([base] * len(some), pa.int64()), pa.array([False] * len(some), pa.bool_()), *[
                pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (tag, ref, n.astype(np.uint32))]], names)
            known = np.repeat(n > 1, n)  # shared inside the slice
            yield pa.RecordBatch.from_arrays([pa.array([turn % buckets], pa.int64()), pa.array([0], pa.int64()), pa.array([True]), pa.array([anchor[known].tobytes()], pa.binary()), pa.array([doc[known].tobytes()], pa.binary()), pa.array([b""], pa.binary())], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(doc: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(anchor.astype(np.uint64).view(np.int64))], ["doc_id", "anchor"])

        for bucket, held in buckets_of(batches):
            for r in held:
                if r["own"]:
                    yield out(np.frombuffer(r["doc"], np.int64), np.frombuffer(r["tag"], np.uint64))
            sent = [r for r in held if not r["own"]]
            if not sent:
                continue
            tag = np.concatenate([np.frombuffer(r["tag"], np.uint32) for r in sent])
            refs = [np.frombuffer(r["doc"], np.uint32 if len(r["doc"]) == len(r["tag"]) else np.uint64) for r in sent]
            alone = np.concatenate([x != np.iinfo(x.dtype).max for x in refs])
            doc = np.concatenate([x.astype(np.int64) + r["base"] for x, r in zip(refs, sent)])
            n = np.concatenate([np.frombuffer(r["n"], np.uint32) for r in sent]).astype(np.int64)
            order = np.argsort(tag, kind="stable")
            tag, doc, alone, n = tag[order], doc[order], alone[order], n[order]
            start = np.flatnonzero(np.concatenate(([True], tag[1:] != tag[:-1])))
            size, total = np.diff(np.append(start, len(tag))), np.add.reduceat(n, start)
            keep = alone & np.repeat(total > 1, size)
            high = np.uint64(bucket << 32)
            yield out(doc[keep], high | tag[keep].astype(np.uint64))
            often = tag[start[total > hot]].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(often), pa.int64()), pa.array((high | often).view(np.int64))], ["doc_id", "anchor"])

    sent = rows.mapInArrow(send, "bucket long, base long, own boolean, tag binary, doc binary, n binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "doc_id long, anchor long")


def representatives(data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each piece of ``data`` the piece of equal bytes in the smallest document (ties: the first)."""
    if not len(begin):
        return np.zeros(0, np.int64)
    powers = np.cumprod(np.full(len(data), ODD[0])) if len(data) else np.zeros(0, np.uint64)
    prefix = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)))
    h = mix64((prefix[begin + size] - prefix[begin]) * powers[len(data) - 1 - begin] + size.astype(np.uint64))   # the same power for all, wherever they begin
    order = np.lexsort((np.arange(len(h)), doc, h))
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    rep = np.empty(len(h), np.int64)
    rep[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = np.flatnonzero(rep != np.arange(len(rep)))
    if len(other):  # equal hashes are held against the bytes
        fits = size[rep[other]] == size[other]
        rep[other[~fits]] = other[~fits]
        other = other[fits]
        n = size[other]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = data[np.repeat(begin[other], n) + inside] == data[np.repeat(begin[rep[other]], n) + inside]
        wrong = other[~np.logical_and.reduceat(equal, np.cumsum(n) - n)] if len(other) else other
        rep[wrong] = wrong
    return rep


def bytes_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of ``data`` one after another."""
    return data[np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]


def ranges(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """The ranges as rows; those of a document that touch or overlap are one row, so strings that go one by one don't make a row each."""
    if len(doc):
        order = np.lexsort((begin, doc))
        doc, begin, end = doc[order], begin[order], end[order]
        other = np.concatenate(([True], doc[1:] != doc[:-1]))
        lift = (np.cumsum(other) - 1) * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + lift) - lift  # the farthest end so far of the document
        first = np.flatnonzero(other | np.concatenate(([True], begin[1:] > reach[:-1])))
        doc, begin, end = doc[first], begin[first], reach[np.append(first[1:], len(doc)) - 1]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "begin", "end"])


def pieces(rows: DataFrame, buckets: int, shards: int, hot: np.ndarray) -> DataFrame:
    """Runs under shared anchors by shard (bucket): documents, places, sizes, tags of anchors and bytes; and ranges that the slice itself decides (own)."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "own", "doc", "place", "size", "tag", "bytes"]
        for turn, batch in enumerate(slices(batches, 1, TEXT_BYTES)):
            batch = batch.filter(pc.is_valid(batch.column(2)))
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            data, offsets = buffer_of(batch.column(1))
            runs = Runs(data, offsets)
            anchor = anchor_ids(runs.anchor, buckets)
            lists = batch.column(2)
            told = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.uint64)
            names_of = lists.flatten().to_numpy().view(np.uint64)
            some = np.isin(mix64(anchor + runs.doc.astype(np.uint64) * ODD[1]), mix64(names_of + told * ODD[1]))
            begin, last, doc, anchor = runs.first[some], runs.last[some], runs.doc[some], anchor[some]
            often = np.isin(anchor, shared.value)
            # strings of hot anchors go one by one
            n = (last - begin + 1)[often]
            single = np.repeat(begin[often], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            tag = mix64(np.concatenate([anchor[~often], runs.string_hash(single)]))
            bucket, tag = (tag % np.uint64(shards)).astype(np.int64), (tag >> np.uint64(32)).astype(np.uint32)
            size = np.concatenate([(last - begin)[~often] + LENGTH, np.full(len(single), LENGTH)])
            doc = np.concatenate([doc[~often], np.repeat(doc[often], n)])
            begin = np.concatenate([begin[~often], single])
            place, owner = begin - offsets[doc], ids[doc]
            rep = representatives(data, begin, size, owner)
            later = owner > owner[rep]
            decided = ranges(owner[later], place[later], (place + size)[later])
            at, start, stop = (decided.column(k).to_numpy() for k in range(3))
            own = [turn % shards, True, *(x.tobytes() for x in (at, start.astype(np.uint32), (stop - start).astype(np.uint32))), b"", b""]
            order = np.argsort(bucket[~later], kind="stable")
            bucket, owner, place, size, begin, tag = (x[~later][order] for x in (bucket, owner, place, size, begin, tag))
            some, cut = np.unique(bucket, return_index=True)
            picked = bytes_of(data, begin, size)
            to = np.concatenate(([0], np.cumsum(size)))
            spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]))
            found = [[x[a:b].tobytes() for a, b in spans] for x in (owner, place.astype(np.uint32), size.astype(np.uint32), tag)]
            packed = [pa.compress(picked[to[a]:to[b]], "zstd", asbytes=True) for a, b in spans]
            # one batch a slice: the rows grow with slices times shards, the batches must not
            columns = [some.tolist(), [False] * len(some), *found, packed]
            yield pa.RecordBatch.from_arrays([pa.array([x, *c], t) for x, c, t in zip(own, columns, (pa.int64(), pa.bool_(), *[pa.binary()] * 5))], names)

    return rows.mapInArrow(run, "bucket long, own boolean, doc binary, place binary, size binary, tag binary, bytes binary")


def shard_groups(data: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one suffix array: starts of whole strings in order, each one's group, and per group a start and the least document."""
    at, group = string_groups(data, size, LENGTH)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return at, group, at[first], np.minimum.reduceat(np.repeat(doc, size)[at], first)


def merged_least(shards: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Per shard (sorted distinct strings, least document) the least document of each string over all shards, by binary search."""
    keys, least = shards[0]
    for k, m in shards[1:]:
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        same = keys[at] == k
        np.minimum.at(least := least.copy(), at[same], m[same])
        spot = np.searchsorted(keys, k[~same])
        keys, least = np.insert(keys, spot, k[~same]), np.insert(least, spot, m[~same])
    return [least[np.searchsorted(keys, k)] for k, _ in shards]


def repeated(data: np.ndarray, size: np.ndarray, doc: np.ndarray, array_bytes: int) -> np.ndarray:
    """Marks of the string starts in ``data`` (pieces one after another) that a smaller document has as well."""
    begin = np.cumsum(size) - size
    covered = np.zeros(len(data), bool)
    part = begin // array_bytes
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    done = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            low, high = begin[a], begin[b - 1] + size[b - 1]
            done.append((low, *shard_groups(data[low:high], size[a:b], doc[a:b])))
    owner = np.repeat(doc, size)
    if len(done) > 1:
        keyed = []
        for low, _, _, first, least in done:
            keyed.append((np.lib.stride_tricks.sliding_window_view(data, LENGTH)[low + first].copy().view(f"S{LENGTH}").ravel(), least))
        least_of = merged_least(keyed)
    else:
        least_of = [d[4] for d in done]
    for (low, at, group, _, _), least in zip(done, least_of):
        covered[low + at] = owner[low + at] > least[group]
    return covered


def removed(sent: DataFrame, array_bytes: int, part_bytes: int) -> DataFrame:
    """(doc_id, begin, end) of byte ranges to remove; ranges of a document may touch or overlap. A shard is compared in parts of about ``part_bytes``."""
    def numbers(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(r["doc"], np.int64), np.frombuffer(r["place"], np.uint32).astype(np.int64), np.frombuffer(r["size"], np.uint32).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in buckets_of(batches):
            for r in held:
                if r["own"]:
                    doc, place, size = numbers(r)
                    yield ranges(doc, place, place + size)
            held = [r for r in held if not r["own"]]
            if not held:
                continue
            sent = [numbers(r) for r in held]
            data = np.concatenate([np.frombuffer(pa.decompress(r["bytes"], int(size.sum()), "zstd"), np.uint8) for r, (_, _, size) in zip(held, sent)])
            doc, place, size = (np.concatenate(x) for x in zip(*sent))
            tag = np.concatenate([np.frombuffer(r["tag"], np.uint32) for r in held])
            held.clear()
            begin, parts = np.cumsum(size) - size, -(-len(data) // part_bytes)
            for k in range(parts):  # equal strings have equal tags
                some = np.flatnonzero(tag % np.uint32(parts) == k)
                if len(some):
                    yield from found(bytes_of(data, begin[some], size[some]), doc[some], place[some], size[some], tag[some])

    def found(data: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.cumsum(size) - size
        rep = representatives(data, begin, size, doc)
        later = doc > doc[rep]
        yield ranges(doc[later], place[later], (place + size)[later])
        own = np.flatnonzero(~later)  # distinct contents, but for repeats inside a document
        _, kind, times = np.unique(tag[own], return_inverse=True, return_counts=True)
        own = own[times[kind] > 1]  # the only content of its anchor shares nothing
        if not len(own):
            return
        n = size[own]
        covered = repeated(bytes_of(data, begin[own], n), n, doc[own], array_bytes)
        piece = np.repeat(np.arange(len(own)), n)
        edge = np.concatenate(([True], (covered[1:] != covered[:-1]) | (piece[1:] != piece[:-1]))) & covered
        stop = np.concatenate(((covered[1:] != covered[:-1]) | (piece[1:] != piece[:-1]), [True])) & covered
        a, b = np.flatnonzero(edge), np.flatnonzero(stop)
        shift = place[own][piece[a]] - (np.cumsum(n) - n)[piece[a]]
        yield ranges(doc[own][piece[a]], a + shift, b + LENGTH + shift)

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, begin long, end long")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", array_bytes: int = ARRAY_BYTES, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, hot_least: int = HOT_LEAST, keep_text: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the bytes that stay.

    Texts are UTF-8 bytes, null is empty. Rows without an id, and texts under 50 bytes, neither lose nor take anything.
    Rows that repeat an id must repeat its text; they lose nothing to each other and the same to others. An empty table
    gives no rows. Ids are integers; only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    long_rows = rows.filter("doc_id IS NOT NULL").filter(F.octet_length("text") >= LENGTH)
    volume = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, shards = max(4, -(-volume // bucket_bytes)), max(4, -(-volume // shard_bytes))
    told = materialise(shared_anchors(long_rows, buckets, max(hot_least, volume // 18 // HOT_SHARE)), "anchors")
    hot = told.filter("doc_id IS NULL").select("anchor").toPandas()["anchor"].to_numpy(np.int64).view(np.uint64)  # about HOT_SHARE at most
    of_doc = told.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    # both joins take all rows by id, so that the texts are shuffled once and the exchange is used again
    found = removed(pieces(rows.join(of_doc, "doc_id", "left").select("doc_id", "text", "anchors"), buckets, shards, hot), array_bytes, part_bytes)
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out: list[list] = [[], [], [], [], []]
            lists = batch.column(2)
            doc = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            doc, begin, end = (c.to_numpy() for c in ranges(doc, *(x.to_numpy() for x in lists.flatten().flatten())).columns)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            begin, end = begin.tolist(), end.tolist()
            for text, a, b in zip(batch.column(1).cast(pa.binary()).to_pylist(), cuts, cuts[1:]):
                text = text or b""
                left = b"".join([text[x:y] for x, y in zip([0, *end[a:b]], [*begin[a:b], len(text)])]) if b > a else text
                for column, value in zip(out, (len(text), len(text) - len(left), b - a, hashlib.sha256(left).hexdigest(), left)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(out, kinds)][:5 if keep_text else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:1 + len(columns)])

    return rows.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
