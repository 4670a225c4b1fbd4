"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within the radius agree in some segment up to a small rest
(pigeonhole), so each one is filed under its segment values and looks up the Hamming ball around each of them.
Of two values that differ in one bit only the one without that bit looks up the other. Matches meet in a
shuffle by segment value and complete distances are verified there, in numpy.

Equal fingerprints are one node from the start. Where a segment value holds very many nodes, a bucket gives a spanning
tree of its links in place of all pairs: components come out the same and the output stays linear.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions.joins import lookup, materialise
from linewell.llm.common import mix64, slices, without
from linewell.llm.components import components
from linewell.llm.set_join import linked, named

SMALL = 256     # pairs of a bucket up to which all its links are listed
CELLS = 1 << 21  # distances computed at once


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words, A-Z folded; fewer words: of the whole sequence; none: no hash."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= size:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], np.uint64)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(length + 1) - 1
    begin = (end - length)[:len(parts) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], 42) for a, b in zip(begin, end[size - 1:].tolist())), np.uint64, len(begin))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int, parts: int) -> DataFrame:
    """(doc_id, f0 .. f<parts - 1>) per row; parts after the first come from remixed hashes. Null texts have no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[int]] = [[] for _ in range(parts)]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                h = shingle_hashes(text, size)
                for k in range(parts):
                    out[k].append(majority(mix64(h ^ np.uint64(k)) if k else h))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.array(o, np.uint64).view(np.int64)) for o in out]], ["doc_id", *[f"f{k}" for k in range(parts)]])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"f{k} long" for k in range(parts)))


def layout(parts: int, segments: int, radii: list[int]) -> list[tuple[int, int, int, int]]:
    """(part, shift, width, radius) of each segment; a part of 64 bits has ``segments`` of them, wide ones first."""
    out = []
    for p in range(parts):
        shift = 0
        for s in range(segments):
            width = (64 - shift + segments - s - 1) // (segments - s)
            out.append((p, shift, width, radii[s]))
            shift += width
    return out


def exact_radii(segments: int, radius: int) -> list[int]:
    """Smallest radii per segment that miss no pair within ``radius``: they add up to radius - segments + 1."""
    base, more = divmod(radius, segments)
    return [base if s <= more else base - 1 for s in range(segments)]


def probes(nodes: DataFrame, plan: list[tuple[int, int, int, int]], parts: int) -> DataFrame:
    """(bucket, own, node, f...) for every segment value and for those one bit above it; radii beyond 1 aren't built."""
    if max(r for *_, r in plan) > 1:
        raise ValueError("segments are too few for this radius")
    names = [f"f{k}" for k in range(parts)]

    def above(value: Column, width: int, tag: Column) -> Column:
        bits = F.array(*[F.lit(1 << k).cast("long") for k in range(width)])
        return F.transform(F.filter(bits, lambda bit: bit.bitwiseAND(value) == 0), lambda bit: F.struct((value + bit + tag).alias("bucket"), F.lit(False).alias("own")))

    entries = []
    for s, (p, shift, width, r) in enumerate(plan):
        if r < 0:
            continue
        value = F.shiftrightunsigned(F.col(f"f{p}"), shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        tag = F.lit(s << 40).cast("long")
        entries.append(F.array(F.struct((value + tag).alias("bucket"), F.lit(True).alias("own"))))
        if r:
            entries.append(above(value, width, tag))
    return nodes.select("node", *names, F.inline(F.concat(*entries))).select("bucket", "own", "node", *names)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of broadcast fingerprints; parts are on the first axis."""
    return np.bitwise_count(x ^ y).sum(axis=0, dtype=np.int32)


def tree(own: np.ndarray, other: np.ndarray, f: np.ndarray, radius: int, spare: int) -> list[np.ndarray]:
    """Links (2 x n row numbers) of one large bucket: a spanning tree over its own rows, for each other row one link to
    every component within the radius, and links to ``spare`` neighbours in fingerprint order.

    Rows are in order of nodes and links go to the first one in reach, so that buckets agree on the links of a dense group."""
    found = []
    left, label, comps = own, np.zeros(f.shape[1], np.int64), 0
    while len(left):
        front, left = left[:1], left[1:]
        label[front] = comps
        while len(front) and len(left):
            step, front = front[:max(1, CELLS // len(left))], front[max(1, CELLS // len(left)):]
            near = distances(f[:, step, None], f[:, None, left]) <= radius
            hit = near.any(axis=0)
            found.append(np.stack([step[near[:, hit].argmax(axis=0)], left[hit]]))
            label[left[hit]] = comps
            front, left = np.concatenate([front, left[hit]]), left[~hit]
        comps += 1
    line = own[np.lexsort(f[:, own])]
    for gap in range(1, min(spare, len(own) - 1) + 1):
        near = distances(f[:, line[:-gap]], f[:, line[gap:]]) <= radius
        found.append(np.stack([line[:-gap][near], line[gap:][near]]))
    block = max(1, CELLS // len(own))
    for at in range(0, len(other), block):
        some = other[at:at + block]
        r, c = np.nonzero(distances(f[:, some, None], f[:, None, own]) <= radius)
        _, first = np.unique(r * comps + label[own[c]], return_index=True)
        found.append(np.stack([some[r[first]], own[c[first]]]))
    return found


def bucket_links(bucket: np.ndarray, own: np.ndarray, f: np.ndarray, radius: int, spare: int = 0) -> Iterator[np.ndarray]:
    """Row numbers (2 x n) of linked rows; rows are sorted by bucket and node."""
    start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    size = np.diff(np.append(start, len(bucket)))
    owned = np.add.reduceat(own.astype(np.int64), start)
    for g in np.flatnonzero((owned > 0) & (size > 1) & (owned * size > SMALL)):
        rows = np.arange(start[g], start[g] + size[g])
        yield from tree(rows[own[rows]], rows[~own[rows]], f, radius, spare)
    group = np.repeat(np.arange(len(start)), size)
    left = np.flatnonzero(own & ((size > 1) & (owned * size <= SMALL))[group])
    ends = np.cumsum(size[group[left]])
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(ends // CELLS)) + 1, [len(left)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        some = left[a:b]
        n = size[group[some]]
        i = np.repeat(some, n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[group[some]], n)
        keep = (i < j) | ~own[j]
        i, j = i[keep], j[keep]
        near = distances(f[:, i], f[:, j]) <= radius
        yield np.stack([i[near], j[near]])


def links(nodes: DataFrame, plan: list[tuple[int, int, int, int]], parts: int, radius: int, spare: int = 0) -> DataFrame:
    """(a, b) of nodes (node, f0 ..) with at most ``radius`` differing bits that agree in a segment up to its radius."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(pieces: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(pieces)
            bucket, own, node = (t.column(k).to_numpy() for k in range(3))
            f = np.stack([t.column(k + 3).to_numpy() for k in range(parts)]).view(np.uint64)
            for i, j in bucket_links(bucket, own, f, radius, spare):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

        pieces: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            bucket = batch.column(0).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if pieces and (cut or pieces[-1].column(0)[-1].as_py() != bucket[0]):
                yield from done([*pieces, t.slice(0, cut)] if cut else pieces)
                pieces = []
            elif cut:
                yield from done([t.slice(0, cut)])
            pieces.append(t.slice(cut))
        if pieces:
            yield from done(pieces)

    return (probes(nodes, plan, parts).repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "a long, b long").filter("a <> b").distinct())


def marked_nodes(docs: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, f0) per row and (f0, node) per fingerprint, the smallest id that has it."""
    marked = materialise(fingerprints(docs, id_col, text_col, size, 1).withColumn("doc_id", F.col("doc_id").cast("long")), "fingerprints")
    return marked, materialise(marked.groupBy("f0").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL"), "nodes")


def print_links(docs: DataFrame, id_col: str, text_col: str, size: int = 4, radius: int = 4, segments: int = 3) -> DataFrame:
    """(a, b) of documents whose components are those of ``near_dedup``: equal fingerprints to the smallest id, those in reach to each other."""
    marked, nodes = marked_nodes(docs, id_col, text_col, size)
    equal = marked.join(nodes, "f0").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    return equal.unionByName(links(nodes, layout(1, segments, exact_radii(segments, radius)), 1, radius))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4, segments: int = 3) -> DataFrame:
    """One row per input row: doc_id (integer), fingerprint (16 hex digits), component_id.

    Links join fingerprints with at most ``radius`` differing bits; component_id is the smallest id reachable. Null and
    empty texts, and those of white space, have fingerprint zero and link like any other. Rows without an id
    get the component of their fingerprint if a row with an id has the same one, else null. Repeated
    rows share a component. An empty table gives no rows. Reads the id and text columns only.
    """
    marked, nodes = marked_nodes(docs, id_col, text_col, size)
    roots = components(links(nodes, layout(1, segments, exact_radii(segments, radius)), 1, radius))
    of_print = nodes.join(roots, "node", "left").select("f0", F.coalesce("root", "node").alias("component_id"))
    return marked.join(of_print, "f0", "left").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def similar(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose sets of ``size``-word shingles have a Jaccard similarity of ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            keep, sets = [], {}
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()):
                for node, text in ((a, x), (b, y)):
                    if node not in sets:
                        sets[node] = np.unique(shingle_hashes(text, size))
                p, q = sets[a], sets[b]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(bool(len(p)) and both >= least * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    # not written: both joins read the one shuffle by node that drops repeated ids
    texts = lookup(texts, materialise(named(pairs), "named"), ["node"], "left_semi").dropDuplicates(["node"])
    return (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """The documents without near-copies: of each group linked by similarity ``least`` the smallest id stays, all columns kept.

    Similarity is Jaccard over sets of five-word shingles, checked on the texts. Candidates come from an exact
    prefix filter (``set_join``), so every pair at ``least`` or more is linked. Documents without words
    or id stay; rows that repeat an id stay or go together.
    """
    return _without_copies(docs, _alike(docs, id_col, text_col, size, least).filter("node <> root").select("node"), id_col)


def _alike(docs: DataFrame, id_col: str, text_col: str, size: int, least: float, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of documents that are linked by similarity ``least`` or the links ``known`` (a, b)."""
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    return linked(rows, lambda text: shingle_hashes(text, size), least, lambda pairs: similar(pairs, docs, id_col, text_col, size, least), known)


def _without_copies(docs: DataFrame, copies: DataFrame, id_col: str) -> DataFrame:
    return without(docs, materialise(copies.select(F.col("node").cast(docs.schema[id_col].dataType).alias(id_col)), "copies"), id_col)


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """The documents without near-copies, by SimHash: of each group the smallest id stays, all columns kept.

    The links are those of ``near_dedup``; the exact check that follows adds the pairs of similarity ``least`` or more (see
    ``one_of_each``) whose fingerprints lie further apart, so neither kind of link is lost. Rows without an id stay; rows that
    repeat an id stay or go together. Texts without words are copies of each other.
    """
    by_print = materialise(print_links(docs, id_col, text_col), "print-links")
    return _without_copies(docs, _alike(docs, id_col, text_col, size, least, by_print).filter("node <> root").select("node"), id_col)
