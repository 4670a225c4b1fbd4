"""Exact similarity join of sets by prefix filtering.

Two sets with a Jaccard similarity of ``least`` or more share an element among the first n - ceil(least * n) + 1 of each,
in any order that is the same for all sets. The order puts elements that a sample shows to be common last, which keeps
buckets small; what the sample misses costs time and loses nothing.

Prefixes are dealt out by element, packed per slice. Every bucket first links its members to three pivots; these links are
checked on the texts, and only pairs that the checked links leave in different components are listed after that.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.functions.joins import lookup, matched, materialise, planned_bytes
from linewell.llm.common import mix64, slices
from linewell.llm.components import components

SAMPLE = 20_000     # documents that show which elements are common
COMMON = 1 << 18    # elements of the sample that are told apart by their counts
KEY_BYTES = 8 << 20  # input per key that prefixes are dealt to
TILE = 2048         # members of a bucket that a task compares with as many others
CELLS = 1 << 18     # pairs compared at once
PIVOTS = 3
BITS = 512
FINE_BITS = 8192    # sets of over a thousand elements fill 512 bits, whatever they hold
ENTRY = np.dtype([("token", "<u4"), ("node", "<i8"), ("n", "<i4")])

Sets = Callable[[bytes | None], np.ndarray]


def prefix_length(n: int, least: float) -> int:
    return n - int(np.ceil(least * n - 1e-9)) + 1


def common(docs: DataFrame, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Sorted elements that three or more documents of a sample share, and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.unique(sets(t)) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            x, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n)], ["x", "n"])

    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < share * (1 << 30)).select("text")
    top = some.mapInArrow(run, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).filter("n > 2").orderBy(F.desc("n"), "x").limit(COMMON).toPandas()
    x, n = top["x"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(x)
    return x[order], n[order]


def prefix(u: np.ndarray, known: np.ndarray, count: np.ndarray, least: float) -> np.ndarray:
    """The first elements of a set (sorted, distinct), common ones last."""
    p = prefix_length(len(u), least)
    if not len(known):
        return u[:p]
    at = np.minimum(np.searchsorted(known, u), len(known) - 1)
    rank = np.where(known[at] == u, count[at], 0)
    return u[np.lexsort((u, rank))[:p]] if rank.any() else u[:p]


def buckets(docs: DataFrame, sets: Sets, least: float) -> DataFrame:
    """(token, node, n, pivots) of members of every bucket of two or more; 32 bits of an element and its key make a token."""
    known, count = common(docs, sets)
    shared = docs.sparkSession.sparkContext.broadcast((known, count))
    keys = 1 << int(np.ceil(np.log2(max(256, planned_bytes(docs) / KEY_BYTES))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for batch in slices(batches):
            found, sizes = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                u = np.unique(sets(text))
                found.append(prefix(u, known, count, least) if len(u) else u)
                sizes.append(len(u))
            own = [len(p) for p in found]
            x = mix64(np.concatenate(found))
            rows = np.empty(len(x), ENTRY)
            rows["token"], rows["node"], rows["n"] = x >> np.uint64(32), np.repeat(batch.column(0).to_numpy(), own), np.repeat(sizes, own)
            key = (x & np.uint64(keys - 1)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, rows = key[order], rows[order]
            if len(key):
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
                yield pa.RecordBatch.from_arrays([pa.array(key[cuts[:-1]]), pa.array([rows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], ["key", "rows"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: int, blobs: list[bytes]) -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(blobs), ENTRY)
            rows = rows[np.lexsort((rows["node"], rows["token"]))]
            token, node, n = rows["token"], rows["node"], rows["n"]
            if len(rows) > 1:
                fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))  # two elements of a set may share 32 bits
                token, node, n = token[fresh], node[fresh], n[fresh]
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.append(start, len(token)))
            several = np.repeat(size > 1, size)
            token, node, n, group = token[several], node[several], n[several], np.repeat(np.arange((size > 1).sum()), size[size > 1])
            start = np.flatnonzero(np.concatenate(([True], np.diff(group) > 0))) if len(group) else group
            pivots = []
            for k in range(PIVOTS):  # the same salts in every bucket, so that buckets agree on pivots
                first = np.lexsort((mix64(node.astype(np.uint64) ^ np.uint64(k)) if k else node, group))[start] if len(group) else group
                other = n[first][group] if len(group) else n
                fits = np.minimum(n, other) >= least * np.maximum(n, other) - 1e-9  # else their sizes alone rule the similarity out
                pivots.append(np.where(fits, node[first][group], node) if len(group) else node)
            return pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64) * keys + key), pa.array(node), pa.array(n), *map(pa.array, pivots)], ["token", "node", "n", *[f"p{k}" for k in range(PIVOTS)]])

        last, blobs = None, []
        for batch in batches:
            for key, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != last and blobs:
                    yield done(last, blobs)
                    blobs = []
                last = key
                blobs.append(rows)
        if blobs:
            yield done(last, blobs)

    packed = docs.select("node", "text").mapInArrow(pack, "key long, rows binary")
    return packed.repartition("key").sortWithinPartitions("key").mapInArrow(unpack, "token long, node long, n int, " + ", ".join(f"p{k} long" for k in range(PIVOTS)))


def sketches(docs: DataFrame, sets: Sets, width: int = BITS) -> DataFrame:
    """(node, sketch, elements): parities of the elements that fall on each of ``width`` bits, and the size of the set. As many bits as differ,
    or more, are elements of one set alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, sizes = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                u = np.unique(sets(text))
                out.append(np.packbits(np.bincount((mix64(u) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes())
                sizes.append(len(u))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(sizes, pa.int32())], ["node", "sketch", "elements"])

    return docs.select("node", "text").mapInArrow(run, "node long, sketch binary, elements int")


def bits(column: pa.Array) -> np.ndarray:
    """Sketches as words of 64 bits, (words, rows)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1).T


def possible(pairs: DataFrame, shapes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity. It leaves out none that has it, and spares the others the
    shuffle of their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, n = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 5))
            alone = sum(np.bitwise_count(x ^ y).astype(np.int32) for x, y in zip(bits(batch.column(2)), bits(batch.column(4))))
            fits = (alone * (1 + least) <= (1 - least) * (m + n) + 1e-6) & (np.minimum(m, n) >= least * np.maximum(m, n) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(fits, pa.bool_()))

    def of(side: str) -> DataFrame:
        return shapes.select(F.col("node").alias(side), F.col("sketch").alias(f"{side}_sketch"), F.col("elements").alias(f"{side}_n"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_sketch", "a_n", "b_sketch", "b_n")
    return rows.mapInArrow(run, "a long, b long")


def refined(pairs: DataFrame, docs: DataFrame, sets: Sets, least: float) -> DataFrame:
    """The pairs (a, b) that long sketches, made for the documents in them only, allow as well: two long texts always pass the short
    ones, and their sketches take a fraction of the shuffle that the texts take."""
    paired = materialise(named(pairs), "paired")
    shapes = sketches(lookup(docs, paired, ["node"], "left_semi"), sets, FINE_BITS).dropDuplicates(["node"])
    return materialise(possible(pairs, materialise(shapes, "fine-sketches"), least), "refined")


def named(pairs: DataFrame) -> DataFrame:
    """(node) of the documents in pairs (a, b)."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def across(members: DataFrame, shapes: DataFrame, least: float) -> DataFrame:
    """(a, b) of all pairs of a bucket in different components whose sizes and sketches allow the similarity; large buckets in tiles.

    At ``least`` or more, at most (1 - least) / (1 + least) of both sizes are elements of one set alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            chunk, node, n, root = (t.column(c).to_numpy() for c in ("chunk", "node", "n", "root"))
            sketch = bits(t.column("sketch"))
            low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
            x, y = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
            block = max(1, CELLS // len(y)) if len(y) else 1
            for at in range(0, len(x) if len(y) else 0, block):
                i, j = x[at:at + block, None], y[None]
                fits = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9)
                if low == high:
                    fits &= i < j
                r, c = np.nonzero(fits)
                r, c = x[at + r], y[c]
                for part in range(0, len(r), CELLS):
                    some, other = r[part:part + CELLS], c[part:part + CELLS]
                    alone = sum(np.bitwise_count(w[some] ^ w[other]).astype(np.int32) for w in sketch)
                    near = alone * (1 + least) <= (1 - least) * (n[some].astype(np.int64) + n[other]) + 1e-6
                    r[part:part + CELLS], c[part:part + CELLS] = np.where(near, some, -1), np.where(near, other, -1)
                r, c = r[r >= 0], c[c >= 0]
                a, b = node[r], node[c]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        pieces: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            ids = np.stack([t.column(c).to_numpy() for c in ("token", "low", "high")])
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(ids, axis=1) != 0).any(axis=0)) + 1, [len(t)]))
            if pieces and any(pieces[-1].column(c)[-1].as_py() != t.column(c)[0].as_py() for c in ("token", "low", "high")):
                yield from done(pa.concat_tables(pieces))
                pieces = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a:
                    yield from done(pa.concat_tables(pieces))
                    pieces = []
                pieces.append(t.slice(a, b - a))
        if pieces:
            yield from done(pa.concat_tables(pieces))

    mixed = members.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("token", F.ceil(F.col("m") / TILE).cast("int").alias("k"))
    open_ = materialise(matched(members, materialise(mixed, "mixed"), ["token"], "inner"), "open")
    rows = matched(open_, shapes.drop("elements"), ["node"], "inner").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    tiles = rows.select("token", "node", "n", "root", "sketch", "chunk", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")).select(
        "token", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "n", "root", "sketch")
    return tiles.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(run, "a long, b long").distinct()


def linked(docs: DataFrame, sets: Sets, least: float, check: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> DataFrame:
    """(node, root) of documents (node, text) that are linked by a similarity of ``least``; ``check`` keeps the true pairs.

    ``known`` holds links (a, b) of another kind that count as well; what they join isn't compared again.
    """
    found = materialise(buckets(docs, sets, least), "buckets")
    to_pivots = found.select("node", F.explode(F.array(*[F.col(f"p{k}") for k in range(PIVOTS)])).alias("pivot")).filter("node <> pivot")
    star = materialise(to_pivots.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "star")
    shapes = materialise(sketches(docs, sets).dropDuplicates(["node"]), "sketches")
    true = check(refined(materialise(possible(star, shapes, least), "possible"), docs, sets, least))
    roots = materialise(components(true if known is None else true.unionByName(known)), "roots")
    members = matched(found.select("token", "node", "n"), roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    rest = materialise(matched(across(members, shapes, least), star, ["a", "b"], "left_anti"), "across")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(check(refined(rest, docs, sets, least))))
