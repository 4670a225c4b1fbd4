import random

import numpy as np
import pyarrow as pa
import pytest

from linewell.llm import decontaminate as dc


def brute_tile(item, doc, least):
    a, b = [False] * len(item), [w == 0 for w in doc]
    while True:
        best, found = 0, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n >= max(best, 1):
                    found = [(i, j)] if n > best else [*found, (i, j)]
                    best = n
        if best < least:
            return a
        for i, j in found:
            if not any(a[i:i + best]) and not any(b[j:j + best]):
                a[i:i + best] = b[j:j + best] = [True] * best


def test_tile():
    rng = random.Random(1)
    for _ in range(400):
        item, doc = ([rng.randint(0 if k else 1, 4) for _ in range(rng.randint(1, 24))] for k in range(2))
        if rng.random() < 0.5:
            c = rng.randint(0, len(item))
            doc = doc[:8] + item[c:] + doc[8:12] + item[:c] + doc[12:]
        least = rng.choice([2, 3, 5])
        assert sum(dc.tile(item, doc, least)) == sum(brute_tile(item, doc, least))


ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def benchmark(spark, rows=()):
    return spark.createDataFrame([(1, ITEM), (2, "one two three four five six seven eight nine ten"), (3, None), (4, "short item"), (5, ""), (6, "--"), *rows], "item_id long, text string")


def doc_rows():
    w = ITEM.split()
    return [(1, "pre " + ITEM.upper() + ", post"), (2, "x " + " ".join(w[10:]) + " mid " + " ".join(w[:10])), (3, " ".join(w[:10])), (4, None), (5, ""), (6, "short item"), (7, "a short item here"), (8, "clean text without anything of the kind at all"),
            (9, " ".join(w[:9] + ["EDIT"] + w[10:])), (10, "fill " * 50_000 + ITEM), (None, ITEM), (11, ITEM + " one two three four five six seven eight nine"), (11, ITEM + " one two three four five six seven eight nine"), (12, " ".join(w[k] + " z" for k in range(20)))]


@pytest.mark.parametrize("block_words", [10, 1000])
def test_decontaminate(spark, table_of, block_words):
    docs = table_of(doc_rows())
    got = {(r.doc_id, r.contaminated, r.item_id, round(r.coverage, 3), r.n_items) for r in dc.decontaminate(docs, benchmark(spark), block_words=block_words).collect()}
    assert got == {(1, True, 1, 1.0, 1), (2, True, 1, 1.0, 1), (3, False, None, 0.0, 0), (4, False, None, 0.0, 0), (5, False, None, 0.0, 0), (6, True, 4, 1.0, 1), (7, False, None, 0.0, 0), (8, False, None, 0.0, 0), (9, True, 1, 0.95, 1),
                   (10, True, 1, 1.0, 1), (None, False, None, 0.0, 0), (11, True, 1, 1.0, 2), (12, False, None, 0.0, 0)}
    clean = dc.clean(docs, benchmark(spark))
    assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 3, 4, 5, 7, 8, 12]
    assert dc.decontaminate(table_of([]), benchmark(spark)).collect() == []
    assert dc.clean(docs, benchmark(spark).limit(0)).count() == len(doc_rows())


def test_against_brute_force(spark, sf):
    """Every document and item whose tiles reach the threshold, found without seeds."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect()}
    offsets, h = dc.word_hashes(pa.array([r.text for r in items.collect()]), {})
    of_item = {r.item_id: h[offsets[k]:offsets[k + 1]] for k, r in enumerate(items.collect())}
    want = set()
    for r in docs.collect():
        d = dc.word_hashes(pa.array([r.text]), {})[1]
        for i, item in of_item.items():
            if len(item) and np.isin(item, d).mean() >= dc.COVERAGE and dc.tile(item.tolist(), d.tolist(), min(5, len(item))).mean() >= dc.COVERAGE:
                want.add((r.doc_id, i))
    assert got == want and want
