import hashlib
import math
import random
import re
from collections import Counter

from linewell.llm import exact_dedup, mixing, queries
from tests.llm.conftest import rows_of
from tests.oracle_check import compare, duck


def test_oracles(spark, sf):
    con = duck(sf)
    for name in ("op3_mixing", "op4_exact_dedup"):
        got, want, _ = compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], sf)
        assert got == want, name


def brute_dedup(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    size = Counter(norm)
    least = {}
    for (i, _), n in zip(rows, norm):
        least[n] = i if least.get(n) is None else min(x for x in (i, least[n]) if x is not None) if i is not None else least[n]
    return sorted(((i, least[n], size[n], i == least[n], hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm)), key=repr)


def test_exact_dedup_cases(spark, table_of):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (5, None), (4, ""), (None, "a b"), (None, "alone"), (7, "same"), (7, "same"), (8, "x" * 200_000), (9, "x" * 200_000), (10, " "), (11, "\n\n"), (12, "a\u00a0b")]
    rows += [(100 + k, "hot") for k in range(40)] + [(200 + k, f"cold {k // 2}") for k in range(30)]
    random.Random(1).shuffle(rows)
    for limit in (4, 1000):  # at 4 only "hot" is a heavy hitter
        assert rows_of(exact_dedup.exact_dedup(table_of(rows), limit=limit)) == brute_dedup(rows)
    kept = exact_dedup.distinct_texts(table_of(rows))
    assert kept.columns == table_of(rows).columns
    want = Counter(r[0] for r in brute_dedup(rows) if r[3] or r[0] is None)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_exact_dedup_empty(table_of):
    assert exact_dedup.exact_dedup(table_of([])).collect() == []
    assert exact_dedup.distinct_texts(table_of([])).collect() == []


def test_heavy_hitters_are_bounded(table_of):
    rows = [(k, f"t{k % 50}") for k in range(500)]
    digests = exact_dedup.materialise(table_of(rows).selectExpr("doc_id", "unhex(sha2(text, 256)) AS digest"), "d")
    assert exact_dedup.heavy_hitters(digests, 20).count() == 0
    assert exact_dedup.heavy_hitters(digests, 60).count() == 50
    counts = {k: v for k, v in zip("abcdef", (9, 7, 5, 3, 2, 1))}
    assert exact_dedup.shrink(dict(counts), 3) == {"a": 6, "b": 4, "c": 2}


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshares until none is above its stop, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        free = sum(w[s] for s in names if s not in stopped)
        t = {s: most * sizes[s] if s in stopped else left * w[s] / free for s in names}
        over = {s for s in names if s not in stopped and t[s] > most * sizes[s]}
        if not over:
            return t
        stopped |= over


def mixing_rows():
    rng = random.Random(4)
    size = {"a": 400, "b": 60, None: 300, "ä": 20, "Z": 500, "zero": 3}
    rows, k = [], 0
    for s, n in size.items():
        for _ in range(n):
            rows.append((k, None if s == "zero" else "w " * rng.choice([1, 5, 20, 200 if rng.random() < 0.05 else 9]), None, s))
            k += 1
    return rows


def test_mixing_against_brute_force(table_of):
    rows = mixing_rows()
    out = mixing.mix(table_of(rows), block_rows=100).collect()
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    of_source, taken, copies = Counter(), Counter(), {}
    for i, s in source.items():
        of_source[s] += size[i]
    goal = brute_targets(dict(of_source))
    for r in out:
        assert r["size"] == size[r.doc_id] and r.source_size == of_source[source[r.doc_id]]
        assert math.isclose(r.target, goal[source[r.doc_id]], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
        copies[r.doc_id] = r.copies
    for s, t in goal.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 250), (s, taken[s], t)
        n = [copies[i] for i in source if source[i] == s]
        rate = t / of_source[s] if of_source[s] else 0
        assert set(n) <= {math.floor(rate), math.ceil(rate)} and abs(sum(n) - rate * len(n)) <= 1
    assert rows_of(mixing.mix(table_of(rows), block_rows=100)) == sorted((tuple(r) for r in out), key=repr)  # reruns agree


def test_mixing_cases(table_of):
    rows = [(1, "a b", None, "s"), (1, "a b", None, "s"), (None, "c", None, None), (2, None, None, "t"), (3, "", None, "t"), (4, "x " * 50_000, None, "s")]
    out = mixing.mix(table_of(rows)).collect()
    assert len(out) == len(rows) and sum(r.taken for r in out if r["size"] == 0) == 0
    assert mixing.mix(table_of([])).collect() == []
    assert {r.target for r in mixing.mix(table_of([(1, None, None, "s"), (2, "", None, None)])).collect()} == {0.0}


def test_mix_is_native(table_of):
    plan = mixing.copies(table_of(mixing_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_copies_keep_columns(table_of):
    rows = mixing_rows()[:300] + [(None, "n n", None, "a")]
    docs = table_of(rows).withColumnRenamed("node", "copy")
    out = mixing.copies(docs)
    assert out.columns == [*docs.columns, "copy_"]
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want
