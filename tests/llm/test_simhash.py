import random

import numpy as np
import pytest
import xxhash

from linewell.llm import set_join, simhash
from linewell.llm.components import components


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400, 400 + k) for k in range(1, 200)] + [(k, k + 1) for k in range(700, 760)] + [(5, 5)]
    root = union(800, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == {x: root[x] for p in pairs for x in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    f = [fingerprint(t) for _, t in rows]
    root = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 4])
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f"{x:016x}", least.get(r)) for (i, _), x, r in zip(rows, f, root)), key=repr)


def texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 300]))]
        for _ in range(rng.choice([1, 1, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out[:n]


def test_near_dedup_against_brute_force(table_of):
    rows = [(k, t) for k, t in enumerate(texts(120))] + [(500, None), (501, ""), (502, " \n"), (503, "One"), (504, "one"), (None, "lonely text of some words"), (None, texts(1)[0]), (7, texts(120)[7])]
    random.Random(2).shuffle(rows)
    assert sorted((tuple(r) for r in simhash.near_dedup(table_of(rows)).collect()), key=repr) == brute(rows)
    assert simhash.near_dedup(table_of([])).collect() == []


@pytest.mark.parametrize("small", [1 << 40, 1])
def test_links_miss_no_pair(spark, monkeypatch, small):
    """Random fingerprints with clusters; with small = 1 buckets of more pairs give a spanning tree only."""
    rng = random.Random(6)
    prints = set()
    while len(prints) < 400:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 20])):
            y = x
            for _ in range(rng.randrange(6)):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
    f = np.array(sorted(prints), np.uint64)
    plan = simhash.layout(1, 3, simhash.exact_radii(3, 4))
    assert [r for *_, r in plan] == [1, 1, 0] and sum(w for _, _, w, _ in plan) == 64
    want = [(a, b) for a in range(len(f)) for b in range(a) if np.bitwise_count(f[a] ^ f[b]) <= 4]
    entries = simhash.probes(spark.createDataFrame([(k, int(x)) for k, x in enumerate(f.view(np.int64))], "node long, f0 long"), plan, 1).orderBy("bucket").collect()
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "CELLS", 1 << 40 if small > 1 else 64)
    bucket, own, node, part = (np.array(c) for c in zip(*entries))
    pairs = set()
    for i, j in simhash.bucket_links(bucket, own, part.astype(np.int64).view(np.uint64)[None, :], 4):
        pairs |= {tuple(sorted(p, reverse=True)) for p in zip(node[i].tolist(), node[j].tolist())}
    pairs = {p for p in pairs if p[0] != p[1]}
    assert pairs <= set(want) and union(len(f), pairs) == union(len(f), want)
    if small > 1:
        assert pairs == set(want)


def test_one_of_each(table_of):
    rng = random.Random(9)
    rows, groups, k = [], [], 0
    for g in range(40):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        ids = []
        for c in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(len(base) // 100 if c else 0):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((k, " ".join(copy)))
            ids.append(k)
            k += 1
        groups.append(ids)
    half = rows[0][1].split()
    rows += [(900, " ".join(half[: len(half) // 2] + [f"u{x}" for x in range(len(half) // 2)])), (901, None), (902, ""), (None, rows[1][1]), (903, "one"), (904, "One"), (903, "one")]
    docs = table_of(rows)
    out = simhash.one_of_each(docs)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns
    assert sorted(map(repr, kept)) == sorted(map(repr, [g[0] for g in groups] + [900, 901, 902, None, 903, 903]))
    assert simhash.one_of_each(table_of([])).collect() == []


def brute_kept(rows, size=5, least=0.8):
    """Ids that stay when every pair of texts is compared."""
    sets = [set(simhash.shingle_hashes(t.encode(), size).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def test_one_of_each_in_a_dense_group_of_template_variants(table_of):
    """Variants of one template, under 0.8 to each other, with a near-copy each: pivots link none of the pairs."""
    rng = random.Random(21)
    template = [f"t{rng.randrange(2000)}" for _ in range(300)]
    rows = []
    for v in range(300):
        own = list(template)
        for k in range(8):
            own[36 * k + rng.randrange(30)] = f"v{v}x{k}"
        copy = list(own)
        for k in range(5):
            copy[60 * k + rng.randrange(50)] = f"edit{v}x{k}"
        rows += [(2 * v, " ".join(own)), (2 * v + 1, " ".join(copy))]
    want = brute_kept(rows)
    assert 250 < len(want) <= 310
    assert sorted(r.doc_id for r in simhash.one_of_each(table_of(rows)).collect()) == want


def test_one_of_each_finds_block_and_scattered_edits_near_the_threshold(table_of):
    """Appended and replaced blocks and scattered edits at 0.80 to 0.85: candidates are complete, not likely."""
    rng = random.Random(22)
    rows, k = [], 0
    for n in (100, 300, 1000):
        for kind in ("append", "replace", "scatter"):
            for share in (0.8, 0.82, 0.85) * 5:
                base = [f"b{k}w{rng.randrange(5000)}" for _ in range(n)]
                copy = list(base)
                if kind == "append":
                    copy += [f"c{k}x{x}" for x in range(int(n * (1 / share - 1)) - 1)]
                elif kind == "replace":
                    m = int(n * (1 - share) / (1 + share)) - 5
                    at = rng.randrange(n - m)
                    copy[at:at + m] = [f"c{k}x{x}" for x in range(m)]
                else:
                    for x in range(int(n * (1 - share) / (1 + share) / 5)):
                        copy[(5 * x + 2) * n // max(n, 1)] = f"c{k}x{x}"
                rows += [(k, " ".join(base)), (k + 1, " ".join(copy))]
                k += 2
    want = brute_kept(rows)
    assert len(want) < 0.6 * len(rows)
    assert sorted(r.doc_id for r in simhash.one_of_each(table_of(rows)).collect()) == want


def test_near_stage_links_both_kinds_in_two_rounds_of_components(table_of, monkeypatch):
    """SimHash links and checked pairs meet in the same components, and nothing that grows with the documents is broadcast to compare buckets."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(120)] for _ in range(6)]
    rows = []
    for k, text in enumerate(base):
        rows.append((10 * k, " ".join(text)))
        rows.append((10 * k + 1, " ".join(text[:57] + [word()] + text[58:])))   # one word changed: Jaccard above 0.8
        rows.append((10 * k + 2, " ".join(text) if k % 2 else " ".join(word() for _ in range(120))))
    rows += [(1000, ""), (1001, " "), (1002, None), (None, " ".join(base[0]))]
    docs, asked, plans = table_of(rows), [], []
    for module in (simhash, set_join):
        monkeypatch.setattr(module, "components", lambda links: (asked.append(1), components(links))[1])
    real = set_join.matched
    monkeypatch.setattr(set_join, "matched", lambda *a: (lambda d: (plans.append(d._jdf.queryExecution().executedPlan().toString()), d)[1])(real(*a)))
    kept = sorted((r.doc_id for r in simhash.one_of_each_group(docs).collect()), key=str)
    by_print = {r.doc_id: r.component_id for r in simhash.near_dedup(docs).collect() if r.doc_id is not None}
    asked_of_stage = len(asked) - 1
    roots = dict(by_print)
    sets = {i: set(zip(*[t.split()[j:] for j in range(5)])) for i, t in rows if i is not None and t and t.strip()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] + list(by_print.items())
    for _ in range(len(roots)):
        for a, b in pairs:
            low = min(roots[a], roots[b])
            roots[a] = roots[b] = low
    assert kept == sorted([i for i, r in roots.items() if i == r] + [None], key=str)
    assert asked_of_stage == 2 and plans and not any("Broadcast" in p for p in plans)


def test_long_texts_that_share_a_line_only_are_told_apart_ahead_of_their_texts(table_of, monkeypatch):
    """Sets of thousands of elements fill a short sketch, so every pair of them passed it and both texts were shuffled."""
    rng = random.Random(31)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1500)) for _ in range(6)]
    texts = [f"{t} {' '.join(f'line{k // 2}x{j}' for j in range(60))}" for k, t in enumerate(texts)]
    texts.append(texts[0].replace("x30", "other"))
    checked = []
    real = simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda pairs, *a: (checked.append({(r.a, r.b) for r in pairs.collect()}), real(pairs, *a))[1])
    docs = table_of(list(enumerate(texts)))
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == set(range(6))
    assert set().union(*checked) == {(0, 6)}
