import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from linewell.llm import suffix_dedup as sd
from linewell.llm.suffix_array import _sorted, common_prefixes, string_groups, suffix_array


def test_arrays():
    rng = np.random.default_rng(1)
    for k in range(60):
        n = int(rng.integers(0, 400))
        d = rng.integers(0, rng.integers(1, 5), n).astype(np.uint8) * np.uint8(rng.choice([1, 80]))
        if n > 100:
            d[50:100] = d[:50]
        order, b = suffix_array(d), d.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        shared = common_prefixes(d, order, 50)
        for j in range(1, n):
            x, y = b[order[j - 1]:][:50], b[order[j]:][:50]
            assert shared[j] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def brute(rows):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            w = b[p:p + 50]
            first[w] = min(i, first.get(w, i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(n):
    rng = random.Random(8)
    letters = "abcdefgh éß\n"
    fresh = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [fresh(rng.choice([49, 50, 51, 60, 120, 400])) for _ in range(12)]
    rows = []
    for k in range(n):
        t = "".join(rng.choice([fresh(rng.randrange(80)), rng.choice(passages), rng.choice(passages)[rng.randrange(40):]]) for _ in range(rng.randrange(6)))
        rows.append((k, passages[5] + t if k % 3 == 0 else t))
    rows += [(n + 1, "a" * 5000), (n, "a" * 3000), (n + 2, "ab" * 2000), (n + 3, "ab" * 30), (n + 4, rows[3][1]), (n + 5, None), (n + 6, ""), (None, passages[5] * 2), (3, rows[3][1]), (n + 7, "\x00" * 60), (n + 8, "\x00" * 55), (n + 9, passages[5] * 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"array_bytes": 500}, {"array_bytes": 2000, "hot_least": 3, "bucket_bytes": 3000, "shard_bytes": 3000}])
def test_against_brute_force(table_of, options):
    """With small arrays shards merge by binary search; with a low limit for hot anchors most strings go one by one."""
    rows = corpus(80)
    out = sd.dedup_substrings(table_of(rows).repartition(5), keep_text=True, **options)
    got = out.collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_far_apart_ids(table_of):
    rows = [(k * 10**12, t) for k, (i, t) in enumerate(corpus(20)) if i is not None]
    assert sorted((tuple(r) for r in sd.dedup_substrings(table_of(rows)).collect()), key=repr) == brute(rows)


def test_empty(table_of):
    assert sd.dedup_substrings(table_of([])).collect() == []
    assert [r.n_bytes for r in sd.dedup_substrings(table_of([(1, None)])).collect()] == [0]


def test_merge_by_binary_search():
    rng = random.Random(2)
    shards = []
    for _ in range(4):
        keys = sorted({bytes(rng.choice(b"\x00ab") for _ in range(3)) for _ in range(8)})
        shards.append((np.array(keys, "S50"), np.array([rng.randrange(100) for _ in keys])))
    least = {}
    for k, m in shards:
        for a, b in zip(k.tolist(), m.tolist()):
            least[a] = min(b, least.get(a, b))
    for (k, _), m in zip(shards, sd.merged_least(shards)):
        assert m.tolist() == [least[a] for a in k.tolist()]


def test_neighbouring_ranges_are_one_row():
    """Strings of hot anchors go one by one; what they remove is still a row per removed run."""
    rng = np.random.default_rng(5)
    doc, begin = rng.integers(0, 4, 400), rng.integers(0, 9000, 400)
    end = begin + rng.integers(50, 70, 400)
    rows = sd.ranges(doc, begin, end).to_pylist()
    covered = lambda found: sorted({(d, p) for d, a, b in found for p in range(a, b)})
    assert covered([(r["doc_id"], r["begin"], r["end"]) for r in rows]) == covered(list(zip(doc.tolist(), begin.tolist(), end.tolist())))
    ordered = sorted((r["doc_id"], r["begin"], r["end"]) for r in rows)
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(ordered, ordered[1:]))
    steps = np.arange(1000)
    assert sd.ranges(np.full(1000, 7), steps, steps + 50).to_pylist() == [{"doc_id": 7, "begin": 0, "end": 1049}]
    assert sd.ranges(steps[:0], steps[:0], steps[:0]).num_rows == 0


@pytest.mark.parametrize("options", [{}, {"hot_least": 3}])
def test_shards_in_parts(table_of, options):
    """A shard far above the bytes compared at a time never compares all of them at once."""
    rows = corpus(60)
    out = sd.dedup_substrings(table_of(rows), part_bytes=1500, **options)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("depth", [5, 8, 50, 64])
def test_string_groups_equal_the_whole_array(depth):
    """Pieces that share long strings, with zeros and with pieces shorter than the depth."""
    rng = np.random.default_rng(6)
    for _ in range(25):
        pool = rng.integers(0, rng.integers(1, 4), 300).astype(np.uint8) * np.uint8(rng.choice([1, 90, 255]))
        cuts = [(int(a), int(rng.integers(1, 150))) for a in rng.integers(0, 220, 12)] + [(0, 70)]
        parts = [pool[a:a + n] for a, n in cuts]
        data, size = np.concatenate(parts), np.array([len(x) for x in parts])
        at, group = string_groups(data, size, depth)
        order = suffix_array(data)
        whole = np.repeat(np.cumsum(size), size) - np.arange(len(data)) >= depth
        want = (np.cumsum(common_prefixes(data, order, depth) < depth) - 1)[whole[order]]
        want = np.unique(want, return_inverse=True)[1]
        kept = order[whole[order]]
        assert sorted(at.tolist()) == sorted(kept.tolist())
        number = np.empty(len(data), np.int64)
        number[kept] = want
        assert group.tolist() == number[at].tolist()     # the same groups in the same order


def test_keys_too_wide_to_pack():
    rng = np.random.default_rng(7)
    key, pos = rng.integers(0, 1 << 62, 500).astype(np.uint64) >> np.uint64(1), np.arange(0, 5000, 10)
    key[100:200] = key[:100]
    at, new = _sorted(pos, key.copy(), 62)
    sorted_key = key[at // 10]
    assert (np.diff(sorted_key.astype(np.int64)) >= 0).all() and sorted(at.tolist()) == pos.tolist()
    assert new.tolist() == [True, *(sorted_key[1:] != sorted_key[:-1])]


class Caught:
    """Takes the place of a table: keeps the function that would run on it."""

    sparkSession = sparkContext = property(lambda self: self)

    def broadcast(self, value):
        return type("Value", (), {"value": value})

    def mapInArrow(self, function, schema):
        return function


def test_a_slice_is_one_batch_whatever_the_shards():
    """Rows of pieces grow with slices times shards; a batch for each of them made the work of a large input grow with its square."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdefgh"), 700)) for _ in range(40)]
    rows, anchors = [], []
    for t in texts:
        runs = sd.Runs(*sd.buffer_of(pa.array([t])))
        anchors.append(np.unique(sd.anchor_ids(runs.anchor, 4)).view(np.int64).tolist())
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts), pa.array(anchors, pa.list_(pa.int64()))], ["doc_id", "text", "anchors"])
    out = list(sd.pieces(Caught(), 4, 1000, np.zeros(0, np.uint64))(iter([batch, batch])))
    assert len(out) == 2 and sum(b.num_rows for b in out) > 1000
