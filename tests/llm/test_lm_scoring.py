import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from linewell.llm import lm_scoring as lm


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def check(rows, out, hot):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(t for (_, text), h in zip(rows, held) if not h for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), h, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for (i, t), h in zip(rows, held))
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert got == want, hot
    assert all(r.score < 0 for r in out) or not n


def test_base_scores(spark, table_of):
    rows = [(k, f"The cat {k % 5} sat on the mat" if k % 3 else f"Ein hund {k} lief \x0b weg") for k in range(60)]
    rows += [(100, None), (101, ""), (102, "unseen words only"), (None, "the cat"), (None, "other text"), (7, rows[7][1]), (7, rows[7][1]), (103, "the rare " * 20_000), (104, "NEW \u00c4"), (100, "again")]
    for hot in (4, 1 << 20):
        out = lm.held_out("doc_id", 7)
        check(rows, lm.score(table_of(rows), ~out, out, hot=hot).collect(), hot)
    assert lm.lm_scores(table_of([])).collect() == []
    alone = lm.lm_scores(table_of([(5, "a b")])).collect()[0] if zlib.crc32(b"5") % 7 == 2 else None
    assert alone is None or (alone.train_tokens, alone.n_known) == (0, 0)


def test_hot_limit_changes_nothing(table_of):
    rows = [(k, " ".join(f"w{x}" for x in range(1100) if (x * 7919 + k) % (3 + x) < 3)) for k in range(60)]
    out = lm.held_out("doc_id", 7)
    scores = [{r.doc_id: r.score for r in lm.score(table_of(rows), ~out, out, hot=h).collect()} for h in (2500, 1 << 20)]
    assert all(math.isclose(scores[0][k], scores[1][k], rel_tol=1e-6) for k in scores[0])


def model():
    rng = np.random.default_rng(1)
    tokens = [lm.END] + [f"t{k}" for k in range(1500)]
    counts = np.sort(rng.integers(1, 900, len(tokens)))[::-1].copy()
    v = lm.Vocabulary(tokens, counts, int(counts.sum()) + 777, len(tokens) + 300)
    w = lm.Weights((rng.normal(size=(1 << lm.BITS, lm.CLASSES)) * 0.2).astype(np.float32), (rng.normal(size=(1 << lm.BITS, lm.WIDTH)) * 0.2).astype(np.float32))
    return v, w


def test_probabilities_sum_to_one():
    v, w = model()
    rows = np.repeat(np.array([[5, 77, 1234, 999]], np.uint16), v.size + 1, axis=0)
    y = np.append(np.arange(v.size), (lm.CLASSES - 1) * lm.WIDTH)
    assert abs(np.exp(lm.log_probabilities(v, w, rows, y)).sum() - 1) < 1e-4
    own = v.counts[v.size:]  # rare tokens of the table, those beyond it, and one unseen
    rare = (own + 1).sum() + (777 + 300) + 1
    assert abs(rare / (v.total + v.distinct + 1) * 10 ** v.rare_shift - 1) < 1e-9


def test_gradient_steps_lower_the_loss():
    v, _ = model()
    rng = np.random.default_rng(3)
    rows = np.repeat(rng.integers(0, 1 << lm.BITS, (8, 4)), 800, axis=0).astype(np.uint16)
    y = np.repeat(rng.integers(0, v.size, 8), 800)
    order = rng.permutation(len(y))
    t = lm.Trainer(v, lm.Weights.zero())
    before = lm.log_probabilities(v, t.w, rows, y).mean()
    for _ in range(20):
        t.learn(rows[order], y[order])
    assert lm.log_probabilities(v, t.w, rows, y).mean() > before + 1


def test_history_stays_inside_a_text():
    s = lm.Sequence.of(pa.array(["a b c", None, "a b c"]))
    h = lm.history(s, {})
    assert s.offsets.tolist() == [0, 4, 5, 9] and (h[:4] == h[5:]).all() and (h[0] == h[4]).all()


def test_beats_unigrams_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.lm_scores(docs).filter("held_out").selectExpr("sum(base_score) / sum(n_tokens) AS base", "sum(score) / sum(n_tokens) AS model").first()
    assert r.model > r.base + 0.05
