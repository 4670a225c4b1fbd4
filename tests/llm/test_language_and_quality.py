import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linewell.llm import language_id, quality
from linewell.llm.common import held_out, words


def test_words():
    offsets, codes, names = words(pa.array([" A b\tb", None, "", "\x0b \n", "c\u00a0d  A"]))
    assert offsets.tolist() == [0, 3, 3, 3, 3, 5]
    assert [names[int(c)].as_py() for c in codes] == ["a", "b", "b", "c\u00a0d", "a"]


def test_held_out(spark):
    ids = [*range(40), None]
    got = {r.i: r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", held_out("i", 4).alias("h")).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.language_id(docs)
    assert out.count() == docs.count() and language_id.accuracy(out, docs) > 0.95
    assert out.filter("NOT (score BETWEEN 0 AND 1)").count() == 0


def test_language_cases(spark, table_of):
    train = [(100 + k, t, lang) for k in range(40) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    rows = [(1, None), (2, ""), (3, "12 34 -- ²"), (4, "the dog"), (5, "katzen"), (6, "日本"), (7, "the " * 100_000), (7, "the"), (None, "die hunde"), (8, "Cat, AND dog!")]
    docs = table_of([*train, *rows])
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.language_id(docs).collect() if r.doc_id is None or r.doc_id < 100]
    pred = {(i, p) for i, p, _ in got}
    assert pred == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "de"), (7, "en"), (None, "de"), (8, "en")} and len(got) == len(rows)
    assert all(s == 0 for i, _, s in got if i in (1, 2, 3)) and all(0.5 <= s <= 1 for i, p, s in got if p != "und")
    assert {r.lang_pred for r in language_id.language_id(table_of(rows)).collect()} == {"und"}  # nothing to learn from
    assert language_id.language_id(table_of([])).collect() == []


def test_word_first_then_shorter_ngrams():
    v = lambda *x: np.array(x, np.float32)
    m = language_id.Model.of(["a", "b"], [{"word": v(-1, -2)}, {"q": v(-5, -6)}, {}, {" ab": v(-3, -4), "abc": v(-5, -4)}, {"abcd": v(-9, -9)}])

    def of_token(token):
        has, rows, weights = m.of_token(token)
        return has, (m.logs[rows] * np.array(weights)[:, None]).sum(axis=0).tolist() if rows else [0, 0]
    assert of_token("word") == (True, [-1, -2])
    assert of_token("abc") == (True, [-4, -4])   # half of its 3-grams are known, none of its 4-grams
    assert of_token("qx") == (True, [-5, -6]) and of_token("zz") == (True, [0, 0]) and of_token("12.") == (False, [0, 0])
    assert of_token("word-ABC") == (True, [-5, -6])


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 0] + 0.3 * rng.normal(size=60) > 0, 1, -1)
    cost = np.full(60, 0.5)
    w = quality.descend([(np.arange(5), r) for r in x], y, cost, 5, epochs=400)
    objective = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    best, g = w.copy(), w.copy()
    for k in range(20000):  # subgradient steps from there find nothing better
        g = g - 0.01 / (k + 1) ** 0.5 * (g - ((y * (x @ g) < 1) * cost * y) @ x)
        best = g if objective(g) < objective(best) else best
    assert objective(w) <= objective(best) + 1e-2


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.quality(docs, labels).cache()
    assert out.count() == docs.count() and out.filter("NOT (score BETWEEN 0 AND 1) OR predicted <> cast(score >= 0.7 AS int)").count() == 0
    j = out.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.avg(F.when(F.col("quality") == 0, F.col("predicted")))).first()
    assert j[0] > 0.93 and j[1] < 0.1


def test_quality_cases(spark, table_of):
    train = [(100 + k, f"good words here number {k}" if k % 2 else f"BUY!! NOW!! {k} $$$") for k in range(80)]
    rows = [(1, None), (2, ""), (3, "good words"), (4, "BUY!! NOW!!"), (None, "good words here"), (5, "good " * 50_000), (5, "good words here")]
    docs = table_of([*train, *rows])
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in train] + [(101, 0, 0), (None, 1, 0), (102, None, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    own = [(r.doc_id, r.score) for r in got if r.doc_id is None or r.doc_id < 100]
    assert len(got) == len(train) + len(rows)
    s = dict(own)
    assert s[1] == s[2] and s[3] > s[4] and s[None] > s[4]
    kept = quality.passing(docs, labels)
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(repr(d) for d, r in zip(docs.collect(), quality.score(docs, quality.fit(docs, labels)).collect()) if r.predicted)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert len({r.score for r in quality.quality(docs, labels.filter("quality = 1")).collect()}) == 1
    assert quality.quality(table_of([]), labels).collect() == []


def test_every_language_is_learned(table_of):
    """230 languages with a word of their own, the last ones with one document each."""
    word = ["".join(chr(97 + k // 26 ** e % 26) for e in range(3)) * 2 for k in range(230)]
    rows = [(2 * k + c, f"{word[k]} {word[k]} {word[k]}", f"l{k:03d}", None) for k in range(230) for c in range(2 if k < 115 else 1)]
    docs = table_of(rows)
    model = language_id.fit(docs, F.lit(True))
    assert model.langs == [f"l{k:03d}" for k in range(230)]
    want = {r[0]: r[2] for r in rows}
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()} == want
