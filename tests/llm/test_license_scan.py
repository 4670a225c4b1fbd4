import duckdb
import pytest

from linewell.llm import license_scan as ls
from linewell.llm.common import session

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    cur = con.execute(ls.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    return sorted([tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall()], key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=repr)


def text_of(t, change=0, drop_key=False):
    words = t.words
    for k in [k for k in range(len(words)) if k not in t.keys][:change]:
        words[k] = "zzz"
    if drop_key:
        words[t.keys[0]] = "zzz"
    return " ".join(words)


def test_keys_are_places_of_the_marked_words():
    t = ls.Template("x", "a *b c* d *e*")
    assert (t.words, t.keys) == (["a", "b", "c", "d", "e"], [1, 2, 4])
    assert ls.Template("x", "a b").keys == [0, 1]


def test_every_template_equals_all_alignments(spark, table_of):
    rows = []
    for t in ls.TEMPLATES:
        rows += [text_of(t).upper(), "so " + text_of(t, 2) + " end", text_of(t, drop_key=True), text_of(t)[:-2], " - ".join(t.words[2:]), text_of(t) + " " + text_of(t)]
    rows = [(k, x) for k, x in enumerate(rows)]
    want = oracle(rows)
    assert got(ls.licenses(table_of(rows))) == want
    assert {label for r in want for label in r[6].split(",")} >= {t.label for t in ls.TEMPLATES}


def test_nulls_empty_long_repeated_and_unicode_texts(spark, table_of):
    long = "mit license " * 30_000 + "é" * 100_000 + " Apache\x00License"
    rows = [(1, None), (2, ""), (3, "  ...  "), (None, "MIT-License!"), (5, "mit_license mitlicense"), (5, "mit_license mitlicense"), (6, long), (7, "mit licensé mit license"), (8, "the GENERAL public\nlicense"),
            (9, "mit mit license license"), (10, "MİT license K license")]
    assert got(ls.licenses(table_of(rows))) == oracle(rows)
    assert got(ls.licenses(table_of([]))) == []


def test_matches_keep_spans_and_labels(spark):
    docs = session(spark).createDataFrame([(1, "Released under the MIT License. This work is licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    found = ls.scan(docs).first()["matches"]
    assert sorted((m["label"], m["base"], m["start"], m["aligned"]) for m in found) == [("cc-by-nc", False, 8, 7), ("mit", True, 3, 2)]


@pytest.mark.parametrize("frequency", [{}, {"license": 0, "mit": 9}, {"mit": 0, "license": 9}, {"cc": 5, "by": 1, "nc": 9}])
def test_results_do_not_depend_on_frequencies(frequency):
    import pyarrow as pa
    texts = pa.array(["x mit license mit", "licensed under cc by nc 4 0", "", "by nc cc by nc 4 0"])
    index = ls.Index(ls.TEMPLATES, frequency)
    offsets, codes = ls.coded_words(texts, pa.array(index.words, pa.large_string()))
    found = sorted((d, s, n, p.template.label) for text, start, aligned, p in index.places(offsets, codes) for d, s, n in zip(text.tolist(), start.tolist(), aligned.tolist()))
    assert found == [(0, 1, 2, "mit"), (1, 0, 7, "cc-by-nc")]
