import json
import os

import pytest
from pyspark.sql import functions as F

from linewell.operators import chain, ledger
from linewell.sources import log_files, writers
from linewell.sources.run_store import RunStore


def test_a_run_is_visible_as_a_whole_or_not_at_all(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    good = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    bad = good.select(F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        store.write({"x": good, "y": bad}, "r1")
    assert store.runs() == [] and store.read("x", good.schema).count() == 0
    assert not any(f.endswith(".parquet") for _, _, files in os.walk(tmp_path) for f in files)
    assert store.write({"x": good, "y": good}, "r1") and store.write({"x": good.limit(1)}, "r2")
    assert not store.write({"x": good.union(good)}, "r1")
    assert sorted(map(tuple, store.read("x", good.schema).collect()), key=repr) == [(1, "a", "r1"), (1, "a", "r2"), (2, None, "r1")]
    assert store.read("y", good.schema, ["r2"]).count() == 0 and store.runs() == ["r1", "r2"]


def test_two_attempts_at_one_run_leave_one(spark, tmp_path):
    a, b = RunStore(spark, str(tmp_path)), RunStore(spark, str(tmp_path))
    df = spark.range(3)
    publish = a._publish

    def other_first(run_id, text):
        assert b.write({"x": df.limit(1)}, run_id)
        return publish(run_id, text)
    a._publish = other_first
    assert not a.write({"x": df}, "r")
    assert a.read("x", df.schema).count() == 1 and len(os.listdir(tmp_path / "data" / "r")) == 1


def test_snapshot_ids_follow_the_contents(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    one = writers.save_snapshot({"x": df}, str(tmp_path), "r1")
    assert writers.save_snapshot({"x": df.orderBy(F.desc("k"))}, str(tmp_path), "r2") == one
    assert writers.save_snapshot({"x": df.union(df)}, str(tmp_path), "r3") != one
    assert writers.save_snapshot({"x": df.limit(0)}, str(tmp_path), "r4") != one
    with pytest.raises(ValueError):
        writers.save_snapshot({"x": df}, str(tmp_path), "../r")


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_lines_are_numbered_across_ranges(spark, tmp_path, size):
    texts = ["é" * (i % 50) + str(i) if i % 7 else "" for i in range(200)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.jsonl").write_text("\n".join(texts[:120]) + "\n")
    (tmp_path / "a" / "2.jsonl").write_text("\n".join(texts[120:]))      # the last line has no end
    (tmp_path / "a" / ".hidden.jsonl").write_text("x\n")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.jsonl").write_text("")
    if size < 64:   # as many ranges as bytes: without Spark
        for name, part in (("1", texts[:120]), ("2", texts[120:])):
            file = str(tmp_path / "a" / f"{name}.jsonl")
            got = [x for r in log_files.ranges(file, 0, os.path.getsize(file), size) for x in log_files.lines_of(str(tmp_path), r)]
            assert [line.decode() for _, line in got] == part and [o for o, _ in got] == sorted({o for o, _ in got})
        return
    got = sorted((r["pos"], r["line"]) for r in log_files.read_lines(spark, str(tmp_path), size).collect())
    assert got == list(enumerate(t for t in texts if t))


def rows(spark, log, n, start=0):
    return spark.createDataFrame([(log, start + i, "2026-01-01T00:00:00Z", "k", f"body\n{start + i}" if i % 3 else None) for i in range(n)], "log_id string, ord long, recorded_utc string, kind string, body string")


def state(spark, root, size=300):
    return {r["log_id"]: (r["records"], r["intact"], r["first_bad"], r["problem"]) for r in chain.audit(log_files.read_records(spark, root, size)).collect()}


def test_log_is_appended_to_and_tampering_is_found(spark, tmp_path):
    root = str(tmp_path)
    assert log_files.append_records(rows(spark, "a", 5).union(rows(spark, "b", 3)), root) == {}
    assert log_files.append_records(rows(spark, "a", 4, 5), root) == {}
    assert state(spark, root) == {"a": (9, True, None, None), "b": (3, True, None, None)}
    first = sorted(os.listdir(tmp_path / "a"))[0]
    lines = (tmp_path / "a" / first).read_text().splitlines()
    for change, found in ((lines[:2] + lines[3:], (8, False, 2, "sequence out of order")), ([lines[1], lines[0], *lines[2:]], (9, False, 0, "sequence out of order")),
                          ([lines[0].replace("k", "x", 1).replace('"kind":"k"', '"kind":"z"'), *lines[1:]], None), (lines[:3] + ["no record", *lines[4:]], (9, False, 3, "sequence out of order"))):
        (tmp_path / "a" / first).write_text("\n".join(change) + "\n")
        got = state(spark, root)
        assert got["b"][1] and not got["a"][1] and (found is None or got["a"] == found)
    # a broken log is refused, the other one goes on
    assert set(log_files.append_records(rows(spark, "a", 1, 9).union(rows(spark, "b", 1, 3)), root)) == {"a"}
    assert state(spark, root)["b"] == (4, True, None, None)
    (tmp_path / "a" / first).write_text("\n".join(lines) + "\n")
    assert state(spark, root)["a"] == (9, True, None, None)


def test_an_audit_goes_on_behind_its_mark(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    log_files.append_records(rows(spark, "a", 5).union(rows(spark, "b", 3)), root)
    log_files.append_records(rows(spark, "a", 4, 5), root)

    def verdicts():
        return {r["log_id"]: tuple(r)[1:] for r in log_files.audit_files(spark, root).collect()}
    assert verdicts() == {"a": (9, True, None, None), "b": (3, True, None, None)}
    read = []
    lines = log_files.read_lines

    def counted(*args):
        d = lines(*args)
        read.append(d.count())
        return d
    monkeypatch.setattr(log_files, "read_lines", counted)
    log_files.append_records(rows(spark, "a", 2, 9), root)
    assert verdicts()["a"] == (11, True, None, None)
    assert read == [0, 2]                       # nothing ahead of the append, its own two records after it
    files = sorted((tmp_path / "a").glob("*.jsonl"))
    for at, changed in ((0, (11, False, 1, "content does not match its hash")), (2, (11, False, 9, "content does not match its hash"))):
        old = files[at].read_text()
        k = 1 if at == 0 else 0
        text = old.splitlines()
        text[k] = text[k].replace('"kind":"k"', '"kind":"kk"')
        files[at].write_text("\n".join(text) + "\n")
        assert verdicts()["a"] == changed and verdicts()["b"] == (3, True, None, None)
        files[at].write_text(old)
        assert verdicts()["a"] == (11, True, None, None)
    os.rename(files[2], tmp_path / "gone")      # what was verified is missing
    assert verdicts()["a"] == (9, True, None, None)


def test_stream_of_a_growing_log(spark, tmp_path):
    log = tmp_path / "logs" / "a"
    log.mkdir(parents=True)
    record = json.dumps({"seq": 0, "kind": "k"})
    (log / "1.jsonl").write_text(record + "\n" + record[:5])     # the second line is being written
    stream = log_files.stream_lines(spark, str(tmp_path / "logs"))
    check, out = str(tmp_path / "check"), str(tmp_path / "out")

    def go():
        q = stream.writeStream.option("checkpointLocation", check).format("parquet").start(out)
        q.processAllAvailable()
        q.stop()
        return sorted((r["offset"], r["line"]) for r in spark.read.parquet(out).collect())
    assert go() == [(0, record)]
    with open(log / "1.jsonl", "a") as f:
        f.write(record[5:] + "\n")
    (log / "2.jsonl").write_text("x\n")
    assert go() == [(0, "x"), (0, record), (len(record) + 1, record)]
    assert len(go()) == 3


def test_prefixes_of_any_length(spark):
    hashes = ["abcdef01", "abcdef02", "abc", "b", "bcdefg", "abcdef01", None]
    f = spark.createDataFrame([(h,) for h in hashes], "hash string")
    asked = ["", "a", "ab", "abc", "abcd", "abcdef", "abcdef0", "abcdef01", "abcdef012", "b", "bc", "bcdefg", "zz", None, "a"]
    got = {r["request_id"]: (r["matches"], r["hash"]) for r in ledger.match_prefixes(spark.createDataFrame(list(enumerate(asked)), "request_id int, forecast_id string"), f).collect()}
    distinct = {h for h in hashes if h}
    for k, p in enumerate(asked):
        hit = [h for h in distinct if p is not None and h.startswith(p)]
        assert got[k] == (len(hit), hit[0] if len(hit) == 1 else None), p
    assert len(got) == len(asked)


def test_archive_adds_each_key_once(spark, tmp_path):
    from linewell.sources.archive import Archive
    schema = "k int, v string, note string"
    df = spark.createDataFrame([(i % 30 if i % 30 else None, "ab"[i % 2], str(i)) for i in range(90)], schema)
    a = Archive(spark, str(tmp_path), df.schema, ["k", "v"], keys=100)
    keys = {(r["k"], r["v"]) for r in df.collect()}
    part = df.filter("k < 10 OR k IS NULL")
    first = {(r["k"], r["v"]) for r in part.collect()}
    assert a.add(part, "b1") == len(first) and a.add(df, "b1") == 0
    new, asked = a.split(df)
    assert {(r["k"], r["v"]) for r in asked.collect()} >= first and new.count() + asked.count() == len(keys)
    assert a.add(df, "b2") == len(keys) - len(first) and a.add(df, "b3") == 0 and a.add(df.limit(0), "b4") == 0
    got = [(r["k"], r["v"]) for r in a.rows().collect()]
    assert len(got) == len(keys) and set(got) == keys
    with pytest.raises(ValueError):
        a.add(df, "b0")


def test_an_overfull_filter_stays_exact(spark, tmp_path):
    from linewell.sources.archive import Archive
    df = spark.range(60_000).withColumnRenamed("id", "k")
    a = Archive(spark, str(tmp_path), df.schema, ["k"], keys=10)      # one bucket of 65,536 bits, nearly all of them set
    assert a.add(df.filter("k % 2 = 0"), "b1") == 30_000
    new, asked = a.split(df)
    assert new.count() < 20_000
    assert a.add(df, "b2") == 30_000 and a.rows().distinct().count() == 60_000


def test_keys_of_an_archive_stay_off_the_driver(spark, tmp_path):
    """A batch whose keys the filter may know is compared with the archive in shuffles: a broadcast of eight megabytes fails here."""
    from linewell.operators import ledger
    from linewell.sources.archive import Archive
    df = spark.range(400_000).withColumnRenamed("id", "k")
    a = Archive(spark, str(tmp_path), df.schema, ["k"], keys=10)
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "8m")
    try:
        assert a.add(df.filter("k < 300000"), "b1") == 300_000 and a.add(df, "b2") == 100_000
        assert ledger.unseen_rows(df, df.filter("k < 300000"), ["k"]).count() == 100_000
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)


def test_many_ranges_are_few_tasks(spark, tmp_path):
    os.makedirs(tmp_path / "a")
    lines = [f"line {i}" for i in range(20_000)]
    (tmp_path / "a" / "x.jsonl").write_text("\n".join(lines) + "\n")
    for reader in (log_files.LogReader(str(tmp_path), 20), log_files.LogStreamReader(str(tmp_path), 20)):
        parts = reader.partitions() if isinstance(reader, log_files.LogReader) else reader.partitions({}, reader.latestOffset())
        assert len(parts) <= 2 * log_files.TASKS
        assert [x for part in parts for batch in reader.read(part) for x in batch.column("line").to_pylist()] == lines
    assert sorted((r["pos"], r["line"]) for r in log_files.read_lines(spark, str(tmp_path), 20).collect()) == list(enumerate(lines))
