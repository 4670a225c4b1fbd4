import corpus_pipeline
from linewell.llm import decontaminate, exact_dedup, queries, simhash


def test_stages(spark, sf, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == (columns if name != "mixing" else [*columns, "copy"])
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "exact_dedup":
            assert exact_dedup.exact_dedup(before).filter("kept").count() == after.count() == exact_dedup.exact_dedup(after).filter("kept").count()
        if name == "decontamination":
            assert decontaminate.leaks(after, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        before = after
    assert before.count() > 0
    ids = sorted(map(tuple, before.select("doc_id", "copy").collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "copy").collect())) == ids


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_the_near_copy_stage_keeps_one_of_each_simhash_component(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = " ".join(f"w{i}" for i in range(3000))
    refrain = "one two three four five " * 100      # its repeats weigh in a fingerprint; as sets of shingles the two are unlike
    more = spark.createDataFrame([(10**9, text), (10**9 + 1, text.replace("w1500", "other")), (None, text), (10**9 + 2, refrain), (10**9 + 3, refrain + "six seven eight nine ten eleven twelve")],
                                 "doc_id long, text string")
    rows = docs.unionByName(more, allowMissingColumns=True)
    component = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(rows).collect() if r["doc_id"] is not None}
    alike = {r["doc_id"] for r in simhash.one_of_each(rows).collect()}
    got = [r["doc_id"] for r in corpus_pipeline.near_stage(spark, rows, sf).collect()]
    assert got.count(None) == 1
    kept = {i for i in got if i is not None}
    assert len({component[i] for i in kept}) == len(kept) and kept <= alike and 10**9 + 3 in alike
    assert {i for i in kept if i >= 10**9} == {10**9, 10**9 + 2}
