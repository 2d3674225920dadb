import corpus_pipeline as cp

from lattica.llm import decontam, jaccard_join
from lattica.llm.common import BLOOM, table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (9_000_001, "", "en", "s", 0)], docs.schema))
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns and docs.exceptAll(before).count() == 0 and 0 < docs.count() <= before.count()
        if name == "ngram_jaccard_join":
            r = jaccard_join.contract(docs).collect()
            assert all(x["doc_id"] == x["component_id"] for x in r) and len({x["doc_id"] for x in r}) == len(r)
            kept = {x["component_id"] for x in jaccard_join.contract(before).collect()}
            assert {x["doc_id"] for x in r} == kept
        if name == "benchmark_decontamination":
            assert decontam.query(docs, table(spark, SF, "benchmark")).count() == 0
    assert {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_run(spark):
    out = cp.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_duplicates_end_in_a_small_query(spark):
    """The driver holds all of a query's stages and filters at once, so steps are written one by one, without Bloom filters."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    held = {k: spark.conf.get(k) for k in (*conf, BLOOM)}
    ran = spark._jsparkSession.sharedState().statusStore()
    before = ran.executionsList().size()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = table(spark, SF, "documents")
        kept = cp.near_duplicates(spark, docs, SF)
        assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
        assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in jaccard_join.contract(docs).collect()}
        plans = [ran.executionsList().apply(k).physicalPlanDescription() for k in range(before, ran.executionsList().size())]
        assert len(plans) > 10 and not any("bloom_filter" in p for p in plans)
        assert spark.conf.get(BLOOM) == held[BLOOM]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_documents(spark, tmp_path):
    """Very long texts, clashing columns, repeated ids with unequal texts, and nulls."""
    docs = table(spark, SF, "documents")
    first = docs.first()
    long = " ".join(r["text"] or "" for r in docs.limit(60).collect()) * 8
    more = [(9_000_001, long, first["lang"], "s", len(long)), (9_000_002, None, None, None, None), (None, first["text"], "en", "s", 1), (9_000_003, first["text"] + " one", "en", "s", 1), (9_000_003, "other words altogether that stand here for once", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs = docs.selectExpr("*", "doc_id as __language", "text as id", "1 as component_id", "2 as n", "'x' as score", "3 as leaks")
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        results = []
        for parts in (3, 7):
            stage(spark, docs.drop("__language").repartition(parts), SF).write.parquet(str(tmp_path / f"{name}{parts}"))
            results.append(spark.read.parquet(str(tmp_path / f"{name}{parts}")))
        a, b = results
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.columns == docs.drop("__language").columns
        docs = a
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert None in ids or k > 2
        assert 9_000_002 not in ids
