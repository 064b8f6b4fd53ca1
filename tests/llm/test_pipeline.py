import corpus_pipeline
from faqloom.llm import decontaminate, secrets_scan, simhash, toxicity
from faqloom.llm.queries import held_out
from pyspark.sql import functions as F
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, before, SF), "test-stage")
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()}
        assert set(new) <= set(old) and len(new) == docs.count()
        if number < 4:
            assert docs.columns == columns
        gone = set(old) - set(new)
        if number == 0:
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            scores = toxicity.scored(before, labels, learn=~held_out(F.col("_id"))).collect()
            assert gone == {s.doc_id for s in scores if s.predicted}
        if number == 1:
            assert gone == {g.doc_id for g in simhash.groups(before).collect() if g.doc_id != g.component_id}
        if number == 2:
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert gone == {r.doc_id for r in decontaminate.report(before, bench).collect() if r.contaminated}
        if number == 3:
            hit = {r.doc_id for r in secrets_scan.scan(before, secrets_scan.fit_for(before)).filter("secret").collect()}
            assert not gone and hit == {d for d in new if new[d].text != old[d].text}
            assert all(new[d].n_chars == len(new[d].text) for d in hit)
        if number == 4:
            assert all(r.copies in (1, 2) and r.text == old[r.doc_id].text for r in new.values())


def test_awkward_rows(spark):
    docs = cases.docs(spark)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.collect()
        assert number == 4 or out.columns == docs.columns
        assert stage(spark, cases.none(spark), SF).count() == 0
