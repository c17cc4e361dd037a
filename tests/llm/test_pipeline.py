from pyspark.sql import functions as F

import corpus_pipeline as P
from stackmill.llm.common import stash, table
from stackmill.llm import decontaminate, simhash


def test_stages_in_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in P.STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        sizes.append(docs.count())
        if name != "token_files":
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            groups = simhash.near_groups(docs, shingle=5, seeds=P.NEAR_SEEDS)
            assert groups.filter("component_id <> doc_id").count() == 0
        if name == "benchmark_decontamination":
            assert decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark")).filter(F.size("spans") > 0).count() == 0
        if name == "mixing_sources":
            assert docs.select("doc_id").distinct().count() == before.count()
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] >= sizes[3] and sizes[5] == sizes[4]


def test_odd_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    good = docs.filter("length(text) between 600 and 3000").orderBy("doc_id").limit(5)
    odd = good.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000_000).unionByName(good)
    names = ["score", "_score", "spans", "n_words", "items", "weight", "_weight", "n_copies", "mix_pass", "fp0", "component_id"]
    odd = odd.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    given = {r["doc_id"]: r for r in odd.collect()}
    for name, stage in P.STAGES[:4]:
        out = stage(spark, odd, sf_dir)
        rows = out.collect()
        assert out.columns == odd.columns and rows, name
        # what stays has its own values in every column but the texts that are cut
        assert all(r[c] == given[r["doc_id"]][c] for r in rows for c in (*names, "lang", "source")), name
    mixed = P.mixing_sources(spark, odd, sf_dir)
    assert {r["doc_id"] for r in mixed.collect()} == set(given)
    read = P.token_files(spark, odd, sf_dir).collect()
    assert {r["doc_id"] for r in read} == set(given) and min(r["n_tokens"] for r in read) == 1
