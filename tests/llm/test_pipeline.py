from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as contract
from test_packing import check_bins

from chirpmill.llm import packing


def test_stages_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "near_duplicates", "benchmark_decontamination", "best_fit_packing"]
    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert ("pipeline" in contract.oracle_sql()) == (corpus_pipeline.ORACLE_SQL is not None)


def test_each_stage_keeps_the_columns_and_does_its_work(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        now = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) <= ids and len(now) >= 0.8 * len(ids), name
        ids = set(now)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check_bins(rows, packing.CAPACITIES)
    assert {r["doc_id"] for r in rows} == ids
    # what a stage did leaves nothing for the same stage to do
    for name, stage in corpus_pipeline.STAGES[1:4]:
        again = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), folder)
        assert again.count() == spark.read.parquet(f"{tmp_path}/{name}").count(), name


def test_an_exact_copy_with_short_lines_goes_as_a_whole(spark):
    long = "these words stand in one line that is long enough"
    rows = [(1, f"Head\n{long}\n\n  Les. \n"), (2, f"Head\n{long}\n\n  Les. \n"), (3, f"{long}\nonly here"), (4, "only here\nHead")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    # no word is lost: the short line that stands nowhere earlier stays, though its document lost all others
    assert got == {1: rows[0][1], 3: "only here"}
