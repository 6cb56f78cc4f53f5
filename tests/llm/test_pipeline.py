"""The pipeline on given and on awkward rows; the queries' columns."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from weirline.llm import chosen_path, queries, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    score = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        if k == 0:
            assert after == {i for i in before if score[i] < 0.5}
        if k == 1:
            pairs = {r.doc_id: r.class_id for r in chosen_path.join(spark.read.parquet(str(tmp_path / "0"))).collect()}
            assert after == {i for i in before if pairs[i] == i}
        if k == 2:
            assert after == set(before)
    assert counts[-1] == counts[-2] and counts[1] <= counts[0]


def test_stages_on_awkward_and_empty_rows(spark, docs, no_docs, tmp_path):
    for name, rows in (("some", docs), ("none", no_docs)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, rows, FOLDER).write.parquet(str(tmp_path / f"{name}{k}"))
            rows = spark.read.parquet(str(tmp_path / f"{name}{k}"))


CLASHES = "row own of rest stay times _row _stay _mix_row _mix_n _mix_of _key _rest _score _evidence removed sha at n path s id copies".split()


def test_stages_leave_columns_of_any_name_alone(spark, docs):
    """Extra columns come out as they went in, whatever their name."""
    full = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).drop("row")
    named = full.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES], F.lit("x").alias("odd name`s"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, named, FOLDER)
        assert got.columns == named.columns
        rows = got.collect()
        assert rows
        for r in rows:
            assert all(r[c] == f"{c}:{r['doc_id']}" for c in CLASHES) and r["odd name`s"] == "x"


def test_registered_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.SQL) <= set(queries.QUERIES)
