from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from obslab.operators.cleaning import normalise
from obslab.operators.models import Variant, fit
from obslab.spec import DatasetSpec
from obslab.streaming import jobs

SPEC = DatasetSpec(label="y", numeric=("x",), categorical=("c",), key=("id",), labels=("a", "b"),
                   categories={"c": ("p", "q", "unknown")})


def rows(spark, start, stop):
    i = F.col("id")
    return spark.range(start, stop).select(
        "id", F.when(i % 5 == 0, "bad").otherwise(i.cast("string")).alias("x"), F.when(i % 2 == 0, "p").otherwise("q").alias("c"),
        F.when(i % 3 == 0, "").when(i % 3 == 1, " a").otherwise("b").alias(SPEC.confirmed),
        F.timestamp_seconds(1_700_000_000 + i).alias("ts"),
    )


@pytest.fixture
def incoming(spark, tmp_path):
    folder = f"{tmp_path}/incoming"
    rows(spark, 0, 60).repartition(3).write.parquet(folder)
    return folder


def test_ingest_equals_the_batch_result_and_continues(spark, tmp_path, incoming):
    schema = spark.read.parquet(incoming).schema
    def run():
        stream = jobs.read_stream(spark, incoming, schema, files_per_trigger=1)
        jobs.ingest(stream, SPEC, "serve", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    run()
    rows(spark, 60, 100).write.mode("append").parquet(incoming)
    run()
    run()
    batch = normalise(spark.read.parquet(incoming), SPEC, "serve")
    good, bad = (spark.read.parquet(f"{tmp_path}/out/{k}") for k in ("good", "quarantine"))
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    assert ids(good) == ids(batch.where(F.size("errors") == 0)) and ids(bad) == ids(batch.where(F.size("errors") > 0))


def test_single_file_as_stream(spark, tmp_path, incoming):
    import pathlib

    name = next(p for p in pathlib.Path(incoming).iterdir() if p.suffix == ".parquet")
    stream = jobs.read_stream(spark, str(name), spark.read.parquet(incoming).schema)
    jobs.ingest(stream, SPEC, "serve", f"{tmp_path}/one", f"{tmp_path}/one-state").awaitTermination()
    kept = sum(spark.read.parquet(f"{tmp_path}/one/{k}").count() for k in ("good", "quarantine"))
    assert kept == spark.read.parquet(str(name)).count() < 60


def test_repeated_arrivals_are_saved_once(spark, tmp_path, incoming):
    rows(spark, 20, 60).write.mode("append").parquet(incoming)
    stream = jobs.read_stream(spark, incoming, spark.read.parquet(incoming).schema, files_per_trigger=1)
    jobs.save_once(stream, "id", "ts", f"{tmp_path}/saved", f"{tmp_path}/state").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/saved").collect()) == list(range(60))


def test_running_counts(spark, tmp_path, incoming):
    stream = jobs.read_stream(spark, incoming, spark.read.parquet(incoming).schema, files_per_trigger=1)
    jobs.running_label_counts(stream, SPEC, f"{tmp_path}/counts", f"{tmp_path}/state").awaitTermination()
    got = {r["y"]: r["n"] for r in jobs.latest_counts(spark, f"{tmp_path}/counts").collect()}
    assert got == {"a": 20, "b": 20}


def test_streamed_scores_equal_batch_scores(spark, tmp_path, incoming):
    stored = spark.read.parquet(incoming)
    train = stored.where("x != 'bad'").select(
        "id", F.col("x").cast("double").alias("x"), "c", F.when(F.col("id") < 30, "a").otherwise("b").alias("y"))
    model = replace(fit(train, SPEC, Variant("m", trees=2)), version="v1")
    stream = jobs.read_stream(spark, incoming, stored.schema).select("id", "x", "c")
    jobs.score_stream(stream, model, f"{tmp_path}/scored", f"{tmp_path}/state").awaitTermination()
    got = {r["id"]: r["predicted_y"] for r in spark.read.parquet(f"{tmp_path}/scored/scored").collect()}
    assert got == {r["id"]: r["predicted_y"] for r in model.predict(train).collect()} and len(got) == 48
    refused = {r["id"]: r["errors"] for r in spark.read.parquet(f"{tmp_path}/scored/refused").collect()}
    assert refused == {i: ["x:not_a_number"] for i in range(0, 60, 5)}


def test_rows_that_arrive_in_reverse_order_are_all_saved(spark, tmp_path):
    folder = f"{tmp_path}/reverse"
    for start in (750, 500, 250, 0, 500):
        rows(spark, start, start + 250).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
        jobs.save_once(stream, "id", "ts", f"{tmp_path}/kept", f"{tmp_path}/kept-state").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == list(range(1000))
