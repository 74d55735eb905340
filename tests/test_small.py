"""Saved bulk answers, side outputs, vectors and targets."""

import hashlib

import pytest
from pyspark.sql import functions as F

from winnow.functions import text
from winnow.operators import counts, sampling
from winnow.sources import files, web


def test_bulk_answers_meet_their_queries_by_place(spark):
    key = hashlib.sha256(b'["q1","q2"]').hexdigest()
    batches = spark.createDataFrame([(1, ["q1", "q2"])], "batch int, queries array<string>")
    cache = lambda *a: spark.createDataFrame([(key, list(a))], "key string, answers array<string>")
    assert sorted(map(tuple, web.bulk_lookup(batches, cache("a1", "a2")).collect())) == [(1, 0, "q1", "a1"), (1, 1, "q2", "a2")]
    with pytest.raises(Exception, match="do not fit"):
        web.bulk_lookup(batches, cache("a1")).collect()
    rows = spark.createDataFrame([("x", 200, "f"), ("x", 503, "f"), (None, None, "f"), (None, 404, "f")], "p string, s int, f string")
    assert [r[0] for r in rows.select(web.first_available(F.col("p"), F.col("s"), F.col("f"))).collect()] == ["x", "f", "f", None]


def test_side_outputs_and_vectors(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.0], "m"), ("b", [0.0, 1.0], "m")], "paper_id string, embedding array<double>, model string")
    files.side_outputs(df, {"good": F.col("paper_id") == "a", "bad": F.col("paper_id") != "a"}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/bad")).first()["paper_id"] == "b"
    df.write.parquet(str(tmp_path / "v"))
    assert files.load_vectors(spark, str(tmp_path / "v"), {"model": "m"}, 2).count() == 2
    with pytest.raises(Exception, match="another make"):
        files.load_vectors(spark, str(tmp_path / "v"), {"model": "n"}, 2).collect()


def test_targets_and_rates(spark):
    have, need = spark.createDataFrame([("a", 3)], "s string, available int"), spark.createDataFrame([("a", 3), ("b", 2)], "s string, needed int")
    assert [tuple(r) for r in sampling.shortages(have, need, "s").collect()] == [("b", 2)]
    steps = spark.createDataFrame([(1, 9.0), (2, 1.0), (3, 2.0)], "step int, seconds double")
    assert counts.mean_after_first(steps, "step", "seconds", 8).first()[0] == 1.5 / 8
    assert spark.range(1).select(sampling.collection_target(F.lit(1), F.lit(2), F.lit(3), 4)).first()[0] == 10
    assert spark.range(1).select(text.embedding_text(F.lit("T"), F.lit("A"))).first()[0] == "T\nA"
