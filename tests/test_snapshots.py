"""Snapshots stay whole through broken rows and failed tasks."""

import pytest
from pyspark.sql import functions as F

from tessella.sources import snapshots


def tables(spark, first, n=50):
    products = spark.range(first, first + n).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("key"), F.col("id"))
    return {"products": products, "metrics": products.agg(F.count("*").alias("n"), F.min("id").alias("least"))}


def checks():
    return {"products": {"a key is missing": F.col("key").isNotNull(), "id is negative": F.col("id") >= 0}}


def seen(spark, path):
    return spark.read.parquet(snapshots.folder(spark, path, "products")).count(), tuple(spark.read.parquet(snapshots.folder(spark, path, "metrics")).first())


def test_versions_become_visible_together_and_faults_leave_the_old_one(spark, tmp_path):
    path = str(tmp_path / "s")
    assert snapshots.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        snapshots.folder(spark, path, "products")
    first = snapshots.publish(spark, path, tables(spark, 0), checks())
    assert seen(spark, path) == (50, (50, 0)) and snapshots.current(spark, path) == first

    broken = tables(spark, 100)
    broken["products"] = broken["products"].withColumn("key", F.when(F.col("id") != 120, F.col("key"))).withColumn("id", F.when(F.col("id") < 130, F.col("id")).otherwise(-1))
    with pytest.raises(snapshots.Rejected) as e:
        snapshots.publish(spark, path, broken, checks())
    assert e.value.failed == {"products": {"a key is missing": 1, "id is negative": 20}} and seen(spark, path) == (50, (50, 0))

    failing = tables(spark, 200)  # the products are written before the job of the metrics fails
    failing["metrics"] = failing["metrics"].select(F.raise_error(F.lit("lost")).cast("long").alias("n"), "least")
    with pytest.raises(Exception, match="lost"):
        snapshots.publish(spark, path, failing, checks())
    assert seen(spark, path) == (50, (50, 0)) and snapshots.current(spark, path) == first
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == [first]

    second = snapshots.publish(spark, path, tables(spark, 300, 7), checks())
    assert seen(spark, path) == (7, (7, 300)) and second != first
    snapshots.prune(spark, path)
    assert seen(spark, path) == (7, (7, 300)) and sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == [second]


def test_other_formats_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "s")
    snapshots.publish(spark, path, {"delivery": spark.createDataFrame([("1", "")], "a string, b string"), "empty": spark.range(0)}, {"empty": {"never": F.lit(False)}}, {"delivery": snapshots.csv, "empty": snapshots.json})
    assert [tuple(r) for r in spark.read.csv(snapshots.folder(spark, path, "delivery"), header=True).collect()] == [("1", None)]
    with pytest.raises(ValueError, match="named by"):
        snapshots.publish(spark, path, {"../x": spark.range(1)})
