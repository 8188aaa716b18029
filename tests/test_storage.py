import os
import threading

from pyspark.sql import functions as F

from skyquilt import storage
from skyquilt.operators import neighbours


def test_setting_after_writes_at_once(spark):
    """Writes of several threads leave the session's setting as it was."""
    before, scratch = spark.conf.get(storage.CLEANUP), storage.Scratch(spark)
    spark.conf.set(storage.CLEANUP, "false")
    threads = [threading.Thread(target=lambda: scratch.save(spark.range(1000).repartition(5))) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(storage.CLEANUP) == "false"
    spark.conf.set(storage.CLEANUP, before)


def test_clear(spark):
    p = spark.range(50).select(F.col("id").alias("idx"), *[(F.col("id") * k % 7).cast("double").alias(a) for k, a in ((3, "x"), (5, "y"), (2, "z"))])
    assert neighbours.knn(p, p, 3).count() == 150
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert any(d.startswith("skyquilt-") for d in os.listdir(root))
    storage.clear(spark)
    assert not any(d.startswith("skyquilt-") for d in os.listdir(root))
