"""Segmentation of points: a forest over multi-scale neighbour features.

The neural network of the original needs a library that is not here; this
substitute uses the same inputs (place, colour, pooled neighbours) and MLlib.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.operators import metrics
from skyquilt.operators.neighbours import knn, multi_scale_max, outlier_flags
from skyquilt.operators.points import augment, feature_vector, normalise, sample_to, voxel_mean
from skyquilt.storage import Scratch, saved

BASE = ["x", "y", "z", "r", "g", "b"]


def features(points: DataFrame, scales: tuple[int, ...] = (4, 8)) -> DataFrame:
    """Points with the largest colour among their neighbours at several scales."""
    pooled = multi_scale_max(knn(points, points, max(scales)), points, ["r", "g", "b"], scales)
    return points.join(pooled, "idx")


def fit(points: DataFrame, scales: tuple[int, ...] = (4, 8), trees: int = 20, seed: int = 7):
    """A forest fitted on all points: it reads them several times, so their features are a table."""
    columns = BASE + [f"{c}_max{k}" for k in scales for c in "rgb"]
    scratch = Scratch(points.sparkSession)
    table = scratch.save(features(points, scales))
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), RandomForestClassifier(numTrees=trees, maxDepth=6, labelCol="label", featuresCol="features", seed=seed)]).fit(table)
    scratch.drop(table)
    return model


def predict(model, points: DataFrame, scales: tuple[int, ...] = (4, 8)) -> DataFrame:
    """``idx, label, pred`` of every point."""
    return model.transform(features(points, scales)).select("idx", "label", F.col("prediction").cast("int").alias("pred"))


def predict_chunks(model, points: DataFrame, chunk: int = 8192, scales: tuple[int, ...] = (4, 8)) -> DataFrame:
    """``idx, chunk, pred``: each chunk of the points, in their order, is predicted from the neighbours in it alone.

    Chunks are as they come, without filling up, and results keep their ``idx``.
    """
    chunked = points.withColumn("chunk", F.floor(F.col("idx") / chunk))
    pooled = multi_scale_max(knn(chunked, chunked, max(scales), within=("chunk",)), points, ["r", "g", "b"], scales)
    return model.transform(chunked.join(pooled, "idx")).select("idx", "chunk", F.col("prediction").cast("int").alias("pred"))


def evaluate(model, points: DataFrame, classes: int, scales: tuple[int, ...] = (4, 8)) -> DataFrame:
    """Overall accuracy, mean recall and mean IoU of a model's predictions on labelled points: one row."""
    return metrics.overall(metrics.confusion(predict(model, points, scales), classes), classes)


def predict_cloud(model, points: DataFrame, n: int, seed: int = 0, scales: tuple[int, ...] = (4, 8)) -> DataFrame:
    """``idx, label, pred`` of ``n`` points sampled from a cloud and normalised; a point drawn several times has a row for each draw."""
    drawn = saved(sample_to(points, n, seed).withColumn("scene", F.lit(0)))
    scene = normalise(drawn.dropDuplicates(["idx"])).select("idx", "label", "r", "g", "b", *[F.col(f"n{a}").alias(a) for a in "xyz"])
    return drawn.select("idx").join(predict(model, scene, scales), "idx")


def dataset_item(points: DataFrame, n: int, voxel: float, seed: int = 0, train: bool = False, k: int = 16, std_ratio: float = 2.0) -> DataFrame:
    """A training item of a cloud: voxel means, outliers left out, ``n`` points sampled, normalised, changed at random if ``train``, with their feature vector."""
    thinned = voxel_mean(points, voxel)
    numbered = saved(thinned.withColumn("idx", F.xxhash64("kx", "ky", "kz")).drop("kx", "ky", "kz", "n"))
    inliers = numbered.join(outlier_flags(numbered, k, std_ratio).where("keep").select("idx"), "idx", "left_semi")
    scene = normalise(sample_to(inliers, n, seed).withColumn("scene", F.lit(0))).select("idx", "scene", "label", "r", "g", "b", *[F.col(f"n{a}").alias(a) for a in "xyz"])
    return feature_vector(augment(scene, seed) if train else scene, with_colour=True).select("idx", "label", "features")


def save_model(model, path: str, keep: int = 3) -> list[str]:
    """Save a model below ``path`` under the next number and remove all but the last ``keep``; returns the numbers left."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(conf)
    there = sorted(f.getPath().getName() for f in system.listStatus(root)) if system.exists(root) else []
    there = [t for t in there if t.isdigit()]
    name = f"{int(there[-1]) + 1 if there else 0:06d}"
    model.save(f"{path}/{name}")
    there.append(name)
    for old in there[:-keep]:
        system.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)
    return there[-keep:]


def load_model(path: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/{name}")
