"""Scorers: windows to family and order logits. Weights do not ship; a scorer is chosen by the caller."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake import vocab
from wavelake.operators.judging import argmax, softmax

Scorer = Callable[[DataFrame], DataFrame]


def constant(chunks: DataFrame) -> DataFrame:
    """What a missing model says: the first class, with no confidence."""
    return chunks.withColumns({"predicted_family": F.lit(vocab.FAMILIES[0]), "family_confidence": F.lit(0.0), "predicted_order": F.lit(vocab.ORDERS[0]), "order_confidence": F.lit(0.0)})


def _labels(logits: Column, names: list[str]) -> tuple[Column, Column]:
    """Name and share of the largest of as many logits as there are names."""
    p = softmax(F.slice(logits, 1, len(names)))
    return F.element_at(vocab.literal_list(names), argmax(p) + 1), F.array_max(p)


def from_columns(family: str = "family_logits", order: str = "order_logits", families: list[str] | None = None, orders: list[str] | None = None) -> Scorer:
    """Logits that the windows carry already."""

    def run(chunks: DataFrame) -> DataFrame:
        f, fc = _labels(F.col(family), families or vocab.FAMILIES)
        o, oc = _labels(F.col(order), orders or vocab.ORDERS)
        return chunks.withColumns({"predicted_family": f, "family_confidence": fc, "predicted_order": o, "order_confidence": oc})

    return run


def onnx(family_model: str, order_model: str, families: list[str], orders: list[str]) -> Scorer:
    """Two ONNX models on (batch, 2, 1024); a session is opened once in each Python worker."""

    def logits(model: str):
        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(i: pd.Series, q: pd.Series) -> pd.Series:
            import sys

            import onnxruntime

            held = sys.__dict__.setdefault("_wavelake_sessions", {})
            if model not in held:
                held[model] = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
            x = np.stack([np.stack([np.asarray(a, np.float32), np.asarray(b, np.float32)]) for a, b in zip(i, q, strict=True)])
            name = held[model].get_inputs()[0].name
            return pd.Series(list(held[model].run(None, {name: x})[0]))

        return run

    def run(chunks: DataFrame) -> DataFrame:
        scored = chunks.withColumns({"_family_logits": logits(family_model)("i", "q"), "_order_logits": logits(order_model)("i", "q")})
        return from_columns("_family_logits", "_order_logits", families, orders)(scored).drop("_family_logits", "_order_logits")

    return run


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(i: pd.Series, q: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(i, q, strict=True):
        x = np.asarray(a, float) + 1j * np.asarray(b, float)
        m = np.abs(x)
        f = np.diff(np.unwrap(np.angle(x)))
        s = np.abs(np.fft.fft(x)) ** 2
        s = s / max(s.sum(), 1e-12)
        bands = np.fft.fftshift(s).reshape(16, -1).sum(axis=1) if len(x) % 16 == 0 else np.zeros(16)
        power = [np.abs(np.fft.fft(x**k)).max() / len(x) for k in (2, 4, 8)]
        out.append([m.std() / max(m.mean(), 1e-12), f.std(), np.abs(f).mean(), np.median(np.abs(f)), *np.percentile(f, [5, 25, 75, 95]), *bands, *power])
    return pd.Series(out)


def features(chunks: DataFrame) -> DataFrame:
    """Adds `features`: envelope, frequency and spectrum statistics of a window."""
    return chunks.withColumn("features", _features("i", "q"))


def fit_ml(chunks: DataFrame, label: str, names: list[str]):
    """A Spark ML multinomial regression on window features; gives a function that adds label and confidence columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    index = F.array_position(vocab.literal_list(names), F.col(label)) - 1
    data = features(chunks).withColumn("_x", array_to_vector("features")).withColumn("_y", index.cast("double")).filter("_y >= 0")
    model = Pipeline(stages=[StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol="_y", maxIter=60, regParam=1e-3, family="multinomial")]).fit(data)

    return _applied(model, names)


def _applied(model, names: list[str]):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def run(rows: DataFrame, out: str, confidence: str) -> DataFrame:
        scored = model.transform(features(rows).withColumn("_x", array_to_vector("features")))
        p = vector_to_array("probability")
        return scored.withColumn(out, F.element_at(vocab.literal_list(names), F.col("prediction").cast("int") + 1)).withColumn(confidence, F.array_max(p)).drop("_x", "_z", "rawPrediction", "probability", "prediction", "features")

    run.model, run.names = model, names
    return run


def save_ml(fitted, path: str) -> None:
    """Keep what fit_ml gave: the model, and the names of its classes in order."""
    fitted.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    vocab.frame(spark, list(enumerate(fitted.names)), "number int, name string").coalesce(1).write.mode("overwrite").json(f"{path}/classes")


def load_ml(path: str):
    from pyspark.ml import PipelineModel

    names = SparkSession.active().read.schema("number int, name string").json(f"{path}/classes").orderBy("number").collect()
    return _applied(PipelineModel.load(f"{path}/model"), [r["name"] for r in names])
