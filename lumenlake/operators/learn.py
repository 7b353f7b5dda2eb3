"""Fitting and tuning over tables.

``fit_logistic`` and the MLlib estimators train one model on a table of any size;
``batched`` and ``selection`` train thousands of logistic ones.  ``grid_scores`` and
``transfer_scores`` run the models of ``functions.models`` on small tables: the grid of
(repeat, fold, parameters) is a table, each cell's fit is one task, and what comes back
are predictions, never models.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import models
from lumenlake.session import ship

# ------------------------------------------------------------------ large tables


def scaling(frame: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 for a constant column) of each column, in one aggregate."""
    row = frame.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}


def standardised(frame: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return frame.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})


def balanced_weight(frame: DataFrame, target: str, name: str = "class_weight") -> DataFrame:
    """n / (2 n_c) of the row's class, from one aggregate of two counts."""
    counts = frame.agg(F.count_if(F.col(target) == 1).alias("_p"), F.count_if(F.col(target) == 0).alias("_n"))
    rows = frame.crossJoin(F.broadcast(counts))
    own = F.when(F.col(target) == 1, F.col("_p")).otherwise(F.col("_n"))
    return rows.withColumn(name, (F.col("_p") + F.col("_n")) / (2.0 * own)).drop("_p", "_n")


def fit_logistic(frame: DataFrame, columns: Sequence[str], target: str, weight: str | None = None, c: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Coefficients and constant of ridge logistic regression (constant penalised) on standardised columns of a table of any size.

    Newton steps; a step is one scan that adds up gradient and curvature in each
    task, so only columns**2 numbers a task move.
    """
    spark = frame.sparkSession
    ship(spark)
    k = len(columns) + 1
    rows = frame.select(*[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(columns)], F.col(target).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    b = np.zeros(k)

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches):
            total = np.zeros(1 + k + k * k)
            for batch in batches:
                data = np.column_stack([col.to_numpy(zero_copy_only=False) for col in batch.columns])
                x, y, w = np.column_stack([data[:, :-2], np.ones(len(data))]), data[:, -2], data[:, -1]
                z = x @ at
                p = models.sigmoid(z)
                total[0] += (w * np.logaddexp(0, -(2 * y - 1) * z)).sum()
                total[1 : 1 + k] += x.T @ (w * (p - y))
                total[1 + k :] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

        got = np.zeros(1 + k + k * k)
        for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            got[r["i"]] = r["v"]
        loss = c * got[0] + 0.5 * at @ at
        return loss, c * got[1 : 1 + k] + at, c * got[1 + k :].reshape(k, k) + np.eye(k)

    now, g, h = sums(b)
    for _ in range(steps):
        d = np.linalg.solve(h, g)
        t = 1.0
        while True:
            new = sums(b - t * d)
            if new[0] <= now - 1e-4 * t * (g @ d) or t < 1e-8:
                break
            t /= 2
        done = now - new[0] <= 1e-10 * (1 + abs(now))
        b = b - t * d
        now, g, h = new
        if done:
            break
    return b[:-1], float(b[-1])


def predict_logistic(frame: DataFrame, columns: Sequence[str], coef: Sequence[float], constant: float, name: str = "probability") -> DataFrame:
    z = sum((F.col(c) * float(b) for c, b in zip(columns, coef, strict=True)), F.lit(float(constant)))
    return frame.withColumn(name, 1 / (1 + F.exp(-z)))


def estimator(name: str, columns: Sequence[str], target: str, weight: str | None = None, **params):
    """An MLlib pipeline of a classifier for tables of any size: logistic, linear_svm, random_forest, boosted."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    kinds = {
        "logistic": (LogisticRegression, {"standardization": False, "elasticNetParam": 0.0}),
        "linear_svm": (LinearSVC, {"standardization": False}),
        "random_forest": (RandomForestClassifier, {"numTrees": 500, "seed": 20260717}),
        "boosted": (GBTClassifier, {"maxIter": 300, "seed": 20260717}),
    }
    kind, defaults = kinds[name]
    model = kind(featuresCol="features", labelCol=target, **({"weightCol": weight} if weight else {}), **(defaults | params))
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), model])


def ml_score(frame: DataFrame, name: str = "score") -> DataFrame:
    """The positive class's probability of an MLlib prediction, or its margin where there is none."""
    from pyspark.ml.functions import vector_to_array

    source = "probability" if "probability" in frame.columns else "rawPrediction"
    return frame.withColumn(name, vector_to_array(source)[1]).drop("features", "rawPrediction", "probability", "prediction")


# ------------------------------------------------------------------ grids of small fits


def _frame(pdf: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    return pdf[list(columns)].to_numpy(np.float64)


def _nothing(schema) -> pd.DataFrame:
    """No rows of a schema, with its types."""
    kinds = {"integer": "int32", "long": "int64", "double": "float64"}
    return pd.DataFrame({f.name: pd.Series(dtype=kinds.get(f.dataType.typeName(), "object")) for f in schema.fields})


def _cells(frame: DataFrame, folds: DataFrame, group: str, grid: Sequence[dict]) -> DataFrame:
    """Rows once for each (repeat, held fold, parameters)."""
    spark = frame.sparkSession
    ship(spark)
    table = spark.createDataFrame([(i, json.dumps(p, sort_keys=True)) for i, p in enumerate(grid)], "param_id int, params string")
    held = folds.select("repeat", F.col("fold").alias("held")).distinct()
    return frame.join(folds, group).join(held, "repeat").crossJoin(F.broadcast(table))


def grid_scores(frame: DataFrame, folds: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str, group: str, model: str, grid: Sequence[dict], weight: str | None = None, by: str | None = None) -> DataFrame:
    """repeat, held, param_id, params and the keys and probability of each held-out row, for every cell of the grid.

    ``folds`` has (group, repeat, fold).  A cell is one task's fit, so the cells
    are what is parallel; a cell's rows must fit a worker.
    """
    out = [f for f in frame.schema.fields if f.name in keys]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("repeat", T.IntegerType()), T.StructField("held", T.IntegerType()), T.StructField("param_id", T.IntegerType()), T.StructField("params", T.StringType()), *out, T.StructField(target, T.IntegerType()), T.StructField("probability", T.DoubleType())])
    names = [f.name for f in out]
    sort = [*names]

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(sort, kind="stable")
        test = pdf["fold"] == pdf["held"]
        train = pdf[~test]
        y = train[target].to_numpy(int)
        got = pdf[test]
        if len(set(y)) < 2 or got.empty:
            return _nothing(schema)
        fitted = models.make(model, json.loads(pdf["params"].iloc[0])).fit(_frame(train, columns), y, None if weight is None else train[weight].to_numpy(float))
        return pd.DataFrame({"repeat": got["repeat"], "held": got["held"], "param_id": got["param_id"], "params": got["params"], **{n: got[n] for n in names}, target: got[target].astype(int), "probability": fitted.score(_frame(got, columns))})

    needed = list(dict.fromkeys([*names, group, target, *columns, *([weight] if weight else [])]))
    cells = _cells(frame.select(*needed), folds, group, grid)
    return cells.groupBy(*([by] if by else []), "repeat", "held", "param_id").applyInPandas(cell, schema)


def tune(scores: DataFrame, group: str, target: str) -> DataFrame:
    """param_id, params, auc of ``grid_scores``, best first: mean group-balanced AUC over repeats, ties to the earlier parameters."""
    from lumenlake.operators.metrics import auc
    from lumenlake.operators.relational import share_weight

    weighted = share_weight(scores, ["repeat", "param_id", group])
    each = auc(weighted, ["param_id", "params", "repeat"], target, "probability", "weight")
    return each.groupBy("param_id", "params").agg(F.avg("auc").alias("auc")).orderBy(F.desc(F.round("auc", 12)), "param_id")


def transfer_scores(frame: DataFrame, pairs: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str, dataset: str, model: str, params: dict, weight: str | None = None) -> DataFrame:
    """Predictions on a target dataset of a model fitted on others: run, target_dataset, keys, target, probability.

    ``pairs`` has (run, part, dataset), part being train or test; leave-one-out
    runs list several training datasets.
    """
    from pyspark.sql import types as T

    ship(frame.sparkSession)
    out = [f for f in frame.schema.fields if f.name in keys]
    names = [f.name for f in out]
    schema = T.StructType([T.StructField("run", T.StringType()), *out, T.StructField(dataset, frame.schema[dataset].dataType), T.StructField(target, T.IntegerType()), T.StructField("probability", T.DoubleType())])

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([dataset, *names], kind="stable")
        train, got = pdf[pdf["part"] == "train"], pdf[pdf["part"] == "test"]
        y = train[target].to_numpy(int)
        if len(set(y)) < 2 or got.empty:
            return _nothing(schema)
        fitted = models.make(model, params).fit(_frame(train, columns), y, None if weight is None else train[weight].to_numpy(float))
        return pd.DataFrame({"run": got["run"], **{n: got[n] for n in names}, dataset: got[dataset], target: got[target].astype(int), "probability": fitted.score(_frame(got, columns))})

    needed = list(dict.fromkeys([*names, dataset, target, *columns, *([weight] if weight else [])]))
    return frame.select(*needed).join(F.broadcast(pairs), dataset).groupBy("run").applyInPandas(cell, schema)
