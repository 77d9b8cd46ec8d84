"""Training, evaluation, tuning and persistence of the detectors."""

from __future__ import annotations

import itertools
import pickle
import time
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlantern.operators import metrics as me
from flowlantern.operators.iforest import IsolationForestModel, fit_isolation_forest
from flowlantern.operators.kernel import OneClassSvmModel, fit_kernel_svc, fit_one_class_svm
from flowlantern.operators.logistic import fit_logistic

ANOMALY_MODELS = ("isolation_forest", "one_class_svm")


@dataclass(frozen=True)
class ModelSettings:
    trees: int = 100
    depth: int = 10
    contamination: float = 0.1
    nu: float = 0.1
    seed: int = 42
    logistic_iterations: int = 1000
    svm_iterations: int = 100
    cost: float = 1.0
    enabled: tuple[str, ...] = ("random_forest", "isolation_forest", "one_class_svm")
    evaluators: dict = field(default_factory=dict)


def split(df: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    return df.where(me.is_train(F.col("pid"), percent)), df.where(~me.is_train(F.col("pid"), percent))


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.col("label").cast("double"))


def random_forest(features: list[str], s: ModelSettings = ModelSettings()) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="vector"),
        RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=s.trees, maxDepth=s.depth, seed=s.seed)])


def logistic_regression(features: list[str], rows: int, s: ModelSettings = ModelSettings()) -> Pipeline:
    """L2 with C = 1, i.e. regParam 1 / rows, on unscaled features."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="vector"),
        LogisticRegression(featuresCol="vector", labelCol="label", maxIter=s.logistic_iterations, regParam=1.0 / max(rows, 1),
                           standardization=False)])


def normal_rows(train: DataFrame) -> DataFrame:
    """Rows labelled 0 for one-class training; all rows where there are none."""
    normal = train.where(F.col("label") == 0)
    return train if normal.isEmpty() else normal


def train(name: str, df: DataFrame, features: list[str], s: ModelSettings = ModelSettings()):
    if name == "random_forest":
        return random_forest(features, s).fit(_labelled(df))
    if name == "logistic_regression":
        return fit_logistic(_labelled(df), features, logistic_regression(features, df.count(), s))
    if name == "isolation_forest":
        return fit_isolation_forest(normal_rows(df), features, s.trees, contamination=s.contamination, seed=s.seed)
    if name == "one_class_svm":
        return fit_one_class_svm(normal_rows(df), features, s.nu, seed=s.seed)
    if name == "svm":
        return fit_kernel_svc(df, features, seed=s.seed, iterations=s.svm_iterations, cost=s.cost)
    raise ValueError(f"unknown model {name}")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def predict(name: str, model, df: DataFrame) -> DataFrame:
    """Adds prediction (0/1), model_confidence, and score for ranking.

    Classifiers: the larger class probability. One-class models: 1 - sigmoid(decision).
    """
    if name in ANOMALY_MODELS:
        out = model.transform(df)
        return out.withColumn("model_confidence", 1.0 - sigmoid(F.col("decision"))).withColumn(
            "score", -F.col("decision")).drop("decision", "iforest_score")
    out = model.transform(_labelled(df) if "label" in df.columns else df)
    p = F.col("probability") if name == "svm" else vector_to_array("probability")[1]
    out = out.withColumn("score", p).withColumn("model_confidence", F.greatest("score", 1.0 - F.col("score")))
    return out.withColumn("prediction", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "vector", "margin")


def evaluate(name: str, model, test: DataFrame) -> DataFrame:
    """One row: model, accuracy, weighted precision, recall, F1."""
    conf = me.confusion(predict(name, model, test))
    return me.weighted_metrics(conf).select(F.lit(name).alias("model"), *me.METRICS)


def auc(name: str, model, test: DataFrame) -> float:
    scored = predict(name, model, test).select(F.col("score"), F.col("label").cast("double").alias("label"))
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(scored)


def train_all(df: DataFrame, features: list[str], s: ModelSettings = ModelSettings(), folds: int = 0) -> tuple[dict, DataFrame]:
    """Every enabled model, fitted on 80 % and evaluated on 20 %: (models, table of metrics, AUC and fit time).

    With ``folds`` the table also has ``cv_mean`` and ``cv_sd``, the weighted F1 of the classifiers over folds of the training
    rows; the one-class models, which learn from normal rows only, have nulls there.
    """
    tr, te = split(df)
    tr = tr.select("pid", "label", *features).persist()  # addresses and times need not be held
    models, info, table = {}, [], None
    for n in s.enabled:
        begin = time.perf_counter()
        models[n] = train(n, tr, features, s)
        seconds = time.perf_counter() - begin
        # ranking quality needs class probabilities, which the one-class models do not give
        one_class = n in ANOMALY_MODELS
        cv = fold_scores(tr, features, (n,), folds, s).first() if folds and not one_class else None
        info.append((n, None if one_class else float(auc(n, models[n], te)), seconds, cv and cv.cv_f1, cv and cv.cv_sd))
        row = evaluate(n, models[n], te)
        table = row if table is None else table.unionByName(row)
    tr.unpersist()
    facts = df.sparkSession.createDataFrame(info, "model string, auc_roc double, train_seconds double, cv_mean double, cv_sd double")
    if not folds:
        facts = facts.drop("cv_mean", "cv_sd")
    return models, table.join(F.broadcast(facts), "model")  # one row per model


def cross_validate(df: DataFrame, estimator: Pipeline, grid: list | None = None, folds: int = 5, parallelism: int = 2):
    """k-fold search scored by weighted F1; the folds come from the row id, so they need no shuffle."""
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid or ParamGridBuilder().build(), numFolds=folds, foldCol="fold",
        evaluator=MulticlassClassificationEvaluator(metricName="f1", labelCol="label"), parallelism=parallelism)
    return cv.fit(_labelled(df).withColumn("fold", me.fold(F.col("pid"), folds)))


def fold_scores(df: DataFrame, features: list[str], names: tuple[str, ...], folds: int = 5, s: ModelSettings = ModelSettings()) -> DataFrame:
    """(model, fold, f1, cv_f1, cv_sd): weighted F1 of every model on every fold, with their mean and population sd.

    As for training, one-class models learn from the normal rows of the other folds only.
    """
    held = df.is_cached  # the folds of rows that the caller holds are marked on the fly, not held twice
    df = _labelled(df).withColumn("fold", me.fold(F.col("pid"), folds))
    if not held:
        df = df.persist()
    try:
        rows = []
        for n in names:
            f1 = []
            for k in range(folds):
                model = train(n, df.where(F.col("fold") != k), features, s)
                f1.append(float(evaluate(n, model, df.where(F.col("fold") == k)).first().f1_score))
            rows += [(n, k, f, float(np.mean(f1)), float(np.std(f1))) for k, f in enumerate(f1)]
    finally:
        if not held:
            df.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, fold int, f1 double, cv_f1 double, cv_sd double")


# ---- fixed values: what can be searched, by the names of ModelSettings or of the MLlib estimator
SEARCHABLE = {
    "random_forest": None, "logistic_regression": None, "isolation_forest": {"trees", "contamination"},
    "one_class_svm": {"nu"}, "svm": {"cost", "svm_iterations"},
}


def grid_search(df: DataFrame, features: list[str], grid: dict[str, list], name: str = "random_forest", folds: int = 5,
                s: ModelSettings = ModelSettings()) -> tuple[object, DataFrame]:
    """(best model, table of parameters with their mean score and whether they won).

    The forest and the logistic model take parameters of their MLlib estimators; the isolation forest, the one-class SVM and the
    kernel SVC those fields of ``ModelSettings`` that ``SEARCHABLE`` names. All are scored by weighted F1 over the same folds of the
    training rows; the winner is fitted on all of them and scored once on the test rows. Of equal scores the first in the grid wins.
    """
    if name not in SEARCHABLE:
        raise ValueError(f"no search for {name}: {', '.join(SEARCHABLE)} can be tuned")
    tr, te = split(df)
    if SEARCHABLE[name] is None:
        best_model, found, test_f1 = _search_mllib(name, tr, te, features, grid, folds, s)
    else:
        unknown = set(grid) - SEARCHABLE[name]
        if unknown:
            raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
        settings = [replace(s, **dict(zip(grid, values))) for values in itertools.product(*grid.values())]
        found = []
        for one in settings:
            row = fold_scores(tr, features, (name,), folds, one).first()
            found.append((", ".join(f"{k}={getattr(one, k)}" for k in sorted(grid)), row.cv_f1, row.cv_sd))
        best_model = train(name, tr, features, settings[max(range(len(found)), key=lambda i: found[i][1])])
        test_f1 = evaluate(name, best_model, te).first().f1_score
    best = max(range(len(found)), key=lambda i: found[i][1])
    rows = [(*row, i == best, float(test_f1) if i == best else None) for i, row in enumerate(found)]
    return best_model, df.sparkSession.createDataFrame(rows, "params string, cv_f1 double, cv_sd double, best boolean, test_f1 double")


def _search_mllib(name: str, tr: DataFrame, te: DataFrame, features: list[str], grid: dict[str, list], folds: int, s: ModelSettings):
    pipe = random_forest(features, s) if name == "random_forest" else logistic_regression(features, tr.count(), s)
    est, builder = pipe.getStages()[-1], ParamGridBuilder()
    for p, values in grid.items():
        builder = builder.addGrid(getattr(est, p), values)
    maps = builder.build()
    fitted = cross_validate(tr, pipe, maps, folds)
    test_f1 = MulticlassClassificationEvaluator(metricName="f1", labelCol="label").evaluate(
        fitted.bestModel.transform(_labelled(te)))
    found = [(", ".join(f"{k.name}={v}" for k, v in sorted(m.items(), key=lambda kv: kv[0].name)), float(a), float(sd))
             for m, a, sd in zip(maps, fitted.avgMetrics, fitted.stdMetrics)]
    return fitted.bestModel, found, test_f1


def voted(models: dict, df: DataFrame) -> DataFrame:
    """``df`` with the predictions of all models in an array ``votes`` of (model, vote, model_confidence): one projection over one scan."""
    out, columns = df, []
    for i, (name, m) in enumerate(models.items()):
        columns.append(f"_vote_{i}")
        out = predict(name, m, out).withColumn(columns[-1], F.struct(
            F.lit(name).alias("model"), F.col("prediction").alias("vote"), F.col("model_confidence").cast("double").alias("model_confidence")))
        out = out.drop("prediction", "model_confidence", "score")
    kept = [F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return out.select(*kept, F.array(*columns).alias("votes"))


def votes(models: dict, df: DataFrame) -> DataFrame:
    """Predictions of all models as a long table (pid, model, vote, model_confidence)."""
    return voted(models, df).select("pid", F.inline("votes"))


# ---- persistence --------------------------------------------------------------------------------
def save_models(spark: SparkSession, models: dict, metrics: DataFrame, path: str) -> None:
    """MLlib models with their writer, the others as one small binary row each; metrics as Parquet."""
    for name, m in models.items():
        if isinstance(m, PipelineModel):
            m.write().overwrite().save(f"{path}/{name}")
        else:
            spark.createDataFrame([(bytearray(pickle.dumps(m.__dict__)),)], "model binary").coalesce(1).write.mode(
                "overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(n, isinstance(m, PipelineModel)) for n, m in models.items()], "model string, mllib boolean"
                          ).coalesce(1).write.mode("overwrite").parquet(f"{path}/names")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def load_models(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    kinds = {"isolation_forest": IsolationForestModel, "one_class_svm": OneClassSvmModel}
    models = {}
    for r in spark.read.parquet(f"{path}/names").orderBy("model").collect():
        if r.mllib:
            models[r.model] = PipelineModel.load(f"{path}/{r.model}")
        else:  # only load models from a folder you trust: the row is a pickle
            blob = spark.read.parquet(f"{path}/{r.model}").first().model
            models[r.model] = kinds[r.model](**pickle.loads(bytes(blob)))
    return models, spark.read.parquet(f"{path}/metrics")
